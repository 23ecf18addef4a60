import math
import random

import pytest
from pyspark.sql import functions as F

from motespark.operators import static as s
from motespark.operators.components import connected_components

P = "frame bigint, id bigint, x double, y double"


def test_proximity(spark, rows):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0), (0, 3, 5000.0, 0.0), (1, 4, 1.0, 1.0), (2, 5, 1.0, 1.0), (2, 6, 1.0, 1.0), (2, 7, None, 1.0)], P)
    got = rows(s.proximity(df, ["frame"], "id", cell=2.0), "id", "proximity")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6]
    assert got[0][1] == 5 and got[1][1] == 5 and got[2][1] == pytest.approx(math.hypot(4997, 4)) and got[3][1] is None and got[4][1] == got[5][1] == 0


def test_lattice_2d(spark):
    grid = [(0, 20 * i + j, float(i), float(j)) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(grid, P)
    args = {"dr": 0.5, "boundary": [(-0.5, 19.5), (-0.5, 19.5)]}
    every = {r.bin: r.g_r for r in s.pair_correlation_2d(df, ["frame"], "id", 8.0, **args).collect()}
    middle = {r.bin: r.g_r for r in s.pair_correlation_2d(df, ["frame"], "id", 8.0, subset=F.col("id") == 210, **args).collect()}
    assert len(every) == 16
    for b in every:
        assert every[b] == pytest.approx(middle[b], rel=0.1)
    bare = {r.bin: r.g_r for r in s.pair_correlation_2d(df, ["frame"], "id", 8.0, handle_edge=False, **args).collect()}
    assert sum(bare.values()) < 0.9 * sum(every.values())


def test_sphere_in_a_corner(spark):
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("d", 1.0), ("p", 0.0), ("lo", 0.0), ("hi", 9.0), ("mid", 4.5))])
    box = [(F.col("lo"), F.col("hi"))] * 3
    c = F.col
    r = df.select(
        s.area_3d_bounded(c("d"), [c("p"), c("p"), c("p")], box).alias("corner"), s.area_3d_bounded(c("d"), [c("p"), c("p"), c("mid")], box).alias("edge"),
        s.area_3d_bounded(c("d"), [c("p"), c("mid"), c("mid")], box).alias("face"), s.area_3d_bounded(c("d"), [c("mid")] * 3, box).alias("inside"),
        s.arclen_2d_bounded(c("d"), [c("p"), c("p")], box[:2]).alias("quarter"), s.arclen_2d_bounded(c("d"), [c("mid"), c("p")], box[:2]).alias("half"),
    ).first()
    sphere = 4 * math.pi
    assert [r.corner, r.edge, r.face, r.inside] == pytest.approx([sphere / 8, sphere / 4, sphere / 2, sphere])
    assert [r.quarter, r.half] == pytest.approx([math.pi / 2, math.pi])


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(0, 199)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "id_a bigint, id_b bigint")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[1000 + i] == 1000 for i in range(150)) and len(got) == 350


def test_clusters(spark, rows):
    pts = [(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 2.0, 0.0), (0, 4, 9.0, 9.0), (1, 5, 0.0, 0.0), (1, 6, None, 0.0)]
    got = rows(s.cluster(spark.createDataFrame(pts, P), ["frame"], "id", 1.0), "id", "cluster", "cluster_size")
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)]


def test_close(spark, rows):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0), (0, 2, 1.0, 0.0, 4.0), (0, 3, 10.0, 0.0, 1.0), (0, 4, 10.5, 0.0, 1.0), (0, 5, 30.0, 0.0, 1.0), (0, 6, 32.0, 0.0, 1.0)], P + ", mass double")
    assert rows(s.where_close(df, ["frame"], "id", 2.0, intensity="mass"), "id") == [(2,), (3,)]
    assert rows(s.drop_close(df, ["frame"], "id", 2.0), "id") == [(2,), (4,), (5,), (6,)]
    assert s.where_close(df, ["frame"], "id", 0).count() == 0
