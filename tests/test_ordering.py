import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motespark.functions.scalar import random_walk
from motespark.operators import motion as m
from motespark.operators import ordering as o


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice([None, 1, 1, 1, 1, 2]), i, rng.choice([None, rng.random()]), 1) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g bigint, i bigint, v double, _part bigint"), data


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbers_and_totals(spark, groups):
    """A group over many ranges counts on; NULL is a group, extra columns of clashing names stay."""
    df, data = table(spark)
    df = df.repartition(7)
    got = {r.i: r for r in o.running_total(o.numbered(df, groups, ["i"], "n"), groups, ["i"], "v", "t").collect()}
    n, t = {}, {}
    for g, i, v, _ in sorted(data, key=lambda r: r[1]):
        key = g if groups else 0
        assert got[i].n == n.get(key, 0) and got[i]._part == 1
        n[key], t[key] = n.get(key, 0) + 1, t.get(key, 0) + (v or 0)
        assert got[i].t == pytest.approx(t[key])
    assert o.numbered(df.limit(0), groups, ["i"], "n").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.31, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("few", [50, 10**6])
def test_quantile(spark, monkeypatch, q, few):
    monkeypatch.setattr(o, "FEW", few)
    monkeypatch.setattr(o, "ACCURACY", 200)
    v = np.random.default_rng(2).normal(size=3000)
    v[:900] = 0.25
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    assert o.quantile(df, "v", q) == pytest.approx(np.quantile(v, q), abs=1e-12)
    assert o.quantile(df.limit(0), "v", q) is None


def test_random_walk(spark):
    w = random_walk(spark.range(500).toDF("t"), "t", seed=1).orderBy("t").toPandas().walk.to_numpy()
    assert len(w) == 500 and 0.8 < np.diff(w).std() < 1.2


def test_entropy_any_block(spark, rows):
    rng = np.random.default_rng(0)
    xy = np.cumsum(rng.normal(size=(90, 2)), axis=0)
    xy[40:60] = xy[39] + np.outer(np.arange(1, 21), (1.0, 0.2))
    df = spark.createDataFrame([(1, f, float(x), float(y)) for f, (x, y) in enumerate(xy)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0)], "particle bigint, frame bigint, x double, y double")
    one = rows(m.min_rolling_theta_entropy(df, 10))
    assert one == rows(m.min_rolling_theta_entropy(df, 10, block=12)) == rows(m.min_rolling_theta_entropy(df, 10, block=1))
    assert dict(one)[1] == pytest.approx(0.0) and dict(one)[2] is None
    assert F is not None
