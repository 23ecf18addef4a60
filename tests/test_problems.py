"""The general data problems: brute force, edge cases, skew."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motespark.operators.near import in_ring, near_pairs, near_pairs_geo, points_in_regions
from motespark.operators.regular_grid import to_regular_grid
from motespark.operators.rolling import CELLS, MONOIDS, _segments, rolling, two_stack
from motespark.operators.spikes import flag_readings, forest_scores, usual_step

NAN = float("nan")
TRAJ = "video bigint, particle bigint, frame bigint, x double, y double, k0 string, v0 double, t string, slot string, seg bigint, blk bigint"


def traj(spark, data):
    """Rows (video, particle, frame, x, y) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "k", 1.5, "t", "s", 7, 8) for r in data], TRAJ)


# --- regular grid


def test_grid(spark, rows):
    t = traj(spark, [(1, 1, 0, 0.0, 1.0), (1, 1, 0, 0.0, 1.0), (1, 1, 3, 3.0, 4.0), (1, 1, 13, 8.0, 9.0), (1, 1, 20, NAN, 1.0), (1, None, 5, 1.0, 1.0), (None, 1, 5, 1.0, 1.0), (1, 2, 7, 5.0, None), (1, 3, -3, 2.0, 2.0)]).withColumn("step", F.lit(5))
    got = rows(to_regular_grid(t, ["video", "particle"], "frame", ["x", "y"], "step").orderBy("particle", "slot"))
    assert got[0] == (1, 1, 0, (0 * 3 + 3 * 2) / 5, (1 * 3 + 4 * 2) / 5, 2, False, 1.0)
    assert got[1][:3] == (1, 1, 1) and got[1][5:7] == (0, True) and got[1][7] == pytest.approx(0.6)
    assert got[2][2] == 2 and got[2][3] == pytest.approx(8.0 * 1 / 4 + 3.0 * 3 / 4) and got[2][5] == 1
    assert got[3] == (1, 3, -1, 2.0, 2.0, 1, False, 0.2)
    assert len(got) == 4
    none = rows(to_regular_grid(t, ["video", "particle"], "frame", ["x"], "step", "none").where("filled"))
    assert none == [(1, 1, 1, None, 0, True, pytest.approx(0.6))]
    line = to_regular_grid(t, ["video", "particle"], "frame", ["x"], "step", "linear").where("particle = 1 and slot = 1").first()
    assert line.x == pytest.approx(3 + 5 * (7.5 - 3) / 10)


@pytest.mark.parametrize("block", [4, 4096])
def test_grid_empty_slots_brute(spark, rows, block):
    rng = random.Random(3)
    data = [(v, p, f, 1.0, 2.0) for v in (1, 2) for p in range(4) for f in sorted(rng.sample(range(-40, 90), rng.randint(1, 15)))]
    t = traj(spark, data).withColumn("step", F.when(F.col("video") == 1, 3).otherwise(None))
    got = rows(to_regular_grid(t, ["video", "particle"], "frame", ["x", "y"], "step", "none", block).where("filled"), "video", "particle", "slot")
    want = []
    for v in (1, 2):
        for p in range(4):
            s = {f // (3 if v == 1 else 1) for a, b, f, *_ in data if (a, b) == (v, p)}
            want += [(v, p, k) for k in range(min(s), max(s)) if k not in s]
    assert got == sorted(want)


def test_grid_empty_and_bad(spark):
    t = traj(spark, []).withColumn("step", F.lit(1))
    assert to_regular_grid(t, ["video", "particle"], "frame", ["x"], "step").count() == 0
    with pytest.raises(ValueError):
        to_regular_grid(t, ["video"], "frame", ["x"], "step", "spline")
    with pytest.raises(ValueError):
        to_regular_grid(t, ["nothing"], "frame", ["x"], "step")


# --- rolling totals


@given(st.lists(st.floats(-1e3, 1e3), max_size=60), st.integers(1, 12), st.sampled_from(sorted(MONOIDS)))
@settings(max_examples=60, deadline=None)
def test_two_stack(values, window, monoid):
    op, zero = MONOIDS[monoid]
    got = two_stack(np.array(values, dtype=float), window, monoid)
    for i in range(len(values)):
        want = op.reduce(np.array(values[max(0, i - window + 1) : i + 1]))
        assert got[i] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("block", [5, 8192])
def test_rolling_brute(spark, block):
    rng = random.Random(1)
    data = []
    for p in (1, 2, None):
        for f in rng.sample(range(-7, 40), 14):
            data.append((1, p, f, rng.choice([NAN, None, rng.random()]), rng.random()))
    data += data[:5] + [(1, 1, 200, 1.0, 1.0), (1, 2, 60, 5.0, 5.0), (1, 2, 60, 6.0, 6.0)]
    got = {(r.particle, r.frame): r for r in rolling(traj(spark, data), ["video", "particle"], "frame", ["x", "y"], [3, 5], ["max", "min"], block).collect()}
    clean = {(v, p, f, None if x is None or x != x else x, y) for v, p, f, x, y in data if p is not None}
    n = 0
    for p in (1, 2):
        frames = [f for _, q, f, *_ in clean if q == p]
        for f in range(min(frames), max(frames) + 1):
            n += 1
            for w in (3, 5):
                xs = [x for _, q, g, x, _ in clean if q == p and f - w < g <= f and x is not None]
                r = got[p, f]
                assert r[f"n_x_{w}"] == len(xs)
                if xs:
                    assert r[f"sum_x_{w}"] == pytest.approx(sum(xs)) and r[f"avg_x_{w}"] == pytest.approx(sum(xs) / len(xs))
                    assert r[f"max_x_{w}"] == max(xs) and r[f"min_x_{w}"] == min(xs)
                else:
                    assert r[f"sum_x_{w}"] is None and r[f"avg_x_{w}"] is None and r[f"max_x_{w}"] is None
    assert len(got) == n


def test_rolling_sparse_chunks():
    """Dense arrays are bounded by time steps: sources of one reading in a whole block don't pile up."""
    n = 2000
    kind, at = np.tile([0, 1], n), np.tile([0, 8191], n)
    until = [8191 if k == 0 else None for k in kind]
    t = pa.table({"kind": pa.array(kind), "t": pa.array(at), "until": pa.array(until, pa.int64())})
    got = list(_segments(iter(t.to_batches(max_chunksize=700)), 29))
    assert pa.concat_tables(got).equals(t.combine_chunks()) or pa.concat_tables(got).to_pylist() == t.to_pylist()
    assert all(p["kind"][0].as_py() == 0 for p in got)
    cells = [sum(p["kind"].to_numpy() == 0) * 8221 for p in got]
    assert max(cells) <= CELLS + 8221 and len(cells) >= n * 8221 // CELLS


def test_rolling_one_reading_in_a_block(spark):
    data = [(1, p, 8192 * k + p, 1.0, 2.0) for p in range(3) for k in range(3)]
    out = rolling(traj(spark, data), ["video", "particle"], "frame", ["x"], [7])
    assert out.count() == 3 * (2 * 8192 + 1)
    assert out.where("n_x_7 = 1").count() == 3 * (2 * 7 + 1)


def test_rolling_empty(spark):
    assert rolling(traj(spark, []), ["video", "particle"], "frame", ["x"], [7]).count() == 0
    with pytest.raises(ValueError):
        rolling(traj(spark, []), ["video"], "frame", ["x"], [0])


# --- neighbours


def brute_pairs(pts, r):
    pts = sorted(set(pts))
    out = set()
    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            if a[0] == b[0] and a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= r * r:
                out.add((min(a[1], b[1]), max(a[1], b[1])))
    return sorted(out)


@pytest.mark.parametrize("cell", [None, 3.0, 7.5])
def test_near_brute(spark, rows, cell):
    rng = random.Random(5)
    pts = [(rng.randint(0, 1), i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(150)]
    pts += [(0, 1000 + i, 3.0 * i, 0.0) for i in range(5)] + [(0, 2000, 0.0, 0.0), (0, 2000, 0.0, 0.0)]
    extra = [(0, 3000, NAN, 0.0), (0, 3001, None, 0.0), (None, 3002, 0.0, 0.0), (0, None, 0.0, 0.0)]
    df = spark.createDataFrame([(*p, 1, 2.0) for p in pts + extra], "g bigint, id bigint, x double, y double, cx bigint, px double")
    got = sorted(set(rows(near_pairs(df, ["g"], "id", "x", "y", 3.0, cell), "id_a", "id_b")))
    assert got == brute_pairs(pts, 3.0)
    assert near_pairs(df.limit(0), ["g"], "id", "x", "y", 3.0).count() == 0


def test_near_geo_brute(spark, rows):
    rng = random.Random(7)
    pts = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(120)]
    pts += [(500, 89.99, 10.0), (501, 89.99, -170.0), (502, 0.0, 179.99), (503, 0.0, -179.99), (504, None, 1.0), (505, 95.0, 0.0)]
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    ok = [p for p in pts if p[1] is not None and abs(p[1]) <= 90]
    for limit in (3.0, 900.0):
        want = sorted((a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :] if km(a, b) <= limit)
        assert rows(near_pairs_geo(df, [], "id", "lat", "lon", limit), "id_a", "id_b") == want


def test_regions(spark, rows):
    shapes = {"square": [(0, 0), (4, 0), (4, 4), (0, 4)], "next": [(4, 0), (8, 0), (8, 4), (4, 4)], "arrow": [(0, 0), (10, 5), (0, 10), (3, 5)], "line": [(0, 0), (1, 1)]}
    reg = spark.createDataFrame([(1, n, [{"x": float(x), "y": float(y)} for x, y in s]) for n, s in shapes.items()] + [(1, "none", None)], "g bigint, name string, ring array<struct<x:double,y:double>>")
    pts = [(1, 1, 2.0, 2.0), (1, 2, 4.0, 2.0), (1, 3, 9.0, 5.0), (1, 4, 1.0, 5.0), (1, 5, NAN, 1.0), (2, 6, 2.0, 2.0), (1, 1, 2.0, 2.0)]
    df = spark.createDataFrame(pts, "g bigint, id bigint, x double, y double")
    got = rows(points_in_regions(df, reg, ["g"], "id", "x", "y", "name", "ring", 3.0), "id", "region")
    assert got == [(1, "arrow"), (1, "square"), (2, "next"), (3, "arrow")]
    assert in_ring is not None


# --- spikes


def walk(n, seed, step=0.5):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(0, step, (n, 2)), axis=0) + 100


def planted():
    a, b, c, d = walk(80, 1), walk(80, 2), walk(80, 3), walk(60, 4)
    bad = set()
    a[20] += (40, -30)
    a[50:52] += (0, 60)
    bad |= {(1, 20), (1, 50), (1, 51)}
    b[30:37] = b[30]
    b[60:66, 0] = b[60, 0]
    bad |= {(2, f) for f in [*range(31, 37), *range(61, 66)]}
    c[40:] += (50, 50)  # it stays there
    d[10] = (-5, 20)
    bad.add((4, 10))
    e = walk(70, 5)  # stuck with jitter, in both coordinates and in one
    jitter = np.random.default_rng(9).normal(0, 3e-4, (8, 2))
    e[20:28] = e[20] + jitter
    e[45:51, 1] = e[45, 1] + jitter[:6, 1]
    bad |= {(7, f) for f in [*range(21, 28), *range(46, 51)]}
    data = [(1, p, f, float(x), float(y)) for p, t in ((1, a), (2, b), (3, c), (4, d), (7, e)) for f, (x, y) in enumerate(t)]
    return data, bad


def test_spikes(spark, rows):
    data, bad = planted()
    extra = [(1, 5, 0, 1.0, 1.0), (1, 6, 0, 1.0, 1.0), (1, 6, 1, 1.0, 1.0), (1, 6, 2, 1.0, 1.0), (1, None, 3, 1.0, 1.0), (1, 1, 80, NAN, 1.0), (1, 1, 81, None, 1.0)] + data[:9]
    t = traj(spark, data + extra)
    out = flag_readings(t, ["video", "particle"], "frame", ["x", "y"], F.col("x") < 0)
    assert out.count() == len(data) + 4
    got = rows(out.where("spike or stuck or outside"), "particle", "frame")
    assert set(got) == bad
    s = out.agg(F.min("score"), F.max("score")).first()
    assert 0 < s[0] <= s[1] < 1
    assert flag_readings(traj(spark, []), ["video", "particle"], "frame", ["x", "y"]).count() == 0


def test_spikes_same_for_any_partitioning(spark, rows):
    data, _ = planted()
    t = traj(spark, data)
    one = rows(flag_readings(t.repartition(1), ["video", "particle"], "frame", ["x", "y"]))
    two = rows(flag_readings(t.repartition(7), ["video", "particle"], "frame", ["x", "y"]))
    assert one == two


def test_spikes_same_for_any_block(spark, rows):
    data, bad = planted()
    far = [(1, 9, 1000 * k + f, float(x), float(y)) for k, w in enumerate((walk(40, 11), walk(40, 12))) for f, (x, y) in enumerate(w)]
    far[55] = (*far[55][:3], far[55][3] + 60, far[55][4])
    bad = bad | {(9, 1015)}
    t = traj(spark, data + far + far[:3])
    rule = F.col("x") < 0
    one = rows(flag_readings(t, ["video", "particle"], "frame", ["x", "y"], rule))
    assert {r[1:3] for r in one if any(r[4:])} == bad
    for block in (7, 32, 300):
        assert rows(flag_readings(t, ["video", "particle"], "frame", ["x", "y"], rule, block=block)) == one


def test_score_decides(spark):
    """Excursions between the lax limit and what the source's own movement makes unusual are left to the forest."""
    w = walk(300, 21)
    w[150] += (3.5, 0)
    w[220] += (14, 0)
    data = [(1, 1, f, float(x), float(y)) for f, (x, y) in enumerate(w)]
    got = {r.frame: r for r in flag_readings(traj(spark, data), ["video", "particle"], "frame", ["x", "y"], far=3.0).collect()}
    assert got[220].spike and not got[150].spike and got[150].score < 0.7 <= got[220].score


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(0, 0.05, size=(3, 1000)))
    x[:, 7] = 0.9
    x[:, 700] = 0.8
    seg = np.repeat([0, 1], 500)
    score = forest_scores(x, seg, np.ones(1000, dtype=bool))
    assert score[:500].argmax() == 7 and score[500:].argmax() == 200
    assert score.mean() < 0.55 < 0.75 < min(score[7], score[700])
    # what isn't fitted can't hide others like it
    x[:, 10:60] = 0.9
    fit = np.ones(1000, dtype=bool)
    fit[10:60] = False
    assert forest_scores(x, seg, fit)[10:60].min() > 0.75 > forest_scores(x, seg, np.ones(1000, dtype=bool))[10:60].max()
    assert len(forest_scores(x[:, :0], seg[:0], fit[:0])) == 0


@given(st.lists(st.integers(-40, 40), min_size=1, max_size=40), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_usual_step_adds_up(bins, parts):
    b = np.array(bins)
    whole = usual_step(np.zeros(len(b), dtype=int), b, np.ones(len(b), dtype=int), 1)
    cut = np.concatenate([np.stack(np.unique(p, return_counts=True)) for p in np.array_split(b, parts) if len(p)], axis=1)
    assert usual_step(np.zeros(cut.shape[1], dtype=int), cut[0], cut[1], 1) == whole
