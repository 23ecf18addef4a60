import numpy as np
import pytest
from pyspark.sql import functions as F

from motespark.operators import filtering as fl
from motespark.operators import motion as m

S = "frame bigint, particle bigint, x double, y double"
NAN = float("nan")


def test_still(spark, rows):
    t = spark.createDataFrame([(f, 0, 0.0, 0.0) for f in range(10)] + [(f, 1, 0.0, 1.0) for f in range(1, 10)], S)
    for smoothing in (0, 2):
        assert rows(m.compute_drift(t, smoothing), "frame", "x", "y") == [(f, 0.0, 0.0) for f in range(1, 10)]
    assert rows(m.emsd(t, 1, 1), "lag", "msd") == [(f, 0.0) for f in range(1, 10)]


def test_steppers(spark, rows):
    t = spark.createDataFrame([(f, 0, float(f), 0.0) for f in range(10)] + [(f, 1, float(f), 1.0) for f in range(1, 10)], S)
    d = m.compute_drift(t)
    assert rows(d, "frame", "x", "y") == [(f, float(f), 0.0) for f in range(1, 10)]
    assert rows(m.subtract_drift(t, d), "x") == [(0.0,)] * 19
    assert rows(m.diagonal_size(t), "particle", "diagonal_size") == [(0, 9.0), (1, 8.0)]


def test_gaps(spark, rows):
    a = list(zip(range(1, 7), [0] * 6, [4.0, 5.0, 4.0, 5.0, 3.0, 2.0], [6.0, 7.0, 8.0, 6.0, 7.0, 6.0]))
    b = list(zip([1, 2, 6], [1] * 3, [-3.0, -1.0, -2.0], [10.0, 11.0, 10.0]))
    t = spark.createDataFrame(a + b, S)
    got = rows(m.emsd(t, 1, 1), "lag", "msd")
    assert [g[1] for g in got] == pytest.approx([4.012847555129437, 4.0, 4.333333333333333, 4.193672099712366, 2.645254074784259])
    nulls = rows(m.imsd(t, 1, 1).where("msd is null"), "particle", "lag")
    assert nulls == [(1, 2), (1, 3)]
    assert m.emsd(t, 1, 1, detail=True, compat=True).count() == 5
    wide = m.imsd(t, 1, 1, wide=True)
    assert set(wide.columns) == {"lagt", "0", "1"}


def test_msd_units_and_missing(spark):
    t = spark.createDataFrame([(f, 0, float(f), 0.0) for f in range(5)] + [(5, 0, NAN, 1.0), (6, 0, None, 1.0)], S)
    r = m.msd(t, 0.5, 10, 2).where("lag = 2").first()
    assert r.msd == pytest.approx(1.0) and r.lagt == pytest.approx(0.2) and r["<x>"] == pytest.approx(1.0)
    assert m.msd(t.limit(0), 1, 1).count() == 0


def sparse_track():
    """Movie 1: a walker and a track whose two frames lie beyond every lag. Movie 2: only such a track. Movie 3: even frames only. Movie 4: a walker."""
    walk = lambda v, step=1: [(v, 1, f, float(f * f % 13), float(3 * f % 7)) for f in range(0, 40, step)]
    gap = lambda v: [(v, 2, 5, 1.0, 2.0), (v, 2, 60, 3.0, 4.0)]
    return walk(1) + gap(1) + gap(2) + walk(3, 2) + walk(4)


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame(sparse_track(), "video_id bigint, particle bigint, frame bigint, x double, y double")


@pytest.fixture
def sparse_same(spark, sparse, tmp_path):
    """Compares a query with its SQL on the sparse tracks, NULL and NaN kept apart."""
    import duckdb

    import __spark_entry__ as entry

    def check(name):
        sparse.write.parquet(str(tmp_path / "traj.parquet"))
        got = entry.queries()[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql(f"create view traj as select * from '{tmp_path}/traj.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        ids = [c for c in ("video_id", "particle", "lag") if c in want.columns]
        assert sorted(got.columns) == sorted(want.columns)
        cols = ids + sorted(set(want.columns) - set(ids))
        key = lambda r: r[: len(ids)]
        a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
        b = sorted(want.project(", ".join(cols)).fetchall(), key=key)
        kind = lambda t: [tuple(None if v is None else v if v == v else "nan" for v in r) for r in t]
        for x, y in zip(kind(a), kind(b), strict=True):
            assert x == pytest.approx(y, abs=2e-6), (x, y)

    return check


def test_emsd_leaves_out_tracks_without_pairs(sparse, rows):
    got = rows(m.emsd(sparse, 1, 1, 20, groups=["video_id"]), "video_id", "lag", "msd")
    by = {v: {lag: msd for g, lag, msd in got if g == v} for v in (1, 2, 3, 4)}
    assert by[1] == by[4] and None not in by[1].values()
    assert set(by[2].values()) == {None} and len(by[2]) == 20
    assert all((msd is None) == (lag % 2 == 1) for lag, msd in by[3].items()) and len(by[3]) == 20


def test_emsd_of_sparse_tracks_as_sql(sparse_same):
    sparse_same("emsd")


def test_emsd_detail_of_sparse_tracks_as_sql(sparse_same):
    sparse_same("emsd_detail")


@pytest.mark.parametrize("compat", [False, True])
def test_emsd_detail_leaves_out_tracks_without_pairs(sparse, rows, compat):
    got = rows(m.emsd(sparse, 1, 1, 20, detail=True, groups=["video_id"], compat=compat), "video_id", "lag", "`<x>`", "`<y^2>`", "msd", "N")
    by = {v: {r[1]: r[2:] for r in got if r[0] == v} for v in (1, 2, 3, 4)}
    assert by[1] == by[4] and None not in by[1][20]
    assert set(by[2].values()) == {(None, None, None, 0.0)} and len(by[2]) == 20
    assert all((r == (None, None, None, 0.0)) == (lag % 2 == 1) for lag, r in by[3].items()) and len(by[3]) == 20


def test_emsd_powerlaw_of_sparse_tracks_as_sql(sparse_same):
    sparse_same("emsd_powerlaw")


def test_msd_of_sparse_tracks_as_sql(sparse_same):
    sparse_same("msd_detail")


def test_msd_of_tracks_without_pairs(sparse, rows):
    d = m.msd(sparse, 1, 1, 20, ["video_id", "particle"]).where("particle = 2")
    assert rows(d, "video_id", "lag", "msd", "N") == [(v, lag, None, None) for v in (1, 2) for lag in range(1, 21)]
    assert rows(m.imsd(sparse, 1, 1, 20, "N", ["video_id", "particle"]).where("particle = 2"), "N") == [(None,)] * 40


def test_many_walks(spark):
    rng = np.random.RandomState(0)
    data = [(f, p, float(x), float(y)) for p in range(50) for f, (x, y) in enumerate(np.cumsum(rng.randn(10, 2), axis=0))]
    got = {r.lag: r.msd for r in m.emsd(spark.createDataFrame(data, S), 1, 1).collect()}
    for lag in (1, 2, 3):
        assert got[lag] == pytest.approx(2 * lag, rel=0.25)


def test_pair_counts(spark):
    t = spark.createDataFrame([(f, p, float(p), float(f * p)) for p in range(9) for f in (2, 6)], S).withColumn("movie", F.lit(1))
    for f in (m.direction_corr, m.velocity_corr):
        assert f(t, 2, 6, groups=["movie"]).count() == 9 * 8 // 2
    with pytest.raises(ValueError):
        m.direction_corr(t, 2, 6)


def test_filters(spark, rows):
    t = spark.createDataFrame([(f, p, float(f), 0.0) for p, n in ((1, 3), (2, 5)) for f in range(n)] + [(9, None, 0.0, 0.0)], S)
    assert rows(fl.filter_stubs(t, 4).select("particle").distinct()) == [(2,)]
    assert fl.filter_tracks(t, F.max("x") > 3).count() == 5
    assert fl.filter_tracks(t.dropna(), lambda p: len(p) < 4).count() == 3
    s = t.withColumn("size", F.col("particle").cast("double")).withColumn("mass", F.col("frame").cast("double"))
    assert rows(fl.filter_clusters(s, threshold=2.0).select("particle").distinct()) == [(1,)]
    assert fl.mass_size_filter(s, 2.0, 2.0).count() == 0 and fl.mass_size_filter(s, 2.0, inclusive=True).count() == 5
    fl.verify_integrity(t)
    with pytest.raises(ValueError):
        fl.verify_integrity(t.union(t))
    with pytest.raises(ValueError):
        fl.filter_stubs(t.drop("frame"))
    with pytest.raises(NotImplementedError):
        m.is_localized(None)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_lag_sums_brute(spark, block):
    """Sums of pairs for tracks with gaps, however they are cut into blocks."""
    rng = np.random.default_rng(4)
    data = [(p, int(f), float(rng.normal()), float(rng.normal())) for p in range(4) for f in sorted(rng.choice(60, 18, replace=False) - 20)]
    data += [(9, 5, 1.0, 1.0), (10, 0, 0.0, 0.0), (10, 500, 3.0, 4.0)]
    df = spark.createDataFrame([*data, (None, 1, 1.0, 1.0)], "particle bigint, frame bigint, x double, y double")
    got = {(r.particle, r.lag): r for r in m.lag_sums(df, ["particle"], ["x", "y"], 8, block).collect()}
    for p in (0, 1, 2, 3, 9, 10):
        own = {f: (x, y) for q, f, x, y in data if q == p}
        span = max(own) - min(own) + 1
        for lag in range(1, 9):
            if lag > span - 1:
                assert (p, lag) not in got
                continue
            d = [(own[f + lag][0] - x, own[f + lag][1] - y) for f, (x, y) in own.items() if f + lag in own]
            r = got[p, lag]
            assert (r.n, r._span, r._n) == (len(d), span, len(own))
            assert (r.s0, r.q1) == pytest.approx((sum(a for a, _ in d), sum(b * b for _, b in d)))
    assert {p for p, _ in got} == {0, 1, 2, 3, 10}
