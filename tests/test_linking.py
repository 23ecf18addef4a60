import numpy as np
import pandas as pd
import pytest

from motespark.operators import linking as lk
from hypothesis import given, settings
from hypothesis import strategies as st
from motespark.operators.assignment import SubnetOversizeError, UnknownLinkingError, assign, cheapest, nearest, neighbours
from motespark.operators.predict import ChannelPredict, DriftPredict, NearestVelocityPredict, instrumented

P = "frame bigint, id bigint, x double, y double"


def table(spark, frames):
    pts = [(f, x, y) for f, ps in enumerate(frames) for x, y in ps]
    return spark.createDataFrame([(f, i, float(x), float(y)) for i, (f, x, y) in enumerate(pts)], P)


def labels(df):
    """Track labels by order of appearance."""
    pdf = df.toPandas().sort_values("id")
    return pd.factorize(pdf["particle"])[0].tolist()


def test_cheapest_assignment():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(30):
        n = int(rng.integers(1, 6))
        c = rng.random((n, n + int(rng.integers(0, 3))))
        got = cheapest(c)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(c.shape[1]), n))
        assert len(set(got)) == n and sum(c[np.arange(n), got]) == pytest.approx(best)


@pytest.mark.parametrize("how", ["joins", "fold"])
@pytest.mark.parametrize(
    ("frames", "reach", "want"),
    [
        ([[(0, 1)], [(1, 1)], [(2, 1)], [(3, 1)]], 5, [0, 0, 0, 0]),
        ([[(6, 0), (15, 8)], [(8, 0), (0, 8)]], 20, [0, 1, 1, 0]),
        ([[(6, 0), (13, 8)], [(8, 0), (0, 8)]], 20, [0, 1, 0, 1]),
        ([[(10, 30), (10, 0)], [(0, 20), (30, 21)]], 30, [0, 1, 1, 0]),
        ([[(10, 30), (10, 0)], [(0, 20), (30, 19)]], 30, [0, 1, 0, 1]),
        ([[(0, 0), (8, 0)], [(7, 8), (15, 8)]], 13, [0, 1, 0, 1]),
        ([[(0, 0), (8, 0)], [(7, 8), (15, 8)]], 12, [0, 1, 1, 2]),
        ([[(0, 0)], [], [(0, 0)]], 5, [0, 1]),
    ],
)
def test_rules(spark, how, frames, reach, want):
    t = table(spark, frames)
    out = lk.link(t, [], "id", reach) if how == "joins" else lk.link_stateful(t, [], reach)
    assert labels(out) == want


def test_joins_equal_fold(spark):
    rng = np.random.default_rng(2)
    pos = rng.uniform(0, 60, (40, 2))
    frames = []
    for _ in range(12):
        pos = pos + rng.normal(0, 1.0, pos.shape)
        frames.append(pos[rng.random(len(pos)) > 0.1])
    t = table(spark, frames)
    a, b = labels(lk.link(t, [], "id", 4.0)), labels(lk.link_stateful(t, [], 4.0))
    assert a == b
    drop = labels(lk.link(t, [], "id", 4.0, strategy="drop"))
    assert drop == labels(lk.link_stateful(t, [], 4.0, strategy="drop"))


def test_memory(spark):
    gap = [[(f, 1)] * (f != 3) + [(f, 3)] * (f > 0) for f in range(6)]
    t = table(spark, gap)
    assert lk.link_stateful(t, [], 5, memory=1).toPandas().particle.nunique() == 2
    removed = table(spark, [[(1, 1), (4, 1)], [(1, 1)], [(1, 1), (2, 1)], [(1, 1), (2, 1), (4, 1)]])
    assert lk.link_stateful(removed, [], 5, memory=2).toPandas().particle.nunique() == 3


def test_pathological(spark):
    t = table(spark, [[(f, 2 * k + f) for k in range(16)] for f in range(5)])
    assert lk.link(t, [], "id", 8).select("particle").distinct().count() == 16


def test_adaptive():
    side = np.arange(21) * 2.0 - 20
    a = np.stack(np.meshgrid(side, side), axis=-1).reshape(-1, 2)
    b = a * 0.9
    with pytest.raises(SubnetOversizeError):
        assign(a, b, 2.0)
    got = assign(a, b, 2.0, adaptive_stop=0.64, adaptive_step=0.8)
    assert (got >= 0).sum() > 300
    links = got[got >= 0]
    assert len(set(links.tolist())) == len(links)


def test_adaptive_ends():
    with pytest.raises(SubnetOversizeError):
        assign(np.array([[0.0], [1.0]]), np.array([[0.1], [1.1]]), 8.0, adaptive_stop=4.0, adaptive_step=0.5, max_size=1)
    assert assign(np.array([[0.0], [1.0]]), np.array([[0.1], [1.1]]), 8.0, adaptive_stop=0.1, adaptive_step=0.25, max_size=1).tolist() == [0, 1]


@pytest.mark.parametrize("make", [lambda: DriftPredict(guess=np.array([20.0, 20.0])), lambda: NearestVelocityPredict(guess=np.array([20.0, 20.0])), lambda: instrumented(DriftPredict)(guess=np.array([20.0, 20.0]))])
def test_predictors(make):
    grid = np.stack(np.meshgrid(np.arange(5) * 30.0, np.arange(5) * 30.0), axis=-1).reshape(-1, 2)
    p = make()
    linker = lk.Linker(10.0, predictor=p)
    ids = [linker.step(t, grid + 20.0 * t) for t in range(3)]
    assert (ids[0] == ids[1]).all() and (ids[0] == ids[2]).all()
    if hasattr(p, "dump"):
        assert len(p.dump()) == 50


def test_channel():
    y = np.arange(0, 100, 5.0)
    v = np.where(y < 50, 8.0, -8.0)
    pos = np.stack([y, np.zeros_like(y)], axis=1)
    linker = lk.Linker(9.0, predictor=ChannelPredict(10.0, minsamples=1))
    a = linker.step(0, pos)
    b = linker.step(1, pos + np.stack([0 * y, v], axis=1))
    c = linker.step(2, pos + np.stack([0 * y, 2 * v], axis=1))
    assert (a == b).all() and (b == c).all()


def test_metric_and_map():
    far = lambda a, b: abs(a - b).max()
    linker = lk.Linker(1.5, dist_func=far)
    assert linker.step(0, [[0.0, 0.0], [9.0, 9.0]]).tolist() == [0, 1] and linker.step(1, [[1.4, 1.4]]).tolist() == [0]
    polar = lk.Linker(1.0, to_eucl=lambda p: np.stack([p[:, 0] * np.cos(p[:, 1]), p[:, 0] * np.sin(p[:, 1])], axis=1))
    polar.step(0, [[5.0, 3.1]])
    assert polar.step(1, [[5.0, -3.1]]).tolist() == [0]
    aniso = lk.Linker((1.0, 10.0))
    aniso.step(0, [[0.0, 0.0]])
    assert aniso.step(1, [[0.0, 8.0]]).tolist() == [0] and aniso.step(2, [[2.0, 8.0]]).tolist() == [1]


def test_partial(spark):
    t = table(spark, [[(0, 0)], [(1, 0)], [(2, 0)], [(3, 0)]]).toPandas().assign(particle=[3, 5, 6, 3])
    out = lk.link_partial(spark.createDataFrame(t), [], "id", 5, (1, 3)).toPandas().sort_values("id").particle.tolist()
    assert out[0] == 3 and out[1] == out[2]
    whole = lk.link_partial(spark.createDataFrame(t), [], "id", 5, (0, 4)).toPandas()
    assert whole.particle.nunique() == 1
    with pytest.raises(ValueError):
        lk.link_partial(spark.createDataFrame(t), [], "id", 5, (3, 3))


def test_partial_names(spark):
    """Old names come in at the patch's first frame and go on after its last; what is cut off gets names of its own."""
    rows = [(0, 1, 0.0, 3), (0, 2, 20.0, 4), (1, 3, 1.0, 3), (1, 4, 21.0, 9), (2, 5, 2.0, 8), (2, 6, 22.0, 4), (3, 7, 3.0, 7), (3, 8, 23.0, 9), (3, 9, 60.0, 3)]
    for groups in ([], ["g"]):
        df = spark.createDataFrame([(f, i, x, 0.0, p, 1) for f, i, x, p in rows], "frame bigint, id bigint, x double, y double, particle bigint, g bigint")
        got = {r.id: r.particle for r in lk.link_partial(df, groups, "id", 5, (1, 3)).collect()}
        assert got[1] == got[3] == got[5] == 3 and got[2] == 4 and got[4] == got[6] == 9
        assert got[7] == 7 and got[8] == -10 and got[9] == -4  # 9 and 3 went to others in the patch; 8 and 4 didn't go on


@pytest.mark.parametrize("tile", [64.0, 0.7])
@pytest.mark.parametrize("kw", [{}, {"memory": 2}, {"adaptive_stop": 0.3, "adaptive_step": 0.8, "max_size": 2}, {"strategy": "drop"}, {"neighbors": None}, {"memory": 1, "adaptive_stop": 0.3, "max_size": 2}])
def test_zones_equal_fold(spark, monkeypatch, tile, kw):
    """However a movie is cut into zones, and with memory into sets of near points, tracks equal those of the fold."""
    monkeypatch.setattr(lk, "TILE", tile)
    monkeypatch.setattr(lk, "SPELL", 64 if tile > 1 else 2)
    rng = np.random.default_rng(7)
    pos, frames = rng.uniform(0, 70, (50, 2)), []
    for _ in range(10):
        pos = pos + rng.normal(0, 1.2, pos.shape)
        frames.append(pos[rng.random(len(pos)) > 0.15])
    t = table(spark, frames)
    fold = {"most" if k == "neighbors" else k: v for k, v in kw.items()}
    want = lk.link_stateful(t, [], 4.0, ident="id", **{"max_size": 30, **fold}).orderBy("id").toPandas()
    got = lk.link(t, [], "id", 4.0, **kw).orderBy("id").toPandas()
    assert got.particle.tolist() == want.particle.tolist()
    assert got.particle.nunique() < len(got) * 0.6


def test_strategies():
    src, dst = np.array([[0.0], [1.0]]), np.array([[0.4], [1.4]])
    assert assign(src, dst, 2.0).tolist() == [0, 1]
    cross = lambda n, m, s, t, d, reach: [1, 0]
    assert assign(src, dst, 2.0, strategy=cross).tolist() == [1, 0]
    with pytest.raises(UnknownLinkingError):
        assign(src, dst, 2.0, strategy="guess")
    crowd = np.arange(12.0)[:, None] / 10
    assert len(neighbours(crowd, crowd, 5.0, 3)[0]) == 36 and len(neighbours(crowd, crowd, 5.0, None)[0]) == 144


@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 3), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_nearest_and_metric(n, m, ndim, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 5, (n, ndim)), rng.normal(0, 2, (m, ndim))
    b[: m // 3, 0] = 1.0
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert (d[np.arange(n), nearest(a, b)] == d.min(axis=1)).all()
    city = lambda p, q: np.abs(p - q).sum()
    s, t, v = neighbours(a, b, 3.0, None, city)
    assert set(zip(s.tolist(), t.tolist())) == {(i, j) for i in range(n) for j in range(m) if city(a[i], b[j]) <= 3.0}


@pytest.mark.parametrize("make", [DriftPredict, NearestVelocityPredict])
def test_predictors_remember_when_a_particle_was_seen(make):
    grid = np.array([[0.0, 0.0], [0.0, 50.0], [0.0, 100.0]])
    linker = lk.Linker(6.0, memory=3, predictor=make(guess=np.array([10.0, 0.0])))
    ids = [linker.step(t, (grid + (10.0 * t, 0.0))[: 2 if t in (2, 3) else 3]) for t in range(6)]
    assert ids[5].tolist() == ids[0].tolist() == ids[4].tolist()

def test_missing_and_empty(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 2, None, 0.0), (None, 3, 0.0, 0.0)], P)
    for out in (lk.link(df, [], "id", 5), lk.link_stateful(df, [], 5)):
        got = {r.id: r.particle for r in out.collect()}
        assert got[1] is not None and got[2] is None and got[3] is None
    assert lk.link(df.limit(0), [], "id", 5).count() == 0
    num = lk.renumber(lk.link(table(spark, [[(0, 0), (50, 50)], [(0, 0)]]), [], "id", 5), [])
    assert sorted(r.particle for r in num.collect()) == [0, 0, 1]
