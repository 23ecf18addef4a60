import itertools
import warnings

import numpy as np
import pandas as pd
import pytest

from motespark.functions import imageproc as ip
from motespark.functions import masks, synth
from motespark.operators import locate as lo
from motespark.operators.brightfield import brightfield_batch, locate_brightfield_ring
from motespark.operators.find_link import FindLinker, find_link, find_link_iter
from motespark.operators.predict import DriftPredict
from motespark.operators.refine_lsq import dimer, refine_batch, refine_leastsq, tetramer, train_leastsq, trimer


def nearest(a, b):
    return np.sqrt(((np.asarray(a)[:, None] - np.asarray(b)[None]) ** 2).sum(axis=2)).min(axis=1)


def packed(spark, images):
    rows = [(i, *lo.pack_frame(im)) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, "frame bigint, shape array<int>, dtype string, data binary")


def test_filters():
    im = np.arange(25, dtype=np.uint8).reshape(5, 5)
    assert (ip.boxcar(im, 1) == im).all()
    step = ip.boxcar(np.array([[0, 0, 9, 0, 0]], dtype=np.uint8), (1, 3))
    assert step.tolist() == [[0, 3, 3, 3, 0]]
    with pytest.raises(ValueError):
        ip.boxcar(im, 2)
    with pytest.raises(ValueError):
        ip.bandpass(im, 5, 3)
    point = np.zeros((21, 21))
    point[10, 10] = 1
    assert ip.lowpass(point, 1).sum() == pytest.approx(1, abs=1e-3)
    assert (ip.invert_image(im) == 255 - im).all() and (ip.invert_image(point) == 1 - point).all()
    f, q = ip.convert_to_int(point * 0.5)
    assert f == 510 and q.max() == 255 and ip.convert_to_int(im)[0] == 1
    old = ip.legacy_bandpass(point * 255, 1, 5)
    assert old[10, 10] == old.max() > 0
    assert ip.dilate(np.array([[0, 1, 0, 0, 0]]), (1, 4)).tolist() == [[1, 1, 1, 0, 0]]
    assert np.isnan(ip.percentile_threshold(np.zeros((3, 3)), 64))


def test_masks():
    assert masks.n_binary_mask(1, 2) == 5 and masks.n_binary_mask((1, 2), 2) == 7
    assert masks.r_squared_mask(2, 2).max() == 4 and masks.gaussian_kernel(1).sum() == pytest.approx(1)
    im = np.ones((9, 9))
    assert masks.mask_image([(4, 4)], im, 2).sum() == 13 and masks.mask_image([(4, 4)], im, 2, invert=True).sum() >= 68
    assert masks.slice_image(np.array([(0, 0)]), im, 2)[0].shape == (3, 3)


def test_black_and_margins():
    with pytest.warns(UserWarning):
        assert len(ip.grey_dilation(np.zeros((20, 20), dtype=np.uint8), 5)) == 0
    edge = np.zeros((20, 20), dtype=np.uint8)
    edge[1, 1] = 200
    edge[5, 5] = 1
    with pytest.warns(UserWarning):
        assert len(ip.grey_dilation(edge, 9, percentile=90)) == 0


@pytest.mark.parametrize("ndim", [2, 3])
def test_locate(ndim):
    pos, im = synth.draw_array(8, 3, ndim=ndim, noise_level=3)
    least = 100 if ndim == 2 else 1000
    f = lo.locate(im, 11, minmass=least)
    assert len(f) == 8
    assert nearest(pos, f[["z", "y", "x"][-ndim:]].to_numpy()).max() < 0.1
    top = lo.locate(im, 11, minmass=least, topn=3)
    assert len(top) == 3 and top.mass.is_monotonic_increasing and top.mass.min() >= f.mass.nsmallest(6).max() - 1e-9
    with pytest.raises(ValueError):
        lo.locate(im, 10)


def test_locate_float_inverted_anisotropic():
    pos, im = synth.draw_array(6, (2, 4))
    f = lo.locate(im, (9, 15), minmass=100)
    assert len(f) == 6 and {"size_y", "size_x", "ep_y", "ep_x"} <= set(f) and nearest(pos, f[["y", "x"]].to_numpy()).max() < 0.2
    g = lo.locate(im / 255, (9, 15), minmass=0.5)
    assert len(g) == 6
    h = lo.locate(255 - im, (9, 15), minmass=100, invert=True)
    assert len(h) == 6
    c = lo.characterize(f[["y", "x"]].to_numpy(), im, (4, 7))
    assert np.isfinite(c["mass"]).all() and np.isnan(lo.characterize(np.array([[0.0, 0.0]]), im, 4)["mass"]).all()


def test_batch(spark):
    pos, im = synth.draw_array(9, 3, noise_level=2)
    frames = packed(spark, [im, im, np.zeros_like(im)])
    f = lo.batch(frames, 13, minmass=100, after_locate=lambda t, d: d[d.mass > 0]).toPandas()
    assert f.groupby("frame").size().to_dict() == {0: 9, 1: 9}


def test_least_squares(spark):
    s = synth.SimulatedImage((64, 64), 4.0, signal=160, hard_radius=1.0, seed=3)
    truth = s.draw_dimer((32.3, 31.7), 0.5, 1.5)
    im = s.noisy_image(8)
    start = pd.DataFrame(np.round(truth) + 0.3, columns=["y", "x"]).assign(size=4.0, signal=150.0)
    got = refine_leastsq(start, im, 15, compute_error=True)
    assert nearest(truth, got[["y", "x"]].to_numpy()).max() < 0.1 and (got.cost < 0.1).all() and (got.y_std > 0).all()
    tied = refine_leastsq(start, im, 15, constraints=[dimer(12.0)])
    assert np.hypot(*(tied[["y", "x"]].iloc[0] - tied[["y", "x"]].iloc[1])) == pytest.approx(12, abs=1e-3)
    assert train_leastsq(start, im, 15, "gauss")["size"] == pytest.approx(4, abs=0.5)
    bad = refine_leastsq(start, im, 15, max_rms_dev=1e-9)
    assert bad.cost.isna().all() and (bad.y == start.y).all()
    out = refine_batch(spark.createDataFrame(start.assign(frame=0)), packed(spark, [im]), 15).toPandas()
    assert len(out) == 2 and (out["cost"] < 0.1).all()
    assert trimer(1.0)["cluster_size"] == 3 and np.abs(tetramer(2.0)["fun"](synth.cluster_shape(4, 2))).max() < 1e-12
    with pytest.raises(ValueError):
        refine_leastsq(start, im, 15, fit_function="hut")


@pytest.mark.parametrize("name", ["ring", "disc", "inv_series_2"])
def test_other_models(name):
    s = synth.SimulatedImage((48, 48), 6.0, signal=150, profile=name if name != "inv_series_2" else "gauss", **({"thickness": 0.3} if name == "ring" else {"disc_size": 0.5} if name == "disc" else {}))
    s.draw_feature((24.2, 23.6))
    start = pd.DataFrame({"y": [24.0], "x": [24.0], "size": [6.0], "signal": [140.0]})
    got = refine_leastsq(start, s(), 21, fit_function=name, param_val={"thickness": 0.3} if name == "ring" else None)
    assert nearest([(24.2, 23.6)], got[["y", "x"]].to_numpy()).max() < 0.3


def test_brightfield(spark):
    truth = [(60.2, 70.6), (140.1, 120.4)]
    im = synth.draw_features_brightfield((200, 200), truth, 15, noise_level=4)
    for f in (locate_brightfield_ring(im, 31, previous=pd.DataFrame({"y": [61.0, 139], "x": [69.0, 121], "particle": [7, 8]})), brightfield_batch(packed(spark, [im]), 31).toPandas()):
        assert len(f) == 2 and nearest(truth, f[["y", "x"]].to_numpy()).max() < 1.0 and f.r.between(12, 17).all()
    with pytest.warns(UserWarning):
        assert len(locate_brightfield_ring(im, 31, previous=pd.DataFrame({"y": [20.0], "x": [180.0], "particle": [3]}))) == 0


def test_find_link(spark):
    frames, shape = [], (60, 90)
    for t in range(4):
        frames.append(synth.draw_spots(shape, [(20, 20 + 2 * t), (40, 40 + 2 * t)], 3))
    dim = synth.draw_spots(shape, [(20, 20 + 2 * 4)], 3).astype(int)
    synth.draw_feature(dim, (40, 40 + 2 * 4), 3, 90)
    frames.append(np.clip(dim, 0, 255).astype(np.uint8))
    df = packed(spark, frames).selectExpr("1 as movie", "*")
    got = find_link(df, ["movie"], 5, 10, diameter=9).toPandas()
    assert got.groupby("particle").size().tolist() == [5, 5]
    assert FindLinker(5, 10).diameter % 2 == 1


def relinked(rows, shape, remove, reach=12, **kw):
    """Particles of two drawn frames where the search is made to miss some features of the second one."""
    truth = pd.DataFrame(rows, columns=["y", "x", "frame", "particle"])
    images = []
    for t in (0, 1):
        im = np.zeros(shape, dtype=np.uint8)
        for at in truth[truth.frame == t][["y", "x"]].to_numpy():
            synth.draw_feature(im, at, 3, 200)
        images.append((t, im))
    second = truth[truth.frame == 1][["y", "x"]].to_numpy()[list(remove)]

    def miss(t, f):
        gone = [np.hypot(f.y - y, f.x - x) < 2 for y, x in second] if t == 1 else []
        return f[~np.logical_or.reduce(gone)].reset_index(drop=True) if gone else f

    parts = [f.assign(frame=t) for t, f in find_link_iter(images, reach, 7, diameter=13, preprocess=False, refine=False, before_link=miss, **kw)]
    got = pd.concat(parts)
    where = [np.hypot(got[got.frame == r.frame].y - r.y, got[got.frame == r.frame].x - r.x) for r in truth.itertuples()]
    assert len(got) == len(truth) and all(w.min() < 2.5 for w in where)
    return pd.factorize(np.array([int(got[got.frame == r.frame].particle.iloc[w.to_numpy().argmin()]) for r, w in zip(truth.itertuples(), where)]))[0].tolist(), truth.particle.tolist()


@pytest.mark.parametrize(
    ("shape", "rows"),
    [
        ((24, 24), [(16, 8, 0, 0), (16, 16, 1, 0)]),
        ((16, 40), [(8, 8, 0, 0), (8, 16, 1, 0), (8, 24, 0, 1), (8, 32, 1, 1)]),
        ((16, 40), [(8, 8, 0, 0), (8, 16, 1, 0), (8, 32, 0, 1), (8, 24, 1, 1)]),
        ((24, 32), [(8, 8, 0, 0), (16, 8, 1, 0), (12, 16, 0, 1), (12, 24, 1, 1)]),
        ((24, 32), [(8, 8, 0, 0), (8, 16, 1, 0), (16, 16, 0, 1), (16, 24, 1, 1)]),
        ((24, 48), [(8, 8, 0, 0), (16, 12, 1, 0), (8, 16, 0, 1), (16, 20, 1, 1), (8, 32, 0, 2), (16, 28, 1, 2), (8, 40, 0, 3), (16, 36, 1, 3)]),
    ],
)
def test_find_link_overlaps(shape, rows):
    """Features of crowded neighbourhoods that the search missed are found and go to the right tracks."""
    second = [i for i, r in enumerate(r for r in rows if r[2] == 1)]
    for n in range(len(second) + 1):
        for remove in itertools.combinations(second, n):
            got, want = relinked(rows, shape, remove)
            assert got == want, remove


def test_find_link_many_lost():
    """Of four lost particles around one missed feature the nearest gets it."""
    cross = [(16, 8, 0, 0), (8, 16, 0, 1), (16, 24, 0, 2), (24, 16, 0, 3)]
    for k, (y, x) in enumerate([(16, 15), (15, 16), (16, 17), (17, 16)]):
        got, want = relinked([*cross, (y, x, 1, k)], (32, 32), [0])
        assert got == want
    one = [(t, synth.draw_spots((60, 90), [(20, 20 + 12 * t)], 3)) for t in range(4)]
    drift = list(find_link_iter(one, 5, 10, diameter=9, predictor=DriftPredict(guess=np.array([0.0, 12.0])), before_link=lambda t, f: f.iloc[:0] if t == 3 else f))
    assert [f.particle.tolist() for _, f in drift] == [[0]] * 4  # looked for where it is expected, not where it was


def test_simulated_image():
    s = synth.SimulatedImage((40, 40, 40), 3.0, signal=100, hard_radius=1.5)
    assert s.draw_cluster(4, (20, 20, 20)).shape == (4, 3) and len(s.f()) == 4
    s.clear()
    assert len(s.coords) == 0
    s.draw_feature_radial(2, (0, 90))
    assert s.coords[0] == pytest.approx([20, 20, 26])
    t = synth.SimulatedImage((80, 80), 3.0, hard_radius=2, signal=1.0, dtype=float)
    assert len(t.draw_features(5, separation=12)) <= 5 and t.noisy_image(0.1).max() <= 1
    t.draw_clusters(1, 3, margin=20)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert t.denoised(0.05, 1, 9).shape == (80, 80)
    assert np.allclose(synth.rot_3d((0.1, 0.2, 0.3)) @ synth.rot_3d((0.1, 0.2, 0.3)).T, np.eye(3))
    assert len(synth.gen_nonoverlapping_locations((50, 50), 30, 10)) < 30 and len(synth.gen_connected_locations((50, 50), 4, 5)) == 4
