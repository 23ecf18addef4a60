"""The training-data problems: brute force, exact round trips, edge cases, skew."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motespark.llm.mixing import apportion, mix
from motespark.llm.oracle import ORACLES
from motespark.llm.packing import best_fit, crossover, evolve, fitness, least_bins, mutate, pack, packing_report
from motespark.llm.quantiles import _as_double, digest, merge, ordered_key, percentiles
from motespark.llm.queries import QUERIES
from motespark.llm.spans import Hashes, anchors, shared_spans, sliding_min, span_report
from motespark.llm.tokens import encoder, with_tokens, VOCABULARY
from motespark.llm.topn import top_n_per_group

NAN = float("nan")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLES[name])


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


def test_packing_query(spark, data):
    """Every document in a container of each limit, none overfull, only those cut that exceed the capacity."""
    p, d = QUERIES["p7_packing"](spark, data).toPandas(), documents(spark, data)
    assert (p.groupby(["limit_id", "container"]).n_tokens.sum() <= p.groupby(["limit_id", "container"]).capacity.first()).all()
    for _, one in p.groupby("limit_id"):
        assert set(one.doc_id) == set(d.doc_id)
        parts, total = one.groupby("doc_id").size(), one.groupby("doc_id").n_tokens.sum()
        assert (parts == np.maximum(np.ceil(total / one.capacity.iloc[0]), 1)).all()
    r = QUERIES["p7_report"](spark, data).toPandas()
    assert (r.containers >= r.least_containers).all() and (r.fullest <= r.capacity).all() and (r.containers <= r.least_containers * 1.02 + 1).all()


def test_mix_queries(spark, data):
    """Chosen records are known, not repeated beyond their source's cap, and add up to what the report says."""
    got, rep, d = QUERIES["p8_mix"](spark, data).toPandas(), QUERIES["p8_report"](spark, data).toPandas().set_index("source"), documents(spark, data)
    assert got.doc_id.is_unique and (got.merge(d, on="doc_id").source_x == got.merge(d, on="doc_id").source_y).all()
    assert (got.repeats <= got.source.map(rep.max_repeats)).all() and (got.repeats >= 1).all()
    assert ((got.n_tokens * got.repeats).groupby(got.source).sum() == rep.selected_tokens[rep.selected_tokens > 0].sort_index()).all()
    assert rep.reached[rep.available_tokens > 0].all() and rep.binds.sum() >= 1
    every = QUERIES["p8_report_all"](spark, data).toPandas()
    assert not every.reached.all() and not every.binds.any() and every.selected_tokens.sum() >= rep.selected_tokens.sum()


def test_all_queries_are_tested():
    assert set(QUERIES) - set(ORACLES) == {"p7_packing", "p7_report", "p8_mix", "p8_report", "p8_report_all"}


# --- top N


@pytest.mark.parametrize("n", [1, 4])
def test_top_n_brute(spark, rows, n):
    rng = random.Random(n)
    data = [(g, rng.choice([1.0, 2.0, 2.5, NAN, None, -0.0]), i) for i in range(300) for g in [rng.choice([None, 1, 2, 2, 2, 2, 3])]]
    data += data[:40]
    df = spark.createDataFrame([(*r, 9, 1, "x") for r in data], "g bigint, score double, id bigint, _rank bigint, _part int, k string").repartition(5)
    got = rows(top_n_per_group(df, ["g"], "score", "id", n, keep=["_rank", "k"], partitions=6), "g", "id", "position")
    want = []
    for g in (None, 1, 2, 3):
        best = sorted({(-s, i) for h, s, i in data if h == g and s is not None and s == s})[:n]
        want += [(g, i, p + 1) for p, (_, i) in enumerate(best)]
    assert got == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))


def test_top_n_hot_group_spans_partitions(spark, rows):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") % 7).cast("double").alias("score"), "id")
    df = df.unionByName(df.where("id < 3").withColumn("g", F.lit("cold")))
    top = top_n_per_group(df, ["g"], "score", "id", 5, partitions=9)
    got = rows(top, "g", "id", "position")
    assert got == [("cold", 0, 3), ("cold", 1, 2), ("cold", 2, 1)] + [("hot", 6 + 7 * k, k + 1) for k in range(5)]


def test_top_n_more_than_a_partition_holds(spark, rows):
    df = spark.range(400).select(F.lit(1).alias("g"), F.lit(2.0).alias("score"), "id")
    got = rows(top_n_per_group(df, ["g"], "score", "id", 250, partitions=8), "id", "position")
    assert got == [(i, i + 1) for i in range(250)]


def test_top_n_empty_and_bad(spark):
    df = spark.createDataFrame([], "g bigint, score double, id bigint")
    assert top_n_per_group(df, ["g"], "score", "id", 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], "score", "id", 3, position="id")
    with pytest.raises(ValueError):
        top_n_per_group(df, ["h"], "score", "id", 3)


# --- percentiles


def test_ordered_key(spark):
    v = [-1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 0.1, 1.0, 1.0000000000000002, 3e8, float("inf"), float("-inf")]
    r = spark.createDataFrame([(x,) for x in v], "x double").select("x", ordered_key(F.col("x")).alias("k")).withColumn("back", _as_double(F.col("k"))).collect()
    assert [x.k for x in sorted(r, key=lambda r: r.x)] == sorted(x.k for x in r)
    assert all(struct.pack("d", x.back) == struct.pack("d", x.x + 0.0) for x in r)


def quantile(vals, q):
    vals = sorted(vals)
    k = max(1, int(np.ceil(q * len(vals))))
    return vals[k - 1]


@pytest.mark.parametrize("bits", [64, 32, 20])
def test_percentiles_brute(spark, bits):
    rng = random.Random(bits)
    data = []
    for g, n in ((1, 400), (2, 1), (None, 30)):
        for i in range(n):
            data.append((g, i % 3, rng.choice([rng.uniform(-5, 5), round(rng.uniform(0, 50)), 7.0, NAN, None]), rng.lognormvariate(0, 3)))
    df = spark.createDataFrame([(a, b, None if v is None else float(v), w) for a, b, v, w in data], "g bigint, day bigint, v double, w double")
    days = [digest(df.where(F.col("day") == k), ["g", "day"], ["v", "w"], bits) for k in range(3)]
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r.g, r.metric, r.q): r for r in percentiles(merge(["g"], *days), ["g"], qs, bits).collect()}
    n = 0
    for g in (1, 2, None):
        for m, k in (("v", 2), ("w", 3)):
            vals = [r[k] for r in data if r[0] == g and r[k] is not None and r[k] == r[k]]
            for q in qs if vals else ():
                want, r = quantile(vals, q), got[g, m, q]
                n += 1
                assert r.n_values == len(vals)
                assert r.value <= want and abs(r.value - want) <= (abs(want) + abs(r.value)) * (0 if bits == 64 else 2.0 ** (12 - bits)) + (1e-300 if bits < 64 else 0)
    assert len(got) == n


def test_percentiles_empty(spark):
    df = spark.createDataFrame([(1, None), (1, NAN)], "g bigint, v double")
    assert percentiles(digest(df, ["g"], ["v"]), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        digest(df, ["g"], ["v"], 5)
    with pytest.raises(ValueError):
        percentiles(digest(df, ["g"], ["v"]), ["g"], [1.5])


# --- packing


def check_packing(packed, items, caps):
    got = packed.toPandas()
    for limit, cap in caps.items():
        p = got[got.limit_id == limit]
        assert p.groupby("container").n_tokens.sum().le(cap).all()
        assert p.groupby("doc").n_tokens.sum().to_dict() == {k: v for k, v in items.items()}
        parts = p.groupby("doc").size()
        for k, v in items.items():
            assert parts[k] == max(1, -(-v // cap))
    return got


def test_packing(spark):
    rng = random.Random(4)
    items = {i: rng.choice([0, 1, rng.randint(1, 90), rng.randint(1, 300), 100]) for i in range(700)} | {9000: 1234, 9001: 100}
    df = spark.createDataFrame([(k, v, "x") for k, v in items.items()] + [(None, 5, "x"), (0, items[0], "y")], "doc bigint, n_tokens bigint, container string")
    limits = spark.createDataFrame([(1, 100), (2, 333), (3, None), (None, 5), (4, 0)], "limit_id bigint, capacity_tokens int")
    packed = pack(df, "doc", "n_tokens", limits, shard_items=300)
    got = check_packing(packed, items, {1: 100, 2: 333})
    assert set(got.limit_id) == {1, 2}
    rep = {r.limit_id: r for r in packing_report(packed).collect()}
    assert rep[2].filled > 0.97 and rep[1].filled > 0.93 and rep[2].containers >= rep[2].least_containers
    again = pack(df.repartition(3), "doc", "n_tokens", limits, shard_items=300).toPandas()
    key = ["limit_id", "doc", "part"]
    assert again.sort_values(key, ignore_index=True).equals(got.sort_values(key, ignore_index=True))


def test_packing_edges(spark):
    limits = spark.createDataFrame([(1, 10)], "limit_id bigint, capacity_tokens int")
    none = spark.createDataFrame([], "doc bigint, n_tokens bigint")
    assert pack(none, "doc", "n_tokens", limits).count() == 0
    one = spark.createDataFrame([(1, None), (2, 10), (3, 20), (4, 21)], "doc bigint, n_tokens bigint")
    check_packing(pack(one, "doc", "n_tokens", limits), {1: 0, 2: 10, 3: 20, 4: 21}, {1: 10})
    assert pack(one, "doc", "n_tokens", limits.limit(0)).count() == 0


def test_genetic_operators():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 300)
    a = best_fit(sizes, 100, np.argsort(-sizes))
    b = best_fit(sizes, 100, rng.permutation(300))
    for child in (f for swap in (False, True) for f in (crossover(sizes, a, b, 100, rng, swap), mutate(sizes, b, 100, rng, swap))):
        assert np.bincount(child, weights=sizes).max() <= 100 and len(child) == 300
    best = evolve(sizes, 100, [b], 6, 60, rng)[0]
    assert fitness(sizes, best, 100) >= fitness(sizes, b, 100)


def triplets(bins, capacity, rng):
    """Items that fill ``bins`` bins in threes without a gap; best-fit decreasing needs a sixth more."""
    a = rng.integers(int(capacity * 0.38), int(capacity * 0.49) + 1, bins)
    b = np.array([rng.integers(capacity // 4, capacity - x - capacity // 4 + 1) for x in a])
    return np.concatenate([a, b, capacity - a - b])


def test_evolution_beats_best_fit_where_that_is_poor():
    rng = np.random.default_rng(0)
    for sizes, capacity, gain in ((triplets(83, 1000, rng), 1000, 0.1), (triplets(300, 1000, rng), 1000, 0.1), (rng.integers(30, 105, 1000), 150, 0.0)):
        plain = best_fit(sizes, capacity, np.argsort(-sizes, kind="stable")).max() + 1
        best = evolve(sizes, capacity, [], 4, 60, np.random.default_rng(1))[0]
        used = best.max() + 1
        assert least_bins(sizes, capacity) <= used <= plain * (1 - gain)
        assert np.bincount(best, weights=sizes).max() <= capacity


@given(st.lists(st.integers(0, 12), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_least_bins(sizes):
    """Never above the number that the best of all orders needs."""
    from itertools import permutations

    sizes = np.array(sizes)
    best = min(best_fit(sizes, 12, np.array(p)).max() + 1 for p in permutations(range(len(sizes))))
    assert least_bins(sizes, 12) <= best


def test_packing_across_shards(spark):
    """What many shards leave over is packed together: hardly more containers than best-fit on all items at once."""
    rng = np.random.default_rng(3)
    items = {i: int(n) for i, n in enumerate(rng.integers(1, 70, 4000))}
    df = spark.createDataFrame(list(items.items()), "doc bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 100)], "limit_id bigint, capacity_tokens int")
    got = check_packing(pack(df, "doc", "n_tokens", limits, shard_items=200), items, {1: 100})
    sizes = np.array(list(items.values()))
    assert got.container.nunique() <= (best_fit(sizes, 100, np.argsort(-sizes)).max() + 1) + 4


# --- mixing


@given(st.lists(st.floats(0, 100), min_size=1, max_size=8), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_apportion_is_highest_quotients(weights, seats):
    got = apportion(weights, seats)
    if sum(weights) == 0:
        assert got.sum() == 0
        return
    assert got.sum() == seats
    low = min((w / (2 * g - 1) for w, g in zip(weights, got) if g), default=np.inf)
    high = max(w / (2 * g + 1) for w, g in zip(weights, got))
    assert low >= high * (1 - 1e-9)


def test_apportion_caps():
    assert apportion([5, 3, 2], 10).tolist() == [5, 3, 2]
    assert apportion([5, 3, 2], 10, [2, 100, 100]).tolist()[0] == 2 and apportion([5, 3, 2], 10, [2, 100, 100]).sum() == 10
    assert apportion([1, 1], 10, [2, 3]).tolist() == [2, 3]


TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.0, 1)]


def corpus(spark, n=3000):
    rng = random.Random(2)
    data = [(i, rng.choice(["a"] * 12 + ["b"] * 3 + ["c", None, "other"]), rng.randint(0, 60), "z") for i in range(n)]
    return data, spark.createDataFrame(data + data[:20] + [(None, "a", 5, "z"), (99999, "a", None, "z")], "id bigint, source string, n bigint, repeats string")


@pytest.mark.parametrize("shard", [64_000_000, 3000])
def test_mix(spark, shard):
    data, df = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, report = mix(df, "id", "source", "n", targets, shard_tokens=shard)
    got, rep = chosen.toPandas(), report.toPandas().set_index("source")
    used = (got.n_tokens * got.repeats).groupby(got.source).sum()
    for s, share, most in TARGETS[:3]:
        assert rep.share[s] == pytest.approx(share, abs=0.02) and rep.reached[s]
        assert rep.selected_tokens[s] == used[s]
        assert got[got.source == s].repeats.between(1, most).all()
    assert rep.share["gone"] == 0 and set(got.source) <= {"a", "b", "c"} and got.id.is_unique
    again = mix(df.repartition(7), "id", "source", "n", targets, shard_tokens=shard)[0].toPandas()
    assert again.sort_values("id", ignore_index=True).equals(got.sort_values("id", ignore_index=True))


def test_mix_out_of_reach_and_empty(spark):
    data, df = corpus(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("c", 0.7, 2), ("nothing", 0.1, 1), ("d", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, "id", "source", "n", targets, total=60_000)
    rep = report.toPandas().set_index("source")
    assert not rep.reached["c"] and rep.most_repeats["c"] == 2 and rep.selected_records["c"] == rep.records["c"] and not rep.reached["nothing"]
    chosen, report = mix(df.limit(0), "id", "source", "n", targets)
    assert chosen.count() == 0 and report.count() == 4


# --- tokens


def test_tokens(spark):
    texts = ["", None, "Hello there", "日本語のテキスト", "a" * 3000, "<|endoftext|> x"]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "id bigint, body string, _text string")
    got = {r.id: r.n_tokens for r in with_tokens(df, "body", ["id", "_text"]).collect()}
    enc = encoder(VOCABULARY)
    assert got == {i: 0 if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert got[0] == got[1] == 0 and got[2] == 2


# --- shared spans


def brute_spans(docs, length):
    seen = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in docs:
        cur = None
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) < 2:
                continue
            if cur and i <= cur[1]:
                cur[1] = i + length
            else:
                if cur:
                    out.add((d, *cur))
                cur = [i, i + length]
        if cur:
            out.add((d, *cur))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram"), [(12, 5), (30, 8), (6, 6)])
def test_spans_brute(spark, rows, length, gram):
    rng = random.Random(length)
    word = lambda n, a="abcdé日🔬": "".join(rng.choice(a) for _ in range(n))
    shared = [word(50), word(31), "z" * 80, "xy" * 40, word(12)]
    docs = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t += word(rng.randint(0, 30)) + s[a : rng.randint(a, len(s))]
        docs.append((i, t))
    docs += [(100, "q" * 90), (101, shared[0]), (102, shared[0]), (103, word(40) * 2), (104, "")]
    df = spark.createDataFrame(docs + [(103, docs[-2][1]), (105, None), (None, shared[0])], "doc bigint, text string").withColumn("th", F.lit(1)).withColumn("p", F.lit(2))
    got = rows(shared_spans(df, "doc", "text", length, gram), "doc", "span_start", "span_end")
    assert got == brute_spans(docs, length)


def test_span_report(spark, rows):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, a), (2, "x" * 50 + a[:250]), (3, "short"), (4, "")], "doc bigint, text string")
    assert rows(span_report(df, "doc", "text", 200)) == [(1, 300, 1, 250, pytest.approx(0.833333)), (2, 300, 1, 250, pytest.approx(0.833333)), (3, 5, 0, 0, 0.0), (4, 0, 0, 0, None)]
    assert shared_spans(df.limit(0), "doc", "text").count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, "doc", "text", 10, 11)


def test_span_pieces(monkeypatch, spark, rows):
    """Texts longer than a piece are cut into overlapping pieces."""
    from motespark.llm import spans as s

    rng = random.Random(9)
    a = "".join(rng.choice("abcdef ") for _ in range(900))
    docs = [(1, a), (2, a[100:700] + "!" + a[:90])]
    whole = list(s._pieces([t for _, t in docs], 40))
    monkeypatch.setattr(s, "PIECE", 128)
    parts = list(s._pieces([t for _, t in docs], 40))
    assert len(parts) > len(whole) == 1
    windows = lambda ps: sorted((w[i], o[i] + k) for w, o, p in ps for i in range(len(p)) for k in range(len(p[i]) - 39))
    assert windows(parts) == windows(whole)


def test_span_batches(monkeypatch):
    """Window and block hashes don't depend on how many texts are hashed together."""
    import pyarrow as pa

    from motespark.llm import spans as s

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 200))) for _ in range(12)]
    lists = []
    for t in texts:
        doc, first, count, off, a, h1, h2 = anchors(s._code_points(t), np.array([len(t)]), 40, 10)
        rows = zip(first.tolist(), count.tolist(), off.tolist(), h1.view(np.int64).tolist(), h2.view(np.int64).tolist())
        lists.append([{"p": p, "n": n, "off": o, "h1": x, "h2": y, "lo": 1, "hi": 1, "i0": 0, "i1": n - 1, "u1": x, "u2": y} for p, n, o, x, y in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(range(12)), pa.array(texts), pa.array(lists)], names=["doc", "th", "text", "c"])
    wn = ["u1", "u2", "i", "w1", "w2", "lo", "hi"]
    bn = ["doc", "th", "h1", "h2", "p", "i0", "i1", "u1", "u2", "core", "lo", "hi"]
    got = []
    for piece in (1, 300, 1 << 20):
        monkeypatch.setattr(s, "PIECE", piece)
        got.append([r for f in (s._windows(40, wn), s._blocks(40, 10, bn)) for out in f(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()])
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
    same: dict = {}
    for r in got[0]:
        if "w1" in r:
            same.setdefault((r["w1"], r["w2"]), 0)
    windows = {t[i : i + 40] for t in texts for i in range(len(t) - 39)}
    assert len(same) == len(windows)


def test_anchor_functions():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    assert (sliding_min(keys, 7) == np.array([keys[i : i + 7].min() for i in range(94)])).all()
    codes = rng.integers(97, 100, 500).astype(np.uint32)
    codes[300:400] = codes[50:150]
    h = Hashes(codes, 0)
    assert h.of(np.array([50]), np.array([150])) == h.of(np.array([300]), np.array([400])) != h.of(np.array([51]), np.array([151]))
    doc, first, count, *_ = anchors(codes, np.array([200, 500]), 30, 8)
    assert count.sum() == 171 + 271 and set(doc) == {0, 1}
