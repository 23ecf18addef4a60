"""Queries that link detections into tracks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motespark.common import cut
from motespark.operators import linking as lk
from motespark.operators.predict import DriftPredict, NearestVelocityPredict
from motespark.plans.motion_queries import _r
from motespark.plans.static_queries import FT, features
from motespark.plans.sqlutil import r6

RANGE = 5.0
G = ["video_id"]


def link_candidates(spark, d):
    return _r(lk.link_candidates(features(spark, d), G, "feature_id", RANGE).select("video_id", "src", "dst", "dist"))


def link_drop(spark, d):
    return lk.link(features(spark, d), G, "feature_id", RANGE, strategy="drop").select("feature_id", "particle")


def link(spark, d):
    return lk.link(features(spark, d), G, "feature_id", RANGE, max_size=1000).select("feature_id", "particle")


def _linked(spark, d, **kw):
    return lk.link(features(spark, d), G, "feature_id", RANGE, **kw).select("video_id", "frame", "feature_id", "particle")


def link_memory(spark, d):
    return _linked(spark, d, memory=3, max_size=1000)


def link_adaptive(spark, d):
    return _linked(spark, d, adaptive_stop=0.05, adaptive_step=0.9)


def link_predict_drift(spark, d):
    return _linked(spark, d, predictor=DriftPredict, max_size=1000)


def link_predict_nearest(spark, d):
    return _linked(spark, d, predictor=NearestVelocityPredict, memory=1, max_size=1000)


def link_partial(spark, d):
    t = features(spark, d).withColumn("particle", F.col("feature_id"))
    return lk.link_partial(t, G, "feature_id", RANGE, (10, 60), max_size=1000).select("video_id", "frame", "feature_id", "particle")


def _rules(linked, memory=0):
    """What a linking must keep to, counted for each movie: nothing but the number of features may differ from 0.

    ``doubled``: two features of a track in one frame; ``far``: steps beyond the range; ``gaps``: steps over more frames
    than the memory allows; ``missed``: without memory, features of consecutive frames that are each other's only
    candidates and in different tracks; ``nameless``: features without a track.
    """
    key = [*G, "particle"]
    w = W.partitionBy(*key).orderBy("frame", "feature_id")
    before = lambda c: F.lag(c).over(w)
    step = linked.where("particle is not null").select(
        *key, (F.col("frame") - before("frame")).alias("dt"), F.sqrt(F.pow(F.col("x") - before("x"), 2) + F.pow(F.col("y") - before("y"), 2)).alias("way")
    )
    n = lambda cond: F.count(F.when(F.expr(cond) if isinstance(cond, str) else cond, 1))
    steps = step.groupBy(*G).agg(n("dt = 0").alias("doubled"), n(F.col("way") >= RANGE + 1e-6).alias("far"), n(F.col("dt") > memory + 1).alias("gaps"))
    out = linked.groupBy(*G).agg(F.count(F.lit(1)).alias("features"), n("particle is null").alias("nameless")).join(steps, G)
    if memory:
        return out
    of = linked.select("feature_id", "particle")
    e = lk.link_candidates(linked, G, "feature_id", RANGE, most=None)
    alone = e.withColumns({"a": F.count(F.lit(1)).over(W.partitionBy("src")), "b": F.count(F.lit(1)).over(W.partitionBy("dst"))}).where("a = 1 and b = 1")
    both = alone.join(of.toDF("src", "p"), "src").join(of.toDF("dst", "q"), "dst")
    return out.join(both.groupBy(*G).agg(n("p <> q").alias("missed")), G, "left").fillna(0, ["missed"])


def _ruled(name, memory=0, **kw):
    def query(spark, d):
        f = features(spark, d)
        linked = lk.link(f, G, "feature_id", RANGE, memory=memory, **kw)
        return _rules(cut(linked), memory)

    query.__name__ = name
    return query


RULED = [
    _ruled("link_rules", max_size=1000), _ruled("link_memory_rules", 3, max_size=1000), _ruled("link_adaptive_rules", adaptive_stop=0.05, adaptive_step=0.9),
    _ruled("link_all_neighbors_rules", neighbors=None, max_size=1000), _ruled("link_drop_rules", strategy="drop"),
]


def link_partial_rules(spark, d):
    """A relinked patch obeys the rules within itself, and the frames before it keep their tracks."""
    f = features(spark, d)
    old = cut(lk.link(f, G, "feature_id", RANGE, strategy="drop"))
    new = cut(lk.link_partial(old, G, "feature_id", RANGE, (10, 60), strategy="drop"))
    kept = new.where("frame < 10").join(old.select("feature_id", F.col("particle").alias("was")), "feature_id")
    inside = _rules(new.where("frame >= 10 and frame < 60"))
    return inside.join(kept.groupBy(*G).agg(F.count(F.when(F.col("was") != F.col("particle"), 1)).alias("renamed_before")), G, "left").fillna(0, ["renamed_before"])


QUERIES = {f.__name__: f for f in (link_candidates, link_drop, link, link_memory, link_adaptive, link_predict_drift, link_predict_nearest, link_partial, link_partial_rules, *RULED)}

_EDGES = f"""{FT}, g AS (SELECT *, floor(x / {RANGE}) AS cx, floor(y / {RANGE}) AS cy FROM f),
h AS (SELECT g.*, cx + i AS jx, cy + j AS jy FROM g, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
e0 AS (SELECT a.video_id, a.feature_id AS src, b.feature_id AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM h a JOIN g b ON a.video_id = b.video_id AND a.frame + 1 = b.frame AND a.jx = b.cx AND a.jy = b.cy),
e1 AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS k FROM e0 WHERE dist < {RANGE} + 1e-7), e AS (SELECT * FROM e1 WHERE k <= 10)"""

ORACLES = {
    "link_candidates": f"WITH {_EDGES} SELECT video_id, src, dst, {r6('dist')} FROM e",
    "link_drop": f"""WITH RECURSIVE {_EDGES}, n AS (SELECT *, count(*) OVER (PARTITION BY src) AS ns, count(*) OVER (PARTITION BY dst) AS nd FROM e),
l AS (SELECT src, dst FROM n WHERE ns = 1 AND nd = 1),
c(head, cur) AS (SELECT feature_id, feature_id FROM f WHERE feature_id NOT IN (SELECT dst FROM l) UNION ALL SELECT c.head, l.dst FROM c JOIN l ON c.cur = l.src)
SELECT cur AS feature_id, head AS particle FROM c""",
    **{
        q.__name__: f"""WITH {FT} SELECT video_id, count(*) AS features, 0::BIGINT AS nameless, 0::BIGINT AS doubled, 0::BIGINT AS far, 0::BIGINT AS gaps
{'' if 'memory' in q.__name__ else ', 0::BIGINT AS missed'} FROM f GROUP BY video_id"""
        for q in RULED
    },
    "link_partial_rules": f"""WITH {FT} SELECT video_id, count(*) AS features, 0::BIGINT AS nameless, 0::BIGINT AS doubled, 0::BIGINT AS far, 0::BIGINT AS gaps, 0::BIGINT AS missed,
0::BIGINT AS renamed_before FROM f WHERE frame >= 10 AND frame < 60 GROUP BY video_id""",
}
