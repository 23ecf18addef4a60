"""Queries of the training-data problems (1, 3, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motespark.common import cut, table
from motespark.llm.mixing import mix
from motespark.llm.packing import pack, packing_report
from motespark.llm.quantiles import digest, merge, percentiles
from motespark.llm.spans import shared_spans, span_report
from motespark.llm.tokens import with_tokens
from motespark.llm.topn import top_n_per_group


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "features"), ["video_id", "frame"], "mass", "feature_id", 5).select("video_id", "frame", "feature_id")


QS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: percentiles are at most 2**-20 of their magnitude too low
BITS = 32


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Each detection once, on the day it first arrived."""
    f = table(spark, d, "features")
    return f.groupBy("video_id", "frame", "feature_id", "mass", "size").agg(F.to_date(F.min("ingested_at")).alias("day"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of mass and size per movie and frame, of daily digests combined."""
    groups = ["video_id", "frame"]
    daily = digest(_readings(spark, d), [*groups, "day"], ["mass", "size"], BITS)
    return percentiles(merge(groups, daily), groups, QS, BITS)


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per movie, without an error."""
    rows = table(spark, d, "features").select("video_id", "frame", "feature_id", "mass", "size").distinct()
    return percentiles(digest(rows, ["video_id"], ["mass", "size"]), ["video_id"], QS)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(with_tokens(table(spark, d, "documents"), "text", ["doc_id"]), "doc_id", "n_tokens", table(spark, d, "pack_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p7_packing(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must keep to, per limit: all counts but those of documents and of containers saved are 0.

    ``overfull``: containers beyond their capacity; ``mixed``: containers of several limits; ``cut``: documents no larger than
    the capacity in several parts; ``short``: documents whose parts don't add up to their tokens; ``above_best_fit``: is
    the number of containers above that of best-fit decreasing's guarantee of 11/9 of the least possible, plus one?
    """
    sized = cut(with_tokens(table(spark, d, "documents"), "text", ["doc_id"]))
    packed = cut(pack(sized, "doc_id", "n_tokens", table(spark, d, "pack_limits")))
    n = lambda cond: F.count(F.when(F.expr(cond) if isinstance(cond, str) else cond, 1))
    bins = packed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("capacity"), F.countDistinct("limit_id").alias("limits"))
    per_bin = bins.groupBy("limit_id").agg(n(F.col("n") > F.col("capacity")).alias("overfull"), n("limits > 1").alias("mixed"), (F.count(F.lit(1)) > F.ceil(F.sum("n") / F.max("capacity")) * 11 / 9 + 1).cast("bigint").alias("above_best_fit"))
    docs = packed.groupBy("limit_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"), F.max("capacity").alias("capacity")).join(sized, "doc_id")
    per_doc = docs.groupBy("limit_id").agg(F.count(F.lit(1)).alias("documents"), n((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut"), n(F.col("n") != F.col("n_tokens")).alias("short"))
    return per_bin.join(per_doc, "limit_id")


def _mix(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    sized = with_tokens(table(spark, d, "documents").where("source IS NOT NULL"), "text", ["doc_id", "source"])
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0 if whole else None
    return mix(sized, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"), total=total)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_report_all(spark: SparkSession, d: str) -> DataFrame:
    """The report where the total is all tokens there are, so that some targets are out of reach."""
    return _mix(spark, d, True)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What a mix must keep to, per source: counts of records used too often, unknown, repeated, or of another source are 0, and the share is met but for a record or block."""
    chosen, report = _mix(spark, d)
    chosen = cut(chosen)
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("own")).distinct()
    n = lambda cond: F.count(F.when(F.expr(cond) if isinstance(cond, str) else cond, 1))
    t = table(spark, d, "mix_targets").select("source", F.col("max_repeats").cast("bigint").alias("max_repeats"), F.round("target_share", 6).alias("target_share"))
    per = chosen.join(docs, "doc_id", "left").join(t, "source", "left")
    rules = per.groupBy("source").agg(
        n("repeats > max_repeats or repeats < 1").alias("too_often"), n("own is null or own <> source").alias("foreign"), (F.count("doc_id") - F.countDistinct("doc_id")).alias("twice")
    )
    got = report.select("source", F.col("reached").cast("bigint").alias("met"))
    return t.join(rules, "source", "left").join(got, "source", "left").fillna(0, ["too_often", "foreign", "twice"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    s = shared_spans(table(spark, d, "documents"), "doc_id", "text", 200)
    return s.select("doc_id", F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return span_report(table(spark, d, "documents"), "doc_id", "text", 200)


QUERIES = {"p1_found": p1_found, "p3_percentiles": p3_percentiles, "p3_exact": p3_exact, "p7_packing": p7_packing, "p7_report": p7_report, "p7_check": p7_check, "p8_mix": p8_mix, "p8_report": p8_report, "p8_report_all": p8_report_all, "p8_check": p8_check, "p9_found": p9_found, "p9_report": p9_report}
