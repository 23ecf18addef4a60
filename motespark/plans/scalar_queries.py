"""Queries of the column functions on the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from motespark.common import rounded, table
from motespark.functions import scalar as s


def scalar_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", s.extract(r'"k": (\d+)', F.col("props"), 1, "bigint").alias("k"), s.extract(r"^(\w)\w*r$", F.col("event_type"), 1).alias("first_letter"))


def scalar_time(spark, d):
    e = table(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    short = F.concat_ws(":", F.date_format("ts", "m"), F.date_format("ts", "ss"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    of_day = s.seconds(s.time_interval(F.date_format("ts", "HH:mm:ss")))
    return e.select(
        "event_id", s.lazy_timestamp(short).alias("regular"), of_day.cast("bigint").alias("of_day"), s.seconds_between(start, s.timestamp(text)).cast("bigint").alias("since"),
        s.timedelta_to_frame(of_day, 24).alias("frame"), s.seconds(s.time_interval(F.col("event_type"))).cast("bigint").alias("none"),
    )


def scalar_safe_exp(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", rounded(s.safe_exp(F.col("value") / -4.0), 9).alias("e"))


def scalar_mode(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(s.stats_mode("event_type").alias("usual"))


QUERIES = {f.__name__: f for f in (scalar_extract, scalar_time, scalar_safe_exp, scalar_mode)}

ORACLES = {
    "scalar_extract": r"""SELECT event_id, CAST(nullif(regexp_extract(props, '"k": (\d+)', 1), '') AS BIGINT) AS k, nullif(regexp_extract(event_type, '^(\w)\w*r$', 1), '') AS first_letter FROM events""",
    "scalar_time": """SELECT event_id, '00:' || CASE WHEN minute(ts) < 10 THEN '0' ELSE '' END || minute(ts) || ':' || CASE WHEN second(ts) < 10 THEN '0' ELSE '' END || second(ts) AS regular,
CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS of_day, CAST(floor(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS since,
CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 24 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS none FROM events""",
    "scalar_safe_exp": "SELECT event_id, round(CASE WHEN value / -4.0 <= ln(2.220446049250313e-16) THEN 0.0 ELSE exp(value / -4.0) END, 9) + 0.0 AS e FROM events",
    "scalar_mode": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type AS usual FROM r WHERE k = 1""",
}
