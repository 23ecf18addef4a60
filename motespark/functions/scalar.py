"""Column functions: text and time parsing, power laws, guarded exponentials."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motespark.common import free_name


def extract(pattern: str, string: Column, group: int = 0, convert: str | None = None) -> Column:
    """The regular expression's group, NULL where it doesn't match; ``convert`` names a type to cast to."""
    got = F.when(string.rlike(pattern), F.regexp_extract(string, pattern, group))
    return got.cast(convert) if convert else got


def timestamp(text: Column) -> Column:
    """A timestamp from 'yyyy-MM-dd HH:mm:ss', NULL if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def lazy_timestamp(text: Column, strict: bool = False) -> Column:
    """'0:37' as '00:00:37': a text that begins like HH:MM:SS, H:MM:SS, MM:SS or M:SS fills 00:00:00 from the right.

    Others are NULL, or with ``strict`` an error; NULL stays NULL. A text of more than eight characters stays as it is.
    """
    full = F.concat(F.substring(F.lit("00:00:00"), F.lit(1), F.greatest(F.lit(8) - F.length(text), F.lit(0))), text)
    bad = F.raise_error(F.concat(F.lit("no time of day: "), text)) if strict else F.lit(None).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(r"^\d?\d?:?\d?\d:\d\d"), full).otherwise(bad)


def time_interval(text: Column) -> Column:
    """The interval that a text beginning with HH:MM:SS names, NULL if it is none."""
    pattern = r"^([0-9][0-9]):([0-5][0-9]):([0-5][0-9])"
    h, m, s = (F.regexp_extract(text, pattern, i).cast("int") for i in (1, 2, 3))
    return F.when(text.rlike(pattern), F.make_dt_interval(F.lit(0), h, m, s.cast("decimal(18,6)")))


def seconds(interval: Column) -> Column:
    """An interval's length in seconds."""
    part = lambda unit: F.date_part(F.lit(unit), interval).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from timestamp a to timestamp b."""
    return b.cast("timestamp").cast("double") - a.cast("timestamp").cast("double")


def timedelta_to_frame(seconds: Column, fps: Column | float) -> Column:
    """Frame number at a time in seconds, cut down."""
    f = F.lit(fps) if isinstance(fps, (int, float)) else fps
    return (seconds * f).cast("bigint")


def safe_exp(x: Column) -> Column:
    """exp with underflow to 0; NaN and NULL stay."""
    return F.when(x <= math.log(sys.float_info.epsilon), F.lit(0.0)).otherwise(F.exp(x))


def random_walk(df: DataFrame, order: str, keys: Sequence[str] = (), seed: int = 0, name: str = "walk") -> DataFrame:
    """Cumulative sum of unit normal steps along ``order``, of any length with or without keys."""
    from motespark.operators.ordering import running_total

    step = free_name(df, "_step")
    return running_total(df.withColumn(step, F.randn(seed)), keys, [order], step, name).drop(step)


def fit_powerlaw(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """y = A x**n by least squares of the logarithms: ``n``, ``A``. Values that aren't positive don't count."""
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*groups, F.log(x).alias("lx"), F.log(y).alias("ly"))
    return ok.groupBy(*groups).agg(F.regr_slope("ly", "lx").alias("n"), F.exp(F.regr_intercept("ly", "lx")).alias("A"))


def validate_tuple(value, ndim: int) -> tuple:
    """A number as a tuple of ``ndim``; a tuple of that length as it is."""
    if not hasattr(value, "__iter__"):
        return (value,) * ndim
    if len(value) == ndim:
        return tuple(value)
    raise ValueError(f"needs {ndim} values")


def is_isotropic(value) -> bool:
    return len(set(value)) == 1 if hasattr(value, "__iter__") else True


def stats_mode(column: str) -> Column:
    """Most frequent value, the smallest of equals."""
    return F.mode(F.col(column), deterministic=True)
