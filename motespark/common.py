"""Helpers shared by all operators: reading, missing values, lineage, bounded broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(*names: str | Column) -> Column:
    """True where every column is neither NULL nor NaN."""
    out = F.lit(True)
    for n in names:
        c = F.col(n) if isinstance(n, str) else n
        out = out & c.isNotNull() & ~F.isnan(c)
    return out


def no_nan(name: str | Column) -> Column:
    """NaN as NULL; Spark's sum, avg and max would otherwise pass NaN on."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clean(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with NaN turned into NULL in the named columns (all floating ones by default)."""
    cols = names or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: no_nan(c) for c in cols}) if cols else df


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded (to millionths of a million from there on), with -0.0 turned into 0.0."""
    return F.when(F.abs(c) >= 1e6, F.round(c / 1e6, digits) * 1e6).otherwise(F.round(c, digits)) + F.lit(0.0)


def need(df: DataFrame, *names: str) -> None:
    """Raise ValueError if a column is missing."""
    lack = [n for n in names if n not in df.columns]
    if lack:
        raise ValueError(f"columns missing: {', '.join(lack)}")


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows; else leave the join to Spark.

    At most ``max_rows + 1`` rows are counted.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="motespark-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder: later uses read the files, lost executors or not."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Remove the files of results of ``cut`` that nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        if not plan.getClass().getSimpleName().startswith("LogicalRDD"):
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in whatever file system the path names; one that is there is replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def first_rows(tab: pa.Table, names: Sequence[str]) -> np.ndarray:
    """First rows of the stretches of a table that are equal in the named columns, which hold no NULL."""
    n = tab.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in names if n > 1 else ():
        a = tab[c].combine_chunks()
        new[1:] |= pc.not_equal(a.slice(1), a.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
