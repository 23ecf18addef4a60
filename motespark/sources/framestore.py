"""Features stored frame by frame in Parquet."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motespark.common import write_text


class FrameStore:
    """A Parquet folder of features, partitioned by frame, so that one frame or the first N prune to their files.

    ``put`` replaces the frames that it holds (dynamic partition overwrite); with ``mode="append"`` it adds rows. Many
    frames are written at once by ``put_all``.
    """

    def __init__(self, spark: SparkSession, path: str, t_column: str = "frame", mode: str = "replace"):
        if mode not in ("replace", "append"):
            raise ValueError("mode must be replace or append")
        self.spark, self.path, self.t_column, self.mode = spark, path.rstrip("/"), t_column, mode

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def _validate(self, df: DataFrame) -> int:
        if self.t_column not in df.columns:
            raise ValueError(f"no column {self.t_column!r}")
        return df.select(self.t_column).distinct().limit(2).count()

    def put(self, df: DataFrame) -> None:
        """Write one frame; an empty one is skipped with a warning."""
        n = self._validate(df)
        if n == 0:
            warnings.warn("an empty frame isn't stored")
        elif n > 1:
            raise ValueError("put takes one frame")
        else:
            self.put_all(df)

    def put_all(self, df: DataFrame) -> None:
        """Write all frames of ``df``."""
        if self.t_column not in df.columns:
            raise ValueError(f"no column {self.t_column!r}")
        w = df.repartition(self.t_column).write.partitionBy(self.t_column)
        if self.mode == "append":
            w.mode("append").parquet(self.path)
        else:
            w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def all(self) -> DataFrame:
        if not self._exists():
            raise KeyError("the store is empty")
        return self.spark.read.parquet(self.path).withColumn(self.t_column, F.col(self.t_column).cast("bigint"))

    def get(self, frame: int) -> DataFrame:
        out = self.all().where(F.col(self.t_column) == frame)
        if out.limit(1).isEmpty():
            raise KeyError(frame)
        return out

    __getitem__ = get

    @property
    def frames(self) -> list[int]:
        """Frame numbers, as the names of the partition folders have them; no file is read."""
        if not self._exists():
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        start = f"{self.t_column}="
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return sorted(int(n[len(start) :]) for n in names if n.startswith(start) and n[len(start) :].lstrip("-").isdigit())

    @property
    def max_frame(self) -> int:
        return max(self.frames)

    def __len__(self) -> int:
        return len(self.frames)

    def __iter__(self) -> Iterator[DataFrame]:
        return (self.get(f) for f in self.frames)

    def dump(self, n: int | None = None) -> DataFrame:
        """All features, or those of the first ``n`` frames."""
        if n is None:
            return self.all()
        first = self.frames[:n]
        return self.all().where(F.col(self.t_column) <= first[-1]) if first else self.all().limit(0)

    def record_meta(self, meta: dict) -> None:
        """Keep call parameters beside the features."""
        write_text(self.spark, f"{self.path}/_meta.json", json.dumps(meta, default=str))

    def sink(self):
        """A function for ``foreachBatch``."""
        return lambda df, _: self.put_all(df)

    def close(self) -> None:
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
