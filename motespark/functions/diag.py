"""What this installation consists of."""

from __future__ import annotations

import importlib.metadata
import logging
import platform
import sys

logger = logging.getLogger("motespark")
_handler = logging.StreamHandler(sys.stdout)
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def dependencies() -> dict[str, str | None]:
    """Versions of Python, the platform and the packages used; None where one is missing."""
    out: dict[str, str | None] = {"python": sys.version.split()[0], "platform": platform.platform()}
    for p in PACKAGES:
        try:
            out[p] = importlib.metadata.version(p)
        except importlib.metadata.PackageNotFoundError:
            out[p] = None
    return out


def performance_report(spark) -> dict[str, str | None]:
    """The session's settings that decide how fast queries run; None where one is neither set nor has a default."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    return {k: spark.conf.get(k, None) for k in keys}


def handle_logging(level: int = logging.INFO) -> None:
    """Send the package's messages to standard output."""
    if _handler not in logger.handlers:
        logger.addHandler(_handler)
    logger.setLevel(level)


def ignore_logging() -> None:
    """Leave the package's messages to the program's own logging again."""
    logger.removeHandler(_handler)
    logger.setLevel(logging.NOTSET)


def quiet(suppress: bool = True) -> None:
    """Only warnings, or with ``suppress=False`` everything from INFO on."""
    logger.setLevel(logging.WARNING if suppress else logging.INFO)
