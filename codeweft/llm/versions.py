"""The current version of each file among all scanned ones, and files that tasks need."""

from __future__ import annotations

import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SENT: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Give the executors a local file of the driver, once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        _SENT.add(key)
        spark.sparkContext.addFile(path)


def shipped_file(path: str) -> str:
    """Where a task finds a file that was shipped."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


def current(facts: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """One row per key: the one with the latest stamp, equal stamps by larger ``tie``, null stamps last.

    Only facts about a version take part, never its content, so what is shuffled is small;
    ``max`` over a struct is folded on the map side, and a file that was scanned very often
    is no hot key.  Rows with a null key are left out.
    """
    rest = [c for c in facts.columns if c not in (*keys, stamp, tie)]
    best = F.max(F.struct(stamp, tie, *rest)).alias("__best")
    return facts.dropna(subset=keys).groupBy(*keys).agg(best).select(*keys, F.col(f"__best.{stamp}").alias(stamp), *[F.col(f"__best.{c}").alias(c) for c in rest])
