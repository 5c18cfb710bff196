"""JSON inputs of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn

INSTANCE = "repo string, instance_id string, base_commit string, problem_statement string, patch string"
RUN = "instance_id string, arm string, gold array<string>, predicted array<string>, first_hit int, tokens long, turns int, cost_usd double, error string"


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Issues (a JSON list or one object per line) with their query and the files of their patch."""
    rows = spark.read.schema(INSTANCE).option("multiLine", True).json(path)
    return rows.select("*", fn.issue_query(F.col("problem_statement")).alias("query"), fn.patch_files(F.col("patch")).alias("gold"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Recorded runs, one object per line; of an instance and arm recorded twice one without an error stays, then the greatest."""
    rest = ["first_hit", "tokens", "turns", "cost_usd", "gold", "predicted", "error"]
    best = F.max(F.struct(F.col("error").isNull().alias("fine"), *rest)).alias("r")
    rows = spark.read.schema(RUN).json(path).groupBy("instance_id", "arm").agg(best)
    return rows.select("instance_id", "arm", *[F.col(f"r.{c}").alias(c) for c in rest])
