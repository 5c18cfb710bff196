"""Problem 1: the top N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int = 5, salts: int = 32) -> DataFrame:
    """The n items of every group with the highest score, equal scores by smaller item.

    Two-stage salted ranking.  A hash of the item splits each group into ``salts``
    subgroups; every subgroup is ranked and cut to n, before the shuffle within each
    task and after it within the subgroup, and only survivors are ranked over the whole
    group.  A group that holds a third of all rows is so spread over ``salts`` tasks and
    its last ranking sees salts * n rows at most.

    Rows with a null group, item or score and NaN scores don't count (infinite ones do,
    -0.0 equals 0.0).  Repeated rows count once, and an item listed with several scores
    counts with its best: both are folded by an aggregate over (group, item) first, whose
    keys spread a large group over all tasks.  Fewer than n items: all
    come out.  Empty input: empty result.  Other columns are never read.
    """
    rows = df.select(
        *[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)],
        F.col(item).alias("__item"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("__score"),
    ).dropna()
    keys = [f"__g{k}" for k in range(len(groups))]
    order = [F.col("__score").desc(), F.col("__item")]
    sub = Window.partitionBy(*keys, F.pmod(F.xxhash64("__item"), F.lit(salts))).orderBy(*order)
    best = rows.groupBy(*keys, "__item").agg(F.max("__score").alias("__score"))
    survivors = best.withColumn("__r", F.row_number().over(sub)).filter(F.col("__r") <= n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        survivors.withColumn("place", F.row_number().over(whole))
        .filter(F.col("place") <= n)
        .select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("__item").alias(item), F.col("__score").alias(score), "place")
    )
