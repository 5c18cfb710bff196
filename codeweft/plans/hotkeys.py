"""Queries over edges whose targets are very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweft.operators.hotkeys import key_load, latest_per_key
from codeweft.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest_per_key(table(spark, sf_dir, "edges"), ["target_id", "kind"], "source_id", "written_at", 3, "target_id")
    return found.select("target_id", "kind", "source_id")


def p5_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_load(table(spark, sf_dir, "edges"), ["target_id", "kind"], 50)


QUERIES = {"p5_found": p5_found, "p5_load": p5_load}

SQL = {
    "p5_found": """
        WITH latest AS (
            SELECT target_id, kind, source_id, max(written_at) AS w FROM edges
            WHERE target_id IS NOT NULL AND source_id IS NOT NULL AND kind IS NOT NULL AND written_at IS NOT NULL
              AND source_id <> target_id
            GROUP BY ALL)
        SELECT target_id, kind, source_id FROM latest
        QUALIFY row_number() OVER (PARTITION BY target_id, kind ORDER BY w DESC, source_id) <= 3""",
    "p5_load": """
        WITH c AS (SELECT target_id, kind, count(*) AS n_rows FROM edges GROUP BY ALL),
             t AS (SELECT sum(n_rows) AS total FROM c)
        SELECT target_id, kind, n_rows, round(n_rows / total, 6) AS share,
               CAST(row_number() OVER (ORDER BY n_rows DESC, target_id NULLS FIRST, kind NULLS FIRST) AS INTEGER) AS place
        FROM c, t QUALIFY place <= 50""",
}
