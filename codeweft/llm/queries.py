"""The llm queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.encoding import round_trips, token_counts, token_ids
from codeweft.llm.handwritten import file_origins, fitted_thresholds
from codeweft.llm.neighbours import nearest, neighbour_pairs, search_work
from codeweft.llm.packing import fill, pack
from codeweft.llm.parsing import all_errors, invalid_files, parse_rates
from codeweft.llm.topn import top_n_per_group
from codeweft.llm.truncation import cut_rates, scored
from codeweft.session import checkpoint, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n_per_group(table(spark, sf_dir, "nodes"), ["community", "kind"], "rank", "id", 5)
    return top.select("community", "kind", F.col("id").alias("node_id"))


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_origins(table(spark, sf_dir, "scans"), table(spark, sf_dir, "upstreams"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _origins(spark, sf_dir).filter(F.col("origin") != "written").select("repo", "path")


def p2_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and characters by language and origin."""
    return _origins(spark, sf_dir).groupBy("lang", "origin").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"))


def p2_deciding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand, by language and by what told them: a statistic of the layout, copied lines or a notice."""
    return _origins(spark, sf_dir).filter("origin <> 'written'").groupBy("lang", "origin", "deciding").agg(F.count(F.lit(1)).alias("n_files"))


def p2_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the origins found part by each statistic of the layout, beside the thresholds in use: they should agree."""
    return fitted_thresholds(_origins(spark, sf_dir)).withColumn("threshold", F.round("threshold", 4))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "scans")).select("repo", "path")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "scans"))


def p3_all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_errors(table(spark, sf_dir, "scans"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(table(spark, sf_dir, "scans"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest(table(spark, sf_dir, "vectors")))


def p4_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the pairs that stand in one array are verified."""
    return search_work(nearest(table(spark, sf_dir, "vectors")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents")).groupBy("same").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counting tokens is the dear part and the groups need their sum first: count once.
    return pack(checkpoint(token_counts(table(spark, sf_dir, "documents"))))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).filter("score >= 0.5").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(scored(table(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_origins": p2_origins,
    "p2_deciding": p2_deciding,
    "p2_thresholds": p2_thresholds,
    "p3_found": p3_found,
    "p3_errors": p3_errors,
    "p3_all_errors": p3_all_errors,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_work": p4_work,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}

SQL = {
    "p1_found": """
        WITH d AS (SELECT DISTINCT community, kind, id AS node_id, rank FROM nodes
                   WHERE community IS NOT NULL AND kind IS NOT NULL AND rank IS NOT NULL AND NOT isnan(rank))
        SELECT community, kind, node_id FROM d
        QUALIFY row_number() OVER (PARTITION BY community, kind ORDER BY rank DESC, node_id) <= 5""",
}
