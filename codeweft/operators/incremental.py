"""Keeping a graph up to date: what changed, what goes, what is carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """repo, path, hash, last_indexed: the last entry of each file (null times are oldest)."""
    last = F.max(F.struct("last_indexed", F.col("content_hash").alias("hash"))).alias("m")
    return files.dropna(subset=["repo", "path"]).groupBy("repo", "path").agg(last).select("repo", "path", "m.hash", "m.last_indexed")


def freshness(current: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path, state of every file that is there or was indexed.

    ``new``: not indexed; ``unchanged``: not modified since; ``touched``: modified, same
    hash; ``changed``: modified, other hash; ``vanished``: indexed, but gone.  Unknown times
    count as modified.
    """
    both = current.select("repo", "path", "modification_time", F.col("hash").alias("now")).join(known, ["repo", "path"], "full")
    state = (
        F.when(F.col("modification_time").isNull() & F.col("now").isNull() & (F.col("hash").isNotNull() | F.col("last_indexed").isNotNull()), "vanished")
        .when(F.col("hash").isNull() & F.col("last_indexed").isNull(), "new")
        .when(F.col("modification_time") <= F.col("last_indexed"), "unchanged")
        .when(F.col("now").eqNullSafe(F.col("hash")), "touched")
        .otherwise("changed")
    )
    return both.select("repo", "path", state.alias("state"))


def cleared(changed: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame, vectors: DataFrame, files: DataFrame | None = None, usage: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without what belongs to changed files (repo, path): nodes, edges at either end, references, vectors, usage and the manifest."""
    gone = nodes.join(changed.select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_semi").select("id").distinct()
    more = {} if files is None else {"files": files.join(changed.select("repo", "path"), ["repo", "path"], "left_anti")}
    more |= {} if usage is None else {"usage": usage.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti")}
    return more | {
        "nodes": nodes.join(gone, "id", "left_anti"),
        "edges": edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"),
        "refs": refs.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti"),
        "vectors": vectors.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti"),
    }


def merged(known: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """News in place of known rows with the same keys, all others as they are."""
    return known.join(news.select(*keys), keys, "left_anti").unionByName(news)


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (repo, file_path, qualified_name, snippet_hash) with the summary of the old symbol of that name in that file, if its snippet is the same.

    Of several old symbols of one name and snippet the greatest summary counts, so the
    result is always the same; null hashes equal nothing.
    """
    keys = ["repo", "file_path", "qualified_name", "snippet_hash"]
    before = old.filter("summary <> '' AND snippet_hash IS NOT NULL").groupBy(*keys).agg(F.max("summary").alias("__s"))
    return new.drop("summary").join(before, keys, "left").withColumn("summary", F.coalesce("__s", F.lit(""))).drop("__s")
