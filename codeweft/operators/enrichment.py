"""Vectors and summaries made outside: what is missing goes out, what comes back is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.operators.incremental import merged
from codeweft.session import shared_folder, written


def embed_missing(nodes: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """vectors (node_id, vec, text_hash) with one for every node that has none or whose text has changed.

    ``embed`` turns a batch of texts into vectors where the nodes are; a node's text is its
    name, qualified name, signature and summary.
    """
    text = fn.node_text("name", "qualified_name", "signature", "summary")
    want = nodes.select(F.col("id").alias("node_id"), text.alias("text"), F.md5(text).alias("text_hash"))
    want = want.join(vectors.select("node_id", "text_hash"), ["node_id", "text_hash"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"node_id": b["node_id"], "vec": embed(b["text"].tolist()), "text_hash": b["text_hash"]})

    return merged(vectors.select("node_id", "vec", "text_hash"), want.mapInPandas(run, "node_id long, vec array<float>, text_hash string"), ["node_id"])


def summarize(items: DataFrame, write: Callable[[list[str]], list[str]]) -> DataFrame:
    """id, summary of work items (id, text) by a callable that is given batches of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "summary": write(b["text"].tolist())})

    return items.select("id", "text").mapInPandas(run, "id long, summary string")


def store_summaries(nodes: DataFrame, offered: DataFrame, order: str | None = None) -> DataFrame:
    """nodes with the summary offered last (id, summary and the column ``order``, else the order of rows), cleaned; empty ones and unknown ids are refused."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    good = offered.filter("id IS NOT NULL").select("id", fn.clean_summary(F.col("summary")).alias("__new"), place.alias("__place")).filter("__new IS NOT NULL")
    last = good.groupBy("id").agg(F.max_by("__new", F.struct("__place", "__new")).alias("__new"))
    return nodes.join(last, "id", "left").withColumn("summary", F.coalesce("__new", "summary")).drop("__new")


def remaining(nodes: DataFrame) -> DataFrame:
    """language, kind, n_nodes, n_left: nodes and those without a summary (modules aside), what an enrichment still has to do."""
    rows = nodes.filter("kind <> 'module'")
    return rows.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.coalesce("summary", F.lit("")) == "", 1)).alias("n_left"))


def with_snippets(nodes: DataFrame, snippets: DataFrame) -> DataFrame:
    """nodes with snippet_hash, the hash of their source lines (id, n, line): what tells later whether a summary still holds."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    return nodes.drop("snippet_hash").join(snippets.groupBy("id").agg(F.sha2(text, 256).alias("snippet_hash")), "id", "left")


def enriched(nodes: DataFrame, batch: Callable[[DataFrame], DataFrame], write: Callable[[list[str]], list[str]], rounds: int = 10) -> tuple[DataFrame, int]:
    """nodes with summaries, batch by batch, and how many still lack one.

    ``batch`` gives the next work items (id, text) of the nodes as they are, ``write`` the
    summaries of a list of texts.  Each round is stored in the shared folder.  It ends when
    nothing is left, after ``rounds``, or when a round stores nothing new.
    """
    root = shared_folder(nodes.sparkSession, "enriched")
    left = nodes.filter((F.coalesce("summary", F.lit("")) == "") & (F.col("kind") != "module")).count()
    for k in range(rounds):
        if not left:
            break
        nodes = written(store_summaries(nodes, summarize(batch(nodes), write)), f"{root}/round-{k}")
        before, left = left, nodes.filter((F.coalesce("summary", F.lit("")) == "") & (F.col("kind") != "module")).count()
        if left == before:
            break
    return nodes, left


def matching(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes with the text in their name or summary, whatever its case."""
    low = text.lower()
    return nodes.filter(F.lower("name").contains(low) | F.lower(F.coalesce("summary", F.lit(""))).contains(low))


#: How words begin that speak of a fix.
FIXING = ["fix", "bug", "crash", "error", "fail", "regress", "broken", "incorrect", "wrong", "issue", "resolve"]


def bare_subject(subject: Column) -> Column:
    """A commit subject without its issue numbers."""
    return F.trim(F.regexp_replace(subject, r"\(?#\d+\)?", ""))


def is_fix(subject: Column) -> Column:
    """Whether a commit subject, less its issue numbers, has three words or more and one that begins like those that speak of a fix."""
    bare = bare_subject(subject)
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    return (words >= 3) & bare.rlike(rf"(?i)\b(?:{'|'.join(FIXING)})")


def fix_commits(commits: DataFrame, code_file: Callable[[Column], Column], current: DataFrame, most_code: int = 5, most: int = 10) -> DataFrame:
    """sha, subject, path: the code files of commits that fix something and touch few files, as far as they still exist."""
    few = commits.filter(is_fix(F.col("subject")) & (F.size("files") <= most))
    few = few.withColumn("code", F.filter("files", code_file)).filter(F.size("code").between(1, most_code))
    return few.select("sha", bare_subject(F.col("subject")).alias("subject"), F.explode("code").alias("path")).join(current.select("path").distinct(), "path", "left_semi").select("sha", "subject", "path")


def run_summary(runs: DataFrame) -> DataFrame:
    """Per arm of recorded runs (arm, first_hit from 1, tokens, turns, cost_usd, error): hit rates, MRR and means, failed runs left out."""
    ok = runs.filter("error IS NULL")
    share = lambda k: F.round(F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)), 3)
    return ok.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), share(5).alias("hit5"), share(10).alias("hit10"), F.round(F.avg(F.coalesce(F.try_divide(F.lit(1.0), "first_hit"), F.lit(0.0))), 3).alias("mrr"),
        F.round(F.avg("tokens"), 1).alias("tokens"), F.round(F.avg("turns"), 1).alias("turns"), F.round(F.avg("cost_usd"), 4).alias("cost_usd"),
    )
