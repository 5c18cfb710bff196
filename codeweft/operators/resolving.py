"""Names to edges, and pairs that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def _suffixes(c: Column) -> Column:
    """The dotted suffixes of a name, itself first: a.b.c, b.c, c."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def _ends(c: Column) -> Column:
    """The ends of a name, letter by letter, that hold its last part whole."""
    return F.transform(F.sequence(F.lit(1), F.length(c) - F.length(_last(c)) + 1), lambda k: F.substring(c, k, F.length(c)))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind: the edges that references resolve to, within the repository of their source.

    In order: the node with that qualified name (largest id); the only node of the name
    whose qualified name ends in it; the only node of the name, for targets without a dot;
    for imports a module file by its dotted path (smallest id).  A qualified name is
    exploded into its dotted suffixes, of which only those that a reference asks for are
    counted, so every way is an equi-join on the whole target: linear in names, whatever
    last part very many of them share.  Edges from a node to itself are dropped.
    """
    n = nodes.select("id", "repo", "kind", "name", "qualified_name")
    r = refs.filter(F.col("target_name").isNotNull() & (F.col("target_name") != "")).distinct()
    r = r.join(n.select(F.col("id").alias("source_id"), "repo"), "source_id")
    want = r.select("repo", "target_name").distinct().withColumns({"last": _last(F.col("target_name")), "dotted": F.translate("target_name", "/", ".")})

    exact = n.groupBy("repo", F.col("qualified_name").alias("target_name")).agg(F.max("id").alias("exact"))
    alone = n.groupBy("repo", F.col("name").alias("last")).agg(F.count(F.lit(1)).alias("named"), F.max("id").alias("only"))
    # A name that ends in a target is longer than it and has its last part as name.
    longer = n.filter(F.col("name") == _last(F.col("qualified_name"))).select("repo", "id", F.explode(F.slice(_suffixes(F.col("qualified_name")), 2, 1_000_000)).alias("target_name"))
    ends = longer.groupBy("repo", "target_name").agg(F.count(F.lit(1)).alias("ends"), F.max("id").alias("ending"))

    module = F.translate(F.regexp_replace("qualified_name", r"\.[^.]*$", ""), "/", ".")
    files = n.filter("kind = 'file'").select("repo", "id", module.alias("mq"))
    # A module is meant by any dotted suffix of its path, and by a target that ends in its whole path.
    by_path = files.select("repo", "id", F.explode(_suffixes(F.col("mq"))).alias("dotted")).groupBy("repo", "dotted").agg(F.min("id").alias("m1"))
    whole = files.groupBy("repo", F.col("mq").alias("end")).agg(F.min("id").alias("id"))
    by_end = want.select("repo", "dotted").distinct().withColumn("end", F.explode(_ends(F.col("dotted")))).join(whole, ["repo", "end"]).groupBy("repo", "dotted").agg(F.min("id").alias("m2"))

    found = want.join(exact, ["repo", "target_name"], "left").join(ends, ["repo", "target_name"], "left").join(alone, ["repo", "last"], "left").join(by_path, ["repo", "dotted"], "left").join(by_end, ["repo", "dotted"], "left")
    symbol = F.coalesce("exact", F.when(F.col("ends") == 1, F.col("ending")), F.when((F.col("named") == 1) & ~F.col("target_name").contains("."), F.col("only")))
    found = found.select("repo", "target_name", symbol.alias("symbol"), F.least("m1", "m2").alias("module"))
    joined = r.join(found, ["repo", "target_name"])
    dst = F.coalesce("symbol", F.when(F.col("kind") == "imports", F.col("module")))
    return joined.select(F.col("source_id").alias("src"), dst.alias("dst"), "kind").filter("dst IS NOT NULL AND dst <> src").distinct()


def few_items(commits: DataFrame, most: int) -> DataFrame:
    """sha, item of the commits (sha, item) with two to ``most`` distinct items.

    Counted before anything is gathered, so a commit with very many items is never in one
    place: its rows are spread by item when they are made distinct.
    """
    rows = commits.select("sha", "item").dropna().distinct()
    sizes = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most))
    return rows.join(sizes.select("sha"), "sha", "left_semi")


def frequent_pairs(commits: DataFrame, support: int = 3, most: int = 50, exclude: DataFrame | None = None) -> DataFrame:
    """a, b, n, weight: pairs of items (columns sha, item) in ``support`` commits or more, weight relative to the most frequent.

    Commits of ``exclude`` (column sha) don't count, as those a search is tested with.
    Commits with one item or more than ``most`` are left out first, so a commit gives
    most * (most - 1) / 2 pairs at most; pairs are made inside their commit's row, without
    a self-join, and counted on the map side.  The highest count is a scalar subquery over
    the counted pairs, so nothing runs before the result is asked for.
    """
    commits = commits if exclude is None else commits.join(exclude.select("sha"), "sha", "left_anti")
    sets = few_items(commits, most).groupBy("sha").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = sets.select(F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.expr("items"), lambda y: F.when(x < y, F.struct(x.alias("a"), y.alias("b"))))))).alias("p")).filter("p IS NOT NULL")
    counted = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    return counted.withColumn("weight", F.col("n") / counted.agg(F.max("n")).scalar())


def cochange_edges(commits: DataFrame, nodes: DataFrame, support: int = 3, most: int = 50, exclude: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, weight: ``co_changes`` edges between the file nodes of paths (commits: repo, sha, path) that change together.

    Paths that aren't indexed as a file drop out after the pairs are counted, as the weight
    is relative to the most frequent pair of all; of several nodes of one file the largest
    id counts, and the smaller id of a pair is the source.
    """
    items = commits.select(F.struct("repo", "sha").alias("sha"), F.struct("repo", "path").alias("item"))
    gone = None if exclude is None else exclude.select(F.struct("repo", "sha").alias("sha"))
    pairs = frequent_pairs(items, support, most, gone)
    files = nodes.filter("kind = 'file'").groupBy(F.struct("repo", F.col("file_path").alias("path")).alias("item")).agg(F.max("id").alias("file"))
    both = pairs.join(files.select(F.col("item").alias("a"), F.col("file").alias("x")), "a").join(files.select(F.col("item").alias("b"), F.col("file").alias("y")), "b")
    return both.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), F.lit("co_changes").alias("kind"), "weight")
