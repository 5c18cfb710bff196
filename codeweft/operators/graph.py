"""The property graph as DataFrames: clean nodes, upserted edges and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Other spellings of a language.
SPELLINGS = {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "golang": "go"}
DEPENDS = ("calls", "imports", "inherits")


def language(c: Column) -> Column:
    """A language in its usual spelling."""
    low = F.lower(c)
    for other, usual in SPELLINGS.items():
        low = F.when(low == other, F.lit(usual)).otherwise(low)
    return low


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id (rows of an id are copies), null and NaN ranks as 0, languages in their usual spelling."""
    rank = F.when(F.col("rank").isNull() | F.isnan("rank"), 0.0).otherwise(F.col("rank"))
    return nodes.dropna(subset=["id"]).dropDuplicates(["id"]).withColumns({"rank": rank, "language": language(F.col("language"))})


def upserted_edges(edges: DataFrame) -> DataFrame:
    """src, dst, kind, weight: one edge per source, target and kind, the weight loaded last wins (equal times: the larger)."""
    known = edges.dropna(subset=["source_id", "target_id", "kind"])
    last = F.max_by("weight", F.struct("loaded_at", "weight")).alias("weight")
    return known.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "kind").agg(last)


def top_symbols(nodes: DataFrame, n: int = 15) -> DataFrame:
    """The n symbols with the highest rank, equal ranks by smaller id."""
    return clean_nodes(nodes).filter(~F.col("kind").isin("file", "module")).orderBy(F.col("rank").desc(), "id").limit(n)


def unsummarized(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The n highest-ranked nodes that still need a summary (files too, modules not)."""
    empty = F.coalesce("summary", F.lit("")) == ""
    return clean_nodes(nodes).filter(empty & (F.col("kind") != "module")).orderBy(F.col("rank").desc(), "id").limit(n)


def neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, dir, kind, weight, id: all neighbours of every seed (column ``seed``), out edges and in edges."""
    known = nodes.select("id")
    out = seeds.join(edges, F.col("seed") == F.col("src")).select("seed", F.lit("out").alias("dir"), "kind", "weight", F.col("dst").alias("id"))
    back = seeds.join(edges, F.col("seed") == F.col("dst")).select("seed", F.lit("in").alias("dir"), "kind", "weight", F.col("src").alias("id"))
    return out.unionByName(back).join(known, "id", "left_semi")


def lookup(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, id, how: the node a reference (column ``ref``) names.

    By qualified name, else by file path, else by name; the highest rank wins, then the
    smaller id.  Three equi-joins over all references at once.
    """
    n = nodes.select("id", "kind", "name", "qualified_name", "file_path", "rank")
    ways = [("qualified_name", F.lit(True)), ("file_path", F.col("kind") == "file"), ("name", F.lit(True))]
    found = None
    for prio, (column, condition) in enumerate(ways, 1):
        part = refs.join(n.filter(condition), F.col("ref") == F.col(column)).select("ref", "id", "rank", F.lit(prio).alias("how"))
        # The best of each way is an aggregate, so a name that very many nodes share is folded on the map side.
        part = part.groupBy("ref", "how").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("id"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("ref").agg(F.min_by("id", "how").alias("id"), F.min("how").alias("how"))


def contained(nodes: DataFrame) -> DataFrame:
    """parent, child: each symbol below the one whose qualified name is its own without the last part, else below its file.

    Of several nodes with one qualified name in a repository the largest id counts.
    """
    n = nodes.select("id", "repo", "kind", "qualified_name", "file_path")
    owners = n.filter("kind <> 'file'").groupBy("repo", F.col("qualified_name").alias("parent_name")).agg(F.max("id").alias("owner"))
    files = n.filter("kind = 'file'").groupBy("repo", "file_path").agg(F.max("id").alias("file_id"))
    cut = F.regexp_replace("qualified_name", r"\.[^.]*$", "")
    symbols = n.filter("kind <> 'file'").withColumn("parent_name", cut)
    joined = symbols.join(owners, ["repo", "parent_name"], "left").join(files, ["repo", "file_path"], "left")
    parent = F.coalesce(F.when(F.col("owner") != F.col("id"), F.col("owner")), F.col("file_id"))
    return joined.select(parent.alias("parent"), F.col("id").alias("child")).dropna()


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b: files joined by any edge but contains between symbols of theirs, in both directions."""
    files = nodes.filter("kind = 'file'").groupBy("repo", "file_path").agg(F.max("id").alias("file"))
    of = nodes.select("id", "repo", "file_path").join(files, ["repo", "file_path"]).select("id", "file")
    e = edges.filter("kind <> 'contains'").select("src", "dst")
    pairs = e.join(of.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").filter("a <> b").select("a", "b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def induced(nodes: DataFrame, edges: DataFrame, n: int = 500) -> tuple[DataFrame, DataFrame]:
    """The n highest-ranked nodes and the edges among them."""
    top = nodes.orderBy(F.col("rank").desc(), "id").limit(n)
    ids = top.select("id")
    inner = edges.join(ids, F.col("src") == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")
    return top, inner


def graph_json(nodes: DataFrame, edges: DataFrame, n: int = 500) -> DataFrame:
    """One line of JSON per element of the induced graph, ids and ranks as strings, as graph viewers read them."""
    top, inner = induced(nodes, edges, n)
    data = F.struct(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), "kind", F.col("file_path").alias("file"), F.col("line_start").alias("line"), F.coalesce("summary", F.lit("")).alias("summary"), F.col("rank").cast("decimal(18,6)").cast("string").alias("rank"))
    a = top.select(F.lit("node").alias("element"), F.to_json(F.struct(data.alias("data")), {"ignoreNullFields": "false"}).alias("json"))
    b = inner.select(F.lit("edge").alias("element"), F.to_json(F.struct(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "kind").alias("data"))).alias("json"))
    return a.unionByName(b)


def graph_document(nodes: DataFrame, edges: DataFrame, n: int = 500) -> DataFrame:
    """json: the same as one document with the lists ``nodes`` and ``edges``; the graph of n nodes bounds it."""
    rows = graph_json(nodes, edges, n)
    part = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("element") == k, F.col("json")))), ",")
    return rows.agg(F.concat(F.lit('{"nodes":['), part("node"), F.lit('],"edges":['), part("edge"), F.lit("]}")).alias("json"))


def is_test(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.element_at(F.split(low, "/"), -1).contains("test") | F.concat(F.lit("/"), low).contains("/tests/")


def impact(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """seed, id, depth, is_test: what depends on each seed, by the least number of incoming calls, imports and inherits.

    All seeds go level by level together.  A level is an equi-join of the frontier with the
    edges, folded to distinct nodes, less those seen before, so a node with a third of all
    callers is one join key of the edge side and spreads by AQE's skew join.
    """
    e = edges.filter(F.col("kind").isin(*DEPENDS)).select("src", "dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(e, F.col("id") == F.col("dst")).select("seed", F.col("src").alias("id")).distinct()
        frontier = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    hit = seen.filter("depth > 0")
    return hit.join(nodes.select("id", "file_path"), "id").select("seed", "id", "depth", is_test(F.col("file_path")).alias("is_test"))


def cochanged(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """seed, weight, file_path, place: files that change together with the file of each seed, the n strongest."""
    files = nodes.filter("kind = 'file'").groupBy("repo", "file_path").agg(F.max("id").alias("file"))
    own = seeds.join(nodes.select(F.col("id").alias("seed"), "repo", "file_path"), "seed").join(files, ["repo", "file_path"]).select("seed", "file")
    e = edges.filter("kind = 'co_changes'").select("src", "dst", "weight")
    both = e.select(F.col("src").alias("file"), F.col("dst").alias("id"), "weight").unionByName(e.select(F.col("dst").alias("file"), F.col("src").alias("id"), "weight"))
    hit = own.join(both, "file").join(nodes.select("id", "file_path"), "id")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("weight").desc(), F.col("file_path").desc(), "id"))
    return hit.select("seed", "weight", "file_path", place.alias("place")).filter(F.col("place") <= n)
