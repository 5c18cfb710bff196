"""From changed lines to the symbols they touch, and from symbols to their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.operators.graph import is_test
from codeweft.operators.retrieval import within_budget

_LINE = re.compile(rb"[^\n]*\n|[^\n]+")


def _alignment(a: list, b: list, store: int = 1 << 28) -> Iterator[tuple[int, int]]:
    """Index pairs of a longest common subsequence, each match as early as it can be.

    Bit i of a row says whether one more item of ``a`` lengthens it (Hyyro's bit vectors,
    one row for each item of ``b``, from the end).  Above ``store`` bits the rows aren't
    kept: ``b`` is halved and the best place to halve ``a`` found first (Hirschberg).
    """
    m, n = len(a), len(b)
    if not m or not n:
        return

    def rows(x: list, y: list) -> Iterator[int]:
        mask, where = (1 << len(x)) - 1, {}
        for i, v in enumerate(x):
            where[v] = where.get(v, 0) | 1 << i
        row = mask
        yield row
        for v in y:
            u = row & where.get(v, 0)
            row = ((row + u) | (row - u)) & mask
            yield row

    if m * n > store and n > 1:
        half = n // 2

        def lengths(x: list, y: list) -> list[int]:
            for last in rows(x, y):
                pass
            return [0, *accumulate(c == "0" for c in reversed(f"{last:0{m}b}"))]

        front, back = lengths(a, b[:half]), lengths(a[::-1], b[half:][::-1])
        cut = max(range(m + 1), key=lambda i: front[i] + back[m - i])
        yield from _alignment(a[:cut], b[:half], store)
        yield from ((i + cut, j + half) for i, j in _alignment(a[cut:], b[half:], store))
        return
    kept, i, j = list(rows(a[::-1], b[::-1])), 0, 0
    while i < m and j < n:
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif kept[n - j] >> (m - i - 1) & 1:  # nothing is lost without a[i]
            i += 1
        else:
            j += 1


def changed_ranges(old: bytes, new: bytes) -> list[tuple[int, int]]:
    """(first, last) of each run of lines of ``new`` that differ from ``old``, numbered from 1, as few lines as possible.

    Where lines were only taken away, both are the line before them (0 at the top), as in
    the hunks of ``git diff --unified=0``.
    """
    a, b = _LINE.findall(old), _LINE.findall(new)
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = next((k for k in range(short - head) if a[-1 - k] != b[-1 - k]), short - head)
    ia, ib = range(head, len(a) - tail), range(head, len(b) - tail)
    both = {a[i] for i in ia} & {b[j] for j in ib}
    ia, ib = [i for i in ia if a[i] in both], [j for j in ib if b[j] in both]
    same = [(ia[i], ib[j]) for i, j in _alignment([a[i] for i in ia], [b[j] for j in ib])]
    out, i0, j0 = [], head, head
    for i, j in [*same, (len(a) - tail, len(b) - tail)]:
        if j > j0:
            out.append((j0 + 1, j))
        elif i > i0:
            out.append((j0, j0))
        i0, j0 = i + 1, j + 1
    return out


def version_hunks(scans: DataFrame) -> DataFrame:
    """repo, path, first, last: each range of lines of the current version that differs from the version before.

    Of each file the two latest versions count, found by their times only; their lines are
    then compared inside Arrow batches (see ``changed_ranges``).  Files without an older
    version or without a difference give none.
    """
    keys = ["repo", "path"]
    stamps = scans.filter("content IS NOT NULL").groupBy(*keys, "modification_time").agg(F.max(F.xxhash64("content")).alias("tie"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("modification_time").desc_nulls_last()))
    two = stamps.withColumn("k", place).filter("k <= 2").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("n = 2")
    texts = scans.withColumn("tie", F.xxhash64("content")).join(two, [*keys, "modification_time", "tie"]).select(*keys, "k", "content")
    pair = texts.groupBy(*keys).agg(F.max(F.when(F.col("k") == 1, F.col("content"))).alias("new"), F.max(F.when(F.col("k") == 2, F.col("content"))).alias("old"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r.as_py(), p.as_py(), *x) for r, p, new, old in zip(*b.columns) for x in changed_ranges(old.as_py(), new.as_py())]
            columns = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))], [*keys, "first", "last"])

    return pair.filter("new <> old").select(*keys, "new", "old").mapInArrow(run, "repo string, path string, first int, last int")


def touched(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The symbols (not files) whose lines overlap a hunk (repo, path, first, last) of their file, each once."""
    spans = nodes.filter("kind <> 'file' AND line_start IS NOT NULL AND line_end IS NOT NULL")
    h = hunks.select(F.col("repo").alias("__r"), F.col("path").alias("__p"), "first", "last")
    overlap = (F.col("repo") == F.col("__r")) & (F.col("file_path") == F.col("__p")) & (F.col("line_start") <= F.col("last")) & (F.col("first") <= F.col("line_end"))
    return spans.join(h, overlap, "left_semi")


def diff_context(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, users: int = 5, tests: int = 3) -> DataFrame:
    """symbol, role, place, id: each touched symbol with its highest-ranked direct users and tests."""
    sym = touched(hunks, nodes).select(F.col("id").alias("symbol"))
    dep = edges.filter(F.col("kind").isin("calls", "imports", "inherits")).select(F.col("dst").alias("symbol"), F.col("src").alias("id")).distinct()
    near = sym.join(dep, "symbol").filter("id <> symbol").join(nodes.select("id", "file_path", "rank"), "id")
    near = near.withColumn("role", F.when(is_test(F.col("file_path")), "test").otherwise("user"))
    place = F.row_number().over(Window.partitionBy("symbol", "role").orderBy(F.col("rank").desc(), "id"))
    kept = near.withColumn("place", place).filter(((F.col("role") == "user") & (F.col("place") <= users)) | ((F.col("role") == "test") & (F.col("place") <= tests)))
    own = sym.select("symbol", F.lit("symbol").alias("role"), F.lit(0).alias("place"), F.col("symbol").alias("id"))
    return own.unionByName(kept.select("symbol", "role", "place", "id"))


def diff_text(context: DataFrame, hunks: DataFrame, nodes: DataFrame, budget: int = 8000) -> DataFrame:
    """pos, line: what a change touches, file by file, as many lines as fit the budget.

    context: the rows of ``diff_context``; hunks: repo, path, first, last.  Each file has a
    line with its number of ranges, then its touched symbols with their users and tests; a
    file in which no symbol is touched says so.  The first ``budget`` lines in order are
    all that can count, and a top-k cuts to them before the running sum.
    """
    n = nodes.select("id", "repo", "file_path", "kind", "qualified_name", "line_start", "summary", "signature")
    own = n.select(F.col("id").alias("symbol"), F.col("repo").alias("r"), F.col("file_path").alias("p"), F.col("line_start").alias("l"))
    role = F.when(F.col("role") == "symbol", "- ").when(F.col("role") == "user", "    used by ").otherwise("    tested by ")
    order = F.when(F.col("role") == "symbol", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = context.join(own, "symbol").join(n, "id").select(F.struct("r", "p", F.coalesce("l", F.lit(0)).alias("l"), "symbol", order.alias("o"), "place").alias("pos"), fn.node_line(role).alias("line"))
    files = hunks.groupBy(F.col("repo").alias("r"), F.col("path").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    known = context.join(own, "symbol").select("r", "p").distinct().withColumn("known", F.lit(True))
    said = F.concat(F.lit("## "), "p", F.lit(": "), F.col("n"), F.lit(" ranges"), F.when(F.col("known").isNull(), ", no symbol touched").otherwise(""))
    heads = files.join(known, ["r", "p"], "left").select(F.struct("r", "p", F.lit(-1).alias("l"), F.lit(0).cast("long").alias("symbol"), F.lit(0).alias("o"), F.lit(0).alias("place")).alias("pos"), said.alias("line"))
    first = rows.unionByName(heads).orderBy("pos").limit(budget).withColumn("one", F.lit(1))
    return within_budget(first, ["one"], "pos", budget).select("pos", "line")


def snippets(symbols: DataFrame, scans: DataFrame, around: int = 2, most: int | None = None, budget: int = 6000) -> DataFrame:
    """id, n, line: the numbered source lines of symbols, some lines around them, as many as fit the budget.

    Only contents of files with a symbol asked for are kept, by a semi join on the small
    side; the version is the current one.
    """
    keys = ["repo", "path"]
    want = symbols.select("id", "repo", F.col("file_path").alias("path"), "line_start", "line_end").filter("line_start IS NOT NULL AND line_end IS NOT NULL")
    mine = scans.join(want.select(*keys).distinct(), keys, "left_semi").filter("content IS NOT NULL")
    text = mine.groupBy(*keys).agg(F.max_by("content", F.struct("modification_time", F.xxhash64("content"))).alias("content"))
    lines = text.select(*keys, F.split(F.decode("content", "UTF-8"), "\n").alias("lines"))
    start = F.greatest(F.col("line_start") - around, F.lit(1))
    length = F.col("line_end") + around - start + 1
    length = length if most is None else F.least(length, F.lit(most))
    cut = want.join(lines, keys).select("id", start.alias("start"), F.posexplode(F.slice("lines", start, F.greatest(length, F.lit(0)))).alias("k", "text"))
    numbered = cut.select("id", (F.col("start") + F.col("k")).alias("n"), F.concat(F.lpad((F.col("start") + F.col("k")).cast("string"), 5, " "), F.lit("| "), "text").alias("line"))
    return within_budget(numbered, ["id"], "n", budget - 40)
