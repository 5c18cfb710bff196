"""Problem 3: source files that do not parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.syntax import PARSERS, errors
from codeweft.llm.versions import current

LANGUAGES = ("python", *PARSERS)
#: Calls that may nest while a file is judged; they lie on the heap, a few hundred bytes each.
FRAMES = 1_000_000
_FACTS = "repo string, path string, modification_time timestamp_ntz, tie long, lang string, errors array<struct<line:int,cause:string>>"
_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))
_COOKIE = re.compile(rb"\A(?:[^\n]*\n)?[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")


def text_of(lang: str, content: bytes) -> str | None:
    """The text of a file, None if its language doesn't allow such bytes."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        if lang == "c":
            return content.decode("latin-1")
        if lang != "python":
            return content.decode("utf-8", "replace")
        cookie = _COOKIE.match(content)
        try:
            return content.decode(cookie[1].decode()) if cookie else None
        except (LookupError, UnicodeDecodeError):
            return None


def syntax_errors(lang: str | None, content: bytes | None) -> list[dict] | None:
    """All errors of one file; None where there is nothing to judge (no content, or a language without grammar)."""
    if content is None or lang not in LANGUAGES:
        return None
    text = text_of(lang, content)
    if text is None:
        return [{"line": 1, "cause": "bytes that are no text"}]
    try:
        return [{"line": line, "cause": cause} for line, cause in errors(lang, text)]
    except RecursionError:
        return [{"line": 1, "cause": "nested too deeply"}]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    for b in batches:
        found = [syntax_errors(lang, content.as_py()) for lang, content in zip(b.column("lang").to_pylist(), b.column("content"))]
        keep = [b.column(c) for c in ("repo", "path", "modification_time", "tie", "lang")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found, _ARROW)], ["repo", "path", "modification_time", "tie", "lang", "errors"])


def parsed_files(scans: DataFrame) -> DataFrame:
    """One row per file of scans with a language: repo, path, lang and all errors of its current version.

    Each version is parsed where it is read: recursive-descent statements, expressions by
    precedence climbing, panic-mode recovery to the end of the statement, so ``errors``
    holds every error by line and its first item is the first cause.  Only these facts are
    shuffled to find the current version, never contents.

    ``errors`` is null for null content and for a language without grammar, empty for a
    valid file (empty and comment-only files are valid).  A byte-order mark, CRLF and, in
    C, Latin-1 bytes are valid; bytes that aren't UTF-8 make a Python file without coding
    line invalid and count in other languages where they stand outside strings and
    comments.  Nesting counts only where a language limits it (Python: 200 brackets); a
    file that takes more than FRAMES nested calls, about 100,000 brackets in each other,
    is beyond any compiler and counts as invalid.  Repeated rows count once; null repo or
    path: left out.  Other columns are never read.
    """
    rows = scans.filter(F.col("lang").isNotNull()).select("repo", "path", F.col("modification_time").cast("timestamp_ntz").alias("modification_time"), F.xxhash64("content").alias("tie"), "lang", "content")
    return current(rows.mapInArrow(_parse, _FACTS), ["repo", "path"], "modification_time", "tie").drop("modification_time")


def invalid_files(scans: DataFrame) -> DataFrame:
    """repo, path, lang, number of errors and the first cause of every file that does not parse."""
    bad = parsed_files(scans).filter(F.size("errors") > 0)
    first = F.col("errors")[0]
    return bad.select("repo", "path", "lang", F.size("errors").alias("n_errors"), first["line"].alias("line"), first["cause"].alias("cause"))


def all_errors(scans: DataFrame) -> DataFrame:
    """repo, path, lang, place, line, cause: every error of every file that does not parse, the first cause at place 0."""
    return parsed_files(scans).select("repo", "path", "lang", F.posexplode("errors").alias("place", "e")).select("repo", "path", "lang", "place", "e.line", "e.cause")


def parse_rates(scans: DataFrame) -> DataFrame:
    """Files judged, invalid files and their share per repository and language, with the totals of each language (repo null)."""
    judged = parsed_files(scans).filter(F.col("errors").isNotNull())
    sums = judged.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.size("errors") > 0, 1)).alias("n_invalid"))
    total = sums.groupBy("lang").agg(F.sum("n_files").alias("n_files"), F.sum("n_invalid").alias("n_invalid")).select(F.lit(None).cast("string").alias("repo"), "lang", "n_files", "n_invalid")
    return sums.unionByName(total).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
