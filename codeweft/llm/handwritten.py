"""Problem 2: generated, minified or vendored files and data saved as code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.versions import current

#: Thresholds by language, fitted by ``fitted_thresholds`` on the 5,533 files of the sf0.1 tables (the origins were
#: settled by another rule before: names that count up, upstream lines, release notices), and rounded; "" holds for
#: every language that isn't named.  number_lines: share of lines with a number, digits: share of digits (generated);
#: space, mean_line, max_line: white-space share at most, line lengths at least (minified); literal: share of the text
#: in numeric literals, run and alnum: share in long encoded runs and of letters and digits (data).
THRESHOLDS = {
    "": {"number_lines": 0.58, "digits": 0.035, "space": 0.06, "mean_line": 200.0, "max_line": 500.0, "literal": 0.4, "run": 0.3, "alnum": 0.8},
    "python": {"number_lines": 0.66, "digits": 0.03},
    "javascript": {"number_lines": 0.54, "digits": 0.027, "space": 0.065},
    "typescript": {"number_lines": 0.53, "digits": 0.026},
    "java": {"number_lines": 0.48, "digits": 0.022},
    "go": {"number_lines": 0.48, "digits": 0.035},
    "c": {"number_lines": 0.61, "digits": 0.035},
    "rust": {"number_lines": 0.62, "digits": 0.055},
}
#: Which origin a statistic speaks for, and whether it does so from the threshold up (1) or down (-1).
STATISTICS = {
    "number_lines": ("generated", 1), "digits": ("generated", 1), "space": ("minified", -1), "mean_line": ("minified", 1), "max_line": ("minified", 1),
    "literal": ("data", 1), "run": ("data", 1), "alnum": ("data", 1),
}
#: A copy shares this part of its telling lines with one upstream file, and this many lines.
COPY_SHARE, COPY_LINES, TELLING = 0.5, 6, 20
#: Distinct upstream lines that are broadcast at most; beyond, the join shuffles.
BROADCAST_LINES = 500_000

# How releases of third-party files name themselves in their first comment.
_RELEASE = re.compile(r"\b(?:release|version:?|v)\s*\d+\.\d+", re.I)
_RIGHTS = re.compile(r"licen[cs]e\b|spdx|released under|\(c\)|copyright|permission is granted|upstream:", re.I)
_HEAD = re.compile(r"\A\s*(?:(?:#|//)[^\n]*\n\s*|/\*.*?\*/\s*)+", re.S)
_LITERAL = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[\s,;]*")
_RUN = re.compile(rb"[A-Za-z0-9+/=_-]{40,}")

_STATS = "n_chars long, n_lines int, max_line double, mean_line double, space double, alnum double, digits double, number_lines double, literal double, run double, notice boolean"
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[48:58] = 3


def layout(content: bytes) -> tuple:
    """The layout statistics of one file, in the order of _STATS; lines are those that aren't blank."""
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    raw = np.frombuffer(content, dtype=np.uint8)
    n = max(1, len(raw))
    kind = _CLASS[raw]
    other, space, letters, digits = np.bincount(kind, minlength=4).tolist()
    bounds = np.concatenate(([0], np.flatnonzero(raw == 10) + 1, [len(raw)]))
    visible = np.concatenate(([0], np.cumsum(kind != 1)))[bounds]
    lines = np.diff(visible) > 0
    with_number = np.diff(np.concatenate(([0], np.cumsum(kind == 3)))[bounds]) > 0
    n_lines = int(lines.sum())
    head = _HEAD.match(text)
    head_text = head[0] if head else ""
    literal = sum(map(len, _LITERAL.findall(text))) / n if digits > 0.1 * n else 0.0
    runs = sum(map(len, _RUN.findall(content))) / n
    return (
        len(text), n_lines, float(np.diff(bounds).max(initial=0)), len(raw) / max(1, n_lines), space / n, (letters + digits) / n, digits / n,
        int(with_number.sum()) / max(1, n_lines), literal, runs, bool(_RELEASE.search(head_text) and _RIGHTS.search(head_text)),
    )


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _STATS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in _STATS.split(", ")]
    keep = ["repo", "path", "modification_time", "tie", "lang"]
    for b in batches:
        rows = [None if c is None else layout(c) for c in b.column("content").to_pylist()]
        stats = [pa.array([None if r is None else r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *stats], [*keep, *names])


def _versions(scans: DataFrame) -> DataFrame:
    stamp = F.col("modification_time").cast("timestamp_ntz").alias("modification_time")
    return scans.filter(F.col("lang").isNotNull()).select("repo", "path", stamp, F.xxhash64("content").alias("tie"), "lang", "content")


def _telling(content: Column) -> Column:
    """The distinct lines of a text that are long enough to tell something, trimmed, as hashes."""
    lines = F.transform(F.split(F.regexp_replace(content.cast("string"), r"\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\t+", "")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= TELLING), lambda x: F.xxhash64(x)))


def file_layouts(scans: DataFrame) -> DataFrame:
    """One row per file of scans with a language: repo, path, lang and the layout of its current version.

    Each version is measured where it is read, and only the measures are shuffled.  Null
    content: null measures; empty content: zeros.
    """
    facts = _versions(scans).mapInArrow(_layouts, f"repo string, path string, modification_time timestamp_ntz, tie long, lang string, {_STATS}")
    return current(facts.withColumn("version", F.col("tie")), ["repo", "path"], "modification_time", "tie").drop("modification_time")


def copied_shares(scans: DataFrame, upstreams: DataFrame) -> DataFrame:
    """repo, path, version, upstream_id, n_same, copied: the upstream file of which a version copies COPY_SHARE of its telling lines or more.

    Equi-joins of line hashes, so nothing is compared pairwise.  The first join only counts
    the lines of a version that any upstream file has, so a line that very many upstream
    files have (a licence) counts once; only versions whose count could be enough meet the
    single upstream files.  The lines of all upstream files are broadcast up to
    BROADCAST_LINES; beyond, the joins shuffle.
    """
    known = upstreams.filter(F.col("content").isNotNull()).select("upstream_id", F.explode(_telling(F.col("content"))).alias("h")).distinct()
    small = known.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    sent = F.broadcast if small else lambda df: df
    version = ["repo", "path", "version", "n"]
    lines = _versions(scans).select("repo", "path", F.col("tie").alias("version"), _telling(F.col("content")).alias("hs"))
    lines = lines.select("repo", "path", "version", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    found = lines.join(sent(known.select("h").distinct()), "h", "left_semi").groupBy(*version).agg(F.collect_set("h").alias("hs"))
    enough = lambda c: (c >= COPY_LINES) & (c >= F.lit(COPY_SHARE) * F.col("n"))
    same = found.filter(enough(F.size("hs"))).select(*version, F.explode("hs").alias("h")).join(sent(known), "h").groupBy(*version, "upstream_id").agg(F.count(F.lit(1)).alias("n_same"))
    best = same.filter(enough(F.col("n_same"))).groupBy("repo", "path", "version").agg(F.max(F.struct(F.col("n_same"), (-F.col("upstream_id")).alias("u"), "n")).alias("b"))
    return best.select("repo", "path", "version", (-F.col("b.u")).alias("upstream_id"), F.col("b.n_same").alias("n_same"), (F.col("b.n_same") / F.col("b.n")).alias("copied"))


def _threshold(name: str, thresholds: dict) -> Column:
    chosen = F.lit(thresholds[""][name])
    for lang, own in thresholds.items():
        if lang and name in own:
            chosen = F.when(F.col("lang") == lang, F.lit(own[name])).otherwise(chosen)
    return chosen


def layout_origin(thresholds: dict = THRESHOLDS) -> tuple[Column, Column]:
    """What the layout of a file (see ``file_layouts``) says about its origin, and the statistic that decides; null for nothing."""

    def beyond(*names: str) -> Column:
        out = F.lit(True)
        for name in names:
            t = _threshold(name, thresholds)
            out = out & (F.col(name) >= t if STATISTICS[name][1] > 0 else F.col(name) <= t)
        return out

    rules = [("data", "literal", ["literal"]), ("data", "run", ["run", "alnum"]), ("minified", "mean_line", ["space", "mean_line", "max_line"]), ("generated", "number_lines", ["number_lines", "digits"])]
    origin = statistic = F.lit(None).cast("string")
    for kind, deciding, names in reversed(rules):
        holds = beyond(*names) & (F.col("n_lines") > 0)
        origin, statistic = F.when(holds, kind).otherwise(origin), F.when(holds, deciding).otherwise(statistic)
    return origin, statistic


def fitted_thresholds(layouts: DataFrame, origin: str = "origin") -> DataFrame:
    """lang, statistic, threshold, n_files, n_others: where the files of known origin part by each statistic of their layout.

    layouts: the columns of ``file_layouts`` and the origin of each file.  For each language
    and statistic the threshold is the geometric mean of the 2nd percentile of the files of
    the origin that it speaks for and the 99.9th of the written ones (mirrored for those
    that count from the threshold down), both by one aggregate over all files.  Null where
    a language has no file of the origin, or where the two don't part.
    """
    out = None
    for name, (kind, sign) in STATISTICS.items():
        value = F.col(name)
        low = F.percentile_approx(F.when(F.col(origin) == kind, value), 0.02 if sign > 0 else 0.98)
        high = F.percentile_approx(F.when(F.col(origin) == "written", value), 0.999 if sign > 0 else 0.001)
        rows = layouts.filter("n_lines > 0").groupBy("lang").agg(low.alias("a"), high.alias("b"), F.count(F.when(F.col(origin) == kind, 1)).alias("n_files"), F.count(F.when(F.col(origin) == "written", 1)).alias("n_others"))
        parted = (F.col("a") - F.col("b")) * sign > 0
        rows = rows.select("lang", F.lit(name).alias("statistic"), F.when(parted, F.sqrt(F.col("a") * F.col("b"))).alias("threshold"), "n_files", "n_others")
        out = rows if out is None else out.unionByName(rows)
    return out


def file_origins(scans: DataFrame, upstreams: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """repo, path, lang, origin, deciding and the measures of the current version of every file with a language.

    ``origin`` is ``data`` (mostly numeric literals or long encoded runs), ``minified``
    (long lines, next to no white space) or ``generated`` (line after line with a number)
    where the layout passes the thresholds of the language; layouts can't tell a copied
    file from a written one, so the rest is ``vendored`` where it shares COPY_SHARE of its
    telling lines with an upstream file or opens with a comment that names a release and
    its licence, else ``written``.  ``deciding`` names the statistic, ``copied`` or
    ``notice``.  Only what a file holds counts: talking about such files or standing in a
    folder with such a name makes no case.

    Null for null content.  Repeated rows count once.  Null repo or path: left out.  Other
    columns are never read.
    """
    files = file_layouts(scans).join(copied_shares(scans, upstreams), ["repo", "path", "version"], "left")
    by_layout, statistic = layout_origin(thresholds)
    copy = F.when(F.col("copied").isNotNull(), "copied").when(F.col("notice"), "notice")
    origin = F.when(F.col("n_chars").isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(by_layout, F.when(copy.isNotNull(), "vendored"), F.lit("written")))
    return files.withColumns({"origin": origin, "deciding": F.when(F.col("n_chars").isNotNull(), F.coalesce(statistic, copy))})
