"""Repositories, commit logs and diffs as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.sources.languages import FOLDERS, decision, language_of, looks_minified

#: Bytes of contents that a task reads, about.
READ = 32 << 20
COMMITS = "sha string, subject string, files array<string>"


def _listed(fs: pafs.FileSystem, base: str) -> list[tuple]:
    """path below base, time, size of every file, without a look into folders that are left out."""
    out, open_ = [], [base]
    while open_:
        for f in fs.get_file_info(pafs.FileSelector(open_.pop())):
            if f.type == pafs.FileType.Directory:
                if not f.base_name.startswith(".") and f.base_name not in FOLDERS:
                    open_.append(f.path)
            elif f.type == pafs.FileType.File:
                out.append((f.path[len(base) :].lstrip("/"), f.mtime, f.size))
    return sorted(out)


def read_repository(spark: SparkSession, root: str, repo: str = "", ignore_files: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """repo, path, modification_time, n_bytes, content, lang of the files below root that belong to the graph by name and size.

    Only names go through the driver, and folders that are left out aren't looked into;
    what the rules and the root's ignore files drop is never read, the rest in tasks of
    about READ bytes.  The root is a path or URI that all executors reach.  Spark's own file
    sources skip names that begin with _ or ., so they can't read a repository.
    """
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:").rstrip("/") or "/")
    here = [f for f in fs.get_file_info([f"{base}/{name}" for name in ignore_files]) if f.type == pafs.FileType.File]
    lines = [x for f in here for x in fs.open_input_stream(f.path).read().decode("utf-8", "replace").splitlines()]
    names = spark.createDataFrame(_listed(fs, base), "path string, modification_time timestamp, n_bytes long")
    kept = names.filter(decision(F.col("path"), F.col("n_bytes"), lines) == "kept")
    count, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    spread = kept.repartition(max(1, -(-size // READ), -(-count // 5000))).select(F.lit(repo).alias("repo"), "path", "modification_time", "n_bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = pafs.FileSystem.from_uri(root)[0] if "://" in root else pafs.LocalFileSystem()
        for b in batches:
            for k, path in enumerate(b.column("path").to_pylist()):
                with source.open_input_stream(f"{base}/{path}") as f:
                    content = pa.array([f.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, content], [*b.schema.names, "content"])

    return spread.mapInArrow(read, "repo string, path string, modification_time timestamp, n_bytes long, content binary").withColumn("lang", language_of(F.col("path")))


def kept_files(scans: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """The scanned files that belong to the graph: by name, size and, for web files, the length of their first lines."""
    return scans.filter((decision(F.col("path"), F.col("n_bytes"), ignore) == "kept") & ~looks_minified(F.col("path"), F.col("content")))


def current_files(scans: DataFrame) -> DataFrame:
    """repo, path, modification_time, hash, n_bytes, lang: the latest version of each file, by its hash instead of its content."""
    facts = F.struct("modification_time", F.sha2("content", 256).alias("hash"), "n_bytes", "lang")
    return scans.dropna(subset=["repo", "path"]).groupBy("repo", "path").agg(F.max(facts).alias("v")).select("repo", "path", "v.*")


def commit_log(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """sha, subject, files of the last commits, newest first; a root without a log gives none."""
    run = ["git", "-C", root, "log", f"-n{most}", "--name-only", "--format=%x1e%H%n%s"]
    try:
        text = subprocess.run(run, capture_output=True, text=True, errors="replace", timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        text = ""
    rows = []
    for block in filter(str.strip, text.split("\x1e")):
        lines = block.strip("\n").split("\n")
        rows.append((lines[0].strip(), lines[1].strip() if len(lines) > 1 else "", sorted({x.strip() for x in lines[2:] if x.strip()})))
    return spark.createDataFrame(rows, COMMITS)


def diff_hunks(lines: DataFrame, n: str = "n", text: str = "line", diff: str | None = None) -> DataFrame:
    """(diff,) path, first, last: the changed ranges of unified diffs without context, given as numbered lines.

    ``diff`` names the column that tells diffs apart, each of which is ordered on its own;
    without one all lines are of one diff.  The file of a hunk is the last file header
    above it.  A hunk without count is one line; a pure deletion counts as touching the
    line it stands at.
    """
    of = [diff] if diff else []
    head = F.regexp_extract(F.col(text), r"^\+\+\+ b/(\S+)", 1)
    span = F.regexp_extract(F.col(text), r"^@@ -\S+ \+(\d+(?:,\d+)?) @@", 1)
    marks = lines.select(*of, n, F.when(head != "", head).alias("head"), F.when(span != "", span).alias("span")).filter("head IS NOT NULL OR span IS NOT NULL")
    above = F.last("head", ignorenulls=True).over(Window.partitionBy(*of).orderBy(n).rowsBetween(Window.unboundedPreceding, 0))
    first = F.split("span", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("span", ","), F.lit(2)).cast("int"), F.lit(1))
    return marks.withColumn("path", above).filter("span IS NOT NULL AND path IS NOT NULL").select(*of, "path", first.alias("first"), (first + F.greatest(count - 1, F.lit(0))).alias("last"))
