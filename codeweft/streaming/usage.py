"""Streams: usage telemetry and continuous refresh of the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import children, exists, remove, shared_folder, written
from codeweft.sources.repositories import current_files


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def usage_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, n_users, total: uses by window; rows later than ``late`` don't count."""
    ts = F.col("ts").cast("timestamp")
    w = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    sums = w.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("n_users"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), "event_type", "n", "n_users", "total")


def run_once(spark: SparkSession, counts: DataFrame, mode: str = "complete", root: str | None = None, keys: tuple[str, ...] = ("window_start", "event_type")) -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder; started again with the same root, it goes on.

    ``complete``: each batch is the whole result, so the last one counts.  ``append``: a
    window comes once, when the watermark has passed it; batches add up.  ``update``:
    windows come again as they change; of each the latest batch counts.  Every batch has a
    folder of its own, so a batch that comes again replaces itself.  Nothing to read: an
    empty table.
    """
    root = root or shared_folder(spark, "usage")
    q = counts.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    q.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")).start().awaitTermination()
    epochs = [int(c.partition("=")[2]) for c in children(spark, f"{root}/out") if c.startswith("epoch=")]
    if not epochs:
        return spark.createDataFrame([], counts.schema)
    if mode == "complete":
        for old in set(epochs) - {max(epochs)}:
            remove(spark, f"{root}/out/epoch={old}")
        return spark.read.schema(counts.schema).parquet(f"{root}/out/epoch={max(epochs)}")
    every = spark.read.option("basePath", f"{root}/out").schema(f"{_ddl(counts)}, epoch int").parquet(*[f"{root}/out/epoch={k}" for k in epochs])
    if mode == "append":
        return every.drop("epoch")
    rest = [c for c in counts.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*").select(*counts.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


#: Parts of a manifest; a batch writes only the parts that it changes.
PARTS = 64


def _parts(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The last batch that wrote each part of a manifest, of those before one."""
    found: dict[int, int] = {}
    for folder in children(spark, f"{root}/manifest"):
        epoch = int(folder.partition("=")[2]) if folder.startswith("epoch=") else -1
        if epoch < 0 or before is not None and epoch >= before:
            continue
        for part in children(spark, f"{root}/manifest/{folder}"):
            if part.startswith("part="):
                found[int(part[5:])] = max(found.get(int(part[5:]), -1), epoch)
    return found


def _manifest(spark: SparkSession, root: str, schema: str, parts: dict[int, int]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/manifest/epoch={e}/part={p}" for p, e in sorted(parts.items())])


def refresh(spark: SparkSession, scans: DataFrame, root: str | None = None) -> DataFrame:
    """The manifest (repo, path, modification_time, hash, n_bytes, lang) kept by a stream of scanned files.

    Each batch is folded to its current files, by their greatest (time, hash, size,
    language) with unknown times as oldest, and so are these with the entries known before:
    the order and grouping of batches make no difference.  A manifest lies in PARTS parts by
    a hash of repository and path; a batch writes only the parts it changes, in a folder of
    its own, and reads what batches before it wrote, so one that comes again changes
    nothing.  What is known is found in the folder, so a new process with the same root
    goes on, also where nothing is new.  Parts that two batches have replaced are removed.
    """
    root = root or shared_folder(spark, "refresh")
    schema = _ddl(current_files(scans))
    facts = ["modification_time", "hash", "n_bytes", "lang"]

    def put(df: DataFrame, epoch: int) -> None:
        part = F.pmod(F.xxhash64("repo", "path"), F.lit(PARTS)).cast("int")
        news = written(current_files(df).withColumn("part", part), f"{root}/news")
        touched = {r["part"] for r in news.select("part").distinct().collect()}  # PARTS numbers at most
        before = _parts(spark, root, epoch)
        known = _manifest(spark, root, schema, {p: e for p, e in before.items() if p in touched}).withColumn("part", part)
        both = known.unionByName(news).groupBy("part", "repo", "path").agg(F.max(F.struct(*facts)).alias("v")).select("part", "repo", "path", "v.*")
        both.write.mode("overwrite").partitionBy("part").parquet(f"{root}/manifest/epoch={epoch}")
        for p in touched & before.keys():  # the batch before this one may come again; what it read may go
            for older in range(before[p]):
                if exists(spark, old := f"{root}/manifest/epoch={older}/part={p}"):
                    remove(spark, old)

    q = scans.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return _manifest(spark, root, schema, _parts(spark, root))
