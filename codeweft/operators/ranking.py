"""Importance and subsystems: iterations whose state is written out after every step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from codeweft.session import remove, shared_folder, written


#: Rows of a bucket of edges, about; out-edges of a node that stand together at most; steps between writes.
BUCKET, TOGETHER, STEPS = 500_000, 100_000, 5
#: Steps of the community search between writes.
TOGETHER_STEPS = 3


def _written(df: DataFrame, folder: str, **sums) -> tuple[DataFrame, dict]:
    """df as a table in the shared checkpoint folder, and sums that are taken while it is written."""
    seen = Observation()
    if sums:
        df = df.observe(seen, *[c.alias(k) for k, c in sums.items()])
    return written(df, folder), seen.get if sums else {}


def _bucketed(df: DataFrame, folder: str, rows: int, keys: list[str]) -> tuple[DataFrame, str]:
    """df as a table at a folder, bucketed by keys, so that joins by them read it without a shuffle; and its name."""
    name = f"flows_{uuid.uuid4().hex}"
    n = max(1, min(100_000, -(-rows // BUCKET)), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, *keys).write.option("path", folder).bucketBy(n, *keys).saveAsTable(name)
    return df.sparkSession.table(name), name


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 30) -> DataFrame:
    """id, rank: weighted PageRank with exactly ``steps`` steps, the highest rank scaled to 1.

    Edges (src, dst, weight) to unknown targets lose their share; nodes without out-edges
    spread theirs evenly.

    A step is r' = M r + s 1, where s holds the mass that is spread evenly.  So r after all
    steps is a sum of the vectors M^j 1 with factors that follow from the mass of each on
    nodes without out-edges.  The vectors need no number from the driver: each is one join
    by source and one sum by target, folded on the map side; nodes that nothing points to
    have no row.  Every STEPS vectors are written out in one job, so no lineage grows.  One
    aggregate then gives the masses and one the ranks.

    The edges are written once, bucketed by source, and no step shuffles them.  A node with
    more than TOGETHER out-edges has them in pieces by a hash of the target, and its weight
    goes to each piece, so no task gets all edges of a hot source.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    weight = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    sources = weight.withColumn("pieces", F.ceil(F.col("n") / TOGETHER).cast("int"))
    root = shared_folder(spark, "pagerank")
    known = ids.join(sources.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("pieces").isNull().alias("loose"), F.coalesce("pieces", F.lit(1)).alias("pieces"), "n")
    known, got = _written(known, f"{root}/nodes", n=F.count(F.lit(1)), edges=F.coalesce(F.sum("n"), F.lit(0)))
    n = got["n"]
    if not n:
        return known.select("id", F.lit(0.0).alias("rank"))
    flows = edges.join(sources, "src").join(known.select(F.col("id").alias("src")), "src", "left_semi")
    flows = flows.groupBy("src", "dst", "pieces").agg((F.sum(F.coalesce(F.try_divide("weight", "total"), F.lit(0.0))) * damping).alias("part"))
    flows = flows.withColumn("piece", F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int")).drop("pieces").join(known.select(F.col("id").alias("dst"), "pieces"), "dst")
    flows, table = _bucketed(flows, f"{root}/flows", got["edges"], ["src", "piece"])

    def step(vector: DataFrame) -> DataFrame:
        pieces = vector.select("id", "w", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"))
        moved = pieces.join(flows, (F.col("id") == F.col("src")) & (F.col("p") == F.col("piece")))
        return moved.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("part")).alias("w"), F.max("pieces").alias("pieces"))

    vector = known.select("id", F.lit(1.0).alias("w"), "pieces")
    powers, parts = "id long, w double, pieces int, j int", []
    for done in range(0, steps, STEPS):
        batch = None
        for j in range(done + 1, min(done + STEPS, steps) + 1):
            vector = step(vector)
            one = vector.withColumn("j", F.lit(j))
            batch = one if batch is None else batch.unionByName(one)
        parts.append(f"{root}/vectors-{done}")
        batch.write.parquet(parts[-1])
        vector = spark.read.schema(powers).parquet(parts[-1]).filter(F.col("j") == min(done + STEPS, steps)).drop("j")
    if steps:
        powers = spark.read.schema(powers).parquet(*parts)
        sums = powers.join(known.filter("loose").select("id"), "id", "left_semi").groupBy("j").agg(F.sum("w").alias("m")).collect()  # a row per step
        mass = {r["j"]: r["m"] for r in sums} | {0: known.filter("loose").count()}
    factors = [1.0 / n]  # factors[i] is the even share after step i
    for i in range(1, steps + 1):
        spread = sum(factors[i - 1 - j] * mass.get(j, 0.0) for j in range(i))
        factors.append((1 - damping) / n + damping * spread / n)
    ranks = known.select("id", F.lit(factors[steps]).alias("rank"))
    if steps:
        by = F.array(*[F.lit(factors[steps - j]) for j in range(steps + 1)])
        ranks = ranks.unionByName(powers.select("id", (by[F.col("j")] * F.col("w")).alias("rank"))).groupBy("id").agg(F.sum("rank").alias("rank"))
    ranks, got = _written(ranks, f"{root}/ranks", top=F.max("rank"))
    spark.sql(f"DROP TABLE {table}")
    for folder in (f"{root}/flows", f"{root}/nodes", *parts):
        remove(spark, folder)
    return ranks.select("id", (F.col("rank") / got["top"]).alias("rank"))


def communities(links: DataFrame, rounds: int = 10, levels: int = 60) -> DataFrame:
    """id, community: label propagation in ascending id order, where a new label counts at once.

    links has both directions (a, b).  In a round each file takes the most frequent label
    of its neighbours, ties the smallest: new labels of smaller ids, old ones of larger.
    That order is kept without going file by file: the round's labels are the only
    solution of label(v) = mode(new labels below v, old labels above v), reached by
    recomputing until nothing changes, each time with one join and one aggregate.  A label
    waits for those of an ascending chain of ids; what is farther than ``levels`` down such
    a chain takes the label it has by then and goes on in the next round, so rounds *
    levels steps are the most, however long the chains.  Some steps are written out
    together.  Files without links aren't in the result and keep their own label.
    """
    spark, root = links.sparkSession, shared_folder(links.sparkSession, "communities")
    links, _ = _written(links.repartition("a"), f"{root}/links")

    def recomputed(labels: DataFrame) -> DataFrame:
        other = labels.select(F.col("id").alias("b"), "label", "new")
        seen = links.join(other, "b").select(F.col("a").alias("id"), F.when(F.col("b") < F.col("a"), F.col("new")).otherwise(F.col("label")).alias("near"))
        best = seen.groupBy("id", "near").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.min_by("near", F.struct(-F.col("n"), "near")).alias("best"))
        return labels.join(best, "id").select("id", "label", F.col("best").alias("new"), (F.col("best") != F.col("new")).alias("moved"))

    labels, _ = _written(links.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")).withColumn("new", F.col("id")), f"{root}/step-0")
    step = 0
    for _ in range(rounds):
        changed = 0
        for _ in range(0, levels, TOGETHER_STEPS):
            after = labels
            for _ in range(TOGETHER_STEPS):
                after = recomputed(after.select("id", "label", "new"))
            step += 1
            after, got = _written(after, f"{root}/step-{step}", moved=F.count(F.when(F.col("moved"), 1)), changed=F.count(F.when(F.col("new") != F.col("label"), 1)))
            remove(spark, f"{root}/step-{step - 1}")
            labels, changed = after.select("id", "label", "new"), got["changed"]
            if not got["moved"]:
                break
        labels = labels.select("id", F.col("new").alias("label"), "new")
        if not changed:
            break
    remove(spark, f"{root}/links")
    return labels.select("id", F.col("label").alias("community"))


def subsystems(nodes: DataFrame, limit: int = 6, per: int = 4, more: tuple[str, ...] = ()) -> DataFrame:
    """community, size, place, file_path (and more columns): the largest communities of files, each with its highest-ranked files.

    The ``limit`` largest come first, ties by smaller id, and of these only those with two
    files or more; label 0 is no community.
    """
    files = nodes.filter("kind = 'file' AND community <> 0")
    big = files.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "community").limit(limit).filter("size >= 2")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.col("rank").desc(), "id"))
    return files.join(big, "community").withColumn("place", place).filter(F.col("place") <= per).select("community", "size", "place", "file_path", *more)


def with_ranks(nodes: DataFrame, ranks: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes with new ranks (id, rank) and communities (id, community of files), each node in the community of its file; unknown: 0."""
    files = nodes.filter("kind = 'file'").groupBy("repo", "file_path").agg(F.max("id").alias("id"))
    of_file = files.join(groups, "id").select("repo", "file_path", "community")
    rest = [c for c in nodes.columns if c not in ("rank", "community")]
    rows = nodes.select(*rest).join(ranks, "id", "left").join(of_file, ["repo", "file_path"], "left")
    return rows.select(*rest, F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("community", F.lit(0)).alias("community"))
