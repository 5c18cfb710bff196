"""Problem 7: filling containers of fixed capacity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Containers a group fills, about, and items it holds, about: a group is one task's work, whatever the size of the corpus.
GROUP, ITEMS = 1024, 65_536


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and start of each item, items in the given order, each into the first bin with room.

    A tournament tree over the bins holds the largest room of each half, so the first bin
    with room is found from the root in as many steps as the tree is high.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [capacity] * (2 * width)
    bins, starts = [], []
    for n in sizes:
        k = 1
        while k < width:
            k = 2 * k if room[2 * k] >= n else 2 * k + 1
        bins.append(k - width)
        starts.append(capacity - room[k])
        room[k] -= n
        k //= 2
        while k:
            room[k] = max(room[2 * k], room[2 * k + 1])
            k //= 2
    return bins, starts


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group: int = GROUP, most: int = ITEMS) -> DataFrame:
    """container, key, piece, start, n_tokens: the container and the place of each item.

    An item above the capacity is cut into full pieces, which are containers of their own,
    and a rest.  Rests and all other items go to randomised groups of about ``group``
    containers, by a hash of key and piece; each group is packed by first-fit decreasing
    (equal sizes by key, then piece) on its own.  The number of groups follows from the sum
    of all sizes and from the number of items (about ``most`` in a group, as very many may
    be empty), so a group's work is bounded however large the corpus is.  Rows with one key
    are spread over the groups, too.

    An item of size 0 or null takes no room and stands in a container all the same.  An
    item of exactly the capacity fills a container.  Rows with the same key are items of
    their own, but get equal keys in the result.  Empty input: empty result.
    """
    cap = F.lit(capacity)
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sized.select(F.col(key).alias("__key"), n.alias("__n"))
    full = (
        items.filter(F.col("__n") >= capacity)
        .withColumn("__row", F.monotonically_increasing_id())  # keys may repeat, containers may not
        .select("__key", "__row", F.explode(F.sequence(F.lit(0), (F.col("__n") / cap).cast("int") - 1)).alias("piece"))
        .select(F.concat_ws("-", F.lit("d"), F.col("__key").cast("string"), F.col("__row"), "piece").alias("container"), "__key", "piece", F.lit(0).alias("start"), F.lit(capacity).alias("n_tokens"))
    )
    rest = items.filter((F.col("__n") < capacity) | (F.col("__n") % cap > 0)).select("__key", (F.col("__n") / cap).cast("int").alias("piece"), (F.col("__n") % cap).cast("int").alias("n_tokens"))
    total, count = rest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, round(total / (capacity * group)), -(-count // most))
    kind = sized.schema[key].dataType.simpleString()

    def ffd(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "__key", "piece"], ascending=[False, True, True])
        bins, pdf["start"] = first_fit(pdf["n_tokens"].tolist(), capacity)
        pdf["container"] = [f"g{g}-{b}" for g, b in zip(pdf["__group"], bins)]
        return pdf[["container", "__key", "piece", "start", "n_tokens"]]

    packed = (
        rest.withColumn("__group", F.pmod(F.xxhash64("__key", "piece", F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("__group")
        .applyInPandas(ffd, f"container string, __key {kind}, piece int, start int, n_tokens int")
    )
    return packed.unionByName(full).withColumnRenamed("__key", key)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least containers possible and the share of room left unused."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest")).select(
        "containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("unused")
    )
