"""Per-key results when a few keys hold most of the records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds at most before it folds them, and folded rows it keeps before it hands them on.
HELD, KEPT = 1 << 19, 1 << 18


def best_members(rows: pa.Table, keys: list[str], member: str, when: str, n: int) -> pa.Table:
    """The state of each key: its n members that were seen last, each with its latest time.

    States merge: those of two parts of a table, put together and folded again, are those
    of the whole.
    """
    latest = rows.group_by([*keys, member]).aggregate([(when, "max")]).rename_columns([*keys, member, when])
    latest = latest.take(pc.sort_indices(latest, [*((k, "ascending") for k in keys), (when, "descending"), (member, "ascending")]))
    if latest.num_rows < 2:
        return latest
    first = np.zeros(latest.num_rows, dtype=bool)
    first[0] = True
    for k in keys:
        c = latest.column(k).combine_chunks()
        first[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(first)
    place = np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))
    return latest.filter(pa.array(place < n))


def latest_per_key(
    df: DataFrame,
    keys: list[str],
    member: str,
    when: str,
    n: int = 3,
    exclude_self: str | None = None,
) -> DataFrame:
    """The n members of every key that were seen last, without a task per hot key.

    Map-side combining: each task folds its rows into a table of key states (the n best
    members of the key so far) that holds KEPT rows; a larger one is handed on as it is and
    a new one begun, as states merge.  Whoever is cut from a task's share has n members of
    the key before it there, so before it everywhere.  Only the states are shuffled, once,
    by key: a hot key sends n rows from each task, however many rows it has, and is merged
    by two algebraic aggregates (the latest time of each member, the first n).

    Rows with a null key, member or time are left out, and so are rows whose member
    equals the column ``exclude_self``.  Repeated rows count once, equal times go to
    the smaller member, an empty input gives an empty result, and columns that aren't
    named here are never read.
    """
    cols = list(dict.fromkeys([*keys, member, when]))
    rows = df.select(*cols).dropna(subset=cols)
    if exclude_self is not None:
        rows = rows.filter(F.col(member) != F.col(exclude_self))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, held, size = None, [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                states = best_members(pa.concat_tables([*([states] if states else []), pa.Table.from_batches(held)]), keys, member, when, n)
                held, size = [], 0
                if states.num_rows > KEPT:
                    yield from states.select(cols).to_batches()
                    states = None
        rest = [*([states] if states else []), *([pa.Table.from_batches(held)] if held else [])]
        if rest:
            yield from best_members(pa.concat_tables(rest), keys, member, when, n).select(cols).to_batches()

    states = rows.mapInArrow(fold, rows.schema).repartition(*keys)
    latest = states.groupBy(*keys, member).agg(F.max(when).alias("__when"))
    order = Window.partitionBy(*keys).orderBy(F.col("__when").desc(), F.col(member))
    return (
        latest.withColumn("__place", F.row_number().over(order))
        .filter(F.col("__place") <= n)
        .select(*keys, member, F.col("__when").alias(when), F.col("__place").alias("place"))
    )


def key_load(df: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """Rows of the n heaviest keys (null keys are keys too) and their share of all rows, heaviest first.

    Counts are algebraic and folded on the map side; the sum of all counts is a scalar
    subquery over them, so the table is read once and nothing runs before the result is
    asked for.  The n heaviest come from a top-k, so no order over all keys is made.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    top = counts.orderBy(F.col("n_rows").desc(), *keys).limit(n)
    order = Window.orderBy(F.col("n_rows").desc(), *keys)
    return top.select(
        *keys,
        "n_rows",
        F.round(F.col("n_rows") / total, 6).alias("share"),
        F.row_number().over(order).alias("place"),
    )
