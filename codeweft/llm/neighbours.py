"""Problem 4: the most similar vectors of every vector, by collision counting on single projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.topn import top_n_per_group

DIM, K, SEED = 64, 5, 20_231
#: Vectors per projection array on the average, arrays a vector stands in.
PER_ARRAY, ENDS = 800, 3
#: Counting projections, collisions that make a candidate, half-width of the first window, how often it doubles before
#: it covers the array, and how many half-widths away a neighbour is nearly always a candidate.
COUNTING, COLLISIONS, WINDOW, DOUBLINGS, VOUCH = 24, 15, 0.07, 1, 5.0
#: Steps of a sorted array in a half-width; a place in it is a byte, so windows are compared by the byte.
STEPS = 15
#: Pairs that are verified at once, so that they stay near the processor.
PIECE = 1 << 13
#: Rows of an array in one task at most; a longer one is cut into blocks that meet pairwise.
BLOCK = 20_000
#: Bytes of vectors in a partition of the search, about.
PART = 8 << 20


def directions(n: int, seed: int, dim: int = DIM) -> np.ndarray:
    """n random directions of length one, the same wherever they are made."""
    d = np.random.default_rng(seed).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1)[:, None]


def usable(vectors: DataFrame, key: str = "node_id", vec: str = "vec", dim: int = DIM) -> DataFrame:
    """key and vec of the rows that take part: ``dim`` numbers, all finite, not all zero."""
    v, bad = F.col(vec), [F.lit(float(x)).cast("float") for x in ("nan", "inf", "-inf")]
    finite = F.forall(v, lambda x: x.isNotNull() & ~x.isin(*bad))
    return vectors.select(F.col(key).alias("node"), v.alias("vec")).filter(F.col("node").isNotNull() & (F.size("vec") == dim) & finite & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1)[:, None]


def _ends(rows: DataFrame, arrays: int, ends: int, dim: int, with_vec: bool) -> DataFrame:
    """array, node (and vec): each vector at the upper end of the arrays of its strongest projections.

    The directions are the sums of one out of each of two sets, so the projections on all
    ``arrays`` of them follow from those on 2 * sqrt(arrays), and the strongest are found
    among the strongest of both sets: placing a vector gets dearer by the square root of
    the number of arrays only.
    """
    side = math.isqrt(max(0, arrays - 1)) + 1
    near = min(ends, side)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = [directions(side, SEED + k, dim).astype(np.float32).T for k in (0, 7)]
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column(1), dim)).astype(np.float32)
            p = [x @ y for y in d]
            top = [np.argpartition(-y, near - 1, axis=1)[:, :near] for y in p]
            sums = np.take_along_axis(p[0], top[0], 1)[:, :, None] + np.take_along_axis(p[1], top[1], 1)[:, None, :]
            best = np.argsort(-sums.reshape(len(x), -1), axis=1)[:, :ends]
            array = np.take_along_axis(top[0], best // near, 1) * side + np.take_along_axis(top[1], best % near, 1)
            for t in range(array.shape[1]):
                cols = [pa.array(array[:, t].astype(np.int64)), b.column(0)]
                yield pa.RecordBatch.from_arrays([*cols, b.column(1)] if with_vec else cols, ["array", "node", "vec"][: 2 + with_vec])

    return rows.mapInArrow(assign, "array long, node long" + ", vec array<float>" * with_vec)


def candidates(place: np.ndarray, left: np.ndarray, lo: int, hi: int, tplace: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the targets lo:hi that lie in COLLISIONS of the windows centred on each query of ``left``.

    ``place`` and ``tplace`` have the places of queries and targets in each counting
    projection, as bytes; a window that runs over the last byte goes on with the first.
    """
    half = np.uint8(STEPS * 2**level)
    hits = np.zeros((len(left), hi - lo), dtype=np.uint8)
    gap, inside = np.empty_like(hits), np.empty(hits.shape, dtype=bool)
    for q, t in zip(place, tplace):
        np.subtract(t[lo:hi][None, :], (q[left] - half)[:, None], out=gap)
        np.less_equal(gap, np.uint8(2 * half), out=inside)
        np.add(hits, inside.view(np.uint8), out=hits)
    return np.nonzero(hits >= COLLISIONS)


def search(ids: np.ndarray, x: np.ndarray, query: np.ndarray, target: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """query id, neighbour id, cosine of up to k neighbours among the targets for each query of one array; then id and number of targets verified for each query.

    Every counting projection is a sorted array; a target collides with a query in it if it
    lies in the window centred on the query.  Collisions are counted for the targets in the
    query's window of the first projection, and only those that collide in COLLISIONS of
    COUNTING windows are verified: their cosine is taken.  Windows double (virtual
    rehashing) for the queries whose k-th neighbour is farther than the window vouches for,
    and at last cover the array.
    """
    p = x @ directions(COUNTING, SEED + 1, x.shape[1]).T
    order = np.argsort(p[:, 0], kind="stable")
    ids, x, p, query, target = ids[order], x[order], p[order], query[order], target[order]
    place = np.ascontiguousarray(np.floor(p * (STEPS / WINDOW)).astype(np.int64).astype(np.uint8).T)
    tplace, tfirst, tid, tx = np.ascontiguousarray(place[:, target]), p[target, 0], ids[target], x[target]
    x32, tx32 = x.astype(np.float32), tx.astype(np.float32)
    buffers = np.empty((2, PIECE, x.shape[1]), dtype=np.float32)
    verified, out = np.zeros(len(ids), dtype=np.int64), []
    qs = np.flatnonzero(query)
    for a in range(0, len(qs), 256):
        left = qs[a : a + 256]
        for level in range(DOUBLINGS + 2):
            half = WINDOW * 2**level if level <= DOUBLINGS else np.inf
            if half < np.inf:
                lo, hi = np.searchsorted(tfirst, [p[left[0], 0] - half, p[left[-1], 0] + half], side="left")
                row, col = candidates(place, left, lo, hi, tplace, level)
                col += lo
            else:
                row, col = np.repeat(np.arange(len(left)), len(tid)), np.tile(np.arange(len(tid)), len(left))
            other = tid[col] != ids[left[row]]
            row, col = row[other], col[other]
            n = np.bincount(row, minlength=len(left))
            verified[left] += n
            sims, mine = np.empty(len(row), dtype=np.float32), left[row]
            for s in range(0, len(row), PIECE):
                one, two = buffers[0][: len(row) - s], buffers[1][: len(row) - s]
                np.take(x32, mine[s : s + PIECE], axis=0, out=one, mode="clip")
                np.take(tx32, col[s : s + PIECE], axis=0, out=two, mode="clip")
                np.einsum("ij,ij->i", one, two, out=sims[s : s + PIECE])
            table = np.full((len(left), max(k, n.max(initial=0))), -2, dtype=np.float32)
            table[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = sims
            kth = -np.partition(-table, k - 1, axis=1)[:, k - 1]
            done = kth >= 1 - (VOUCH * half) ** 2 / 2 if half < np.inf else np.ones(len(left), dtype=bool)
            kept = done[row] & (sims >= kth[row] - 1e-5)  # the few that can be among the k best, now in double precision
            row, col = row[kept], col[kept]
            cosine = np.round(np.einsum("ij,ij->i", x[left[row]], tx[col]), 9)
            q, t = ids[left[row]], tid[col]
            first = np.lexsort((t, -cosine, q))
            q, t, cosine = q[first], t[first], cosine[first]
            best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
            out.append((q[best], t[best], cosine[best]))
            left = left[~done]
            if not len(left):
                break
    q, t, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return q, t, s, ids[query], verified[query]


def nearest(vectors: DataFrame, key: str = "node_id", vec: str = "vec", k: int = K, dim: int = DIM) -> DataFrame:
    """node, near, met, verified: for every usable vector up to k (distance, id), nearest first; distance is minus the cosine, rounded to 9 decimals.

    Each vector stands at the upper end of the sorted arrays of its ENDS strongest out of
    many single projections, where similar vectors meet; see ``search`` for what happens
    inside an array.  There are as many arrays as keep an array at PER_ARRAY vectors times
    ENDS, at every size.  An array with more than BLOCK rows is cut into blocks by a hash
    of the id, and every two blocks meet in a task of their own, so a crowded array costs
    more tasks, not a larger one, and nothing is dropped.

    Repeated rows count once.  Of more than k+1 nodes with the same vector, the k+1 smallest
    ids take part and give the others their neighbours: themselves and what they have found,
    as a multiple of the vector is as near and may have smaller ids.  Unusable vectors take
    no part; nodes without any neighbour have no row.  ``met`` counts the targets in the
    arrays of a node, ``verified`` those whose cosine was taken; null for nodes that take
    over the neighbours of an equal one.  Empty input: empty result.  Other columns are
    never read.
    """
    rows = usable(vectors, key, vec, dim).select("node", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    n, most = copies.agg(F.coalesce(F.sum(F.least("n", F.lit(k + 1))), F.lit(0)), F.max("n")).first()
    if most is not None and most > k + 1:
        many = copies.filter(F.col("n") > k + 1).select("h1", "h2")
        crowd = rows.join(many, ["h1", "h2"], "left_semi")
        first = top_n_per_group(crowd.withColumn("zero", F.lit(0.0)), ["h1", "h2"], "zero", "node", k + 1).select("h1", "h2", "node")
        kept = crowd.join(first, ["h1", "h2", "node"], "left_semi").dropDuplicates(["node"])
        near = _nearest(rows.join(many, ["h1", "h2"], "left_anti").select("node", "vec").unionByName(kept.select("node", "vec")), n, k, dim)
        lists = first.join(near, "node").groupBy("h1", "h2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        inside = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("node")).alias("ids"))
        others = crowd.select("h1", "h2", "node").distinct().join(first, ["h1", "h2", "node"], "left_anti").join(inside, ["h1", "h2"]).join(lists, ["h1", "h2"], "left")
        own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id")))
        both = F.concat(own, F.coalesce("near", F.expr("CAST(array() AS array<struct<d:double,id:bigint>>)")))
        others = others.select("node", F.slice(F.array_sort(F.array_distinct(both)), 1, k).alias("near"), F.lit(None).cast("long").alias("met"), F.lit(None).cast("long").alias("verified"))
        return near.unionByName(others)
    return _nearest(rows.select("node", "vec"), n, k, dim)


def _nearest(rows: DataFrame, n: int, k: int, dim: int) -> DataFrame:
    arrays = max(1, n // PER_ARRAY)
    ends = min(ENDS, arrays)
    placed = _ends(rows, arrays, ends, dim, True)
    crowded = None
    if n * ends > BLOCK:
        sizes = _ends(rows, arrays, ends, dim, False).groupBy("array").count().filter(F.col("count") > BLOCK)
        crowded = sizes.select("array", F.ceil(F.col("count") / BLOCK).cast("int").alias("m"))
    if crowded is not None:
        # An array in BLOCK has a row here at most, so this side is n * ENDS / BLOCK rows of two numbers.
        placed = placed.join(F.broadcast(crowded), "array", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        placed = placed.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("m", "other")
    else:
        placed = placed.withColumns({"own": F.lit(0), "a": F.lit(0), "b": F.lit(0)})

    # As many partitions as keep a task's share at PART bytes, whatever the session's setting.
    parts = max(1, -(-n * ends * (4 * dim + 24) // PART))
    placed = placed.select("array", "node", "vec", "own", "a", "b").repartition(parts, "array", "a", "b")

    def find(key, group):
        group = group.combine_chunks()
        ids, own = group.column("node").to_numpy(), group.column("own").to_numpy()
        _, once = np.unique(ids, return_index=True)
        x = _unit(_matrix(group.column("vec").combine_chunks(), dim)[once])
        ids, own, a, b = ids[once], own[once], key[1].as_py(), key[2].as_py()
        every = np.ones(len(ids), dtype=bool)
        parts = [search(ids, x, every, every, k)] if a == b else [search(ids, x, own == a, own == b, k), search(ids, x, own == b, own == a, k)]
        q, t, s, asked, verified = (np.concatenate(c) for c in zip(*parts))
        met = np.concatenate([np.full(len(p[3]), np.sum(m)) for p, m in zip(parts, [every] if a == b else [own == b, own == a])])
        order, place = np.argsort(q, kind="stable"), np.argsort(asked)  # a query has all its neighbours in one run, nearest first
        q, t, s, asked = q[order], t[order], s[order], asked[place]
        starts = np.searchsorted(q, asked)
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(-s), pa.array(t)], ["d", "id"]))
        return pa.table([pa.array(asked), near, pa.array(met[place]), pa.array(verified[place])], ["node", "near", "met", "verified"])

    found = placed.groupBy("array", "a", "b").applyInArrow(find, "node long, near array<struct<d:double,id:long>>, met long, verified long")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return found.groupBy("node").agg(merged.alias("near"), F.sum("met").alias("met"), F.sum("verified").alias("verified")).filter(F.size("near") > 0)


def search_work(near: DataFrame) -> DataFrame:
    """One row: nodes, pairs that stood in one array (each way), those of them that were verified, and their share."""
    sums = near.agg(F.count(F.lit(1)).alias("nodes"), F.sum("met").alias("met"), F.sum("verified").alias("verified"))
    return sums.withColumn("share", F.round(F.try_divide("verified", "met"), 4))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """node_a, node_b with node_a < node_b: pairs in which at least one is a neighbour of the other."""
    each = near.select("node", F.explode("near.id").alias("id"))
    return each.select(F.least("node", "id").alias("node_a"), F.greatest("node", "id").alias("node_b")).distinct()
