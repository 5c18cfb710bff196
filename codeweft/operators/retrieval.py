"""Ranked retrieval for many queries at once: BM25, cosine, fusion and budgeted context."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.session import shared_folder, shared_table, written

COLUMNS = ("name", "qualified_name", "summary")
#: Queries, vectors and nodes that meet in a task of the exact searches, about.
QUERY_BLOCK, VECTOR_BLOCK, NODE_BLOCK = 4096, 25_000, 200_000


def postings(nodes: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id, col, pos, token of every token of the given columns."""
    cols = F.array(*[F.struct(F.lit(k).alias("col"), fn.tokens(F.col(c)).alias("toks")) for k, c in enumerate(columns)])
    return nodes.select("id", F.explode(cols).alias("c")).select("id", "c.col", F.posexplode("c.toks").alias("pos", "token"))


def _phrases(query: Column) -> Column:
    """The phrases of a query, the tokens of each with a blank between; words without a token left out."""
    return F.filter(F.transform(fn.query_words(query), lambda w: F.array_join(fn.tokens(w), " ")), lambda p: p != "")


def bm25(queries: DataFrame, nodes: DataFrame, limit: int = 12, blend: float = 5.0, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """qid, id, score, place: the ``limit`` best nodes of each query (columns qid, query).

    Each word of a query is a phrase of the tokens in it, which must stand next to each
    other in one column; phrases are joined by OR and words that come twice count twice.
    The score is minus BM25 (k1 1.2, b 0.75) over all columns, less ``blend`` times the
    rank, lowest first, equal scores by smaller id.

    Three tables are written to the shared folder, each once: the distinct queries, their
    distinct phrases, and of each node the numbers of the phrases in it.  Then a task takes
    a block of queries and passes over the table of nodes, block by block, with the best so
    far of each query; so neither nodes nor candidates are copied or exchanged, and only
    the result leaves the task.  Exact.
    """
    return ranked(indexed(queries, nodes, columns), limit, blend)


def indexed(queries: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, str, int, float]:
    """What ``ranked`` takes, for one or several blends: the queries, the folder of the tables, the number of nodes and their mean length."""
    at = shared_folder(queries.sparkSession, "bm25")
    words = queries.select("qid", _phrases(F.col("query")).alias("p")).filter(F.size("p") > 0)
    # Queries of one id are one query; equal queries are answered once.
    words = words.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    asked = written(words.groupBy("p").agg(F.collect_list(F.struct(F.col("qid").cast("long").alias("qid"))).alias("qids")), f"{at}/asked")
    written(asked.select(F.explode("p").alias("phrase")).distinct(), f"{at}/phrases")
    text = nodes.select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"), *[fn.tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])
    found = written(text.mapInArrow(_matching(f"{at}/phrases", len(columns)), "id long, rank double, len int, phrases array<int>, times array<int>"), f"{at}/found")
    written(found.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df")), f"{at}/df")
    n, average = found.agg(F.count(F.lit(1)), F.avg("len")).first()
    return asked, at, n, average or 1.0


def ranked(index: tuple[DataFrame, str, int, float], limit: int, blend: float) -> DataFrame:
    """qid, id, score, place of the ``limit`` best nodes, see ``bm25``."""
    asked, at, n, average = index
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    best = asked.repartition(blocks).mapInArrow(_best_of_all(at, n, average, limit, blend), "qids array<struct<qid:long>>, id long, score double, place int")
    return best.select(F.explode("qids").alias("q"), "id", "score", "place").select("q.qid", "id", "score", "place")


def _numbered(path: str) -> pa.Array:
    """The phrases; each has its place as number."""
    words = shared_table(path).to_table()["phrase"].combine_chunks()
    return words.take(pc.array_sort_indices(words))


def _matching(path: str, columns: int):
    """A function of batches of nodes (id, rank, t0, t1, ...): their length and which phrases they have how often."""

    def match(batches):
        phrases = _numbered(path)
        tokens = pc.split_pattern(phrases, " ")
        words = tokens.flatten().unique() if len(tokens) else pa.array([], pa.string())
        # A phrase is a path of states: a step is from a state by a token to the next state.
        parts, sizes = pc.index_in(tokens.flatten(), words).to_numpy().astype(np.int64), pc.list_value_length(tokens).to_numpy()
        starts, state, steps = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), []
        of_state: list[np.ndarray] = []
        for j in range(int(sizes.max(initial=0))):
            alive = np.flatnonzero(sizes > j)
            keys, to = np.unique(state[alive] * len(words) + parts[starts[alive] + j], return_inverse=True)
            state[alive] = to
            ends, full = np.full(len(keys), -1, np.int64), sizes[alive] == j + 1
            ends[to[full]] = alive[full]
            steps.append(keys)
            of_state.append(ends)
        for batch in batches:
            rows, found = np.arange(batch.num_rows), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            length = np.zeros(batch.num_rows, np.int64)
            for k in range(columns):
                lists = batch[f"t{k}"]
                size = pc.list_value_length(lists).to_numpy()
                length += size
                row, token = np.repeat(rows, size), pc.fill_null(pc.index_in(lists.flatten(), words), -1).to_numpy().astype(np.int64)
                place, state = np.arange(len(token)), np.zeros(len(token), np.int64)
                for j, (keys, ends) in enumerate(zip(steps, of_state)):
                    here = place + j < len(token)
                    place, state = place[here], state[here]
                    here = (row[place + j] == row[place]) & (token[place + j] >= 0)
                    place, key = place[here], state[here] * len(words) + token[place[here] + j]
                    state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    here = keys[state] == key
                    place, state = place[here], state[here]
                    over = ends[state] >= 0
                    found.append((row[place[over]], ends[state[over]]))
            pairs, times = np.unique(np.concatenate([r * max(1, len(phrases)) + p for r, p in found]), return_counts=True)
            row, phrase = np.divmod(pairs, max(1, len(phrases)))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (phrase, times)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["rank"], pa.array(length.astype(np.int32)), *lists], ["id", "rank", "len", "phrases", "times"])

    return match


def _node_blocks(path: str):
    """id, rank and len of about NODE_BLOCK nodes after the other, by id, and their postings (phrase, node, times) by phrase and node."""
    held, rows = [], 0
    batches = shared_table(path).to_batches(batch_size=NODE_BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
        if rows and (batch is None or rows >= NODE_BLOCK):
            t = pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
            ids = t["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            phrase = pc.list_flatten(t["phrases"]).to_numpy()
            node = np.repeat(place, pc.list_value_length(t["phrases"]).to_numpy())
            order = np.argsort(phrase.astype(np.int64) * len(ids) + node)
            yield ids[by_id], t["rank"].to_numpy()[by_id], t["len"].to_numpy()[by_id], phrase[order], node[order], pc.list_flatten(t["times"]).to_numpy()[order]


def _highest(nodes: np.ndarray, score: np.ndarray, limit: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` nodes with the highest scores (to nine digits), in order, equal ones by smaller node; those below ``least`` may be left out."""
    if least > -np.inf:
        kept = np.flatnonzero(score >= least)
        nodes, score = nodes[kept], score[kept]
    if len(score) > limit:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - limit)[len(score) - limit] - 2e-9)
        nodes, score = nodes[kept], score[kept]
    order = np.lexsort((nodes, -np.rint(score * 1e9)))[:limit]
    return nodes[order], score[order]


def _best_of_all(at: str, n: int, average: float, limit: int, blend: float):
    """A function of batches of queries (p, qids): qids, id, score, place of the ``limit`` best nodes of each.

    The phrases of a query are taken from the most frequent to the rarest and the queries
    in the order of these sequences, so what queries have in common at the start is summed
    once.  A further phrase raises only its own nodes, so the best after it are among
    these and the best before it; nodes below the best so far of all queries that have
    the sequence in common aren't ordered.
    """

    def best(batches):
        asked = list(batches)
        if not asked:
            return
        asked = pa.Table.from_batches(asked).combine_chunks()
        phrases, counted = _numbered(f"{at}/phrases"), shared_table(f"{at}/df").to_table()
        df, idf = np.zeros(len(phrases), np.int64), np.zeros(len(phrases))
        df[counted["phrase"].to_numpy()] = counted["df"].to_numpy()
        log = np.log((n - df + 0.5) / (df + 0.5))
        idf = np.where(log <= 0, 1e-6, log)
        frequent = np.empty(len(phrases), np.int64)
        frequent[np.argsort(-df, kind="stable")] = np.arange(len(phrases))
        size = pc.list_value_length(asked["p"]).to_numpy()
        wanted = pc.index_in(pc.list_flatten(asked["p"]), phrases).to_numpy()
        # Of each query the distinct phrases that any node has, and how often it has them.
        pairs, times = np.unique(np.repeat(np.arange(len(asked)), size) * len(phrases) + wanted, return_counts=True)
        query, wanted = np.divmod(pairs, len(phrases))
        order = np.lexsort((frequent[wanted], query))
        order = order[df[wanted[order]] > 0]
        starts = np.searchsorted(query[order], np.arange(len(asked) + 1))
        steps = list(zip(frequent[wanted[order]].tolist(), times[order].tolist(), wanted[order].tolist()))
        paths = sorted((steps[i:j], q) for q, (i, j) in enumerate(zip(starts[:-1], starts[1:])) if j > i)
        common = [0, *(next((d for d, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in itertools.pairwise(paths)), 0]
        ids, scores, counts = np.zeros((len(asked), limit), np.int64), np.full((len(asked), limit), -np.inf), np.zeros(len(asked), np.int64)
        none = (np.empty(0, np.int64), np.empty(0))
        for node_id, rank, length, phrase, node, f in _node_blocks(f"{at}/found"):
            weight = idf[phrase] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[node] / average))
            edges = np.searchsorted(phrase, np.arange(len(phrases) + 1)).tolist()
            bonus = blend * rank
            raised = weight + bonus[node]
            total, before, tops = np.zeros(len(node_id)), [], [none]
            # Of each step the least score that can still come out for any query that has the step in common.
            least, lows = [], []
            for k in range(len(paths) - 1, -1, -1):
                path, q = paths[k]
                own = scores[q, limit - 1] - 2e-9
                lows = [min(own, x) for x in lows[: common[k + 1]]] + [own] * (len(path) - common[k + 1])
                least.append(lows)
            least.reverse()
            for k, (path, q) in enumerate(paths):
                while len(before) > common[k]:
                    mine, old = before.pop()
                    total[mine] = old
                    tops.pop()
                found = tops[-1]
                for d in range(common[k], len(path)):
                    _, often, wanted_ = path[d]
                    lo, hi = edges[wanted_], edges[wanted_ + 1]
                    mine, old = node[lo:hi], total[node[lo:hi]]
                    score = old + (raised[lo:hi] if often == 1 else weight[lo:hi] * often + bonus[mine])
                    had, value = found
                    if len(had) and len(mine):
                        same = mine[np.minimum(np.searchsorted(mine, had), len(mine) - 1)] != had
                        had, value = had[same], value[same]
                    last = d + 1 == len(path)
                    if len(mine):
                        mine_best = _highest(mine, score, limit, least[k][d])
                        found = _highest(np.concatenate([had, mine_best[0]]), np.concatenate([value, mine_best[1]]), limit) if len(had) else mine_best
                    if not last or common[k + 1] == len(path):
                        total[mine] = old + (weight[lo:hi] if often == 1 else weight[lo:hi] * often)
                        before.append((mine, old))
                        tops.append(found)
                had, value = found
                have = counts[q]
                if len(had) and value[0] >= scores[q, limit - 1] - 2e-9:
                    own, score = np.concatenate([ids[q, :have], node_id[had]]), np.concatenate([scores[q, :have], value])
                    own, score = _highest(own, score, limit)
                    counts[q] = len(own)
                    ids[q, : len(own)], scores[q, : len(own)] = own, score
        q, place = np.nonzero(np.arange(limit) < counts[:, None])
        for a in range(0, len(q), 10_000):
            r, c = q[a : a + 10_000], place[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([asked["qids"].combine_chunks().take(pa.array(r)), pa.array(ids[r, c]), pa.array(-scores[r, c]), pa.array((c + 1).astype(np.int32))], ["qids", "id", "score", "place"])

    return best


def finite_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """node_id, vec of distinct rows with ``dim`` finite numbers."""
    bad = [F.lit(float(x)).cast("float") for x in ("nan", "inf", "-inf")]
    return vectors.filter((F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~x.isin(*bad))).select("node_id", "vec").distinct()


def semantic(queries: DataFrame, vectors: DataFrame, limit: int = 50) -> DataFrame:
    """qid, id, score, place: the nodes whose vectors have the largest cosine with each query vector (qid, qvec).

    Exact for any number of queries: blocks of query vectors meet blocks of vectors, each
    meeting is a task that gives the ``limit`` best of its block for each of its queries,
    and these are merged.  All vectors have one length.  Equal cosines: larger id.
    """
    blocks = {"q": max(1, -(-queries.count() // QUERY_BLOCK)), "v": max(1, -(-vectors.count() // VECTOR_BLOCK))}

    def side(df: DataFrame, key: str, vec: str, own: str, other: str) -> DataFrame:
        """The rows in the block of their own side, once for each block of the other."""
        block = F.pmod(F.xxhash64(key, vec), F.lit(blocks[own])).cast("int").alias(own)
        rows = df.select(F.lit(own).alias("side"), F.col(key).alias("key"), F.col(vec).alias("vec"), block)
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))).select("side", "key", "vec", "q", "v")

    def best(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()

        def part(name: str) -> tuple[np.ndarray, np.ndarray]:
            t = group.filter(pc.equal(group["side"], name)).combine_chunks()
            x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) if len(t) else np.empty((0, 0))
            size = np.linalg.norm(x, axis=1)
            return t["key"].to_numpy(), x / np.where(size == 0, 1, size)[:, None]

        (qid, q), (ids, x) = part("q"), part("v")
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(qid) if len(ids) else 0, 128):
            sims = q[at : at + 128] @ x.T
            last = -np.partition(-sims, limit - 1, axis=1)[:, limit - 1] if len(ids) > limit else np.full(len(sims), -2.0)
            row, col = np.nonzero(sims >= last[:, None] - 2e-9)
            score = np.round(sims[row, col], 9)
            order = np.lexsort((-ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < limit
            found.append((qid[at + row[kept]], ids[col[kept]], score[kept]))
        return pa.table([np.concatenate(c) for c in zip(*found)], ["qid", "id", "score"])

    vectors = vectors.filter("node_id IS NOT NULL")
    meetings = side(queries, "qid", "qvec", "q", "v").unionByName(side(vectors, "node_id", "vec", "v", "q"))
    scores = meetings.repartition(blocks["q"] * blocks["v"], "q", "v").groupBy("q", "v").applyInArrow(best, "qid long, id long, score double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").desc()))
    return scores.withColumn("place", place).filter(F.col("place") <= limit)


def fuse(lexical: DataFrame, vector: DataFrame, limit: int = 12, k: int = 60) -> DataFrame:
    """qid, id, rrf, place: reciprocal-rank fusion of two ranked lists (qid, id, place); equal sums in lexical, then vector order."""
    a = lexical.select("qid", "id", F.col("place").alias("lp"))
    b = vector.select("qid", "id", F.col("place").alias("vp"))
    both = a.join(b, ["qid", "id"], "full")
    rrf = F.coalesce(1 / (F.lit(k) + F.col("lp")), F.lit(0.0)) + F.coalesce(1 / (F.lit(k) + F.col("vp")), F.lit(0.0))
    both = both.withColumn("rrf", rrf)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), F.coalesce("lp", F.lit(10**9)), "vp"))
    return both.withColumn("place", place).filter(F.col("place") <= limit).select("qid", "id", "rrf", "place")


def _prefix(partition: list[str], order: list[Column], size: Column) -> Column:
    return F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def within_budget(lines: DataFrame, partition: list[str], order: str, budget: int, line: str = "line", extra: int = 1) -> DataFrame:
    """The lines of each partition, in order, up to the first that exceeds the budget of characters.

    A line has one character at least with its end, so the first ``budget`` lines are all
    that can count; they are cut by a top-n before the running sum, which bounds it.
    """
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(order))
    short = lines.withColumn("__place", place).filter(F.col("__place") <= budget)
    total = _prefix(partition, [F.col("__place")], F.length(line) + extra)
    return short.withColumn("__sum", total).filter(F.col("__sum") <= budget).drop("__place", "__sum")


def priorities(pairs: DataFrame, nodes: DataFrame, usage: DataFrame, decay: float = 1.0) -> DataFrame:
    """pairs (with id, weight) and the priority and line of each neighbour."""
    n = nodes.select("id", "rank", "kind", "qualified_name", "file_path", "line_start", "summary", "signature").withColumnRenamed("kind", "node_kind")
    rows = pairs.withColumnRenamed("kind", "edge").join(n, "id").join(usage.select(F.col("node_id").alias("id"), "uses"), "id", "left")
    prio = F.col("weight") * (0.5 + F.col("rank")) * decay * fn.usage_boost(F.col("uses"))
    rel = F.when(F.col("dir") == "out", F.col("edge")).otherwise(F.concat("edge", F.lit("-by")))
    line = fn.node_line(F.concat(F.lit("["), rel, F.lit("] ")))
    return rows.withColumnRenamed("node_kind", "kind").withColumn("prio", F.round(prio, 9)).withColumn("line", line)


def best_edges(pairs: DataFrame, nodes: DataFrame, usage: DataFrame, budget: int, decay: float = 1.0) -> DataFrame:
    """seed, n, id, prio, line: each neighbour of a seed once, by its best edge, in order of priority, as many as can count.

    Equal priorities: out edges first, then kind, then id.  Taken in this order, nodes whose
    lines without the kind of edge exceed the budget can't come out, whatever stands
    between them, and a line has one character at least.
    """
    rows = priorities(pairs, nodes, usage, decay).filter("id <> seed")
    first = F.struct((-F.col("prio")).alias("p"), (F.col("dir") != "out").alias("back"), "edge", "line", (F.length("line") - F.length("edge") - F.when(F.col("dir") == "out", 0).otherwise(3)).alias("size"))
    one = rows.groupBy("seed", "id").agg(F.min(first).alias("e"))
    order = [F.col("e.p"), F.col("e.back"), F.col("e.edge"), F.col("id")]
    placed = one.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).filter(F.col("n") <= budget)
    before = _prefix(["seed"], [F.col("n")], F.col("e.size")) - F.col("e.size")
    return placed.withColumn("__before", before).filter(F.col("__before") <= budget).select("seed", "n", "id", (-F.col("e.p")).alias("prio"), F.col("e.line").alias("line"))


def direct_context(pairs: DataFrame, nodes: DataFrame, usage: DataFrame, budget: int = 8000) -> DataFrame:
    """seed, place, id, line: the neighbours of each seed by priority, as many lines as fit the budget.

    A neighbour joined by several edges comes once, by its best; equal priorities: out
    edges first, then kind, then id.
    """
    placed = best_edges(pairs, nodes, usage, budget).select("seed", F.col("n").alias("place"), "id", "line")
    return within_budget(placed, ["seed"], "place", budget - 40)


def headers(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """seed, head: the line of each seed, its signature where it has one, and an empty line."""
    n = seeds.join(nodes.withColumn("seed", F.col("id")), "seed")
    signature = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("declared: "), "signature", F.lit("\n"))).otherwise("")
    return n.select("seed", F.concat(fn.node_line(F.lit("")), F.lit("\n"), signature, F.lit("\n")).alias("head"))


def arranged(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, usage: DataFrame, neighbours, budget: int) -> DataFrame:
    """seed, at, hop, via, id, line: what a best-first walk over two hops would take from each seed, in its order.

    A walk that always takes the waiting node of the highest priority, and lets a taken
    neighbour of the seed put its own neighbours into the queue with 0.6 of their
    priority, takes a neighbour at its own priority, and what it lets in at once where
    that has a higher one, else at that one's priority, after the seed's neighbours as
    good.  So the order follows from columns; what a node that was taken before would let
    in is for the reader of the rows to leave out.
    """
    first = best_edges(neighbours(seeds, nodes, edges), nodes, usage, budget)
    hop = neighbours(first.select(F.col("id").alias("seed")).distinct(), nodes, edges)
    second = best_edges(hop, nodes, usage, budget, 0.6).select(F.col("seed").alias("via"), F.col("n").alias("m"), F.col("id").alias("child"), F.col("prio").alias("p2"), F.col("line").alias("line2"))
    own = first.select("seed", F.lit(1).alias("hop"), F.lit(None).cast("long").alias("via"), "id", "line", F.col("prio").alias("k1"), F.lit(0).alias("k2"), F.col("n").alias("k3"), F.lit(-1e300).alias("k4"), F.lit(0).alias("k5"))
    let = first.select("seed", F.col("id").alias("via"), "n", "prio").join(second, "via").filter("child <> seed")
    lazy = F.col("p2") <= F.col("prio")
    let = let.select("seed", F.lit(2).alias("hop"), "via", F.col("child").alias("id"), F.col("line2").alias("line"), F.least("prio", "p2").alias("k1"), lazy.cast("int").alias("k2"), F.col("n").alias("k3"), F.when(lazy, 0.0).otherwise(-F.col("p2")).alias("k4"), F.col("m").alias("k5"))
    order = Window.partitionBy("seed").orderBy(F.col("k1").desc(), "k2", "k3", "k4", "k5")
    return own.unionByName(let).select("seed", F.row_number().over(order).alias("at"), "hop", "via", "id", "line")


def context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, usage: DataFrame, neighbours, budget: int = 8000) -> DataFrame:
    """seed, place, id, depth, line: best-first expansion over two hops within a budget of characters.

    Neighbours are taken by priority; one taken at the first hop lets in its own, which
    don't let in others; a node comes once; the first line that doesn't fit ends it.  The
    seed's own lines (see ``headers``) count, too.  Spark orders all rows of a seed (see
    ``arranged``); what depends on the rows before, which of them are new and fit, is one
    pass over the rows of a seed, which the budget bounds.
    """
    rows = arranged(seeds, nodes, edges, usage, neighbours, budget).join(headers(seeds, nodes).select("seed", F.length("head").alias("used")), "seed")

    def take(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        room, taken, opened, kept = budget - 40 - group["used"][0].as_py(), {group["seed"][0].as_py()}, {None}, []
        for at, (hop, via, node, size) in enumerate(zip(*(c.to_pylist() for c in (group["hop"], group["via"], group["id"], pc.utf8_length(group["line"]))))):
            if node in taken or via not in opened:
                continue
            room -= size + 1
            if room < 0:
                break
            taken.add(node)
            kept.append(at)
            if hop == 1:
                opened.add(node)
        out = group.take(pa.array(kept, pa.int64()))
        return pa.table([out["seed"], pa.array(range(1, len(kept) + 1), pa.int32()), out["id"], out["hop"], out["line"]], ["seed", "place", "id", "depth", "line"])

    return rows.groupBy("seed").applyInArrow(take, "seed long, place int, id long, depth int, line string")


def context_text(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, usage: DataFrame, refs: DataFrame, neighbours, budget: int = 8000, unresolved: int = 10) -> DataFrame:
    """seed, text: the answer about each seed: its own lines, its context, and the first names it refers to, if they fit as well."""
    lines = context(seeds, nodes, edges, usage, neighbours, budget)
    body = lines.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: F.concat(x.line, F.lit("\n"))), "").alias("body"))
    names = refs.filter("target_name IS NOT NULL AND target_name <> ''").select(F.col("source_id").alias("seed"), "target_name").join(seeds, "seed", "left_semi").distinct()
    first = names.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("target_name"))).filter(F.col("k") <= unresolved)
    tails = first.groupBy("seed").agg(F.concat(F.lit("refers to: "), F.array_join(F.array_sort(F.collect_list("target_name")), ", "), F.lit("\n")).alias("tail"))
    all_ = headers(seeds, nodes).join(body, "seed", "left").join(tails, "seed", "left")
    text = F.concat("head", F.coalesce("body", F.lit("")))
    return all_.select("seed", F.concat(text, F.when(F.length(text) + F.length("tail") <= budget, F.col("tail")).otherwise("")).alias("text"))


def overview(nodes: DataFrame, top: DataFrame, groups: DataFrame, budget: int = 8000) -> DataFrame:
    """pos, line: counts, key symbols, subsystems and files by top folder, as many lines as fit the budget.

    groups: community, size, place, file_path, summary.  The counts are an aggregate of the
    plan, so nothing runs before the result is asked for.
    """
    spark = nodes.sparkSession
    about = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" — "), c)).otherwise("")
    counts = nodes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "file", 1)).alias("files"))
    counts = counts.select(F.lit("0").alias("pos"), F.concat(F.lit("# Graph of "), "n", F.lit(" nodes in "), "files", F.lit(" files")).alias("line"))
    key = F.lpad(F.row_number().over(Window.orderBy(F.col("rank").desc(), "id")).cast("string"), 6, "0")
    symbols = top.select(F.concat(F.lit("1-"), key).alias("pos"), fn.node_line(F.lit("- ")).alias("line"))
    lead = F.max(F.when(F.col("place") == 1, F.col("summary"))).alias("lead")
    per = groups.groupBy("community", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: x.file_path), ", ").alias("names"), F.count(F.lit(1)).alias("shown"), lead)
    more = F.when(F.col("size") > F.col("shown"), F.concat(F.lit(" and "), F.col("size") - F.col("shown"), F.lit(" more"))).otherwise("")
    order = F.lpad(F.row_number().over(Window.orderBy(F.col("size").desc(), "community")).cast("string"), 6, "0")
    subs = per.select(F.concat(F.lit("3-"), order).alias("pos"), F.concat(F.lit("- "), "size", F.lit(" files: "), "names", more, about(F.col("lead"))).alias("line"))
    heads = [("1-", "## Most important symbols"), ("3-", "## Groups of files"), ("5-", "## All files")]
    folder = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise(".")
    listed = nodes.filter("kind = 'file'").select(folder.alias("folder"), "file_path", "repo", "id", "summary")
    titles = listed.select("folder").distinct().select(F.concat(F.lit("6-"), "folder").alias("pos"), F.concat(F.lit("### "), "folder", F.lit("/")).alias("line"))
    paths = listed.select(F.concat(F.lit("6-"), "folder", F.lit("\u0001"), "file_path", F.lit("\u0001"), "repo").alias("pos"), F.concat(F.lit("- "), F.col("file_path"), about(F.col("summary"))).alias("line"))
    lines = spark.createDataFrame(heads, "pos string, line string").unionByName(counts).unionByName(symbols).unionByName(subs).unionByName(titles).unionByName(paths)
    # Lines beyond the budget can't count, so one ordered top-k bounds what the running sum sees.
    first = lines.orderBy("pos").limit(budget).withColumn("one", F.lit(1))
    return within_budget(first, ["one"], "pos", budget).select("pos", "line")


def search(queries: DataFrame, nodes: DataFrame, vectors: DataFrame, limit: int = 12) -> DataFrame:
    """qid, id, place of each query (qid, query, qvec): lexical and vector search fused where there are vectors, else lexical."""
    lexical = bm25(queries, nodes, limit if (plain := vectors.limit(1).isEmpty()) else 50)
    if plain:
        return lexical.select("qid", "id", "place")
    return fuse(lexical, semantic(queries.filter("qvec IS NOT NULL").select("qid", "qvec"), vectors, 50), limit).select("qid", "id", "place")


def impact_listed(reached: DataFrame, together: DataFrame, nodes: DataFrame, users: int = 20, tests: int = 10) -> DataFrame:
    """seed, section, place, id, line: what depends on a seed by (depth, rank, id), the first ``users``, the first ``tests`` of the tests, and the files that change with it.

    reached: seed, id, depth, is_test (see ``graph.impact``); together: seed, weight,
    file_path, place (see ``graph.cochanged``).
    """
    n = nodes.select("id", "rank", "kind", "qualified_name", "file_path", "line_start", "summary", "signature")
    section = F.when(F.col("is_test"), "tests").otherwise("users")
    rows = reached.withColumn("section", section).join(n, "id")
    place = F.row_number().over(Window.partitionBy("seed", "section").orderBy("depth", F.col("rank").desc(), "id"))
    rows = rows.withColumn("place", place).filter(((F.col("section") == "users") & (F.col("place") <= users)) | ((F.col("section") == "tests") & (F.col("place") <= tests)))
    rows = rows.select("seed", "section", "place", "id", fn.node_line(F.concat(F.lit("["), "depth", F.lit("] "))).alias("line"))
    line = F.concat(F.lit("["), F.round("weight", 2), F.lit("] "), F.col("file_path"))
    return rows.unionByName(together.select("seed", F.lit("together").alias("section"), "place", F.lit(None).cast("long").alias("id"), line.alias("line")))


def impact_text(listed: DataFrame, seeds: DataFrame, nodes: DataFrame, budget: int = 6000) -> DataFrame:
    """seed, text: the sections of ``impact_listed`` under the seed's line, as many lines as fit the budget."""
    number = F.when(F.col("section") == "users", 1).when(F.col("section") == "tests", 2).otherwise(3)
    title = F.when(F.col("section") == "users", "used by:").when(F.col("section") == "tests", "tested by:").otherwise("changes with:")
    rows = listed.select("seed", number.alias("s"), F.col("place").alias("p"), "line")
    rows = rows.unionByName(listed.select("seed", number.alias("s"), F.lit(0).alias("p"), title.alias("line")).distinct())
    head = seeds.join(nodes.withColumn("seed", F.col("id")), "seed").select("seed", F.lit(0).alias("s"), F.lit(0).alias("p"), fn.node_line(F.lit("")).alias("line"))
    kept = within_budget(rows.unionByName(head).withColumn("o", F.struct("s", "p")), ["seed"], "o", budget)
    return kept.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x.line), "\n").alias("text"))


def ranked_files(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, repo, file_path, pos: ranked nodes (qid, id, place) as ranked files, each file at its first place, from 1."""
    f = hits.join(nodes.select("id", "repo", "file_path"), "id").groupBy("qid", "repo", "file_path").agg(F.min("place").alias("place"))
    return f.select("qid", "repo", "file_path", F.row_number().over(Window.partitionBy("qid").orderBy("place")).alias("pos"))


def expanded_files(hits: DataFrame, nodes: DataFrame, edges: DataFrame, neighbours, top: int = 5) -> DataFrame:
    """qid, repo, file_path, pos: ranked files, then the files of the neighbours of the ``top`` best hits by summed w * (0.5 + rank)."""
    direct = ranked_files(hits, nodes)
    best = hits.filter(F.col("place") <= top)
    near = neighbours(best.select(F.col("id").alias("seed")).distinct(), nodes, edges)
    n = nodes.select("id", "repo", "file_path", "rank")
    scored = best.select("qid", F.col("id").alias("seed")).join(near, "seed").join(n, "id").groupBy("qid", "repo", "file_path").agg(F.sum(F.col("weight") * (0.5 + F.col("rank"))).alias("s"))
    new = scored.join(direct.select("qid", "repo", "file_path"), ["qid", "repo", "file_path"], "left_anti")
    last = direct.groupBy("qid").agg(F.max("pos").alias("last"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "repo", "file_path"))
    more = new.withColumn("k", order).join(last, "qid").select("qid", "repo", "file_path", (F.col("last") + F.col("k")).alias("pos"))
    return direct.unionByName(more)


def metrics(ranked: DataFrame, tasks: DataFrame) -> DataFrame:
    """n_tasks, hit5, hit10, mrr: where the gold file (qid, repo, file_path) of each task stands among its ranked files."""
    first = tasks.join(ranked, ["qid", "repo", "file_path"]).groupBy("qid").agg(F.min("pos").alias("first"))
    all_ = tasks.select("qid").distinct().join(first, "qid", "left")
    share = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 3)
    return all_.agg(F.count(F.lit(1)).alias("n_tasks"), share(5).alias("hit5"), share(10).alias("hit10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3).alias("mrr"))


def mean_tokens(ranked: DataFrame, tasks: DataFrame) -> DataFrame:
    """tokens: what the listed files of a task cost on the average, at a quarter of the characters."""
    each = ranked.groupBy("qid").agg(F.floor(F.sum(F.length("file_path") + 1) / 4).alias("t"))
    return tasks.select("qid").distinct().join(each, "qid", "left").agg(F.round(F.avg(F.coalesce("t", F.lit(0))), 1).alias("tokens"))


def metrics_by_repository(ranked: DataFrame, tasks: DataFrame) -> DataFrame:
    """repo, n_tasks, hit5, hit10, mrr: the metrics for the tasks of each repository."""
    first = tasks.join(ranked, ["qid", "repo", "file_path"]).groupBy("qid", "repo").agg(F.min("pos").alias("first"))
    all_ = tasks.select("qid", "repo").distinct().join(first, ["qid", "repo"], "left")
    share = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 3)
    return all_.groupBy("repo").agg(F.count(F.lit(1)).alias("n_tasks"), share(5).alias("hit5"), share(10).alias("hit10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3).alias("mrr"))
