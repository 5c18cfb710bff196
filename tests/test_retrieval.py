"""Search, context and rendering against SQLite's full-text index and hand-built cases."""

import heapq
import json
import random
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.operators import graph, retrieval
from codeweft.plans import retrieval as plans
from tests.test_graph import edges_of, node, nodes_of


def test_bm25_equals_sqlite(spark):
    texts = [("parse_file", "pkg.parse_file", "reads a file and parses it"), ("check_token", "auth.check_token", "checks the token of a café"), ("token", "auth.token", "token token"), ("walk", "pkg.walk", ""), ("file", "pkg.file", "parse the file file")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, qualified_name, summary)")
    db.executemany("INSERT INTO t(rowid, name, qualified_name, summary) VALUES (?,?,?,?)", [(k, *x) for k, x in enumerate(texts, 1)])
    n = nodes_of(spark, [node(k, name=a, qname=b, summary=c, rank=0.1 * k) for k, (a, b, c) in enumerate(texts, 1)])
    asked = ["check_token", "parse file", "file file cafe", "nothing here", "token"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    got = {}
    for r in retrieval.bm25(q, n, 10, 0.0).collect():
        got.setdefault(r["qid"], {})[r["id"]] = r["score"]
    for k, text in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in text.split())
        want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        assert got.get(k, {}).keys() == want.keys()
        assert all(abs(got[k][i] - want[i]) < 1e-9 for i in want)
    blended = retrieval.bm25(q.filter("qid = 4"), n, 1).first()
    assert blended["place"] == 1


def test_semantic_ties_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "node_id long, vec array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<float>")
    got = [r["id"] for r in retrieval.semantic(q, v).orderBy("place").collect()]
    assert got == [3, 1, 4, 2]  # equal cosines: the larger id; a zero vector scores 0
    lexical = spark.createDataFrame([(7, 2, 1), (7, 9, 2)], "qid long, id long, place int")
    fused = [r["id"] for r in retrieval.fuse(lexical, retrieval.semantic(q, v)).orderBy("place").collect()]
    assert fused[0] == 2 and set(fused) == {1, 2, 3, 4, 9}


def test_semantic_takes_any_number_of_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (1500, 4)).astype("float32")  # many equal cosines and some zeros
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "node_id long, vec array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 500)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 400)
    got = {}
    for r in retrieval.semantic(v.filter("node_id < 1100").selectExpr("node_id AS qid", "vec AS qvec"), v, 7).collect():
        got.setdefault(r["qid"], {})[r["place"]] = (r["score"], r["id"])
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-9)[:, None]
    sims = np.round(unit[:1100] @ unit.T, 9)
    assert len(got) == 1100
    for q, places in got.items():
        order = np.lexsort((-np.arange(1500), -sims[q]))[:7]
        assert [places[k + 1][1] for k in range(7)] == order.tolist()


def test_context_expands_through_strong_parents_only(spark):
    n = graph.clean_nodes(nodes_of(spark, [node(1, rank=0.2), node(2, rank=0.9), node(3, rank=0.1), node(4, rank=1.0), node(5, rank=0.5)]))
    e = edges_of(spark, [(1, 2, "calls", 1.0), (1, 3, "calls", 1.0), (2, 4, "calls", 1.0), (4, 5, "calls", 1.0), (3, 1, "calls", 1.0)])
    use = spark.createDataFrame([(3, 4)], "node_id long, uses long")
    seeds = spark.createDataFrame([(1,)], "seed long")
    got = [(r["id"], r["depth"]) for r in retrieval.context(seeds, n, e, use, graph.neighbours).orderBy("place").collect()]
    assert got == [(2, 1), (4, 2), (3, 1)]  # 5 is three hops away
    direct = retrieval.direct_context(graph.neighbours(seeds, n, e), n, use).orderBy("place").collect()
    assert [r["id"] for r in direct] == [2, 3] and direct[0]["line"].startswith("[calls] function n2 — a.py:1")
    assert retrieval.context(seeds, n, e, use, graph.neighbours, budget=90).count() <= 1


def plain_walk(seed, near, prio, line, room):
    """The best-first walk with a queue, for one seed."""
    heap, k, taken, out = [], 0, {seed}, []
    for b in near(seed, 1.0):
        k += 1
        heapq.heappush(heap, (-prio(b, 1.0), k, 1, b))
    while heap:
        _, _, hop, b = heapq.heappop(heap)
        if b[-1] in taken:
            continue
        room -= len(line(b)) + 1
        if room < 0:
            break
        taken.add(b[-1])
        out.append((b[-1], hop))
        for c in near(b[-1], 0.6) if hop == 1 else ():
            k += 1
            heapq.heappush(heap, (-prio(c, 0.6), k, 2, c))
    return out


def test_context_equals_a_walk_with_a_queue(spark):
    """Six kinds of edges to each node, ties and loops: the order of a queue, and the budget is filled."""
    rng = random.Random(9)
    kinds = ["calls", "imports", "inherits", "contains", "co_changes", "reads"]
    n = [node(k, rank=rng.choice([0.0, 0.1, 0.5, 1.0]), name=f"n{k}", qname=f"pkg.n{k}") for k in range(1, 90)]
    e = {(a, b, kind): rng.choice([0.2, 0.5, 1.0]) for a in range(1, 90) for b in rng.sample(range(1, 90), 3) for kind in rng.sample(kinds, 2)}
    e |= {(1, b, kind): 1.0 for b in range(2, 60) for kind in kinds}
    nodes, edges = graph.clean_nodes(nodes_of(spark, n)), edges_of(spark, [(*k, w) for k, w in e.items()])
    use = spark.createDataFrame([(3, 4)], "node_id long, uses long")
    rank = {r["id"]: r["rank"] for r in nodes.collect()}
    lines = {r["id"]: r["line"] for r in nodes.select("id", fn.node_line(F.lit("")).alias("line")).collect()}
    arcs = [(a, "out", kind, w, b) for (a, b, kind), w in e.items()] + [(b, "in", kind, w, a) for (a, b, kind), w in e.items()]
    prio = lambda x, d: round(x[3] * (0.5 + rank[x[4]]) * d * (1.4 if x[4] == 3 else 1.0), 9)
    line = lambda x: f"[{x[2] + ('-by' if x[1] == 'in' else '')}] {lines[x[4]]}"
    near = lambda s, d: sorted((x for x in arcs if x[0] == s and x[4] != s), key=lambda x: (-prio(x, d), x[1] != "out", x[2], x[4]))
    for budget in (900, 2500, 100_000):
        got = retrieval.context(spark.createDataFrame([(1,), (2,), (70,)], "seed long"), nodes, edges, use, graph.neighbours, budget)
        heads = {r["seed"]: len(r["head"]) for r in retrieval.headers(spark.createDataFrame([(1,), (2,), (70,)], "seed long"), nodes).collect()}
        rows = got.orderBy("seed", "place").collect()
        for seed in (1, 2, 70):
            mine = [(r["id"], r["depth"]) for r in rows if r["seed"] == seed]
            assert mine == plain_walk(seed, near, prio, line, budget - 40 - heads[seed]), (seed, budget)
    used = sum(len(r["line"]) + 1 for r in retrieval.context(spark.createDataFrame([(1,)], "seed long"), nodes, edges, use, graph.neighbours, 2500).collect())
    assert used > 2500 - 40 - 120


def test_the_answer_about_a_node(spark):
    n = graph.clean_nodes(nodes_of(spark, [node(1, rank=0.2), node(2, rank=0.9)]))
    refs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None)], "source_id long, target_name string")
    use = spark.createDataFrame([], "node_id long, uses long")
    ask = lambda budget: retrieval.context_text(spark.createDataFrame([(1,)], "seed long"), n, edges_of(spark, [(1, 2, "calls", 1.0)]), use, refs, graph.neighbours, budget).first()["text"]
    assert ask(8000).startswith("function n1 — a.py:1") and "[calls] function n2" in ask(8000) and ask(8000).endswith("refers to: a, b\n")
    assert "refers to" not in ask(30)


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "b" * 20), (3, "c")], "k int, line string").withColumn("g", F.lit(1))
    assert [r["k"] for r in retrieval.within_budget(df, ["g"], "k", 10).collect()] == [1]


def test_metrics_and_expansion(spark):
    n = nodes_of(spark, [node(1, path="a.py"), node(2, path="b.py", rank=1.0), node(3, path="a.py")])
    hits = spark.createDataFrame([(1, 1, 1), (1, 3, 2)], "qid long, id long, place int")
    e = edges_of(spark, [(1, 2, "calls", 1.0)])
    ranked = retrieval.expanded_files(hits, n, e, graph.neighbours)
    assert sorted((r["file_path"], r["pos"]) for r in ranked.collect()) == [("a.py", 1), ("b.py", 2)]
    tasks = spark.createDataFrame([(1, "r", "b.py"), (2, "r", "a.py")], "qid long, repo string, file_path string")
    assert tuple(retrieval.metrics(ranked, tasks).first()) == (2, 0.5, 0.5, 0.25)


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(fn.token_estimate(F.lit("abcdefghi"))) == 2
    assert val(fn.tokens(F.lit("Café check_token parseHTTP"))) == ["cafe", "check", "token", "parsehttp"]
    assert val(fn.module_name(F.lit("pkg/a.b/c.py"))) == "pkg.a.b.c"
    assert val(fn.import_root(F.lit('"os.path"'), F.lit("python"))) == "os"
    assert val(fn.csv_schema(F.lit("id,name\n1,2"))) == "Table with the columns id,name" and val(fn.csv_schema(F.lit("x\n1,2"))) is None
    assert val(fn.sql_schema(F.lit("create table if not exists `users` (a int); CREATE TABLE b(x)"))) == "Script that creates the tables users, b"
    assert val(fn.issue_query(F.lit("see\n```\ncode\n```\nhere now"), 2)) == "see here"
    assert val(fn.issue_query(F.lit("see\n```\ncode\n```\nhere now"), 250, " [code] ")) == "see [code] here now"
    assert val(fn.patch_files(F.lit("diff --git a/x.py b/x.py\n+1\ndiff --git a/y.py b/y.py"))) == ["x.py", "y.py"]
    assert val(fn.reply_files(F.lit('no [1 then ["./a.py", "b.py"] done'))) == ["a.py", "b.py"]
    assert val(fn.reply_summaries(F.lit('x [{"id": 3, "summary": "s"}] y')))[0]["id"] == 3
    assert val(fn.clean_summary(F.lit("  \n"))) is None and len(val(fn.clean_summary(F.lit("a" * 400)))) == 300
    assert val(fn.usage_boost(F.lit(9))) == 1.5


def test_graph_lines_are_json(spark):
    n = nodes_of(spark, [node(1)])
    assert json.loads(graph.graph_json(n, edges_of(spark, [])).first()["json"])["data"]["id"] == "1"


def test_impact_is_listed_by_depth_and_capped(spark):
    rows = [node(1), *[node(k, rank=k / 100) for k in range(2, 32)], node(40, path="tests/t.py")]
    n = graph.clean_nodes(nodes_of(spark, rows))
    e = edges_of(spark, [(k, 1, "calls", 1.0) for k in range(2, 30)] + [(31, 2, "calls", 1.0), (40, 1, "calls", 1.0)])
    seeds = spark.createDataFrame([(1,)], "seed long")
    listed = retrieval.impact_listed(graph.impact(seeds, n, e), graph.cochanged(seeds, n, e), n)
    users = [r["id"] for r in listed.filter("section = 'users'").orderBy("place").collect()]
    assert users == list(range(29, 9, -1)) and [r["id"] for r in listed.filter("section = 'tests'").collect()] == [40]
    text = retrieval.impact_text(listed, seeds, n).first()["text"].split("\n")
    assert text[0].startswith("function n1") and text[1] == "used by:" and text[-2] == "tested by:" and len(text) == 24
    assert len(retrieval.impact_text(listed, seeds, n, 100).first()["text"]) <= 100


def test_search_is_lexical_where_there_are_no_vectors(spark):
    n = graph.clean_nodes(nodes_of(spark, [node(1, name="walk_tree"), node(2, name="other")]))
    q = spark.createDataFrame([(7, "walk", [1.0, 0.0])], "qid long, query string, qvec array<float>")
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "node_id long, vec array<float>")
    assert [r["id"] for r in retrieval.search(q, n, v.limit(0)).collect()] == [1]
    assert {r["id"] for r in retrieval.search(q, n, v).collect()} == {1, 2}


def test_rates_and_tokens_of_repositories(spark):
    ranked = spark.createDataFrame([(1, "r", "abc", 1), (1, "r", "b", 2), (2, "s", "b", 1)], "qid long, repo string, file_path string, pos int")
    tasks = spark.createDataFrame([(1, "r", "b"), (2, "s", "c"), (3, "s", "c")], "qid long, repo string, file_path string")
    assert {r["repo"]: (r["n_tasks"], r["mrr"]) for r in retrieval.metrics_by_repository(ranked, tasks).collect()} == {"r": (1, 0.5), "s": (2, 0.0)}
    assert retrieval.mean_tokens(ranked, tasks).first()["tokens"] == 0.3


def shuffled(spark):
    """Bytes written for exchanges so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_bm25_copies_no_nodes_for_blocks_of_queries(spark, monkeypatch):
    n = graph.clean_nodes(nodes_of(spark, [node(k, name=f"walk_tree_{k % 40}", summary=f"walks the tree {k % 97} and more") for k in range(1, 2001)])).cache()
    q = spark.createDataFrame([(k, f"walk tree {k % 97}" + " more" * (k % 3)) for k in range(120)], "qid long, query string").cache()
    assert n.count() == 2000 and q.count() == 120
    took, rows = {}, {}
    for block in (1000, 8):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "NODE_BLOCK", 300)
        at = shuffled(spark)
        rows[block] = sorted((r["qid"], r["place"], r["id"], round(r["score"], 9)) for r in retrieval.bm25(q, n).collect())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        took[block] = shuffled(spark) - at
    assert rows[8] == rows[1000] and len(rows[8]) == 120 * 12
    assert took[8] < 2 * took[1000]


def test_bm25_gives_the_smallest_ids_of_very_many_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "NODE_BLOCK", 700)
    n = nodes_of(spark, [node(k, name="fix", summary="one more fix", rank=0.5) for k in range(5000, 0, -1)]).cache()
    q = spark.createDataFrame([(k, "fix more") for k in range(300)] + [(300, "fix"), (300, "more")], "qid long, query string").cache()
    assert n.count() == 5000 and q.count() == 302
    at = shuffled(spark)
    rows = retrieval.bm25(q, n, blend=0.0).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert {q: [r["id"] for r in sorted(rows, key=lambda r: r["place"]) if r["qid"] == q] for q in (0, 299, 300)} == dict.fromkeys((0, 299, 300), list(range(1, 13)))
    assert len(rows) == 301 * 12 and shuffled(spark) - at < 50_000


def test_bm25_orders_no_nodes_below_the_best_so_far(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "NODE_BLOCK", 200)
    n = nodes_of(spark, [node(k, name=f"walk_tree_{k % 5}") for k in range(1, 2001)])
    q = spark.createDataFrame([(k, f"walk tree {k}") for k in range(5)], "qid long, query string")
    asked, at, count, mean = retrieval.indexed(q, n)
    highest, ordered = retrieval._highest, []

    def counted(nodes, score, limit, least=-np.inf):
        ordered.append(int((score >= least).sum()))
        return highest(nodes, score, limit, least)

    monkeypatch.setattr(retrieval, "_highest", counted)
    got = [r for b in retrieval._best_of_all(at, count, mean, 12, 0.0)(iter(asked.toArrow().to_batches())) for r in b.to_pylist()]
    for k in range(5):
        assert [r["id"] for r in got if r["qids"][0]["qid"] == k] == [i for i in range(1, 2001) if i % 5 == k][:12]
    assert sum(ordered) < 4500  # each query's own 400 nodes and the first block's


def exchanges(query, spark):
    return query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_the_plan_of_the_ladder_spans_one_rung(spark):
    assert exchanges(plans.localization, spark) == 0


def test_the_plan_of_rates_by_repository_holds_no_search(spark):
    assert exchanges(plans.localization_by_repository, spark) < 15


def test_the_plan_of_the_hybrid_search_reads_written_tables(spark):
    assert exchanges(plans.search_hybrid_fixed, spark) < 15
