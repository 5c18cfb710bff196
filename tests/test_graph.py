"""Graph operators against plain-Python models on small graphs."""

import json
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeweft.operators import graph, ranking, resolving
from codeweft.operators.hotkeys import key_load, latest_per_key

NODE = "id long, repo string, kind string, name string, qualified_name string, language string, file_path string, line_start int, line_end int, signature string, summary string, parse_error boolean, rank double, community long"


def node(i, kind="function", name=None, qname=None, path="a.py", rank=0.0, repo="r", lines=(1, 2), summary="", signature="", community=0):
    name = name or f"n{i}"
    return (i, repo, kind, name, qname or name, "python", path, *lines, signature, summary, False, rank, community)


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, NODE)


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, kind string, weight double")


def plain_rank(ids, edges, d=0.85, steps=30):
    out, rank = Counter(), {v: 1 / len(ids) for v in ids}
    for s, _, w in edges:
        out[s] += w
    for _ in range(steps):
        loose = sum(rank[v] for v in ids if v not in out)
        new = {v: (1 - d) / len(ids) + d * loose / len(ids) for v in ids}
        for s, t, w in edges:
            if t in new and s in rank:
                new[t] += d * rank[s] * w / out[s]
        rank = new
    return {v: r / max(rank.values()) for v, r in rank.items()}


def test_pagerank_equals_the_model(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(12), rng.randrange(15), float(rng.randint(1, 4))) for _ in range(40)]
    edges = list({(s, t): (s, t, w) for s, t, w in edges}.values())
    n = nodes_of(spark, [node(i) for i in range(14)])  # 14 is an unknown target
    got = {r["id"]: r["rank"] for r in ranking.pagerank(n, edges_of(spark, [(s, t, "calls", w) for s, t, w in edges])).collect()}
    want = plain_rank(list(range(14)), edges)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert max(got.values()) == 1.0


def test_pagerank_of_nothing_and_of_no_edges(spark):
    none = nodes_of(spark, [])
    assert ranking.pagerank(none, edges_of(spark, [])).count() == 0
    one = ranking.pagerank(nodes_of(spark, [node(1), node(2)]), edges_of(spark, [])).collect()
    assert [r["rank"] for r in one] == [1.0, 1.0]


def sweep(links, rounds=10):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    label = {v: v for v in near}
    for _ in range(rounds):
        moved = False
        for v in sorted(near):
            c = Counter(label[u] for u in near[v])
            best = min(c, key=lambda x: (-c[x], x))
            moved, label[v] = moved or best != label[v], best
        if not moved:
            break
    return label


def test_communities_equal_the_sequential_sweep(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(1, 25), 2))) for _ in range(26)} | {(30, 31)}
    links = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    got = {r["id"]: r["community"] for r in ranking.communities(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == sweep(links)
    assert got[30] == got[31]  # a component of two files agrees


def test_communities_of_a_long_chain_take_bounded_steps(spark):
    links = [(a, b) for k in range(40) for a, b in ((k, k + 1), (k + 1, k))]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["community"] for r in ranking.communities(df, 2, 6).collect()}
    assert got.keys() == set(range(41)) and got[0] == got[1]
    assert {r["id"]: r["community"] for r in ranking.communities(df).collect()} == sweep(links)


def test_pagerank_splits_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOGETHER", 3)
    edges = [(0, k, 1.0) for k in range(1, 14)] + [(k, (k * 5) % 14, 2.0) for k in range(1, 14)]
    got = {r["id"]: r["rank"] for r in ranking.pagerank(nodes_of(spark, [node(i) for i in range(14)]), edges_of(spark, [(s, t, "calls", w) for s, t, w in edges]), steps=7).collect()}
    want = plain_rank(list(range(14)), edges, steps=7)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_upsert_keeps_the_weight_loaded_last(spark):
    t = lambda k: datetime(2025, 1, k)
    rows = [(1, 2, "calls", 1.0, t(1), t(5)), (1, 2, "calls", 2.0, t(2), t(3)), (1, 2, "imports", 1.0, t(1), t(1)), (None, 2, "calls", 1.0, t(1), t(1)), (1, 2, None, 1.0, t(1), t(1))]
    e = spark.createDataFrame(rows, "source_id long, target_id long, kind string, weight double, written_at timestamp, loaded_at timestamp")
    assert sorted(map(tuple, graph.upserted_edges(e).collect())) == [(1, 2, "calls", 1.0), (1, 2, "imports", 1.0)]


def test_lookup_tries_qualified_name_then_path_then_name(spark):
    n = graph.clean_nodes(nodes_of(spark, [node(1, "file", "a.py", "a.py", "a.py"), node(2, name="parse", qname="a.parse", rank=0.5), node(3, name="parse", qname="b.parse", rank=1.0), node(4, name="parse", qname="c.parse", rank=float("nan"))]))
    refs = spark.createDataFrame([("a.parse",), ("a.py",), ("parse",), ("nothing",)], "ref string")
    assert sorted(map(tuple, graph.lookup(refs, n).collect())) == [("a.parse", 2, 1), ("a.py", 1, 1), ("parse", 3, 3)]


def test_resolution_tiers(spark):
    n = nodes_of(spark, [
        node(1, "file", "m.py", "pkg/m.py", "pkg/m.py"), node(2, name="go", qname="pkg.m.go"), node(3, name="go", qname="pkg.x.go"), node(4, name="solo", qname="pkg.m.solo"),
        node(5, name="twin", qname="pkg.twin"), node(6, name="twin", qname="pkg.twin"), node(7, name="go", qname="other.m.go", repo="s"),
    ])
    refs = [(4, "calls", t) for t in ("m.go", "go", "solo", "pkg.twin", "", None, "q.solo")] + [(2, "imports", "pkg.m"), (2, "calls", "pkg.m"), (2, "calls", "pkg.m.go")]
    got = {tuple(r) for r in resolving.resolve(spark.createDataFrame(refs, "source_id long, kind string, target_name string"), n).collect()}
    # m.go by suffix; go is ambiguous; solo is its own source; a dotted name needs a suffix; self edges go
    assert got == {(4, 2, "calls"), (4, 6, "calls"), (2, 1, "imports")}


def test_impact_counts_depth_and_splits_tests(spark):
    n = nodes_of(spark, [node(1), node(2), node(3, path="tests/t.py"), node(4), node(5), node(6)])
    e = edges_of(spark, [(2, 1, "calls", 1.0), (3, 2, "calls", 1.0), (4, 3, "calls", 1.0), (5, 4, "calls", 1.0), (6, 1, "contains", 1.0), (4, 1, "imports", 1.0)])
    got = {(r["id"], r["depth"], r["is_test"]) for r in graph.impact(spark.createDataFrame([(1,)], "seed long"), n, e).collect()}
    assert got == {(2, 1, False), (4, 1, False), (3, 2, True), (5, 2, False)}


def test_frequent_pairs_need_support_and_small_commits(spark):
    rows = [(s, i) for s in range(3) for i in (1, 2)] + [(9, i) for i in range(60)] + [(5, 1)]
    got = resolving.frequent_pairs(spark.createDataFrame(rows, "sha long, item long")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 1.0)]
    assert resolving.frequent_pairs(spark.createDataFrame([], "sha long, item long")).count() == 0


def test_export_is_induced(spark):
    n = nodes_of(spark, [node(1, rank=1.0), node(2, rank=0.5), node(3)])
    e = edges_of(spark, [(1, 2, "calls", 1.0), (1, 3, "calls", 1.0)])
    got = sorted(r["json"] for r in graph.graph_json(n, e, 2).collect())
    assert len(got) == 3 and '{"data":{"source":"1","target":"2","kind":"calls"}}' in got


def test_subsystems_cut_before_the_size_filter(spark):
    rows = [node(i, "file", path=f"{i}.py", community=c, rank=i / 10) for i, c in ((1, 5), (2, 5), (3, 5), (4, 7), (5, 0), (6, 0))]
    got = [tuple(r) for r in ranking.subsystems(nodes_of(spark, rows), 1, 2).orderBy("place").collect()]
    assert got == [(5, 3, 1, "3.py"), (5, 3, 2, "2.py")]


@pytest.mark.parametrize("hot", [0, 400])
def test_latest_per_key(spark, hot):
    t = lambda k: datetime(2025, 1, 1, 0, 0, k % 60)
    rng = random.Random(hot)
    rows = [(rng.randrange(4), rng.choice(["calls", "imports", None]), rng.choice([None, *range(9)]), rng.choice([None, *map(t, range(6))]), "x") for _ in range(200)]
    rows += [(1, "calls", k, t(k), "x") for k in range(hot)] * 2
    df = spark.createDataFrame(rows, "target_id int, kind string, source_id int, written_at timestamp, place string")  # a clashing extra column
    last = {}
    for g, k, s, w, _ in rows:
        if None not in (k, s, w) and s != g:
            last[g, k, s] = max(w, last.get((g, k, s), w))
    want = set()
    for key in {x[:2] for x in last}:
        best = sorted((x[2] for x in last if x[:2] == key), key=lambda s: (-last[(*key, s)].timestamp(), s))[:3]
        want |= {(*key, s) for s in best}
    got = latest_per_key(df, ["target_id", "kind"], "source_id", "written_at", 3, "target_id")
    assert {tuple(r)[:3] for r in got.collect()} == want
    assert latest_per_key(df.limit(0), ["target_id", "kind"], "source_id", "written_at").count() == 0


def test_key_load(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert [tuple(r) for r in key_load(df, ["k"], 2).orderBy("place").collect()] == [(1, 2, 0.5, 1), (None, 1, 0.25, 2)]


def test_neighbours_and_contained(spark):
    n = graph.clean_nodes(nodes_of(spark, [node(1, "file", qname="a.py", path="a.py"), node(2, "class", "C", "a.C"), node(3, "method", "m", "a.C.m"), node(4, "function", "f", "a.f")]))
    assert {tuple(r) for r in graph.contained(n).collect()} == {(1, 2), (2, 3), (1, 4)}
    e = edges_of(spark, [(2, 3, "calls", 1.0), (4, 2, "calls", 0.5), (2, 99, "calls", 1.0)])
    got = {(r["dir"], r["id"]) for r in graph.neighbours(spark.createDataFrame([(2,)], "seed long"), n, e).collect()}
    assert got == {("out", 3), ("in", 4)}
    assert graph.file_links(n, e).count() == 0  # all in one file
    assert n.select(F.max("rank")).first()[0] == 0.0


def test_cochange_edges_join_indexed_files(spark):
    n = nodes_of(spark, [node(5, "file", path="a.py"), node(9, "file", path="a.py"), node(3, "file", path="b.py"), node(4, "file", path="c.py", repo="s")])
    rows = [("r", f"s{k}", p) for k in range(3) for p in ("a.py", "b.py", "gone.py")] + [("s", "s0", "a.py"), ("s", "s0", "c.py")]
    got = [tuple(r) for r in resolving.cochange_edges(spark.createDataFrame(rows, "repo string, sha string, path string"), n).collect()]
    assert got == [(3, 9, "co_changes", 1.0)]


def test_new_ranks_and_communities(spark):
    n = nodes_of(spark, [node(1, "file", path="a.py", rank=0.3, community=7), node(2, path="a.py"), node(3, path="b.py")])
    got = graph.clean_nodes(ranking.with_ranks(n, spark.createDataFrame([(1, 1.0), (2, 0.5)], "id long, rank double"), spark.createDataFrame([(1, 4)], "id long, community long")))
    assert {r["id"]: (r["rank"], r["community"]) for r in got.collect()} == {1: (1.0, 4), 2: (0.5, 4), 3: (0.0, 0)}


def test_graph_document(spark):
    n = nodes_of(spark, [node(1, rank=1.0, summary='say "x"'), node(2)])
    doc = json.loads(graph.graph_document(n, edges_of(spark, [(1, 2, "calls", 1.0)])).first()["json"])
    assert [x["data"]["id"] for x in doc["nodes"]] == ["1", "2"] and doc["nodes"][0]["data"]["summary"] == 'say "x"' and doc["edges"][0]["data"]["kind"] == "calls"
    assert json.loads(graph.graph_document(n.limit(0), edges_of(spark, [])).first()["json"]) == {"nodes": [], "edges": []}
