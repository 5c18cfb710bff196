import json

from pyspark.sql import functions as F

from codeweft.operators import enrichment
from codeweft.sources.instances import read_instances, read_runs
from codeweft.sources.languages import language_of
from tests.test_graph import node, nodes_of


def test_only_missing_or_changed_nodes_are_embedded(spark):
    n = nodes_of(spark, [node(1), node(2, summary="new"), node(3)])
    embed = lambda texts: [[float(len(t))] for t in texts]
    none = spark.createDataFrame([], "node_id long, vec array<float>, text_hash string")
    first = enrichment.embed_missing(n, none, embed)
    assert first.count() == 3
    kept = first.withColumn("vec", F.when(F.col("node_id") == 1, F.array(F.lit(-1.0).cast("float"))).otherwise(F.col("vec")))
    again = {r["node_id"]: r["vec"][0] for r in enrichment.embed_missing(nodes_of(spark, [node(1), node(2, summary="newer"), node(3)]), kept, embed).collect()}
    assert again[1] == -1.0 and again[2] == len("n2 n2 newer")


def test_summaries_are_cleaned_and_refused(spark):
    n = nodes_of(spark, [node(1, summary="old"), node(2, summary="stay")])
    made = enrichment.summarize(spark.createDataFrame([(1, "x"), (2, "y"), (99999, "z")], "id long, text string"), lambda t: ["  good  " if x == "x" else " " if x == "y" else "no" for x in t])
    assert {r["id"]: r["summary"] for r in enrichment.store_summaries(n, made).collect()} == {1: "good", 2: "stay"}
    assert [r["id"] for r in enrichment.matching(n, "OLD").collect()] == [1]
    twice = spark.createDataFrame([(1, "z first", 1), (1, "a last", 2), (1, "  ", 3)], "id long, summary string, at int")
    assert enrichment.store_summaries(n, twice, "at").filter("id = 1").first()["summary"] == "a last"


def test_enrichment_ends_when_nothing_is_left_or_stored(spark):
    n = nodes_of(spark, [node(k) for k in range(5)])
    batch = lambda nodes: nodes.filter("summary = ''").orderBy("id").limit(2).selectExpr("id", "name AS text")
    done, left = enrichment.enriched(n, batch, lambda texts: [f"about {t}" for t in texts])
    assert left == 0 and {r["summary"] for r in done.collect()} == {f"about n{k}" for k in range(5)}
    stuck, left = enrichment.enriched(n, batch, lambda texts: [" " for _ in texts])
    assert left == 5 and enrichment.remaining(stuck).first()["n_left"] == 5


def test_snippet_hashes(spark):
    n = nodes_of(spark, [node(1), node(2)])
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id long, n int, line string")
    got = {r["id"]: r["snippet_hash"] for r in enrichment.with_snippets(n, lines).collect()}
    assert got[2] is None and len(got[1]) == 64


def test_fix_commits(spark):
    c = spark.createDataFrame([("1", "fix the crash here (#12)", ["a.py", "n.md"]), ("2", "fix (#1)", ["a.py"]), ("3", "add a thing now", ["a.py"]), ("4", "fix broken old file", ["gone.py"]), ("5", "fix many files here", [f"{k}.py" for k in range(11)])], "sha string, subject string, files array<string>")
    got = enrichment.fix_commits(c, lambda p: language_of(p).isNotNull(), spark.createDataFrame([("a.py",)], "path string"))
    assert [tuple(r) for r in got.collect()] == [("1", "fix the crash here", "a.py")]
    said = spark.createDataFrame([("resolves #3 in the walker",), ("regressions in parsing found",), ("prefix the names here",), ("Incorrect #12",)], "s string")
    assert [r["x"] for r in said.select(enrichment.is_fix(F.col("s")).alias("x")).collect()] == [True, True, False, False]


def test_instances_and_runs(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"repo": "r", "instance_id": "i", "base_commit": "c", "problem_statement": "It fails\n```\nx\n```\nnow", "patch": "diff --git a/x.py b/x.py\n"}]))
    r = read_instances(spark, str(tmp_path / "i.json")).first()
    assert r["query"] == "It fails now" and r["gold"] == ["x.py"]
    lines = [{"instance_id": "i", "arm": "a", "first_hit": 1, "tokens": 10, "turns": 2, "cost_usd": 0.1}, {"instance_id": "j", "arm": "a", "first_hit": None, "tokens": 30, "turns": 4, "cost_usd": 0.3}, {"instance_id": "k", "arm": "a", "error": "x"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    s = enrichment.run_summary(read_runs(spark, str(tmp_path / "r.jsonl"))).first()
    assert (s["n"], s["hit5"], s["mrr"], s["tokens"]) == (2, 0.5, 0.5, 20.0)
