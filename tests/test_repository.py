"""Sources, incremental upkeep, changes, extraction and streams on small repositories."""

import subprocess
from datetime import datetime
from random import Random

from pyspark.sql import functions as F

from codeweft.operators import changes, extraction, incremental
from codeweft.sources import languages as lang
from codeweft.sources import repositories as repos
from codeweft.streaming import usage
from tests.test_graph import edges_of, node, nodes_of

SCAN = "repo string, path string, modification_time timestamp_ntz, n_bytes long, content binary, lang string"


def scan(path, text, day=1, lang_="python", repo="r"):
    b = text.encode()
    return (repo, path, datetime(2025, 1, day), len(b), bytearray(b), lang_)


def test_repository_scan_and_rules(spark, tmp_path):
    files = {"a.py": "x = 1\n", "web/app.js": "a" * 3000, "web/ok.js": "let a;\n", "node_modules/m.js": "1", ".git/config": "x", "x.min.js": "1", "deps.lock": "1", "img.png": "1", "notes.md": "#", "skip/z.py": "1", "keep/z.py": "2"}
    for p, t in files.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "big.py").write_text("#" * 1_000_001)
    got = {r["path"]: r["lang"] for r in repos.kept_files(repos.read_repository(spark, str(tmp_path), "r"), ["skip/", "# no"]).select("path", "lang").collect()}
    assert got == {"a.py": "python", "web/ok.js": "javascript", "notes.md": None, "keep/z.py": "python"}


def test_ignore_files_and_odd_names_of_a_repository(spark, tmp_path):
    root = tmp_path / "re.po (x)"
    for p in ("a b/c+d.py", "x[1].py", "{y}.py", "pkg/__init__.py", "skip/z.py", "keep.py", "draft.py"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x = 1\n")
    (root / ".gitignore").write_text("skip/\ndraft.*\n")
    got = {r["path"]: bytes(r["content"]) for r in repos.read_repository(spark, str(root), "r").filter("lang = 'python'").collect()}
    assert got.keys() == {"a b/c+d.py", "x[1].py", "{y}.py", "pkg/__init__.py", "keep.py"} and set(got.values()) == {b"x = 1\n"}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.lock").write_text("1")
    assert repos.read_repository(spark, str(tmp_path / "empty")).count() == 0


def test_ignore_patterns():
    import re

    def hit(pattern, path):
        return bool(re.search(lang.pattern_of(pattern)[0], path))

    assert hit("*.log", "a/b.log") and not hit("/*.log", "a/b.log") and hit("/*.log", "b.log")
    assert hit("build/", "x/build/o.c") and not hit("build/", "x/build") and hit("a/**/z", "a/b/c/z") and hit("a/**/z", "a/z")
    assert hit("doc?.md", "doc1.md") and not hit("doc?.md", "doc12.md") and hit("[!a]x", "bx") and not hit("[!a]x", "ax")
    assert lang.pattern_of("# c") is None and lang.pattern_of("!keep")[1]


def test_freshness_and_cascade(spark):
    s = spark.createDataFrame([scan("same.py", "1", 1), scan("touch.py", "2", 5), scan("edit.py", "3", 5), scan("new.py", "4", 1)], SCAN)
    cur = repos.current_files(s)
    h = {r["path"]: r["hash"] for r in cur.collect()}
    known = spark.createDataFrame([("r", "same.py", h["same.py"], datetime(2025, 1, 2)), ("r", "touch.py", h["touch.py"], datetime(2025, 1, 2)), ("r", "edit.py", "x", datetime(2025, 1, 2)), ("r", "gone.py", "y", None)], "repo string, path string, content_hash string, last_indexed timestamp_ntz")
    got = {r["path"]: r["state"] for r in incremental.freshness(cur, incremental.manifest(known)).collect()}
    assert got == {"same.py": "unchanged", "touch.py": "touched", "edit.py": "changed", "new.py": "new", "gone.py": "vanished"}
    n = nodes_of(spark, [node(1, path="edit.py"), node(2, path="same.py")])
    left = incremental.cleared(spark.createDataFrame([("r", "edit.py")], "repo string, path string"), n, edges_of(spark, [(1, 2, "calls", 1.0), (2, 2, "calls", 1.0)]), spark.createDataFrame([(1, "calls", "x")], "source_id long, kind string, target_name string"), spark.createDataFrame([(2, [1.0])], "node_id long, vec array<float>"))
    assert {k: d.count() for k, d in left.items()} == {"nodes": 1, "edges": 1, "refs": 0, "vectors": 1}


def test_summaries_are_carried_while_the_snippet_is_the_same(spark):
    schema = "repo string, file_path string, qualified_name string, snippet_hash string, summary string"
    old = spark.createDataFrame([("r", "a.py", "a.f", "h1", "does f"), ("r", "a.py", "a.f", "h1", "a twin"), ("s", "a.py", "a.h", "h4", "elsewhere"), ("r", "a.py", "a.g", "h2", "does g"), ("r", "a.py", "a.n", None, "x")], schema)
    new = spark.createDataFrame([("r", "a.py", "a.f", "h1", ""), ("r", "a.py", "a.g", "h3", ""), ("r", "a.py", "a.h", "h4", ""), ("r", "a.py", "a.n", None, "")], schema).union(spark.createDataFrame([], schema))
    got = {(r["qualified_name"], r["summary"]) for r in incremental.carried(old, new).collect()}
    assert got - {("a.n", "")} == {("a.f", "does f"), ("a.g", ""), ("a.h", "")} and len(got) == 4
    assert incremental.carried(old, new).count() == 4


def test_hunks_and_touched_symbols(spark):
    text = "x\n" * 3
    s = spark.createDataFrame([scan("a.py", "one\ntwo\nthree\nfour", 1), scan("a.py", "one\nTWO\nthree\nfour", 2), scan("b.py", text, 1)], SCAN)
    hunks = changes.version_hunks(s)
    assert [tuple(r) for r in hunks.collect()] == [("r", "a.py", 2, 2)]
    n = nodes_of(spark, [node(1, path="a.py", lines=(1, 2)), node(2, path="a.py", lines=(3, 4)), node(3, path="t/test_a.py"), node(4, path="c.py", rank=0.5)])
    assert [r["id"] for r in changes.touched(hunks, n).collect()] == [1]
    ctx = changes.diff_context(hunks, n, edges_of(spark, [(3, 1, "calls", 1.0), (4, 1, "calls", 1.0), (2, 1, "contains", 1.0)]))
    assert {(r["role"], r["id"]) for r in ctx.collect()} == {("symbol", 1), ("test", 3), ("user", 4)}
    shown = changes.snippets(n.filter("id = 2"), s, 1).orderBy("n").collect()
    assert [r["line"] for r in shown] == ["    2| TWO", "    3| three", "    4| four"]


def test_distant_edits_are_separate_hunks(spark):
    old = [f"line {k}" for k in range(1, 21)]
    new = ["LINE 1", *old[1:9], *old[10:17], "more", "and more", *old[17:-1], "LINE 20"]
    s = spark.createDataFrame([scan("a.py", "\n".join(old), 1), scan("a.py", "\n".join(new), 2), scan("b.py", "x\ny\n", 1), scan("b.py", "y\n", 2)], SCAN)
    hunks = changes.version_hunks(s)
    assert sorted(tuple(r) for r in hunks.collect()) == [("r", "a.py", 1, 1), ("r", "a.py", 9, 9), ("r", "a.py", 17, 18), ("r", "a.py", 21, 21), ("r", "b.py", 0, 0)]
    n = nodes_of(spark, [node(1, path="a.py", lines=(1, 2)), node(2, path="a.py", lines=(3, 8)), node(3, path="a.py", lines=(20, 21)), node(4, path="b.py", lines=(1, 1))])
    assert sorted(r["id"] for r in changes.diff_context(hunks, n, edges_of(spark, [(2, 2, "calls", 1.0)])).collect()) == [1, 3]


def test_ranges_change_as_few_lines_as_git(tmp_path):
    random = Random(7)
    for k in range(40):
        a = [random.choice("abcdefgh") if k % 2 else f"{random.randrange(60)}" for _ in range(random.randrange(80))]
        b = [x for x in a if random.random() > 0.15]
        for _ in range(random.randrange(8)):
            b.insert(random.randrange(len(b) + 1), random.choice("abcxyz"))
        best = list(changes._alignment(a, b))
        assert all(a[i] == b[j] for i, j in best) and all(p < q and r < s for (p, r), (q, s) in zip(best, best[1:]))
        assert len(best) == len(list(changes._alignment(a, b, 16)))  # halved again and again
        for name, lines in (("old", a), ("new", b)):
            (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        diff = subprocess.run(["git", "diff", "--no-index", "--minimal", "--unified=0", "old", "new"], cwd=tmp_path, capture_output=True, text=True).stdout.split("\n")[4:]
        assert sum(x[:1] == "-" for x in diff) == len(a) - len(best) and sum(x[:1] == "+" for x in diff) == len(b) - len(best)


def test_unified_diff(spark):
    lines = ["diff --git a/m.py b/m.py", "--- a/m.py", "+++ b/m.py", "@@ -1 +1,2 @@", "+x", "@@ -9,2 +10,0 @@", "-y", "+++ b/n.py", "@@ -3 +3 @@"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert sorted(map(tuple, repos.diff_hunks(df).collect())) == [("m.py", 1, 2), ("m.py", 10, 10), ("n.py", 3, 3)]
    two = df.withColumn("d", F.lit(1)).unionByName(df.withColumn("d", F.lit(2)))
    assert repos.diff_hunks(two, diff="d").count() == 6


def test_commit_log(spark, tmp_path):
    assert repos.commit_log(spark, str(tmp_path / "none")).count() == 0
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (tmp_path / "a.py").write_text(str(k))
        (tmp_path / "b.py").write_text(str(k))
        git("add", ".")
        git("commit", "-qm", f"change {k}")
    got = repos.commit_log(spark, str(tmp_path)).collect()
    assert [(r["subject"], r["files"]) for r in got] == [("change 1", ["a.py", "b.py"]), ("change 0", ["a.py", "b.py"])]


def test_extraction():
    py = b"import os.path\nfrom pkg.a import x\nclass A(Base):\n    def m(self):\n        return run(1)\n\ndef f():\n    A().m()\n"
    bad, syms, refs = extraction.extract("python", py, "pkg/mod.py")
    assert not bad and {(s[0], s[2]) for s in syms} == {("class", "pkg.mod.A"), ("method", "pkg.mod.A.m"), ("function", "pkg.mod.f")}
    assert {("imports", "pkg.mod", "os"), ("imports", "pkg.mod", "pkg"), ("inherits", "pkg.mod.A", "Base"), ("calls", "pkg.mod.A.m", "run")} <= set(refs)
    assert extraction.extract("python", b"def (", "x.py") == (True, [], [])
    samples = {
        "javascript": (b"class B extends A {\n  go(x) {\n    run(x);\n  }\n}\nfunction f() { return g(); }\nconst h = (x) => x;\n", {("class", "B"), ("method", "go"), ("function", "f"), ("function", "h")}),
        "java": (b"import a.b.C;\npublic class B extends A {\n    public int go(int x) {\n        return run(x);\n    }\n}\n", {("class", "B"), ("method", "go")}),
        "go": (b"package m\n\ntype T struct {\n}\n\nfunc (t *T) Go() int {\n\treturn run()\n}\n\nfunc F() {\n}\n", {("class", "T"), ("method", "Go"), ("function", "F")}),
        "c": (b"#include <x.h>\nstruct S {\n int a;\n};\nstatic int go(int x) {\n    return run(x);\n}\n", {("class", "S"), ("function", "go")}),
        "rust": (b"use a::b;\npub struct S {\n}\nimpl S {\n    pub fn go(&self) -> u32 {\n        run()\n    }\n}\n", {("class", "S"), ("function", "go")}),
        "typescript": (b"interface I {\n  a: string;\n}\nexport class B {\n  go(x: number): number {\n    return run(x);\n  }\n}\n", {("class", "I"), ("class", "B"), ("method", "go")}),
    }
    for language, (code, want) in samples.items():
        bad, syms, refs = extraction.extract(language, code, "d/x.z")
        assert not bad and {(s[0], s[1]) for s in syms} == want, language
        assert language == "typescript" or any(r[2] in ("run", "g") for r in refs), language
    assert extraction.extract("ruby", b"def go\nend\n", "x.rb")[1][0][:2] == ("function", "go")
    assert extraction.extract(None, b"x", "x.md") == (False, [], [])


def test_extraction_of_every_form_of_a_definition():
    samples = {
        "java": (
            "class Box<T extends Item> extends Base<T> implements Shape, a.b.Solid {\n    Box(int x) {\n        super(x);\n    }\n    public Box() { this(make()); }\n    int size() { return count(); }\n    abstract List<String> names(int a, int b) throws IOException;\n    // int gone() { lost(); }\n    void run() {\n        return go(1);\n    }\n}\ninterface Shape {\n    int area();\n}\nenum Op implements Shape {\n    PLUS(1) {\n    };\n}\n",
            {("class", "Box", 1, 12), ("method", "Box", 2, 4), ("method", "Box", 5, 5), ("method", "size", 6, 6), ("method", "names", 7, 7), ("method", "run", 9, 11), ("class", "Shape", 13, 15), ("method", "area", 14, 14), ("class", "Op", 16, 19)},
            {("inherits", "d.x.Box", "Base"), ("inherits", "d.x.Box", "Shape"), ("inherits", "d.x.Box", "a.b.Solid"), ("inherits", "d.x.Op", "Shape"), ("calls", "d.x.Box.Box", "make"), ("calls", "d.x.Box.size", "count"), ("calls", "d.x.Box.run", "go")},
            {"lost", "area", "names", "size"},
        ),
        "typescript": (
            "export type Id = string | number\ntype Both<T> =\n  | A\n  | T;\nclass B extends A implements I, J<string> {\n  go(x: number): number { return run(x); }\n}\nconst h = (x) => twice(x)\nfunction f() { return g(); }\n",
            {("class", "Id", 1, 1), ("class", "Both", 2, 4), ("class", "B", 5, 7), ("method", "go", 6, 6), ("function", "h", 8, 8), ("function", "f", 9, 9)},
            {("inherits", "d.x.B", "A"), ("inherits", "d.x.B", "I"), ("inherits", "d.x.B", "J"), ("calls", "d.x.B.go", "run"), ("calls", "d.x.h", "twice"), ("calls", "d.x.f", "g")},
            {"go", "f"},
        ),
        "go": (
            "package m\n\ntype Id int\ntype (\n\tHandler func(x int) error\n\tPair struct {\n\t\ta int\n\t}\n\tOld = Pair\n)\ntype Names []string\n\nfunc F() int { return g() }\n",
            {("class", "Id", 3, 3), ("class", "Handler", 5, 5), ("class", "Pair", 6, 8), ("class", "Names", 11, 11), ("function", "F", 13, 13)},
            {("calls", "d.x.F", "g")},
            {"F"},
        ),
        "cpp": (
            "class B : public A, private ns::C<int> {\n  B(int x) : a(x) {\n  }\n  int go() const { return run(); }\n};\nint B::far(int x) {\n  return near(x);\n}\n",
            {("class", "B", 1, 5), ("method", "B", 2, 3), ("method", "go", 4, 4), ("function", "far", 6, 8)},
            {("inherits", "d.x.B", "A"), ("inherits", "d.x.B", "ns::C"), ("calls", "d.x.B.go", "run"), ("calls", "d.x.far", "near")},
            {"far", "go"},
        ),
        "rust": ("fn f<'a>(x: &'a str, y: &'a str) -> u32 { g(x) }\n", {("function", "f", 1, 1)}, {("calls", "d.x.f", "g")}, {"f"}),
    }
    samples["javascript"] = (
        "function f(x) {\n  const a = x.replace(/[{(\\[`]/g, '');\n  return `{ ${g(`${h(x)}`)}\n  }} lost(`;\n}\nclass C {\n  m(a = k()) { return n() / 2; }\n}\n",
        {("function", "f", 1, 5), ("class", "C", 6, 8), ("method", "m", 7, 7)},
        {("calls", "d.x.f", "x.replace"), ("calls", "d.x.f", "g"), ("calls", "d.x.f", "h"), ("calls", "d.x.C.m", "n")},
        {"lost", "f", "m"},
    )
    for language, (code, symbols, wanted, no_calls) in samples.items():
        bad, syms, refs = extraction.extract(language, code.encode(), "d/x.z")
        assert not bad and {(s[0], s[1], s[3], s[4]) for s in syms} == symbols, language
        assert wanted <= set(refs) and not {r[2] for r in refs if r[0] == "calls"} & no_calls, (language, refs)


def test_streams(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "run"
    spark.createDataFrame([scan("a.py", "1", 1), scan("b.py", "1", 1)], SCAN).coalesce(1).write.parquet(str(src / "scans.parquet"))
    first = usage.refresh(spark, usage.stream(spark, str(src), "scans"), str(root)).collect()
    assert {r["path"] for r in first} == {"a.py", "b.py"}
    spark.createDataFrame([scan("a.py", "2", 3)], SCAN).coalesce(1).write.mode("append").parquet(str(src / "scans.parquet"))
    second = {r["path"]: r["hash"] for r in usage.refresh(spark, usage.stream(spark, str(src), "scans"), str(root)).collect()}
    assert second["a.py"] != {r["path"]: r["hash"] for r in first}["a.py"] and len(second) == 2
    again = {r["path"]: r["hash"] for r in usage.refresh(spark, usage.stream(spark, str(src), "scans"), str(root)).collect()}
    assert again == second  # nothing new: the manifest is found in the folder
    late = [scan("a.py", "older", 2), ("r", "b.py", None, 1, bytearray(b"9"), "python"), ("r", "n.py", None, 1, bytearray(b"1"), "python")]
    spark.createDataFrame(late, SCAN).coalesce(1).write.mode("append").parquet(str(src / "scans.parquet"))
    third = {r["path"]: r["hash"] for r in usage.refresh(spark, usage.stream(spark, str(src), "scans"), str(root)).collect()}
    assert third.keys() == {"a.py", "b.py", "n.py"} and {k: third[k] for k in second} == second
    whole = {r["path"]: r["hash"] for r in repos.current_files(spark.read.parquet(str(src / "scans.parquet"))).collect()}
    assert third == whole
    empty = tmp_path / "none"
    spark.createDataFrame([], SCAN).coalesce(1).write.parquet(str(empty / "scans.parquet"))
    assert usage.refresh(spark, usage.stream(spark, str(empty), "scans")).count() == 0


def test_usage_windows_in_append_mode_and_after_a_restart(spark, tmp_path):
    event = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda rows: spark.createDataFrame([(k, datetime(2025, 1, 1, h, m), 1, "view", 1.0, None) for k, (h, m) in enumerate(rows)], event).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "events.parquet"))
    run = lambda mode, root: {r["window_start"].hour: r["n"] for r in usage.run_once(spark, usage.usage_counts(usage.stream(spark, str(tmp_path / "in"), "events")), mode, str(tmp_path / root)).collect()}
    put([(1, 5), (1, 9), (2, 1)])
    assert run("complete", "c") == {1: 2, 2: 1} and run("append", "a") == {} and run("update", "u") == {1: 2, 2: 1}
    put([(5, 0)])
    run("append", "a")
    put([(1, 30), (5, 1)])  # far too late, and in time
    assert run("complete", "c") == {1: 3, 2: 1, 5: 2}
    assert run("append", "a") == {1: 2, 2: 1}
    assert run("update", "u") in ({1: 2, 2: 1, 5: 2}, {1: 3, 2: 1, 5: 2})
    put([(9, 0)])
    assert run("append", "a") == {1: 2, 2: 1, 5: 2} and run("append", "a") == {1: 2, 2: 1, 5: 2}


def test_python_that_does_not_parse_keeps_its_symbols(spark):
    code = "import os, re as r\nfrom a.b import c\n\nclass A(B, ns.C):\n    def f(self):\n        return go(1)\n\n    def g(self:\n        'lost('\n        x = h(2)\n\ndef top():\n    pass\n"
    bad, syms, refs = extraction.extract("python", code.encode(), "d/x.py")
    assert bad and [(s[0], s[2], s[3], s[4]) for s in syms] == [("class", "d.x.A", 4, 10), ("method", "d.x.A.f", 5, 6), ("method", "d.x.A.g", 8, 10), ("function", "d.x.top", 12, 13)]
    assert {("imports", "d.x", "os"), ("imports", "d.x", "re"), ("imports", "d.x", "a"), ("inherits", "d.x.A", "B"), ("inherits", "d.x.A", "ns.C"), ("calls", "d.x.A.f", "go"), ("calls", "d.x.A.g", "h")} == set(refs)
    df = spark.createDataFrame([scan("x.py", code, 1), scan("x.py", "def one(): pass\n", 2), scan("x.py", "def one(): pass\n", 2)], SCAN)
    assert [[s["name"] for s in r["symbols"]] for r in extraction.current_symbols(df).collect()] == [["one"]]


def test_the_answer_about_a_change(spark):
    n = nodes_of(spark, [node(1, path="a.py", lines=(1, 3)), node(2, path="b.py", rank=0.5), node(3, path="tests/t.py"), node(4, path="a.py", lines=(9, 12))])
    e = edges_of(spark, [(2, 1, "calls", 1.0), (3, 1, "calls", 1.0)])
    hunks = spark.createDataFrame([("r", "a.py", 2, 2), ("r", "a.py", 5, 5), ("r", "c.py", 1, 1)], "repo string, path string, first int, last int")
    text = [r["line"] for r in changes.diff_text(changes.diff_context(hunks, n, e), hunks, n).orderBy("pos").collect()]
    assert text[0] == "## a.py: 2 ranges" and text[1].startswith("- function n1") and text[2].startswith("    used by function n2") and text[3].startswith("    tested by function n3")
    assert text[4:] == ["## c.py: 1 ranges, no symbol touched"]
    assert changes.diff_text(changes.diff_context(hunks, n, e), hunks, n, 30).count() == 1
