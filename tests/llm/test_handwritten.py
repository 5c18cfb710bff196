from datetime import datetime

from pyspark.sql import functions as F

from codeweft.llm.handwritten import THRESHOLDS, file_layouts, file_origins, fitted_thresholds, layout, layout_origin

PROSE = "".join(f"def work_{w}(first, second):\n    return first + second  # {w} goes on here\n\n" for w in "alpha beta gamma delta epsilon zeta eta theta".split())
LIB = "".join(f"    const value{w} = compute{w}(input, {w!r}); // keep\n" for w in "One Two Three Four Five Six Seven Eight Nine".replace("One", "A").split())
FILES = {
    "written.py": PROSE,
    "talks.py": '# This used to be generated by a tool; it is maintained by hand.\nHEADER = "// Code generated by x. DO NOT EDIT."\n' + PROSE,
    "gen.py": "class A:\n" + "".join(f"    _grid_{k:03d} = None\n" for k in range(20)),
    "signed.go": "// Code generated by x. DO NOT EDIT.\npackage a\ntype T struct {\n\tAa1 int\n\tBb2 int\n\tCc3 int\n}\n",
    "min.js": "var _0=function(t){return t[0]};" * 40,
    "table.py": "T = [\n" + "    1234, 5678, 91011, 121314,\n" * 20 + "]\n",
    "blob.py": 'B = [\n    "' + "aB3dE5gH7jK9mN1pQ3sT5vX7zA9cE1gI3kM5oQ7s" * 10 + '",\n]\n',
    "notice.py": "# This file is part of lib, release 1.0.7.\n# License: open, see COPYING\n" + PROSE,
    "copy.js": "// mine\n" + LIB.replace("computeTwo", "other"),
    "empty.py": "",
}


def test_origins(spark):
    rows = [("r", p, datetime(2025, 1, 2), bytearray(t.encode()), "javascript" if p.endswith("js") else "python", "x") for p, t in FILES.items()]
    rows += [("r", "gen.py", datetime(2025, 1, 1), bytearray(PROSE.encode()), "python", "x"), ("r", "null.py", datetime(2025, 1, 1), None, "python", "x"), ("r", "doc.md", datetime(2025, 1, 1), bytearray(b"x"), None, "x")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "repo string, path string, modification_time timestamp, content binary, lang string, origin string")
    up = spark.createDataFrame([(1, LIB), (2, None), (3, "short\n")], "upstream_id long, content string")
    got = {r["path"]: r["origin"] for r in file_origins(df, up).collect()}
    assert got == {
        "written.py": "written", "talks.py": "written", "gen.py": "generated", "signed.go": "written", "min.js": "minified", "table.py": "data", "blob.py": "data",
        "notice.py": "vendored", "copy.js": "vendored", "empty.py": "written", "null.py": None,
    }
    assert file_origins(df.limit(0), up).count() == 0
    assert file_origins(df, up.limit(0)).filter("origin = 'vendored'").count() == 1


def test_what_decides(spark):
    rows = [("r", p, datetime(2025, 1, 2), bytearray(t.encode()), "python", 1) for p, t in FILES.items()]
    df = spark.createDataFrame(rows, "repo string, path string, modification_time timestamp, content binary, lang string, n int")
    up = spark.createDataFrame([(k, LIB) for k in range(300)] + [(1000, LIB.replace("computeTwo", "other"))], "upstream_id long, content string")
    got = {r["path"]: (r["deciding"], r["upstream_id"]) for r in file_origins(df, up).collect()}
    assert got["gen.py"] == ("number_lines", None) and got["table.py"][0] == "literal" and got["blob.py"][0] == "run"
    assert got["notice.py"] == ("notice", None) and got["copy.js"] == ("copied", 1000) and got["written.py"] == (None, None)


def test_thresholds_part_the_files_they_are_fitted_on(spark):
    members = lambda k: "".join(f"    _grid_{i:03d} = None\n" for i in range(k))
    texts = [(f"g{k}.py", "class A:\n" + members(12 + k), "generated") for k in range(10)] + [(f"w{k}.py", PROSE + f"LIMIT = {k}\n" * k, "written") for k in range(10)]
    rows = [("r", p, datetime(2025, 1, 2), bytearray(t.encode()), "python") for p, t, _ in texts]
    df = file_layouts(spark.createDataFrame(rows, "repo string, path string, modification_time timestamp, content binary, lang string"))
    known = df.join(spark.createDataFrame([(p, o) for p, _, o in texts], "path string, origin string"), "path")
    fitted = {r["statistic"]: r for r in fitted_thresholds(known).collect()}
    assert fitted["number_lines"]["n_files"] == 10 and 0 < fitted["number_lines"]["threshold"] < 1 and fitted["literal"]["threshold"] is None
    own = THRESHOLDS | {"python": {n: fitted[n]["threshold"] for n in ("number_lines", "digits")}}
    kinds = {r["path"]: r["k"] for r in df.withColumn("k", F.coalesce(layout_origin(own)[0], F.lit("written"))).collect()}
    assert kinds == {p: o for p, _, o in texts}


def test_layout_of_odd_bytes():
    assert layout(b"")[0] == 0
    assert layout(b"\xff\xfe\x00" * 10)[0] == 30
    assert layout(b"x" * 3_000_000)[2] == 3_000_000 and layout(b"\n\n \n")[1] == 0
