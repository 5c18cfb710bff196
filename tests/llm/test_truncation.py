import random

from codeweft.llm.truncation import cut_rates, described, examples, features, last_word, length_limits, looked_up, scored, stripped, vocabulary_of

SUBJECTS = "The parser|A worker|This index|Every query|The old cache".split("|")
VERBS = "reads the manifest|drops a row|keeps the lock|returns nothing|walks the whole graph".split("|")
ENDS = "before the release|on a cold start|for every file|until the queue is empty|after the last update".split("|")


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    sentence = lambda: f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}"
    rows, cut = [], set()
    for k in range(n):
        text = ". ".join(sentence() for _ in range(rng.randint(2, 9))) + rng.choice([".", ".", ".", ""])
        source = rng.choice(["a", "b"])
        if source == "a" and len(text) > 200:
            text = text[:200] + (rng.choice(["", "..."]))
            if not stripped(text)[0].rstrip().endswith((".", *ENDS)):
                cut.add(k)
        rows.append((k, text, source, "en", 1))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows + [(9001, None, "a", "en", 1), (9002, "", "a", "en", 1), (9003, " \n", "b", "en", 1)], "doc_id long, text string, source string, lang string, score int")
    limits = {(r["source"], r["limit"]) for r in length_limits(described(df, "doc_id", "text", "source", "lang")).collect()}
    assert ("a", 200) in limits and len(limits) < 4
    s = scored(df)
    got = {r["doc_id"] for r in s.filter("score >= 0.5").collect()}
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got) > 0.8
    assert s.count() == 900
    rates = {r["source"]: r["rate"] for r in cut_rates(s).collect()}
    assert rates["a"] > 0.3 > rates["b"]


def test_copies_of_a_text_take_one_place_of_the_sample(spark):
    df = spark.createDataFrame(corpus(n=300)[0], "doc_id long, text string, source string, lang string, score int")
    facts = lambda d: looked_up(described(d, "doc_id", "text", "source", "lang"), limits, words)
    limits, words = length_limits(described(df, "doc_id", "text", "source", "lang")), vocabulary_of(df)
    base = facts(df)
    first = base.filter("NOT __at").orderBy("__hash").first()["__key"]
    hot = df.filter(f"doc_id = {first}").first()["text"]
    more = df.unionByName(spark.createDataFrame([(10_000 + k, hot, "b", "en", 1) for k in range(400)], df.schema))
    count = lambda f, d: {(r["fold"], r["label"]): r["count"] for r in examples(f, d, "doc_id", "text", 100, 64).groupBy("fold", "label").count().collect()}
    got = count(facts(more), more)
    assert got == count(base, df) and len(got) == 4


def test_the_last_words_that_are_looked_up(spark):
    rows = [(k, f"one shared ending number {k} alpha", "a", "en", 1) for k in range(50)] + [(90, "it ends with alp", "a", "en", 1), (91, "alpha stands inside, alpha too.", "a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score int")
    facts = described(df, "doc_id", "text", "source", "lang")
    got = {r["__key"]: (r["__word"], r["__known"]) for r in looked_up(facts, length_limits(facts), vocabulary_of(df)).collect()}
    assert len(got) == 52 and got[0] == ("alpha", True) and got[90] == ("alp", False) and got[91] == ("", True)


def test_last_words_are_no_words_inside(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["Ab cd ef", "cd ab...", "ab", "", "...", "ab cd. ", None])], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in vocabulary_of(df, least=1).collect()} == {"ab": 2, "cd": 2}


def test_one_text_only(spark):
    df = spark.createDataFrame([(1, "A single short text without any end", "a", None)], "doc_id long, text string, source string, lang string")
    assert scored(df).count() in (0, 1)


def test_marks_are_taken_off():
    assert stripped("ab [truncated]") == ("ab", "note") and stripped("ab...") == ("ab", "dots") and stripped("ab… (output clipped, 5 chars left out)")[0] == "ab"
    assert stripped("a [b]") == ("a [b]", "none") and last_word("some wor...") == "wor" and last_word("end.") == ""
    assert stripped("x" * 100_000 + "...")[0] == "x" * 100_000
    assert features("", False, False, True) and features("\u0301" * 50, True, True, False)


def test_nothing_to_score(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert scored(df).count() == 0 and cut_rates(scored(df)).count() == 0
