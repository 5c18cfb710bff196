"""Problem 8: texts that lost their end."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.session import shared_folder, written

#: Distinct texts the classifier is fitted on at most, and the width of its hashed features.
SAMPLE, WIDTH = 20_000, 1 << 18
#: Parts that the rows of one last word are spread over, and tasks that a step of the fitting takes.
SALTS, FITTING = 32, 4
#: Steps of the first fitting, which only has to tell negatives that look cut, and of the last.
STEPS = (15, 30)

#: A limit or a broken transfer leaves more characters than this.
SHORTEST = 40

#: What is put in place of a lost end, as a pattern and as examples for artificial cuts.
NOTE = re.compile(r"(?:\s*(?:\.{3,}|…))?\s*[\[(<][^\[\]()<>\n]*\b(?:truncat|cut|snip|clip|omit|shorten|abbreviat|trunc|more)[^\[\]()<>\n]*[\])>]\s*\Z", re.I)
DOTS = re.compile(r"\s*(?:\.{3,}|…)\s*\Z")
MARKS = ("...", "…", " ...", " [truncated]", "...(cut)", " <snip>", "\n[output omitted]", "… (clipped, 120 more characters)")

_WORD = re.compile(r"[^\W\d_]+|\d+|\S")
_STOP = re.compile(r"(?<=[\w`)\]])(?:[.!](?=\s|\Z)|(?=\n))")
_LETTERS = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"[^\W\d_]+\Z")


def stripped(text: str) -> tuple[str, str]:
    """A text without what stands for a lost end, and what kind of thing that was."""
    last = text[-200:].rstrip()[-1:]
    if last and last in "])>" and (m := NOTE.search(text[-200:])):
        return text[: len(text) - 200 + m.start() if len(text) > 200 else m.start()], "note"
    if last and last in ".…" and (m := DOTS.search(text[-20:])):
        return text[: len(text) - 20 + m.start() if len(text) > 20 else m.start()], "dots"
    return text, "none"


def _kind(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else "_" if c in " \t" else c


def _word_at_end(u: str) -> str:
    m = _LAST.search(u[-80:])
    return m[0].lower() if m else ""


def last_word(text: str) -> str:
    """The letters the text breaks off in, lower case; "" if it ends in something else."""
    return _word_at_end(stripped(text)[0])


def closing(text: str, code: bool) -> tuple[list[str], list[str], str, str]:
    """The terms of a text's end, those that wait for what is known of the whole corpus, its stripped text and last word.

    Closing characters and words, punctuation still open.  The waiting terms: three if the
    length is at a limit, three if it isn't, one if the last word is known, one if it isn't.
    """
    u, mark = stripped(text)
    body = u.rstrip()
    line = body[body.rfind("\n") + 1 :]
    words = [w.lower() if w.isalpha() else "0" if w.isdigit() else w for w in _WORD.findall(line[-160:])][-6:]
    w = ["^"] * (6 - len(words)) + words
    tail = u[len(body) :]
    space = "n" if "\n" in tail else "s" if tail else ""
    c = "code" if code else "text"
    kind = _kind(body[-1:] or " ")
    out = [
        f"{c} end {_kind(body[-1:])}{space}" if body else f"{c} end {space}",
        f"{c} end2 {''.join(map(_kind, body[-2:]))}{space}",
        f"{c} space {space}",
        f"mark {mark}",
        f"ticks {body.count('`') % 2}",
        f"fence {body.count('```') % 2}",
        f"{c} round {line.count('(') > line.count(')')} square {line.count('[') > line.count(']')}",
        f"{c} quotes {line.count(chr(34)) % 2}",
        f"{c} braces {((n := body.count('{')) > (m := body.count('}'))) - (n < m)}",
        f"{c} words {len(words)} {'n' if len(line) < len(body) else ''}",
        f"{c} line {w[0] if len(words) == 6 else words[0] if words else ''} {line[:2]}",
        f"{c} size {min(len(body) // 20, 10)}",
        f"{c} indent {line[:1].isspace()} {space}",
    ]
    if not code:
        out += [f"w1 {w[5]}", f"w2 {w[4]} {w[5]}", f"w3 {w[3]} {w[4]} {w[5]}", f"s2 {w[3]} {w[4]}", f"s3 {w[2]} {w[3]} {w[4]}", f"s4 {w[1]} {w[2]} {w[3]}", f"p1 {w[4]}"]
        out.append(f"x{mark} {w[4]} {w[5]}")
    else:
        out += [f"c1 {w[5]}", f"c2 {w[4]} {w[5]}"]
    late = [x for at in (True, False) for x in (f"limit {at}", f"limit {at} {kind}", f"limit {at} {c} {mark} {space}")]
    late += [f"{c} known {known} {kind} {space}" for known in (True, False)]
    return out, late, u, _word_at_end(u)


def _chosen(late: list, at_limit: bool, known: bool) -> list:
    return late[:3] * at_limit + late[3:6] * (not at_limit) + [late[6 if known else 7]]


class _Buckets(dict):
    """The bucket of each term; those seen are remembered, in each worker 200,000 at most."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, term: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) % self.width
        return h


_BUCKETS: dict[int, _Buckets] = {}


def hashed(terms: list[str], width: int) -> list[int]:
    of = _BUCKETS.get(width)
    if of is None:
        of = _BUCKETS[width] = _Buckets(width)
    return [of[t] for t in terms]


def features(text: str, code: bool, at_limit: bool, known: bool) -> list[str]:
    """All terms of a text whose length and last word have been looked up."""
    terms, late, _, _ = closing(text, code)
    return terms + _chosen(late, at_limit, known)


def _cut(text: str, limits: list[int], seed: int) -> tuple[str, bool] | None:
    """An intact text with its end taken away inside a word, sentence or line; and whether at a limit."""
    fit = [n for n in limits if 20 < n < len(text) - 1]
    if fit and seed % 2:
        at, limited = fit[seed // 2 % len(fit)], True
    else:
        at, limited = 1 + len(text) * (20 + seed // 7 % 78) // 100, False
    for _ in range(40):
        if at < SHORTEST or at >= len(text):
            return None
        if text[at - 1] not in ".!?:\n\r" and text[at] not in "\n\r" and text[:at].rstrip()[-1:] not in ".!?:":
            break
        at -= 1
    else:
        return None
    if limited and at not in fit:
        limited = False
    mark = MARKS[seed // 11 % len(MARKS)] if seed // 3 % 3 == 0 else ""
    return text[:at] + mark, limited


def _ends(text: str) -> list[int]:
    """Where the sentences of a text end, before their full stops: up to there it is complete all the same."""
    return [m.start() for m in _STOP.finditer(text)]


def described(documents: DataFrame, key: str, text: str, source: str, lang: str, width: int = WIDTH) -> DataFrame:
    """What later steps need of each document with a text that isn't blank; the texts stay where they are read.

    __key, __source, __code (no language), __hash of the text, __fold, __size (characters),
    __n and __bytes (without what stands for a lost end), __word (the last), __terms and
    __late (buckets of hashed terms, see ``closing``).
    """
    rows = documents.select(F.col(key).alias("__key"), F.coalesce(F.col(source), F.lit("")).alias("__source"), F.col(lang).isNull().alias("__code"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    rows = rows.filter(F.col("__text").isNotNull() & F.col("__text").rlike(r"(?U)\S"))
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, code in zip(b.column(4), b.column(2).to_pylist()):
                t = t.as_py()
                terms, late, u, word = closing(t, code)
                out.append((len(t), len(u), len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")), word, hashed(terms, width), hashed(late, width)))
            cols = zip(*out) if out else ([],) * 6
            more = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), ints, ints))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], [*b.schema.names[:4], "__size", "__n", "__bytes", "__word", "__terms", "__late"])

    kind = rows.schema["__key"].dataType.simpleString()
    facts = rows.mapInArrow(run, f"__key {kind}, __source string, __code boolean, __hash long, __size int, __n int, __bytes int, __word string, __terms array<int>, __late array<int>")
    return facts.withColumn("__fold", F.pmod("__hash", F.lit(2)).cast("int"))


def length_limits(facts: DataFrame) -> DataFrame:
    """source, limit, n_rows: lengths at which a source has far more texts than around them.

    Counted over all documents (see ``described``), without what was put in place of a lost
    end; copies of one text make no limit.  The result has a few rows per source, however
    many documents there are.
    """
    counts = facts.filter("__n >= 40").select(F.col("__source").alias("source"), F.col("__n").alias("n"), "__hash").distinct().groupBy("source", "n").agg(F.count(F.lit(1)).alias("n_rows"))
    around = Window.partitionBy("source").orderBy("n").rangeBetween(-12, 12)
    near = counts.withColumn("__near", F.sum("n_rows").over(around) - F.col("n_rows")).withColumn("__top", F.max("n_rows").over(around))
    total = Window.partitionBy("source")
    return (
        near.withColumn("__all", F.sum("n_rows").over(total))
        .filter((F.col("n_rows") >= 5) & (F.col("n_rows") == F.col("__top")) & (F.col("n_rows") * 6 > F.col("__near")) & (F.col("n_rows") * 400 > F.col("__all")))
        .select("source", F.col("n").alias("limit"), "n_rows")
    )


def vocabulary_of(documents: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """word, n: the words inside texts, each text without its last one, in lower case, seen ``least`` times or more.

    Counted over all documents; each task sends a word once per batch, not once per occurrence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            split = pc.split_pattern_regex(pc.utf8_lower(b.column(0)), r"[^\p{L}]+")
            words = split.flatten()
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
            ends = bounds[1:] - 1  # a split text has one piece at least
            blank = pc.equal(words.take(pa.array(ends)), "").to_numpy(zero_copy_only=False)  # what follows the last word has no letters
            for found, sign in ((words, 1), (words.take(pa.array(np.maximum(ends - blank, bounds[:-1]))), -1)):
                n = found.value_counts()
                yield pa.RecordBatch.from_arrays([n.field(0).cast(pa.string()), pc.multiply(n.field(1), sign)], ["word", "n"])

    rows = documents.select(text).filter(F.col(text).isNotNull())
    counts = rows.mapInArrow(count, "word string, n long").filter("word <> ''")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def looked_up(facts: DataFrame, limits: DataFrame, words: DataFrame) -> DataFrame:
    """The facts with the limits of the source, __at (the length is at one), __known (the last word is) and all terms.

    Documents are joined with the words by word and a salt, of which those that end in no
    word have very many, so neither they nor those of a hot word meet in one task.
    """
    per_source = limits.groupBy(F.col("source").alias("__source")).agg(F.sort_array(F.collect_list("limit")).alias("__limits"))
    # A limit counts characters or bytes; blanks or half a character at the cut may be gone.
    near = F.exists("__limits", lambda m: F.col("__n").between(m - 1, m) | F.col("__bytes").between(m - 3, m))
    asked = facts.filter("__word <> ''").select(F.col("__word").alias("word")).distinct()
    known = asked.join(words.select("word"), "word", "left_semi").select(F.col("word").alias("__word"), F.lit(True).alias("__known"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.when(F.col("__word") == "", F.lit(1 << 20)).otherwise(F.lit(SALTS))
    rows = facts.join(F.broadcast(per_source), "__source", "left").withColumn("__at", F.coalesce(near, F.lit(False)))  # a row per source
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__key", "__hash"), salt).cast("int")).join(known, ["__word", "__salt"], "left")
    rows = rows.withColumn("__known", F.col("__known").isNotNull() | (F.col("__word") == "")).drop("__salt")
    late = F.concat(F.when(F.col("__at"), F.slice("__late", 1, 3)).otherwise(F.slice("__late", 4, 3)), F.when(F.col("__known"), F.slice("__late", 7, 1)).otherwise(F.slice("__late", 8, 1)))
    return rows.withColumn("__terms", F.concat("__terms", late)).drop("__late")


def _shown(t: str, code: bool, limits: list[int] | None, known: bool, width: int) -> Iterator[tuple[float, list[int]]]:
    """Label and hashed terms of the examples made of one text."""

    def terms(x: str, at: bool, ok: bool | None = None) -> list[int]:
        """Terms of a text; whether its last word is known is looked up among its own words where it isn't given."""
        early, late, _, word = closing(x, code)
        ok = (not word or word in words()) if ok is None else ok
        return hashed(early + _chosen(late, at, ok), width)

    inside: list[set] = []

    def words() -> set:
        if not inside:
            inside.append(set(_LETTERS.findall(t.lower())))
        return inside[0]

    seed = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    early, late, _, _ = closing(t, code)
    yield 0.0, hashed(early + _chosen(late, False, known), width)
    if seed % 2 and t.rstrip()[-1:] in ".!?}`)":
        yield 0.0, hashed(early + _chosen(late, True, known), width)
    ends = [] if code else _ends(t)
    for k in (0, 1):
        if cut := _cut(t, limits or [], seed + 12345 * k):
            yield 1.0, terms(cut[0], cut[1])
        if ends and (whole := t[: ends[(seed // 5 + 777 * k) % len(ends)]]):
            early, late, _, word = closing(whole, code)
            ok = not word or word in words()
            yield 0.0, hashed(early + _chosen(late, False, ok), width)
            if limits is not None:  # right at a limit, the missing stop was cut off
                yield 1.0, hashed(early + _chosen(late, True, ok), width)
                yield 0.0, terms(whole + ".", True, True)


def examples(facts: DataFrame, documents: DataFrame, key: str, text: str, sample: int = SAMPLE, width: int = WIDTH) -> DataFrame:
    """fold, label, terms: each intact document as it is (0) and with its end cut off (1).

    Documents away from every limit count as intact; at most ``sample`` distinct texts of
    them, in order of a hash, each once however many copies it has.  The cut is inside a
    word, sentence or line, half of the cuts at a limit of the source, a third with a mark
    in place of the rest.  A prose text up to the end of one of its sentences, but without
    the stop, is intact, unless its length is a limit; with the stop it is intact there,
    too.  Half of the texts with a closing mark are shown as if their length were a limit.

    The sample is chosen by hash and key alone (at most ``sample`` small rows, so they are
    broadcast), and its texts are then read where they lie, in as many tasks as hold them.
    """
    intact = facts.filter(~F.col("__at") & (F.col("__size") >= 12))
    one = intact.groupBy("__hash").agg(F.min(F.struct("__key", "__source", "__code", "__known", "__limits")).alias("one")).orderBy("__hash").limit(sample)
    one = one.select("__hash", "one.*")
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).withColumn("__hash", F.xxhash64("__text"))
    chosen = texts.join(F.broadcast(one), ["__key", "__hash"]).select("__hash", "__code", "__known", "__limits", "__text").dropDuplicates(["__hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, label, terms = [], [], []
            for h, code, known, limits, t in zip(*(c.to_pylist() for c in b.columns)):
                for y, x in _shown(t, code, limits, known, width):
                    fold.append(h % 2)
                    label.append(y)
                    terms.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(label, pa.float64()), pa.array(terms, pa.list_(pa.int32()))], ["fold", "label", "terms"])

    return chosen.mapInArrow(run, "fold int, label double, terms array<int>")


Weights = list[tuple[np.ndarray, float]]


def probabilities(rows: DataFrame, weights: Weights, keep: list[str], fold: str, terms: str) -> DataFrame:
    """The columns to keep and score: the logistic of the summed weights of a row's terms, by the model of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, folds = b.column(terms), b.column(fold).to_numpy()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            score = np.empty(b.num_rows)
            for k, (w, intercept) in enumerate(weights):
                sums = np.concatenate(([0.0], np.cumsum(w[flat])))
                margin = sums[at[1:]] - sums[at[:-1]] + intercept
                score = np.where(folds == k, 1 / (1 + np.exp(-margin)), score)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    wanted = rows.select(*keep, *(c for c in (fold, terms) if c not in keep))
    fields = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in keep)
    return wanted.mapInArrow(run, f"{fields}, score double")


def _vectorizer(spark: SparkSession, buckets: str) -> CountVectorizerModel:
    """Vectors of the buckets listed, from the column words; the list crosses to Spark as one string, not word by word."""
    jvm = spark.sparkContext._jvm
    model = CountVectorizerModel(jvm.org.apache.spark.ml.feature.CountVectorizerModel(jvm.org.apache.commons.lang3.StringUtils.split(buckets, ",")))
    return model.setInputCol("words").setOutputCol("features").setBinary(True)


def fit(rows: DataFrame, width: int = WIDTH, reg: float = 3e-4) -> Weights | None:
    """Two logistic regressions over hashed features, each for the half of the texts it wasn't fitted on: the weight of each bucket, and the intercept.

    rows: fold, label, terms.  Only buckets that an example has get a weight.  Some texts
    that count as intact have lost their end too.  A model would learn those by
    heart, so each half is judged by the model of the other half, negatives that look cut
    are taken out, and both models are fitted again.  Where one half lacks examples of
    either kind, one model of all rows serves both; None where all rows do.
    """
    seen = rows.groupBy("fold", "label").count().collect()  # four rows at most
    labels = [{r["label"] for r in seen if r["fold"] != k} for k in (0, 1)]
    if len(labels[0] | labels[1]) < 2:
        return None
    buckets = rows.select(F.explode("terms").alias("t")).distinct()
    kept = np.sort(np.array([r["t"] for r in buckets.collect()], dtype=np.int64))  # width at most
    vectors = _vectorizer(rows.sparkSession, ",".join(map(str, kept)) or "none")

    def ready(examples: DataFrame) -> DataFrame:
        """Vectors for the fitting: a bounded sample of short ones, so more tasks would only add to the steps."""
        return vectors.transform(examples.withColumn("words", F.col("terms").cast("array<string>"))).select("fold", "label", "features").coalesce(FITTING).cache()

    def fitted(examples: DataFrame, steps: int) -> tuple[np.ndarray, float]:
        model = LogisticRegression(maxIter=steps, regParam=reg, tol=1e-4).fit(examples)
        w = np.zeros(width)
        w[kept] = model.coefficients.toArray()[: len(kept)]
        return w, model.intercept

    every = ready(rows)
    try:
        if min(map(len, labels)) < 2:
            return [fitted(every, STEPS[1])] * 2
        first = [fitted(every.filter(F.col("fold") != k), STEPS[0]) for k in (0, 1)]
    finally:
        every.unpersist()
    clean = ready(probabilities(rows, first, ["fold", "label", "terms"], "fold", "terms").filter("label = 1 OR score < 0.5"))
    try:
        return [fitted(clean.filter(F.col("fold") != k), STEPS[1]) for k in (0, 1)]
    finally:
        clean.unpersist()


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", sample: int = SAMPLE, width: int = WIDTH) -> DataFrame:
    """key, source, score, at_limit of every document whose text isn't null, empty or blank.

    ``score`` is the probability that the end was lost; 0.5 and more counts as cut.  Limits
    and known words come from all documents, the classifier from artificial cuts (see fit).
    Texts are read three times: for what is hashed of them, for their words, and those of
    the sample for the examples; all else works on the hashed facts, a table in the shared
    folder.  Equal texts of one source have equal scores.  A null source is a source of its
    own, a null language means code.  Empty input, or nothing to fit on: an empty result.
    """
    root = shared_folder(documents.sparkSession, "truncation")
    facts = written(described(documents, key, text, source, lang, width), f"{root}/facts")
    rows = written(looked_up(facts, length_limits(facts), vocabulary_of(documents, text)), f"{root}/rows")
    weights = fit(written(examples(rows, documents, key, text, sample, width), f"{root}/examples"), width)
    if weights is None:
        rows, weights = rows.filter("false"), [(np.zeros(width), 0.0)] * 2
    rows = rows.select(F.col("__key").alias(key), F.col("__source").alias("source"), F.col("__at").alias("at_limit"), "__fold", "__terms")
    return probabilities(rows, weights, [key, "source", "at_limit"], "__fold", "__terms").select(key, "source", "score", "at_limit")


def cut_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, n_documents, n_cut, n_at_limit, rate: how often each source loses the end of a text."""
    cut = F.col("score") >= threshold
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(cut, 1)).alias("n_cut"), F.count(F.when(cut & F.col("at_limit"), 1)).alias("n_cut_at_limit")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_documents"), 6))
