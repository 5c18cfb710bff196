"""Search, context and evaluation queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.operators import enrichment, graph, ranking, retrieval
from codeweft.plans.graph import E, LINE, N, TOP, load, seeds_of
from codeweft.session import remove, shared_folder, table, written
from codeweft.sources.repositories import current_files


def subjects(spark, sf_dir):
    """qid, query: the first line of every commit message."""
    d = table(spark, sf_dir, "documents").filter("source = 'commit_log' AND text IS NOT NULL")
    return d.select(F.col("doc_id").alias("qid"), F.substring_index("text", "\n", 1).alias("query"))


def search_bm25(spark, sf_dir):
    hits = retrieval.bm25(subjects(spark, sf_dir), load(spark, sf_dir)[0])
    return hits.withColumn("score", F.round("score", 6))


def search_plain(spark, sf_dir):
    """The same without the rank."""
    hits = retrieval.bm25(subjects(spark, sf_dir), load(spark, sf_dir)[0], blend=0.0)
    return hits.withColumn("score", F.round("score", 6))


def seed_vectors(spark, sf_dir):
    v = retrieval.finite_vectors(table(spark, sf_dir, "vectors"))
    return seeds_of(spark, sf_dir).join(v, F.col("seed") == F.col("node_id")).select(F.col("seed").alias("qid"), F.col("vec").alias("qvec"))


def search_semantic(spark, sf_dir):
    return retrieval.semantic(seed_vectors(spark, sf_dir), retrieval.finite_vectors(table(spark, sf_dir, "vectors"))).withColumn("score", F.round("score", 6))


def search_hybrid(spark, sf_dir):
    n = load(spark, sf_dir)[0]
    words = seeds_of(spark, sf_dir).join(n, F.col("seed") == F.col("id")).select(F.col("seed").alias("qid"), F.col("name").alias("query"))
    lexical = retrieval.bm25(words, n, 50)
    vector = retrieval.semantic(seed_vectors(spark, sf_dir), retrieval.finite_vectors(table(spark, sf_dir, "vectors")), 50)
    return retrieval.fuse(lexical, vector).withColumn("rrf", F.round("rrf", 6))


def search_semantic_fixed(spark, sf_dir):
    """The fixed query set, which grows with the table: every vector whose id is divisible by 50, against all."""
    v = retrieval.finite_vectors(table(spark, sf_dir, "vectors"))
    q = v.filter("node_id % 50 = 0").select(F.col("node_id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.semantic(q, v).withColumn("score", F.round("score", 6))


def search_hybrid_fixed(spark, sf_dir):
    """The same for names and vectors of the nodes whose id is divisible by 50; what both searches read again is written once."""
    at = shared_folder(spark, "hybrid")
    n = written(load(spark, sf_dir)[0].select("id", "rank", *retrieval.COLUMNS), f"{at}/nodes")
    v = written(retrieval.finite_vectors(table(spark, sf_dir, "vectors")), f"{at}/vectors")
    words = n.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("name").alias("query"))
    q = written(v.withColumnsRenamed({"node_id": "qid", "vec": "qvec"}).join(words.select("qid"), "qid", "left_semi"), f"{at}/queries")
    return retrieval.fuse(retrieval.bm25(words, n, 50), retrieval.semantic(q, v, 50)).withColumn("rrf", F.round("rrf", 6))


def embed_missing(spark, sf_dir):
    """Nodes without a vector and the text that would be embedded."""
    n, v = load(spark, sf_dir)[0], table(spark, sf_dir, "vectors")
    rest = n.join(v.filter("vec IS NOT NULL").select(F.col("node_id").alias("id")), "id", "left_anti")
    return rest.select("id", fn.node_text("name", "qualified_name", "signature", "summary").alias("text"))


def usage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.count(F.lit(1)).alias("uses"))


def usage_boosts(spark, sf_dir):
    return usage(spark, sf_dir).select("node_id", "uses", F.round(fn.usage_boost(F.col("uses")), 6).alias("boost"))


def context_direct(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return retrieval.direct_context(graph.neighbours(seeds_of(spark, sf_dir), n, e), n, usage(spark, sf_dir))


def context_full(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return retrieval.context(seeds_of(spark, sf_dir), n, e, usage(spark, sf_dir), graph.neighbours)


def fixed_seeds(spark, sf_dir):
    """The fixed seeds, which grow with the table: every symbol whose id is divisible by 50."""
    return load(spark, sf_dir)[0].filter("id % 50 = 0 AND kind <> 'file'").select(F.col("id").alias("seed"))


def context_fixed(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return retrieval.context(fixed_seeds(spark, sf_dir), n, e, usage(spark, sf_dir), graph.neighbours)


def answer_context(spark, sf_dir):
    """The answers about the key symbols and their length."""
    n, e = load(spark, sf_dir)
    texts = retrieval.context_text(seeds_of(spark, sf_dir), n, e, usage(spark, sf_dir), table(spark, sf_dir, "refs"), graph.neighbours)
    return texts.select("seed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def unresolved_tails(spark, sf_dir):
    """The first ten distinct reference names of every symbol, in one string."""
    r = table(spark, sf_dir, "refs").filter("target_name IS NOT NULL").select("source_id", "target_name").distinct()
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("target_name"))
    first = r.withColumn("place", place).filter("place <= 10")
    return first.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("target_name")), ", ").alias("tail"))


def overview_text(spark, sf_dir):
    n = load(spark, sf_dir)[0]
    return retrieval.overview(n, graph.top_symbols(table(spark, sf_dir, "nodes")), ranking.subsystems(n, more=("summary",))).select("line")


def node_lines(spark, sf_dir):
    return load(spark, sf_dir)[0].select("id", fn.node_line(F.lit("- ")).alias("line"))


def files_by_folder(spark, sf_dir):
    n = load(spark, sf_dir)[0].filter("kind = 'file'")
    folder = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise(".")
    return n.groupBy("repo", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


def issue_queries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'issue_tracker' AND text IS NOT NULL")
    q = fn.issue_query(F.col("text"))
    return d.select("doc_id", F.length(q).alias("n_chars"), F.md5(q).alias("query_md5"))


def stored_summaries(spark, sf_dir):
    """The latest summary offered for each known node, cleaned."""
    d = table(spark, sf_dir, "documents").filter("source = 'enrich_batch' AND node_id IS NOT NULL")
    d = d.select("node_id", "doc_id", "created_at", fn.clean_summary(F.col("text")).alias("summary")).filter("summary IS NOT NULL")
    last = d.groupBy("node_id").agg(F.max_by("summary", F.struct("created_at", "doc_id")).alias("summary"))
    return last.join(load(spark, sf_dir)[0].select(F.col("id").alias("node_id")), "node_id", "left_semi")


def _tasks(spark, sf_dir, n):
    """Summaries as queries for the file of their symbol."""
    d = table(spark, sf_dir, "documents").filter("source = 'enrich_batch' AND node_id IS NOT NULL AND text IS NOT NULL")
    n = n.select(F.col("id").alias("node_id"), "repo", "file_path")
    return d.select(F.col("doc_id").alias("qid"), "node_id", fn.issue_query(F.col("text")).alias("query")).join(n, "node_id")


def _searched(spark, sf_dir):
    """A folder with the tables that the ladder reads again and again: the nodes' columns and the tasks, each written once."""
    at = shared_folder(spark, "localization")
    n = written(load(spark, sf_dir)[0].select("id", "repo", "file_path", "rank", "name", "qualified_name"), f"{at}/nodes")
    return at, n, written(_tasks(spark, sf_dir, n), f"{at}/tasks")


def _rungs(spark, sf_dir, at, n, t):
    """The searched nodes of each rung of the ladder, as ranked files; the tasks' own words aren't in what is searched."""
    e = written(load(spark, sf_dir)[1], f"{at}/edges")
    # The two searches share their tables and are written out once; three rungs read the second.
    index = retrieval.indexed(t.select("qid", "query"), n, ("name", "qualified_name"))
    found = {blend: written(retrieval.ranked(index, 25, blend), f"{at}/found{blend:.0f}") for blend in (0.0, 5.0)}
    plain = e.filter("kind <> 'co_changes'")
    for name, blend, by in (("fts", 0.0, None), ("rank", 5.0, None), ("expand-nc", 5.0, plain), ("expand", 5.0, e)):
        hits = found[blend]
        yield name, retrieval.ranked_files(hits, n) if by is None else retrieval.expanded_files(hits, n, by, graph.neighbours)


def localization(spark, sf_dir):
    """hit@5, hit@10 and MRR of the lexical, ranked and expanded search, the last with and without co-change edges, and what a task's files cost.

    The files of a rung are written once, for its rates and its cost, and go with them, so
    no plan spans more than one rung.
    """
    at, n, t = _searched(spark, sf_dir)
    gold, out = t.select("qid", "repo", "file_path"), None
    for name, files in _rungs(spark, sf_dir, at, n, t):
        files = written(files, f"{at}/{name}")
        row = written(retrieval.metrics(files, gold).crossJoin(retrieval.mean_tokens(files, gold)).withColumn("method", F.lit(name)), f"{at}/row-{name}")
        remove(spark, f"{at}/{name}")
        out = row if out is None else out.unionByName(row)
    return out


def localization_by_repository(spark, sf_dir):
    """The same for the ranked search, repository by repository."""
    _, n, t = _searched(spark, sf_dir)
    hits = retrieval.bm25(t.select("qid", "query"), n, 25, 5.0, ("name", "qualified_name"))
    return retrieval.metrics_by_repository(retrieval.ranked_files(hits, n), t.select("qid", "repo", "file_path"))


def fix_subjects(spark, sf_dir):
    """Commit subjects that speak of a fix, without their issue numbers."""
    q = subjects(spark, sf_dir)
    return q.filter(enrichment.is_fix(F.col("query"))).select("qid", enrichment.bare_subject(F.col("query")).alias("subject"))


def enrichment_remaining(spark, sf_dir):
    return enrichment.remaining(load(spark, sf_dir)[0])


def token_reduction(spark, sf_dir):
    """Tokens of all lines about nodes beside those of all current files, and how many times more the files are."""
    lines = load(spark, sf_dir)[0].agg(F.sum(fn.token_estimate(fn.node_line(F.lit("- ")))).alias("n_lines_tokens"))
    files = current_files(table(spark, sf_dir, "scans")).agg(F.sum(F.floor(F.col("n_bytes") / 4)).alias("n_file_tokens"))
    return files.withColumn("n_lines_tokens", lines.scalar()).withColumn("ratio", F.round(F.col("n_file_tokens") / F.col("n_lines_tokens"), 4))


def token_totals(spark, sf_dir):
    """Tokens of all texts of a source at a quarter of the characters."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.groupBy("source").agg(F.sum(fn.token_estimate(F.col("text"))).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"))


QUERIES = {
    f.__name__: f
    for f in (
        search_bm25, search_plain, search_semantic, search_hybrid, search_semantic_fixed, search_hybrid_fixed, embed_missing, usage_boosts, context_direct, context_full, context_fixed, answer_context, unresolved_tails,
        overview_text, node_lines, files_by_folder, issue_queries, stored_summaries, localization, localization_by_repository, fix_subjects, enrichment_remaining, token_totals, token_reduction,
    )
}

_TOKENS = "regexp_extract_all(translate(lower(coalesce({}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēĕęěğīįłńňōőŕřśšťūůűźżž', 'aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorrsstuuuzzz'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(queries: str, limit: int, blend: float, prefix: str = "") -> str:
    """CTEs up to ``hits`` (qid, id, score, place) for the CTE named by queries (qid, query)."""
    t = _TOKENS
    return f"""
        p AS (SELECT id, col, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM
              (SELECT id, 0 AS col, {t.format('name')} AS toks FROM n UNION ALL SELECT id, 1, {t.format('qualified_name')} FROM n UNION ALL SELECT id, 2, {t.format('summary')} FROM n)),
        z AS (SELECT id, rank, len({t.format('name')}) + len({t.format('qualified_name')}) + len({t.format('summary')}) AS len FROM n),
        av AS (SELECT avg(len) AS a, count(*) AS c FROM z),
        w0 AS (SELECT qid, unnest(regexp_extract_all(query, '[A-Za-z0-9_]+')) AS word FROM {queries}),
        w AS (SELECT * FROM (SELECT qid, {t.format('word')} AS toks FROM w0) WHERE len(toks) > 0),
        ph AS (SELECT toks, len(toks) AS m, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS j FROM (SELECT DISTINCT toks FROM w)),
        v AS (SELECT toks, m, id, col, pos - j AS start, count(*) AS c FROM ph JOIN p USING (token) GROUP BY ALL HAVING count(*) = m),
        h AS (SELECT toks, id, count(*) AS f FROM v GROUP BY ALL),
        df AS (SELECT toks, count(*) AS df FROM h GROUP BY ALL),
        i AS (SELECT toks, CASE WHEN ln((c - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((c - df + 0.5) / (df + 0.5)) END AS idf FROM df, av),
        s AS (SELECT qid, id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) - {blend} * any_value(rank) AS score
              FROM w JOIN h USING (toks) JOIN i USING (toks) JOIN z USING (id), av GROUP BY qid, id),
        hits AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS INTEGER) AS place FROM s QUALIFY place <= {limit})"""


_SUBJECTS = "q AS (SELECT doc_id AS qid, string_split(text, chr(10))[1] AS query FROM documents WHERE source = 'commit_log' AND text IS NOT NULL)"
_VEC = "fv AS (SELECT DISTINCT node_id, vec FROM vectors WHERE len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))))"
_COS = """sem AS (SELECT qid, node_id AS id, round(dot / (CASE WHEN qn = 0 THEN 1 ELSE qn END * CASE WHEN vn = 0 THEN 1 ELSE vn END), 9) AS score FROM
        (SELECT qv.node_id AS qid, fv.node_id, list_dot_product(qv.vec::DOUBLE[], fv.vec::DOUBLE[]) AS dot, sqrt(list_dot_product(qv.vec::DOUBLE[], qv.vec::DOUBLE[])) AS qn, sqrt(list_dot_product(fv.vec::DOUBLE[], fv.vec::DOUBLE[])) AS vn
         FROM fv AS qv JOIN seeds ON seed = qv.node_id, fv)),
        semtop AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS INTEGER) AS place FROM sem QUALIFY place <= 50)"""
_LINE = LINE
_U = "u AS (SELECT user_id AS id, count(*) AS uses FROM events GROUP BY 1)"
_METRIC = "round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 3) AS hit{k}"

SQL = {
    "search_bm25": f"WITH {N}, {_SUBJECTS}, {_bm25_sql('q', 12, 5.0)} SELECT qid, id, round(score, 6) AS score, place FROM hits",
    "search_plain": f"WITH {N}, {_SUBJECTS}, {_bm25_sql('q', 12, 0.0)} SELECT qid, id, round(score, 6) AS score, place FROM hits",
    "search_semantic": f"WITH {N}, {TOP}, {_VEC}, {_COS} SELECT qid, id, round(score, 6) AS score, place FROM semtop",
    "search_hybrid": f"""WITH {N}, {TOP}, {_VEC}, {_COS}, q AS (SELECT seed AS qid, name AS query FROM seeds JOIN n ON seed = id), {_bm25_sql('q', 50, 5.0)},
        r AS (SELECT qid, id, coalesce(1.0::DOUBLE / (60 + a.place), 0) + coalesce(1.0::DOUBLE / (60 + b.place), 0) AS rrf, a.place AS lp, b.place AS vp FROM hits a FULL JOIN semtop b USING (qid, id))
        SELECT qid, id, round(rrf, 6) AS rrf, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, coalesce(lp, 1000000000), vp NULLS FIRST) AS INTEGER) AS place FROM r QUALIFY place <= 12""",
    "embed_missing": f"""WITH {N} SELECT id, concat_ws(' ', nullif(name, ''), nullif(qualified_name, ''), nullif(signature, ''), nullif(summary, '')) AS text FROM n
        WHERE id NOT IN (SELECT node_id FROM vectors WHERE vec IS NOT NULL AND node_id IS NOT NULL)""",
    "usage_boosts": f"WITH {_U} SELECT id AS node_id, uses, round(1 + 0.1 * least(uses, 5), 6) AS boost FROM u",
    "context_direct": f"""WITH {N}, {E}, {TOP}, {_U},
        x AS (SELECT seed, 'out' AS dir, kind AS edge, weight, dst AS id FROM seeds JOIN e ON seed = src UNION ALL SELECT seed, 'in', kind, weight, src FROM seeds JOIN e ON seed = dst),
        y AS (SELECT seed, dir, edge, n.id, round(weight * (0.5 + rank) * (1 + 0.1 * least(coalesce(uses, 0), 5)), 9) AS prio,
              {_LINE.format(prefix="'[' || CASE WHEN dir = 'out' THEN edge ELSE edge || '-by' END || '] '", kind='n.kind')} AS line FROM x JOIN n USING (id) LEFT JOIN u USING (id) WHERE n.id <> seed),
        o AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY prio DESC, dir DESC, edge, id) = 1),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY prio DESC, dir DESC, edge, id) AS INTEGER) AS place FROM o)
        SELECT seed, place, id, line FROM k QUALIFY sum(length(line) + 1) OVER (PARTITION BY seed ORDER BY place) <= 7960""",
    "unresolved_tails": """WITH d AS (SELECT DISTINCT source_id, target_name FROM refs WHERE target_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_name) <= 10000),
        f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_name) <= 10)
        SELECT source_id, string_agg(target_name, ', ' ORDER BY target_name) AS tail FROM f GROUP BY source_id""",
    "node_lines": f"WITH {N} SELECT id, {_LINE.format(prefix=chr(39) + '- ' + chr(39), kind='kind')} AS line FROM n",
    "files_by_folder": f"WITH {N} SELECT repo, CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE '.' END AS folder, count(*) AS n_files FROM n WHERE kind = 'file' GROUP BY ALL",
    "stored_summaries": f"""WITH {N}, d AS (SELECT node_id, doc_id, created_at, substring(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), 1, 300) AS summary FROM documents WHERE source = 'enrich_batch' AND node_id IS NOT NULL)
        SELECT node_id, summary FROM d WHERE summary <> '' AND node_id IN (SELECT id FROM n) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, doc_id DESC) = 1""",
    "token_totals": "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS n_tokens, count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY source",
}
_WALK = f"""
        pr AS (SELECT x.*, n.id AS node, round(weight * (0.5 + rank) * (1 + 0.1 * least(coalesce(uses, 0), 5)), 9) AS p1, round(weight * (0.5 + rank) * 0.6 * (1 + 0.1 * least(coalesce(uses, 0), 5)), 9) AS p2,
              {_LINE.format(prefix="'[' || CASE WHEN dir = 'out' THEN edge ELSE edge || '-by' END || '] '", kind='n.kind')} AS line
              FROM (SELECT src AS a, 'out' AS dir, kind AS edge, weight, dst AS b FROM e UNION ALL SELECT dst, 'in', kind, weight, src FROM e) x JOIN n ON b = n.id LEFT JOIN u ON u.id = n.id WHERE a <> b),
        f1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p1 DESC, dir DESC, edge, b) AS n FROM
              (SELECT pr.* FROM pr JOIN seeds ON a = seed QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY p1 DESC, dir DESC, edge) = 1)),
        f2 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p2 DESC, dir DESC, edge, b) AS m FROM
              (SELECT * FROM pr WHERE a IN (SELECT b FROM f1) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY p2 DESC, dir DESC, edge) = 1)),
        al AS (SELECT a AS seed, 1 AS hop, CAST(NULL AS BIGINT) AS via, b AS id, line, p1 AS k1, 0 AS k2, n AS k3, -1e300 AS k4, 0 AS k5 FROM f1
               UNION ALL SELECT f1.a, 2, f1.b, f2.b, f2.line, least(f1.p1, f2.p2), CASE WHEN f2.p2 <= f1.p1 THEN 1 ELSE 0 END, n, CASE WHEN f2.p2 <= f1.p1 THEN 0 ELSE -f2.p2 END, m FROM f1 JOIN f2 ON f2.a = f1.b WHERE f2.b <> f1.a),
        it AS MATERIALIZED (SELECT seed, hop, via, id, line, row_number() OVER (PARTITION BY seed ORDER BY k1 DESC, k2, k3, k4, k5) AS nr FROM al),
        hd AS MATERIALIZED (SELECT seed, {_LINE.format(prefix="''", kind='kind')} || chr(10) || CASE WHEN coalesce(signature, '') <> '' THEN 'declared: ' || signature || chr(10) ELSE '' END || chr(10) AS head FROM seeds JOIN n ON seed = id),
        walk AS (SELECT seed, CAST(0 AS BIGINT) AS nr, [seed] AS taken, [seed] AS opened, CAST(7960 - length(head) AS BIGINT) AS room, 0 AS place, false AS ok, CAST(NULL AS BIGINT) AS id, 0 AS hop, '' AS line FROM hd
              UNION ALL SELECT seed, nr, CASE WHEN ok THEN list_append(taken, id) ELSE taken END, CASE WHEN ok AND hop = 1 THEN list_append(opened, id) ELSE opened END, CASE WHEN ok THEN room - length(line) - 1 ELSE room END, CASE WHEN ok THEN place + 1 ELSE place END, ok, id, hop, line
              FROM (SELECT w.seed, it.nr, w.taken, w.opened, w.room, w.place, NOT list_contains(w.taken, it.id) AND (it.hop = 1 OR list_contains(w.opened, it.via)) AS ok, it.id, it.hop, it.line FROM walk w JOIN it ON it.seed = w.seed AND it.nr = w.nr + 1 WHERE w.room >= 0))"""


def _walked(seeds: str) -> str:
    return f"WITH RECURSIVE {N}, {E}, {seeds}, {_U}, {_WALK}"


SQL["issue_queries"] = r"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE source = 'issue_tracker' AND text IS NOT NULL),
        q AS (SELECT doc_id, array_to_string(string_split(t, ' ')[1:120], ' ') AS q FROM b) SELECT doc_id, CAST(length(q) AS INTEGER) AS n_chars, md5(q) AS query_md5 FROM q"""
SQL["fix_subjects"] = rf"""WITH {_SUBJECTS}, b AS (SELECT qid, trim(regexp_replace(query, '\(?#\d+\)?', '', 'g'), ' ') AS subject FROM q)
        SELECT qid, subject FROM b WHERE len(list_filter(string_split_regex(subject, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) >= 3 AND regexp_matches(subject, '(?i)\b(?:{"|".join(enrichment.FIXING)})')"""
SQL["enrichment_remaining"] = f"WITH {N} SELECT language, kind, count(*) AS n_nodes, count(*) FILTER (WHERE coalesce(summary, '') = '') AS n_left FROM n WHERE kind <> 'module' GROUP BY ALL"
SQL["overview_text"] = f"""WITH {N}, tp AS (SELECT * FROM n WHERE kind NOT IN ('file', 'module') ORDER BY rank DESC, id LIMIT 15),
        sy AS (SELECT '1-' || lpad(CAST(row_number() OVER (ORDER BY rank DESC, id) AS VARCHAR), 6, '0') AS pos, {_LINE.format(prefix="'- '", kind='kind')} AS line FROM tp),
        cs AS (SELECT community, count(*) AS size FROM n WHERE kind = 'file' AND community <> 0 GROUP BY 1 ORDER BY size DESC, community LIMIT 6),
        mb AS (SELECT community, size, file_path, summary, row_number() OVER (PARTITION BY community ORDER BY rank DESC, id) AS place FROM n JOIN cs USING (community) WHERE kind = 'file' AND size >= 2 QUALIFY place <= 4),
        sb AS (SELECT community, size, string_agg(file_path, ', ' ORDER BY place) AS names, count(*) AS shown, max(summary) FILTER (WHERE place = 1) AS lead FROM mb GROUP BY ALL),
        ss AS (SELECT '3-' || lpad(CAST(row_number() OVER (ORDER BY size DESC, community) AS VARCHAR), 6, '0') AS pos, '- ' || size || ' files: ' || names || CASE WHEN size > shown THEN ' and ' || (size - shown) || ' more' ELSE '' END || CASE WHEN coalesce(lead, '') <> '' THEN ' — ' || lead ELSE '' END AS line FROM sb),
        fl AS (SELECT CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE '.' END AS folder, file_path, repo, summary FROM n WHERE kind = 'file'),
        ls AS (SELECT '0' AS pos, '# Graph of ' || count(*) || ' nodes in ' || count(*) FILTER (WHERE kind = 'file') || ' files' AS line FROM n
               UNION ALL SELECT '1-', '## Most important symbols' UNION ALL SELECT '3-', '## Groups of files' UNION ALL SELECT '5-', '## All files'
               UNION ALL SELECT pos, line FROM sy UNION ALL SELECT pos, line FROM ss
               UNION ALL SELECT DISTINCT '6-' || folder, '### ' || folder || '/' FROM fl
               UNION ALL SELECT '6-' || folder || chr(1) || file_path || chr(1) || repo, '- ' || file_path || CASE WHEN coalesce(summary, '') <> '' THEN ' — ' || summary ELSE '' END FROM fl),
        rs AS (SELECT line, sum(length(line) + 1) OVER (ORDER BY pos, line ROWS UNBOUNDED PRECEDING) AS total FROM ls) SELECT line FROM rs WHERE total <= 8000"""


def _ladder_sql() -> str:
    """CTEs from the tasks to pos (method, qid, repo, file_path, pos): the files of each rung."""
    t = _TOKENS
    pieces = _bm25_sql("q", 25, 0.0)
    pieces = pieces[: pieces.index("s AS (SELECT qid")].replace(f" UNION ALL SELECT id, 2, {t.format('summary')} FROM n", "").replace(f" + len({t.format('summary')})", "")
    near = "SELECT src AS seed, dst AS id, weight, kind FROM e UNION ALL SELECT dst, src, weight, kind FROM e"
    return f"""ta AS (SELECT doc_id AS qid, n.repo, n.file_path, array_to_string(string_split(trim(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')[1:120], ' ') AS query
              FROM documents d JOIN n ON d.node_id = n.id WHERE source = 'enrich_batch' AND text IS NOT NULL),
        q AS (SELECT qid, query FROM ta), {pieces}
        sc AS (SELECT qid, id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) AS base, any_value(rank) AS rank FROM w JOIN h USING (toks) JOIN i USING (toks) JOIN z USING (id), av GROUP BY qid, id),
        hi AS (SELECT 0 AS blend, qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9), id) AS place FROM sc QUALIFY place <= 25
               UNION ALL SELECT 5, qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(base - 5.0 * rank, 9), id) AS place FROM sc QUALIFY place <= 25),
        rf AS (SELECT blend, qid, repo, file_path, row_number() OVER (PARTITION BY blend, qid ORDER BY min(place)) AS pos FROM hi JOIN n USING (id) GROUP BY blend, qid, repo, file_path),
        nr AS ({near}),
        ex AS (SELECT m, qid, n.repo, n.file_path, sum(weight * (0.5 + n.rank)) AS s FROM hi JOIN nr ON hi.id = seed JOIN n ON nr.id = n.id, (VALUES ('expand-nc'), ('expand')) v(m)
               WHERE blend = 5 AND place <= 5 AND (m = 'expand' OR nr.kind <> 'co_changes') GROUP BY ALL),
        ne AS (SELECT m, ex.qid, ex.repo, ex.file_path, last + row_number() OVER (PARTITION BY m, ex.qid ORDER BY round(s, 9) DESC, ex.repo, ex.file_path) AS pos
               FROM ex JOIN (SELECT qid, max(pos) AS last FROM rf WHERE blend = 5 GROUP BY qid) l ON ex.qid = l.qid ANTI JOIN (SELECT * FROM rf WHERE blend = 5) r ON ex.qid = r.qid AND ex.repo = r.repo AND ex.file_path = r.file_path),
        ps AS (SELECT CASE blend WHEN 0 THEN 'fts' ELSE 'rank' END AS method, qid, repo, file_path, pos FROM rf
               UNION ALL SELECT m, qid, repo, file_path, pos FROM rf, (VALUES ('expand-nc'), ('expand')) v(m) WHERE blend = 5 UNION ALL SELECT * FROM ne),
        tk AS (SELECT method, qid, sum(length(file_path) + 1) // 4 AS t FROM ps GROUP BY ALL),
        fi AS (SELECT method, qid, repo, min(pos) AS first FROM ps JOIN ta USING (qid, repo, file_path) GROUP BY ALL),
        al AS (SELECT m.method, ta.qid, ta.repo, first, coalesce(t, 0) AS t FROM ta CROSS JOIN (SELECT DISTINCT method FROM ps) m LEFT JOIN fi ON fi.method = m.method AND fi.qid = ta.qid LEFT JOIN tk ON tk.method = m.method AND tk.qid = ta.qid)"""


_RATES = f"count(*) AS n_tasks, {_METRIC.format(k=5)}, {_METRIC.format(k=10)}, round(avg(coalesce(1.0::DOUBLE / first, 0)), 3) AS mrr"
SQL["localization"] = f"WITH {N}, {E}, {_ladder_sql()} SELECT method, {_RATES}, round(avg(t), 1) AS tokens FROM al GROUP BY method"
SQL["localization_by_repository"] = f"WITH {N}, {E}, {_ladder_sql()} SELECT repo, {_RATES} FROM al WHERE method = 'rank' GROUP BY repo"
SQL["token_reduction"] = f"""WITH {N}, c AS (SELECT n_bytes FROM scans WHERE repo IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY modification_time DESC NULLS LAST, sha256(content) DESC NULLS LAST, n_bytes DESC, lang DESC) = 1),
        x AS (SELECT CAST(sum(n_bytes // 4) AS BIGINT) AS n_file_tokens FROM c), y AS (SELECT CAST(sum(length({_LINE.format(prefix="'- '", kind='kind')}) // 4) AS BIGINT) AS n_lines_tokens FROM n)
        SELECT n_file_tokens, n_lines_tokens, round(n_file_tokens / n_lines_tokens, 4) AS ratio FROM x, y"""
SQL["context_full"] = f"{_walked(TOP)} SELECT seed, place, id, hop AS depth, line FROM walk WHERE ok AND room >= 0"
SQL["answer_context"] = f"""{_walked(TOP)}, rf AS (SELECT DISTINCT source_id AS seed, target_name FROM refs WHERE target_name <> '' QUALIFY dense_rank() OVER (PARTITION BY source_id ORDER BY target_name) <= 10),
        tl AS (SELECT seed, 'refers to: ' || string_agg(target_name, ', ' ORDER BY target_name) || chr(10) AS tail FROM rf GROUP BY seed),
        bd AS (SELECT seed, string_agg(line || chr(10), '' ORDER BY place) AS body FROM walk WHERE ok AND room >= 0 GROUP BY seed),
        tx AS (SELECT hd.seed, head || coalesce(body, '') AS t, tail FROM hd LEFT JOIN bd USING (seed) LEFT JOIN tl USING (seed)),
        ty AS (SELECT seed, CASE WHEN tail IS NOT NULL AND length(t) + length(tail) <= 8000 THEN t || tail ELSE t END AS text FROM tx)
        SELECT seed, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM ty"""
SQL["search_semantic_fixed"] = SQL["search_semantic"].replace(f"{TOP}, {_VEC}", f"{_VEC}, seeds AS (SELECT DISTINCT node_id AS seed FROM fv WHERE node_id % 50 = 0)")
SQL["search_hybrid_fixed"] = SQL["search_hybrid"].replace(TOP, "seeds AS (SELECT id AS seed FROM n WHERE id % 50 = 0)")
