"""Queries over scanned files, manifests, changes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions import scalars as fn
from codeweft.operators import changes, extraction, graph, incremental
from codeweft.plans.graph import E, N, load
from codeweft.session import table
from codeweft.sources import languages as lang
from codeweft.sources import repositories as repos
from codeweft.streaming import usage as streams

IGNORE = ["# local", "draft/", "*.min.*", "!src/**/*.min.js", "/tools/trellis"]


def languages_by_suffix(spark, sf_dir):
    s = table(spark, sf_dir, "scans")
    return s.groupBy(lang.suffix(F.col("path")).alias("suffix"), lang.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def scan_decisions(spark, sf_dir):
    s = table(spark, sf_dir, "scans")
    return s.select("repo", "path", "modification_time", lang.decision(F.col("path"), F.col("n_bytes"), IGNORE).alias("decision"))


def scan_kept(spark, sf_dir):
    return repos.kept_files(table(spark, sf_dir, "scans"), IGNORE).groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def _state(spark, sf_dir):
    return incremental.freshness(repos.current_files(table(spark, sf_dir, "scans")), incremental.manifest(table(spark, sf_dir, "files")))


def freshness(spark, sf_dir):
    return _state(spark, sf_dir)


def cleared_tables(spark, sf_dir):
    """Rows left in each table after changed and vanished files are cleared."""
    n, e = load(spark, sf_dir)
    gone = _state(spark, sf_dir).filter("state IN ('changed', 'vanished')")
    left, out = incremental.cleared(gone, n, e, table(spark, sf_dir, "refs"), table(spark, sf_dir, "vectors")), None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def schema_summaries(spark, sf_dir):
    s = table(spark, sf_dir, "scans").filter("content IS NOT NULL").filter(lang.suffix(F.col("path")).isin(".csv", ".sql"))
    text = F.decode("content", "UTF-8")
    about = F.when(lang.suffix(F.col("path")) == ".csv", fn.csv_schema(text)).otherwise(fn.sql_schema(text))
    return s.select("repo", "path", "modification_time", about.alias("summary")).filter("summary IS NOT NULL").distinct()


def extracted_symbols(spark, sf_dir):
    """Symbols found in the current files, by language and kind."""
    s = table(spark, sf_dir, "scans").filter("lang IS NOT NULL")
    x = extraction.current_symbols(s).select("path", F.explode("symbols").alias("s"))
    return x.groupBy(lang.language_of(F.col("path")).alias("language"), F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_symbols"))


def extracted_refs(spark, sf_dir):
    """References found in the current files, by language and kind."""
    s = table(spark, sf_dir, "scans").filter("lang IS NOT NULL")
    x = extraction.current_symbols(s).select("path", F.explode("refs").alias("r"))
    return x.groupBy(lang.language_of(F.col("path")).alias("language"), F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_refs"))


def spans_touched(spark, sf_dir):
    """Symbols that overlap the first three lines of a class."""
    n = load(spark, sf_dir)[0]
    hunks = n.filter("kind = 'class'").select("repo", F.col("file_path").alias("path"), F.col("line_start").alias("first"), (F.col("line_start") + 2).alias("last"))
    return changes.touched(hunks, n).select("id")


def hunks_of_versions(spark, sf_dir):
    return changes.version_hunks(table(spark, sf_dir, "scans"))


def diff_context(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return changes.diff_context(changes.version_hunks(table(spark, sf_dir, "scans")), n, e)


def answer_diff(spark, sf_dir):
    """What the latest changes of all files touch, as an answer of 8,000 characters."""
    n, e = load(spark, sf_dir)
    hunks = changes.version_hunks(table(spark, sf_dir, "scans"))
    return changes.diff_text(changes.diff_context(hunks, n, e), hunks, n).select("line")


def read_symbols(spark, sf_dir):
    return changes.snippets(graph.top_symbols(table(spark, sf_dir, "nodes")), table(spark, sf_dir, "scans"))


def enrichment_batch(spark, sf_dir):
    """The next nodes to summarise with their source, sixty lines at most."""
    return changes.snippets(graph.unsummarized(table(spark, sf_dir, "nodes")), table(spark, sf_dir, "scans"), 0, 60, 40_000)


def usage_stream(spark, sf_dir):
    counts = streams.usage_counts(streams.stream(spark, sf_dir, "events"))
    return streams.run_once(spark, counts).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def refresh_stream(spark, sf_dir):
    return streams.refresh(spark, streams.stream(spark, sf_dir, "scans")).select("repo", "path", "hash", "n_bytes", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        languages_by_suffix, scan_decisions, scan_kept, freshness, cleared_tables, schema_summaries, extracted_symbols, extracted_refs, spans_touched,
        hunks_of_versions, diff_context, answer_diff, read_symbols, enrichment_batch, usage_stream, refresh_stream,
    )
}

_CUR = """c AS (SELECT repo, path, modification_time, sha256(content) AS hash, n_bytes, lang FROM scans WHERE repo IS NOT NULL AND path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY modification_time DESC NULLS LAST, sha256(content) DESC NULLS LAST, n_bytes DESC, lang DESC) = 1)"""
_STATE = f"""{_CUR}, m AS (SELECT repo, path, content_hash AS hash, last_indexed FROM files WHERE repo IS NOT NULL AND path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY last_indexed DESC NULLS LAST, content_hash DESC NULLS LAST) = 1),
    st AS (SELECT coalesce(c.repo, m.repo) AS repo, coalesce(c.path, m.path) AS path,
      CASE WHEN modification_time IS NULL AND c.hash IS NULL AND (m.hash IS NOT NULL OR last_indexed IS NOT NULL) THEN 'vanished'
           WHEN m.hash IS NULL AND last_indexed IS NULL THEN 'new' WHEN modification_time <= last_indexed THEN 'unchanged'
           WHEN c.hash IS NOT DISTINCT FROM m.hash THEN 'touched' ELSE 'changed' END AS state
      FROM c FULL JOIN m ON c.repo = m.repo AND c.path = m.path)"""
_SUFFIX = "CASE WHEN regexp_matches(lower(string_split(path, '/')[-1]), '.\\.[^.]+$') THEN regexp_extract(lower(string_split(path, '/')[-1]), '(\\.[^.]+)$', 1) ELSE lower(string_split(path, '/')[-1]) END"
_LANGS = "l(suffix, language) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lang.LANGUAGES.items()) + ")"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _ignored_sql() -> str:
    out = "false"
    for found in filter(None, map(lang.pattern_of, IGNORE)):
        out = f"CASE WHEN regexp_matches(path, '{found[0]}') THEN {str(not found[1]).lower()} ELSE {out} END"
    return out


def _snippets_sql(chosen: str, around: int, most: int, budget: int) -> str:
    return f"""WITH {N}, sy AS ({chosen}), tx AS (SELECT repo, path, TRY(decode(content)) AS text FROM scans WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY modification_time DESC NULLS LAST) = 1),
        ln AS (SELECT sy.id, greatest(line_start - {around}, 1) AS a, least(line_end + {around} - greatest(line_start - {around}, 1) + 1, {most}) AS k, string_split(text, chr(10)) AS lines FROM sy JOIN tx ON sy.repo = tx.repo AND sy.file_path = tx.path WHERE line_start IS NOT NULL AND line_end IS NOT NULL),
        ex AS (SELECT id, a + generate_subscripts(part, 1) - 1 AS n, unnest(part) AS line FROM (SELECT id, a, lines[a : a + k - 1] AS part FROM ln)),
        nm AS (SELECT id, CAST(n AS INTEGER) AS n, CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, ' ') ELSE CAST(n AS VARCHAR) END || '| ' || line AS line FROM ex)
        SELECT id, n, line FROM nm QUALIFY sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n) <= {budget}"""


SQL = {
    "languages_by_suffix": f"WITH {_LANGS}, s AS (SELECT {_SUFFIX} AS suffix FROM scans) SELECT suffix, language, count(*) AS n_files FROM s LEFT JOIN l USING (suffix) GROUP BY ALL",
    "scan_decisions": f"""WITH {_LANGS}, s AS (SELECT *, {_SUFFIX} AS suffix, lower(string_split(path, '/')[-1]) AS low, string_split(path, '/')[:-2] AS dirs FROM scans)
        SELECT repo, path, modification_time, CASE WHEN list_bool_or(list_transform(dirs, lambda x: starts_with(x, '.') OR x IN ({_LIST(lang.FOLDERS)}))) THEN 'folder'
          WHEN {_ignored_sql()} THEN 'ignored' WHEN suffix(low, '.min.js') OR suffix(low, '.min.css') OR suffix(low, '.lock') THEN 'suffix'
          WHEN language IS NULL AND s.suffix NOT IN ({_LIST(lang.TEXTS)}) THEN 'kind' WHEN n_bytes > {lang.LARGEST} THEN 'size' ELSE 'kept' END AS decision
        FROM s LEFT JOIN l ON s.suffix = l.suffix""",
    "scan_kept": f"""WITH {_LANGS}, s AS (SELECT *, {_SUFFIX} AS suffix, lower(string_split(path, '/')[-1]) AS low, string_split(path, '/')[:-2] AS dirs, string_split(regexp_replace(substring(hex(content), 1, 16384), '(..)', '\\1 ', 'g'), '0A ') AS head FROM scans)
        SELECT repo, lang, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM s LEFT JOIN l ON s.suffix = l.suffix
        WHERE NOT coalesce(list_bool_or(list_transform(dirs, lambda x: starts_with(x, '.') OR x IN ({_LIST(lang.FOLDERS)}))), false) AND NOT ({_ignored_sql()}) AND NOT (suffix(low, '.min.js') OR suffix(low, '.min.css') OR suffix(low, '.lock'))
          AND NOT (language IS NULL AND s.suffix NOT IN ({_LIST(lang.TEXTS)})) AND NOT coalesce(n_bytes > {lang.LARGEST}, false)
          AND NOT (s.suffix IN ({_LIST(lang.SNIFFED)}) AND coalesce(list_max(list_transform(head, lambda x: length(x) // 3)) > {lang.LONGEST}, false)) GROUP BY ALL""",
    "schema_summaries": rf"""WITH s AS (SELECT repo, path, modification_time, {_SUFFIX} AS suffix, TRY(decode(content)) AS text FROM scans WHERE content IS NOT NULL),
        c AS (SELECT repo, path, modification_time, 'Table with the columns ' || substring(string_split(text, chr(10))[1], 1, 400) AS summary FROM s WHERE suffix = '.csv' AND contains(substring(string_split(text, chr(10))[1], 1, 400), ',')),
        t AS (SELECT repo, path, modification_time, regexp_extract_all(text, '(?i)create[ 	
]+table[ 	
]+(?:if[ 	
]+not[ 	
]+exists[ 	
]+)?["''`\[]?([A-Za-z_][A-Za-z0-9_]*)', 1) AS names FROM s WHERE suffix = '.sql')
        SELECT * FROM c UNION SELECT repo, path, modification_time, 'Script that creates the tables ' || array_to_string(names[1:20], ', ') FROM t WHERE len(names) > 0""",
    "read_symbols": _snippets_sql("SELECT id, repo, file_path, line_start, line_end FROM n WHERE kind NOT IN ('file', 'module') ORDER BY rank DESC, id LIMIT 15", 2, 10**6, 5960),
    "enrichment_batch": _snippets_sql("SELECT id, repo, file_path, line_start, line_end FROM n WHERE coalesce(summary, '') = '' AND kind <> 'module' ORDER BY rank DESC, id LIMIT 20", 0, 60, 39_960),
    "freshness": f"WITH {_STATE} SELECT repo, path, state FROM st",
    "cleared_tables": f"""WITH {N}, {E}, {_STATE}, g AS (SELECT DISTINCT id FROM n JOIN st ON n.repo = st.repo AND n.file_path = st.path WHERE state IN ('changed', 'vanished'))
        SELECT 'nodes' AS name, count(*) AS n_rows FROM n WHERE id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'edges', count(*) FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'refs', count(*) FROM refs WHERE source_id NOT IN (SELECT id FROM g) OR source_id IS NULL
        UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE node_id NOT IN (SELECT id FROM g) OR node_id IS NULL""",
    "spans_touched": f"""WITH {N}, h AS (SELECT repo, file_path, line_start AS first, line_start + 2 AS last FROM n WHERE kind = 'class')
        SELECT id FROM n WHERE kind <> 'file' AND EXISTS (SELECT 1 FROM h WHERE h.repo = n.repo AND h.file_path = n.file_path AND n.line_start <= last AND first <= n.line_end)""",
    "usage_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "refresh_stream": f"WITH {_CUR} SELECT repo, path, hash, n_bytes, lang FROM c",
}
