"""Queries over the graph tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import graph, ranking, resolving, retrieval
from codeweft.session import table

N = """n AS (SELECT DISTINCT id, repo, kind, name, qualified_name, file_path, line_start, line_end, signature, summary, community,
    CASE WHEN rank IS NULL OR isnan(rank) THEN 0.0 ELSE rank END AS rank,
    CASE lower(language) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'golang' THEN 'go' ELSE lower(language) END AS language
    FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY 1) = 1)"""
E = """e AS (SELECT source_id AS src, target_id AS dst, kind, weight FROM edges
    WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY loaded_at DESC, weight DESC) = 1)"""
LINE = """regexp_replace({prefix} || {kind} || ' ' || qualified_name || ' — ' || CASE WHEN coalesce(line_start, 0) <> 0 THEN concat_ws(':', file_path, CAST(line_start AS VARCHAR)) ELSE coalesce(file_path, '') END
        || ' — ' || coalesce(nullif(summary, ''), nullif(signature, ''), ''), '[ —]+$', '')"""
TOP = "seeds AS (SELECT id AS seed FROM n WHERE kind NOT IN ('file', 'module') ORDER BY rank DESC, id LIMIT 15)"


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.clean_nodes(table(spark, sf_dir, "nodes")), graph.upserted_edges(table(spark, sf_dir, "edges"))


def seeds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_symbols(table(spark, sf_dir, "nodes")).select(F.col("id").alias("seed"))


def languages(spark, sf_dir):
    return load(spark, sf_dir)[0].groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


def edges_upserted(spark, sf_dir):
    return load(spark, sf_dir)[1].select("src", "dst", "kind", F.round("weight", 6).alias("weight"))


def edges_kept(spark, sf_dir):
    """Edges after all that were resolved from names are deleted, by kind."""
    e = load(spark, sf_dir)[1].filter(~F.col("kind").isin("calls", "imports", "inherits", "references"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"))


def key_symbols(spark, sf_dir):
    return graph.top_symbols(table(spark, sf_dir, "nodes")).select("id", "kind", "qualified_name", F.round("rank", 6).alias("rank"))


def needs_summary(spark, sf_dir):
    return graph.unsummarized(table(spark, sf_dir, "nodes")).select("id", "kind", "qualified_name")


def summaries_of_files(spark, sf_dir):
    n = load(spark, sf_dir)[0]
    return n.filter("kind <> 'file' AND summary <> ''").select("repo", "file_path", "qualified_name", "id", "summary")


def neighbours_top(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return graph.neighbours(seeds_of(spark, sf_dir), n, e).select("seed", "dir", "kind", F.round("weight", 6).alias("weight"), "id")


def degrees(spark, sf_dir):
    """In- and out-degree of every node by kind of edge."""
    n, e = load(spark, sf_dir)
    out = e.groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n_out"))
    back = e.groupBy(F.col("dst").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n_in"))
    both = out.join(back, ["id", "kind"], "full").na.fill(0, ["n_out", "n_in"])
    return both.join(n.select("id"), "id", "left_semi")


def lookups(spark, sf_dir):
    refs = table(spark, sf_dir, "refs").select(F.col("target_name").alias("ref")).filter("ref IS NOT NULL AND ref <> ''").distinct()
    return graph.lookup(refs, load(spark, sf_dir)[0])


def contains_edges(spark, sf_dir):
    return graph.contained(load(spark, sf_dir)[0])


def file_graph(spark, sf_dir):
    return graph.file_links(*load(spark, sf_dir))


def pagerank(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return ranking.pagerank(n, e.filter("kind <> 'contains'")).select("id", F.round("rank", 6).alias("rank"))


def communities(spark, sf_dir):
    return ranking.communities(graph.file_links(*load(spark, sf_dir)))


def subsystems(spark, sf_dir):
    return ranking.subsystems(load(spark, sf_dir)[0])


def impact(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return graph.impact(seeds_of(spark, sf_dir), n, e)


def impact_cochanged(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return graph.cochanged(seeds_of(spark, sf_dir), n, e).withColumn("weight", F.round("weight", 6))


def answer_impact(spark, sf_dir):
    """What depends on the key symbols, their tests and what changes with them, capped as an answer shows it."""
    n, e = load(spark, sf_dir)
    seeds = seeds_of(spark, sf_dir)
    listed = retrieval.impact_listed(graph.impact(seeds, n, e), graph.cochanged(seeds, n, e), n)
    return listed.select("seed", "section", "place", "id", F.when(F.col("section") != "together", F.col("line")).alias("line"))


def impact_fixed(spark, sf_dir):
    """How many nodes depend on each symbol whose id is divisible by 50, by depth."""
    n, e = load(spark, sf_dir)
    seeds = n.filter("id % 50 = 0 AND kind <> 'file'").select(F.col("id").alias("seed"))
    return graph.impact(seeds, n, e).groupBy("seed", "depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("is_test"), 1)).alias("n_tests"))


def cochange_edges(spark, sf_dir):
    """Co-change edges between the indexed files that were modified in the same month of a repository, twice or more."""
    month = F.date_format("modification_time", "yyyy-MM")
    commits = table(spark, sf_dir, "scans").select("repo", month.alias("sha"), "path")
    return resolving.cochange_edges(commits, load(spark, sf_dir)[0], 2, 400).withColumn("weight", F.round("weight", 6))


def graph_export(spark, sf_dir):
    n, e = load(spark, sf_dir)
    return graph.graph_json(n, e)


def resolved_edges(spark, sf_dir):
    return resolving.resolve(table(spark, sf_dir, "refs"), load(spark, sf_dir)[0])


def cochange_pairs(spark, sf_dir):
    """Orders as commits, their parts as files."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("item"))
    return resolving.frequent_pairs(lines).withColumn("weight", F.round("weight", 6))


QUERIES = {
    f.__name__: f
    for f in (
        languages, edges_upserted, edges_kept, key_symbols, needs_summary, summaries_of_files, neighbours_top, degrees, lookups, contains_edges,
        file_graph, pagerank, communities, subsystems, impact, impact_cochanged, answer_impact, impact_fixed, cochange_edges, graph_export, resolved_edges, cochange_pairs,
    )
}


def _pagerank_sql(steps: int = 30, d: float = 0.85) -> str:
    parts = [
        N, E,
        "w AS MATERIALIZED (SELECT src, sum(weight) AS total FROM e WHERE kind <> 'contains' GROUP BY src)",
        "f AS MATERIALIZED (SELECT e.src, dst, sum(weight / total) AS part FROM e JOIN w USING (src) WHERE kind <> 'contains' AND dst IN (SELECT id FROM n) GROUP BY ALL)",
        "m AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM w) AS loose, (SELECT count(*) FROM n) AS k FROM n)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / k AS rank FROM m)",
    ]
    for i in range(steps):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT m.id, (1 - {d}) / k + {d} * coalesce((SELECT sum(r.rank) FROM r{i} r JOIN m USING (id) WHERE loose), 0) / k + {d} * coalesce(moved, 0) AS rank"
            f" FROM m LEFT JOIN (SELECT dst, sum(rank * part) AS moved FROM r{i} JOIN f ON id = src GROUP BY dst) x ON m.id = x.dst)"
        )
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, round(rank / (SELECT max(rank) FROM r{steps}), 6) AS rank FROM r{steps}"


_FILES = "fs AS (SELECT repo, file_path, max(id) AS file FROM n WHERE kind = 'file' GROUP BY ALL)"
_TEST = "(contains(list_extract(string_split(lower(coalesce(file_path, '')), '/'), -1), 'test') OR contains('/' || lower(coalesce(file_path, '')), '/tests/'))"

_IMPACT = f"""d AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('calls', 'imports', 'inherits') AND src IN (SELECT id FROM n)),
        l1 AS (SELECT DISTINCT seed, src AS id FROM seeds JOIN d ON seed = dst), l2 AS (SELECT DISTINCT seed, src AS id FROM l1 JOIN d ON id = dst),
        l3 AS (SELECT DISTINCT seed, src AS id FROM l2 JOIN d ON id = dst),
        ud AS (SELECT seed, id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY ALL),
        im AS (SELECT seed, ud.id, depth, {_TEST} AS is_test FROM ud JOIN n ON ud.id = n.id WHERE seed <> ud.id)"""
_TOGETHER = """own AS (SELECT seed, file FROM seeds JOIN n ON seed = id JOIN fs USING (repo, file_path)),
        bo AS (SELECT src AS file, dst AS id, weight FROM e WHERE kind = 'co_changes' UNION ALL SELECT dst, src, weight FROM e WHERE kind = 'co_changes'),
        tg AS (SELECT seed, round(weight, 6) AS weight, file_path, CAST(row_number() OVER (PARTITION BY seed ORDER BY weight DESC, file_path DESC, bo.id) AS INTEGER) AS place
        FROM own JOIN bo USING (file) JOIN n ON bo.id = n.id QUALIFY place <= 8)"""

SQL = {
    "languages": f"WITH {N} SELECT language, kind, count(*) AS n_nodes FROM n GROUP BY ALL",
    "edges_upserted": f"WITH {E} SELECT src, dst, kind, round(weight, 6) AS weight FROM e",
    "edges_kept": f"WITH {E} SELECT kind, count(*) AS n_edges FROM e WHERE kind NOT IN ('calls', 'imports', 'inherits', 'references') GROUP BY kind",
    "key_symbols": f"WITH {N} SELECT id, kind, qualified_name, round(rank, 6) AS rank FROM n WHERE kind NOT IN ('file', 'module') ORDER BY n.rank DESC, id LIMIT 15",
    "needs_summary": f"WITH {N} SELECT id, kind, qualified_name FROM n WHERE coalesce(summary, '') = '' AND kind <> 'module' ORDER BY rank DESC, id LIMIT 20",
    "summaries_of_files": f"WITH {N} SELECT repo, file_path, qualified_name, id, summary FROM n WHERE kind <> 'file' AND summary <> ''",
    "neighbours_top": f"""WITH {N}, {E}, {TOP}
        SELECT seed, 'out' AS dir, e.kind, round(weight, 6) AS weight, dst AS id FROM seeds JOIN e ON seed = src WHERE dst IN (SELECT id FROM n)
        UNION ALL SELECT seed, 'in', e.kind, round(weight, 6), src FROM seeds JOIN e ON seed = dst WHERE src IN (SELECT id FROM n)""",
    "degrees": f"""WITH {N}, {E}, o AS (SELECT src AS id, kind, count(*) AS n_out FROM e GROUP BY ALL), i AS (SELECT dst AS id, kind, count(*) AS n_in FROM e GROUP BY ALL)
        SELECT id, kind, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (id, kind) WHERE id IN (SELECT id FROM n)""",
    "lookups": f"""WITH {N}, r AS (SELECT DISTINCT target_name AS ref FROM refs WHERE target_name <> ''),
        x AS (SELECT ref, id, rank, 1 AS how FROM r JOIN n ON ref = qualified_name
              UNION ALL SELECT ref, id, rank, 2 FROM r JOIN n ON ref = file_path AND kind = 'file'
              UNION ALL SELECT ref, id, rank, 3 FROM r JOIN n ON ref = name)
        SELECT ref, id, how FROM x QUALIFY row_number() OVER (PARTITION BY ref ORDER BY how, rank DESC, id) = 1""",
    "contains_edges": f"""WITH {N}, {_FILES}, o AS (SELECT repo, qualified_name AS parent_name, max(id) AS owner FROM n WHERE kind <> 'file' GROUP BY ALL),
        s AS (SELECT *, regexp_replace(qualified_name, '\\.[^.]*$', '') AS parent_name FROM n WHERE kind <> 'file')
        SELECT coalesce(CASE WHEN owner <> s.id THEN owner END, file) AS parent, s.id AS child
        FROM s LEFT JOIN o ON s.repo = o.repo AND s.parent_name = o.parent_name LEFT JOIN fs ON s.repo = fs.repo AND s.file_path = fs.file_path
        WHERE coalesce(CASE WHEN owner <> s.id THEN owner END, file) IS NOT NULL""",
    "file_graph": f"""WITH {N}, {E}, {_FILES}, o AS (SELECT id, file FROM n JOIN fs USING (repo, file_path)),
        p AS (SELECT x.file AS a, y.file AS b FROM e JOIN o x ON src = x.id JOIN o y ON dst = y.id WHERE e.kind <> 'contains' AND x.file <> y.file)
        SELECT a, b FROM p UNION SELECT b, a FROM p""",
    "pagerank": _pagerank_sql(),
    "subsystems": f"""WITH {N}, b AS (SELECT community, count(*) AS size FROM n WHERE kind = 'file' AND community <> 0 GROUP BY 1 ORDER BY size DESC, community LIMIT 6)
        SELECT community, size, CAST(row_number() OVER (PARTITION BY community ORDER BY rank DESC, id) AS INTEGER) AS place, file_path
        FROM n JOIN b USING (community) WHERE kind = 'file' AND size >= 2 QUALIFY place <= 4""",
    "impact": f"WITH {N}, {E}, {TOP}, {_IMPACT} SELECT seed, id, depth, is_test FROM im",
    "impact_fixed": f"""WITH {N}, {E}, seeds AS (SELECT id AS seed FROM n WHERE id % 50 = 0 AND kind <> 'file'), {_IMPACT}
        SELECT seed, depth, count(*) AS n_nodes, count(*) FILTER (WHERE is_test) AS n_tests FROM im GROUP BY ALL""",
    "answer_impact": f"""WITH {N}, {E}, {TOP}, {_FILES}, {_IMPACT}, {_TOGETHER},
        k AS (SELECT im.seed, CASE WHEN is_test THEN 'tests' ELSE 'users' END AS section, CAST(row_number() OVER (PARTITION BY seed, is_test ORDER BY depth, rank DESC, n.id) AS INTEGER) AS place, n.id, {LINE.format(prefix="'[' || depth || '] '", kind='kind')} AS line FROM im JOIN n ON im.id = n.id)
        SELECT seed, section, place, id, line FROM k WHERE place <= CASE WHEN section = 'users' THEN 20 ELSE 10 END
        UNION ALL SELECT seed, 'together', place, NULL, NULL FROM tg""",
    "cochange_edges": f"""WITH {N}, c AS (SELECT DISTINCT repo, strftime(modification_time, '%Y-%m') AS sha, path FROM scans WHERE repo IS NOT NULL AND path IS NOT NULL AND modification_time IS NOT NULL),
        k AS (SELECT repo, sha FROM c GROUP BY ALL HAVING count(*) BETWEEN 2 AND 400),
        p AS (SELECT x.repo, x.path AS a, y.path AS b, count(*) AS n FROM c x JOIN c y ON x.repo = y.repo AND x.sha = y.sha AND x.path < y.path JOIN k ON x.repo = k.repo AND x.sha = k.sha GROUP BY ALL HAVING count(*) >= 2),
        fs AS (SELECT repo, file_path, max(id) AS file FROM n WHERE kind = 'file' GROUP BY ALL)
        SELECT least(u.file, v.file) AS src, greatest(u.file, v.file) AS dst, 'co_changes' AS kind, round(n / (SELECT max(n) FROM p), 6) AS weight
        FROM p JOIN fs u ON p.repo = u.repo AND a = u.file_path JOIN fs v ON p.repo = v.repo AND b = v.file_path""",
    "impact_cochanged": f"WITH {N}, {E}, {TOP}, {_FILES}, {_TOGETHER} SELECT seed, weight, file_path, place FROM tg",
    "graph_export": f"""WITH {N}, {E}, t AS (SELECT * FROM n ORDER BY rank DESC, id LIMIT 500)
        SELECT 'node' AS element, CAST(json_object('data', json_object('id', CAST(id AS VARCHAR), 'label', name, 'kind', kind, 'file', file_path, 'line', line_start, 'summary', coalesce(summary, ''), 'rank', CAST(CAST(rank AS DECIMAL(18, 6)) AS VARCHAR))) AS VARCHAR) AS json FROM t
        UNION ALL SELECT 'edge', CAST(json_object('data', json_object('source', CAST(src AS VARCHAR), 'target', CAST(dst AS VARCHAR), 'kind', kind)) AS VARCHAR)
        FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""",
    "resolved_edges": f"""WITH {N}, r AS (SELECT DISTINCT source_id, refs.kind, target_name, n.repo, list_extract(string_split(target_name, '.'), -1) AS last FROM refs JOIN n ON source_id = id WHERE target_name <> ''),
        w AS (SELECT DISTINCT repo, target_name, last FROM r),
        x AS (SELECT repo, qualified_name AS target_name, max(id) AS exact FROM n GROUP BY ALL),
        o AS (SELECT repo, name AS last, count(*) AS named, max(id) AS only_id FROM n GROUP BY ALL),
        s AS (SELECT w.repo, target_name, count(*) AS ends, max(id) AS ending FROM w JOIN n ON w.repo = n.repo AND w.last = n.name AND suffix(qualified_name, '.' || target_name) GROUP BY ALL),
        f AS (SELECT *, list_extract(string_split(mq, '.'), -1) AS key FROM (SELECT repo, id, replace(regexp_replace(qualified_name, '\\.[^.]*$', ''), '/', '.') AS mq FROM n WHERE kind = 'file')),
        a AS (SELECT *, list_extract(string_split(dotted, '.'), -1) AS key FROM (SELECT *, replace(target_name, '/', '.') AS dotted FROM w)),
        m AS (SELECT a.repo, target_name, min(id) AS module FROM a JOIN f ON a.repo = f.repo AND a.key = f.key
              WHERE mq = dotted OR suffix(mq, '.' || dotted) OR suffix(dotted, mq) GROUP BY ALL),
        y AS (SELECT r.source_id AS src, r.kind, coalesce(exact, CASE WHEN ends = 1 THEN ending END, CASE WHEN named = 1 AND NOT contains(r.target_name, '.') THEN only_id END, CASE WHEN r.kind = 'imports' THEN module END) AS dst
              FROM r LEFT JOIN x USING (repo, target_name) LEFT JOIN s USING (repo, target_name) LEFT JOIN o ON r.repo = o.repo AND r.last = o.last LEFT JOIN m ON r.repo = m.repo AND r.target_name = m.target_name)
        SELECT DISTINCT src, dst, kind FROM y WHERE dst IS NOT NULL AND dst <> src""",
    "cochange_pairs": """WITH c AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS item FROM lineitem),
        k AS (SELECT sha FROM c GROUP BY sha HAVING count(*) BETWEEN 2 AND 50),
        p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM c x JOIN c y ON x.sha = y.sha AND x.item < y.item WHERE x.sha IN (SELECT sha FROM k) GROUP BY ALL HAVING count(*) >= 3)
        SELECT a, b, n, round(n / (SELECT max(n) FROM p), 6) AS weight FROM p""",
}
