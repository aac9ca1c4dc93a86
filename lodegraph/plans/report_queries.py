"""Reports: what differs between two revisions, and results in their canonical order; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.analyses import architecture, store
from lodegraph.compare.report import Revisions
from lodegraph.graph.frame import build_graph, live_symbols, load_graph, merged_edges
from lodegraph.plans import graph_queries as gq
from lodegraph.schemas import rank_of
from lodegraph.tables import table

#: The instant that parts the base revision from the head in these reports.
CUT = "2025-05-15 00:00:00"


def revisions(spark: SparkSession, folder: str) -> Revisions:
    """What was known at the cut and what is known now. A symbol's lines, test flag and number of references stand for its fingerprint, its qualified name for its signature."""
    symbols, edges, cut = table(spark, folder, "symbols"), table(spark, folder, "edges"), F.lit(CUT).cast("timestamp")

    def marks(rows: DataFrame, refers: DataFrame) -> DataFrame:
        n = refers.groupBy("repo_id", F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
        body = F.concat_ws(":", "start_line", "end_line", "is_test", F.coalesce("n", F.lit(0)))
        return rows.join(n, ["repo_id", "id"], "left").select("repo_id", "id", body.alias("fingerprint"), F.col("qualified_name").alias("signature"))

    old, new = live_symbols(symbols.where(F.col("extracted_at") < cut)), live_symbols(symbols)
    old_edges, new_edges = merged_edges(edges.where(F.col("recorded_at") < cut)), merged_edges(edges)
    base = build_graph(old, old_edges, live_symbols(table(spark, folder, "shared_symbols")))
    return Revisions(base, load_graph(spark, folder), marks(old, old_edges), marks(new, new_edges))


def diff_report(spark: SparkSession, folder: str) -> DataFrame:
    return revisions(spark, folder).changes()


def diff_impact(spark: SparkSession, folder: str) -> DataFrame:
    r = revisions(spark, folder)
    return r.affected(r.head.scratch.keep(r.changes()))


def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    r = revisions(spark, folder)
    changes = r.head.scratch.keep(r.changes())
    return r.summary(changes, r.affected(changes))


def _place(group: str, *order) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))


def impact_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of the most called symbol may affect, in report order: surest first, then nearest, then by id."""
    rows = gq.impact_affected(spark, folder)
    return rows.select("repo_id", _place("repo_id", rank_of(F.col("confidence"), ("certain", "possible")), "depth", "id").alias("place"), "id")


def impact_groups_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Affected files and modules, largest first."""
    rows = gq.impact_groups(spark, folder).withColumn("of", F.concat_ws("\u0001", "repo_id", "by"))
    return rows.select("repo_id", "by", _place("of", F.desc("symbols"), "name").alias("place"), "name", "symbols")


def related_tests_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Tests among the callers of the most called symbol, nearest first."""
    g = load_graph(spark, folder)
    rows = g.named(store.related_tests(g, gq.hot_symbols(g), 3, None), nid="id")
    return rows.select(F.col("q").alias("repo_id"), _place("q", "depth", "id").alias("place"), "id", "depth")


def symbol_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of each kind, tests, files and lines spanned by modules, per repository."""
    n = load_graph(spark, folder).nodes
    kinds = ("module", "struct", "enum", "trait", "function", "method")
    return n.groupBy("repo_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count_if("is_test").alias("n_tests"), F.count_distinct("file").alias("n_files"))


def file_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The files one step from the file that most files depend on (ties go to the larger name), in either direction."""
    g = load_graph(spark, folder)
    d = architecture.derive(g, "file").select("repo_id", "from_name", "to_name", "weight")
    fans = d.groupBy("repo_id", F.col("to_name").alias("key")).agg(F.count("*").alias("n"))
    key = fans.groupBy("repo_id").agg(F.max(F.struct("n", "key")).alias("m")).select("repo_id", F.col("m.key").alias("key"))
    return store.one_hop(d, key)


QUERIES = {f.__name__: f for f in (diff_report, diff_impact, diff_summary, impact_ranked, impact_groups_ranked, related_tests_ranked, symbol_counts, file_neighbours)}


def _graph_at(s: str, symbols: str, edges: str, seeds: str) -> str:
    """The graph of a revision and what is downstream of its seeds; names end in ``s``."""
    return f"""
live_{s} AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY extracted_at DESC, deleted_at DESC NULLS LAST) AS rn FROM {symbols} WHERE id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
m_{s} AS (SELECT DISTINCT repo_id, from_id, to_id, relation FROM {edges} WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
n_{s} AS (SELECT repo_id, id, kind, name, file, start_line, end_line, module, is_test, qualified_name, true AS own FROM live_{s}
  UNION ALL SELECT e.repo_id, b.id, b.kind, b.name, b.file, b.start_line, b.end_line, b.module, b.is_test, b.qualified_name, false FROM (SELECT DISTINCT repo_id, unnest([from_id, to_id]) AS id FROM m_{s}) e JOIN borrow b USING (id) ANTI JOIN live_{s} l ON l.repo_id = e.repo_id AND l.id = e.id),
e_{s} AS (SELECT m.* FROM m_{s} m SEMI JOIN n_{s} a ON a.repo_id = m.repo_id AND a.id = m.from_id SEMI JOIN n_{s} b ON b.repo_id = m.repo_id AND b.id = m.to_id),
i_{s} AS (SELECT e.repo_id, e.from_id, e.to_id FROM e_{s} e JOIN n_{s} n ON n.repo_id = e.repo_id AND n.id = e.to_id AND n.kind = 'method' WHERE relation = 'IMPLEMENTS'),
t_{s} AS (SELECT repo_id, to_id AS s, from_id AS d, relation = 'CALLS_CANDIDATE' AS maybe, false AS seed_only FROM e_{s} WHERE relation IN ('CALLS', 'CALLS_CANDIDATE')
  UNION ALL SELECT repo_id, to_id, from_id, false, true FROM i_{s} UNION ALL SELECT repo_id, from_id, to_id, false, false FROM i_{s})""", f"""
seed_{s} AS (SELECT DISTINCT c.repo_id, c.id FROM chg c SEMI JOIN n_{s} n ON n.repo_id = c.repo_id AND n.id = c.id WHERE {seeds}),
sure_{s} AS (SELECT repo_id, id, 0 AS depth FROM seed_{s} UNION SELECT r.repo_id, t.d, r.depth + 1 FROM sure_{s} r JOIN t_{s} t ON t.repo_id = r.repo_id AND t.s = r.id AND NOT t.maybe AND (NOT t.seed_only OR r.depth = 0) WHERE r.depth < 8),
every_{s} AS (SELECT repo_id, id, 0 AS depth FROM seed_{s} UNION SELECT r.repo_id, t.d, r.depth + 1 FROM every_{s} r JOIN t_{s} t ON t.repo_id = r.repo_id AND t.s = r.id AND (NOT t.seed_only OR r.depth = 0) WHERE r.depth < 8),
certain_{s} AS (SELECT repo_id, id, min(depth) AS depth FROM sure_{s} GROUP BY ALL),
down_{s} AS (SELECT *, 0 AS c FROM certain_{s} WHERE depth > 0 UNION ALL SELECT repo_id, id, min(depth), 1 FROM every_{s} ANTI JOIN certain_{s} USING (repo_id, id) GROUP BY ALL)"""


_HEAD = _graph_at("h", "symbols", "edges", "c.change = 'modified'")
_BASE = _graph_at("b", f"(SELECT * FROM symbols WHERE extracted_at < TIMESTAMPTZ '{CUT}+00')", f"(SELECT * FROM edges WHERE recorded_at < TIMESTAMPTZ '{CUT}+00')", "c.change = 'removed' AND c.kind <> 'module'")
_MARK = "start_line || ':' || end_line || ':' || is_test || ':' || coalesce(n, 0)"
_CHANGES = f"""WITH RECURSIVE
borrow AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC, deleted_at DESC NULLS LAST) AS rn FROM shared_symbols) WHERE rn = 1 AND deleted_at IS NULL), {_HEAD[0]}, {_BASE[0]},
nb AS (SELECT repo_id, id, kind, name, file, start_line AS line, {_MARK} AS f, qualified_name AS s FROM live_h LEFT JOIN (SELECT repo_id, from_id AS id, count(*) AS n FROM m_h GROUP BY ALL) USING (repo_id, id)), ob AS (SELECT repo_id, id, kind, name, file, start_line AS line, {_MARK} AS f, qualified_name AS s FROM live_b LEFT JOIN (SELECT repo_id, from_id AS id, count(*) AS n FROM m_b GROUP BY ALL) USING (repo_id, id)),
come AS (SELECT * FROM nb ANTI JOIN ob USING (repo_id, id)), gone AS (SELECT * FROM ob ANTI JOIN nb USING (repo_id, id)),
moves AS (SELECT a.repo_id, r.id AS from_id, a.id AS to_id FROM (SELECT repo_id, kind, name, f, min(id) AS id FROM come WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT repo_id, kind, name, f, min(id) AS id FROM gone WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) = 1) r USING (repo_id, kind, name, f)),
chg AS (SELECT n.repo_id, n.id, NULL::VARCHAR AS previous_id, 'modified' AS change, n.s <> o.s AS signature_changed, n.kind, n.file, n.line FROM nb n JOIN ob o USING (repo_id, id) WHERE n.kind <> 'module' AND n.f IS DISTINCT FROM o.f
  UNION ALL SELECT repo_id, id, NULL, 'added', false, kind, file, line FROM come ANTI JOIN (SELECT repo_id, to_id AS id FROM moves) m USING (repo_id, id)
  UNION ALL SELECT repo_id, id, NULL, 'removed', false, kind, file, line FROM gone ANTI JOIN (SELECT repo_id, from_id AS id FROM moves) m USING (repo_id, id)
  UNION ALL SELECT m.repo_id, m.to_id, m.from_id, 'moved', false, n.kind, n.file, n.line FROM moves m JOIN nb n ON n.repo_id = m.repo_id AND n.id = m.to_id)"""
_AFFECTED = f"""{_CHANGES}, {_HEAD[1]}, {_BASE[1]},
ways AS (SELECT repo_id, id, depth, c, 0 AS side FROM down_h UNION ALL SELECT repo_id, id, depth, c, 1 FROM down_b),
aff AS (SELECT w.repo_id, w.id, CASE w.c WHEN 0 THEN 'certain' ELSE 'possible' END AS confidence, CASE w.side WHEN 0 THEN 'head' ELSE 'base' END AS side, w.depth
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY c, side) AS rn FROM ways) w SEMI JOIN n_h n ON n.repo_id = w.repo_id AND n.id = w.id
  ANTI JOIN (SELECT repo_id, id FROM chg UNION SELECT repo_id, previous_id FROM chg WHERE previous_id IS NOT NULL) x ON x.repo_id = w.repo_id AND x.id = w.id WHERE w.rn = 1)"""
_KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("module", "struct", "enum", "trait", "function", "method"))
ORACLES = {
    "diff_report": _CHANGES + " SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE change WHEN 'modified' THEN 0 WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, file NULLS FIRST, line NULLS FIRST, id) AS place, id, previous_id, change, signature_changed, kind, file, line FROM chg",
    "diff_impact": _AFFECTED + " SELECT repo_id, id, confidence, side, depth FROM aff",
    "diff_summary": _AFFECTED + """,
        own AS (SELECT repo_id, count(*) AS changes, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'moved') AS moved, count(*) FILTER (signature_changed) AS signatures,
          count(*) FILTER (kind IN ('function', 'method')) AS callables, count(*) FILTER (kind IN ('struct', 'enum', 'trait')) AS types, count(*) FILTER (kind = 'module') AS modules, count(DISTINCT file) AS files FROM chg GROUP BY repo_id),
        d AS (SELECT a.repo_id, count(*) FILTER (confidence = 'certain') AS affected, count(*) FILTER (confidence = 'possible') AS possibly_affected, count(*) FILTER (n.is_test) AS affected_tests, count(DISTINCT n.file) FILTER (confidence = 'certain') AS affected_files, count(DISTINCT n.module) FILTER (confidence = 'certain') AS affected_modules
          FROM aff a JOIN n_h n ON n.repo_id = a.repo_id AND n.id = a.id GROUP BY a.repo_id)
        SELECT own.*, coalesce(affected, 0) AS affected, coalesce(possibly_affected, 0) AS possibly_affected, coalesce(affected_tests, 0) AS affected_tests, coalesce(affected_files, 0) AS affected_files, coalesce(affected_modules, 0) AS affected_modules FROM own LEFT JOIN d USING (repo_id)""",
    "impact_ranked": gq.R + f"{gq._IMPACT} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY confidence, depth, id) AS place, id FROM affected",
    "impact_groups_ranked": f"SELECT repo_id, \"by\", row_number() OVER (PARTITION BY repo_id, \"by\" ORDER BY symbols DESC, name) AS place, name, symbols FROM ({gq.ORACLES['impact_groups']})",
    "related_tests_ranked": f"SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY depth, id) AS place, id, depth FROM ({gq.ORACLES['callers_depth3']}) c SEMI JOIN (SELECT repo_id, id FROM (WITH {gq._GRAPH} SELECT * FROM nodes) WHERE is_test) t USING (repo_id, id)",
    "symbol_counts": f"WITH {gq._GRAPH} SELECT repo_id, {_KINDS}, count(*) FILTER (is_test) AS n_tests, count(DISTINCT file) AS n_files FROM nodes GROUP BY repo_id",
    "file_neighbours": "WITH " + gq._deps("file") + """, k AS (SELECT repo_id, arg_max(to_name, (n, to_name)) AS key FROM (SELECT repo_id, to_name, count(*) AS n FROM deps GROUP BY ALL) GROUP BY repo_id)
        SELECT d.repo_id, k.key, 'in' AS direction, d.from_name AS other, d.weight FROM deps d JOIN k ON k.repo_id = d.repo_id AND k.key = d.to_name UNION ALL SELECT d.repo_id, k.key, 'out', d.to_name, d.weight FROM deps d JOIN k ON k.repo_id = d.repo_id AND k.key = d.from_name""",
}
