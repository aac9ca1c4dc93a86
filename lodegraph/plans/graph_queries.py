"""Queries over the code graph of every repository at once, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.analyses import architecture, store
from lodegraph.analyses.impact import Impact, impact, select_tests
from lodegraph.graph import whole
from lodegraph.graph.frame import Graph, live_symbols, load_graph, merged_edges
from lodegraph.schemas import CERTAIN
from lodegraph.tables import table


def _text(lines):
    return F.concat_ws(",", F.transform(lines, lambda x: x.cast("string")))


def hot_symbols(g: Graph) -> DataFrame:
    """(q, nid): the most called symbol of each repository; ties go to the larger id."""
    fans = architecture.fans(architecture.links_of(g, "function")).where("fan_in > 0")
    return fans.groupBy("g").agg(F.max(F.struct("fan_in", "node")).alias("m")).select(F.col("g").alias("q"), F.col("m.node").alias("nid"))


def edge_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged_edges(table(spark, folder, "edges")).withColumn("lines", _text("lines"))


def live_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return live_symbols(table(spark, folder, "symbols")).select("repo_id", "id", "kind", "file", "module", "is_test")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical edges: both ends known, shared symbols included."""
    g = load_graph(spark, folder)
    return g.named(g.edges, src="from_id", dst="to_id").select("repo_id", "from_id", "to_id", "relation", _text("lines").alias("lines"))


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return store.graph_stats(load_graph(spark, folder))


def call_degrees(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    fans = architecture.fans(architecture.links_of(g, "function"))
    return g.named(fans.withColumnRenamed("node", "nid"), nid="id").select(F.col("g").alias("repo_id"), "id", "fan_in", "fan_out")


def _reached(g: Graph, found: DataFrame) -> DataFrame:
    return g.named(found.where("depth > 0"), nid="id").select(F.col("q").alias("repo_id"), "id", "depth")


def callers_depth3(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return _reached(g, store.callers(g, hot_symbols(g), 3, None).visited)


def callees_depth2(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    widest = architecture.fans(architecture.links_of(g, "function")).where("fan_out > 0").groupBy("g").agg(F.max(F.struct("fan_out", "node")).alias("m"))
    return _reached(g, store.callees(g, widest.select(F.col("g").alias("q"), F.col("m.node").alias("nid")), 2, None).visited)


def _hot_impact(g: Graph, possible: bool = False) -> Impact:
    return impact(g, hot_symbols(g), max_nodes=None, possible=possible)


def impact_affected(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of each repository's most called symbol may affect, certain and possible."""
    g = load_graph(spark, folder)
    rows = g.named(_hot_impact(g, True).affected, nid="id")
    return rows.select(F.col("q").alias("repo_id"), "id", "depth", "confidence")


def impact_score(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return _hot_impact(g).score().withColumnRenamed("q", "repo_id")


def impact_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    report = _hot_impact(g)
    return report.groups("file").withColumn("by", F.lit("file")).unionByName(report.groups("module").withColumn("by", F.lit("module"))).withColumnRenamed("q", "repo_id")


def impact_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The chain of facts behind each affected symbol."""
    g = load_graph(spark, folder)
    steps = _hot_impact(g).evidence().select("q", "nid", F.posexplode("path").alias("pos", "s")).select("q", "nid", "pos", F.col("s.nid").alias("source"), F.col("s.parent").alias("target"), F.col("s.step").alias("step"), _text(F.col("s.lines")).alias("lines"))
    return g.named(steps, nid="id", source="from_id", target="to_id").select(F.col("q").alias("repo_id"), "id", "pos", "from_id", "to_id", "step", "lines")


def impact_chain_length(spark: SparkSession, folder: str) -> DataFrame:
    return impact_evidence(spark, folder).groupBy("repo_id", "id").agg(F.count("*").alias("steps"))


def selected_tests(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    chosen = select_tests(g, hot_symbols(g), max_nodes=None, possible=True, per_symbol=False)["selected"]
    return g.named(chosen, nid="id").select(F.col("q").alias("repo_id"), "id", "depth", "confidence")


def test_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Direct, transitive and possible tests with the calls in their chains."""
    g = load_graph(spark, folder)
    chosen = select_tests(g, hot_symbols(g), max_nodes=None, possible=True, per_symbol=False)["selected"]
    return g.named(chosen, nid="id").select(F.col("q").alias("repo_id"), "id", "depth", "calls", "selection")


def untested_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The three most called callables of each repository that no test reaches."""
    g = load_graph(spark, folder)
    from pyspark.sql import Window

    called = architecture.fans(architecture.links_of(g, "function")).where("fan_in > 0").join(g.nodes.where("kind in ('function', 'method') and not is_test").select(F.col("nid").alias("node")), "node", "left_semi")
    top = called.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("fan_in"), F.desc("node")))).where("r <= 3")
    rest = select_tests(g, top.select(F.col("g").alias("q"), F.col("node").alias("nid")), max_nodes=None)["untested"]
    return g.named(rest, nid="id").select(F.col("q").alias("repo_id"), "id")


def call_components(spark: SparkSession, folder: str) -> DataFrame:
    """Cyclic components of the call graph; a component is named by its smallest member."""
    g = load_graph(spark, folder)
    parts = whole.strong_components(architecture.links_of(g, "function"), g.scratch).where("cyclic")
    return g.named(parts, node="id", component="component_id").select(F.col("g").alias("repo_id"), "id", "component_id", "size")


def module_cycles(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return whole.strong_components(architecture.links_of(g, "module"), g.scratch).where("cyclic").select(F.col("g").alias("repo_id"), F.col("node").alias("module"), "component", "size")


def module_cycle_hops(spark: SparkSession, folder: str) -> DataFrame:
    """The hops of a shortest cycle through the smallest member of each module cycle."""
    g = load_graph(spark, folder)
    return whole.cycle_hops(architecture.links_of(g, "module"), g.scratch).withColumnRenamed("g", "repo_id")


def module_layers(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return whole.dependency_layers(architecture.links_of(g, "module"), g.scratch).select(F.col("g").alias("repo_id"), F.col("node").alias("module"), "layer")


def module_view(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return architecture.view(architecture.links_of(g, "module"), g.scratch).select(F.col("g").alias("repo_id"), F.col("node").alias("module"), "fan_in", "fan_out", "in_cycle")


def module_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return architecture.hotspots(architecture.links_of(g, "module"), g.scratch, 5).select(F.col("g").alias("repo_id"), F.col("node").alias("module"), "fan_in", "fan_out", F.round("betweenness", 2).alias("betweenness"))


def call_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    spots = architecture.hotspots(architecture.links_of(g, "function"), g.scratch, 20)
    return g.named(spots, node="id").select(F.col("g").alias("repo_id"), "place", "id", "fan_in", "fan_out", "betweenness")


def _derived(spark: SparkSession, folder: str, level: str) -> DataFrame:
    d = architecture.derive(load_graph(spark, folder), level)
    samples = F.concat_ws(";", F.transform("evidence", lambda e: F.concat_ws("|", e["from_id"], e["to_id"], e["kind"], e["line"].cast("string"))))
    return d.select("repo_id", "from_name", "to_name", "weight", F.concat_ws(",", "via").alias("via"), samples.alias("evidence"))


def file_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, "file")


def module_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, "module")


def crate_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    g = load_graph(spark, folder)
    return architecture.crate_roll_up(architecture.derive(g, "module")).withColumn("via", F.concat_ws(",", "via"))


def shortest_path_length(spark: SparkSession, folder: str) -> DataFrame:
    """Steps from each repository's smallest test to its most called symbol, where a path of at most 10 exists."""
    g = load_graph(spark, folder)
    first = g.nodes.where("is_test").groupBy("repo_id").agg(F.min("nid").alias("a")).withColumnRenamed("repo_id", "q")
    path = store.shortest(g, first.join(hot_symbols(g).withColumnRenamed("nid", "b"), "q"))
    return path.groupBy("q").agg(F.max("pos").alias("length")).withColumnRenamed("q", "repo_id")


def search_prefix(spark: SparkSession, folder: str) -> DataFrame:
    nodes = live_symbols(table(spark, folder, "symbols"))
    return store.search(nodes, "pack or").select("repo_id", "place", "id", "score")


def children_ordered(spark: SparkSession, folder: str) -> DataFrame:
    nodes = live_symbols(table(spark, folder, "symbols"))
    return store.children(nodes).select("repo_id", "parent", "place", "id")


def root_modules(spark: SparkSession, folder: str) -> DataFrame:
    return store.crates(live_symbols(table(spark, folder, "symbols")))


QUERIES = {
    f.__name__: f
    for f in (
        edge_merge, live_nodes, graph_edges, graph_stats, call_degrees, callers_depth3, callees_depth2, impact_affected, impact_score, impact_groups, impact_evidence, impact_chain_length, selected_tests, test_chains,
        untested_hot, call_components, module_cycles, module_cycle_hops, module_layers, module_view, module_hotspots, call_hotspots, file_dependencies, module_dependencies, crate_dependencies, shortest_path_length,
        search_prefix, children_ordered, root_modules,
    )
}

_RANK = "CASE relation WHEN 'CALLS' THEN 0 WHEN 'CALLS_CANDIDATE' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END"
_LIVE = """live AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY extracted_at DESC, deleted_at DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL)"""
_MERGED = """merged AS (SELECT repo_id, from_id, to_id, relation, first(resolution ORDER BY recorded_at, loaded_at, resolution NULLS FIRST) AS resolution, list_sort(list_distinct(flatten(list(lines)))) AS lines
  FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY repo_id, from_id, to_id, relation)"""
_GRAPH = f"""{_LIVE}, {_MERGED},
borrow AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC, deleted_at DESC NULLS LAST) AS rn FROM shared_symbols) WHERE rn = 1 AND deleted_at IS NULL),
ends AS (SELECT DISTINCT repo_id, unnest([from_id, to_id]) AS id FROM merged),
nodes AS (SELECT repo_id, id, kind, file, module, is_test FROM live UNION ALL SELECT e.repo_id, b.id, b.kind, b.file, b.module, b.is_test FROM ends e JOIN borrow b USING (id) ANTI JOIN live l ON l.repo_id = e.repo_id AND l.id = e.id),
ge AS (SELECT m.* FROM merged m SEMI JOIN nodes a ON a.repo_id = m.repo_id AND a.id = m.from_id SEMI JOIN nodes b ON b.repo_id = m.repo_id AND b.id = m.to_id),
calls AS (SELECT DISTINCT repo_id, from_id, to_id FROM ge WHERE relation = 'CALLS'),
fans AS (SELECT repo_id, id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT repo_id, from_id AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT repo_id, to_id, 1, 0 FROM calls) GROUP BY ALL),
hot AS (SELECT repo_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, id DESC) AS rn FROM fans WHERE fan_in > 0) WHERE rn = 1)"""
_IMPACT = f"""{_GRAPH},
impl AS (SELECT e.repo_id, e.from_id, e.to_id FROM ge e JOIN nodes n ON n.repo_id = e.repo_id AND n.id = e.to_id AND n.kind = 'method' WHERE relation = 'IMPLEMENTS'),
steps AS (
  SELECT repo_id, to_id AS s, from_id AS d, relation = 'CALLS_CANDIDATE' AS maybe, false AS seed_only FROM ge WHERE relation IN ('CALLS', 'CALLS_CANDIDATE')
  UNION ALL SELECT repo_id, to_id, from_id, false, true FROM impl
  UNION ALL SELECT repo_id, from_id, to_id, false, false FROM impl),
sure AS (SELECT repo_id, id, 0 AS depth FROM hot UNION SELECT r.repo_id, t.d, r.depth + 1 FROM sure r JOIN steps t ON t.repo_id = r.repo_id AND t.s = r.id AND NOT t.maybe AND (NOT t.seed_only OR r.depth = 0) WHERE r.depth < 8),
every AS (SELECT repo_id, id, 0 AS depth FROM hot UNION SELECT r.repo_id, t.d, r.depth + 1 FROM every r JOIN steps t ON t.repo_id = r.repo_id AND t.s = r.id AND (NOT t.seed_only OR r.depth = 0) WHERE r.depth < 8),
certain AS (SELECT repo_id, id, min(depth) AS depth FROM sure GROUP BY ALL HAVING min(depth) > 0),
possible AS (SELECT repo_id, id, min(depth) AS depth FROM every GROUP BY ALL HAVING min(depth) > 0),
affected AS (SELECT *, 'certain' AS confidence FROM certain UNION ALL SELECT *, 'possible' FROM possible ANTI JOIN certain USING (repo_id, id))"""
_SCORE = ", ".join(f"floor(100 * {w} * least(1, ln(1.0 + {n}) / ln(1.0 + {s})) * 10 + 0.5) / 10 AS c{i}" for i, (n, w, s) in enumerate((("direct_dependents", 0.20, 10), ("transitive_dependents", 0.25, 100), ("affected_modules", 0.20, 10), ("affected_tests", 0.15, 25), ("fan_in", 0.10, 10), ("dependency_depth", 0.10, 6))))


def _deps(level: str) -> str:
    return f"""{_GRAPH},
crossing AS (SELECT e.*, a.{level} AS from_name, b.{level} AS to_name, {_RANK} AS rank FROM ge e JOIN nodes a ON a.repo_id = e.repo_id AND a.id = e.from_id JOIN nodes b ON b.repo_id = e.repo_id AND b.id = e.to_id
  WHERE relation <> 'CALLS_CANDIDATE' AND a.{level} <> b.{level}),
deps AS (SELECT repo_id, from_name, to_name, count(*) AS weight, list(relation) AS rels,
  array_to_string(list(from_id || '|' || to_id || '|' || relation || '|' || coalesce(lines[1], 0) ORDER BY from_id, to_id, rank)[1:5], ';') AS evidence FROM crossing GROUP BY ALL)"""


_VIA = "array_to_string(list_filter(['CALLS', 'CALLS_CANDIDATE', 'IMPORTS', 'IMPLEMENTS'], lambda x: list_contains(rels, x)), ',')"
_MODULE = f"""{_deps("module")},
links AS (SELECT DISTINCT repo_id, from_name AS s, to_name AS d FROM deps),
reach AS (SELECT repo_id, s AS a, d AS b FROM links UNION SELECT r.repo_id, r.a, l.d FROM reach r JOIN links l ON l.repo_id = r.repo_id AND l.s = r.b),
cyclic AS (SELECT DISTINCT repo_id, a FROM reach WHERE a = b),
parts AS (SELECT x.repo_id, x.a AS module, min(x.b) AS component, count(DISTINCT x.b) AS size FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY ALL),
mfans AS (SELECT repo_id, id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT repo_id, s AS id, 0 AS i, 1 AS o FROM links UNION ALL SELECT repo_id, d, 1, 0 FROM links) GROUP BY ALL)"""
R = "WITH RECURSIVE "
ORACLES = {
    "edge_merge": f"WITH {_MERGED} SELECT repo_id, from_id, to_id, relation, resolution, array_to_string(lines, ',') AS lines FROM merged",
    "live_nodes": f"WITH {_LIVE} SELECT repo_id, id, kind, file, module, is_test FROM live",
    "graph_edges": f"WITH {_GRAPH} SELECT repo_id, from_id, to_id, relation, array_to_string(lines, ',') AS lines FROM ge",
    "graph_stats": f"WITH {_GRAPH} SELECT repo_id, 'node' AS what, kind AS label, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT repo_id, 'node', 'test', count(*) FROM nodes WHERE is_test GROUP BY ALL UNION ALL SELECT repo_id, 'relationship', relation, count(*) FROM ge GROUP BY ALL",
    "call_degrees": f"WITH {_GRAPH} SELECT * FROM fans",
    "callers_depth3": R + f"{_GRAPH}, r AS (SELECT repo_id, id, 0 AS depth FROM hot UNION SELECT r.repo_id, c.from_id, r.depth + 1 FROM r JOIN calls c ON c.repo_id = r.repo_id AND c.to_id = r.id WHERE r.depth < 3) SELECT repo_id, id, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0",
    "callees_depth2": R + f"{_GRAPH}, wide AS (SELECT repo_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_out DESC, id DESC) AS rn FROM fans WHERE fan_out > 0) WHERE rn = 1), r AS (SELECT repo_id, id, 0 AS depth FROM wide UNION SELECT r.repo_id, c.to_id, r.depth + 1 FROM r JOIN calls c ON c.repo_id = r.repo_id AND c.from_id = r.id WHERE r.depth < 2) SELECT repo_id, id, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0",
    "impact_affected": R + f"{_IMPACT} SELECT repo_id, id, depth, confidence FROM affected",
    "impact_chain_length": R + f"{_IMPACT} SELECT repo_id, id, depth AS steps FROM certain",
    "selected_tests": R + f"{_IMPACT} SELECT a.repo_id, a.id, a.depth, a.confidence FROM affected a JOIN nodes n USING (repo_id, id) WHERE n.is_test",
    "impact_groups": R + f"{_IMPACT} SELECT c.repo_id, 'file' AS \"by\", n.file AS name, count(*) AS symbols, count(*) FILTER (n.is_test) AS tests FROM certain c JOIN nodes n USING (repo_id, id) WHERE n.file IS NOT NULL GROUP BY ALL UNION ALL SELECT c.repo_id, 'module', n.module, count(*), count(*) FILTER (n.is_test) FROM certain c JOIN nodes n USING (repo_id, id) WHERE n.module IS NOT NULL GROUP BY ALL",
    "impact_score": R + f"""{_IMPACT},
        x AS (SELECT h.repo_id, count(c.id) FILTER (c.depth = 1) AS direct_dependents, count(c.id) AS transitive_dependents, count(DISTINCT n.module) AS affected_modules, count(*) FILTER (n.is_test) AS affected_tests,
          coalesce(max(c.depth), 0) AS dependency_depth FROM hot h LEFT JOIN certain c ON c.repo_id = h.repo_id LEFT JOIN nodes n ON n.repo_id = c.repo_id AND n.id = c.id GROUP BY ALL),
        f AS (SELECT h.repo_id, count(DISTINCT c.from_id) FILTER (c.from_id <> h.id) AS fan_in FROM hot h LEFT JOIN calls c ON c.repo_id = h.repo_id AND c.to_id = h.id GROUP BY ALL),
        p AS (SELECT x.*, f.fan_in, {_SCORE} FROM x JOIN f USING (repo_id)),
        t AS (SELECT *, floor((c0 + c1 + c2 + c3 + c4 + c5) * 10 + 0.5) / 10 AS score FROM p)
        SELECT repo_id, direct_dependents, transitive_dependents, affected_modules, affected_tests, fan_in, dependency_depth, score, CASE WHEN score < 25 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END AS level FROM t""",
    "untested_hot": R + f"""{_GRAPH},
        impl AS (SELECT e.repo_id, e.from_id, e.to_id FROM ge e JOIN nodes n ON n.repo_id = e.repo_id AND n.id = e.to_id AND n.kind = 'method' WHERE relation = 'IMPLEMENTS'),
        steps AS (SELECT repo_id, to_id AS s, from_id AS d, false AS seed_only FROM calls UNION ALL SELECT repo_id, to_id, from_id, true FROM impl UNION ALL SELECT repo_id, from_id, to_id, false FROM impl),
        top AS (SELECT repo_id, id FROM (SELECT f.*, row_number() OVER (PARTITION BY f.repo_id ORDER BY fan_in DESC, f.id DESC) AS rn FROM fans f JOIN nodes n USING (repo_id, id) WHERE fan_in > 0 AND n.kind IN ('function', 'method') AND NOT n.is_test) WHERE rn <= 3),
        r AS (SELECT repo_id, id AS seed, id, 0 AS depth FROM top UNION SELECT r.repo_id, r.seed, t.d, r.depth + 1 FROM r JOIN steps t ON t.repo_id = r.repo_id AND t.s = r.id AND (NOT t.seed_only OR r.depth = 0) WHERE r.depth < 8)
        SELECT repo_id, id FROM top ANTI JOIN (SELECT r.repo_id, r.seed AS id FROM r JOIN nodes n ON n.repo_id = r.repo_id AND n.id = r.id WHERE n.is_test AND r.depth > 0) t USING (repo_id, id)""",
    "call_components": R + f"""{_GRAPH}, reach AS (SELECT repo_id, from_id AS a, to_id AS b FROM calls UNION SELECT r.repo_id, r.a, c.to_id FROM reach r JOIN calls c ON c.repo_id = r.repo_id AND c.from_id = r.b)
        SELECT x.repo_id, x.a AS id, min(x.b) AS component_id, count(DISTINCT x.b) AS size FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY ALL""",
    "module_cycles": R + f"{_MODULE} SELECT repo_id, module, component, size FROM parts",
    "module_view": R + f"{_MODULE} SELECT f.repo_id, f.id AS module, fan_in, fan_out, c.a IS NOT NULL AS in_cycle FROM mfans f LEFT JOIN cyclic c ON c.repo_id = f.repo_id AND c.a = f.id",
    "module_layers": R + f"""{_MODULE},
        named AS (SELECT f.repo_id, f.id AS module, coalesce(p.component, f.id) AS comp FROM mfans f LEFT JOIN parts p ON p.repo_id = f.repo_id AND p.module = f.id),
        cl AS (SELECT DISTINCT l.repo_id, a.comp AS a, b.comp AS b FROM links l JOIN named a ON a.repo_id = l.repo_id AND a.module = l.s JOIN named b ON b.repo_id = l.repo_id AND b.module = l.d WHERE a.comp <> b.comp),
        up AS (SELECT DISTINCT repo_id, comp, 0 AS layer FROM named UNION SELECT c.repo_id, c.a, u.layer + 1 FROM up u JOIN cl c ON c.repo_id = u.repo_id AND c.b = u.comp)
        SELECT n.repo_id, n.module, max(u.layer) AS layer FROM named n JOIN up u ON u.repo_id = n.repo_id AND u.comp = n.comp GROUP BY ALL""",
    "module_hotspots": R + f"""{_MODULE},
        bf AS (SELECT repo_id, s AS a, d AS b, 1 AS d FROM links WHERE s <> d UNION SELECT r.repo_id, r.a, l.d, r.d + 1 FROM bf r JOIN links l ON l.repo_id = r.repo_id AND l.s = r.b WHERE r.d < 30 AND l.d <> r.a),
        dist AS (SELECT repo_id, a, b, min(d) AS d FROM bf GROUP BY ALL),
        walk AS (SELECT l.repo_id, l.s AS a, l.d AS b, 1 AS d, 1.0::DOUBLE AS n, [l.s, l.d] AS p FROM links l WHERE l.s <> l.d UNION ALL
          SELECT w.repo_id, w.a, l.d, w.d + 1, 1.0, list_append(w.p, l.d) FROM walk w JOIN links l ON l.repo_id = w.repo_id AND l.s = w.b JOIN dist x ON x.repo_id = w.repo_id AND x.a = w.a AND x.b = l.d AND x.d = w.d + 1),
        sigma AS (SELECT repo_id, a, b, d, sum(n) AS n FROM walk GROUP BY ALL),
        btw AS (SELECT x.repo_id, x.b AS id, sum(x.n * y.n / z.n) AS score FROM sigma x JOIN sigma y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b <> x.a JOIN sigma z ON z.repo_id = x.repo_id AND z.a = x.a AND z.b = y.b AND z.d = x.d + y.d GROUP BY ALL),
        s AS (SELECT f.repo_id, f.id AS module, f.fan_in, f.fan_out, floor(coalesce(b.score, 0) * 1000 + 0.5) / 1000 AS betweenness FROM mfans f LEFT JOIN btw b ON b.repo_id = f.repo_id AND b.id = f.id),
        o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY betweenness DESC, fan_in DESC, module) AS rn FROM s)
        SELECT repo_id, module, fan_in, fan_out, round(betweenness, 2) AS betweenness FROM o WHERE rn <= 5""",
    "file_dependencies": f"WITH {_deps('file')} SELECT repo_id, from_name, to_name, weight, {_VIA} AS via, evidence FROM deps",
    "module_dependencies": f"WITH {_deps('module')} SELECT repo_id, from_name, to_name, weight, {_VIA} AS via, evidence FROM deps",
    "crate_dependencies": f"""WITH {_deps("module")}, c AS (SELECT repo_id, split_part(regexp_replace(from_name, '^[^:]*:', ''), '::', 1) AS from_name, split_part(regexp_replace(to_name, '^[^:]*:', ''), '::', 1) AS to_name, weight, rels FROM deps),
        r AS (SELECT repo_id, from_name, to_name, sum(weight)::BIGINT AS weight, flatten(list(rels)) AS rels FROM c WHERE from_name <> to_name GROUP BY ALL) SELECT repo_id, from_name, to_name, weight, {_VIA} AS via FROM r""",
    "shortest_path_length": R + f"""{_GRAPH}, any_e AS (SELECT DISTINCT repo_id, from_id, to_id FROM ge WHERE relation <> 'CALLS_CANDIDATE'), st AS (SELECT repo_id, min(id) AS id FROM nodes WHERE is_test GROUP BY repo_id),
        r AS (SELECT st.repo_id, st.id, 0 AS depth FROM st SEMI JOIN hot USING (repo_id) UNION SELECT r.repo_id, e.to_id, r.depth + 1 FROM r JOIN any_e e ON e.repo_id = r.repo_id AND e.from_id = r.id WHERE r.depth < 10)
        SELECT r.repo_id, min(r.depth) AS length FROM r JOIN hot h ON h.repo_id = r.repo_id AND h.id = r.id GROUP BY ALL""",
    "search_prefix": f"""WITH {_LIVE}, w AS (SELECT repo_id, id, name, qualified_name, list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || qualified_name), '[^a-z0-9_]+'), lambda t: t <> '')) AS words FROM live),
        h AS (SELECT *, len(list_filter(words, lambda t: starts_with(t, 'pack'))) AS a, len(list_filter(words, lambda t: starts_with(t, 'or'))) AS b FROM w),
        o AS (SELECT *, a + b AS score, row_number() OVER (PARTITION BY repo_id ORDER BY lower(name) = 'pack or' DESC, a + b DESC, length(qualified_name), qualified_name, id) AS place FROM h WHERE a > 0 AND b > 0)
        SELECT repo_id, place, id, score FROM o WHERE place <= 50""",
    "children_ordered": f"""WITH {_LIVE} SELECT repo_id, parent, row_number() OVER (PARTITION BY repo_id, parent ORDER BY CASE kind WHEN 'module' THEN 0 WHEN 'trait' THEN 1 WHEN 'struct' THEN 2 WHEN 'enum' THEN 3 WHEN 'function' THEN 4 ELSE 5 END, name, id) AS place, id
        FROM live WHERE parent IS NOT NULL QUALIFY place <= 2000""",
    "root_modules": f"WITH {_LIVE} SELECT repo_id, id, name, file FROM live WHERE kind = 'module' AND parent IS NULL",
}
