"""The query surface over a graph: lookups, search, explorer, neighbourhoods, related tests, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.graph.frame import Graph
from lodegraph.graph.traverse import bfs, shortest_paths
from lodegraph.schemas import CERTAIN, GRAPH_FORMAT, QUERY_DEPTH, QUERY_NODES, QUERY_RESULTS, TREE_KINDS, Ambiguous, InvalidArgument, NotFound, OutdatedIndex, depth_within, rank_of


def tokens(text: Column) -> Column:
    """Lower-case words of a name, as the search index holds them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def search(nodes: DataFrame, text: str, kinds: tuple[str, ...] | None = None, limit: int = QUERY_RESULTS, offset: int = 0) -> DataFrame:
    """Symbols whose names have a word with each prefix of ``text``: exact names first, then by matched words, shorter and smaller qualified names, ids.

    Every repository has its own page; ``place`` counts from 1.
    """
    wanted = [t for t in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text.lower()).split() if t]
    if not wanted:
        raise InvalidArgument("nothing to search for")
    limit = max(0, min(limit, QUERY_RESULTS))
    rows = nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))
    words = F.array_distinct(F.concat(tokens(F.col("name")), tokens(F.col("qualified_name"))))
    hits = [F.size(F.filter(F.col("words"), _starts(p))) for p in wanted]
    found = rows.withColumn("words", words)
    for h in hits:
        found = found.where(h > 0)
    score = sum(hits[1:], hits[0])
    order = [F.desc(F.lower("name") == text.strip().lower()), F.desc("score"), F.length("qualified_name"), "qualified_name", "id"]
    placed = found.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
    return placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("repo_id", "place", "id", "kind", "name", "score")


def _starts(prefix: str):
    return lambda w: w.startswith(prefix)


def find_symbol(nodes: DataFrame, repo_id: str, text: str, prefer: tuple[str, ...] = ()) -> str:
    """The id that a text names: id, then qualified name, then its end after ``::``, then name; the first step that finds anything decides."""
    own = nodes.where(F.col("repo_id") == repo_id)
    for hit in (F.col("id") == text, F.col("qualified_name") == text, F.col("qualified_name").endswith("::" + text), F.col("name") == text):
        rows = own.where(hit).select("id", "kind").orderBy("id").limit(11).collect()
        if rows:
            preferred = [r["id"] for r in rows if r["kind"] in prefer]
            if len(rows) == 1 or len(preferred) == 1:
                return preferred[0] if len(preferred) == 1 else rows[0]["id"]
            raise Ambiguous(text, [r["id"] for r in rows[:10]])
    raise NotFound(text)


def repository(repositories: DataFrame, text: str) -> str:
    """The repo_id that an id or a name means; an id wins."""
    rows = repositories.where((F.col("repo_id") == text) | (F.col("name") == text)).select("repo_id", "format_version", (F.col("repo_id") == text).alias("exact")).distinct().orderBy(F.desc("exact"), "repo_id").limit(11).collect()
    if not rows:
        raise NotFound(text)
    if not rows[0]["exact"] and len({r["repo_id"] for r in rows}) > 1:
        raise Ambiguous(text, [r["repo_id"] for r in rows])
    check_format(rows[0]["format_version"])
    return rows[0]["repo_id"]


def check_format(version: int | None) -> None:
    if version != GRAPH_FORMAT:
        raise OutdatedIndex(f"graph format {version}, not {GRAPH_FORMAT}; index the repository again")


def repositories(rows: DataFrame) -> DataFrame:
    """One row for each repository, the latest analysis."""
    cols = [c for c in rows.columns if c not in ("repo_id", "analyzed_at")]
    return rows.groupBy("repo_id").agg(F.max_by(F.struct("analyzed_at", *cols), F.col("analyzed_at")).alias("r")).select("repo_id", "r.*")


def symbols_in_order(nodes: DataFrame, repo_id: str, ids: list[str]) -> DataFrame:
    """The symbols with these ids in the order asked for; unknown ids are passed over."""
    asked = nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, id string")
    return nodes.where(F.col("repo_id") == repo_id).join(asked, "id").orderBy("position")


def children(nodes: DataFrame, limit: int = 4 * QUERY_NODES) -> DataFrame:
    """(repo_id, parent, place, id, kind, name): what lies directly below each symbol, by kind, name and id."""
    order = Window.partitionBy("repo_id", "parent").orderBy(rank_of(F.col("kind"), TREE_KINDS), "name", "id")
    return nodes.where("parent is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("repo_id", "parent", "place", "id", "kind", "name")


def one_hop(dependencies: DataFrame, keys: DataFrame, direction: str = "both") -> DataFrame:
    """(repo_id, key, direction, other, weight): what depends on each key (in), or what it depends on (out), one step away.

    dependencies: repo_id, from_name, to_name, weight. keys: repo_id, key. An
    unknown key has no rows; ``direction`` is in, out or both.
    """
    if direction not in ("in", "out", "both"):
        raise InvalidArgument(f"direction {direction}: in, out or both")
    ways = [("in", "to_name", "from_name"), ("out", "from_name", "to_name")]
    parts = [
        dependencies.join(keys.select("repo_id", F.col("key").alias(own)), ["repo_id", own]).select("repo_id", F.col(own).alias("key"), F.lit(name).alias("direction"), F.col(other).alias("other"), "weight")
        for name, own, other in ways
        if direction in (name, "both")
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def crates(nodes: DataFrame) -> DataFrame:
    """Root modules: modules without a parent."""
    return nodes.where("kind = 'module' and parent is null").select("repo_id", "id", "name", "file")


def neighbours(g: Graph, starts: DataFrame, direction: str, relations: tuple[str, ...], depth: int, max_nodes: int | None = QUERY_NODES):
    """Level-wise traversal from starts (q, nid); ``direction`` is in, out or both. Step columns: relation."""
    depth_within(depth, QUERY_DEPTH)
    e = g.edges.where(F.col("relation").isin(*relations)).withColumnRenamed("repo_id", "g")
    out = e.select("g", "src", "dst", "relation")
    back = e.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    keyed = steps.withColumn("key", F.concat(F.lpad(F.hex("dst"), 16, "0"), "relation"))
    placed = starts.select("q", "nid").join(g.nodes.select("nid", F.col("repo_id").alias("g")), "nid")
    return bfs(keyed, placed, g.scratch, depth, max_nodes, ("relation",))


def callers(g: Graph, starts: DataFrame, depth: int, max_nodes: int | None = QUERY_NODES):
    return neighbours(g, starts, "in", ("CALLS",), depth, max_nodes)


def callees(g: Graph, starts: DataFrame, depth: int, max_nodes: int | None = QUERY_NODES):
    return neighbours(g, starts, "out", ("CALLS",), depth, max_nodes)


def related_tests(g: Graph, starts: DataFrame, depth: int, max_nodes: int | None = QUERY_NODES) -> DataFrame:
    """(q, nid, depth) of tests among the callers."""
    found = callers(g, starts, depth, max_nodes).visited.where("depth > 0")
    return found.join(g.nodes.where("is_test").select("nid"), "nid", "left_semi").select("q", "nid", "depth")


def shortest(g: Graph, pairs: DataFrame, max_depth: int = QUERY_DEPTH) -> DataFrame:
    """pairs: q, a, b. (q, pos, nid) along certain relations."""
    placed = pairs.join(g.nodes.select(F.col("nid").alias("a"), F.col("repo_id").alias("g")), "a")
    return shortest_paths(g.projection(*CERTAIN).withColumnRenamed("repo_id", "g"), placed, g.scratch, depth_within(max_depth))


def graph_stats(g: Graph) -> DataFrame:
    """(repo_id, what, label, n): nodes by kind, tests, relationships by type."""
    kinds = g.nodes.groupBy("repo_id", F.col("kind").alias("label")).agg(F.count("*").alias("n")).select("repo_id", F.lit("node").alias("what"), "label", "n")
    tests = g.nodes.where("is_test").groupBy("repo_id").agg(F.count("*").alias("n")).select("repo_id", F.lit("node").alias("what"), F.lit("test").alias("label"), "n")
    rels = g.edges.groupBy("repo_id", F.col("relation").alias("label")).agg(F.count("*").alias("n")).select("repo_id", F.lit("relationship").alias("what"), "label", "n")
    return kinds.unionByName(tests).unionByName(rels)
