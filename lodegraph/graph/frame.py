"""The canonical graph: nodes with order-preserving integers, merged edges, and what an edge means for a change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.schemas import NODE_COLUMNS, RELATIONS, rank_of
from lodegraph.session import Scratch
from lodegraph.tables import table


def live_symbols(rows: DataFrame) -> DataFrame:
    """The latest extraction of each (repo_id, id), unless it tells of a deletion."""
    kept = [c for c in NODE_COLUMNS if c not in ("repo_id", "id")]
    one = rows.where("id is not null").groupBy("repo_id", "id").agg(F.max(F.struct("extracted_at", "deleted_at", *kept)).alias("r"))
    return one.where("r.deleted_at is null").select("repo_id", "id", *[f"r.{c}" for c in kept])


def merged_edges(rows: DataFrame) -> DataFrame:
    """One edge for each (repo_id, from_id, to_id, relation): the first row's resolution, all lines sorted once. Null ends refer to nothing."""
    first = F.struct("recorded_at", "loaded_at", "resolution")
    return (
        rows.where("from_id is not null and to_id is not null")
        .groupBy("repo_id", "from_id", "to_id", "relation")
        .agg(F.min_by("resolution", first).alias("resolution"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    )


@dataclass
class Graph:
    """nodes: NODE_COLUMNS and nid, whose order is that of (repo_id, id). edges: repo_id, src, dst (nids), relation, resolution, lines. Both are written tables."""

    scratch: Scratch
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.scratch.spark

    def projection(self, *relations: str) -> DataFrame:
        """(repo_id, src, dst) of these relations, each pair once."""
        return self.edges.where(F.col("relation").isin(*relations)).select("repo_id", "src", "dst").distinct()

    def named(self, df: DataFrame, **columns: str) -> DataFrame:
        """Replaces nid columns by ids: named(df, src="from_id")."""
        for nid, name in columns.items():
            df = df.join(self.nodes.select(F.col("nid").alias(nid), F.col("id").alias(name)), nid).drop(nid)
        return df


def build_graph(symbols: DataFrame, edges: DataFrame, shared: DataFrame | None = None) -> Graph:
    """symbols: NODE_COLUMNS, one row each; shared ones are joined to every repository whose edges name them. Edges with an unknown end are dropped.

    nid is a range-partitioned order number: no repository is sorted in one task.
    """
    scratch = Scratch(symbols.sparkSession, "graph")
    nodes = symbols.select(*NODE_COLUMNS)
    if shared is not None:
        ends = edges.select("repo_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        borrowed = ends.join(shared.select(*[c for c in NODE_COLUMNS if c != "repo_id"]), "id").join(nodes.select("repo_id", "id"), ["repo_id", "id"], "left_anti")
        nodes = nodes.unionByName(borrowed.select(*NODE_COLUMNS))
    ordered = scratch.keep(nodes.repartitionByRange("repo_id", "id").sortWithinPartitions("repo_id", "id").select(F.monotonically_increasing_id().alias("nid"), "*"))
    at = ordered.select("repo_id", "id", "nid")
    linked = edges.join(at.select("repo_id", F.col("id").alias("from_id"), F.col("nid").alias("src")), ["repo_id", "from_id"])
    linked = linked.join(at.select("repo_id", F.col("id").alias("to_id"), F.col("nid").alias("dst")), ["repo_id", "to_id"])
    return Graph(scratch, ordered, scratch.keep(linked.select("repo_id", "src", "dst", "relation", "resolution", "lines")))


#: Graphs that stay built for further questions; a graph is built again once one of its tables changes.
KEPT_GRAPHS = 8
_kept: dict[tuple, Graph] = {}


def _state_of(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """The session and every file of the tables with its size and time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = [spark.sparkContext.applicationId, folder]
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = p.getFileSystem(conf)
        seen += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)]
    return tuple(seen)


def load_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph of the project's tables. One build serves all questions of a session for as long as the tables stay as they are."""
    key = _state_of(spark, folder, ("symbols", "edges", "shared_symbols"))
    if key not in _kept:
        while len(_kept) >= KEPT_GRAPHS:
            del _kept[next(iter(_kept))]
        _kept[key] = build_graph(live_symbols(table(spark, folder, "symbols")), merged_edges(table(spark, folder, "edges")), live_symbols(table(spark, folder, "shared_symbols")))
    return _kept[key]


def impact_edges(g: Graph, possible: bool = False) -> DataFrame:
    """(repo_id, src, dst, step, file_of, key, relation, resolution, lines): when src changes, dst may be affected.

    Callers follow what they call, implementations follow a changed trait
    method, and a trait method follows its implementations. ``key`` orders the
    steps from one src: callers and implementations by node and relation, then
    dispatch. ``seed_only`` steps leave a changed symbol only.
    """
    relations = ("CALLS", "CALLS_CANDIDATE") if possible else ("CALLS",)
    rank = rank_of(F.col("relation"), RELATIONS).cast("string")
    method = g.nodes.where("kind = 'method'").select("nid")
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    calls = g.edges.where(F.col("relation").isin(*relations)).select(
        "repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("relation") == "CALLS", "calls").otherwise("may_call").alias("step"), F.lit(False).alias("seed_only"), F.concat(F.lit("0"), wide("src"), rank).alias("key"), "relation", "resolution", "lines"
    )
    impl = g.edges.where("relation = 'IMPLEMENTS'").join(method.withColumnRenamed("nid", "dst"), "dst", "left_semi")
    down = impl.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("implements").alias("step"), F.lit(True).alias("seed_only"), F.concat(F.lit("0"), wide("src"), rank).alias("key"), "relation", "resolution", "lines")
    up = impl.select("repo_id", "src", "dst", F.lit("dispatches_to").alias("step"), F.lit(False).alias("seed_only"), F.concat(F.lit("1"), wide("dst"), rank).alias("key"), "relation", "resolution", "lines")
    return calls.unionByName(down).unionByName(up)
