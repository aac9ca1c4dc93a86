"""Dependencies between files, modules and crates, and what their graph says: cycles, layers, hotspots, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.graph import whole
from lodegraph.graph.frame import Graph
from lodegraph.schemas import CERTAIN, EVIDENCE_SAMPLES, RELATIONS, rank_of, rounded
from lodegraph.session import Scratch


def in_relation_order(kinds: Column) -> Column:
    """A set of relations in canonical order."""
    return F.filter(F.array(*map(F.lit, RELATIONS)), lambda r: F.array_contains(kinds, r))


def derive(g: Graph, level: str, samples: int = EVIDENCE_SAMPLES) -> DataFrame:
    """(repo_id, from_name, to_name, weight, via, evidence): certain edges between different files or modules, rolled up; the first edges are kept as evidence.

    The samples of a pair come from a map-side top list, so a pair with many
    edges is never collected.
    """
    of = g.nodes.select("nid", "id", F.col(level).alias("name")).where("name is not null")
    a, b = (of.select(F.col("nid").alias(x), F.col("name").alias(f"{y}_name"), F.col("id").alias(f"{y}_id")) for x, y in (("src", "from"), ("dst", "to")))
    crossing = g.edges.where(F.col("relation").isin(*CERTAIN)).join(a, "src").join(b, "dst").where("from_name <> to_name")
    pair = ["repo_id", "from_name", "to_name"]
    flat = crossing.select(*pair, "relation", "src", "dst", rank_of(F.col("relation"), RELATIONS).alias("rank"), F.struct("from_id", "to_id", F.col("relation").alias("kind"), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(0)).alias("line")).alias("e"))
    sums = flat.groupBy(pair).agg(F.count("*").alias("weight"), in_relation_order(F.collect_set("relation")).alias("via"))
    top = flat.withColumn("r", F.row_number().over(Window.partitionBy(pair).orderBy("src", "dst", "rank"))).where(F.col("r") <= samples)
    seen = top.groupBy(pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "e"))), lambda x: x["e"]).alias("evidence"))
    return sums.join(seen, pair)


def crate_of(module: Column) -> Column:
    """First segment of a module's qualified name."""
    return F.split_part(F.regexp_replace(module, r"^[^:]*:(?!:)", ""), F.lit("::"), F.lit(1))


def crate_roll_up(modules: DataFrame) -> DataFrame:
    """Module dependencies by crate, without those inside one crate."""
    flat = modules.select("repo_id", crate_of(F.col("from_name")).alias("from_name"), crate_of(F.col("to_name")).alias("to_name"), "weight", "via").where("from_name <> to_name")
    return flat.groupBy("repo_id", "from_name", "to_name").agg(F.sum("weight").alias("weight"), in_relation_order(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"))


def links_of(g: Graph, level: str) -> DataFrame:
    """The digraph of a level as (g, src, dst): calls between symbols, or dependencies between files, modules or crates."""
    if level == "function":
        return g.projection("CALLS").select(F.col("repo_id").alias("g"), "src", "dst")
    deps = derive(g, "module" if level == "crate" else level)
    if level == "crate":
        deps = crate_roll_up(deps)
    return deps.select(F.col("repo_id").alias("g"), F.col("from_name").alias("src"), F.col("to_name").alias("dst"))


def fans(links: DataFrame) -> DataFrame:
    """(g, node, fan_in, fan_out) over distinct links; a self-loop counts once each way."""
    flat = links.select("g", "src", "dst").distinct()
    ends = flat.select("g", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("g", F.col("e.node").alias("node")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def hotspots(links: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """(g, node, fan_in, fan_out, betweenness, place): the most central nodes of each graph, then by fan-in, then by name."""
    scored = fans(links).join(whole.betweenness(links, scratch), ["g", "node"]).withColumn("betweenness", rounded(F.col("score"), 3))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("betweenness"), F.desc("fan_in"), "node"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).drop("score")


def view(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, node, fan_in, fan_out, in_cycle) for every node with a dependency."""
    of = whole.strong_components(links, scratch).select("g", "node", F.col("cyclic").alias("in_cycle"))
    return fans(links).join(of, ["g", "node"])
