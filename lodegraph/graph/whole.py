"""Whole-graph algorithms on many graphs at once.

Graphs of at most ``KERNEL_EDGES`` edges are grouped by graph and run through
the in-memory kernels, many at a time. Larger ones run as loops of joins. Both
ways give the same rows; tests hold them against each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.graph import kernels
from lodegraph.session import Scratch

KERNEL_EDGES = 200_000


def split_by_size(links: DataFrame, scratch: Scratch, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(links of small graphs, links of large ones or None)."""
    large = scratch.keep(links.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g"))
    if large.isEmpty():
        return links, None
    return links.join(large, "g", "left_anti"), links.join(large, "g", "left_semi")


def _indexed(pdf: pd.DataFrame) -> tuple[list, list[list[int]]]:
    nodes = sorted(set(pdf["src"]).union(pdf["dst"]))
    at = {v: i for i, v in enumerate(nodes)}
    return nodes, kernels.adjacency(len(nodes), zip(pdf["src"].map(at), pdf["dst"].map(at)))


def component_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, adj = _indexed(pdf)
    rows = []
    for part in kernels.components(adj):
        cyclic = len(part) > 1 or part[0] in adj[part[0]]
        rows += [(pdf["g"].iloc[0], nodes[a], nodes[part[0]], len(part), cyclic) for a in part]
    return pd.DataFrame(rows, columns=["g", "node", "component", "size", "cyclic"])


def strong_components(links: DataFrame, scratch: Scratch, limit: int = KERNEL_EDGES) -> DataFrame:
    """links: g, src, dst. (g, node, component, size, cyclic) for every node with a link; component is the smallest member."""
    links = scratch.keep(links.select("g", "src", "dst").distinct())
    small, large = split_by_size(links, scratch, limit)
    kind = dict(links.dtypes)
    schema = f"g {kind['g']}, node {kind['src']}, component {kind['src']}, size int, cyclic boolean"
    out = small.groupBy("g").applyInPandas(component_kernel, schema)
    if large is not None:
        labelled = _large_components(large, scratch)
        sizes = labelled.groupBy("g", "component").agg(F.count("*").cast("int").alias("size"))
        loops = large.where("src = dst").select("g", F.col("src").alias("node"), F.lit(True).alias("loop"))
        more = labelled.join(sizes, ["g", "component"]).join(loops, ["g", "node"], "left").select("g", "node", "component", "size", ((F.col("size") > 1) | F.col("loop").isNotNull()).alias("cyclic"))
        out = out.unionByName(more)
    return out


def _large_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Trim what has no way in or out, colour forwards with the smallest node, take what reaches its colour backwards; repeat on the rest."""
    nodes = links.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    edges = scratch.keep(links.where("src <> dst"))
    done: list[DataFrame] = []
    left = scratch.keep(nodes)
    while not left.isEmpty():
        while True:
            ends = edges.select("g", F.col("src").alias("node")).distinct().intersect(edges.select("g", F.col("dst").alias("node")).distinct())
            core = scratch.keep(left.join(ends, ["g", "node"], "left_semi"))
            done.append(scratch.keep(left.join(core, ["g", "node"], "left_anti").select("g", "node", F.col("node").alias("component"))))
            changed = done[-1].count()
            edges = scratch.keep(edges.join(core.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi"))
            left = core
            if not changed:
                break
        if left.isEmpty():
            break
        colour = scratch.keep(left.select("g", "node", F.col("node").alias("colour")))
        while True:
            pushed = edges.join(colour.select("g", F.col("node").alias("src"), "colour"), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.min("colour").alias("pushed"))
            better = colour.join(pushed, ["g", "node"], "left").select("g", "node", F.least("colour", "pushed").alias("colour"), (F.col("pushed") < F.col("colour")).alias("moved"))
            better = scratch.keep(better)
            if better.where("moved").isEmpty():
                break
            colour = better.drop("moved")
        inside = scratch.keep(edges.join(colour.select("g", F.col("node").alias("src"), F.col("colour").alias("a")), ["g", "src"]).join(colour.select("g", F.col("node").alias("dst"), F.col("colour").alias("b")), ["g", "dst"]).where("a = b").select("g", "src", "dst"))
        part = scratch.keep(colour.where("node = colour").select("g", "node", F.col("colour").alias("component")))
        front = part
        while True:
            back = inside.join(front.select("g", F.col("node").alias("dst"), "component"), ["g", "dst"]).select("g", F.col("src").alias("node"), "component").distinct()
            front = scratch.keep(back.join(part, ["g", "node"], "left_anti"))
            if front.isEmpty():
                break
            part = scratch.keep(part.unionByName(front))
        done.append(part)
        left = scratch.keep(left.join(part, ["g", "node"], "left_anti"))
        edges = scratch.keep(edges.join(left.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(left.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("g", "node", "component")


def layer_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, adj = _indexed(pdf)
    return pd.DataFrame({"g": pdf["g"].iloc[0], "node": nodes, "layer": kernels.layers(adj)})


def dependency_layers(links: DataFrame, scratch: Scratch, limit: int = KERNEL_EDGES) -> DataFrame:
    """links: g, src depends on dst. (g, node, layer); 0 depends on nothing, members of a cycle share a layer."""
    links = scratch.keep(links.select("g", "src", "dst").distinct())
    small, large = split_by_size(links, scratch, limit)
    kind = dict(links.dtypes)
    out = small.groupBy("g").applyInPandas(layer_kernel, f"g {kind['g']}, node {kind['src']}, layer int")
    if large is not None:
        out = out.unionByName(_large_layers(large, scratch))
    return out


def _large_layers(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Layers of the condensation, peeled from the bottom: a component is settled once all it depends on are."""
    of = scratch.keep(strong_components(links, scratch, 0).select("g", "node", "component"))
    a, b = (of.select("g", F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
    open_ = scratch.keep(links.join(a, ["g", "src"]).join(b, ["g", "dst"]).where("a <> b").select("g", "a", "b").distinct())
    parts = of.select("g", F.col("component").alias("a")).distinct()
    settled, layer = [], 0
    rest = scratch.keep(parts)
    while not rest.isEmpty():
        bottom = scratch.keep(rest.join(open_.select("g", "a").distinct(), ["g", "a"], "left_anti"))
        settled.append(bottom.withColumn("layer", F.lit(layer)))
        rest = scratch.keep(rest.join(bottom, ["g", "a"], "left_anti"))
        open_ = scratch.keep(open_.join(bottom.withColumnRenamed("a", "b"), ["g", "b"], "left_anti"))
        layer += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return of.join(out.withColumnRenamed("a", "component"), ["g", "component"]).select("g", "node", F.col("layer").cast("int").alias("layer"))


def betweenness(links: DataFrame, scratch: Scratch, limit: int = KERNEL_EDGES, shards: int = 16) -> DataFrame:
    """(g, node, score) of every node with a link. The sources of a graph are shared out over tasks; their scores add up.

    A graph above ``limit`` edges is still held whole by each of its tasks,
    which this measure needs; more shards then split the sources finer.
    """
    links = scratch.keep(links.select("g", "src", "dst").distinct())
    sizes = links.groupBy("g").agg(F.count("*").alias("n"))
    spread = sizes.select("g", F.explode(F.sequence(F.lit(0), F.least(F.lit(shards - 1), F.floor(F.col("n") / 2000)).cast("int"))).alias("shard"), (F.least(F.lit(shards - 1), F.floor(F.col("n") / 2000)) + 1).cast("int").alias("of"))
    kind = dict(links.dtypes)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, adj = _indexed(pdf)
        shard, of = int(pdf["shard"].iloc[0]), int(pdf["of"].iloc[0])
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": nodes, "score": kernels.betweenness(adj, range(shard, len(nodes), of))})

    parts = links.join(spread, "g").groupBy("g", "shard").applyInPandas(kernel, f"g {kind['g']}, node {kind['src']}, score double")
    return parts.groupBy("g", "node").agg(F.sum("score").alias("score"))


def cycle_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, adj = _indexed(pdf)
    rows = []
    for n, part in enumerate(kernels.cyclic_components(adj)):
        cycle = kernels.shortest_cycle(adj, part)
        rows += [(pdf["g"].iloc[0], n, i, nodes[a], nodes[cycle[(i + 1) % len(cycle)]], len(part)) for i, a in enumerate(cycle)]
    return pd.DataFrame(rows, columns=["g", "cycle", "pos", "src", "dst", "size"])


def cycle_hops(links: DataFrame, scratch: Scratch, limit: int = KERNEL_EDGES) -> DataFrame:
    """(g, cycle, pos, src, dst, size): the hops of a shortest cycle through the smallest member of each cyclic component; cycles of a graph are numbered by size and smallest member.

    Only links inside cyclic components are kept, so what a kernel holds is one
    graph's cyclic part.
    """
    of = scratch.keep(strong_components(links, scratch, limit).where("cyclic").select("g", "node", "component"))
    kind = dict(links.dtypes)
    inside = links.join(of.select("g", F.col("node").alias("src"), F.col("component").alias("a")), ["g", "src"]).join(of.select("g", F.col("node").alias("dst"), F.col("component").alias("b")), ["g", "dst"]).where("a = b")
    return inside.groupBy("g").applyInPandas(cycle_kernel, f"g {kind['g']}, cycle int, pos int, src {kind['src']}, dst {kind['src']}, size int")
