"""Breadth-first traversals for many queries over many graphs at once.

Graphs of at most ``KERNEL_EDGES`` steps are grouped with their queries and
searched in memory, many at a time. Larger ones share one loop of joins: a
level is one join of the frontier with the steps, an anti-join with what is
visited and a minimum per node. There, which neighbour wins is told by an order
key that grows by one piece a level, so no level is ranked in one task, and
each level is a table in the shared folder. Both ways give the same rows.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.graph.whole import KERNEL_EDGES, split_by_size
from lodegraph.session import Scratch


@dataclass
class Reached:
    """visited: g, q, nid, depth, parent (null for a start), and the carried step columns. truncated: the queries cut by the node limit."""

    visited: DataFrame
    truncated: DataFrame


def bfs(steps: DataFrame, starts: DataFrame, scratch: Scratch, max_depth: int, max_nodes: int | None = None, carry: tuple[str, ...] = (), limit: int = KERNEL_EDGES) -> Reached:
    """steps: g, src, dst, key (orders the steps of one src; ties go to the smallest dst), optionally seed_only. starts: g, q, nid; the starts of a query are taken in nid order.

    A node is reached by the first step in (order of its source, key). Steps
    that are ``seed_only`` leave a start only. With ``max_nodes``, a query stops
    at the node that would exceed it, starts not counted; it is then truncated.
    """
    if "seed_only" not in steps.columns:
        steps = steps.withColumn("seed_only", F.lit(False))
    steps = scratch.keep(steps.select("g", "src", "dst", "key", "seed_only", *carry))
    starts = scratch.keep(starts.select("g", "q", "nid").distinct())
    small, large = split_by_size(steps, scratch, limit)
    fields = {f.name: f for f in [*starts.schema.fields, *steps.schema.fields]}
    out = f"g {fields['g'].dataType.simpleString()}, q {fields['q'].dataType.simpleString()}, nid bigint, depth int, parent bigint, " + "".join(f"{c} {fields[c].dataType.simpleString()}, " for c in carry) + "cut boolean"
    own = starts if large is None else starts.join(large.select("g").distinct(), "g", "left_anti")
    found = scratch.keep(own.groupBy("g").cogroup(small.groupBy("g")).applyInPandas(_kernel(max_depth, max_nodes, carry), out))
    visited, truncated = found.drop("cut"), found.where("cut").select("q").distinct()
    if large is not None:
        v, t = _loop(large, starts.join(large.select("g").distinct(), "g", "left_semi"), scratch, max_depth, max_nodes, carry)
        visited, truncated = visited.unionByName(v.select(visited.columns)), truncated.unionByName(t)
    return Reached(visited, truncated)


def _kernel(max_depth: int, max_nodes: int | None, carry: tuple[str, ...]):
    columns = ["g", "q", "nid", "depth", "parent", *carry, "cut"]

    def search(starts: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        if not len(starts):
            return pd.DataFrame(columns=columns)
        steps = steps.sort_values(["src", "key", "dst"], kind="stable").reset_index(drop=True)
        first: dict[int, tuple[int, int]] = {}
        src = steps["src"].to_numpy()
        edges = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
        for a, b in zip(edges, np.r_[edges[1:], len(src)]):
            first[int(src[a])] = (int(a), int(b))
        dst, seed_only = steps["dst"].tolist(), steps["seed_only"].tolist()
        rows: list[tuple] = []
        named = starts["q"].map(lambda q: tuple(q.items()) if isinstance(q, dict) else tuple(q) if hasattr(q, "asDict") else q)
        for _, own in starts.groupby(named, sort=False, dropna=False):
            q = own["q"].iloc[0]
            depth = dict.fromkeys(sorted(own["nid"].tolist()), 0)
            head = len(rows)
            rows += [(q, s, 0, None, -1) for s in depth]
            queue, reached, cut = deque(depth), 0, False
            while queue and not cut:
                a = queue.popleft()
                d = depth[a]
                if d >= max_depth:
                    break
                for i in range(*first.get(a, (0, 0))):
                    b = dst[i]
                    if b in depth or d and seed_only[i]:
                        continue
                    if max_nodes is not None and reached >= max_nodes:
                        cut = True
                        break
                    depth[b] = d + 1
                    reached += 1
                    rows.append((q, b, d + 1, a, i))
                    queue.append(b)
            if cut:
                rows[head] = (*rows[head][:4], -2)
        out = pd.DataFrame({"g": [starts["g"].iloc[0]] * len(rows), "q": [r[0] for r in rows], "nid": [r[1] for r in rows], "depth": [r[2] for r in rows]})
        out["parent"] = pd.array([r[3] for r in rows], dtype="Int64")
        at = np.array([r[4] for r in rows])
        for c in carry:
            values = steps[c].to_numpy(dtype=object)
            out[c] = pd.Series([values[i] if i >= 0 else None for i in at], dtype=object)
        out["cut"] = at == -2
        return out[columns]

    return search


def _loop(steps: DataFrame, starts: DataFrame, scratch: Scratch, max_depth: int, max_nodes: int | None, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    types = dict(steps.dtypes)
    columns = ["g", "q", "nid", "depth", "parent", "order", *carry]
    levels = [scratch.keep(starts.select("g", "q", "nid", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lpad(F.hex("nid"), 16, "0").alias("order"), *[F.lit(None).cast(types[c]).alias(c) for c in carry]))]
    cut: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        visited = _all(levels)
        ahead = levels[-1].select("g", "q", F.col("nid").alias("src"), F.col("order").alias("o"))
        near = ahead.join(steps if depth == 1 else steps.where("not seed_only"), ["g", "src"])
        fresh = near.join(visited.select("q", F.col("nid").alias("dst")), ["q", "dst"], "left_anti")
        best = fresh.groupBy("g", "q", "dst").agg(F.min_by(F.struct("o", "key", "src", *carry), F.struct("o", "key", "src")).alias("b"))
        new = scratch.keep(best.select("g", "q", F.col("dst").alias("nid"), F.lit(depth).alias("depth"), F.col("b.src").alias("parent"), F.concat("b.o", "b.key", F.lpad(F.hex("dst"), 16, "0")).alias("order"), *[F.col(f"b.{c}").alias(c) for c in carry]).select(columns))
        if new.isEmpty():
            break
        if max_nodes is not None:
            had = visited.where("depth > 0").groupBy("q").agg(F.count("*").alias("had"))
            over = scratch.keep(new.groupBy("q").agg(F.count("*").alias("n")).join(had, "q", "left").select("q", (F.lit(max_nodes) - F.coalesce("had", F.lit(0))).alias("room"), "n").where("n > room"))
            if not over.isEmpty():
                first = new.join(over, "q").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("order"))).where(F.col("r") <= max_nodes)
                levels.append(scratch.keep(first.where("r <= room").select(columns)))
                cut.append(over.select("q"))
                new = scratch.keep(new.join(over.select("q"), "q", "left_anti").select(columns))
        levels.append(new)
    truncated = _all(cut) if cut else starts.select("q").limit(0)
    return _all(levels).drop("order"), truncated


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def paths(reached: DataFrame, scratch: Scratch, columns: list[str]) -> DataFrame:
    """(q, nid, path): for each reached node the steps back to its start, nearest first; each step is a struct of nid, parent and ``columns``. Links are doubled, so the rounds are the logarithm of the depth."""
    own = scratch.keep(reached.select(*dict.fromkeys(["q", "nid", "parent", "depth", *columns])))
    state = own.where("depth > 0").select("q", "nid", F.when(F.col("depth") > 1, F.col("parent")).alias("up"), F.array(F.struct("nid", "parent", *columns)).alias("path"))
    most = own.agg(F.max("depth")).first()[0] or 0
    done = 1
    while done < most:
        state = scratch.keep(state)
        far = state.select("q", F.col("nid").alias("up"), F.col("up").alias("up2"), F.col("path").alias("rest"))
        state = state.join(far, ["q", "up"], "left").select("q", "nid", F.col("up2").alias("up"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path"))
        done *= 2
    return scratch.keep(state.select("q", "nid", "path"))


def shortest_paths(links: DataFrame, pairs: DataFrame, scratch: Scratch, max_depth: int, limit: int = KERNEL_EDGES) -> DataFrame:
    """links: g, src, dst. (q, pos, nid) of the path with fewest steps from ``a`` to ``b`` of each pair (g, q, a, b); ties by the smallest node. A pair without a path has no rows; a node's path to itself is the node."""
    pairs = scratch.keep(pairs.select("g", "q", "a", "b"))
    steps = links.select("g", "src", "dst", F.lpad(F.hex("dst"), 16, "0").alias("key")).distinct()
    found = bfs(steps, pairs.select("g", "q", F.col("a").alias("nid")), scratch, max_depth, limit=limit)
    goal = found.visited.join(pairs.select("q", F.col("b").alias("nid")), ["q", "nid"], "left_semi")
    whole = paths(found.visited, scratch, ["depth"]).join(goal.select("q", "nid"), ["q", "nid"], "left_semi")
    rows = whole.select("q", F.explode("path").alias("s")).select("q", F.col("s.depth").alias("pos"), F.col("s.nid").alias("nid"))
    first = pairs.join(goal.select("q").distinct(), "q", "left_semi").select("q", F.lit(0).alias("pos"), F.col("a").alias("nid"))
    return first.unionByName(rows)
