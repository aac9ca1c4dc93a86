"""Parent links to hierarchies: paths, depths, roots, descendants, cycles.

1. Leaves are peeled until only cycles are left. Rounds are squared: the nodes
   that parent**(2**k) still reaches are those that 2**k rounds of peeling
   leave, so a height h takes log2(h) rounds on shrinking tables.
2. One link of each cycle is cut (at its smallest node), which leaves a forest.
3. Each tree's Euler tour is ranked as a linked list: runs inside a bucket of
   bounded size are contracted in numpy, the remaining cross-bucket links are
   ranked by pointer jumping. Entry and exit positions give depth, root and the
   descendants of any node as an interval.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import Scratch, coalesce_text

#: Nodes of one hash bucket, and children of one parent that one task orders.
BUCKET_NODES = 500_000
_PART = "v bigint, d_in bigint, w_in bigint, out_in bigint, d_ex bigint, w_ex bigint, out_ex bigint, end_in bigint, end_ex bigint"


def latest(rows: DataFrame, group: str, key: str, parent, order: str, carry: list[str]) -> DataFrame:
    """One row for each (group, key): the one with the largest order; ties go to the largest parent. Rows without a key name no node and are left out."""
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(group).alias("grp"), F.col(key).alias("id"))
        .agg(F.max(F.struct(F.col(order).alias("o"), parent.alias("parent"), *[F.col(c) for c in carry])).alias("r"))
        .select("grp", "id", "r.parent", *[f"r.{c}" for c in carry])
    )


def number(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes with an exact integer v, links (v, p, grp)); p is null for a root or where the parent is unknown."""
    numbered = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("v"), "*"))
    key = coalesce_text(F.col("grp")).alias("g")
    of = numbered.select(key, F.col("id").alias("parent"), F.col("v").alias("p"))
    links = numbered.select("v", "grp", key, "parent").join(of, ["g", "parent"], "left").select("v", "p", "grp")
    return numbered, scratch.keep(links)


def expose_cycles(links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The nodes on cycles, with p; None where there are none."""
    jump, left, own = links.where("p is not null").select("v", "p"), -1, False
    while True:
        reached = jump.select(F.col("p").alias("v")).distinct()
        onward = jump.select(F.col("v").alias("p"), F.col("p").alias("q"))
        following = scratch.keep(jump.join(reached, "v", "left_semi").join(onward, "p").select("v", F.col("q").alias("p")))
        if own:
            scratch.drop(jump)
        jump, own = following, True
        n = jump.count()
        if n == 0:
            scratch.drop(jump)
            return None
        if n == left:
            break
        left = n
    return scratch.keep(links.join(jump.select("v"), "v", "left_semi").select("v", "p"))


def cuts(cycles: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest node of each cycle, by doubling the stretch that each node has looked at until no minimum changes."""
    state = cycles.select("v", F.col("p").alias("jump"), F.col("v").alias("low"))
    own = False
    while True:
        far = state.select(F.col("v").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        both = state.join(far, "jump").select("v", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        following = scratch.keep(both)
        if own:
            scratch.drop(state)
        state, own = following, True
        if state.where("moved").isEmpty():
            return state.where("v = low").select("v")


def siblings(forest: DataFrame, scratch: Scratch, limit: int) -> tuple[DataFrame, DataFrame]:
    """(v, follows): the next child of the same parent, and (v, first): the first child. Parents with more children than limit are ordered in shards, which are then chained."""
    children = forest.where("p is not null").select("v", "p")
    counted = children.groupBy("p").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    hot = scratch.keep(counted.where(F.col("n") > limit).select("p", F.ceil(F.col("n") / limit).cast("int").alias("shards")))
    lead = F.lead("v").over(Window.partitionBy("p", "shard").orderBy("v"))
    firsts = counted.select(F.col("p").alias("v"), "first")
    if hot.isEmpty():
        return children.withColumn("shard", F.lit(0)).select("v", lead.alias("follows")), firsts
    placed = children.join(hot, "p", "left").withColumn("shard", F.pmod(F.xxhash64("v"), F.coalesce("shards", F.lit(1))))
    ends = scratch.keep(placed.join(hot.select("p"), "p", "left_semi").groupBy("p", "shard").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    chain = ends.select(F.col("hi").alias("v"), F.lead("lo").over(Window.partitionBy("p").orderBy("shard")).alias("across")).where("across is not null")
    heads = ends.groupBy(F.col("p").alias("v")).agg(F.min_by("lo", "shard").alias("head"))
    firsts = firsts.join(heads, "v", "left").select("v", F.coalesce("head", "first").alias("first"))
    return placed.select("v", lead.alias("follows")).join(chain, "v", "left").select("v", F.coalesce("follows", "across").alias("follows")), firsts


def contract_bucket(t: pa.Table) -> pa.Table:
    """Both tour elements of each node of a bucket: steps to where its run leaves the bucket, exits less entries passed, and the element there (null at the tour's end)."""
    def column(name: str) -> np.ndarray:
        return t.column(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    v, p, first, follows = (column(x) for x in ("v", "p", "first", "follows"))
    by = np.argsort(v)
    v, p, first, follows = v[by], p[by], first[by], follows[by]
    m = len(v)
    enter = np.where(first >= 0, 2 * first, 2 * v + 1)
    leave = np.where(follows >= 0, 2 * follows, np.where(p >= 0, 2 * p + 1, -1))
    target = np.concatenate([enter, leave])
    at = np.searchsorted(v, target >> 1)
    at[at >= m] = 0
    local = (target >= 0) & (v[at] == target >> 1)
    here = np.arange(2 * m)
    jump = np.where(local, at + (target & 1) * m, here)
    weight = np.concatenate([np.full(m, -1, np.int64), np.ones(m, np.int64)])
    steps, passed = local.astype(np.int64), np.where(local, weight[jump], 0)
    while True:
        following = jump[jump]
        if np.array_equal(following, jump):
            break
        steps, passed, jump = steps + steps[jump], passed + passed[jump], following
    out = target[jump]
    end = np.where(out < 0, np.concatenate([2 * v, 2 * v + 1])[jump], -1)
    def nullable(x: np.ndarray) -> pa.Array:
        return pa.array(x, mask=x < 0)

    return pa.table({"v": v, "d_in": steps[:m], "w_in": passed[:m], "out_in": nullable(out[:m]), "d_ex": steps[m:], "w_ex": passed[m:], "out_ex": nullable(out[m:]), "end_in": nullable(end[:m]), "end_ex": nullable(end[m:])})


def rank_tours(forest: DataFrame, scratch: Scratch, n: int, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """forest: (v, p, grp). Gives (v, entry, exit, depth, root); entry and exit count from the end of the tree's tour, so that u is below v where exit(v) < exit(u) and entry(u) < entry(v) and their roots are equal."""
    buckets = max(8, 2 * n // bucket_nodes + 1)
    sizes = forest.groupBy("grp").agg(F.count("*").alias("size"))
    large = scratch.keep(sizes.where(F.col("size") > bucket_nodes).select(coalesce_text(F.col("grp")).alias("g")))
    own = F.pmod(F.xxhash64("g"), F.lit(buckets))
    placed = forest.withColumn("g", coalesce_text(F.col("grp")))
    if large.isEmpty():
        placed = placed.withColumn("bucket", own)
    else:
        placed = placed.join(large.withColumn("split", F.lit(True)), "g", "left").withColumn("bucket", F.when(F.col("split"), F.pmod(F.xxhash64("v"), F.lit(buckets))).otherwise(own))
    follows, firsts = siblings(forest, scratch, bucket_nodes)
    linked = placed.select("v", "p", "bucket").join(follows, "v", "left").join(firsts, "v", "left")
    parts = scratch.keep(linked.select("v", "p", "first", "follows", F.col("bucket").cast("int").alias("bucket")).groupBy("bucket").applyInArrow(contract_bucket, _PART))

    done = parts.select("v", F.col("d_in").alias("entry"), F.col("d_ex").alias("exit"), F.col("w_in").alias("w"), F.col("end_in").alias("end"), "out_in", "out_ex")
    if not parts.where("out_in is not null or out_ex is not null").isEmpty():
        ranks = _rank_crossings(parts, scratch)
        a = ranks.select(F.col("x").alias("out_in"), F.col("d").alias("da"), F.col("w").alias("wa"), F.col("end").alias("ea"))
        b = ranks.select(F.col("x").alias("out_ex"), F.col("d").alias("db"))
        zero = F.lit(0).cast("bigint")
        done = done.join(a, "out_in", "left").join(b, "out_ex", "left").select(
            "v", (F.col("entry") + F.coalesce(F.col("da") + 1, zero)).alias("entry"), (F.col("exit") + F.coalesce(F.col("db") + 1, zero)).alias("exit"),
            (F.col("w") + F.coalesce("wa", zero)).alias("w"), F.coalesce("end", "ea").alias("end"),
        )
    return done.select("v", "entry", "exit", (F.col("w") - 1).cast("int").alias("depth"), F.shiftright("end", 1).alias("root"))


def _rank_crossings(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, d, w, end) of each element that a link from another bucket enters: steps to the tour's end, weight passed with its own, and the end's element."""
    elements = parts.select(F.explode(F.array(
        F.struct((F.col("v") * 2).alias("x"), F.col("d_in").alias("d"), (F.col("w_in") - 1).alias("w"), F.col("out_in").alias("out"), F.col("end_in").alias("end")),
        F.struct((F.col("v") * 2 + 1).alias("x"), F.col("d_ex").alias("d"), (F.col("w_ex") + 1).alias("w"), F.col("out_ex").alias("out"), F.col("end_ex").alias("end")),
    )).alias("e")).select("e.*")
    entered = parts.select(F.explode(F.array("out_in", "out_ex")).alias("x")).where("x is not null").distinct()
    state = scratch.keep(elements.join(entered, "x", "left_semi"))
    zero = F.lit(0).cast("bigint")
    while not state.where("out is not null").isEmpty():
        far = state.select(F.col("x").alias("out"), F.col("d").alias("d2"), F.col("w").alias("w2"), F.col("out").alias("out2"), F.col("end").alias("end2"))
        jumped = state.join(far, "out", "left").select(
            "x", (F.col("d") + F.coalesce(F.col("d2") + 1, zero)).alias("d"), (F.col("w") + F.coalesce("w2", zero)).alias("w"), F.col("out2").alias("out"), F.coalesce("end", "end2").alias("end")
        )
        following = scratch.keep(jumped)
        scratch.drop(state)
        state = following
    return state.select("x", "d", "w", "end")


class Hierarchy:
    """The forest of ``rows``: of several rows for one (group, key) the latest counts, a parent is looked up in the same group.

    A parent that is null or unknown makes a root. A node on or below a cycle
    is endless: it has no root, depth or path. Null keys name no node; a null
    group is a group of its own; ties on ``order`` go to the largest parent; an
    empty table gives an empty forest. Other columns are not read.
    """

    def __init__(self, rows: DataFrame, group: str, key: str, parent, order: str, name: str | None = None, bucket_nodes: int = BUCKET_NODES):
        spark = rows.sparkSession
        self.scratch = Scratch(spark, "hierarchy")
        self.nodes, self.links = number(latest(rows, group, key, parent, order, [name] if name else []), self.scratch)
        self.name, self.bucket_nodes = name, bucket_nodes
        cycles = expose_cycles(self.links, self.scratch)
        self.cut = cuts(cycles, self.scratch) if cycles is not None else None
        forest = self.links
        if self.cut is not None:
            mark = self.cut.withColumn("cut", F.lit(True))
            forest = self.scratch.keep(forest.join(mark, "v", "left").select("v", F.when(F.col("cut").isNull(), F.col("p")).alias("p"), "grp"))
        self.forest = forest
        self._tours: DataFrame | None = None

    @property
    def tours(self) -> DataFrame:
        """(v, entry, exit, depth, root, endless); endless trees hang from a cut cycle."""
        if self._tours is None:
            t = rank_tours(self.forest, self.scratch, self.nodes.count(), self.bucket_nodes)
            if self.cut is None:
                t = t.withColumn("endless", F.lit(False))
            else:
                t = t.join(self.cut.select(F.col("v").alias("root"), F.lit(True).alias("cut")), "root", "left").withColumn("endless", F.col("cut").isNotNull()).drop("cut")
            self._tours = self.scratch.keep(t.select("v", "entry", "exit", "depth", "root", "endless"))
        return self._tours

    def endless(self) -> DataFrame:
        """(grp, id) of the nodes whose chain of parents never ends."""
        return self.tours.where("endless").select("v").join(self.nodes.select("v", "grp", "id"), "v").select("grp", "id")

    def paths(self, separator: str = "::") -> DataFrame:
        """(v, path): the names from the root down, doubled link by link."""
        label = F.coalesce(F.col(self.name), F.col("id")) if self.name else F.col("id")
        ended = self.tours.where("not endless").select("v")
        state = self.scratch.keep(self.forest.join(ended, "v", "left_semi").join(self.nodes.select("v", label.alias("path")), "v").select("v", F.col("p").alias("up"), "path"))
        while not state.where("up is not null").isEmpty():
            far = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
            longer = state.join(far, "up", "left").select("v", F.col("up2").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat_ws(separator, "head", "path")).alias("path"))
            following = self.scratch.keep(longer)
            self.scratch.drop(state)
            state = following
        return state.select("v", "path")

    def tree(self) -> DataFrame:
        """One row per node: grp, id, path, depth, root_id, entry, exit, n_descendants; all but grp and id are null where the chain never ends."""
        t = self.tours.where("not endless")
        root = self.nodes.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
        known = t.join(self.paths(), "v").join(root, "root").select("v", "path", "depth", "root_id", "entry", "exit", ((F.col("entry") - F.col("exit") - 1) / 2).cast("bigint").alias("n_descendants"))
        return self.nodes.select("v", "grp", "id").join(known, "v", "left").drop("v")

    def descendants(self, of: DataFrame) -> DataFrame:
        """(grp, id, descendant) for the nodes (grp, id) of a query set: the nodes of the same tree whose interval lies inside."""
        ids = self.nodes.select("v", "grp", "id")
        asked = of.select("grp", "id").distinct().join(ids, ["grp", "id"]).join(self.tours.where("not endless"), "v").select("grp", "id", "root", F.col("entry").alias("hi"), F.col("exit").alias("lo"))
        below = self.tours.where("not endless").select("v", "root", "entry")
        inside = asked.join(below, "root").where("entry < hi and entry > lo").select("grp", "id", "v")
        return inside.join(ids.select("v", F.col("id").alias("descendant")), "v").select("grp", "id", "descendant")

    def all_descendants(self) -> DataFrame:
        """(grp, id, descendant) for every node that is not endless. Each node's chain of ancestors is doubled link by link, so work grows with the rows given and not with a tree's size squared."""
        ended = self.tours.where("not endless").select("v")
        above = F.when(F.col("p").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("p"))
        state = self.scratch.keep(self.forest.join(ended, "v", "left_semi").select("v", F.col("p").alias("up"), above.alias("above")))
        while not state.where("up is not null").isEmpty():
            far = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("above").alias("more"))
            longer = state.join(far, "up", "left").select("v", F.col("up2").alias("up"), F.when(F.col("more").isNull(), F.col("above")).otherwise(F.concat("above", "more")).alias("above"))
            following = self.scratch.keep(longer)
            self.scratch.drop(state)
            state = following
        below = state.join(self.nodes.select("v", F.col("id").alias("descendant")), "v").select(F.explode("above").alias("v"), "descendant")
        return below.join(self.nodes.select("v", "grp", "id"), "v").select("grp", "id", "descendant")
