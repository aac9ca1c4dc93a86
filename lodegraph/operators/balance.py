"""Per-key results where few keys hold most rows.

Loads are counted exactly with map-side combining. Light keys share hash bins,
which are packed onto tasks by load, largest first; a key above the target is
split into as many proportionate shards as its load asks for. Where members are
counted, rows of a split key are placed by a hash of their member, so distinct
counts add up over shards; in a join they take the shards in turn. The matching
side is replicated to these shards only. What reaches the
driver is bounded by the number of bins and of split keys (at most
``tasks * SHARDS_PER_TASK``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import buckets_for, coalesce_text

BINS_PER_TASK, SHARDS_PER_TASK = 8, 4


@dataclass(frozen=True)
class Plan:
    """bin_task[i]: the task of bin i. shards: key hash -> the tasks of its shards; such keys are in no bin."""

    tasks: int
    bin_task: list[int]
    shards: dict[int, list[int]]

    @property
    def bins(self) -> int:
        return len(self.bin_task)


def pack(bin_loads: dict[int, int], split: dict[int, int], tasks: int, bins: int, target: float) -> Plan:
    """Shards of the split keys, then bins, each largest first, onto the least loaded task."""
    pieces = [(load / n, ("key", k, i)) for k, load in split.items() for n in [min(tasks, max(2, -(-load // max(1, int(target)))))] for i in range(n)]
    pieces += [(load, ("bin", b, 0)) for b, load in bin_loads.items()]
    heap = [(0.0, t) for t in range(tasks)]
    bin_task, shards = [b % tasks for b in range(bins)], {}
    for load, (kind, k, _) in sorted(pieces, key=lambda p: (-p[0], p[1])):
        had, t = heapq.heappop(heap)
        heapq.heappush(heap, (had + load, t))
        if kind == "bin":
            bin_task[k] = t
        else:
            shards.setdefault(k, []).append(t)
    return Plan(tasks, bin_task, shards)


def make_plan(loads: DataFrame, tasks: int) -> Plan:
    """loads: (h, load), one row per key hash; counted once and held while the plan is made."""
    bins = tasks * BINS_PER_TASK
    loads = loads.persist()
    total = loads.agg(F.sum("load")).first()[0] or 0
    target = total / tasks / SHARDS_PER_TASK
    hot = {r["h"]: r["load"] for r in loads.where(F.col("load") > target).collect()} if total else {}
    light = loads.where(F.col("load") <= target).groupBy(F.pmod("h", F.lit(bins)).cast("int").alias("bin")).agg(F.sum("load").alias("load"))
    plan = pack({r["bin"]: r["load"] for r in light.collect()}, hot, tasks, bins, target)
    loads.unpersist()
    return plan


def task_of(plan: Plan, h: Column, spread: Column) -> Column:
    """The task of a row: its bin's, or that of its shard by ``spread``, a number."""
    tasks = F.lit(np.asarray(plan.bin_task, np.int32))
    light = F.element_at(tasks, (F.pmod(h, F.lit(plan.bins)) + 1).cast("int"))
    if not plan.shards:
        return light
    shards = F.create_map(*[x for k, ts in plan.shards.items() for x in (F.lit(k).cast("bigint"), F.array(*map(F.lit, ts)))])
    own = F.try_element_at(shards, h)
    return F.when(own.isNull(), light).otherwise(F.try_element_at(own, (F.pmod(spread, F.size(own)) + 1).cast("int")))


def tasks_of_match(plan: Plan, h: Column) -> Column:
    """The tasks that a row of the matching side is replicated to."""
    tasks = F.lit(np.asarray(plan.bin_task, np.int32))
    light = F.array(F.element_at(tasks, (F.pmod(h, F.lit(plan.bins)) + 1).cast("int")))
    if not plan.shards:
        return light
    shards = F.create_map(*[x for k, ts in plan.shards.items() for x in (F.lit(k).cast("bigint"), F.array(*map(F.lit, ts)))])
    return F.coalesce(F.array_distinct(F.try_element_at(shards, h)), light)


def key_hash(key: Column) -> Column:
    return F.xxhash64(coalesce_text(key))


#: Distinct (key, member) pairs that a task combines before it passes them on.
COMBINE_PAIRS = 200_000
_PAIRS = "key string, member string, n bigint, weight double"
_KEYS = "key string, n_rows bigint, n_members bigint, weight double"


def _merge(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["key", "member"], use_threads=False).aggregate([("n", "sum"), ("weight", "sum")])
    return t.select(["key", "member", "n_sum", "weight_sum"]).rename_columns(["key", "member", "n", "weight"])


def combine_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal (key, member) pairs of a partition, holding at most about COMBINE_PAIRS."""
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n >= COMBINE_PAIRS:
            merged = _merge(held)
            held, n = [merged], merged.num_rows
            if n >= COMBINE_PAIRS // 2:
                yield from merged.to_batches()
                held, n = [], 0
    if held:
        yield from _merge(held).to_batches()


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key of one task: rows, distinct members that are not null, weight. Every row of a pair is in the same task."""
    held: list[pa.Table] = []
    n = limit = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]).select(["key", "member", "n", "weight"]))
        n += b.num_rows
        if n > max(limit, COMBINE_PAIRS):
            held = [_merge(held)]
            n, limit = held[0].num_rows, 2 * held[0].num_rows
    if not held:
        return
    t = _merge(held).group_by("key", use_threads=False).aggregate([("n", "sum"), ("member", "count"), ("weight", "sum")])
    yield from t.select(["key", "n_sum", "member_count", "weight_sum"]).rename_columns(["key", "n_rows", "n_members", "weight"]).to_batches()


def tasks_for(rows: DataFrame, bytes_each: int = 32 << 20, least: int = 12, most: int = 1 << 16) -> int:
    return buckets_for(rows, bytes_each, least, most)


def per_key(rows: DataFrame, key: str, member: str, weight: str | None = None, tasks: int | None = None) -> DataFrame:
    """(key, n_rows, n_members, weight) for each key that is not null, in balanced work.

    n_members counts distinct members that are not null, weight adds up the
    weights that are not null (0 where there are none). Repeated rows count as
    often as they are delivered. An empty table gives no keys; columns other
    than these three are not read.
    """
    tasks = tasks or tasks_for(rows)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    flat = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.lit(1).cast("bigint").alias("n"), w.alias("weight"))
    plan = make_plan(flat.groupBy(key_hash(F.col("key")).alias("h")).agg(F.count("*").alias("load")), tasks)
    pairs = flat.mapInArrow(combine_pairs, _PAIRS)
    placed = pairs.withColumn("task", task_of(plan, key_hash(F.col("key")), F.xxhash64(coalesce_text(F.col("member")))))
    parts = placed.repartitionById(tasks, "task").mapInArrow(count_task, _KEYS)
    return parts.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_members").alias("n_members"), F.sum("weight").alias("weight"))


def balanced_join(rows: DataFrame, match: DataFrame, on: str, tasks: int | None = None) -> DataFrame:
    """Left join of rows with the rows of ``match`` for the same key, in balanced work.

    Rows of a split key take its shards in turn, so that a key of equal rows is
    spread too; they must come in an order of their own, as from files or a
    written table. Rows of ``match`` are copied to these shards only. Both sides
    go to the tasks of the plan and are joined there. Null keys match nothing
    and are spread like a key. Columns of ``match`` whose names clash get the
    prefix ``match_``.
    """
    tasks = tasks or tasks_for(rows)
    h = key_hash(F.col(on).cast("string"))
    plan = make_plan(rows.groupBy(h.alias("h")).agg(F.count("*").alias("load")), tasks)
    left = rows.withColumn("_turn", F.monotonically_increasing_id()).withColumn("_task", task_of(plan, h, F.col("_turn"))).drop("_turn").repartitionById(tasks, "_task")
    names = {c: f"match_{c}" if c in rows.columns else c for c in match.columns if c != on}
    right = match.where(F.col(on).isNotNull()).select(F.col(on).alias("_on"), *[F.col(c).alias(n) for c, n in names.items()], F.explode(tasks_of_match(plan, h)).alias("_to")).repartitionById(tasks, "_to")
    return left.join(right, (F.col("_task") == F.col("_to")) & (F.col(on) == F.col("_on")), "left").drop("_task", "_to", "_on")


def hot_keys(counted: DataFrame, measure: str, total: float, share: float) -> DataFrame:
    """Keys whose measure is at least ``share`` of ``total``."""
    return counted.where(F.col(measure) >= share * total).select("key", measure)
