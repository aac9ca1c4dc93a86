"""Mixing sources to target shares of tokens.

The total is the largest one that no source has to exceed its cap for. A
low-discrepancy schedule (the golden-ratio sequence through the cumulated
shares) says which source each slot takes a block from, so that every prefix of
the mix holds the shares. Per source, documents in hashed order are cut into
blocks of equal token counts; the r-th slot of a source takes its block r,
starting over until the cap. Ranks and running sums are two-level, so no source
is ever ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import Scratch

GOLDEN = 0.6180339887498949
MOST_SLOTS, LEAST_BLOCK, SLOT_RANGE = 10_000_000, 512, 1 << 16


@dataclass(frozen=True)
class Quota:
    source: str
    weight: float
    max_repeats: int
    tokens: int
    share: float


def quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int]) -> list[Quota]:
    """Shares over the sources that hold tokens and may be used; the others get 0. Null or negative weights and caps count as 0."""
    rows = [(s, max(0.0, w or 0.0), max(0, r or 0), tokens.get(s) or 0) for s, w, r in targets]
    total = sum(w for _, w, r, t in rows if r and t)
    return [Quota(s, w, r, t, w / total if total and r and t else 0.0) for s, w, r, t in rows]


def largest_total(q: list[Quota]) -> int:
    """Tokens of the largest mix in which every source holds its share within its cap."""
    return int(min((x.tokens * x.max_repeats / x.share for x in q if x.share), default=0))


def golden(i: Column) -> Column:
    """frac(i * golden ratio), exact enough for 2**50 slots: the high and the low part of i are folded apart."""
    high, low = F.floor(i / (1 << 20)), i % (1 << 20)
    step = ((1 << 20) * GOLDEN) % 1.0
    x = high * F.lit(step) + low * F.lit(GOLDEN)
    return x - F.floor(x)


def schedule(spark, q: list[Quota], slots: int) -> DataFrame:
    """(slot, source, rank): the source of each slot and how many slots before it took from the same source."""
    used = [x for x in q if x.share]
    edge, pick = 0.0, None
    for x in used[:-1]:
        edge += x.share
        hit = F.col("u") < edge
        pick = F.when(hit, F.lit(x.source)) if pick is None else pick.when(hit, F.lit(x.source))
    last = F.lit(used[-1].source) if used else F.lit(None).cast("string")
    taken = spark.range(slots if used else 0).withColumnRenamed("id", "slot").withColumn("u", golden(F.col("slot"))).select("slot", (pick.otherwise(last) if pick is not None else last).alias("source"), F.floor(F.col("slot") / SLOT_RANGE).alias("part"))
    before = taken.groupBy("source", "part").agg(F.count("*").alias("n")).select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    return taken.withColumn("r", inner).join(before, ["source", "part"]).select("slot", "source", (F.col("before") + F.col("r")).alias("rank"))


def blocks(counted: DataFrame, block_tokens: int, parts: int) -> DataFrame:
    """counted with the block in which each document starts; documents are in hashed order within their source."""
    order = F.xxhash64("doc_id")
    placed = counted.withColumn("o", order).withColumn("part", F.floor((F.col("o") / F.lit(2.0**63) + 1) / 2 * parts))
    sums = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(F.col("inner"), F.lit(0).cast("bigint"))
    return placed.withColumn("inner", inner).join(before, ["source", "part"]).select("doc_id", "source", "n_tokens", F.floor(start / block_tokens).alias("block"))


class Mix:
    """The mix of ``counted`` (doc_id, source, n_tokens) to ``targets`` (source, target_weight, max_repeats).

    Sources without a target, and documents without tokens or source, are not
    used. A source without tokens holds nothing: its weight is shared out among
    the others. Several rows for one source: the largest weight counts. An empty
    table on either side gives an empty mix.
    """

    def __init__(self, counted: DataFrame, targets: DataFrame, docs_per_part: int = 50_000):
        spark = counted.sparkSession
        self.scratch = Scratch(spark, "mix")
        self.counted = self.scratch.keep(counted.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens"))
        per = {r["source"]: r for r in self.counted.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
        wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("r")).select("source", "r.*")
        self.quotas = sorted(quotas([(r["source"], r["target_weight"], r["max_repeats"]) for r in wanted.collect()], {s: r["t"] for s, r in per.items()}), key=lambda x: x.source)
        self.total = largest_total(self.quotas)
        self.block = max(LEAST_BLOCK, -(-self.total // MOST_SLOTS))
        self.parts = max(1, max((r["n"] for r in per.values()), default=0) // docs_per_part + 1)

    def rows(self) -> DataFrame:
        """(position, doc_id, source, copy, n_tokens): a row for each use of a document; copy counts from 0, position is the slot."""
        spark = self.counted.sparkSession
        slots = schedule(spark, self.quotas, self.total // self.block)
        used = [x for x in self.quotas if x.share]
        n_blocks, cap = F.lit(None).cast("bigint"), F.lit(0)
        for x in used:
            own = F.col("source") == x.source
            n_blocks = F.when(own, F.lit(-(-x.tokens // self.block)).cast("bigint")).otherwise(n_blocks)
            cap = F.when(own, F.lit(x.max_repeats)).otherwise(cap)
        placed = slots.withColumn("n", n_blocks).withColumn("copy", F.floor(F.col("rank") / F.col("n"))).where(F.col("copy") < cap).select(F.col("slot").alias("position"), "source", "copy", (F.col("rank") % F.col("n")).alias("block"))
        return placed.join(blocks(self.counted, self.block, self.parts), ["source", "block"]).select("position", "doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens")

    def shares(self) -> DataFrame:
        """A row for each target: what it should hold and what it holds."""
        spark = self.counted.sparkSession
        wanted = spark.createDataFrame([(x.source, x.weight, x.max_repeats, x.tokens, x.share) for x in self.quotas], "source string, target_weight double, max_repeats int, available_tokens bigint, target_share double")
        got = self.rows().groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens"), (F.max("copy") + 1).alias("repeats"))
        zero = F.lit(0).cast("bigint")
        whole = got.agg(F.sum("tokens").alias("whole"))
        return wanted.join(got, "source", "left").join(whole, F.lit(True), "left").select(
            "source", "target_weight", "max_repeats", "available_tokens", F.round("target_share", 6).alias("target_share"), F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("tokens", zero).alias("tokens"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"),
        )
