"""Processing only new or changed records, without skips or repeats after failures.

A run rereads its source from the oldest transaction that was still open at the
last successful run (``reread``), and removes what it has seen before by an
anti-join of (key, version) pairs against the ledger of processed pairs
(``remove_overlap``). ``Feed`` keeps that ledger for one consumer; ``pending_runs``
does the same for many recorded runs at once, each with the ledger of the run it
started from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.snapshots import key_hashes
from lodegraph.operators.tiers import Tiers


def reread(rows: DataFrame, txn: str, low: Column | int | None) -> DataFrame:
    """The rows from the oldest open transaction on; rows without a transaction always, everything where nothing has run."""
    if low is None:
        return rows
    oldest = low if isinstance(low, Column) else F.lit(low)
    return rows.where(F.col(txn).isNull() | oldest.isNull() | (F.col(txn) >= oldest))


def last_versions(rows: DataFrame, key: list[str], version: str, order: Column, carry: list[str] = []) -> DataFrame:
    """One row for each key: its version with the largest order (null is the smallest, ties go to the larger version)."""
    return rows.groupBy(*key).agg(F.max(F.struct(order.alias("o"), F.col(version).alias("v"), *carry)).alias("r")).select(*key, F.col("r.v").alias(version), *[f"r.{c}" for c in carry])


def remove_overlap(rows: DataFrame, ledger: DataFrame, key: list[str], version: str) -> DataFrame:
    """The rows whose (key, version) is not in the ledger.

    Both have one version for each key, so the anti-join goes by the key, by
    which both sides are partitioned already, and compares the versions after.
    """
    held = ledger.select(*key, F.col(version).alias("_held"), F.lit(True).alias("_known"))
    joined = rows.join(held, key, "left")
    return joined.where(F.col("_known").isNull() | ~F.col(version).eqNullSafe(F.col("_held"))).drop("_held", "_known")


def pending_runs(rows: DataFrame, runs: DataFrame, snapshot: str, key: str, version: str, order: Column) -> DataFrame:
    """(snapshot, key) of the rows that each run has to process.

    rows: snapshot, key, version and what ``order`` needs; a run delivers the
    rows of its own snapshot, as one transaction. runs: snapshot, base (the
    snapshot of the run whose state it started from, null for none), txn and
    base_txn, in which no later transaction had begun. Each run rereads what was
    written since its base, for its own snapshot, and the ledger of its base are
    the pairs of the base's snapshot. Snapshots and keys must not be null; of
    several rows for one key the one with the largest order counts, ties go to
    the larger version. A run without a base processes everything.
    """
    both = [snapshot, key]
    own = rows.join(runs.select(snapshot, F.col("txn").alias("_txn"), F.col("base_txn").alias("_low")), snapshot)
    current = last_versions(reread(own, "_txn", F.col("_low")), both, version, order)
    based = runs.where("base is not null").select(F.col("base").alias("_base"), F.col(snapshot).alias("_run"))
    processed = rows.withColumnRenamed(snapshot, "_base").join(based, "_base").withColumnRenamed("_run", snapshot)
    ledger = last_versions(processed, both, version, order)
    return remove_overlap(current, ledger, both, version).select(*both)


class Feed:
    """New or changed records since the last successful run of one consumer.

    source rows: key columns, version (any string; null is a version of its
    own), txn (bigint; rows without one are read on every run until processed).
    Of several rows for one key the last committed txn counts, ties by version.
    A run counts once ``commit`` has published its marker; one that dies before
    leaves no trace and its rows come again. Two runs cannot both commit.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], version: str, txn: str):
        self.spark, self.key, self.version, self.txn = spark, key, version, txn
        self.tiers = Tiers(spark, folder, {"ledger": ("h1 bigint, h2 bigint, _v bigint", ["h1", "h2"])})

    def _compact(self, df: DataFrame) -> DataFrame:
        return df.select("*", *key_hashes(*map(F.col, self.key)), F.xxhash64(F.coalesce(F.col(self.version).cast("string"), F.lit("\u0000null"))).alias("_v"))

    def _new(self, seen: DataFrame, columns: list[str], marker: dict) -> DataFrame:
        order = F.struct(F.col(self.txn), F.col(self.version).cast("string"))
        last = self._compact(seen).groupBy("h1", "h2").agg(F.max_by(F.struct(*columns, "_v"), order).alias("r")).select("h1", "h2", "r.*")
        return remove_overlap(last, self.tiers.read("ledger", marker), ["h1", "h2"], "_v").drop("h1", "h2", "_v")

    def _visible(self, source: DataFrame, open_txns: list[int]) -> tuple[DataFrame, DataFrame]:
        is_open = F.coalesce(F.col(self.txn).isin(open_txns), F.lit(False)) if open_txns else F.lit(False)
        return source.where(~is_open), source.where(is_open)

    def pending(self, source: DataFrame, open_txns: list[int]) -> tuple[DataFrame, dict]:
        """(rows of the whole source to process, token for ``commit``); open_txns: transactions not ended when this run starts, whose rows are not visible to it."""
        marker = self.tiers.marker()
        low = marker["extra"].get("low")
        seen, _ = self._visible(source, open_txns)
        seen = reread(seen, self.txn, low)
        top = None if open_txns else seen.agg(F.max(self.txn)).first()[0]
        new_low = min(open_txns) if open_txns else top
        return self._new(seen, source.columns, marker), {"marker": marker, "low": low if new_low is None else new_low, "seq": marker["seq"] + 1}

    def arriving(self, batch: DataFrame, open_txns: list[int]) -> tuple[DataFrame, dict]:
        """The same for a source that hands over each row once, in any order: only the ledger removes rows, and rows of open transactions are held for later batches."""
        marker = self.tiers.marker()
        held = marker["extra"].get("held")
        whole = batch.unionByName(self.spark.read.schema(batch.schema).parquet(held)) if held else batch
        seen, later = self._visible(whole, open_txns)
        return self._new(seen, batch.columns, marker), {"marker": marker, "low": marker["extra"].get("low"), "seq": marker["seq"] + 1, "later": later if open_txns else None}

    def commit(self, processed: DataFrame, token: dict) -> None:
        """Appends to the ledger and publishes the marker. A second commit of the same sequence number fails."""
        extra = {"low": token["low"]}
        if token.get("later") is not None:
            extra["held"] = f"{self.tiers.folder}/held/{token['seq']}-{processed.sparkSession.sparkContext.applicationId}"
            token["later"].write.mode("overwrite").parquet(extra["held"])
        self.tiers.commit(token["marker"], {"ledger": self._compact(processed).select("h1", "h2", "_v")}, extra)


def follow(arriving: DataFrame, feed: Feed, process: Callable[[DataFrame, int], None], checkpoint: str, open_txns: Callable[[], list[int]] = list):
    """Hands the new or changed records of each micro-batch to ``process(rows, seq)``; gives the running query.

    ``process`` must write under ``seq`` and overwrite what is there: a batch
    that failed before its commit comes again with the same number.
    """

    def batch(df: DataFrame, _: int) -> None:
        todo, token = feed.arriving(df, open_txns())
        todo = todo.persist()
        try:
            process(todo, token["seq"])
            feed.commit(todo, token)
        finally:
            todo.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
