"""References to records that do not exist, kept up to date as references, parents and deletions arrive.

The state is keyed by (scope, key): of a parent, the earliest sight, the latest
one and whether that one says it was deleted; of the references to it, for each
table and period, the first and the last time and what is wrong with them.
``advance`` takes the state of the keys that a batch names, and the batch: new
references probe their parent, arriving parents resolve or, with a deletion,
reopen the references that wait at their key. It works on sorted integers, one
bucket of keys at a time, and runs either against the state that ``OrphanState``
stores, or through the batches of a whole history at once (``replay``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.tiers import Tiers
from lodegraph.session import buckets_for, coalesce_text

STATES = ("missing", "late", "deleted")
_NONE, _MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of source tables behind a bucket of keys that is advanced at once.
BUCKET_BYTES = 4 << 20
#: A reference (tab and period set) or a sight of a parent (tab null), collapsed; s_ columns hold what is known of a shared parent.
_EVENT = "step int, tab string, period string, scope string, key string, first bigint, last bigint, deleted bigint, s_first bigint, s_last bigint, s_deleted bigint, s_known boolean"
_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]
_FOUND = "tab string, period string, scope string, key string, first bigint, last bigint, wrong int"
_STEPS = "step int, tab string, period string, state string, n bigint"


def month(at: Column) -> Column:
    """Months since year 0, 0 where there is no time."""
    return F.coalesce(F.year(at) * 12 + F.month(at), F.lit(0)).cast("int")


def parent_events(rows: DataFrame, scope: str | None, key: str, seen: str, deleted: str, steps: bool = False) -> DataFrame:
    """(scope, key, step, first, last, deleted): the sights of each key, by month if asked; a scope of None is found from every scope. Null keys are no parents."""
    seen_at, deleted_at = F.unix_micros(seen), F.unix_micros(deleted)
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy((coalesce_text(F.col(scope)) if scope else F.lit("*")).alias("scope"), F.col(key).alias("key"), (month(F.col(seen)) if steps else F.lit(0)).alias("step"))
        .agg(F.min(seen_at).alias("first"), F.max(F.struct(seen_at.alias("last"), deleted_at.alias("deleted"))).alias("l"))
        .select("scope", "key", "step", "first", "l.last", "l.deleted")
    )


def reference_events(rows: DataFrame, tab: str, scope: str, key: Column, at: str) -> DataFrame:
    """(tab, period, scope, key, step, first, last): the references of these rows, collapsed. Null refers to nothing."""
    when = F.unix_micros(at)
    return (
        rows.select(F.date_format(at, "yyyy-MM").alias("period"), month(F.col(at)).alias("step"), F.col(scope).alias("scope"), key.alias("key"), when.alias("t"))
        .where("key is not null")
        .groupBy(F.lit(tab).alias("tab"), "period", "scope", "key")
        .agg(F.first("step").alias("step"), F.min("t").alias("first"), F.max("t").alias("last"))
    )


class Bucket:
    """The state of some keys, in arrays: parents by number, references with the number of their parent."""

    def __init__(self, t: pa.Table):
        names = pc.binary_join_element_wise(pc.fill_null(t.column("scope"), "\u0000null"), t.column("key"), "\u0001").combine_chunks()
        codes = names.dictionary_encode()
        number = codes.indices.to_numpy(zero_copy_only=False)
        refers = pc.is_valid(t.column("tab")).to_numpy(zero_copy_only=False).astype(bool)
        step = t.column("step").to_numpy(zero_copy_only=False)
        value = {c: pc.fill_null(t.column(c), _MOST if c in ("first", "s_first") else _NONE).to_numpy(zero_copy_only=False) for c in ("first", "last", "deleted", "s_first", "s_last", "s_deleted")}
        n = len(codes.dictionary)
        self.rows = np.flatnonzero(refers)
        self.at, self.of = step[refers], number[refers]
        self.a, self.b = value["first"][refers], value["last"][refers]
        known = pc.fill_null(t.column("s_known"), False).to_numpy(zero_copy_only=False).astype(bool)[refers]
        self.shared = known, value["s_first"][refers], value["s_last"][refers], value["s_deleted"][refers]
        self.wrong = np.zeros(len(self.rows), np.int32)
        self.known, self.first = np.zeros(n, bool), np.full(n, _MOST)
        self.last, self.deleted = np.full(n, _NONE), np.full(n, _NONE)
        sights = np.flatnonzero(~refers)
        self.sights = {c: value[c][sights] for c in ("first", "last", "deleted")} | {"of": number[sights], "step": step[sights]}

    def steps(self) -> np.ndarray:
        return np.unique(np.concatenate([self.at, self.sights["step"]]))

    def advance(self, step: int) -> np.ndarray:
        """Takes in the batch of a step; gives the references it was able to alter."""
        new = self.sights["step"] == step
        of, last, deleted = self.sights["of"][new], self.sights["last"][new], self.sights["deleted"][new]
        self.known[of] = True
        np.minimum.at(self.first, of, self.sights["first"][new])
        by = np.lexsort((deleted, last, of))
        of, last, deleted = of[by], last[by], deleted[by]
        end = np.ones(len(of), bool)
        end[:-1] = of[1:] != of[:-1]
        of, last, deleted = of[end], last[end], deleted[end]
        later = (last > self.last[of]) | (last == self.last[of]) & (deleted > self.deleted[of])
        self.last[of[later]], self.deleted[of[later]] = last[later], deleted[later]
        arrived = np.zeros(len(self.known), bool)
        arrived[of] = True
        touched = np.flatnonzero((self.at == step) | (self.at < step) & arrived[self.of])
        self.wrong[touched] = self._probe(touched)
        return touched

    def _probe(self, refs: np.ndarray) -> np.ndarray:
        """Bits of STATES for references; one row may be late and deleted. Without a time of its own a reference can only be missing."""
        of, a, b = self.of[refs], self.a[refs], self.b[refs]
        s_known, s_first, s_last, s_deleted = (x[refs] for x in self.shared)
        known = self.known[of] | s_known
        seen = np.minimum(self.first[of], s_first)
        seen[seen == _MOST] = _NONE
        shared = s_known & (~self.known[of] | (s_last > self.last[of]) | (s_last == self.last[of]) & (s_deleted > self.deleted[of]))
        deleted = np.where(shared, s_deleted, self.deleted[of])
        timed = b != _NONE
        late = known & timed & (a < seen)
        gone = known & timed & (deleted != _NONE) & (b >= np.maximum(deleted, seen))
        return np.where(known, 0, 1) | np.where(late, 2, 0) | np.where(gone, 4, 0)


def advance_bucket(t: pa.Table) -> pa.Table:
    """All batches of a bucket in order; every reference as it stands after the last one."""
    b = Bucket(t)
    for step in b.steps():
        b.advance(step)
    names = ("tab", "period", "scope", "key", "first", "last")
    return t.select(names).take(pa.array(b.rows)).append_column("wrong", pa.array(b.wrong))


def bucket_history(t: pa.Table) -> pa.Table:
    """How many references of each table, period and state are pending more (or less) after each batch than before."""
    b = Bucket(t)
    groups = pc.binary_join_element_wise(t.column("tab"), pc.fill_null(t.column("period"), ""), "\u0001").take(pa.array(b.rows)).combine_chunks().dictionary_encode()
    group, out = groups.indices.to_numpy(zero_copy_only=False), []
    for step in b.steps():
        before = b.wrong.copy()
        touched = b.advance(step)
        for k, state in enumerate(STATES):
            more = (b.wrong[touched] >> k & 1) - (before[touched] >> k & 1)
            moved = more != 0
            at, sums = np.unique(group[touched][moved], return_inverse=True)
            counts = np.bincount(sums, more[moved], len(at)) if len(at) else []
            for g, n in zip(at, counts):
                tab, period = groups.dictionary[int(g)].as_py().split("\u0001")
                out.append((int(step), tab, period or None, state, int(n)))
    columns = list(zip(*out)) or [[]] * 5
    types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, ty) for c, ty in zip(columns, types)], names=["step", "tab", "period", "state", "n"])


def _tagged(references: DataFrame, parents: DataFrame, shared: DataFrame | None) -> DataFrame:
    """References with what is known of a shared parent, and sights, in one table of events."""
    none = {c: F.lit(None).cast("bigint") for c in ("s_first", "s_last", "s_deleted")} | {"s_known": F.lit(False)}
    refs = references.withColumn("deleted", F.lit(None).cast("bigint"))
    if shared is not None:
        one = shared.groupBy("key").agg(F.min("first").alias("s_first"), F.max(F.struct("last", "deleted")).alias("l")).select("key", "s_first", F.col("l.last").alias("s_last"), F.col("l.deleted").alias("s_deleted"), F.lit(True).alias("s_known"))
        refs = refs.join(one, "key", "left")
    else:
        refs = refs.withColumns(none)
    own = parents.withColumns({"tab": F.lit(None).cast("string"), "period": F.lit(None).cast("string")} | none)
    return refs.select(*_COLUMNS).unionByName(own.select(*_COLUMNS))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(coalesce_text(F.col("scope")), F.col("key")), F.lit(n)).cast("int")


def _states(found: DataFrame) -> DataFrame:
    each = F.array_compact(F.array(*[F.when(F.col("wrong").bitwiseAND(1 << k) != 0, F.lit(s)) for k, s in enumerate(STATES)]))
    return found.where("wrong <> 0").select("tab", "period", "scope", "key", F.explode(each).alias("state"))


def replay(references: list[DataFrame], parents: DataFrame, shared: DataFrame | None, sources: list[DataFrame], history: bool = False) -> DataFrame:
    """(tab, period, scope, key, state) pending after a history that arrives month by month, shared parents first.

    references and parents carry their step. ``sources`` are the tables behind
    them, by whose size the buckets are made. With ``history``, the changes
    (step, tab, period, state, n) of the counts instead.
    """
    refs = references[0]
    for r in references[1:]:
        refs = refs.unionByName(r)
    buckets = sum(buckets_for(s, BUCKET_BYTES, 1) for s in sources)
    events = _tagged(refs, parents, shared).withColumn("bucket", _bucket(buckets))
    if history:
        return events.groupBy("bucket").applyInArrow(bucket_history, _STEPS).groupBy("step", "tab", "period", "state").agg(F.sum("n").alias("n"))
    return _states(events.groupBy("bucket").applyInArrow(advance_bucket, _FOUND))


class OrphanState:
    """The stored state. ``advance`` merges a batch of collapsed references and parents, any of which may be None.

    Only keys that the batch names are read and probed, and only their rows are
    written: state tables are partitioned by buckets of keys, of which those of
    the batch are opened, and grow by tiers. Keys of shared parents are found
    from every scope, so references to them are looked up by key alone.
    """

    #: Buckets of keys that the stored tables are partitioned by.
    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        key = ["scope", "key"]
        self.spark = spark
        self.tiers = Tiers(
            spark, folder,
            {
                "references": ("tab string, period string, scope string, key string, first bigint, last bigint, wrong int, b int", ["tab", "period", *key]),
                "parents": ("scope string, key string, first bigint, last bigint, deleted bigint, b int", key),
                "shared": ("key string, first bigint, last bigint, deleted bigint, b int", ["key"]),
            },
            "b",
        )

    def _b(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int")

    def advance(self, references: DataFrame | None = None, parents: DataFrame | None = None, shared: DataFrame | None = None) -> None:
        marker, read = self.tiers.marker(), self.tiers.read
        given = [df.select("key") for df in (references, parents, shared) if df is not None]
        keys = given[0]
        for g in given[1:]:
            keys = keys.unionByName(g)
        keys = keys.distinct().withColumn("b", self._b())
        opened = sorted(r["b"] for r in keys.select("b").distinct().collect())
        keys = keys.select("key")
        only = lambda name: read(name, marker, opened).join(keys, "key", "left_semi")
        merge = lambda df, by: df.groupBy(*by).agg(F.min("first").alias("first"), F.max(F.struct("last", "deleted")).alias("l")).select(*by, "first", "l.last", "l.deleted")
        held, held_parents, held_shared = only("references"), only("parents").drop("b"), only("shared").drop("b")
        new_parents = merge(held_parents.unionByName(parents.drop("step")), ["scope", "key"]) if parents is not None else held_parents
        new_shared = merge(held_shared.unionByName(shared.select("key", "first", "last", "deleted")), ["key"]) if shared is not None else held_shared
        # a reference that meets no new parent stays as it is: only those at arriving keys, and new ones, are probed
        waiting = held.select("tab", "period", "scope", "key", "first", "last").withColumn("step", F.lit(0))
        refs = waiting if references is None else waiting.unionByName(references.select("tab", "period", "scope", "key", "first", "last").withColumn("step", F.lit(0)))
        refs = refs.groupBy("tab", "period", "scope", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("step").alias("step"))
        events = _tagged(refs, new_parents.withColumn("step", F.lit(0)), new_shared).withColumn("bucket", _bucket(len(opened) or 1))
        probed = events.groupBy("bucket").applyInArrow(advance_bucket, _FOUND).withColumn("b", self._b())
        batch = {"references": probed}
        if parents is not None:
            batch["parents"] = new_parents.withColumn("b", self._b())
        if shared is not None:
            batch["shared"] = new_shared.withColumn("b", self._b())
        self.tiers.commit(marker, batch, {})

    def pending(self) -> DataFrame:
        """(tab, period, scope, key, state) of what is not sound."""
        return _states(self.tiers.read("references", self.tiers.marker()))

    def counts(self) -> DataFrame:
        """Pending references per table, period and state: a snapshot to report."""
        return self.pending().groupBy("tab", "period", "state").agg(F.count("*").alias("orphans"))
