"""Comparing keyed snapshots: what changed between two.

Rows become compact: a 128-bit key hash, a 64-bit hash of their snapshot and a
64-bit row hash. Repeats are collapsed before the shuffle; keys are spread over
hash buckets, so one repository may hold any share of the rows. Per bucket the
keys are sorted in numpy and set differences are found with ``searchsorted`` on
codes of (key, snapshot). Full values are fetched only for keys that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import buckets_for, coalesce_text

_DIFF = "h1 bigint, h2 bigint, source bigint, later bigint, change tinyint"
ADDED, REMOVED, CHANGED = 0, 1, 2
CHANGE_NAMES = ("added", "removed", "changed")


@dataclass(frozen=True)
class Keyed:
    """A table of snapshot rows.

    snapshot: columns that name the snapshot. key: columns that identify a row
    in it. row_hash: (kind, number) of what counts as its value; kind 0 is null.
    order: of several rows for one key of one snapshot the largest counts; null
    is the smallest, and ties go to the larger (kind, number).
    """

    rows: DataFrame
    snapshot: list[Column]
    key: list[Column]
    row_hash: tuple[Column, Column]
    order: Column


def snapshot_id(*columns: Column) -> Column:
    return F.xxhash64(*map(coalesce_text, columns))


def key_hashes(*columns: Column) -> list[Column]:
    texts = [coalesce_text(c.cast("string")) for c in columns]
    return [F.xxhash64(*texts).alias("h1"), F.xxhash64(F.lit("lode"), *reversed(texts)).alias("h2")]


def _compact(t: Keyed) -> DataFrame:
    kind, number = t.row_hash
    return (
        t.rows.select(snapshot_id(*t.snapshot).alias("snap"), *key_hashes(*t.key), kind.alias("kind"), number.alias("number"), F.coalesce(t.order.cast("bigint"), F.lit(-(1 << 63))).alias("ord"))
        .groupBy("snap", "h1", "h2", "kind", "number")
        .agg(F.max("ord").alias("ord"))
    )


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False)


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there, where) of each wanted code in sorted codes."""
    at = np.searchsorted(codes, wanted)
    at[at == len(codes)] = 0
    return (codes[at] == wanted) if len(codes) else np.zeros(len(wanted), bool), at


def compare_bucket(t: pa.Table) -> pa.Table:
    """Differences within one bucket. before/after name the snapshots that a row's own one is held against, null for none."""
    snap, h1, h2, kind, number, order = (_column(t, x) for x in ("snap", "h1", "h2", "kind", "number", "ord"))
    has_before, has_after = (_column(t, x).astype(bool) for x in ("has_before", "has_after"))
    before, after = _column(t, "before"), _column(t, "after")
    ids = np.unique(np.concatenate([snap, before, after]))
    s = np.searchsorted(ids, snap)
    by = np.lexsort((number, kind, order, s, h2, h1))
    first = np.ones(len(by), bool)
    first[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    key = np.cumsum(first) - 1
    codes = key.astype(np.int64) * len(ids) + s[by]
    last = np.ones(len(by), bool)
    last[:-1] = codes[1:] != codes[:-1]
    keep, codes, key = by[last], codes[last], key[last]
    kind, number = kind[keep], number[keep]
    own = codes - key.astype(np.int64) * len(ids)

    out = []

    def emit(mask: np.ndarray, change: int, later: np.ndarray) -> None:
        rows = keep[mask]
        out.append((h1[rows], h2[rows], snap[rows], later[mask], np.full(len(rows), change, np.int8)))

    base = np.searchsorted(ids, before[keep])
    there, at = _find(codes, codes - own + base)
    there &= has_before[keep]
    same = (kind[at] == kind) & (number[at] == number)
    emit(has_before[keep] & ~there, ADDED, snap[keep])
    emit(there & ~same, CHANGED, snap[keep])
    following = np.searchsorted(ids, after[keep])
    there, _ = _find(codes, codes - own + following)
    emit(has_after[keep] & ~there, REMOVED, after[keep])
    names = ("h1", "h2", "source", "later", "change")
    return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(names)})


def differences(t: Keyed, plan: DataFrame) -> DataFrame:
    """Rows (h1, h2, source, later, change) that differ along a plan of comparisons.

    plan: one row for each snapshot that takes part: snap; before, the snapshot
    it is held against for added and changed rows, or null; after, the one in
    which its rows may have been removed, or null. source is the snapshot that
    holds the row.
    """
    compact = _compact(t)
    buckets = buckets_for(t.rows)
    zero = F.lit(0).cast("bigint")
    placed = compact.join(plan, "snap").select(
        "snap", "h1", "h2", "kind", "number", "ord", F.coalesce("before", zero).alias("before"), F.col("before").isNotNull().alias("has_before"),
        F.coalesce("after", zero).alias("after"), F.col("after").isNotNull().alias("has_after"), F.pmod("h1", F.lit(buckets)).cast("int").alias("bucket"),
    )
    return placed.groupBy("bucket").applyInArrow(compare_bucket, _DIFF)


def snapshot_changes(t: Keyed, plan: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The differing rows with ``fields`` of the source row, ``later`` and ``change``; each once.

    Null keys are values like others; a key that occurs in no snapshot of the
    plan yields nothing, an empty table an empty result.
    """
    found = differences(t, plan)
    wanted = t.rows.select(*key_hashes(*t.key), snapshot_id(*t.snapshot).alias("source"), *[c.alias(n) for n, c in fields.items()])
    return wanted.join(found, ["h1", "h2", "source"]).select(*fields, "later", "change").distinct()


def consecutive(runs: DataFrame, group: str, order: list[str], snap: Column) -> DataFrame:
    """A plan that holds each snapshot of a group against the one before it.

    The window needs one row of look-back and one of look-ahead only, so a
    group is streamed and never held.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    chained = runs.withColumn("snap", snap)
    return chained.select("snap", F.lag("snap").over(w).alias("before"), F.lead("snap").over(w).alias("after"))
