"""Joins that are not on equality alone: as of, innermost interval, longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, take: list[str]) -> DataFrame:
    """Adds ``take`` of the latest right row of the same key with since <= at; null where there is none, ties go to the larger ``take``.

    Both sides go through one window per key, so nothing is multiplied. ``take``
    must not name left columns.
    """
    cols = left.columns
    none = F.lit(None)
    a = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), none.cast(right.select(F.struct(*take)).schema[0].dataType).alias("_take"))
    b = right.where(F.col(since).isNotNull()).select(*by, F.col(since).alias("_t"), F.lit(0).alias("_side"), none.cast(a.schema["_row"].dataType).alias("_row"), F.struct(*take).alias("_take"))
    w = Window.partitionBy(by).orderBy(F.asc_nulls_first("_t"), "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_take", True).over(w)).where("_side = 1").select("_row.*", *[F.col("_last")[c].alias(c) for c in take])


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, first: str, last: str, name: str) -> DataFrame:
    """points with the name of the smallest span of the same key that holds ``at``: the one that starts last, then ends first, then the larger name."""
    cols = points.columns
    keyed = points.withColumn("_id", F.monotonically_increasing_id())
    s = spans.select(*by, F.col(first).alias("_a"), F.col(last).alias("_b"), F.col(name).alias("_n"))
    met = keyed.join(s, by).where((F.col("_a") <= F.col(at)) & (F.col(at) <= F.col("_b")))
    best = met.groupBy(*cols, "_id").agg(F.max_by("_n", F.struct("_a", -F.col("_b"), "_n")).alias("owner"))
    return best.select(*cols, "owner")


def longest_prefix(paths: DataFrame, folders: DataFrame, by: list[str], path: str, folder: str) -> DataFrame:
    """paths with the deepest folder of the same key that holds them; the empty folder holds all. Each path is expanded to its own ancestors, so the join is an equality."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    cols = paths.columns
    flat = paths.withColumn("_f", F.explode(ancestors)).join(folders.select(*by, F.col(folder).alias("_f")).distinct(), [*by, "_f"])
    return flat.groupBy(*cols).agg(F.max_by("_f", F.length("_f")).alias("owner"))


def numbered_duplicates(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with n: 1 for the first of equal keys, 2 for the second and so on."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
