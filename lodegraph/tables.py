"""Reading the project's tables, and the spellings in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_path(path: Column) -> Column:
    """A path as the project spells it: relative, ``/`` between segments, no ``.`` or empty segments."""
    slashed = F.translate(path, "\\", "/")
    segments = F.filter(F.split(slashed, "/", -1), lambda s: (s != "") & (s != "."))
    odd = slashed.rlike(r"(^|/)\.?(/|$)")
    return F.when(odd, F.array_join(segments, "/")).otherwise(slashed)


def hash_number(text: Column) -> tuple[Column, Column]:
    """(kind, number) of a 64-bit number in hexadecimal.

    kind 0: null, 1: a number, 2: not hexadecimal, where the number is a hash of
    the trimmed text. Two hashes are equal where both parts are.
    """
    digits = F.regexp_extract(F.lower(text), r"^\s*(?:0x)?0*([0-9a-f]{0,16})\s*$", 1)
    good = F.lower(text).rlike(r"^\s*(?:0x[0-9a-f]|[0-9a-f])[0-9a-f]*\s*$") & ~F.lower(text).rlike(r"[1-9a-f][0-9a-f]{16}")
    number = F.coalesce(F.conv(digits, 16, -10).cast("bigint"), F.lit(0).cast("bigint"))
    kind = F.when(text.isNull(), F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(2))
    value = F.when(text.isNull(), F.lit(0).cast("bigint")).when(good, number).otherwise(F.xxhash64(F.trim(text)))
    return kind.cast("tinyint"), value
