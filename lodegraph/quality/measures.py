"""Set comparison with precision and recall, averages over probes, nearest-rank quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.schemas import rounded


def ratio(a: Column, b: Column) -> Column:
    """a / b to three places, null where b is 0."""
    return rounded(F.try_divide(a, b), 3)


def compare_sets(expected: DataFrame, actual: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, expected, actual, true_positives, missing, unexpected, precision, recall); a side without rows gives null ratios."""
    columns = [*by, *key]
    a = expected.select(columns).distinct().withColumn("e", F.lit(1))
    b = actual.select(columns).distinct().withColumn("a", F.lit(1))
    joined = a.join(b, columns, "full")
    has_e, has_a = F.col("e").isNotNull(), F.col("a").isNotNull()
    sums = joined.groupBy(by).agg(F.count_if(has_e).alias("expected"), F.count_if(has_a).alias("actual"), F.count_if(has_e & has_a).alias("true_positives"), F.count_if(has_e & ~has_a).alias("missing"), F.count_if(has_a & ~has_e).alias("unexpected"))
    return sums.withColumn("precision", ratio(F.col("true_positives"), F.col("actual"))).withColumn("recall", ratio(F.col("true_positives"), F.col("expected")))


def test_selection(probes: DataFrame, predicted: DataFrame) -> DataFrame:
    """probes: symbol, failing (array of test ids). predicted: symbol, test. One row of micro averages; probes without a prediction count as empty ones."""
    want = probes.select("symbol", F.explode("failing").alias("test"))
    per = compare_sets(want, predicted.join(probes.select("symbol"), "symbol", "left_semi"), ["symbol"], ["test"])
    whole = probes.select("symbol").join(per, "symbol", "left").na.fill(0)
    exact = F.count_if((F.col("missing") == 0) & (F.col("unexpected") == 0))
    sums = whole.agg(F.count("*").alias("probes"), F.sum("expected").alias("actual"), F.sum("actual").alias("predicted"), F.sum("true_positives").alias("true_positives"), exact.alias("exact"))
    return sums.withColumn("precision", ratio(F.col("true_positives"), F.col("predicted"))).withColumn("recall", ratio(F.col("true_positives"), F.col("actual")))


def order_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, min, median, p95, max, mean) at the nearest rank round((n - 1) q) of the sorted values; null values are left out.

    Values are counted first, so that what is ordered per group is its distinct
    values and not its rows.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy("v")
    placed = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))

    def at(q: float) -> Column:
        index = F.floor((F.col("n") - 1) * q + 0.5)
        return F.min(F.when(F.col("upto") > index, F.col("v")))

    return placed.groupBy(by).agg(F.max("n").alias("n"), F.min("v").alias("min"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"))
