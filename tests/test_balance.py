import random
from collections import Counter

from pyspark.sql import functions as F

from lodegraph.operators import balance


def skewed(spark, n=3000):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 5 + ["warm"] * 2 + [f"k{i}" for i in range(20)] + [None]), rnd.choice([None] + [f"m{i}" for i in range(200)]), rnd.choice([1, 2, None])) for _ in range(n)]
    return data, spark.createDataFrame(data, "to_id string, from_id string, w int").selectExpr("*", "1 as n", "'x' as task", "2 as h")


def test_per_key_against_brute_force(spark):
    data, df = skewed(spark)
    want = {k: (sum(1 for a, *_ in data if a == k), len({m for a, m, _ in data if a == k and m is not None}), float(sum(w or 0 for a, _, w in data if a == k))) for k in {a for a, *_ in data if a}}
    for tasks in (1, 5):
        got = {r["key"]: (r["n_rows"], r["n_members"], r["weight"]) for r in balance.per_key(df, "to_id", "from_id", "w", tasks).collect()}
        assert got == want


def test_one_pair_repeated(spark):
    df = spark.createDataFrame([("k", "m")] * 500 + [("j", None)], "to_id string, from_id string")
    assert sorted(tuple(r) for r in balance.per_key(df, "to_id", "from_id").collect()) == [("j", 1, 0, 0.0), ("k", 500, 1, 0.0)]


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, "m")], "to_id string, from_id string")
    assert balance.per_key(df, "to_id", "from_id").count() == 0
    assert balance.per_key(df.limit(0), "to_id", "from_id").count() == 0


def test_plan_splits_hot_keys_in_proportion():
    plan = balance.pack({0: 10, 1: 10, 2: 5}, {99: 120}, tasks=4, bins=8, target=20)
    assert len(plan.shards[99]) == 4 and set(plan.shards[99]) == {0, 1, 2, 3}
    assert len(plan.bin_task) == 8 and set(plan.bin_task) <= {0, 1, 2, 3}


def test_rows_are_spread(spark):
    _, df = skewed(spark)
    h = balance.key_hash(F.col("to_id"))
    plan = balance.make_plan(df.groupBy(h.alias("h")).agg(F.count("*").alias("load")), 4)
    sizes = Counter(r["t"] for r in df.select(balance.task_of(plan, h, F.xxhash64(F.coalesce("from_id", F.lit("")))).alias("t")).collect())
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) < 1.4 * 3000 / 4


def test_balanced_join_equals_a_plain_one(spark, rows):
    _, df = skewed(spark, 800)
    match = spark.createDataFrame([("hot", "a", 1), ("hot", "b", 2), ("k1", "c", 3), (None, "d", 4), ("none", "e", 5)], "to_id string, label string, w int")
    got = balance.balanced_join(df, match, "to_id", 5)
    want = df.join(match.withColumnRenamed("w", "match_w"), "to_id", "left")
    cols = ["to_id", "from_id", "w", "label", "match_w"]
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(map(tuple, want.select(cols).collect()))


def test_a_join_on_one_key_of_equal_rows_is_spread(spark, tmp_path):
    spark.createDataFrame([("hot", "m")] * 4000 + [(f"k{i}", "m") for i in range(4000)], "to_id string, from_id string").write.parquet(str(tmp_path / "rows"))
    match = spark.createDataFrame([("hot", 1), ("k1", 2)], "to_id string, w int")
    joined = balance.balanced_join(spark.read.parquet(str(tmp_path / "rows")), match, "to_id", 8)
    assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 8000 and len(sizes) == 8 and max(sizes) < 1.3 * 1000
    assert joined.where("w = 1").count() == 4000


def test_hot_keys(spark):
    _, df = skewed(spark)
    hot = balance.hot_keys(balance.per_key(df, "to_id", "from_id"), "n_rows", df.count(), 0.05)
    assert {r["key"] for r in hot.collect()} == {"hot", "warm"}
