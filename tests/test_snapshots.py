import random

from pyspark.sql import functions as F

from lodegraph.operators import snapshots
from lodegraph.operators.snapshots import Keyed, snapshot_id
from lodegraph.tables import hash_number, plain_path

SNAP = lambda: snapshot_id(F.col("g"), F.col("rev"))


def keyed(spark, data, extra=""):
    df = spark.createDataFrame(data, "g string, rev string, k string, v string, t bigint")
    if extra:
        df = df.selectExpr("*", "'x' as h1", "'y' as change", "1 as snap")
    kind = F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("tinyint")
    return Keyed(df, [F.col("g"), F.col("rev")], [F.col("g"), F.col("k")], (kind, F.coalesce(F.xxhash64("v"), F.lit(0).cast("bigint"))), F.col("t"))


def runs(spark, data):
    return spark.createDataFrame(data, "g string, rev string, seq int")


def brute(data, order):
    held = {}
    for g, rev, k, v, t in data:
        old = held.setdefault((g, rev), {}).get(k)
        if old is None or (t if t is not None else -1) >= (old[0] if old[0] is not None else -1):
            held[(g, rev)][k] = (t, v)
    out = set()
    for g, revs in order.items():
        for a, b in zip(revs, revs[1:]):
            old, new = held.get((g, a), {}), held.get((g, b), {})
            out |= {(g, k, b, "added") for k in new if k not in old} | {(g, k, b, "removed") for k in old if k not in new} | {(g, k, b, "changed") for k in new if k in old and old[k][1] != new[k][1]}
    return out


def changes(spark, t, r):
    plan = snapshots.consecutive(r, "g", ["seq"], SNAP())
    revs = r.select(SNAP().alias("later"), "rev")
    found = snapshots.snapshot_changes(t, plan, {"g": F.col("g"), "k": F.col("k")}).join(revs, "later")
    return {(x["g"], x["k"], x["rev"], snapshots.CHANGE_NAMES[x["change"]]) for x in found.collect()}


def test_consecutive_changes_against_brute_force(spark):
    rnd = random.Random(3)
    order = {g: [f"{g}{i}" for i in range(4)] for g in "ab"}
    data = [(g, rev, f"k{rnd.randrange(12)}", rnd.choice(["x", "y", None]), i) for i, (g, rev) in enumerate((g, rev) for g, revs in order.items() for rev in revs for _ in range(9))]
    data += data[:10]
    r = runs(spark, [(g, rev, i) for g, revs in order.items() for i, rev in enumerate(revs)])
    assert changes(spark, keyed(spark, data, "clash"), r) == brute(data, order)


def test_nulls_ties_and_empty_snapshots(spark):
    data = [("a", "1", None, "x", None), ("a", "1", "k", None, 1), ("a", "3", "k", "v", 5), ("a", "3", "k", "w", 5), ("a", None, "z", "z", 1), ("b", "1", "q", "q", 1)]
    r = runs(spark, [("a", "1", 1), ("a", "2", 2), ("a", "3", 3), ("b", "1", 1)])
    got = changes(spark, keyed(spark, data), r)
    assert got == {("a", None, "2", "removed"), ("a", "k", "2", "removed"), ("a", "k", "3", "added")}


def test_empty_tables(spark):
    empty = keyed(spark, [])
    assert changes(spark, empty, runs(spark, [("a", "1", 1), ("a", "2", 2)])) == set()
    assert changes(spark, keyed(spark, [("a", "1", "k", "v", 1)]), runs(spark, [])) == set()


def test_one_key_holding_a_third_of_all_rows(spark):
    data = [("a", "1", "hot", "v", i) for i in range(500)] + [("a", "2", "hot", "w", 1)] + [("a", str(1 + i % 2), f"k{i // 2}", "v", 1) for i in range(1000)]
    r = runs(spark, [("a", "1", 1), ("a", "2", 2)])
    assert changes(spark, keyed(spark, data), r) == {("a", "hot", "2", "changed")}


def test_path_and_hash_spellings(spark):
    df = spark.createDataFrame([("./a//b/./c.rs", "0x00FF "), ("a\\b\\c.rs", "ff"), ("/a/b/c.rs/", "\tFF\n"), (".", ""), (None, None), ("a.b/..c", "ffffffffffffffff"), ("é/x", "nothex")], "p string, h string")
    kind, number = hash_number(F.col("h"))
    got = df.select(plain_path(F.col("p")), kind, number).collect()
    assert [r[0] for r in got] == ["a/b/c.rs", "a/b/c.rs", "a/b/c.rs", "", None, "a.b/..c", "é/x"]
    assert [(r[1], r[2]) for r in got][:3] == [(1, 255)] * 3
    assert [r[1] for r in got][3:] == [2, 0, 1, 2]
    assert got[5][2] == -1
