import pytest
from pyspark.sql import functions as F

from lodegraph.operators import feed
from lodegraph.operators.tiers import Conflict


def test_runs_process_what_their_base_lacks(spark, rows):
    data = [("a1", "k", "v", 1), ("a2", "k", "v", 1), ("a2", "n", "v", 1), ("a3", "k", "w", 1), ("a3", "k", "v", None), ("a3", "n", None, 1), ("x", "k", "v", 1)]
    r = spark.createDataFrame([("a1", None, 1, None), ("a2", "a1", 2, 1), ("a3", "a2", 3, 2), ("a4", "a2", 4, 2)], "s string, base string, txn int, base_txn int")
    given = spark.createDataFrame(data, "s string, k string, v string, t int").selectExpr("*", "1 as base", "2 as txn")
    assert rows(feed.pending_runs(given, r, "s", "k", "v", F.col("t"))) == [("a1", "k"), ("a2", "n"), ("a3", "k"), ("a3", "n")]
    assert rows(feed.pending_runs(given.limit(0), r, "s", "k", "v", F.col("t"))) == [] and rows(feed.pending_runs(given, r.limit(0), "s", "k", "v", F.col("t"))) == []


def make(spark, data):
    return spark.createDataFrame(data, "k string, v string, txn bigint, note string")


def got(df):
    return sorted(((r["k"], r["v"]) for r in df.collect()), key=str)


def test_feed_neither_skips_nor_repeats(spark, tmp_path):
    f = feed.Feed(spark, str(tmp_path / "feed"), ["k"], "v", "txn")
    first = make(spark, [("a", "1", 1, "x"), ("b", "1", 2, "x"), ("c", "1", 3, "x"), (None, "n", None, "x")])
    todo, token = f.pending(first, open_txns=[2])
    assert got(todo) == sorted([("a", "1"), ("c", "1"), (None, "n")], key=str)
    todo, token = f.pending(first, open_txns=[2])  # the run died before it committed
    assert len(got(todo)) == 3
    f.commit(todo, token)
    second = first.unionByName(make(spark, [("a", "2", 4, "x"), ("d", None, 5, "x")]))
    todo, token = f.pending(second, open_txns=[])
    assert got(todo) == [("a", "2"), ("b", "1"), ("d", None)]
    f.commit(todo, token)
    assert f.pending(second, open_txns=[])[0].isEmpty()
    with pytest.raises(Conflict):
        f.commit(todo, token)


def test_batches_in_any_order_lose_nothing(spark, tmp_path):
    f = feed.Feed(spark, str(tmp_path / "feed"), ["k"], "v", "txn")
    seen = []
    for data, open_txns in (([("a", "1", 10, "")], []), ([("b", "1", 5, ""), ("c", "1", 11, ""), ("a", "1", 10, "")], [11]), ([("e", "1", 2, "")], [11]), ([("d", "1", 1, "")], [])):
        todo, token = f.arriving(make(spark, data), open_txns)
        todo = todo.persist()
        seen.append(got(todo))
        f.commit(todo, token)
    assert seen == [[("a", "1")], [("b", "1")], [("e", "1")], [("c", "1"), ("d", "1")]]


def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch):
    f = feed.Feed(spark, str(tmp_path / "feed"), ["k"], "v", "txn")
    source = make(spark, [("a", "1", 1, ""), ("b", "1", 2, "")])
    for step in ("write", "_publish"):
        todo, token = f.pending(source, [])
        monkeypatch.setattr(f.tiers, step, lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            f.commit(todo, token)
        monkeypatch.undo()
        assert f.tiers.marker()["seq"] == -1 and len(got(f.pending(source, [])[0])) == 2
    (tmp_path / "feed" / "done").mkdir(exist_ok=True)
    (tmp_path / "feed" / "done" / "_torn").write_text("")
    todo, token = f.pending(source, [])
    f.commit(todo, token)
    assert f.pending(source, [])[0].isEmpty()


def test_the_ledger_is_merged_by_tiers(spark, tmp_path):
    f = feed.Feed(spark, str(tmp_path / "feed"), ["k"], "v", "txn")
    for i in range(6):
        todo, token = f.arriving(make(spark, [(f"k{i}", "1", i, ""), ("same", str(i), i, "")]), [])
        f.commit(todo, token)
    m = f.tiers.marker()
    assert len(m["tables"]["ledger"]) <= 3 and f.tiers.read("ledger", m).count() == 7


def test_following_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    f = feed.Feed(spark, str(tmp_path / "feed"), ["k"], "v", "txn")
    fails = [True]

    def process(df, seq):
        df.write.mode("overwrite").parquet(f"{out}/seq={seq}")
        if fails and fails.pop():
            raise RuntimeError("down")

    for i, data in enumerate(([("a", "1", 9, "")], [("b", "1", 3, ""), ("a", "1", 9, ""), ("a", "2", 10, "")])):
        make(spark, data).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k string, v string, txn bigint, note string").parquet(str(source))
        for _ in range(2):
            try:
                feed.follow(stream, f, process, str(tmp_path / "check")).awaitTermination()
            except Exception as e:
                assert "down" in str(e)
    assert got(spark.read.parquet(out)) == [("a", "1"), ("a", "2"), ("b", "1")]
