import pytest
from pyspark.sql import functions as F

from lodegraph.compare import symbols as compare
from lodegraph.compare.report import Revisions
from lodegraph.functions import text
from lodegraph.graph.frame import build_graph
from lodegraph.operators import ranges
from lodegraph.quality import measures
from lodegraph.schemas import OutdatedIndex
from lodegraph.versioned import store as store_module
from lodegraph.versioned.store import GraphStore

SYM = "repo_id string, id string, kind string, name string, fingerprint string, signature string"


def test_comparison(spark, rows):
    base = spark.createDataFrame([("r", "m", "module", "m", "1", "s"), ("r", "a", "function", "a", "1", "s"), ("r", "b", "function", "b", "2", "s"), ("r", "old", "function", "x", "7", "s"), ("r", "n1", "function", "n", None, "s"), ("r", "d1", "function", "d", "9", "s"), ("r", "d2", "function", "d", "9", "s")], SYM)
    head = spark.createDataFrame([("r", "m", "module", "m", "2", "s"), ("r", "a", "function", "a", "1", "s"), ("r", "b", "function", "b", "3", "t"), ("r", "new", "function", "x", "7", "s"), ("r", "n2", "function", "n", None, "s"), ("r", "d3", "function", "d", "9", "s")], SYM)
    got = rows(compare.compare(base, head).select("id", "previous_id", "change", "signature_changed"))
    assert sorted(map(str, got)) == sorted(map(str, [("b", None, "modified", True), ("new", "old", "moved", False), ("n1", None, "removed", False), ("n2", None, "added", False), ("d1", None, "removed", False), ("d2", None, "removed", False), ("d3", None, "added", False)]))


def test_touched_lines(spark, rows):
    s = spark.createDataFrame([("r", "outer", "f", 1, 10, None), ("r", "inner", "f", 3, 5, "outer")], "repo_id string, id string, file string, start_line int, end_line int, parent string")
    h = spark.createDataFrame([("r", "f", 4, 2), ("r", "f", 10, 0), ("r", "f", 9, 0), ("r", "f", 20, 3)], "repo_id string, file string, start int, lines int")
    t = compare.touched(s, h)
    assert rows(t) == [("r", "inner", 4, 5), ("r", "outer", 4, 5), ("r", "outer", 9, 9)]
    assert rows(compare.uncovered(t, s)) == [("r", "inner"), ("r", "outer")]
    assert rows(compare.uncovered(t.where("first = 4"), s)) == [("r", "inner")]


def test_range_joins(spark, rows):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 5), (4, "u", None)], "e int, k string, t int")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 6, "c"), ("u", None, "z")], "k string, s int, x string")
    assert rows(ranges.as_of(left, right, ["k"], "t", "s", ["x"]).select("e", "x")) == [(1, "b"), (2, None), (3, None), (4, None)]
    files = spark.createDataFrame([("r", "a/b/c.rs"), ("r", "a/d.rs"), ("r", "e.rs")], "repo string, path string")
    folders = spark.createDataFrame([("r", ""), ("r", "a"), ("r", "a/b"), ("q", "e")], "repo string, folder string")
    assert rows(ranges.longest_prefix(files, folders, ["repo"], "path", "folder")) == [("r", "a/b/c.rs", "a/b"), ("r", "a/d.rs", "a"), ("r", "e.rs", "")]


def test_measures(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3, None, 9)] + [("b", None)], "g string, v int")
    r = measures.order_statistics(df, ["g"], "v").collect()
    assert [(x["g"], x["n"], x["min"], x["median"], x["p95"], x["max"], x["mean"]) for x in r] == [("a", 5, 1, 3, 9, 9, 4.2)]
    probes = spark.createDataFrame([("s", ["t1", "t2"]), ("u", []), ("w", ["t3"])], "symbol string, failing array<string>")
    said = spark.createDataFrame([("s", "t1"), ("s", "t9"), ("w", "t3"), ("zz", "t1")], "symbol string, test string")
    q = measures.test_selection(probes, said).first()
    assert (q["probes"], q["actual"], q["predicted"], q["true_positives"], q["exact"], q["precision"], q["recall"]) == (3, 3, 3, 2, 2, 0.667, 0.667)


def test_text_functions(spark):
    assert text.fnv1a(b"") == 0xCBF29CE484222325 and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    many = [b"ab" * n for n in range(30)] + [b"", b"z" * 5000]
    assert text.fnv1a_all(many) == [text.fnv1a(t) for t in many] and text.fnv1a_all([]) == [] and text.fnv1a_all(many[:3]) == [text.fnv1a(t) for t in many[:3]]
    df = spark.createDataFrame([("https://u:p@h/x/y.git", "a\n\n  b\n\t\n", "method", "c::T::m")], "u string, t string, k string, q string")
    r = df.select(text.without_credentials(F.col("u")), text.name_of_url(F.col("u")), text.nonblank_lines(F.col("t")), text.short_name(F.col("k"), F.col("q")), text.symbol_id(F.col("k"), F.col("q"), F.lit(2)), text.content_hash("t")).first()
    assert tuple(r)[:5] == ("https://h/x/y.git", "y", 2, "T::m", "method:c::T::m#2") and r[5] == f"{text.fnv1a(b'a' + b'''\n\n  b\n\t\n'''):016x}"


def test_stored_versions(spark, tmp_path, monkeypatch):
    stored = GraphStore(spark, str(tmp_path / "g"), {"nodes": ["id"]})
    make = lambda data: {"nodes": spark.createDataFrame(data, "id string, v int")}
    text = lambda s: [tuple(r) for r in s.dump().collect()]
    first = stored.write(make([("a", 1), ("b", None), ("c", 3)]))
    assert (first.mode, first.reason, first.added) == ("full", "not stored yet", 3)
    second = stored.write(make([("a", 1), ("b", 2), ("d", 4)]), first.token)
    assert (second.mode, second.added, second.removed, second.changed) == ("incremental", 1, 1, 1)
    whole = GraphStore(spark, str(tmp_path / "h"), {"nodes": ["id"]})
    whole.write(make([("a", 1), ("b", 2), ("d", 4)]))
    assert text(stored) == text(whole) and len(text(whole)) == 3
    tables = lambda: stored._tiers().marker()["tables"]
    before = tables()
    third = stored.write(make([("a", 1), ("b", 2), ("d", 4)]), second.token)
    assert (third.mode, third.added + third.removed + third.changed) == ("incremental", 0) and tables() == before
    assert stored.write(make([("a", 1)]), first.token).reason == "no state for the stored graph" and text(stored) == [("nodes", '{"id":"a","v":1}')]
    assert stored.delete() == 1 and stored.current() is None
    monkeypatch.setattr(store_module, "GRAPH_FORMAT", store_module.GRAPH_FORMAT + 1)
    assert whole.why_full(None, False) == "format changed"
    with pytest.raises(OutdatedIndex):
        whole.load("nodes")


def test_reports_over_two_revisions(spark, rows):
    columns = "repo_id string, id string, kind string, name string, qualified_name string, file string, start_line int, end_line int, parent string, module string, is_test boolean"
    node = lambda i, kind="function", test=False: ("r", i, kind, i, i, f"{i[0]}.rs", 1, 2, None, "m", test)
    edges = lambda data: spark.createDataFrame([("r", a, b, rel, None, [1]) for a, b, rel in data], "repo_id string, from_id string, to_id string, relation string, resolution string, lines array<int>")
    marks = lambda data: spark.createDataFrame([("r", i, f, s) for i, f, s in data], "repo_id string, id string, fingerprint string, signature string")
    base = build_graph(spark.createDataFrame([node("a"), node("b"), node("gone"), node("t", test=True), node("m", "module")], columns), edges([("b", "a", "CALLS"), ("t", "b", "CALLS"), ("t", "gone", "CALLS")]))
    head = build_graph(spark.createDataFrame([node("a"), node("b"), node("new"), node("t", test=True), node("x"), node("m", "module")], columns), edges([("b", "a", "CALLS"), ("x", "a", "CALLS_CANDIDATE"), ("new", "b", "CALLS")]))
    r = Revisions(base, head, marks([("a", "1", "s"), ("b", "1", "s"), ("gone", "7", "s"), ("t", "1", "s"), ("m", "1", "s")]), marks([("a", "2", "z"), ("b", "1", "s"), ("new", "3", "s"), ("t", "1", "s"), ("x", None, "s"), ("m", "2", "s")]))
    changes = r.changes()
    assert [(c["place"], c["id"], c["change"], c["signature_changed"]) for c in changes.orderBy("place").collect()] == [(1, "a", "modified", True), (2, "new", "added", False), (3, "x", "added", False), (4, "gone", "removed", False)]
    found = r.affected(changes)
    assert rows(found.select("id", "confidence", "side", "depth")) == [("b", "certain", "head", 1), ("t", "certain", "base", 1)]
    s = r.summary(changes, found).first()
    assert (s["changes"], s["modified"], s["added"], s["removed"], s["affected"], s["possibly_affected"], s["affected_tests"], s["files"]) == (4, 1, 2, 1, 2, 0, 1, 4)
    assert r.affected(changes.limit(0)).count() == 0
