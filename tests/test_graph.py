"""The change-impact example: seven symbols, their calls and one trait dispatch; and joins held against kernels."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.analyses import store
from lodegraph.analyses.impact import expand_change, impact, select_tests
from lodegraph.graph import whole
from lodegraph.graph.frame import build_graph
from lodegraph.graph.traverse import bfs, shortest_paths
from lodegraph.schemas import Ambiguous, InvalidArgument, NotFound
from lodegraph.session import Scratch

S = "repo_id string, id string, kind string, name string, qualified_name string, file string, start_line int, end_line int, parent string, module string, is_test boolean"
E_ = "repo_id string, from_id string, to_id string, relation string, resolution string, lines array<int>"


def symbol(id, kind, file, module, parent=None, is_test=False):
    q = id.partition(":")[2]
    return ("r", id, kind, q.rpartition("::")[2], q, file, 1, 9, parent, module, is_test)


@pytest.fixture(scope="module")
def graph(spark):
    symbols = [
        symbol("mod:s", "module", "lib.rs", "mod:s"), symbol("mod:s::pay", "module", "pay.rs", "mod:s::pay", "mod:s"),
        symbol("fn:s::pay::validate", "function", "pay.rs", "mod:s::pay", "mod:s::pay"), symbol("fn:s::pay::authorize", "function", "pay.rs", "mod:s::pay", "mod:s::pay"), symbol("fn:s::checkout", "function", "checkout.rs", "mod:s::checkout"),
        symbol("fn:t::test_authorize", "function", "tests.rs", "mod:t", is_test=True), symbol("fn:t::test_checkout", "function", "tests.rs", "mod:t", is_test=True),
        symbol("trait:s::Gate", "trait", "gate.rs", "mod:s::gate"), symbol("method:s::Gate::charge", "method", "gate.rs", "mod:s::gate", "trait:s::Gate"),
        symbol("struct:s::Stripe", "struct", "stripe.rs", "mod:s::stripe"), symbol("method:s::Stripe::charge", "method", "stripe.rs", "mod:s::stripe", "struct:s::Stripe"), symbol("fn:s::maybe", "function", "lib.rs", "mod:s"),
    ]
    call = lambda a, b, rel="CALLS", lines=(3,): ("r", a, b, rel, "path", list(lines))
    edges = [
        call("fn:s::pay::authorize", "fn:s::pay::validate"), call("fn:s::checkout", "fn:s::pay::authorize"), call("fn:t::test_authorize", "fn:s::pay::authorize"), call("fn:t::test_checkout", "fn:s::checkout"),
        call("fn:s::pay::authorize", "method:s::Gate::charge"), call("method:s::Stripe::charge", "method:s::Gate::charge", "IMPLEMENTS"), call("fn:s::maybe", "fn:s::pay::validate", "CALLS_CANDIDATE"), call("fn:s::x", "fn:gone", "CALLS"),
    ]
    return build_graph(spark.createDataFrame(symbols, S), spark.createDataFrame(edges, E_))


def seed(g, *ids):
    return g.nodes.where(F.col("id").isin(*ids)).select(F.lit("q").alias("q"), "nid")


def named(g, df):
    return g.named(df, nid="id")


def test_dangling_edges_are_dropped_and_order_is_that_of_ids(graph):
    assert graph.edges.count() == 7
    ids = [r["id"] for r in graph.nodes.orderBy("nid").collect()]
    assert ids == sorted(ids)


def test_impact_of_a_function(graph):
    report = impact(graph, seed(graph, "fn:s::pay::validate"), possible=True)
    got = {r["id"]: (r["depth"], r["confidence"]) for r in named(graph, report.affected).collect()}
    assert got == {"fn:s::pay::authorize": (1, "certain"), "fn:s::checkout": (2, "certain"), "fn:t::test_authorize": (2, "certain"), "fn:t::test_checkout": (3, "certain"), "fn:s::maybe": (1, "possible")}
    score = report.score().first()
    assert [score[n] for n in ("direct_dependents", "transitive_dependents", "affected_modules", "affected_tests", "fan_in", "dependency_depth")] == [1, 4, 3, 2, 1, 3]
    assert (score["score"], score["level"]) == (41.2, "medium")
    assert sorted(r["contribution"] for r in report.factors().collect()) == [2.9, 5.1, 5.8, 7.1, 8.7, 11.6]
    assert [(r["name"], r["symbols"], r["tests"]) for r in report.groups("file").orderBy(F.desc("symbols"), "name").collect()] == [("tests.rs", 2, 2), ("checkout.rs", 1, 0), ("pay.rs", 1, 0)]
    chain = {r["nid"]: r["path"] for r in report.evidence().collect()}
    far = graph.nodes.where("id = 'fn:t::test_checkout'").first()["nid"]
    assert [s["step"] for s in chain[far]] == ["calls"] * 3 and chain[far][0]["nid"] == far


def test_dispatch_and_implementations(graph):
    up = {r["id"]: r["depth"] for r in named(graph, impact(graph, seed(graph, "method:s::Stripe::charge")).affected).collect()}
    assert up == {"method:s::Gate::charge": 1, "fn:s::pay::authorize": 2, "fn:s::checkout": 3, "fn:t::test_authorize": 3, "fn:t::test_checkout": 4}
    down = {r["id"]: (r["depth"], r["step"]) for r in named(graph, impact(graph, seed(graph, "method:s::Gate::charge")).affected).collect()}
    assert down["method:s::Stripe::charge"] == (1, "implements") and down["fn:s::pay::authorize"] == (1, "calls")


def test_expansion_and_limits(graph):
    kinds = {r["id"] for r in named(graph, expand_change(graph, seed(graph, "struct:s::Stripe"))).collect()}
    assert kinds == {"struct:s::Stripe", "method:s::Stripe::charge"}
    module = {r["id"] for r in named(graph, expand_change(graph, seed(graph, "mod:s"))).collect()}
    assert {"mod:s", "mod:s::pay", "fn:s::pay::validate", "fn:s::maybe"} <= module and "fn:s::checkout" not in module
    cut = impact(graph, seed(graph, "fn:s::pay::validate"), max_nodes=2)
    assert cut.affected.count() == 2 and cut.truncated.count() == 1
    with pytest.raises(InvalidArgument):
        store.callers(graph, seed(graph, "mod:s"), 99)


def test_selected_tests(graph):
    chosen = select_tests(graph, seed(graph, "fn:s::pay::authorize", "fn:s::maybe"))
    got = {r["id"]: (r["calls"], r["selection"]) for r in named(graph, chosen["selected"]).collect()}
    assert got == {"fn:t::test_authorize": (1, "direct"), "fn:t::test_checkout": (2, "transitive")}
    assert [r["id"] for r in named(graph, chosen["untested"]).collect()] == ["fn:s::maybe"]
    assert chosen["reaches"].count() == 2


def test_lookups(graph):
    assert store.find_symbol(graph.nodes, "r", "pay::validate") == "fn:s::pay::validate"
    assert store.find_symbol(graph.nodes, "r", "validate") == "fn:s::pay::validate"
    assert store.find_symbol(graph.nodes, "r", "Gate::charge") == "method:s::Gate::charge"
    with pytest.raises(Ambiguous):
        store.find_symbol(graph.nodes, "r", "charge")
    with pytest.raises(NotFound):
        store.find_symbol(graph.nodes, "r", "nothing")
    assert [r["id"] for r in store.symbols_in_order(graph.nodes, "r", ["mod:s", "no", "fn:s::maybe"]).collect()] == ["mod:s", "fn:s::maybe"]


def random_links(spark, n, m, seed_):
    rnd = random.Random(seed_)
    return spark.createDataFrame([(f"g{i % 2}", rnd.randrange(n), rnd.randrange(n)) for i in range(m)], "g string, src bigint, dst bigint")


@pytest.mark.parametrize("what", [whole.strong_components, whole.dependency_layers])
def test_joins_and_kernels_agree(spark, rows, what):
    links = random_links(spark, 14, 34, 11)
    scratch = Scratch(spark, "t")
    small, large = (what(links, scratch, limit) for limit in (1000, 0))
    assert rows(small) == rows(large.select(small.columns))


def test_traversals_agree(spark, rows):
    links = random_links(spark, 18, 50, 3).withColumn("key", F.lpad(F.hex("dst"), 16, "0")).withColumn("seed_only", F.col("src") % 5 == 0)
    starts = spark.createDataFrame([("g0", "a", 1), ("g0", "a", 2), ("g1", "b", 0), ("g1", "c", 7)], "g string, q string, nid bigint")
    for most in (None, 4):
        scratch = Scratch(spark, "t")
        one, two = (bfs(links.withColumn("label", F.lit(7)), starts, scratch, 4, most, ("label",), limit) for limit in (1000, 0))
        assert rows(one.visited.select("q", "nid", "depth", "parent")) == rows(two.visited.select("q", "nid", "depth", "parent"))
        assert rows(one.truncated) == rows(two.truncated)


def test_paths_between_pairs(spark, rows):
    links = spark.createDataFrame([("g", a, b) for a, b in ((0, 1), (1, 2), (2, 4), (0, 3), (3, 4))], "g string, src bigint, dst bigint")
    pairs = spark.createDataFrame([("g", "x", 0, 4), ("g", "y", 4, 0), ("g", "z", 2, 2)], "g string, q string, a bigint, b bigint")
    assert rows(shortest_paths(links, pairs, Scratch(spark, "t"), 9)) == [("x", 0, 0), ("x", 1, 3), ("x", 2, 4), ("z", 0, 2)]
