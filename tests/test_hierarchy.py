import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators.hierarchy import Hierarchy


def build(spark, links, **kw):
    data = [("r", k, p, f"n{k}", 1) for k, p in links]
    df = spark.createDataFrame(data, "repo string, id string, up string, name string, at int").selectExpr("*", "1 as v", "'x' as p", "'y' as grp")
    return Hierarchy(df, "repo", "id", F.col("up"), "at", "name", **kw)


def brute(links):
    up = dict(links)
    up = {k: (p if p in up else None) for k, p in up.items()}
    out = {}
    for k in up:
        chain, x = [], k
        while x is not None and x not in chain:
            chain.append(x)
            x = up[x]
        out[k] = None if x is not None else chain[::-1]
    return out


def forest(n, seed, cycles=True):
    rnd = random.Random(seed)
    links = [(f"k{i:03d}", f"k{rnd.randrange(i):03d}" if i and rnd.random() < 0.9 else rnd.choice([None, "unknown"])) for i in range(n)]
    if cycles:
        links += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("s", "s"), ("below", "c1"), ("deep", "below")]
    return links


@pytest.mark.parametrize("bucket_nodes", [500_000, 7])
def test_against_brute_force(spark, bucket_nodes):
    links = forest(60, 5)
    want = brute(links)
    h = build(spark, links, bucket_nodes=bucket_nodes)
    got = {r["id"]: r for r in h.tree().collect()}
    assert set(got) == set(want)
    assert {r["id"] for r in h.endless().collect()} == {k for k, c in want.items() if c is None}
    for k, chain in want.items():
        r = got[k]
        if chain is None:
            assert r["path"] is None and r["depth"] is None and r["root_id"] is None and r["n_descendants"] is None
        else:
            below = sum(1 for c in want.values() if c and k in c) - 1
            assert (r["path"], r["depth"], r["root_id"], r["n_descendants"]) == ("::".join(f"n{x}" for x in chain), len(chain) - 1, chain[0], below)


def test_descendants_are_intervals(spark):
    links = forest(40, 9)
    want = brute(links)
    h = build(spark, links)
    asked = spark.createDataFrame([("r", "k000"), ("r", "k003"), ("r", "c0")], "grp string, id string")
    got = {(r["id"], r["descendant"]) for r in h.descendants(asked).collect()}
    assert got == {(a, k) for k, c in want.items() if c for a in c[:-1] if a in ("k000", "k003")}


def test_long_chain_and_wide_star(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(90)]
    star = [("hub", None)] + [(f"leaf{i}", "hub") for i in range(90)]
    h = build(spark, chain + star, bucket_nodes=20)
    got = {r["id"]: (r["depth"], r["n_descendants"]) for r in h.tree().collect()}
    assert got["c89"] == (89, 0) and got["c0"] == (0, 89) and got["hub"] == (0, 90) and got["leaf7"] == (1, 0)


def test_nulls_repeats_ties_and_empty(spark):
    data = [("r", "a", None, 1), ("r", "a", "b", 2), ("r", "b", None, 1), ("r", "b", None, 1), ("r", None, "a", 1), (None, "a", "b", 1), ("r", "t", "a", 3), ("r", "t", "b", 3), ("q", "b", "a", None)]
    df = spark.createDataFrame(data, "g string, id string, up string, at int")
    h = Hierarchy(df, "g", "id", F.col("up"), "at")
    got = {(r["grp"], r["id"]): (r["path"], r["depth"]) for r in h.tree().collect()}
    assert got == {("r", "a"): ("b::a", 1), ("r", "b"): ("b", 0), (None, "a"): ("a", 0), ("r", "t"): ("b::t", 1), ("q", "b"): ("b", 0)}
    empty = Hierarchy(df.limit(0), "g", "id", F.col("up"), "at")
    assert empty.tree().count() == 0 and empty.endless().count() == 0


def test_every_node_has_its_descendants(spark):
    links = forest(60, 7)
    h = build(spark, links)
    got = [(r["id"], r["descendant"]) for r in h.all_descendants().collect()]
    want = {(a, k) for k, c in brute(links).items() if c for a in c[:-1]}
    assert sorted(got) == sorted(want) and any(a not in {c[0] for c in brute(links).values() if c} for a, _ in want)
