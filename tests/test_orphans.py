import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodegraph.operators import orphans

DAY = lambda n: datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(days=n)
P = "repo_id string, id string, extracted_at timestamp, deleted_at timestamp"
R = "repo_id string, ref string, recorded_at timestamp"


def parents(spark, data, shared=False, steps=False):
    df = spark.createDataFrame(data, P).withColumn("scope", F.lit("clash")).withColumn("key", F.lit(1))
    return orphans.parent_events(df, None if shared else "repo_id", "id", "extracted_at", "deleted_at", steps)


def refs(spark, data):
    return orphans.reference_events(spark.createDataFrame(data, R).withColumn("first", F.lit("clash")).withColumn("step", F.lit("x")), "t", "repo_id", F.col("ref"), "recorded_at")


def found(spark, r, p, s=None, history=False):
    known = parents(spark, s, True) if s is not None else None
    made = parents(spark, p, steps=True)
    return orphans.replay([refs(spark, r)], made, known, [made], history)


def states(df):
    return sorted(((r["period"], r["scope"], r["key"], r["state"]) for r in df.collect()), key=str)


def brute(r, p, s):
    """By definition, one reference at a time."""
    out = set()
    for scope, key, at in r:
        if key is None:
            continue
        sights = [(x[2], x[3]) for x in p if x[0] == scope and x[1] == key] + [(x[2], x[3]) for x in s if x[1] == key]
        period = at.strftime("%Y-%m") if at else None
        if not sights:
            out.add((period, scope, key, "missing"))
        elif at and at < min(t for t, _ in sights):
            out.add((period, scope, key, "late"))
        elif at:
            gone = max(sights, key=lambda x: (x[0], x[1] is not None, x[1] or DAY(0)))[1]
            if gone and at >= gone:
                out.add((period, scope, key, "deleted"))
    return sorted(out, key=str)


def some(rnd, n):
    p = [(rnd.choice("rq"), rnd.choice("abcdef"), DAY(rnd.randrange(90)), DAY(rnd.randrange(90)) if rnd.random() < 0.4 else None) for _ in range(n)]
    s = [("z", rnd.choice("efg"), DAY(rnd.randrange(90)), DAY(rnd.randrange(90)) if rnd.random() < 0.3 else None) for _ in range(2)]
    r = [(rnd.choice(["r", "q", None]), rnd.choice(["a", "b", "c", "d", "e", "f", "g", "h", None]), DAY(rnd.randrange(90)) if rnd.random() < 0.9 else None) for _ in range(3 * n)]
    return r, p, s


def test_states_of_a_reference(spark):
    p = [("r", "ok", DAY(0), None), ("r", "late", DAY(5), None), ("r", "gone", DAY(0), None), ("r", "gone", DAY(2), DAY(3)), ("r", "back", DAY(0), DAY(1)), ("r", "back", DAY(2), None), ("q", "other", DAY(0), None), ("r", None, DAY(0), None)]
    s = [("z", "shared", DAY(0), None), ("z", "late", DAY(4), None)]
    r = [("r", k, DAY(4)) for k in ("ok", "late", "gone", "back", "other", "shared", "nowhere", None)] + [("r", "gone", DAY(1)), ("r", "late", DAY(1)), ("r", "late", DAY(40)), (None, "ok", DAY(4))]
    assert states(found(spark, r, p, s)) == sorted([("2025-01", "r", "gone", "deleted"), ("2025-01", "r", "late", "late"), ("2025-01", "r", "nowhere", "missing"), ("2025-01", "r", "other", "missing"), ("2025-01", None, "ok", "missing")], key=str)


def test_boundaries_and_missing_times(spark):
    p = [("r", "a", DAY(1), DAY(2)), ("r", "b", DAY(1), None)]
    assert [(x["period"], x["key"], x["state"]) for x in found(spark, [("r", "a", DAY(1)), ("r", "b", None), ("r", "c", None)], p).collect()] == [(None, "c", "missing")]
    assert [x["state"] for x in found(spark, [("r", "a", DAY(2))], p).collect()] == ["deleted"]


def test_replay_against_brute_force(spark):
    rnd = random.Random(5)
    for n in (4, 14):
        r, p, s = some(rnd, n)
        assert states(found(spark, r, p, s)) == brute(r, p, s)


def test_history_is_what_was_known_then(spark):
    r, p, s = some(random.Random(8), 12)
    r = [x for x in r if x[2]]
    changes = found(spark, r, p, s, True).collect()
    for m in (1, 2, 3):
        end = datetime(2025, m + 1, 1, tzinfo=timezone.utc)
        want = brute([x for x in r if x[2] < end], [x for x in p if x[2] < end], s)
        got = {}
        for c in changes:
            if c["step"] <= 2025 * 12 + m:
                got[c["period"], c["state"]] = got.get((c["period"], c["state"]), 0) + c["n"]
        count = {}
        for period, _, _, state in want:
            count[period, state] = count.get((period, state), 0) + 1
        assert {k: v for k, v in got.items() if v} == count


def test_stored_state_is_the_same_in_any_batches(spark, tmp_path):
    r, p, s = some(random.Random(11), 10)
    state = orphans.OrphanState(spark, str(tmp_path / "s"))
    state.advance(references=refs(spark, r[:10]))
    assert {x[3] for x in states(state.pending())} == {"missing"}
    state.advance(parents=parents(spark, p[5:]))
    state.advance(references=refs(spark, r[10:20]), shared=parents(spark, s, True))
    assert states(state.pending()) == brute(r[:20], p[5:], s)
    state.advance(references=refs(spark, r[20:]), parents=parents(spark, p[:5]))
    assert states(state.pending()) == brute(r, p, s) and sum(x["orphans"] for x in state.counts().collect()) == len(brute(r, p, s))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    state = orphans.OrphanState(spark, str(tmp_path / "s"))
    state.advance(references=refs(spark, [("r", f"k{i}", DAY(1)) for i in range(400)]))
    state.advance(parents=parents(spark, [("r", "k7", DAY(0), None)]))
    marker = state.tiers.marker()
    assert [t["rows"] for t in marker["tables"]["references"]] == [400, 1] and [t["rows"] for t in marker["tables"]["parents"]] == [1]
    assert state.pending().count() == 399


def test_empty_tables(spark, tmp_path):
    assert found(spark, [], [], []).count() == 0
    assert found(spark, [("r", "a", DAY(0))], []).count() == 1
    state = orphans.OrphanState(spark, str(tmp_path / "s"))
    state.advance(references=refs(spark, []), parents=parents(spark, []))
    assert state.pending().count() == 0
