from lodegraph.explain import evidence

STEPS = "q string, chain int, pos int, source string, target string, kind string, file string, lines array<int>"
NAMES = [("fn:a::f", "function", "a::f", "a.rs"), ("method:a::T::g", "method", "a::T::g", "t.rs"), ("fn:a::h", "function", "a::h", "a.rs")]


def made(spark):
    steps = spark.createDataFrame([
        ("x", 1, 0, "fn:a::f", "method:a::T::g", "calls", "a.rs", [3, 4]), ("x", 1, 1, "method:a::T::g", "fn:a::h", "implements", "t.rs", []), ("x", 2, 0, "method:a::T::g", "fn:a::h", "implements", "t.rs", []),
        ("y", 1, 0, "fn:zz", "fn:a::h", "may_call", None, None),
    ], STEPS)
    names = spark.createDataFrame(NAMES, "id string, kind string, qualified_name string, file string")
    return steps, names, evidence.fact_texts(evidence.number_facts(steps), names)


def test_facts_are_numbered_by_first_use(spark, rows):
    steps, _, facts = made(spark)
    assert rows(facts.select("q", "fact", "text")) == [
        ("x", "E1", "`f` makes a call to `T::g` in a.rs:3,4"), ("x", "E2", "`T::g` is written in t.rs as an implementation of `h`"), ("y", "E1", "one call of `fn:zz` in an unknown place has several candidates, `h` among them"),
    ]
    assert evidence.number_facts(steps.limit(0)).count() == 0


def test_answers_cite_and_pass_their_own_check(spark):
    steps, names, facts = made(spark)
    questions = spark.createDataFrame([("x", "sufficient", "Resolved steps lead there:", None), ("y", "possible", "A chain leads there.", "See also the tests."), ("z", "insufficient", "?", None)], "q string, status string, head string, note string")
    written = evidence.write_answers(questions, steps, facts)
    said = {r["q"]: r["text"] for r in written.collect()}
    assert said["x"].split("\n") == ["Resolved steps lead there:", "- `f` makes a call to `T::g` in a.rs:3,4 [E1]. `T::g` is written in t.rs as an implementation of `h` [E2].", "- `T::g` is written in t.rs as an implementation of `h` [E2]."]
    assert said["z"] == "The graph shows no such effect." and said["y"].endswith("See also the tests.")
    known = names.unionByName(spark.createDataFrame([("fn:zz", "function", "fn:zz", "z.rs")], names.schema)).crossJoin(spark.createDataFrame([("x",), ("y",)], "q string"))
    assert {r["q"]: r["accepted"] for r in evidence.check_answers(written, facts, known).collect()} == {"x": True, "y": True, "z": True}
    offered = spark.createDataFrame([("x", "`f` reaches `h` [E1, E2]."), ("y", "`f` calls `nope` [E1]."), ("z", "It all depends.")], "q string, text string")
    v = evidence.check_answers(offered, facts, known)
    assert {r["q"]: r["source"] for r in evidence.choose(written, offered, v, questions).collect()} == {"x": "model", "y": "template", "z": "template"}


def test_checks(spark):
    _, names, facts = made(spark)
    known = names.crossJoin(spark.createDataFrame([("x",)], "q string"))

    def check(text):
        r = evidence.check_answers(spark.createDataFrame([("x", text)], "q string, text string"), facts, known).first()
        return r["accepted"], r["problems"], r["warnings"]

    assert check("`f` calls `g` [E1]. a::h is affected [E2].") == (True, [], [])
    assert check("`f` calls `g` [E9].")[1] == ["no fact is numbered E9"]
    assert check(None)[1] == check("  ")[1] == ["blank text"] and check("All is well.")[1] == ["no fact is cited"]
    assert check("`f` calls a::zz [E1].")[1] == ["`a::zz` is related to other code but not part of the evidence"]
    assert check("See `zz()`. `f` calls `T::g`. [E1]")[0::2] == (True, ["`zz()` is not part of the evidence", "without a citation: `f` calls `T::g`."])


def test_the_best_kind_of_chain_answers(spark, rows):
    one = lambda q, t: spark.createDataFrame([(q, 1, 0, "a", t, "calls", "f", [1])], STEPS)
    best = evidence.best_chains(one("x", "c"), one("x", "p").unionByName(one("y", "p")), one("y", "b").unionByName(one("z", "b")))
    assert rows(best.select("q", "target", "status")) == [("x", "c", "sufficient"), ("y", "p", "possible"), ("z", "b", "insufficient")]


def test_what_is_told(spark, rows):
    df = spark.createDataFrame([("x", 5, 1, False), ("x", 4, 2, True), ("x", 3, 2, False), ("x", 6, 1, True)], "q string, nid int, depth int, is_test boolean")
    assert [r[1] for r in sorted(rows(evidence.telling(df, 3)), key=lambda r: r[-1])] == [5, 6, 4]
