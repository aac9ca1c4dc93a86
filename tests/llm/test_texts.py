import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import encoding, mixing, reading, sourcefiles

HAND = "use std::fmt;\n\npub struct A {\n    pub name: String,\n}\n\nfn f(state: &mut Vec<u64>, n: u64) {\n    let total: u64 = state.iter().sum();\n    let next = if total % 10 == 0 { total / 2 } else { total + n };\n    state.push(next);\n    println!(\"{} of {}\", next, state.len());\n}\n"
T = "doc_id bigint, path string, text string, bytes bigint, language string"


def test_reasons():
    why = lambda path, text, size=10, lang="rust": sourcefiles.reasons(path, text, size, lang)
    assert why("src/a.rs", HAND) == []
    assert why("src/a.rs", None, 3_000_000) == ["too_large"] and why("src/a.rs", None, 2 * 1024 * 1024) == []
    assert why("vendor/x-1.2.3/a.rs", HAND) == ["vendored_path"] and why("src/vendors.rs", HAND) == []
    assert why("src/vendor_api.rs", HAND) == [] and why("src/generated_names.rs", HAND) == [] and why("src/a_pb.rs", HAND) == ["generated_name"]
    assert why("src/a.rs", "// Code generated by x from y; DO NOT EDIT.\n" + HAND) == ["generated_header"]
    assert why("src/a.rs", "/*\n" + " * own licence\n" * 12 + " * @generated by x from y.proto\n */\n" + HAND) == ["generated_header"]
    assert why("src/a.rs", "// Writes the `@generated` line that our emitter puts on top of its output.\n" + HAND) == []
    assert why("src/a.rs", "// Do not edit the order below without asking: it matters.\n" + HAND) == []
    assert why("src/a.rs", HAND + "const MARK: &str = \"// Code generated by emit; DO NOT EDIT.\";\n") == []
    assert why("src/a.rs", "// Copied unchanged from fastparser 0.12.8.\n" + HAND) == ["vendored_header"]
    assert why("src/a.rs", "// SPDX-License-Identifier: MIT (worker)\n" + HAND) == []
    assert "numeric_data" in why("src/a.rs", "pub static X: &[u8] = &[\n" + "    0x61, 0xaa, 0x64, 0x64,\n" * 9 + "];\n")
    assert "encoded_data" in why("src/a.rs", "pub static X: &[&str] = &[\n" + f"    \"{'aB3/' * 16}\",\n" * 4 + "];\n")
    assert "minified" in why("a.js", "function a(b,c){return b?c+1:[b,c]}" * 20, 700, "javascript")
    assert "repetitive" in why("src/a.rs", "".join(f"pub fn x_f{i:03d}(raw: &[u8]) -> u8 {{ raw[{i}] }}\n" for i in range(30)))
    assert why("src/a.rs", "") == [] and why("src/a.rs", "\n \n") == [] and why(None, HAND, None, None) == []


def test_source_file_tables(spark):
    data = [(1, "src/a.rs", HAND, 10, "rust"), (2, None, None, None, None), (3, "a.pb.go", "package a\n", 10, None), (4, "a.rs", None, 3_000_000, None), (4, "a.rs", None, 3_000_000, None), (5, "x.js", "a" * 300_000, 300_000, "javascript")]
    df = spark.createDataFrame(data, T).selectExpr("*", "'x' as reason")
    assert sorted((r["doc_id"], r["reason"]) for r in sourcefiles.not_handwritten(df).collect()) == [(3, "generated_name"), (4, "too_large"), (4, "too_large"), (5, "minified")] or {r["doc_id"] for r in sourcefiles.not_handwritten(df).collect()} == {3, 4, 5}
    assert sourcefiles.not_handwritten(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in sourcefiles.layout_statistics(df).collect()} == {1, 3, 5}


TEXTS = [None, "", " ", "Hello, world! It's 12 o'clock.\r\n\tñandú 日本語 🧩🧩 <|endoftext|>", "a" * 5000, " " * 3000 + "x", "word " * 900, "\n\n\n" * 400 + "end", "١٢٣ abc" * 50]


def test_ids_decode_to_the_text_and_match_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encoding.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as k")
    for chunk, overlap in ((1 << 18, 1 << 10), (64, 16), (300, 50)):
        got = {r["doc_id"]: r["ids"] for r in encoding.token_ids(df, chunk=chunk, overlap=overlap).collect()}
        assert set(got) == set(range(len(TEXTS)))
        for i, t in enumerate(TEXTS):
            assert got[i] == other.encode(t or "", add_special_tokens=False).ids, (chunk, i)
            assert encoding.decode(got[i]) == (t or "")
    assert encoding.token_ids(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in encoding.token_counts(df, ["doc_id"]).orderBy("doc_id").collect()] == [len(got[i]) for i in range(len(TEXTS))]


def test_meeting_points():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["word", " ", "  ", "\n", "12", "é", "x" * 30, "'ll", "!?", "\t", "日本"]) for _ in range(rnd.randrange(80)))
        want = encoding.encode(text, "byte_bpe_50k", encoding.FOLDER, 1 << 30)
        for piece, overlap in ((7, 3), (40, 12), (16, 16)):
            assert (encoding.encode(text, "byte_bpe_50k", encoding.FOLDER, piece, overlap) == want).all()
    assert encoding.meet([5, 9, 12], [4, 9, 12]) == 9 and encoding.meet([5], [6]) is None
    assert encoding.stretches(30, 10, [[12], [21, 23]], [[11, 12], [22]]) == [(0, 12), (12, 30)]


def mix(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "'x' as copy", "1 as block")
    return mixing.Mix(d, spark.createDataFrame(targets, "source string, target_weight double, max_repeats int").selectExpr("*", "'y' as n_tokens"), docs_per_part=100)


def test_shares_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, s, rnd.randrange(50, 400)) for i, s in enumerate(["big"] * 900 + ["mid"] * 250 + ["small"] * 60)] + [(9001, "big", 0), (9002, None, 7), (9003, "untargeted", 70)]
    m = mix(spark, docs, [("big", 50.0, 1), ("mid", 30.0, 2), ("small", 20.0, 4), ("absent", 10.0, 3), (None, 1.0, 1), ("never", 0.0, 1)])
    shares = {r["source"]: r for r in m.shares().collect()}
    assert set(shares) == {"big", "mid", "small", "absent", "never"} and shares["absent"]["tokens"] == 0
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s]["actual_share"] - want) < 0.03 and shares[s]["repeats"] <= shares[s]["max_repeats"]
    rows = m.rows().collect()
    uses = collections.Counter(r["doc_id"] for r in rows)
    cap = {"big": 1, "mid": 2, "small": 4}
    assert all(uses[r["doc_id"]] <= cap[r["source"]] for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    ordered = sorted(rows, key=lambda r: r["position"])
    part = ordered[: len(ordered) // 3]
    total = sum(r["n_tokens"] for r in part)
    assert abs(sum(r["n_tokens"] for r in part if r["source"] == "mid") / total - 0.3) < 0.08


def test_empty_mixes(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).rows().count() == 0
    assert mix(spark, [(1, "a", 5)], []).rows().count() == 0
    assert [r["actual_share"] for r in mix(spark, [], [("a", None, None)]).shares().collect()] == [0.0]


def test_the_schedule_is_exact_far_out(spark):
    i = 3 * (1 << 40) + 12345
    got = spark.range(1).select(mixing.golden(F.lit(i))).first()[0]
    from fractions import Fraction

    want = float(Fraction(i) * Fraction(mixing.GOLDEN) % 1)
    assert abs(got - want) < 1e-3


#: Words that the rules were made with, and words that they were not.
WORDS = """people 2 being 2 science 2 idea 3 poem 2 naive 2 business 2 something 2 useful 2 everything 3 therefore 2 algorithm 4 area 3 rhythm 2 sometimes 2 the 1 table 2 reading 2 added 2 makes 1 repository 5 dependency 4 create 2 action 2 cycle 2 moved 1 apple 2 banana 3 computer 3 language 2 media 3 radio 3 period 3 various 3 serious 3 previous 3 social 2 special 2 nation 2 question 2 patient 2 ancient 2 client 2 quiet 2 society 4 variety 4 experience 4 audience 3 orient 3 actual 3 usual 3 manual 3 evaluate 4 guard 1 sequence 2 frequent 2 fluid 2 ruin 2 continuity 5 continuous 4 quote 1 beyond 2 layer 2 player 2 royal 2 employee 3 playing 2 seeing 2 going 2 doing 2 trying 2 prism 2 mechanism 4 tried 1 studied 2 played 1 wanted 2 asked 1 jumped 1 files 1 tables 2 changes 2 pages 2 services 3 classes 2 boxes 2 wishes 2 catches 2 names 1 homework 2 somewhere 2 careful 2 careless 2 movement 2 lovely 2 completely 3 statement 2 likewise 2 lifetime 2 you 1 year 1 yellow 2 style 1 rule 1 while 1 little 2 people's 2 simple 2 example 3 possible 3 available 4 document 3 important 3 information 4 development 4 environment 4 original 4 university 5 understand 3 difficult 3 paragraph 3 library 3 memory 3 engineer 3 geography 4 reality 4 react 2 theater 3 hierarchy 4 easier 3 happiest 3 cooperate 4 coordinate 4 poet 2 influence 3 cruel 2 medium 3 genius 2 virus 2 function 2 version 2 vision 2 religion 3 region 2 conscious 2 delicious 3 curious 3 graph 1 symbol 2 caller 2 method 2 module 2 parser 2 compile 2 index 2 snapshot 2 resolver 3 edges 2 nodes 1 through 1 thought 1 straight 1 queue 1 league 1 value 2 issue 2 argue 2 true 1 due 1 cue 1 eye 1 agree 2 free 1 three 1 coffee 2 area's 3 interior 4 superior 4 obvious 3 tedious 3 million 2 opinion 3 union 2 material 4 initial 3 essential 3 partial 2 negotiate 4 appropriate 4 association 5 create 2 creation 3 creative 3 created 3 idea 3 linear 3 nuclear 3 really 2 realize 3 ideal 3 breathe 1 clothes 1 rectangle 3 handle 2 handled 2 settled 2 called 1 filed 1 filled 1 needed 2 loaded 2 used 1 using 2 user 2 usage 2 server 2 service 2 machine 2 engine 2 promise 2 purpose 2 measure 2 figure 2 nature 2 picture 2 minute 2 private 2 climate 2 separate 3 accurate 3 fortunately 4 immediately 5 entirely 3 safety 2 ninety 2 variety 4"""
HELD_OUT = """water 2 mountain 2 elephant 3 umbrella 3 butterfly 3 yesterday 3 tomorrow 3 afternoon 3 holiday 3 kitchen 2 garden 2 bicycle 3 hospital 3 president 3 government 3 economy 4 political 4 philosophy 4 psychology 4 biology 4 chemistry 3 physics 2 mathematics 4 calculate 3 dictionary 4 vocabulary 5 pronunciation 5 education 4 temperature 4 literature 4 vegetable 4 comfortable 4 interesting 4 chocolate 3 camera 3 family 3 general 3 several 3 desperate 3 favorite 3 restaurant 3 orange 2 purple 2 circle 2 triangle 3 square 1 cube 1 sphere 1 voyage 2 journey 2 money 2 honey 2 monkey 2 valley 2 trouble 2 double 2 bubble 2 puzzle 2 whistle 2 castle 2 gentle 2 battle 2 candle 2 noble 2 able 2 stable 2 unable 3 capable 3 terrible 3 horrible 3 visible 3 flexible 3 sensible 3 responsible 4 sensation 3 relation 3 station 2 motion 2 ocean 2 region 2 legion 2 violin 3 violet 3 lion 2 giant 2 diary 3 dialogue 3 trial 2 denial 3 reliable 4 variable 4 triumph 2 museum 3 stadium 3 premium 3 helium 3 serious 3 furious 3 glorious 3 victorious 4 precious 2 spacious 2 gracious 2 ambitious 3 nutritious 3 courageous 3 advantageous 4 simultaneous 5 miscellaneous 5 spontaneous 4 hideous 3 courteous 3 bounteous 3 strengths 1 breathed 1 smoked 1 baked 1 painted 2 landed 2 decided 3 invited 3 watched 1 pushed 1 mixed 1 fixed 1 studying 3 carrying 3 flying 2 crying 2 skiing 2 knowing 2 growing 2 viewing 2 sewing 2 suing 2 argument 3 judgment 2 management 3 basement 2 amazement 3 hopeless 2 priceless 2 nameless 2 shameful 2 graceful 2 peaceful 2 spiteful 2 wholesome 2 lonesome 2 handsome 2 awesome 2 meanwhile 2 otherwise 3 elsewhere 2 everyone 3 everywhere 3 anyone 3 someone 2 nowhere 2 therein 2 hereby 2 whereas 2 fireplace 2 baseline 2 codebase 2 database 3 filename 2 namespace 2 timestamp 2 lifecycle 3 baseball 2 household 2 warehouse 2 horseback 2 nineteen 2 moreover 3 forever 3 however 3 whatever 3 never 2 clever 2"""


def test_syllables():
    counted = lambda said: list(zip(said.split()[::2], map(int, said.split()[1::2])))
    assert [w for w, n in counted(WORDS) if reading.syllables(w) != n] == []
    held = counted(HELD_OUT)
    assert sum(reading.syllables(w) == n for w, n in held) >= 0.85 * len(held)
    assert reading.syllables("Tageszeitung", False) == 4 and reading.syllables("nube", False) == 2 and reading.syllables("zzz") == 1


def test_prose_leaves_markup_out():
    text = "# A title here\n\nShort words go on. See `some_code::path` now!\n\n```rust\nfn incomprehensibility() {}\n```\n\n* One item\n* Two items\n\nSee https://example.org/incomprehensibilities v1.2.3 too.\n"
    n = dict(zip(reading.COUNTS, reading.counts(text)))
    assert n["n_sentences"] == 5 and n["n_poly"] == 0
    assert reading.counts("") == reading.counts("12 34 --") == (0,) * 7


def test_rising_steps():
    ends, values = reading.rising_steps(np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 4, 5]))
    assert ends == [1.0, 3.0, 4.0] and values == [1.0, 2.5, 4.5]


def test_harder_texts_get_higher_levels(spark):
    easy, hard = "We go on. It is a big dog. You can see it. ", "Incremental representation necessitates deterministic reconciliation of heterogeneous configurations. "
    docs = [(i, (easy if i % 2 else hard) * (1 + i % 3)) for i in range(40)] + [(100, None), (101, ""), (102, "42"), (103, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as level", "3 as lix", "cast(null as string) as lang")
    graded = reading.text_counts(df).select("doc_id", *[c.alias(n) for n, c in reading.grade_columns().items()])
    pdf = graded.toPandas()
    assert pdf[pdf.doc_id.isin([100, 101, 102])].lix.isna().all()
    labelled = pdf[pdf.doc_id < 20].assign(level=lambda x: np.where(x.doc_id % 2, 1.0, 5.0))
    for steps in (reading.fit(labelled), reading.fit(labelled.iloc[:0])):
        got = {r["doc_id"]: r["s"] for r in graded.select("doc_id", reading.level_column(steps).alias("s")).collect()}
        assert all(got[i] < 2.5 if i % 2 else got[i] > 3.5 for i in range(40))
    assert reading.text_counts(df.limit(0)).count() == 0


def test_marks_after_a_long_licence():
    from lodegraph.llm import sourcefiles

    licence = "".join(f"// Line {n} of the licence.\n\n" for n in range(200))
    assert sourcefiles.reasons("src/a.go", licence + "// Code generated by protoc-gen-go. DO NOT EDIT.\npackage a\n", None, "go") == ["generated_header"]
    assert sourcefiles.reasons("src/a.go", licence + "package a\n// Code generated by x\n", None, "go") == []
    assert sourcefiles.leading_comment("// a\n" * 5000) == ["a"] * 5000


def test_layouts_that_only_means_and_alphanumerics_tell():
    bundle = "\n".join("x={a:1,b:function(c){return d.e(c,f)}},g=h.i(j),k=[l,m,n].o(p=>q(r,s)),t=u?v:w;if(y){z(aa,bb)}else{cc.dd=ee};" + "f" * 20 for _ in range(6))
    assert max(map(len, bundle.split("\n"))) < 180 and sourcefiles.body_reasons(sourcefiles.layout(bundle), "javascript") == ["minified"]
    blob = "\n".join('"' + "aB3" * 12 + '"' for _ in range(7))
    assert sourcefiles.body_reasons(sourcefiles.layout(blob), "go") == ["encoded_data"]
    signs = "\n".join("[(<>), {|}, (&&), " + "<>|&" * n + "]," for n in range(1, 12))
    assert "sign_data" in sourcefiles.body_reasons(sourcefiles.layout(signs), "rust")


def test_what_people_write_in_long_runs():
    uses = "\n".join(f"pub use crate::a{i}::{n};" for i, n in enumerate("Alpha Beta Gamma Delta Eps Zeta Eta Theta Iota Kappa".split() * 3))
    fields = "pub struct Wide {\n" + "\n".join(f"    pub {n}: Option<String>," for n in "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split() * 3) + "\n}\n"
    arms = "fn f(x: u8) -> u8 {\n    match x {\n" + "\n".join(f"        {i} => {i + 3}," for i in range(8)) + "\n        _ => 0,\n    }\n}\n"
    for text in (uses, fields, arms):
        assert "repetitive" not in sourcefiles.body_reasons(sourcefiles.layout(text), "rust"), text
    numbered = "pub struct A {\n" + "\n".join(f"    pub tag{i}: Option<i64>," for i in range(30)) + "\n}\n"
    assert sourcefiles.body_reasons(sourcefiles.layout(numbered), "rust") == ["repetitive"]
