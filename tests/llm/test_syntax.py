import ast
import random
import sys
from functools import reduce
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import constructs  # noqa: E402

from lodegraph.llm import parsing, syntax  # noqa: E402

GOOD = {
    "rust": [
        "use std::fmt;\n\n#[derive(Debug, Clone)]\npub struct A<'a> {\n    pub name: &'a str,\n    limit: Option<usize>,\n}\n\nimpl<'a> A<'a> {\n    pub fn new(name: &'a str) -> Self {\n        Self { name, limit: None }\n    }\n}\n",
        "pub(crate) fn f<T: Clone + Ord>(mut xs: Vec<T>) -> Vec<T> {\n    while xs.len() > 3 {\n        let _ = xs.pop();\n    }\n    xs\n}\n",
        "fn g(s: &str) -> Option<u32> {\n    let (a, b) = s.split_once(':')?;\n    match b.parse().ok()? {\n        0 => None,\n        1..=9 => Some(1),\n        x if x > 10 => Some(x),\n        _ => a.parse().ok(),\n    }\n}\n",
        "const S: &str = r#\"{ [ ( \"<<<<<<< \"#;\n/* a /* nested */ { still */\npub const N: [u32; 3] = [1, 2, 3];\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic X: u8 = b'{';\nfn h() -> char { '\\'' }\n",
    ],
    "javascript": [
        "import a from \"b\";\nexport function f(xs, n = 3) {\n  const kept = xs.filter((x) => x.v > n);\n  if (!kept.length) {\n    throw new Error(`none above ${n} of ${xs.map((y) => `${y}`)}`);\n  }\n  return kept\n}\n",
        "const R = /[{(]\\/\"/g;\nlet a = 1\nlet b = a / 2 / 1\nclass A extends B {\n  #x = 1;\n  get y() { return this.#x }\n  static async z() {}\n}\n",
        "!function(){var a={p:!0,d:6};for(var i=0;i<3;i++)if(a[i]>2)return i}();\n//# sourceMappingURL=x.js.map",
        "#!/usr/bin/env node\n\"use strict\";\nswitch (x) {\n  case 1: return_(1);\n  default:\n    f();\n}\n",
    ],
    "typescript": [
        "import type { A } from \"./a\";\nexport interface B { name: string; n?: number; tags: Array<string>; }\nexport type C = { kind: \"x\"; size: number } | { kind: \"none\" };\nconst f = <T,>(rows: T[], pick: (row: T) => string): Map<string, T[]> => {\n  const groups = new Map<string, T[]>();\n  rows.forEach((row) => {\n    groups.set(pick(row), [...(groups.get(pick(row)) ?? []), row]);\n  });\n  return groups;\n};\n",
        "class A {\n  private readonly x: string;\n\n  constructor(x: string) {\n    this.x = x;\n  }\n}\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tb \"os\"\n)\n\nvar _ = fmt.Sprint(\"x\")\n\ntype T struct {\n\tName  string `json:\"n\"`\n\tF []string\n}\n\nfunc (t *T) Do(xs []int, n int) (int, error) {\n\ttotal := 0\n\tfor _, x := range xs {\n\t\tif x > n {\n\t\t\ttotal += x\n\t\t}\n\t}\n\treturn total, nil\n}\n",
        "package b\n\nfunc f(s string) (string, bool) {\n\tswitch s {\n\tcase \"x\":\n\t\treturn \"y\", true\n\tdefault:\n\t\treturn \"\", false\n\t}\n}\n\nconst a, c = '\\'', '{'\n",
    ],
    "python": ["def f(x):\n    return x\n", "﻿x = 1\n"],
}
WORDS = {"rust": "pub fn", "javascript": "export function", "typescript": "export interface", "go": "package", "python": "def"}


@pytest.mark.parametrize("language", GOOD)
def test_valid_texts(language):
    for text in GOOD[language]:
        assert syntax.parses(language, text), text
        assert syntax.parses(language, text.replace("\n", "\r\n"))
        assert syntax.parses(language, "")
        assert syntax.parses(language, " \n\t")


@pytest.mark.parametrize("language", ["rust", "javascript", "typescript", "go"])
def test_broken_texts(language):
    for text in GOOD[language]:
        lines = text.split("\n")
        for mark in ("<<<<<<< ours", "=======", ">>>>>>> 38cd2e6916"):
            assert not syntax.parses(language, "\n".join([*lines[:1], mark, *lines[1:]])), (mark, text)
        if "{" in text and language != "javascript":
            at = text.index("{")
            assert not syntax.parses(language, text[: at + 1]), text[: at + 1]
        assert not syntax.parses(language, text + "\nThe file was cut off here by a person")


def test_other_languages_in_a_file():
    for own in ("rust", "javascript", "go"):
        for other in ("rust", "typescript", "go", "python"):
            if own != other:
                assert not syntax.parses(own, GOOD[other][0]), (own, other)


@pytest.mark.parametrize("language", constructs.GOOD)
def test_constructs(language):
    assert [t for t in constructs.GOOD[language] if not syntax.parses(language, t)] == []
    assert [t for t in constructs.BROKEN[language] if syntax.parses(language, t)] == []


PYTHON = [
    "import a\n@b\n@c(1)\ndef f(x,\n\ny=\"\"\"a\n# b\n\"\"\"):\n    return {\n'x': 1}\nelse_ = 2\nif x:\n    pass\n# c\nelif y:\n    pass\nelse:\n    z\nclass A: pass\ntry:\n  a\nfinally:\n  b\nx = 1 + \\\ny\n",
    "def f():\n  if a:\n    x\n  y = (1,\nb\n",
    "x = '''a\ndef (\n'''\nwith a as b:\n\tc\nmatch x:\n  case 1: pass\n",
    "a = 1\n  b = 2\n",
    "@a\nx = 1\n",
    "x = 1\nelse:\n  y\n",
]


def _texts():
    for language in constructs.GOOD:
        for t in [*GOOD[language], "\n".join(constructs.GOOD[language]), *constructs.GOOD[language][:12], *constructs.BROKEN[language][:8]]:
            yield language, t
            yield language, t[: len(t) // 2]
    for t in PYTHON:
        yield "python", t


def _cut_at(language, text, offsets):
    cuts = [0, *offsets, len(text)]
    maps = [syntax.piece_map(language, text[a:b]) for a, b in zip(cuts, cuts[1:])]
    if language == "python":
        maps[0] = maps[0].first()
    return maps


def test_pieces_give_what_the_whole_gives():
    """Every line end as a cut, all cuts at once, and composition in random order."""
    rnd = random.Random(7)
    for language, text in _texts():
        text = syntax.prepare(language, text)
        if not text.strip():
            continue
        want = ast_valid(text) if language == "python" else syntax.parses(language, text, 1 << 30)
        ends = [i + 1 for i, c in enumerate(text[:-1]) if c == "\n" and text[i - 1 : i] != "\\"]
        for e in ends:
            assert syntax.verdict(reduce(syntax.compose, _cut_at(language, text, [e]))) == want, (language, text, e)
        assert syntax.parses(language, text, 1) == want
        maps = _cut_at(language, text, ends)
        while len(maps) > 1:
            i = rnd.randrange(len(maps) - 1)
            maps[i : i + 2] = [syntax.compose(maps[i], maps[i + 1])]
        assert syntax.verdict(parsing.unpack(language, parsing.pack(maps[0]))) == want, (language, text)


def test_composition_is_associative():
    for language, text in _texts():
        text = syntax.prepare(language, text)
        a, b, c = (syntax.piece_map(language, p) for p in (list(syntax.pieces(text, 30)) + ["", "", ""])[:3])
        assert syntax.compose(syntax.compose(a, b), c) == syntax.compose(a, syntax.compose(b, c))


def test_what_may_nest_deeply():
    assert syntax.parses("rust", "/*" * 500 + "*/" * 500 + "fn f() {}") and not syntax.parses("rust", "/*" * 500 + "*/" * 499)
    assert syntax.parses("javascript", "x = " + "`${" * 300 + "1" + "}`" * 300) and syntax.parses("go", "package a\nvar x = " + "(" * 900 + "1" + ")" * 900)
    assert syntax.parses("javascript", "x = " + "a ? b : " * 3000 + "c") and syntax.parses("rust", "fn f() { let x = " + "!" * 5000 + "y; }")
    assert syntax.parses("typescript", "let x: " + "A<" * 60 + "B" + ">" * 60) and syntax.parses("rust", "type X = " + "A<" * 60 + "B" + ">" * 60 + ";")


def ast_valid(text):
    try:
        ast.parse(text)
        return True
    except SyntaxError:
        return False


def test_python_is_the_interpreters_own():
    for text in ("x = (1,\n", "def f(\n", "x = 1", "print 1"):
        try:
            ast.parse(text)
            good = True
        except SyntaxError:
            good = False
        assert syntax.parses("python", text) == good


def test_tables_with_odd_rows(spark):
    long = GOOD["rust"][0] * 40
    data = [(1, "a.rs", GOOD["rust"][0]), (2, "a.rs", "fn f( {"), (3, "a.rs", None), (4, "a.rs", " \n"), (5, None, "fn f( {"), (6, "a.txt", "fn f( {"), (7, "A.PY", "def f("), (8, "b.rs", long), (9, "b.rs", long + "fn g( {"), (10, "c.ts", "")]
    df = spark.createDataFrame(data, "doc_id bigint, path string, text string").selectExpr("*", "'x' as broken", "'y' as k", "'z' as lang_")
    want = {1: False, 2: True, 7: True, 8: False, 9: True}
    for sizes in ((), (200, 90, 2), (1, 1, 3)):
        assert {r["doc_id"]: r["broken"] for r in parsing.check_syntax(df, *sizes).collect()} == want
    assert parsing.check_syntax(df.limit(0)).count() == 0
    rated = df.drop("k").withColumn("repo_id", df["lang_"])
    assert {(r["language"], r["n_files"], r["n_broken"]) for r in parsing.rates(rated, parsing.check_syntax(rated)).collect()} == {("rust", 4, 2), ("python", 1, 1)}
