"""Syntax checks over tables of source files; pieces, summaries and grammars are in ``syntax``."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import syntax
from lodegraph.llm.lexing import State

#: Texts of more characters are read by several tasks, in parts of PART characters, FAN of which one task composes.
SPREAD, PART, FAN = 1 << 20, 1 << 18, 8
_ROWS = "doc_id bigint, broken boolean, k int, lang_ string, body string"


def language_column(path: Column) -> Column:
    """The language of a path's extension, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    pairs = [x for e, name in syntax.EXTENSIONS.items() for x in (F.lit(e), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), extension)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    b = pd.DataFrame(rows, columns=["doc_id", "broken", "k", "lang_", "body"])
    return b.astype({"doc_id": "Int64", "broken": "boolean", "k": "Int32", "lang_": object, "body": object})


def _read(batches: Iterator[pd.DataFrame], spread: int, part: int) -> Iterator[pd.DataFrame]:
    """Verdicts on texts that one task reads; parts of the others."""
    for b in batches:
        known = []
        for d, lang, t in zip(b["doc_id"], b["lang_"], b["text"]):
            if len(t) <= spread:
                known.append((d, not syntax.parses(lang, t), None, None, None))
                continue
            for k, p in enumerate(syntax.pieces(syntax.prepare(lang, t), part)):
                yield _frame([(d, None, k, lang, p)])
        yield _frame(known)


def pack(s: syntax.Summary | syntax.Python) -> str:
    if isinstance(s, syntax.Python):
        return json.dumps([s.text, s.known, s.ok])
    return json.dumps([s.text, [[a, b, t] for a, (b, t) in s.by.items()]])


def unpack(language: str, body: str) -> syntax.Summary | syntax.Python:
    if language == "python":
        return syntax.Python(*json.loads(body))
    text, by = json.loads(body)
    return syntax.Summary(language, text, {State(*a): (State(*b), t) for a, b, t in by})


def _combine(batches: Iterator[pd.DataFrame], fan: int | None) -> Iterator[pd.DataFrame]:
    """Passes verdicts on. Neighbouring parts become one summary each ``fan`` of them; without a fan summaries become verdicts."""
    parts: dict[tuple, list] = defaultdict(list)
    for b in batches:
        yield _frame(list(b[b["k"].isna()].itertuples(index=False, name=None)))
        for d, _, k, lang, body in b[b["k"].notna()].itertuples(index=False, name=None):
            parts[d, int(k) // fan if fan else 0, lang].append((int(k), body))
    for (d, g, lang), held in parts.items():
        held.sort()
        if not fan:
            whole = reduce(syntax.compose, [unpack(lang, body) for _, body in held])
            yield _frame([(d, not syntax.verdict(whole), None, None, None)])
            continue
        maps = [syntax.piece_map(lang, body) for _, body in held]
        if held[0][0] == 0 and lang == "python":
            maps[0] = maps[0].first()
        yield _frame([(d, None, g, lang, pack(reduce(syntax.compose, maps)))])


def check_syntax(docs: DataFrame, spread: int = SPREAD, part: int = PART, fan: int = FAN) -> DataFrame:
    """(doc_id, broken) of each text in a language that can be parsed.

    docs: doc_id (unique), path, text; other columns are not read. Null, empty
    and blank texts, null paths and other extensions give no row; repeated rows
    give one each. Every text is read piece by piece and its summaries are
    composed; those above ``spread`` characters by several tasks in two rounds.
    The table is scanned once, only verdicts and parts of long texts are shuffled.
    """
    known = docs.select("doc_id", "text", language_column(F.col("path")).alias("lang_")).where(F.col("lang_").isNotNull() & F.col("text").rlike(r"\S"))
    rows = known.mapInPandas(lambda it: _read(it, spread, part), _ROWS)
    rows = rows.repartition("doc_id", F.floor(F.col("k") / fan)).mapInPandas(lambda it: _combine(it, fan), _ROWS)
    return rows.repartition("doc_id").mapInPandas(lambda it: _combine(it, None), _ROWS).select("doc_id", "broken")


def rates(docs: DataFrame, checked: DataFrame) -> DataFrame:
    """Files, broken files and their share per repo_id and language."""
    of = docs.select("doc_id", "repo_id", language_column(F.col("path")).alias("language"))
    return of.join(checked, "doc_id").groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"), F.round(F.avg(F.col("broken").cast("int")), 6).alias("share"))
