"""Reading level of prose: classic formulas on sentence length and syllables, combined by their median.

Each formula gives a school grade. The grades of a bounded sample of labelled
texts say how each formula's grades map to the levels of the labels (a rising
step function per formula); a text's level is the rounded median of what the
formulas say. Code, links, headings and markup are taken out first, because
they are not prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fitted on; which, a hash of doc_id decides.
MAX_LABELLED = 20_000
FORMULAS = ("flesch_kincaid", "gunning_fog", "smog", "coleman_liau", "ari", "forcast", "lix")
COUNTS = ("n_sentences", "n_words", "n_letters", "n_syllables", "n_poly", "n_mono", "n_long")

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_DROP = re.compile(r"`[^`\n]*`|https?://\S+|www\.\S+|<[^<>\n]{1,80}>|!?\[([^\]\n]*)\]\([^)\n]*\)|\b\S+@\S+\.\w+|\bv?\d+(?:\.\d+)+\b|\(see\s*\)|\b[Ee]\.g\.|\b[Ii]\.e\.")
_HEADING = re.compile(r"^[ \t]{0,3}(?:#{1,6}[ \t].*|[=\-*_]{3,}[ \t]*|(?: {4}|\t)\S.*|\|.*)$", re.M)
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", re.M)
_END = re.compile(r"[.!?…]+[\"')\]]*(?=\s|\Z)|\n[ \t]*\n|\n(?=\u0001)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_VOWELS = re.compile(r"[aeiouyàâäéèêëîïôöûüœæáíóúãõ]+")
#: An e that is not heard: at the end, in -es and -ed, and before an ending or second word that begins with a consonant.
_SILENT = (
    re.compile(r"(?<![aeiouyl])e$|(?<=[aeiouylr]l)e$|(?<=[aeiou]g)ue$|(?<=q)ue$|(?<=[^aeiouy])e(?=ty$)"),
    re.compile(r"(?<![aeiouyszxcg])(?<!ch)(?<!sh)(?<![^aeiouy]l)es$"),
    re.compile(r"(?<![aeiouytd])(?<![^aeiouyl]l)ed$"),
    re.compile(r"(?<=[^aeiouyl])e(?=(?:ful|less|ly|ment|ness|thing|time|where|one$|body|fore|ware|work|like|ship|hood|ward|wise|what|how|line|place|point|stamp|base|file|name|guard|keep|land|space))"),
    re.compile(r"(?<=[aeiou]l)e(?=(?:ful|less|ly|ment|ness|name|system))"),
    re.compile(r"(?<=ev)e(?=r[yi])|(?<=bus)i(?=ness)"),
)
#: Neighbouring vowels that are two syllables.
_SPLIT = re.compile(
    r"(?<![ctgs])ia(?!g[eo])|(?<=[dstc])ia(?=t)|(?<![ctsgxln])io(?!u)|(?<=[ln])io(?![nu])|(?<=[bdhlmnprv])iou|iu(?=m)|(?<!p)(?<![gp]g)eo(?!u)|(?<=\bid)ea|(?<=ar)ea$|(?<=cr)ea(?=t)|(?<=\br)ea(?=c?t|li)|(?<=th)ea(?=t)|(?<=lin)ea|(?<=nucl)ea"
    r"|(?<=sc)ie(?=n)|(?<=cl)ie(?=n)|(?<=qu)ie(?=t)|(?<=d)ie(?=t)|(?<=[cxr])ie(?=t[yi])|(?<=h)ie(?=r)|(?<=[rdvln])ie(?=n[ct])|(?<=[^aeioutc])ie(?=r$|st$)|(?<=\bp)oe(?=[mt])|(?<=c)oe(?=x)|(?<=c)oo(?=p|rd)"
    r"|(?<![qg])ua(?!r[dy]|de)|(?<=g)ua(?=r?a|l$)|(?<![qg])ue(?=n[ct]|l|t)|(?<=fl)ui|(?<=r)ui(?=n)|ui(?=ty|ti)|(?<![q])uo|ii|(?<=[aeou])ing|(?<=[^aeiou]y)ing|(?<=na)i(?=v)|(?<=[aeiou])y(?=[aeiou])(?!e[ds]?$)|(?<=[aeiou])sm$|thm(?=$|s)"
)
_FIRST_Y = re.compile(r"^y(?=[aeiou])")


def syllables(word: str, english: bool = True) -> int:
    """Syllables of one word, at least 1. Other languages than English sound every group of vowels."""
    w = word.lower()
    if not english:
        return max(1, len(_VOWELS.findall(w)))
    w = _FIRST_Y.sub("j", w.partition("'")[0].partition("’")[0] if w.endswith(("'s", "’s")) else w)
    n = len(_VOWELS.findall(w))
    for rule in _SILENT:
        n -= len(rule.findall(w))
    return max(1, n + len(_SPLIT.findall(w)))


class _Syllables(dict):
    """Remembers words, up to a bound."""

    def __init__(self, english: bool):
        super().__init__()
        self._english = english

    def __missing__(self, word: str) -> int:
        n = syllables(word, self._english)
        if len(self) < 500_000:
            self[word] = n
        return n


_KNOWN = {True: _Syllables(True), False: _Syllables(False)}


def prose(text: str) -> str:
    """The running text: no code, links, headings, tables or rules; list items are marked, so that each ends the sentence before it."""
    text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _HEADING.sub("\n", text)
    text = _ITEM.sub("\u0001", text)
    return _DROP.sub(lambda m: m.group(1) or " ", text)


def counts(text: str, english: bool = True) -> tuple[int, ...]:
    """COUNTS of a text; all 0 where it has no words."""
    body = prose(text)
    words = _WORD.findall(body)
    if not words:
        return (0,) * len(COUNTS)
    syl = np.fromiter(map(_KNOWN[english].__getitem__, words), np.int32, len(words))
    size = np.fromiter(map(len, words), np.int32, len(words))
    sentences = sum(1 for s in _END.split(body) if _WORD.search(s))
    return (max(1, sentences), len(words), int(size.sum()), int(syl.sum()), int((syl >= 3).sum()), int((syl == 1).sum()), int((size > 6).sum()))


def grade_columns() -> dict[str, Column]:
    """The formulas over the columns COUNTS; null where a text has no words."""
    s, w, letters, syl, poly, mono, long_words = (F.nullif(F.col(c), F.lit(0)) if c in ("n_words", "n_sentences") else F.col(c) for c in COUNTS)
    per = w / s
    return {
        "flesch_kincaid": 0.39 * per + 11.8 * syl / w - 15.59,
        "gunning_fog": 0.4 * (per + 100 * poly / w),
        "smog": 1.043 * F.sqrt(30 * poly / s) + 3.1291,
        "coleman_liau": 5.88 * letters / w - 29.6 * s / w - 15.8,
        "ari": 4.71 * letters / w + 0.5 * per - 21.43,
        "forcast": 20 - 15 * mono / w,
        "lix": per + 100 * long_words / w,
    }


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [counts(t, not isinstance(lang, str) or lang == "en") if isinstance(t, str) else (0,) * len(COUNTS) for t, lang in zip(b["text"], b["lang"])]
        out = pd.DataFrame(rows, columns=list(COUNTS), dtype="int64")
        yield pd.concat([b.drop(columns="text").reset_index(drop=True), out], axis=1)


def text_counts(docs: DataFrame, keep: list[str] = []) -> DataFrame:
    """doc_id, ``keep`` (lang or nothing) and COUNTS of each document; null and blank texts count 0, a text of unknown language is taken for English."""
    out = docs.select("doc_id", "lang", "text").mapInPandas(_count_batches, "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.select("doc_id", *keep, *COUNTS)


def rising_steps(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """The rising step function nearest to y (pooled means): (right ends, values)."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[by], y[by]):
        if pools and pools[-1][2] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, end = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, end]
    return [p[2] for p in pools], [p[0] / p[1] for p in pools]


#: Where there are no labels: school grades at which the levels 2 to 5 begin, and the same for lix.
DEFAULT_STEPS = ([6.0, 10.0, 14.0, 18.0, 99.0], [1.0, 2.0, 3.0, 4.0, 5.0])
DEFAULT_LIX = ([30.0, 42.0, 54.0, 66.0, 999.0], [1.0, 2.0, 3.0, 4.0, 5.0])


def fit(labelled: pd.DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Steps of each formula from its grades and the column ``level``; with fewer than five labels, which no steps can be fitted to, the default ones."""
    if len(labelled) < 5:
        return {f: DEFAULT_LIX if f == "lix" else DEFAULT_STEPS for f in FORMULAS}
    return {f: rising_steps(labelled[f].to_numpy(float), labelled["level"].to_numpy(float)) for f in FORMULAS}


def _below(name: str):
    return lambda end: end < F.col(name)


def level_column(steps: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The median, over the formulas, of the level that their grade maps to; unrounded."""
    said = []
    for f, (ends, values) in steps.items():
        inner = F.array(*[F.lit(float(e)) for e in ends[:-1]]) if len(ends) > 1 else F.expr("array(cast(null as double))")
        at = F.size(F.filter(inner, _below(f)))
        said.append(F.element_at(F.array(*[F.lit(float(v)) for v in values]), at + 1))
    ordered = F.array_sort(F.array(*said))
    k = len(said)
    return ordered[k // 2] if k % 2 else (ordered[k // 2 - 1] + ordered[k // 2]) / 2
