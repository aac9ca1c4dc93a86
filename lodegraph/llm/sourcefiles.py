"""Source files that nobody wrote by hand as code: generated, minified, vendored, or data saved as code.

Thresholds on the layout of a text, tuned per language, tell bodies that no
hand writes: long lines with little white space, a high density of numeric
literals, long encoded runs, and one line shape that fills the file. Paths tell
vendored directories and the names that tools give; the leading comment tells
what a tool or an importer wrote there. Marks in the middle of a text, in
strings or in quotes are only mentions and count for nothing.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: larger files are not analysed (2 MiB)
TOO_LARGE = 2 * 1024 * 1024
LAYOUT = ("mean_line", "max_line", "white_share", "alnum_share", "number_density", "encoded_share", "repeat_share", "n_lines")
REASONS = ("too_large", "vendored_path", "generated_name", "generated_header", "vendored_header", "minified", "encoded_data", "numeric_data", "sign_data", "repetitive")


@dataclass(frozen=True)
class Limits:
    """From where a body counts as not written by hand.

    A body is minified by a long line, or long lines on average, with little
    white space; it is encoded by long runs, or by alphanumerics nearly alone;
    number_density counts numeric literals in 100 characters of code, and code
    that holds hardly any letters or digits is a table of signs. repeat_share is
    that of the commonest line shape, in files of many lines, in smaller ones
    repeat_most.
    """

    minified_line: int = 200
    minified_white: float = 0.10
    mean_line: int = 120
    mean_white: float = 0.09
    encoded_alnum: float = 0.88
    encoded_white: float = 0.09
    signs_alnum: float = 0.25
    number_density: float = 4.8
    encoded_share: float = 0.30
    repeat_share: float = 0.42
    repeat_lines: int = 20
    repeat_most: float = 0.80
    repeat_least: int = 8


LIMITS = {
    "rust": Limits(),
    "go": Limits(repeat_share=0.45),
    "python": Limits(minified_white=0.08, mean_white=0.08, encoded_alnum=0.90),
    "typescript": Limits(mean_line=130),
    "javascript": Limits(minified_line=180, minified_white=0.12, mean_line=110),
}

# fixed values: directories for other projects' code, and the names that tools give to files
_VENDORED = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|3rd-?party|deps|extern|external|node_modules|bower_components|site-packages)/|(?:^|/)[\w.]+(?:-[\w.]+)*-v?\d+\.\d+(?:\.\d+)?/", re.I)
_NAMED = re.compile(r"[._-](?:generated|gen|pb|pb2|pb2_grpc|pb\.gw|g|bindings|min|bundle|string)\.[a-z]+$|\.(?:min|bundle|pb|gen|generated|g)\.[\w.]+$|-[0-9a-f]{6,}\.[a-z]+$", re.I)
_GENERATED = re.compile(
    r"code generated (?:by|from)\b|@generated\b|(?:this (?:file|code) (?:is|was|has been) )?(?:auto-?\s?generated|automatically generated|machine[- ](?:written|generated|made))\b"
    r"|(?:this file was )?generated (?:by|from|with) |produced by the \S+ (?:tool|compiler|generator)|do not (?:edit|modify)(?:[.!;:]|$)",
    re.I,
)
_IMPORTED = re.compile(
    r"(?:copied|taken|vendored|imported)(?: \w+)? from \S+ v?\d+\.\d+|this copy of \S+ .*(?:imported|vendored|copied)|upstream: https?://|\S+ v\d+\.\d+(?:\.\d+)? \|.*licen[cs]e", re.I
)
_COMMENT = re.compile(r"\s*(?:///?!?|//!|#|/\*+!?|\*|<!--)\s?(.*)")
_SOURCE_MAP = re.compile(r"^//[#@] sourceMappingURL=", re.M)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?)")
_ENCODED = re.compile(r"[A-Za-z0-9+/=]{40,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
#: Lines that people write in long runs: imports, re-exports, module and field declarations, but for numbered fields.
_DECLARED = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:use|mod|import|from|package|extern crate|export\s+(?:\*|type\s*\{|\{))\b.*|(?:pub(?:\([^)]*\))?\s+|readonly\s+)*[A-Za-z_]+\??:\s*[A-Za-z_][\w<>\[\]|&:., ]*[;,]")
_WORDS, _DIGITS = re.compile(r"[A-Za-z_]\w*"), re.compile(r"9[9.]*")
_AS_DIGIT = {ord(str(d)): "9" for d in range(10)}


def leading_comment(text: str) -> list[str]:
    """The comment lines at the head of a text, without their marks."""
    lines, inside = [], False
    for line in io.StringIO(text.lstrip("﻿"), newline="\n"):
        line = line.removesuffix("\n")
        bare = line.strip()
        if not bare:
            continue
        if bare.startswith("#!") and not bare.startswith("#!["):
            continue
        m = None if inside else _COMMENT.match(line)
        if inside:
            lines.append(bare.lstrip("* ").rstrip("*/ ").strip())
            inside = "*/" not in bare
        elif m and not bare.startswith("#[") and not bare.startswith("#!["):
            lines.append(m.group(1).rstrip("*/ ").strip())
            inside = bare.startswith("/*") and "*/" not in bare
        else:
            break
    return lines


def layout(text: str) -> tuple[float, ...]:
    """LAYOUT of a text that is not blank."""
    text = text.replace("\r\n", "\n")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n = len(text)
    longest = max(map(len, lines))
    white = n - sum(map(len, text.split()))
    alnum = len(re.sub(r"[^0-9A-Za-z]+", "", text)) if n else 0
    # comments do not dilute the code
    code = [x for x in lines if not x.lstrip().startswith(("//", "#", "/*", "* ", "*/"))] or lines
    joined = "\n".join(code)
    numbers = len(_NUMBER.findall(joined))
    encoded = sum(map(len, _ENCODED.findall(joined))) if longest >= 40 else 0
    told = "\n".join(x for x in map(str.strip, code) if not _DECLARED.fullmatch(x))
    shaped = _WORDS.sub("w", _DIGITS.sub("9", _QUOTED.sub("s", told).translate(_AS_DIGIT)))
    shapes = Counter(x for x in shaped.split("\n") if len(x) > 2)
    total = sum(len(x.strip()) > 2 for x in code) or 1
    repeat = max(shapes.values(), default=0) / total
    return (n / len(lines), float(longest), white / n, alnum / n, 100.0 * numbers / max(1, len(joined)), encoded / max(1, len(joined)), repeat, float(total))


def reasons(path: str | None, text: str | None, size: float | None, language: str | None) -> list[str]:
    """Why a file is not hand-written source, in order of cost; empty where it is, or where it holds nothing to tell."""
    if size is not None and size > TOO_LARGE:
        return ["too_large"]
    if text is None or not text.strip():
        return []
    path = path or ""
    if _VENDORED.search(path):
        return ["vendored_path"]
    if _NAMED.search(path):
        return ["generated_name"]
    head = leading_comment(text)
    if any(_GENERATED.match(x) for x in head):
        return ["generated_header"]
    if any(_IMPORTED.match(x) for x in head):
        return ["vendored_header"]
    if _SOURCE_MAP.search(text):
        return ["minified"]
    return body_reasons(layout(text), language)


def body_reasons(stats: tuple[float, ...], language: str | None) -> list[str]:
    """What the layout alone tells."""
    limits = LIMITS.get(language or "", Limits())
    mean, longest, white, alnum, numbers, encoded, repeat, n = stats
    told = {
        "minified": encoded < limits.encoded_share and (longest >= limits.minified_line and white < limits.minified_white or mean >= limits.mean_line and white < limits.mean_white),
        "encoded_data": encoded >= limits.encoded_share or alnum >= limits.encoded_alnum and white < limits.encoded_white,
        "numeric_data": numbers >= limits.number_density,
        "sign_data": alnum < limits.signs_alnum and n >= limits.repeat_least,
        "repetitive": n >= limits.repeat_lines and repeat >= limits.repeat_share or n >= limits.repeat_least and repeat >= limits.repeat_most,
    }
    return [reason for reason, holds in told.items() if holds]


#: fixed values: languages by extension, for rows without a language
_BY_EXTENSION = {"rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "go": "go"}


def language_of(path: str | None, language: str | None) -> str | None:
    return language or _BY_EXTENSION.get((path or "").rpartition(".")[2].lower())


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for d, path, text, size, lang in zip(b["doc_id"], b["path"], b["text"], b["bytes"], b["language"]):
            path, text, lang = (x if isinstance(x, str) else None for x in (path, text, lang))
            why = reasons(path, text, None if pd.isna(size) else size, language_of(path, lang))
            if why:
                found.append((d, why[0]))
        yield pd.DataFrame(found, columns=["doc_id", "reason"]).astype({"doc_id": "int64", "reason": "object"})


def not_handwritten(docs: DataFrame) -> DataFrame:
    """(doc_id, reason) of the source files that nobody wrote by hand as code.

    docs: doc_id, path, text, bytes, language; other columns are not read. A
    null size is small; a null, empty or blank text is a case only if the file
    is too large; a null path or language is told from the rest. Every row of a
    repeated doc_id is judged. An empty table gives no rows.
    """
    return docs.select("doc_id", "path", "text", "bytes", "language").mapInPandas(_judge, "doc_id bigint, reason string")


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b[b["text"].map(lambda t: isinstance(t, str) and bool(t.strip()))]
        out = pd.DataFrame([layout(t) for t in b["text"]], columns=list(LAYOUT), dtype="float64")
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        yield out.astype({"doc_id": "int64"})


def layout_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and LAYOUT of each text that is not null or blank."""
    return docs.select("doc_id", "text").mapInPandas(_measure, "doc_id bigint, " + ", ".join(f"{c} double" for c in LAYOUT))


def source_files(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("source") == "source_file")
