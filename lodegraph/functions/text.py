"""Identifiers, names, paths, addresses and lines as column expressions; the content hash as a vectorised function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.schemas import KIND_TAGS

# fixed values: languages by extension
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell",
}
DISPLAY_CHARS = 60


def symbol_id(kind: Column, qualified: Column, n: Column | None = None) -> Column:
    """tag:qualified_name, with #n from the second of equal ones on."""
    tag = F.lit("")
    for k, t in KIND_TAGS.items():
        tag = F.when(kind == k, t).otherwise(tag)
    base = F.concat(tag, F.lit(":"), qualified)
    return base if n is None else F.when(n > 1, F.concat(base, F.lit("#"), n.cast("string"))).otherwise(base)


def qualified_of(id: Column) -> Column:
    return F.regexp_replace(id, r"^[a-z]+:(?!:)", "")


def short_name(kind: Column, qualified: Column) -> Column:
    """The last segment, with the type's for a method."""
    parts = F.split(qualified, "::")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - F.when(kind == "method", 1).otherwise(0), F.lit(1)), F.lit(2)), "::")


def normalised(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, most: int = DISPLAY_CHARS) -> Column:
    clean = normalised(text)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def language_of(path: Column) -> Column:
    pairs = [x for e, name in LANGUAGES.items() for x in (F.lit(e), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def nonblank_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*\S")).cast("int")


# fixed values: marks of generated files
GENERATED_ENDINGS, GENERATED_PARTS = (".pb.rs", ".min.js"), ("_generated.", ".generated.")
GENERATED_MARKERS = ("@generated", "do not edit", "code generated by", "automatically generated")
HEADER_LINES = 5


def _any(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole | c
    return whole


def is_generated_name(path: Column) -> Column:
    """Names that generators give to files."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return _any([F.endswith(name, F.lit(x)) for x in GENERATED_ENDINGS] + [F.contains(name, F.lit(x)) for x in GENERATED_PARTS])


def has_generated_header(text: Column, lines: int = HEADER_LINES) -> Column:
    """A generator's mark in the first lines."""
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"))
    return _any([F.contains(head, F.lit(x)) for x in GENERATED_MARKERS])


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-z+]+://)[^/@]*@", "$1")


def name_of_url(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"([^/:]+)$", 1)


def is_remote(source: Column) -> Column:
    return source.contains("://") | source.rlike(r"^git@[^:]+:")


def lines_between(text: Column, first: int, last: int) -> Column:
    """An array of (line, text) structs, counted from 1."""
    rows = F.transform(F.split(text, "\n"), lambda t, i: F.struct((i + 1).alias("line"), F.regexp_replace(t, "\r$", "").alias("text")))
    return F.slice(rows, first, last - first + 1)


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Fewer texts than this at one position are hashed one by one.
_FEW = 8


def fnv1a(data: bytes, seed: int = FNV_START) -> int:
    h = seed
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(texts: list[bytes]) -> list[int]:
    """FNV-1a of many texts at once: one step for each position, over all texts that reach it."""
    by = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in by])
    h = np.full(len(by), FNV_START, np.uint64)
    if not len(by):
        return []
    flat = np.frombuffer(b"".join(texts[i] for i in by), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shared = int(sizes[_FEW - 1]) if len(by) >= _FEW else 0
    prime, live = np.uint64(FNV_PRIME), len(by)
    with np.errstate(over="ignore"):
        for at in range(shared):
            while sizes[live - 1] <= at:
                live -= 1
            h[:live] = (h[:live] ^ flat[starts[:live] + at]) * prime
    out = [0] * len(by)
    for k, i in enumerate(by):
        out[i] = fnv1a(texts[i][shared:], int(h[k])) if len(texts[i]) > shared else int(h[k])
    return out


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, 16 hexadecimal digits; null for null."""
    known = text.notna()
    hashed = iter(fnv1a_all([t.encode() for t in text[known]]))
    return pd.Series([f"{next(hashed):016x}" if k else None for k in known], dtype=object)
