"""Encoding of texts with a public byte-level BPE.

A text of more than one chunk is cut into overlapping chunks. Each chunk is
pre-tokenised from its start; inside an overlap the two neighbours' boundaries
meet, and from a boundary that both have on they agree, because a pre-token
depends only on what follows its start. The stretches between such meeting
points are encoded in parallel and joined in order. Where two neighbours never
meet (one pre-token fills the overlap), they are encoded as one stretch.
Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' files lie, on every executor.
FOLDER = "/opt/tokenizers"
#: Chunks that one task reads one after the other; longer texts than CHUNK are read by several tasks in chunks of that size.
PIECE, PIECE_OVERLAP = 1 << 12, 1 << 7
CHUNK, OVERLAP = 1 << 18, 1 << 10
# fixed value: the pre-token pattern of the byte-level vocabularies
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(name: str, folder: str):
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str, folder: str, piece: int = PIECE, overlap: int = PIECE_OVERLAP) -> np.ndarray:
    """The ids of a text, read in overlapping chunks that are stitched where their pre-tokens meet."""
    if not text:
        return np.zeros(0, np.int32)
    coded = [np.asarray(encoder(name, folder).encode_to_numpy(text[a:b], disallowed_special=()), dtype=np.int32) for a, b in (stitch(text, piece, overlap) if len(text) > piece else [(0, len(text))])]
    return coded[0] if len(coded) == 1 else np.concatenate(coded)


def stitch(text: str, piece: int, overlap: int) -> list[tuple[int, int]]:
    """Stretches of a text that can be encoded apart."""
    tails, heads = [], []
    for at in range(piece, len(text), piece):
        before, end = text[at - piece : at + overlap + 1], min(at + overlap, len(text))
        tails.append(boundaries(before, at - piece, at, end))
        heads.append(boundaries(text[at : at + overlap + 1], at, at, end))
    return stretches(len(text), piece, tails, heads)


def decode(ids, name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    e = encoder(name, folder)
    return b"".join(map(e.decode_single_token_bytes, ids)).decode("utf-8")


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(chunk: str, start: int, lo: int, hi: int) -> list[int]:
    """Starts of pre-tokens of a chunk that begins at ``start``, within [lo, hi), counted in the whole text.

    A start after white space is left out: where white space ends a pre-token,
    its end depends on what follows, so the text cannot be parted there.
    """
    return [p for m in _pattern().finditer(chunk) if lo <= (p := m.start() + start) < hi and not (m.start() and chunk[m.start() - 1].isspace())]


def meet(ahead: list[int], behind: list[int]) -> int | None:
    """The first boundary that both neighbours have; a chunk's own start counts only if the one ahead has it."""
    common = set(ahead).intersection(behind)
    return min(common) if common else None


def stretches(n: int, chunk: int, tails: list[list[int]], heads: list[list[int]]) -> list[tuple[int, int]]:
    """Stretches of a text of n characters that can be encoded apart; tails[k], heads[k]: boundaries in the overlap of chunks k and k + 1, from either."""
    cuts = [0, *(p for t, h in zip(tails, heads) if (p := meet(t, h)) is not None), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _encode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            ids = [encode(t or "", name, folder) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), _lists(ids)], [*keys, "ids"])


def _count_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(encode(t or "", name, folder)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in b.schema.names if k != "text"), pa.array(n, pa.int64())], [*(k for k in b.schema.names if k != "text"), "n_tokens"])


def _chunks(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for d, t in zip(b["doc_id"], b["text"]):
            for k, at in enumerate(range(0, len(t), chunk)):
                yield pd.DataFrame({"doc_id": [d], "k": [k], "n": [len(t)], "chunk": [t[at : at + chunk + overlap + 1]]})


def _overlaps(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for d, k, n, c in zip(b["doc_id"], b["k"], b["n"], b["chunk"]):
            at, end = k * chunk, (k + 1) * chunk
            rows.append((d, k, n, boundaries(c[: overlap + 1], at, at, at + overlap) if k else [], boundaries(c, at, end, min(end + overlap, at + len(c)))))
        yield pd.DataFrame(rows, columns=["doc_id", "k", "n", "head", "tail"])


def _plan(b: pd.DataFrame, chunk: int) -> pd.DataFrame:
    b = b.sort_values("k")
    parts = stretches(int(b["n"].iloc[0]), chunk, [list(t) for t in b["tail"].iloc[:-1]], [list(h) for h in b["head"].iloc[1:]])
    return pd.DataFrame({"doc_id": b["doc_id"].iloc[0], "cuts": [[a for a, _ in parts] + [parts[-1][1]]]})


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for d, t, cuts in zip(b["doc_id"], b["text"], b["cuts"]):
            for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
                yield pd.DataFrame({"doc_id": [d], "k": [k], "text": [t[a:e]]})


def token_ids(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; [] for null and empty texts.

    docs: doc_id (unique), text; other columns are not read. The strings of
    special tokens in a text are ordinary text.
    """
    flat = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    schema = "doc_id bigint, ids array<int>"
    short = flat.where(~is_long).mapInArrow(lambda it: _encode_batches(it, name, folder, ["doc_id"]), schema)
    long = flat.where(is_long)
    cut = long.mapInPandas(lambda it: _chunks(it, chunk, overlap), "doc_id bigint, k int, n bigint, chunk string").repartition("doc_id", "k")
    seen = cut.mapInPandas(lambda it: _overlaps(it, chunk, overlap), "doc_id bigint, k int, n bigint, head array<bigint>, tail array<bigint>")
    plan = seen.groupBy("doc_id").applyInPandas(lambda b: _plan(b, chunk), "doc_id bigint, cuts array<bigint>")
    parts = long.join(plan, "doc_id").mapInPandas(_slices, "doc_id bigint, k int, text string").repartition("doc_id", "k")
    coded = parts.mapInArrow(lambda it: _encode_batches(it, name, folder, ["doc_id", "k"]), "doc_id bigint, k int, ids array<int>")
    whole = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p")).select("doc_id", F.flatten(F.col("p.ids")).alias("ids"))
    return short.unionByName(whole)


def token_counts(docs: DataFrame, keep: list[str], name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``keep`` and n_tokens of every document; 0 for null and empty texts."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.select(*keep).schema.fields, StructField("n_tokens", LongType())])
    return docs.select(*keep, "text").mapInArrow(lambda it: _count_batches(it, name, folder), schema)
