"""Encoding of a whole corpus with a public byte-level BPE (problem 7).

Method: forced boundaries. Two neighbouring bytes that are neighbours inside no token of the vocabulary always lie
in different tokens, whatever is around them, so a text may be cut between them and the fragments encoded one by
one. The cuts before a blank or line feed split a text into words, so most fragments come from a small dictionary
of fragments seen before; the others (runs without white space) are cut at every certain pair in them.

The expression that pre-splits text must not notice a cut: before white space it always ends a piece; between two
visible characters a fragment of a piece is again one piece, but for an apostrophe, which may begin a contraction,
so no cut touches one.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary and the expression that splits text before merging; both belong to the public tokenizer.
VOCABULARY = os.environ.get("SHEAFLINE_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments kept per worker, and the longest one that is kept or left uncut.
CACHE_SIZE, CACHE_CHARS = 200_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def pair_table(tokens) -> np.ndarray:
    """[a, b] is true where bytes a, b are neighbours inside some token."""
    inside = np.zeros((256, 256), dtype=bool)
    for t in tokens:
        b = np.frombuffer(t, dtype=np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


class Encoder:
    """encode(text) gives the ids as the bytes of an int32 array."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = read_ranks(data)
        self.bpe = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = pair_table(ranks)
        seen = np.arange(33, 127)
        self.sure = np.zeros((256, 256), dtype=bool)
        self.sure[np.ix_(seen, seen)] = ~inside[np.ix_(seen, seen)]
        self.sure[ord("'"), :] = self.sure[:, ord("'")] = False
        before = [chr(c) for c in seen if not inside[c, 32] and not inside[c, 10]]
        self.cut = re.compile(f"(?<=[{re.escape(''.join(before))}])(?=[ \n])") if before else None
        self.known: dict[str, bytes] = {}

    def _ids(self, fragment: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(fragment), dtype=np.int32).tobytes()

    def _long(self, fragment: str) -> bytes:
        if not fragment.isascii():
            return self._ids(fragment)
        b = np.frombuffer(fragment.encode(), dtype=np.uint8)
        at = [0, *(np.flatnonzero(self.sure[b[:-1], b[1:]]) + 1).tolist(), len(fragment)]
        return b"".join(self._ids(fragment[i:j]) for i, j in zip(at, at[1:]))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, out = self.known, []
        for f in self.cut.split(text) if self.cut else [text]:
            ids = known.get(f)
            if ids is None:
                if len(f) > CACHE_CHARS:
                    ids = self._long(f)
                else:
                    if len(known) >= CACHE_SIZE:
                        known.clear()
                    ids = known[f] = self._ids(f)
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, fixed


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of int) of every row; null and empty texts give an empty list, special strings are ordinary text.

    No shuffle. Repeated rows give repeated rows; other columns are not read.
    """
    data = _vocabulary(df, vocabulary)
    src = df.select(F.col(key), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for b in batches:
            parts = [enc.encode(t.as_py()) for t in b.column(1)]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, "ids"])

    kind = dict(src.dtypes)[key]
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length of the encoding of ``text`` (0 if null or empty)."""
    data = _vocabulary(df, vocabulary)
    src = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for b in batches:
            n = [len(enc.encode(t.as_py())) // 4 for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")
