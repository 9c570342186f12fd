"""Similarity of strings and fuzzy location of labels, the operations for which no built-in exists."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """2 * matched / total characters, by longest matching blocks."""
    return SequenceMatcher(None, a, b).ratio()


# the type as an object: a worker that imports this module has no session to parse its name
@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns; null where one is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


class Finder:
    """The best place of every label in documents, by similarity: the line most like it, or in longer lines the run of as many words as the label has.

    The strings that labels are compared with are few beside their occurrences, so each is judged once and remembered: counts of
    letters in common bound the similarity of all new strings to all labels at once, and only pairs that the bound
    leaves are compared.
    """

    #: Strings remembered by a worker; what is forgotten is judged again. Strings judged in one array operation.
    KEPT, BLOCK = 500_000, 2_048

    def __init__(self, labels: list[str], least: float):
        self.labels = list(dict.fromkeys(x.lower().strip() for x in labels if x.strip()))
        self.least = least
        self.sizes = sorted({len(x.split()) for x in self.labels})
        self.of_size = {n: [x for x in self.labels if len(x.split()) == n] for n in self.sizes}
        self.counts = {n: _letters(self.of_size[n]) for n in self.sizes}
        self.longest = max(map(len, self.labels), default=0)
        self.all_counts = _letters(self.labels)
        # string -> ((label, similarity), ...); under 0 those of whole lines
        self.known: dict[int, dict[str, tuple[tuple[str, float], ...]]] = {n: {} for n in (0, *self.sizes)}

    def _judge(self, size: int, strings: set[str]) -> None:
        known = self.known[size]
        if len(known) > self.KEPT:
            known.clear()
            return self._judge(size, strings)
        new = [s for s in strings if s not in known]
        labels, counts = (self.labels, self.all_counts) if size == 0 else (self.of_size[size], self.counts[size])
        lengths = np.array([len(x) for x in labels])
        for a in range(0, len(new), self.BLOCK):
            part = new[a : a + self.BLOCK]
            common = np.minimum(_letters(part)[:, None, :], counts[None, :, :]).sum(axis=2, dtype=np.int64)
            hits: dict[int, list[tuple[str, float]]] = {}
            for i, k in zip(*np.nonzero(2 * common >= self.least * (np.array([len(x) for x in part])[:, None] + lengths[None, :]) - 1e-9)):
                r = ratio(labels[k], part[i])
                if r >= self.least:
                    hits.setdefault(i, []).append((labels[k], r))
            known.update((s, tuple(hits.get(i, ()))) for i, s in enumerate(part))

    def locate(self, documents: list[list[str]]) -> list[dict[str, tuple[int, float]]]:
        """For each document label -> (index of the line, similarity); the earliest best counts. Labels that reach the least similarity nowhere are absent."""
        read = [[(low, low.split()) for low in (t.lower().strip() for t in lines)] for lines in documents]
        self._judge(0, {low for rows in read for low, _ in rows if len(low) <= self.longest + 5})
        for n in self.sizes:
            self._judge(n, {" ".join(words[k : k + n]) for rows in read for _, words in rows for k in range(len(words) - n + 1)})
        whole, out = self.known[0], []
        for rows in read:
            best: dict[str, tuple[int, float]] = {}
            for i, (low, words) in enumerate(rows):
                found = [(x, r) for x, r in whole.get(low, ()) if len(low) <= len(x) + 5]
                for n in self.sizes:
                    known = self.known[n]
                    found += [(x, r) for k in range(len(words) - n + 1) for x, r in known[" ".join(words[k : k + n])] if len(low) > len(x) + 5]
                for x, r in found:
                    if x not in best or r > best[x][1]:
                        best[x] = (i, r)
            out.append(best)
        return out


def _letters(strings: list[str]) -> np.ndarray:
    """How often each string has each of the letters a to z, each digit, and all else together (at most 255 times)."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    kind = np.full(codes.shape, 36)
    letter, digit = (codes >= 97) & (codes <= 122), (codes >= 48) & (codes <= 57)
    kind[letter] = codes[letter] - 97
    kind[digit] = codes[digit] - 22
    row = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    counts = np.bincount(row * 37 + kind, minlength=len(strings) * 37)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(strings), 37)
