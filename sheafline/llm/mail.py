"""Only the text that the sender of a mail newly wrote (problem 2).

Method: the body is segmented into blocks (paragraphs, split where the depth of quotation or the cue of the lines changes) and
gradient-boosted trees classify them by contact density, quote depth, sender frequency (in how many mails and by how
many senders their lines occur), overlap with the quoted ancestors, wording, and how far the nearest closing
formulas, separators, introductions, copied headers and quotations are on either side. A second stage of trees sees also
what the first says of the neighbouring blocks. The trees decide alone; they are fitted on a bounded sample of mails that
``mail_labels`` labels, since no labelled mails exist.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm import mail_labels
from sheafline.llm import mail_lines as C
from sheafline.llm.boosting import Boosted
from sheafline.llm.mail_lines import Line, bare, read_mail
from sheafline.session import bounded_sample, top_and_rest

#: Mails of the training sample (the first by a hash of their id); lines broadcast with their counts (the others come by a join); mails that a line must stand in to be counted as repeated.
FIT_MAILS, MOST_LINES, LINE_MAILS = 1_500, 20_000, 3
#: Farthest distance, in lines, that a feature tells apart.
FAR = 40


def blocks_of(lines: list[Line]) -> list[list[Line]]:
    out: list[list[Line]] = []
    for x in lines:
        if out and out[-1][-1].paragraph == x.paragraph and out[-1][-1].cue == x.cue:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", s.lower())


class Wording:
    """Log odds of words in old against new lines of the training sample."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    @classmethod
    def fit(cls, labelled: list[tuple[str, int]]) -> Wording:
        c = (Counter(), Counter())
        for text, y in labelled:
            c[y].update(set(_words(text)))
        n = [max(sum(1 for _, y in labelled if y == k), 1) for k in (0, 1)]
        return cls({w: math.log((c[1][w] + 0.5) / (n[1] + 1)) - math.log((c[0][w] + 0.5) / (n[0] + 1)) for w in {*c[0], *c[1]} if c[0][w] + c[1][w] >= 3})

    def score(self, text: str) -> float:
        w = _words(text)
        return sum(self.odds.get(x, 0.0) for x in w) / max(len(w), 1)


def _distances(marks: list[bool], sizes: list[int]) -> tuple[list[int], list[int]]:
    """For each block the lines between it and the nearest marked block before and after it, ``FAR`` at most."""
    n = len(marks)
    before, after = [FAR] * n, [FAR] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        gap = FAR
        for i in order:
            out[i] = gap
            gap = 0 if marks[i] else min(FAR, gap + sizes[i])
    return before, after


def features(blocks: list[list[Line]], names: set[str], common: dict[str, tuple[int, int]], wording: Wording) -> np.ndarray:
    """A row for each block; all features come from the wording and the layout of the lines."""
    n = len(blocks)
    if not n:
        return np.zeros((0, WIDTH))
    sizes, cues, deep = [len(b) for b in blocks], [b[0].cue for b in blocks], [b[0].depth > 0 for b in blocks]
    total = sum(sizes)
    head = [b[0].cue == C.HEAD and len(b) >= 2 for b in blocks]
    top = [c == C.MARKER or h for c, h in zip(cues, head)]
    first_top = next((i for i, t in enumerate(top) if t), n)
    old = {w for i, b in enumerate(blocks) for x in b if x.depth or i > first_top for w in _words(x.text)}
    marks = [[c == k and not d for c, d in zip(cues, deep)] for k in (C.CLOSES, C.SEPARATES, C.NAMES, C.CONTACTS, C.MARKER, C.INTRODUCES, C.INTRO_BEGINS, C.INTRO_ENDS)] + [head, deep]
    near = [d for m in marks for d in _distances(m, sizes)]
    # from each block on to the next quotation, marker or introduction: lines, and the share of them that are short
    rest, short = [0] * n, [0.0] * n
    lines = few = 0
    for i in range(n - 1, -1, -1):
        if i + 1 < n and (deep[i + 1] or top[i + 1] or cues[i + 1] in (C.INTRODUCES, C.INTRO_BEGINS)):
            lines = few = 0
        rest[i], short[i] = min(lines, FAR), few / max(lines, 1)
        lines += sizes[i]
        few += sum(len(x.text) < 45 and len(x.text.split()) <= 4 for x in blocks[i])
    rows, seen, depth_seen = [], 0, 0
    for i, b in enumerate(blocks):
        text = " ".join(x.text for x in b)
        words = _words(text)
        freq = [common.get(x.text, (1, 1)) for x in b]
        own = 0.0 if b[0].depth else 1.0
        rows.append((
            sum(x.cue == C.CONTACTS or "@" in x.text for x in b) / len(b), max(x.depth for x in b), math.log(max(f[0] for f in freq)), math.log(max(f[1] for f in freq)), sum(math.log(f[0]) for f in freq) / len(b),
            len(old.intersection(words)) / max(len(set(words)), 1) * own, seen / total, seen, len(b), len(text) / len(b), len(words) / len(b), max(len(x.text) for x in b), wording.score(text), wording.score(blocks[i + 1][0].text) if i + 1 < n else 0.0,
            sum(bare(x.text) in names for x in b) / len(b), text.count("@") / len(b), sum(c.isdigit() for c in text) / max(len(text), 1), float(text[:1].isdigit()), float(text.endswith(",")), float(bool(C.HEAD_FIRST.match(b[0].text))),
            sizes[i + 1] if i + 1 < n else 0, float(i > first_top), float(i == first_top), float(i > 0 and b[0].paragraph == blocks[i - 1][0].paragraph), depth_seen, rest[i], short[i],
            *(d[i] for d in near), *(float(cues[i] == k) for k in range(10)), float(i + 1 < n and deep[i + 1]), float(i > 0 and deep[i - 1]),
        ))
        seen += len(b)
        depth_seen = max(depth_seen, b[0].depth)
    return np.array(rows, dtype=float)


#: Number of features.
WIDTH = 27 + 20 + 10 + 2


def _stacked(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The features of the second stage: those of the first and what it says of the two blocks on either side and of all before."""
    pad = np.concatenate([[0.5, 0.5], p, [0.5, 0.5]])
    n = len(p)
    return np.column_stack([f, p, pad[:n], pad[1 : n + 1], pad[3 : n + 3], pad[4 : n + 4], np.maximum.accumulate(p) if n else p, np.minimum.accumulate(p[::-1])[::-1] if n else p])


class Model:
    def __init__(self, first: Boosted, second: Boosted, wording: Wording, common: dict[str, tuple[int, int]]):
        self.first, self.second, self.wording, self.common = first, second, wording, common

    def probabilities(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """Of each mail the probability of each block to be old."""
        ends = np.cumsum([len(f) for f in feats])[:-1] if feats else []
        if not sum(map(len, feats)):
            return [np.zeros(0) for _ in feats]
        one = np.split(self.first.probability(np.concatenate(feats)), ends)
        return np.split(self.second.probability(np.concatenate([_stacked(f, p) for f, p in zip(feats, one)])), ends)


def train(texts: list[str], common: dict[str, tuple[int, int]]) -> Model:
    """Trees and wording from mails. The second stage is fitted on predictions of trees that did not see the mail, so that it learns how far they may be trusted."""
    mails = [(lines, names, mail_labels.structure(lines, names)) for lines, names in map(read_mail, filter(None, texts))]
    wording = Wording.fit([(x.text, int(s != mail_labels.NEW)) for lines, _, states in mails for x, s in zip(lines, states) if not x.depth])
    feats, labels = [], []
    for lines, names, states in mails:
        state = {x.no: s for x, s in zip(lines, states)}
        blocks = blocks_of(lines)
        feats.append(features(blocks, names, common, wording))
        labels.append(np.array([float(sum(state[x.no] != mail_labels.NEW for x in b) * 2 > len(b)) for b in blocks]))
    x = lambda part: np.concatenate([np.zeros((0, WIDTH)), *part])
    y = lambda part: np.concatenate([np.zeros(0), *part])
    halves = [slice(k, None, 2) for k in (0, 1)]
    crossed: list[np.ndarray] = [np.zeros(0)] * len(feats)
    for own, other in (halves, halves[::-1]):
        trees = Boosted(**TREES).fit(x(feats[other]), y(labels[other]))
        crossed[own] = [trees.probability(f) for f in feats[own]]
    second = [_stacked(f, p) for f, p in zip(feats, crossed)]
    return Model(Boosted(**TREES).fit(x(feats), y(labels)), Boosted(**TREES).fit(np.concatenate([np.zeros((0, WIDTH + 7)), *second]), y(labels)), wording, common)


#: The trees of both stages.
TREES = {"rounds": 40, "depth": 4, "rate": 0.3, "cuts": 16, "leaf": 5, "share": 0.4}


def old_lines(texts: list[str | None], model: Model, counts: list[list | None] | None = None) -> list[list[int]]:
    """Of each mail the numbers of the lines that are not newly written. counts: (line, mails, senders) of repeated lines of each mail that are not broadcast."""
    mails = [read_mail(t) if t else ([], set()) for t in texts]
    per = [blocks_of(lines) for lines, _ in mails]
    more = [{c["line"]: (c["mails"], c["senders"]) for c in x or ()} for x in counts or [None] * len(texts)]
    feats = [features(b, names, model.common | m if m else model.common, model.wording) for b, (_, names), m in zip(per, mails, more)]
    return [[x.no for b, q in zip(blocks, p) if q > 0.5 for x in b] for blocks, p in zip(per, model.probabilities(feats))]


def _lines_of(mails: DataFrame) -> DataFrame:
    """model_id, sender, line of every line that is more than three signs."""
    line = F.trim(F.regexp_replace("line", r"^(?:\s{0,2}[>|])+\s?", ""))
    rows = mails.select("model_id", F.lower(F.regexp_extract("plain_text", r"(?m)^From: *(.*)$", 1)).alias("sender"), F.explode_outer(F.split("plain_text", "\n")).alias("line"))
    return rows.withColumn("line", line).where(F.length("line") > 3)


def common_lines(mails: DataFrame) -> DataFrame:
    """line, mails, senders: the lines that several mails have."""
    counts = _lines_of(mails).groupBy("line").agg(F.count("*").alias("mails"), F.approx_count_distinct("sender", 0.1).alias("senders"))
    return counts.where(F.col("mails") >= LINE_MAILS)


@lru_cache(maxsize=2)
def _model(holder) -> Model:
    return holder.value


def mails_of(models: DataFrame) -> DataFrame:
    return models.where(F.lower("source_type").isin("eml", "msg") & F.col("plain_text").isNotNull())


_COUNTS = "array<struct<line:string,mails:bigint,senders:bigint>>"


def fit(mails: DataFrame, most: int = MOST_LINES) -> tuple[Model, DataFrame]:
    """The model, and the mails with ``counts``: their repeated lines beyond those that are broadcast."""
    top, rest = top_and_rest(common_lines(mails), "mails", most)
    common = {r["line"]: (r["mails"], r["senders"]) for r in top}
    sample = [r["plain_text"] for r in bounded_sample(mails, "model_id", FIT_MAILS)]
    if rest is None:
        return train(sample, common), mails.withColumn("counts", F.lit(None).cast(_COUNTS))
    asked = mails.sparkSession.createDataFrame([(x,) for x in sorted({x.text for t in sample for x in read_mail(t)[0]})] or [("",)], "line string")
    seen = common | {r["line"]: (r["mails"], r["senders"]) for r in rest.join(F.broadcast(asked), "line").collect()}  # at most the lines of the sample
    model = train(sample, seen)
    model.common = common
    own = _lines_of(mails).select("model_id", "line").join(rest, "line").groupBy("model_id").agg(F.collect_set(F.struct("line", "mails", "senders")).alias("counts"))
    return model, mails.join(own, "model_id", "left")


def _read(models: DataFrame, most: int, schema: str, rows) -> DataFrame:
    """``rows`` of (ids, texts, lines that are old) of each batch."""
    model, mails = fit(mails_of(models).select("model_id", "plain_text"), most)
    data = models.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for b in batches:
            for a in range(0, b.num_rows, 1_000):
                part = b.slice(a, 1_000)
                texts = part.column(1).to_pylist()
                yield rows(part.column(0), texts, old_lines(texts, model, part.column(2).to_pylist()))

    return mails.select("model_id", "plain_text", "counts").mapInArrow(run, schema)


def find_old_lines(models: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """model_id, line_no of every non-blank body line of a mail that its sender did not newly write.

    Mails without a blank line are all header and give nothing, as do null and empty ones. Repeated rows of a model
    count once. most: repeated lines that are broadcast; the result does not depend on it.
    """

    def rows(ids: pa.Array, _: list[str], found: list[list[int]]) -> pa.RecordBatch:
        each = [m for m, f in zip(ids.to_pylist(), found) for _ in f]
        return pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array([n for f in found for n in f], pa.int32())], names=["model_id", "line_no"])

    return _read(models, most, "model_id bigint, line_no int", rows).dropDuplicates()


def new_text(models: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """model_id, new_text: the body without the lines that the sender did not newly write."""

    def rows(ids: pa.Array, texts: list[str], found: list[list[int]]) -> pa.RecordBatch:
        out = []
        for t, drop in zip(texts, found):
            lines, gone = t.split("\n"), set(drop)
            start = next((i for i, r in enumerate(lines) if not r.strip()), len(lines))
            kept = "\n".join(r for i, r in enumerate(lines) if i > start and i not in gone)
            out.append(re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", kept).strip())
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["model_id", "new_text"])

    return _read(models, most, "model_id bigint, new_text string", rows).dropDuplicates(["model_id"])
