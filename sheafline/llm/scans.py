"""Noise in text from scanned pages (problem 4).

Method: running headers and footers are lines at the edges of pages that come again, nearly equal, on other pages of
their document, or whose form does so in enough documents of the corpus; page numbers are forms whose figure runs
with the pages. The remaining lines are joined, words broken at line ends put together where the corpus vocabulary
says so, and words that the vocabulary lacks are read back along the confusions of character recognition.

The vocabulary counts the words of all lines that were not recognised from images. Documents are rows (arrays of
lines) after one shuffle, so that every later step is narrow; words and forms are aggregated before they move. A bounded
part of the vocabulary and of the forms is broadcast; what a document asks beyond it comes to it by a join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import cut, top_and_rest

#: Lines at either edge of a page that may be furniture; least similarity of two forms; least share of the pages or documents.
EDGE, SIMILAR, SHARE = 4, 0.8, 0.5
#: Least documents of a form of furniture, and the forms and words that are broadcast (the commonest first; the others come by a join).
FORM_DOCS, MOST_FORMS, MOST_WORDS = 3, 20_000, 200_000
#: Least count of a word to be known, and to be believed in where a word is cut in two.
KNOWN, COMMON = 2, 20

HYPHENS = "-¬­‐"
_EDGES = "\"'()[]<>{}.,;:?*_/\\–—“”‘" + HYPHENS
#: Pieces that recognition confuses, wrong to right.
CONFUSED = (
    ("©", "e"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("$", "s"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("q", "g"), ("g", "q"), ("l", "i"), ("i", "l"), ("n", "u"), ("u", "n"), ("o", "c"), ("y", "v"), ("v", "y"), ("a", "o"), ("o", "a"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("nn", "m"), ("m", "nn"), ("in", "m"), ("m", "in"), ("iii", "m"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("fi", "ﬁ"),
)
_CLASS = str.maketrans({"©": "c", "e": "c", "@": "a", "!": "i", "|": "i", "l": "i", "1": "i", "0": "o", "5": "s", "$": "s", "6": "h", "8": "h", "b": "h", "9": "g", "q": "g", "f": "t", "ﬁ": "ti", "ﬂ": "ti"})
_WORDLIKE = re.compile(r"[^\W\d_]")
_SINGLES = re.compile(r"(?<![^\s])[^\W\d_](?: [^\W\d_]){2,}(?![^\s.,;:])|(?<![^\s])[^\W\d_]{2} [^\W\d_](?: [^\W\d_])+(?![^\s.,;:])")
_HYPHENS = frozenset(HYPHENS)
_BROKEN = re.compile(rf"[^\W\d_][{HYPHENS}]$")
_NO_WORD = re.compile(r"[A-Z]{1,3}[0-9]{1,4}[A-Z]{0,3}|[0-9]+(?:st|nd|rd|th|hrs|am|pm|km)|[A-Z][A-Z0-9]+[/-][A-Z0-9/-]+")
_PLATES = re.compile(r"\b[A-Z]{1,3}[0-9]{1,4} ?[A-Z]{0,3}\b|\b[A-Z]{3} [0-9]{1,3}[A-Z]?\b")
_MARKS = re.compile("#(?: ?#)+")
_ROMAN = re.compile(r"^[ivxlc]{1,7}$", re.I)


def skeleton(word: str) -> str:
    """A form that a word shares with its misreadings, several at once."""
    w = word.replace("vv", "w").replace("rn", "m").replace("iii", "m").replace("ii", "u").replace("cl", "d").replace("ri", "n")
    return w.translate(_CLASS)


@lru_cache(maxsize=200_000)
def form(text: str) -> str:
    """What stays of a line if figures, plates, references and misreadings are taken out of it."""
    t = text.strip()
    figures = any(map(str.isdigit, t))
    if figures:
        t = _PLATES.sub("#", t)
    if _ROMAN.match(t):
        return "#roman"
    words = t.lower().split()
    if figures:
        words = ["#" if (n := sum(map(str.isdigit, w))) and n * 2 > len(w.strip("()[].,-")) else w for w in words]
    bones = skeleton(" ".join(words))
    return _MARKS.sub("#", bones) if "#" in bones else bones


@lru_cache(maxsize=50_000)
def _places(a: str) -> dict[str, int]:
    """For each letter of ``a`` the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time in the bits of one number."""
    at, whole = _places(a), (1 << len(a)) - 1
    open_ = whole
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(a) - open_.bit_count()


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 0.25 * len(b) or len(b) <= 7:
        return False
    least = SIMILAR * (len(a) + len(b))
    # letters in common, and letters in common in order, bound the similarity and spare most comparisons
    return 2 * sum([min(a.count(c), b.count(c)) for c in set(b)]) >= least and 2 * in_order(a, b) >= least and SequenceMatcher(None, a, b, False).ratio() >= SIMILAR


class Document:
    """lines: (flat_pos, page, line, text), in order. forms: those of the edge lines if they are known already; weak: the repeated ones."""

    def __init__(self, lines: list[tuple[int, int, int, str]], forms: list[str] | None = None, weak: list[int] | None = None):
        self.lines, self.weak = lines, None if weak is None else set(weak)
        pages: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(lines):
            if x[3].strip():
                pages[x[1]].append(i)
        self.pages = [pages[p] for p in sorted(pages)]
        at = list(dict.fromkeys(i for p in self.pages for i in p[:EDGE] + p[-EDGE:]))
        self.edges: dict[int, str] = dict(zip(at, [form(lines[i][3]) for i in at] if forms is None else forms))

    def repeated(self) -> set[int]:
        """Edge lines whose form comes again at the same edge of enough other pages."""
        if self.weak is not None:
            return self.weak
        n = len(self.pages)
        if n < 2:
            return set()
        found: set[int] = set()
        for side in (lambda p: p[:EDGE], lambda p: p[-EDGE:]):
            groups: list[tuple[str, list[int], set[int]]] = []
            for k, p in enumerate(self.pages):
                for i in side(p):
                    f = self.edges[i]
                    for g in groups:
                        if g[0] == f or alike(g[0], f):
                            g[1].append(i)
                            g[2].add(k)
                            break
                    else:
                        groups.append((f, [i], {k}))
            for _, at, on in groups:
                if len(on) >= 2 and len(on) >= SHARE * n:
                    found.update(at)
        return found


    def running(self) -> set[int]:
        """What the figures of bare page numbers are ahead of their pages, where that is the same on at least two and half of the pages."""
        ahead: dict[int, set[int]] = defaultdict(set)
        for p in self.pages:
            for i in p[:EDGE] + p[-EDGE:]:
                n = _figure(self.lines[i][3]) if self.edges[i] == "#" else None
                if n is not None:
                    ahead[n - self.lines[i][1]].add(self.lines[i][1])
        return {d for d, on in ahead.items() if len(on) >= 2 and len(on) >= SHARE * len(self.pages)}


class Reader:
    """What is known of the corpus: counts of clean words and forms of furniture.

    own: what a document was given beyond them, by question: ("word", w) -> count, ("bone", k) -> word, ("form", f) -> 1; with ``asks``
    the questions that they leave open are noted in ``asked``.
    """

    def __init__(self, words: dict[str, int], forms: set[str], bones: dict[str, str] | None = None, own: dict[tuple[str, str], object] | None = None, asks: bool = False):
        self.words, self.forms, self.own = words, forms, own or {}
        self.asked: set[tuple[str, str]] | None = set() if asks else None
        self.bones = bones_of(words) if bones is None else bones
        self.cache: dict[str, str | None] = {}
        self.fine: set[str] = set()  # tokens as they stand that need no look

    def _beyond(self, kind: str, key: str, default):
        if self.asked is not None:
            self.asked.add((kind, key))
        return self.own.get((kind, key), default)

    def count(self, w: str) -> int:
        n = self.words.get(w, 0)
        return n or (self._beyond("word", w, 0) if self.own or self.asked is not None else 0)

    def bone(self, k: str) -> str:
        w = self.bones.get(k, "")
        return w or (self._beyond("bone", k, "") if self.own or self.asked is not None else "")

    def of_furniture(self, f: str) -> bool:
        return f in self.forms or bool((self.own or self.asked is not None) and self._beyond("form", f, 0))

    def known(self, w: str) -> bool:
        return self.count(w) >= KNOWN

    def reading(self, word: str) -> str | None:
        """The known word that an unknown one misreads, if any. Lower case in and out."""
        if word not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[word] = self._reading(word)
        return self.cache[word]

    def _reading(self, w: str) -> str | None:
        if self.known(w) or not _WORDLIKE.search(w) or len(w) < 2:
            return None
        strange = sum(not (c.isalpha() or c in "'’-") for c in w)
        if strange > 3 or (strange and strange * 2 > len(w)):
            return None
        hit = self.bone(skeleton(w))
        if hit and hit != w and (len(w) > 3 or self.count(hit) >= COMMON):
            return hit
        best = None
        for wrong, right in CONFUSED:
            at = w.find(wrong)
            while at >= 0:
                c = w[:at] + right + w[at + len(wrong) :]
                c = c if self.known(c) else self.bone(skeleton(c))
                if c and c != w and self.count(c) > (self.count(best) if best else 0):
                    best = c
                at = w.find(wrong, at + 1)
        if best and (len(w) > 3 or self.count(best) >= COMMON):
            return best
        if len(w) >= 6 and not strange:  # one character lost or added
            for i in range(len(w)):
                c = w[:i] + w[i + 1 :]
                if self.count(c) >= COMMON:
                    return c
            for i in range(len(w) + 1):
                for x in "etaoinsrhldcumfpgwybvk":
                    c = w[:i] + x + w[i:]
                    if self.count(c) >= COMMON:
                        return c
        return None

    def furniture(self, doc: Document) -> set[int]:
        """Edge lines of a form of the corpus, and repeated ones with nothing but furniture between them and the edge of their page."""
        weak, running = doc.repeated(), doc.running()
        found: set[int] = set()
        for k, p in enumerate(doc.pages):
            for side in (p[:EDGE], p[::-1][:EDGE]):
                enclosed = True
                for i in side:
                    f, line = doc.edges[i], doc.lines[i][3]
                    if f == "#":
                        hit = enclosed and (_page_number(line, doc.lines[i][1] + 1, k + 1) or (_figure(line) is not None and _figure(line) - doc.lines[i][1] in running))
                    else:
                        hit = self.of_furniture(f) or (enclosed and i in weak)
                    if hit:
                        found.add(i)
                    enclosed &= hit
        return found

    def judge(self, doc: Document) -> tuple[list[tuple[int, str]], str]:
        """((flat_pos, defect) of each line, the text repaired into paragraphs)."""
        out = set()
        bad = self.furniture(doc)
        for i in bad:
            out.add((doc.lines[i][0], "furniture"))
        text = [x for i, x in enumerate(doc.lines) if i not in bad and x[3].strip()]
        parts: list[str] = []
        carried = ""  # the first half of a broken word
        for k, (pos, _, _, line) in enumerate(text):
            nxt = text[k + 1][3] if k + 1 < len(text) else ""
            tokens = line.split()
            fixed: list[str] = []
            wrong = False
            head = carried
            carried = ""
            last = tokens[-1] if tokens else ""
            broken = last[-1:] in _HYPHENS and bool(_BROKEN.search(last)) and bool(nxt.split())
            if broken:
                a, b = last.rstrip(HYPHENS), nxt.split()[0]
                whole, tied = _core(a + b), _core(a + "-" + b)
                broken = b[:1].islower() or self.known(whole) or self.known(tied) or self.reading(whole) is not None
            for t, w in enumerate(tokens):
                if t == 0 and head:
                    whole = _core(head + w)
                    real = whole if self.known(whole) or self.known(_core(head + "-" + w)) else self.reading(whole)
                    if real and real != whole:
                        if not real.endswith(_core(w)):
                            wrong = True
                        if not real.startswith(_core(head)):
                            out.add((text[k - 1][0], "misread"))
                        fixed.append(real)
                    else:
                        fixed.append(head + ("-" if not self.known(whole) and self.known(_core(head + "-" + w)) else "") + w)
                    continue
                if broken and t == len(tokens) - 1:
                    carried = last.rstrip(HYPHENS)
                    continue
                if w in self.fine:
                    fixed.append(w)
                    continue
                core = w.strip(_EDGES)
                low = core.lower()
                if self.known(low) or _skip(core):
                    if len(self.fine) < 300_000:
                        self.fine.add(w)
                else:
                    real = self.reading(low)
                    if real is None and t + 1 < len(tokens):
                        pair = low + tokens[t + 1].strip(_EDGES).lower()
                        if len(pair) >= 5 and core.isalpha() and core.islower() and self.count(pair) >= COMMON:
                            real = low
                            wrong = True
                    if real is None and core.islower() and core.isalpha() and len(core) >= 6 and any(self.count(low[:j]) >= 5 * COMMON and self.count(low[j:]) >= 5 * COMMON for j in range(2, len(low) - 1)):
                        wrong = True
                    if real is not None:
                        wrong = True
                        w = w.replace(core, _cased(real, core))
                fixed.append(w)
            if broken:
                out.add((pos, "hyphenated"))
            if _SINGLES.search(line) and self.spaced(line):
                wrong = True
            if wrong:
                out.add((pos, "misread"))
            parts.append(" ".join(fixed))
            if line.rstrip().endswith((".", ":", "!", "?")) and not carried:
                parts.append("\n")
        body = re.sub(r" *\n *", "\n", " ".join(p for p in parts if p))
        return sorted(out), body.strip()

    def spaced(self, line: str) -> bool:
        """A word set with blanks between its letters."""
        for m in _SINGLES.finditer(line):
            run = m.group().split()
            if len(run) >= 3 and any(self.known(w) or self.reading(w) for w in ("".join(run).lower(), "".join(run[1:]).lower()) if len(w) > 2):
                return True
            if sum(len(x) == 1 and x.islower() for x in run) >= 3:
                return True
        return False


def _figure(line: str) -> int | None:
    """The figure that a short line of figures begins with."""
    m = re.match(r"\D*(\d{1,4})", line.translate(str.maketrans("lIOo|", "11001")))
    return int(m[1]) if m and len(line.strip()) <= 12 else None


def _page_number(line: str, *numbers: int) -> bool:
    """A line of figures that begins with the number of its page."""
    return _figure(line) in numbers


def bones_of(words: dict[str, int]) -> dict[str, str]:
    """skeleton -> the commonest known word that has it (the first by letters of equally common ones)."""
    bones: dict[str, str] = {}
    for w, n in words.items():
        if n >= KNOWN and len(w) > 1:
            k = skeleton(w)
            if k not in bones or (-n, w) < (-words[bones[k]], bones[k]):
                bones[k] = w
    return bones


def _core(word: str) -> str:
    return word.strip(_EDGES).lower()


def _cased(real: str, like: str) -> str:
    return real.upper() if like.isupper() and len(like) > 1 else real.capitalize() if like[:1].isupper() else real


def _skip(core: str) -> bool:
    """Tokens that are no words: figures, plates, references, mail and web addresses."""
    digits = sum(map(str.isdigit, core))
    return (
        not core or ("@" in core and "." in core.partition("@")[2]) or "://" in core or digits > 2 or digits * 2 >= len(core)
        or (core.isupper() and len(core) <= 3) or bool(_NO_WORD.fullmatch(core)) or core[:1] in "+£#"
    )


def documents_of(lines: DataFrame) -> DataFrame:
    """model_id, lines: the distinct lines of each recognised document, in order. Null texts count as empty."""
    row = F.struct("flat_pos", "page_index", "line_index", F.coalesce("text", F.lit("")).alias("text"))
    per = lines.where(~F.coalesce(F.col("confidence") >= 1, F.lit(False))).groupBy("model_id").agg(F.array_sort(F.collect_set(row)).alias("lines"), F.min("confidence").alias("least"))
    return per.where(F.col("least") < 1).drop("least")


def vocabulary(lines: DataFrame) -> DataFrame:
    """word, n of the words in lines that were not recognised from images."""
    edge = re.escape(_EDGES).replace("/", r"\/")
    word = F.regexp_replace("word", f"^[{edge}]+|[{edge}]+$", "")
    counts = lines.where(F.col("confidence") >= 1).select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).select(word.alias("word")).where(F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*$")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= KNOWN)


def _rows(lines: pa.ListArray) -> list[list[tuple[int, int, int, str]]]:
    """(flat_pos, page_index, line_index, text) of the lines of each document, read column by column."""
    every = list(zip(*(c.to_pylist() for c in lines.flatten().flatten())))
    out, at = [], 0
    for n in lines.value_lengths().to_pylist():
        out.append(every[at : at + (n or 0)])
        at += n or 0
    return out


def with_forms(docs: DataFrame) -> DataFrame:
    """``docs`` with edges (forms of the edge lines), weak (numbers of the repeated ones) and, of documents of several pages, seen and repeated (distinct forms)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [Document(lines) for lines in _rows(b.column(1))]
            weak = [d.repeated() for d in read]
            many = [len(d.pages) > 1 for d in read]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([list(d.edges.values()) for d in read], strings), pa.array([sorted(w) for w in weak], pa.list_(pa.int32())),
                pa.array([sorted(set(d.edges.values())) if m else [] for d, m in zip(read, many)], strings), pa.array([sorted({d.edges[i] for i in w}) if m else [] for d, w, m in zip(read, weak, many)], strings),
            ], names=["model_id", "lines", "edges", "weak", "seen", "repeated"])

    kind = dict(docs.dtypes)["lines"]
    return docs.select("model_id", "lines").mapInArrow(run, f"model_id bigint, lines {kind}, edges array<string>, weak array<int>, seen array<string>, repeated array<string>")


def furniture_forms(docs: DataFrame) -> DataFrame:
    """form, seen, local: in how many documents of several pages a form stands at an edge, and in how many it is repeated there."""
    each = lambda c: docs.select(F.explode_outer(c).alias("form"), (F.lit(c) == "repeated").cast("bigint").alias("local"))
    return each("seen").unionByName(each("repeated")).where("form is not null").groupBy("form").agg(F.sum(1 - F.col("local")).alias("seen"), F.sum("local").alias("local"))


def _answers(words: DataFrame | None, forms: DataFrame | None) -> DataFrame:
    """kind, key, answer, n: all that may be asked beyond what is broadcast."""
    session = (words if words is not None else forms).sparkSession
    out = session.createDataFrame([], "kind string, key string, answer string, n bigint")
    if forms is not None:
        out = out.unionByName(forms.select(F.lit("form").alias("kind"), F.col("form").alias("key"), F.lit("1").alias("answer"), F.lit(1).cast("bigint").alias("n")))
    if words is not None:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string())], names=["word", "n", "bone"])

        w = words.select("word", "n").mapInArrow(run, "word string, n bigint, bone string")
        best = w.where(F.length("word") > 1).groupBy("bone").agg(F.min(F.struct((-F.col("n")).alias("least"), "word")).alias("x"))
        out = out.unionByName(w.select(F.lit("word").alias("kind"), F.col("word").alias("key"), F.lit(None).cast("string").alias("answer"), "n"))
        out = out.unionByName(best.select(F.lit("bone").alias("kind"), F.col("bone").alias("key"), F.col("x.word").alias("answer"), F.lit(1).cast("bigint").alias("n")))
    return cut(out)


_OWN = "array<struct<kind:string,key:string,answer:string,n:bigint>>"


def _given(rows: list[dict] | None) -> dict[tuple[str, str], object]:
    return {(x["kind"], x["key"]): x["n"] if x["kind"] == "word" else x["answer"] for x in rows or ()}


def with_answers(docs: DataFrame, data, answers: DataFrame) -> DataFrame:
    """``docs`` with ``own``: the answers to what each asks beyond the broadcast part. An answer may lead to further questions, so this goes on until none has an answer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forms, bones = data.value
        for b in batches:
            for m, rows, edges, weak, own in zip(b.column(0).to_pylist(), _rows(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4))):
                given = _given(own)
                reader = Reader(words, forms, bones, given, asks=True)
                reader.judge(Document(rows, edges, weak))
                open_ = sorted(reader.asked - given.keys())
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(open_), pa.int64()), pa.array([k for k, _ in open_], pa.string()), pa.array([k for _, k in open_], pa.string())], names=["model_id", "kind", "key"])

    docs = docs.withColumn("own", F.lit(None).cast(_OWN))
    while True:
        asked = docs.select("model_id", "lines", "edges", "weak", "own").mapInArrow(run, "model_id bigint, kind string, key string")
        new = cut(asked.join(answers, ["kind", "key"]).groupBy("model_id").agg(F.collect_set(F.struct("kind", "key", "answer", "n")).alias("_new")))
        if new.isEmpty():
            return docs
        docs = cut(docs.join(new, "model_id", "left").withColumn("own", F.concat(F.coalesce("own", F.array().cast(_OWN)), F.coalesce("_new", F.array().cast(_OWN)))).drop("_new"))


@lru_cache(maxsize=2)
def _reader(holder) -> Reader:
    return Reader(*holder.value)


def repair_scans(lines: DataFrame, texts: bool = False, most_words: int = MOST_WORDS, most_forms: int = MOST_FORMS) -> DataFrame:
    """model_id, flat_pos, defect of every defect of the recognised documents; with ``texts`` instead model_id, text: the repaired paragraphs.

    A document is recognised from images if some confidence in it is below 1. Repeated rows count once. Documents
    without any confidence are left alone. most_words, most_forms: what is broadcast; the result does not depend on it.
    """
    docs = cut(with_forms(documents_of(lines)))
    sc = lines.sparkSession.sparkContext
    top, more_words = top_and_rest(vocabulary(lines), "n", most_words)
    words = {r["word"]: r["n"] for r in top}
    good, more_forms = top_and_rest(furniture_forms(docs).where((F.col("local") >= FORM_DOCS) & (F.col("local") >= SHARE * F.col("seen"))), "local", most_forms)
    data = sc.broadcast((words, {r["form"] for r in good}, bones_of(words)))
    if more_words is None and more_forms is None:
        docs = docs.withColumn("own", F.lit(None).cast(_OWN))
    else:
        docs = with_answers(docs, data, _answers(more_words, more_forms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(data)
        for b in batches:
            ids, pos, kinds, bodies = [], [], [], []
            for m, rows, edges, weak, own in zip(b.column(0).to_pylist(), _rows(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4))):
                by = Reader(reader.words, reader.forms, reader.bones, _given(own)) if own else reader
                found, body = by.judge(Document(rows, edges, weak))
                if texts:
                    ids.append(m)
                    bodies.append(body)
                else:
                    ids += [m] * len(found)
                    pos += [f[0] for f in found]
                    kinds += [f[1] for f in found]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], names=["model_id", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(kinds, pa.string())], names=["model_id", "flat_pos", "defect"])

    return docs.select("model_id", "lines", "edges", "weak", "own").mapInArrow(run, "model_id bigint, text string" if texts else "model_id bigint, flat_pos int, defect string")
