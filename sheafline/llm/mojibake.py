"""Garbled text from wrong character encodings (problem 6).

Method: minimum description length. Each window around characters outside ASCII is re-encoded and decoded along every
chain of wrong decodings that its characters allow; every candidate is compressed with the zstandard dictionary
of each language, and the chain with the fewest bits, its own cost included, wins. Without a gain the window stays.

Windows are judged apart, since one text may quote another one that went through other programs. A window is the
word that holds the characters, digits made equal, with the word before it if it has hardly any letters itself. There
are few different ones, so that each worker compresses each of them once and looks it up afterwards.

The dictionaries hold the most frequent words of each language and the most frequent windows of the corpus, counted over
all of it, without those that a chain turns into a more frequent one. Windows beyond the bound of the dictionaries are joined
to the windows that they or a decoding of them equal, and those are judged once with them as known words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafline.session import cut, top_and_rest

#: Single byte encodings that programs took UTF-8 for, and pairs of them (was read as, really is).
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254")
SWAPPED = (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1252", "cp1250"))
#: Bits that a step of a chain costs.
UTF8_BITS, SWAP_BITS, DEPTH = 6, 11, 3
#: Bytes of each dictionary that stand before a window when it is compressed.
LEAD_BYTES = 240
#: Bounds of the dictionaries: bytes of words a language, windows of the corpus.
TEXT_BYTES, TOP_WINDOWS = 24_000, 6_000
#: Two bytes for every character, so that a letter is not cheap for being early in the code table.
COMPRESSED_AS = "utf-16-le"
#: Windows kept with their verdicts per worker.
CACHE_SIZE = 100_000

_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_EDGE = "\"'()[]<>{}.,;:!?*_|/\\-"


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[dict[int, int], list[str]]:
    """Character to byte and byte to character; a byte without a character stands for the control character of its number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    to_byte = {ord(c): b for b, c in enumerate(chars)}
    if codec != "latin-1":
        for b in range(0x80, 0xA0):
            to_byte.setdefault(b, b)
    return to_byte, chars


def _encode(text: str, codec: str) -> bytes | None:
    table = _tables(codec)[0]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def candidates(text: str, depth: int = DEPTH) -> dict[str, int]:
    """The decodings of ``text`` that some chain gives, with the bits of the cheapest chain."""
    found: dict[str, int] = {}
    todo = [(text, 0)]
    for level in range(depth):
        nxt = []
        for t, bits in todo:
            for codec in READ_AS:
                raw = _encode(t, codec)
                if raw is None or raw.isascii():
                    continue
                try:
                    new = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                cost = bits + UTF8_BITS
                if new != text and cost < found.get(new, 1 << 30):
                    found[new] = cost
                    if not new.isascii():
                        nxt.append((new, cost))
        todo = nxt
    for read, real in SWAPPED:
        raw = _encode(text, read)
        if raw is not None:
            new = "".join(_tables(real)[1][b] for b in raw)
            if new != text and not any(0x7F <= ord(c) < 0xA0 for c in new):
                found.setdefault(new, SWAP_BITS)
    return found


def window(before: str | None, word: str) -> tuple[str, str, str]:
    """(left context, core, core with digits made equal) of a word."""
    core = word.strip(_EDGE) or word
    letters = sum(c.isascii() and c.isalpha() for c in core)
    left = re.sub("[0-9]", "0", (before or "").strip(_EDGE)) if letters < 2 else ""
    return left, core, re.sub("[0-9]", "0", core)


def name(left: str, core: str) -> str:
    return f"{left} {core}" if left else core


def windows_in(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(where the core begins, left context, core, core with digits made equal) of each window."""
    for m in _WORD.finditer(text):
        word = m.group()
        a = text.rfind(" ", 0, max(m.start() - 1, 0)) + 1
        before = text[a : m.start() - 1].rpartition("\n")[2] if m.start() and text[m.start() - 1] == " " else None
        left, core, flat = window(before[-24:] if before else None, word)
        yield m.start() + word.find(core), left, core, flat


class Judge:
    """restore(window) gives the winning decoding, None where the window stays."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard as z

        self.compressors = [
            z.ZstdCompressor(level=19, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in dictionaries if d
        ] or [z.ZstdCompressor(level=19, write_checksum=False, write_content_size=False)]
        # zstandard stores a block as it is unless it gains some bytes, so a short window alone would cost the same
        # whether it stands in the dictionary or not; behind a known beginning its own cost shows
        self.lead = [d[:LEAD_BYTES] for d in dictionaries if d] or [b"the " * 40]
        self.known: dict[tuple[str, str], str | None] = {}

    def bits(self, text: str, own: tuple = ()) -> int:
        data = text.encode(COMPRESSED_AS, "surrogatepass")
        return 8 * min(len(c.compress(lead + data)) for c, lead in [*zip(self.compressors, self.lead), *own])

    def judge_with(self, left: str, core: str, more: list[str]) -> str | None:
        """As ``restore``, with the windows ``more`` as if they stood in the dictionaries."""
        import zstandard as z

        lead = self.lead[-1]
        d = z.ZstdCompressionDict(lead + f" {' '.join(more)} ".encode(COMPRESSED_AS, "surrogatepass"), dict_type=z.DICT_TYPE_RAWCONTENT)
        c = z.ZstdCompressor(level=19, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return self._judge(left, core, ((c, lead),))

    def restore(self, left: str, core: str) -> str | None:
        key = (left, core)
        if key not in self.known:
            if len(self.known) >= CACHE_SIZE:
                self.known.clear()
            self.known[key] = self._judge(left, core)
        return self.known[key]

    def _judge(self, left: str, core: str, own: tuple = ()) -> str | None:
        found = candidates(core)
        if not found:
            return None
        frame = lambda t: f" {left} {t} " if left else f" {t} "
        best, least = None, self.bits(frame(core), own)
        for new, chain in sorted(found.items(), key=lambda x: (x[1], x[0])):
            n = self.bits(frame(new), own) + chain
            if n < least:
                best, least = new, n
        return best

    def repair(self, text: str, known: dict[str, str | None] | None = None) -> tuple[bool, str]:
        """(has a garbled sequence, the text restored as far as can be); ``known``: verdicts by name of the window."""
        if text.isascii():
            return False, text
        bad, out, end, known = "�" in text, [], 0, known or {}
        for at, left, core, flat in windows_in(text):
            key = name(left, flat)
            new = known[key] if key in known else self.restore(left, flat)
            if new is not None:
                bad = True
                digits = iter(re.findall("[0-9]", core))
                out += [text[end:at], re.sub("0", lambda z: next(digits, "0"), new)]
                end = at + len(core)
        return bad, "".join([*out, text[end:]]) if out else text


class Dictionaries(list):
    """The dictionaries, and ``beyond``: the clean windows (w) of the corpus that do not fit in; None if all do."""

    def __init__(self, items: list[bytes], beyond: DataFrame | None = None):
        super().__init__(items)
        self.beyond = beyond


def _windows(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, w, n: the windows of each text; without ``keys`` counted a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *ids, values = (c.to_pylist() for c in b.columns)
            found = Counter((*k, name(left, flat)) for *k, t in zip(*ids, values) for _, left, _, flat in windows_in(t))
            cols = [[k[i] for k in found] for i in range(len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(found.values()), pa.int64())], names=[*keys, "w", "n"])

    schema = ", ".join([*(f"{k} string" for k in keys), "w string", "n bigint"])
    return texts.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(*keys, text).mapInArrow(run, schema)


def _decodings(windows: DataFrame) -> DataFrame:
    """w, new, sure: what the chains make of each window; ``sure`` if it is valid as UTF-8 read wrongly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w in b.column(0).to_pylist():
                left, _, core = w.rpartition(" ")
                rows += [(w, name(left, new), bits % UTF8_BITS == 0) for new, bits in candidates(core).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["w", "new", "sure"])

    return windows.select("w").mapInArrow(run, "w string, new string, sure boolean")


def _clean(counts: DataFrame) -> DataFrame:
    """The windows (w, n) without those that some chain turns into a more frequent one or that are valid as UTF-8 read wrongly."""
    fit = counts.where(~F.col("w").rlike("[\ufffd\x80-\x9f]"))
    rivals = counts.select(F.col("w").alias("new"), F.col("n").alias("m"))
    worse = _decodings(fit).join(rivals, "new", "left").join(fit, "w").where(F.col("sure") | (F.col("m") >= F.col("n"))).select("w").distinct()
    return fit.join(worse, "w", "left_anti")


def _words(documents: DataFrame) -> DataFrame:
    """lang, w, n: the words of all documents of a language, digits made equal."""
    flat = F.translate("text", "123456789", "0" * 9)
    raw = documents.where(F.col("lang").isNotNull() & (F.col("lang") != "und")).select("lang", F.explode(F.split(flat, "[ \t\r\n]+")).alias("w")).groupBy("lang", "w").count()
    edge = re.escape(_EDGE)
    core = F.regexp_replace("w", f"^[{edge}]+|[{edge}]+$", "")
    return raw.withColumn("w", core).where(F.col("w") != "").groupBy("lang", "w").agg(F.sum("count").alias("n"))


def _language_dictionaries(words: DataFrame) -> list[bytes]:
    """The most frequent words of each language, the most frequent last; of those that tie at the bound as many, by hash, as fit."""
    size = 2 * (F.length("w") + 1)
    steps = words.groupBy("lang", "n").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy(F.desc("n"))) - F.col("bytes")
    steps = steps.withColumn("before", before).where(F.col("before") < TEXT_BYTES)
    steps = steps.select("lang", "n", ((F.lit(TEXT_BYTES) - F.col("before")) / F.col("bytes") * (1 << 20)).alias("part"))
    picked = words.join(F.broadcast(steps), ["lang", "n"]).where(F.pmod(F.xxhash64("w"), F.lit(1 << 20)) <= F.col("part"))  # counts above the bound, not words
    by_lang: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["n"], r["w"])):  # about TEXT_BYTES a language
        by_lang.setdefault(r["lang"], []).append(r["w"])
    return [f" {' '.join(w)} ".encode(COMPRESSED_AS, "surrogatepass")[-TEXT_BYTES:] for w in by_lang.values()]


def dictionaries(documents: DataFrame, texts: DataFrame, text: str = "text", top: int = TOP_WINDOWS) -> Dictionaries:
    """One zstandard dictionary a language of ``documents`` (lang, text), and one of the windows of ``texts`` and the words outside ASCII of ``documents``."""
    outside = F.col("w").rlike("[^\\x00-\\x7f]")
    words = cut(_words(documents))
    counts = _windows(texts, text).unionByName(words.where(outside).select("w", "n"))
    clean = cut(_clean(cut(counts.groupBy("w").agg(F.sum("n").alias("n")))))
    by_lang = _language_dictionaries(words.where(~outside).unionByName(words.join(clean.select("w"), "w", "left_semi").select("lang", "w", "n")))
    first, rest = top_and_rest(clean, "n", top)
    first = sorted(first, key=lambda r: (r["n"], r["w"]))
    windows = [r["w"] for r in first]
    cases = [v for w in windows for v in (w.upper(), w.lower()) if " " not in w and v != w]
    of_corpus = f" {' '.join(cases)} {' '.join(windows)} ".encode(COMPRESSED_AS, "surrogatepass") if windows else b""
    return Dictionaries([*by_lang, of_corpus], None if rest is None else rest.select("w"))


def _verdicts(windows: DataFrame, dicts: Dictionaries, data) -> DataFrame:
    """w, new of the windows that are judged otherwise (null: stays) once the windows beyond the dictionaries are known."""
    one = ~F.col("w").contains(" ")
    forms = F.array("w", F.when(one, F.upper("w")).otherwise(F.col("w")), F.when(one, F.lower("w")).otherwise(F.col("w")))
    known = dicts.beyond.select(F.explode(forms).alias("new")).distinct()
    asked = windows.select("w").distinct()
    pairs = _decodings(asked).select("w", "new").unionByName(asked.select("w", F.col("w").alias("new")))
    more = pairs.join(known, "new").groupBy("w").agg(F.sort_array(F.collect_set("new")).alias("more"))  # at most the decodings of one window

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge_of(tuple(data.value))
        for b in batches:
            rows = []
            for w, extra in zip(*(c.to_pylist() for c in b.columns)):
                left, _, core = w.rpartition(" ")
                new = judge.judge_with(left, core, extra)
                if new != judge.restore(left, core):
                    rows.append((w, new))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["w", "new"])

    return more.mapInArrow(run, "w string, new string")


def find_garbled(texts: DataFrame, keys: list[str], text: str, dicts: list[bytes], restored: bool = False) -> DataFrame:
    """The rows with at least one garbled sequence: ``keys`` (and ``restored``, the text with every sequence restored that can be).

    Null, empty and ASCII texts are never garbled and do not leave the JVM; a replacement character is garbled beyond
    restoring. Rows are judged one by one, so repeated rows come out repeated. No shuffle is needed unless the corpus has
    windows beyond the dictionaries; then the verdicts that they change are joined to the texts.
    """
    data = texts.sparkSession.sparkContext.broadcast(list(dicts))  # bounded by the parameters above
    src = texts.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(*keys, F.col(text).alias("_text"))
    kinds = dict(src.dtypes)
    extra = getattr(dicts, "beyond", None) is not None
    if extra:
        src = src.withColumn("_key", F.sha2("_text", 256))
        found = cut(_windows(src, "_text", "_key").select("_key", "w").distinct())
        changed = found.join(_verdicts(found, dicts, data), "w").groupBy("_key").agg(F.collect_list(F.struct("w", "new")).alias("_known"))
        src = src.join(changed, "_key", "left").select(*keys, "_text", "_known")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge_of(tuple(data.value))
        for b in batches:
            known = b.column(len(keys) + 1).to_pylist() if extra else [None] * b.num_rows
            got = [judge.repair(t, {x["w"]: x["new"] for x in k or ()}) for t, k in zip(b.column(len(keys)).to_pylist(), known)]
            keep = pa.array([g[0] for g in got], pa.bool_())
            cols = [c.filter(keep) for c in b.columns[: len(keys)]]
            if restored:
                cols.append(pa.array([g[1] for g in got if g[0]], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *(["restored"] * restored)])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", restored string" if restored else "")
    return src.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _judge_of(dicts: tuple[bytes, ...]) -> Judge:
    return Judge(list(dicts))


def all_texts(models: DataFrame, lines: DataFrame) -> DataFrame:
    """model_id, flat_pos (-1: the whole plain text), text."""
    whole = models.select("model_id", F.lit(-1).alias("flat_pos"), F.col("plain_text").alias("text"))
    return whole.unionByName(lines.select("model_id", "flat_pos", "text"))


def garbled_rows(models: DataFrame, lines: DataFrame, documents: DataFrame, restored: bool = False) -> DataFrame:
    """model_id, flat_pos of every garbled plain text (-1) and line, each once."""
    texts = all_texts(models, lines)
    dicts = dictionaries(documents, lines.select("text").unionByName(models.select(F.col("plain_text").alias("text"))))
    return find_garbled(texts, ["model_id", "flat_pos"], "text", dicts, restored).dropDuplicates(["model_id", "flat_pos"])
