"""Personal information inside free text (problem 5).

Method: a semi-Markov conditional random field. A text is cut into tokens; runs of tokens that may belong to personal data
(chunks) become lattices whose arcs are all admissible spans of every kind, each with features of the whole span: its
pattern of classes, its parts, the shape of its figures, the share of its words in the lexicons of the corpus, what stands
on either side. Dynamic programming over the lattice chooses boundaries and kinds together; ordinary text costs nothing. The
weights maximise the likelihood of labelled chunks (partition function by the forward pass, expectations by the backward
pass) over a bounded sample of texts, which ``pii_labels`` labels, since no labelled texts exist.

Features see only classes of tokens, so a chunk's best segmentation depends on nothing but its string of classes and is worked
out once for all chunks that share it. The lexicons are counted over the whole corpus from labelled places in it and
from the fixtures; a bounded part is broadcast, the entries beyond it reach the texts that hold them by a join.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm import pii_labels as L
from sheafline.session import bounded_sample, top_and_rest

#: Texts of the fit (the first by a hash of their id), entries of a lexicon that are broadcast.
FIT_TEXTS, MOST_WORDS = 800, 200_000
#: Longest spans of each kind in tokens: the bound of the bounded-entity dynamic programming, not of texts or chunks.
LONGEST = {"NAME": 12, "EMAIL": 1, "PHONE": 11, "ID": 7, "ADDRESS": 60}
#: Chunks and tokens whose results a worker remembers; what is forgotten is worked out again.
REMEMBERED = 400_000
KINDS = tuple(LONGEST)

#: Private sign before the token of a mail address.
MAIL = "\ue000"
# a word may hold the signs that letters become in a wrong decoding, so all but these may stand in it
_W = r"[^\s\d_!-/:-@\[-`{-~“”‘’…–—·•]"
_TOKEN = re.compile(
    r" ?(?:[a-z]{2,}+(?=[ ,.;:\n)])"
    rf"|[^\W\d_](?!\. ?[^\W\d_]){_W}*+(?:['’-](?![sS]\b)[^\W\d_]{_W}*+)*+(?!\d)"
    r"|[A-Za-z]{1,2}\d[\dA-Za-z]? ?\d[A-Za-z]{2}(?![^\W_])|[^\W\d_]\.(?= ?[^\W\d_])|[^\W_]+|\S)|\n(?:[ \t]*[>|])*[ \t]*|[^\S\n]+"
)
_FORM = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a")})
_RUN = re.compile(r"[A-Za-z]+|\d+")
_POSTCODE = re.compile(r"[A-Za-z]{1,2}\d[\dA-Za-z]? ?\d[A-Za-z]{2}$")
#: Words beside personal data, by what they announce; words of one group are one class.
_GROUPS = {
    "name": "client insured name claimant re policyholder", "from": "from von de", "role": "handler witness driver", "hail": "dear hi hello morning",
    "tel": "tel telephone mobile mob phone t m ddi line ring call fax contact reached", "no": "no number", "ref": "ref reference claim card policy request subject betreff objet asunto file job instruction temat",
    "place": "address location garage inspect located inspection repairer bodyshop", "id": "passport licence license ni nino insurance driving", "bye": "regards sincerely faithfully wishes thanks kr",
}
_GROUP = {w: g for g, words in _GROUPS.items() for w in words.split()} | {w: w for w in ("is", "at", "on", "i", "to", "our", "your", "and")} | {w: "title" for w in L.TITLES}
_TELLING = frozenset({"place", "id"})
_LEADS = frozenset({"name", "from", "role", "hail", "title", "bye", "is", "to", "i"})

# coarse classes of tokens: first character of each range of code points
O, M, P, D = 0x1000, 0x4000, 0x5000, 0x6000
_IN = r"[\u4000-\u6fffcke]"  # words that may be parts (those of addresses apart), figures and mixed tokens, postcodes, mail addresses
_FIGURE, _PLACE = r"[\u6000-\u6fff]", r"\u5000-\u6fffck"
# a line end stands within a chunk only where an address may go on
_GLUE = rf"(?:[,;/.()+'#w-]{{1,3}}(?:\n(?:#\.?)?)?|(?<=[{_PLACE}u])\n(?:#\.?)?|\n(?=[{_PLACE}]))?"
_CHUNK = re.compile(rf"(?:{_IN}|[+(](?={_FIGURE})|#(?=w?\.?w?{_FIGURE}))(?:{_GLUE}{_IN}|[,;/]{{0,2}}\n?u(?=[,;/]{{0,2}}\n?{_IN})|[,;/]u(?=\n)|\.(?![,;/.()+'-]))*")


class Token:
    """What the features see of a token: its coarse class (``mark``), a name, and for words, figures and mixed tokens their parts."""

    __slots__ = ("mark", "name", "lex", "place", "case", "role", "shape", "digits", "lead", "known", "upper", "size", "begins", "short")

    def __init__(self, mark: str, name: str, lex: int = 0, place: str = "", case: str = "", role: str = "", shape: str = "", digits: int = 0, lead: str = "", known: bool = False, size: int = 0):
        self.mark, self.name, self.lex, self.place, self.case, self.role, self.shape, self.digits, self.lead, self.known = mark, name, lex, place, case, role, shape, digits, lead, known
        self.upper, self.size = case in ("U", "i"), size
        self.short = f"{lex}{place}{case}{role[:1]}" if mark == "m" else mark
        self.begins = shape[:1] == "A" or shape in ("N8", "N9")  # an identity number may begin here


class Coder(dict):
    """Token -> one character for its class. Classes get their characters as they come; ``tokens`` has what a character means."""

    def __init__(self, names: dict[str, int], places: dict[str, int], prefixes: dict[str, int]):
        super().__init__()
        self.names, self.places, self.prefixes = names, places, prefixes
        self.tokens: dict[str, Token] = {}
        self.codes: dict[tuple, str] = {}
        self.used = {O: 0, M: 0, P: 0, D: 0}
        #: Outside a chunk words, figures and the rest count by their coarse class only.
        self.outside: dict[int, str] = {}
        self.leads: set[str] = set()
        self.written: dict[int, str] = {}
        self.forms: dict[tuple, str] = {}
        self.house = self.figures("1")
        self.read("\n")
        for c in "md":
            self.tokens[c] = Token(c, c)

    def of(self, base: int | str, token: Token) -> str:
        key = (base, token.name)
        got = self.codes.get(key)
        if got is None:
            if isinstance(base, str):
                got = base
            else:
                # a range that is full shares its last character
                got = chr(base + self.used[base])
                self.used[base] = min(self.used[base] + 1, (0x2FFF if base == O else 0xFFF))
            self.codes[key] = got
            self.tokens[got] = token
            if token.name in _LEADS:
                self.leads.add(got)
            if token.mark in "mdu" or token.name == "word":
                self.outside[ord(got)] = "d" if token.mark == "d" else "m"
        return got

    def __missing__(self, raw: str) -> str:
        got = self.read(raw)
        if len(self) > REMEMBERED:
            self.clear()
        self[raw] = got
        return got

    def read(self, raw: str) -> str:
        w = raw.lstrip(" \t")
        if raw[:1] == "\n":
            return self.of("\n", Token("\n", "\n")) if not w.strip("\n \t") else self.of("q", Token("q", "quote"))
        if not w.strip():
            return self.of("w", Token("w", "wide"))
        if w.isalpha():
            return self.word(w, w.lower())
        if w[0] == MAIL and len(w) > 1:
            return self.of("e", Token("e", "mail"))
        low = w.lower().replace("’", "'")
        if not any(c.isalnum() for c in w):
            if w in ",;/.()+'-’" and not (w == "-" and raw != w):
                w = w.replace("’", "'")
                return self.of(w, Token(w, w))
            name = ":" if w in ":|" else "dash" if w in "-–—" else "sign"
            return self.of(O, Token("o", name))
        if _POSTCODE.match(w):
            # five signs may be the end of a licence number as well
            return self.of("k", Token("c", "code", shape="A1N2A2")) if len(w) == 5 and w[1:3].isdigit() else self.of("c", Token("c", "code", shape="X"))
        if any(c.isdigit() for c in w):
            return self.figures(w)
        return self.word(w, low)

    def figures(self, w: str) -> str:
        """Class of a token with figures in it; tokens of one form share it."""
        known = len(w) >= 5 and w[0] == "0" and w[1:5] in self.prefixes and w.isdigit()
        form = (w.translate(_FORM), known, w[:4] if w[:2] in ("44", "00") else w[0] == "0", w[-1] in "ABCDabcd", w[-1].isalpha() and "9" in w and bool(re.match(r"[A-Za-z]{2,4}9{1,3}\d{6}", w)) or bool(re.fullmatch(r"[A-Za-z]{2,4}9{1,3}", w)))
        got = self.forms.get(form)
        if got is None:
            if len(self.forms) > REMEMBERED:
                self.forms.clear()
            got = self.forms[form] = self.new_form(w, known, form[-1])
        return got

    def new_form(self, w: str, known: bool, nines: bool) -> str:
        runs = _RUN.findall(w)
        if sum(map(len, runs)) != len(w) or len(w) > 20:
            return self.of(D, Token("d", "odd", shape="X"))
        last = runs[-1]
        shape = "".join(("N" if r.isdigit() else "A") + str(len(r)) for r in runs)
        if not last.isdigit() and len(last) == 1:
            shape = shape[:-2] + ("C1" if last.upper() in "ABCD" else "B1")
        plain = w.isdigit()
        lead = "0044" if w.startswith("0044") else "44" if w.startswith("44") else "0" if w[0] == "0" else ""
        kind = "house" if re.fullmatch(r"\d{1,4}[A-Za-z]?", w) else "long" if plain else "mixed"
        return self.of(D, Token("d", f"{kind}:{shape}:{lead}:{known:d}:{nines:d}", shape=shape, digits=len(w) if plain else 0, lead=lead, known=known, case="9" if nines else "", role=kind))

    def word(self, w: str, low: str) -> str:
        base = low.rstrip("'.")
        flat = base.replace("'", "")
        n = self.names.get(base, 0)
        lex = min(1, n)
        place = "K" if flat in L._KINDS_OF_STREET else "U" if flat in L.UNIT_WORDS else "B" if flat in L.BUSINESS_WORDS else "p" if flat in self.places or base in self.places or flat in L._FIXED_PLACES else ""
        case = "i" if len(base) == 1 and w[0].isupper() else "U" if w.isupper() else "l" if w.islower() else "T" if w[0].isupper() else "x"
        role = "title" if base in L.TITLES else "firm" if base in L.FIRM_WORDS else "particle" if base in L.PARTICLES else ""
        group = _GROUP.get(base)
        label = group is not None and base not in L.PARTICLES and role != "firm"
        if case == "i" and (w != "I"):
            return self.of(P if place else M, Token("m", "A" if w == "A" else f"i{place}{w[1:]}", place=place, case="i", size=1))
        if base == "no":
            return self.of("#", Token("#", "no", place="p", case=case))
        if (role == "title" or base in L.STOP or (label and not lex)) and place in ("", "B") and not (place == "B" and case != "l"):
            return self.of(O, Token("o", group or "word"))
        if case == "l" and not lex and not place and role != "particle":
            return self.of(O, Token("o", group)) if group else self.of("u", Token("u", "word")) if len(w) > 2 else self.of(O, Token("o", "word"))
        name = f"{lex}{place or '-'}{case}{role[:1]}" + (":" + group if label else f":{len(w)}" if case == "U" and len(w) in (2, 5) and not lex and not place else "")
        got = self.of(P if place else M, Token("m", name, lex=lex, place=place, case=case, role=role, size=len(w)))
        if place and case != "T" and ord(got) not in self.written:
            self.written[ord(got)] = self.of(P, Token("m", f"{lex}{place}T{role[:1]}" + (":" + group if label else ""), lex=lex, place=place, case="T", role=role, size=0))
        return got


def mails_in(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, spelled-out ones too, in order."""
    out: list[tuple[int, int]] = []
    at = text.find("@")
    while at >= 0:
        line = text.rfind("\n", 0, at) + 1
        a = max(line - 1, *[text.rfind(c, line, at) for c in " \t<(:,;\""]) + 1
        stop = text.find("\n", at)
        m = next((m for m in L._EMAIL.finditer(text, a, len(text) if stop < 0 else stop) if m.end() > at), None)
        if m and m.start() < at:
            out.append((m.start(), m.end()))
        at = text.find("@", max(at + 1, out[-1][1] if out else 0))
    if "[at]" in text or "(at)" in text or "{at}" in text or " dot " in text:
        for m in re.finditer(r"[^\n]*(?:\[at\]|\(at\)|\{at\}| dot )[^\n]*", text):
            for x in L._SPELLED.finditer(text, m.start(), m.end()):
                if not any(a < x.end() and x.start() < b for a, b in out):
                    out.append((x.start(), x.end()))
        out.sort()
    return out


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, which put together are the text; a mail address is one token, marked by a private sign before it."""
    if "@" not in text and "[at]" not in text and "(at)" not in text and "{at}" not in text and " dot " not in text:
        return _TOKEN.findall(text)
    out: list[str] = []
    end = 0
    for a, b in mails_in(text):
        out += _TOKEN.findall(text[end:a])
        out.append(MAIL + text[a:b])
        end = b
    return out + _TOKEN.findall(text[end:])


def said(toks: list[str]) -> str:
    """The text of tokens."""
    return "".join([t[1:] if t[0] == MAIL and len(t) > 1 else t for t in toks])


_BEFORE, _AFTER = 4, 2
#: Signs beyond which the features look on.
_SOFT = frozenset("\n,;/.()+'-w") | {"quote", "wide", ":", "dash", "sign"}


def canonical(key: str, coder: Coder) -> str:
    """``key`` without what no feature sees: words beyond the nearest one unless they are labels, what follows a word, lengths of figures too few for a number, and in an address how its words are written."""
    before, inner, after = key.split("\0")
    t = coder.tokens
    left, seen = [], False
    for c in reversed(before):
        x = t[c]
        left.append("m" if seen and x.name not in _TELLING else c)
        seen = seen or x.name not in _SOFT
    addressed = any(t[c].mark == "c" or t[c].place == "K" for c in inner)
    if addressed or t[after[0]].name not in _SOFT:
        after = after[0] + "m"
    if addressed:  # the words of an address count alike however they are written
        inner = inner.translate(coder.written)
    else:  # without one, unknown words on a line of their own at the end cannot belong to what stands before
        cut = inner.rfind("\n")
        if cut > 0 and all(t[c].mark == "m" and not t[c].lex and not t[c].place for c in inner[cut + 1 :]):
            inner, after = inner[:cut], "\nm"
    # lengths of short figures matter only where a telephone or identity number may be made of them
    digits = sum(t[c].digits for c in inner)
    if digits < 9 and not any((t[c].role == "mixed" and t[c].begins) or (digits >= 4 and t[c].upper and t[c].size == 2) for c in inner):
        inner = "".join(coder.house if t[c].role == "house" else c for c in inner)
    return f"{''.join(reversed(left))}\0{inner}\0{after}"


def coded(toks: list[str], coder: Coder) -> str:
    """The classes of the tokens, with ``_BEFORE`` line ends before and ``_AFTER`` behind them."""
    return "\n\n\n\n" + "".join(map(coder.__getitem__, toks)) + "\n\n"


def chunks_of(toks: list[str], coder: Coder) -> Iterator[tuple[str, int, int]]:
    """(key, first, end) of each chunk; the key holds the classes of the tokens before, in and after it."""
    codes = coded(toks, coder)
    for m in _CHUNK.finditer(codes):
        a, b = m.span()
        yield f"{codes[a - _BEFORE:a].translate(coder.outside)}\0{codes[a:b]}\0{codes[b:b + _AFTER].translate(coder.outside)}", a - _BEFORE, b - _BEFORE


@lru_cache(maxsize=REMEMBERED)
def features(part: tuple) -> tuple[str, ...]:
    """The features of a part of a span; what a span's parts hold is put together in ``Lattice``."""
    sort, *x = part
    if sort == "name":
        kinds, known, words, places, commas, case, word, gap, right, more = x
        full = known == words
        return (
            "N", f"N:known={known}/{words}", f"N:seq={' '.join(kinds) if words < 5 else 'long'}", f"N:first={kinds[0]}", f"N:last={kinds[-1]}", f"N:L={word}", f"N:L={word}{gap}", f"N:gap={gap}:{case}{min(words, 3)}", f"N:R={right}", f"N:R2={right} {more}",
            f"N:{known > 0}:{word}", f"N:{full}:{words > 1}:{case}", f"N:{right}:{kinds[-1]}", f"N:place={places}/{words}", f"N:comma={commas}", f"N:{full}:{gap}:{right}", f"N:{full}:{word}:{gap}:{words > 1}",
        )
    if sort == "mail":
        return "E", f"E:L={x[0]}"
    if sort == "phone":
        groups, digits, front, word, role, known, near, right = x
        plain = len(groups) == 1
        return (
            "P", f"P:form={' '.join(groups)}", f"P:digits={digits}:{front}", f"P:front={front}", f"P:role={role}", f"P:L={word}", f"P:{role}:{plain}", f"P:known={known}:{plain}:{role}", f"P:known={known}", f"P:near={near}", f"P:R={right}", f"P:plain={plain}",
        )
    if sort == "id":
        kind, told, word, size, right = x
        return "I", f"I:{kind}", f"I:{kind}:{told}", f"I:{kind}:L={word}", f"I:{kind}:n={size}", f"I:{kind}:R={right}"
    if sort == "start":
        label, first, ahead, word, gap = x
        return "A", f"A:label={label}", f"A:first={first}", f"A:ahead={ahead}", f"A:{ahead}>{first}", f"A:L={word}", f"A:gap={gap}"
    if sort == "end":
        last, second, follows, right = x
        return f"A:last={last}", f"A:last2={second} {last}", f"A:follows={follows}", f"A:{last}>{follows}", f"A:R={right}"
    number, kind, code, words, unknown, odd, numbers, lines, dots, label, last = x
    core = f"A:{number > 0:d}{min(kind, 2)}{min(code, 2)}"
    return (
        core, f"{core}:{label}", f"A:words={min(words, 6)}", f"A:unknown={min(unknown, 4)}", f"A:odd={min(odd, 3)}", f"A:numbers={min(numbers, 4)}", f"A:lines={min(lines, 6)}", f"A:dots={min(dots, 3)}", f"A:code-end={code > 0}:{last}",
        f"A:share={round(unknown / (words + code + unknown), 1)}", f"A:{min(unknown, 3)}:{min(lines, 3)}:{code > 0}",
    )


class Lattice:
    """The admissible spans of a chunk: (first, end, kind, parts); ``features`` says what each part means."""

    def __init__(self, key: str, coder: Coder):
        before, inner, after = key.split("\0")
        t = coder.tokens
        self.left = [t[c] for c in before]
        self.t = [t[c] for c in inner]
        self.right = [t[c] for c in after]
        self.n = len(self.t)
        self.all = self.left + self.t + self.right
        self.arcs: list[tuple[int, int, str, tuple[tuple, ...]]] = []
        self._names()
        self._figures()
        self._addresses()

    def side(self, i: int) -> tuple[str, str, str]:
        """Left of token ``i``: the last word or figure (its name), what stands between, the class of the nearest token."""
        k = i + len(self.left) - 1
        gap = ""
        near = self.all[k]
        while k >= 0 and self.all[k].name in _SOFT:
            gap = ("\\" if self.all[k].mark == "\n" else self.all[k].name[:1]) + gap
            k -= 1
        word = self.all[k] if k >= 0 else near
        return (word.name if word.mark == "o" and word.name != "word" else "m" if word.mark in "ou" else word.mark), gap[-3:], near.name if near.mark == "o" and near.name != "word" else near.mark

    def after(self, j: int) -> tuple[str, str]:
        """Right of the span that ends before ``j``: the next token and the one after it."""
        k = j + len(self.left)
        return self.all[k].name, self.all[k + 1].name if k + 1 < len(self.all) else "\n"

    def _names(self) -> None:
        t, n = self.t, self.n
        for i in range(n):
            if t[i].mark != "m" or (t[i].case == "l" and not t[i].lex and t[i].role != "particle"):
                continue
            word, gap, _ = self.side(i)
            led = word in _LEADS
            words, known, commas, places = 0, 0, 0, 0
            for j in range(i + 1, min(n, i + LONGEST["NAME"]) + 1):
                x = t[j - 1]
                if x.mark == "m":
                    words += 1
                    known += x.lex > 0
                    places += bool(x.place)
                elif x.mark == "," and not commas and t[j - 2].upper:
                    commas += 1
                    continue
                elif x.mark not in "-'":
                    break
                else:
                    continue
                if not known and not led:  # words that nothing marks as names are none
                    continue
                right, next_one = self.after(j)
                kinds = tuple(y.short for y in t[i:j])
                case = "l" if all(y.case == "l" for y in t[i:j] if y.mark == "m") else "U" if all(y.upper for y in t[i:j] if y.mark == "m") else "T"
                self.arcs.append((i, j, "NAME", (("name", kinds, known, words, places, commas, case, word, gap, right, next_one if right in _SOFT else ""),)))

    def _figures(self) -> None:
        t, n = self.t, self.n
        for i in range(n):
            if t[i].mark == "e":
                word, gap, _ = self.side(i)
                self.arcs.append((i, i + 1, "EMAIL", (("mail", word),)))
            if t[i].mark not in "d+(":
                continue
            word, _, near = self.side(i)
            role = "phone" if word in ("tel", "no", "on", "from") else "ref" if word == "ref" else "none"
            digits, groups, lead, known = 0, [], "", False
            for j in range(i + 1, min(n, i + LONGEST["PHONE"]) + 1):
                x = t[j - 1]
                if x.mark in "+().-":
                    groups.append(x.mark)
                    continue
                if not x.digits:
                    break
                digits, lead, known = digits + x.digits, lead or x.lead or "none", known or x.known
                groups.append(str(x.digits))
                if 9 <= digits <= 15:
                    right = self.after(j)[0]
                    front = t[i].mark if t[i].mark in "+(" else lead
                    self.arcs.append((i, j, "PHONE", (("phone", tuple(groups), digits, front, word, role, known, near, right),)))
        # identity numbers: the shapes of neighbouring tokens together
        for i in range(n):
            x = t[i]
            if not (x.begins if x.mark == "d" else x.mark == "m" and x.upper and x.size in (2, 5)):
                continue
            word = self.side(i)[0]
            marks = any(y.name == "id" for y in self.all[i : i + len(self.left)])
            for j in range(i + 1, min(n, i + LONGEST["ID"]) + 1):
                x = t[j - 1]
                if x.mark not in "dmc-":
                    break
                if x.mark == "-":
                    continue
                kind = id_kind([y for y in t[i:j] if y.mark != "-"])
                if kind:
                    right, _ = self.after(j)
                    self.arcs.append((i, j, "ID", (("id", kind, marks, word, j - i, right[:4]),)))

    def _addresses(self) -> None:
        t, n = self.t, self.n
        if not any(x.mark == "c" or (x.mark == "m" and x.place) for x in t):
            return
        starts = [i for i in range(n) if t[i].mark in "dmc#" and (i == 0 or t[i].mark in "d#c" or t[i - 1].mark not in "m" or t[i].place in ("U", "B") or not t[i - 1].place)]
        ends = [j for j in range(1, n + 1) if t[j - 1].mark in "dmcu." and (j == n or t[j - 1].mark == "c" or t[j].mark not in "m" or not t[j].place)]
        # how many tokens of each sort stand before a place
        sums = [[0] * 9]
        for x in t:
            word = x.mark == "m"
            sums.append([c + v for c, v in zip(sums[-1], (x.mark == "d" and x.role == "house", x.place == "K", x.mark == "c", word and bool(x.place), (word and not x.place) or x.mark == "u", x.mark == "d" and x.role != "house", x.mark == "d", x.mark == "\n", x.mark == "."))])
        kinds = [self._kind(x) for x in t]
        after = {}
        for j in ends:
            right = self.after(j)[0]
            after[j] = ("end", kinds[j - 1], kinds[j - 2] if j > 1 else "", self._part(j), right if len(right) < 3 else "")
        for i in starts:
            word, gap, _ = self.side(i)
            label = any(y.name == "place" for y in self.all[i : i + len(self.left)])
            start = ("start", label, kinds[i], self._part(i - 1), word, gap)
            a = sums[i]
            for j in ends:
                if j <= i or j - i > LONGEST["ADDRESS"]:
                    continue
                b = sums[j]
                words, code = b[3] - a[3], b[2] - a[2]
                if (words or code) and words + code + (b[0] > a[0]) > 1:
                    self.arcs.append((i, j, "ADDRESS", (start, after[j], ("part", b[0] - a[0], b[1] - a[1], code, words, b[4] - a[4], b[5] - a[5], b[6] - a[6], b[7] - a[7], b[8] - a[8], label, kinds[j - 1]))))

    @staticmethod
    def _kind(x: Token) -> str:
        if x.mark == "m":
            return "m" + (x.place or "-" + x.case)
        return x.role if x.mark == "d" else x.mark

    def _part(self, k: int) -> str:
        """Class of the token at ``k`` of the chunk; of glue also that of the next token further out."""
        x = self.all[k + len(self.left)]
        return self._kind(x) if x.mark != "o" else ":" if x.name in (":", "dash", "|") else "o"


def id_kind(part: list[Token]) -> str | None:
    """The kind of identity number that the shapes of the tokens make together, if any."""
    if any(x.shape == "X" or (x.mark == "m" and not x.upper) for x in part):
        return None
    s = "".join("?" if x.mark == "m" else x.shape for x in part)
    flat = re.sub(r"N(\d+)", lambda m: "0" * int(m[1]), re.sub(r"A(\d+)", lambda m: "a" * int(m[1]), s.replace("C1", "c").replace("B1", "b")))
    if "?" in flat:
        # words that stand alone: two letters before six figures and one after them, or the whole first part of a licence
        first, last = (x.size if x.mark == "m" else 0 for x in (part[0], part[-1]))
        if (first, last, flat.strip("?")) in ((2, 1, "000000"), (0, 1, "aa000000"), (2, 0, "000000c")):
            return "ni"
        return "licence" if first == 5 and re.fullmatch(r"\?000000[abc][abc0]{4}", flat) else None
    if re.fullmatch(r"aa000000c", flat):
        return "ni"
    if re.fullmatch(r"[abc][abc0]{4}000000[abc][abc0]{4}", flat) or (part[0].case == "9" and re.fullmatch(r"[abc]{2,4}0{1,3}000000[abc][abc0]{4}", flat)):
        return "licence"
    if re.fullmatch(r"[abc]?0{8,9}", flat) and len(part) == 1:
        return "passport"
    return None


class Weights(dict):
    """Weights of features; the sums of parts are remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(weights)
        self.parts: dict[tuple, float] = {}

    def score(self, parts: tuple[tuple, ...]) -> float:
        total = 0.0
        for p in parts:
            v = self.parts.get(p)
            if v is None:
                if len(self.parts) > REMEMBERED:
                    self.parts.clear()
                v = self.parts[p] = sum([self.get(f, 0.0) for f in features(p)])
            total += v
        return total


def segment(arcs: list[tuple[int, int, str, tuple[tuple, ...]]], n: int, weights: Weights) -> list[tuple[int, int, str]]:
    """The best disjoint spans of a chunk of ``n`` tokens (Viterbi over the lattice; a token outside all spans costs nothing)."""
    into: dict[int, list[tuple[int, float, str]]] = defaultdict(list)
    for i, j, kind, parts in arcs:
        v = weights.score(parts)
        if v > 0:
            into[j].append((i, v, kind))
    if not into:
        return []
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, v, kind in into.get(j, ()):
            if best[i] + v > best[j]:
                best[j], back[j] = best[i] + v, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


class Chunks:
    """Chunks of the fit: their lattices as arrays of feature numbers, the arcs of their labels and how often they stand."""

    def __init__(self, data: dict[tuple[str, tuple], int], coder: Coder):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, list[tuple[int, int, list[int]]], list[int], int]] = []
        for (key, gold), times in data.items():
            lattice = Lattice(key, coder)
            spans = {(i, j, k): x for x, (i, j, k, _) in enumerate(lattice.arcs)}
            if not all(g in spans for g in gold):
                continue
            self.items.append((lattice.n, [(i, j, [self.ids.setdefault(f, len(self.ids)) for part in parts for f in features(part)]) for i, j, _, parts in lattice.arcs], [spans[g] for g in gold], times))


def likelihood(n: int, arcs: list[tuple[int, int, list[int]]], gold: list[int], w: list[float], gradient: bool = True) -> tuple[float, list[float]]:
    """Log likelihood of the labelled path of one chunk, and for each arc its label less its expectation."""
    score = [sum([w[f] for f in fs]) for _, _, fs in arcs]
    into: dict[int, list[int]] = defaultdict(list)
    for x, (_, j, _) in enumerate(arcs):
        into[j].append(x)
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        terms = [alpha[j - 1], *(alpha[arcs[x][0]] + score[x] for x in into.get(j, ()))]
        top = max(terms)
        alpha[j] = top + math.log(sum([math.exp(v - top) for v in terms]))
    z = alpha[n]
    value = sum(score[x] for x in gold) - z
    if not gradient:
        return value, []
    # mass[j]: probability that a path passes the place before token j
    mass, g = [0.0] * n + [1.0], [0.0] * len(arcs)
    for j in range(n, 0, -1):
        if mass[j] <= 1e-9:
            continue
        mass[j - 1] += mass[j] * math.exp(alpha[j - 1] - alpha[j])
        for x in into.get(j, ()):
            p = mass[j] * math.exp(alpha[arcs[x][0]] + score[x] - alpha[j])
            mass[arcs[x][0]] += p
            g[x] -= p
    for x in gold:
        g[x] += 1.0
    return value, g


def fit(data: dict[tuple[str, tuple], int], coder: Coder, rounds: int = 12, rate: float = 0.4, decay: float = 1e-3) -> dict[str, float]:
    """Weights that maximise the likelihood of labelled chunks: adaptive gradient steps, a chunk at a time."""
    chunks = Chunks(data, coder)
    w, seen = [0.0] * len(chunks.ids), [1e-2] * len(chunks.ids)
    for _ in range(rounds):
        for n, arcs, gold, times in chunks.items:
            if not arcs:
                continue
            _, g = likelihood(n, arcs, gold, w)
            weight = math.sqrt(times)
            step: dict[int, float] = defaultdict(float)
            for x, v in enumerate(g):
                if abs(v) > 1e-3:
                    for f in arcs[x][2]:
                        step[f] += v
            for f, v in step.items():
                v = v * weight - decay * w[f]
                seen[f] += v * v
                w[f] += rate * v / math.sqrt(seen[f])
    return {f: round(w[k], 4) for f, k in chunks.ids.items() if abs(w[k]) > 1e-3}


def labelled(texts: list[str], proposer: L.Proposer, coder: Coder) -> dict[tuple[str, tuple], int]:
    """(key of a chunk, its labelled spans) -> how often it stands. Chunks that a doubtful or a cut span touches are left out."""
    out: dict[tuple[str, tuple], int] = Counter()
    for text in texts:
        toks = tokens_of(text)
        start, end, at = {}, {}, 0
        for k, tok in enumerate(toks):
            bare = tok.lstrip(" \t")
            size = len(tok) - (bare[:1] == MAIL and len(bare) > 1)
            end[at + size] = k + 1
            start[at + size - len(bare) + (len(tok) - size)] = k
            at += size
        spans, doubt = [], []
        for s in proposer.segments(text):
            y = L.certain(s, coder.prefixes)
            a, b = start.get(s.start), end.get(s.end)
            if y == 1 and a is not None and b is not None:
                spans.append((a, b, s.kind, s.end - s.start))
            elif y != 0:
                doubt.append((s.start, s.end))
        kept: list[tuple[int, int, str]] = []
        for a, b, kind, _ in sorted(spans, key=lambda x: -x[3]):
            if all(b <= p or q <= a for p, q, _ in kept):
                kept.append((a, b, kind))
        blur = {start[p] for a, b in doubt for p in range(a, b) if p in start}
        for key, a, b in chunks_of(toks, coder):
            if any(k in blur for k in range(a, b)) or any(p < a < q or p < b < q for p, q, _ in kept):
                continue
            out[(canonical(key, coder), tuple(sorted((p - a, q - a, kind) for p, q, kind in kept if a <= p and q <= b)))] += 1
    return out


#: The segmentation of a chunk without any admissible span (an empty one differs: it has spans, but none that is worth it).
NO_SPAN = ()


class Tagger:
    """Finds the personal data of texts; remembers the segmentation of each string of classes."""

    def __init__(self, coder: Coder, weights: dict[str, float]):
        self.coder, self.weights = coder, Weights(weights)
        self.known: dict[str, list[tuple[int, int, str]]] = {}
        self.solved: dict[str, list[tuple[int, int, str]]] = {}
        #: Chunks that hold no admissible span unless a word before them leads to one.
        self.weak: set[str] = set()

    def spans(self, toks: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first, end, kind) of each piece, in tokens."""
        known, weak, leads, outside = self.known, self.weak, self.coder.leads, self.coder.outside
        codes = coded(toks, self.coder)
        for m in _CHUNK.finditer(codes):
            a, b = m.span()
            inner, left = codes[a:b], codes[a - _BEFORE : a]
            if inner in weak and leads.isdisjoint(left):
                continue
            key = f"{left.translate(outside)}\0{inner}\0{codes[b:b + _AFTER].translate(outside)}"
            got = known.get(key)
            if got is None:
                got = self.best(key)
                if got == NO_SPAN and leads.isdisjoint(left):
                    weak.add(inner)
            for i, j, kind in got:
                yield a - _BEFORE + i, a - _BEFORE + j, kind

    def best(self, key: str) -> list[tuple[int, int, str]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.weak) > REMEMBERED:
            self.weak.clear()
        if len(self.solved) > REMEMBERED:
            self.solved.clear()
        short = canonical(key, self.coder)
        got = self.solved.get(short)
        if got is None:
            lattice = Lattice(short, self.coder)
            got = self.solved[short] = segment(lattice.arcs, lattice.n, self.weights) if lattice.arcs else NO_SPAN
        self.known[key] = got
        return got

    def pieces(self, text: str) -> set[tuple[str, str]]:
        toks = tokens_of(text)
        return {(kind, said(toks[a:b]).lstrip(" \t")) for a, b, kind in self.spans(toks)}

    def redacted(self, text: str) -> str:
        """``text`` with each piece replaced by the name of its kind in brackets."""
        toks = tokens_of(text)
        out, end = [], 0
        for a, b, kind in self.spans(toks):
            blank = toks[a][: len(toks[a]) - len(toks[a].lstrip(" \t"))]
            out += [said(toks[end:a]), f"{blank}[{kind}]"]
            end = b
        return "".join([*out, said(toks[end:])])


#: Values of labels that hold one name, and headers of mails; the part in parentheses is the name.
_NAME_LINES = r"(?m)^(?:[>| ]*\*?(?:From|Von) ?:|(?:Our Client|Client Name|Claimant|Name|Re) ?:|I, )[^\n]*$"
_NAME_PLACES = (r"^[>| ]*\*?(?:From|Von) ?:\*? *([^<\n@:]{3,40}?) *(?:<|$)", r"^(?:Our Client|Client Name|Claimant|Name|Re) ?: *(?:(?:Mr|Mrs|Ms|Miss|Dr) )?([^\n\d@:()]{4,36})$", r"^I, ([^\n\d@:(),]{4,36}), confirm")
# found at their delimiter, which is rarer than the first letters of the labels
_PLACE_VALUES = r"(?m) ?[:–-](?<=(?:Address|Location|Garage|inspect|located at) ?[:–-]) ?\n?([^\n:@]{8,110})$"
#: Numbers set in groups: the four figures after the nought tell telephone numbers from references.
_GROUPED = r"(0(?<![\w+./:-]0)\d{2,4}\)?[ .-]{1,2}\d{3,4}[ .-]?\d{3,4})(?!\d)"
#: Least weight of an entry of each lexicon; a place in a fixture weighs five.
LEAST = {"name": 2, "place": 5, "prefix": 3}


def lexicon(models: DataFrame, fixtures: DataFrame) -> DataFrame:
    """kind (name, place, prefix), w, n: words of names and of addresses, beginnings of telephone numbers; counted in one pass over all texts."""
    value = lambda k: F.get(F.map_values(F.map_filter("expected_values", lambda key, _: key == k)), F.lit(0))
    spot = lambda kind, v, weight=1: F.struct(F.lit(kind).alias("kind"), v.alias("v"), F.lit(weight).alias("weight"))
    spots_of = lambda kind, p: F.transform(F.regexp_extract_all("plain_text", F.lit(p), F.lit(0 if kind == "line" else 1)), lambda v: spot(kind, F.substring(F.regexp_replace(v, r"\D", ""), 2, 4) if kind == "prefix" else v))
    found = [spots_of(kind, p) for kind, p in (("line", _NAME_LINES), ("place", _PLACE_VALUES), ("prefix", _GROUPED))]
    firm = F.lower(value("claimant_name")).rlike(r"\b(?:" + "|".join(sorted(L.FIRM_WORDS)) + r"|as above|see|not|known|tbc|advised|unknown)\b")
    own = F.when(~firm, F.regexp_replace(value("claimant_name"), r"[,(<\[].*$", ""))
    spots = models.select(F.explode_outer(F.concat(*found)).alias("s")).unionByName(fixtures.select(F.explode(F.array(spot("name", own), spot("place", value("inspection_address"), 5))).alias("s"))).select("s.*").where(F.col("v").isNotNull())
    named = F.coalesce(*(F.nullif(F.regexp_extract("v", p, 1), F.lit("")) for p in _NAME_PLACES))
    spots = spots.select(F.when(F.col("kind") == "line", "name").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "line", named).otherwise(F.col("v")).alias("v"), "weight")
    # counted as they stand before anything else, so that all that follows sees each word once
    raw = spots.select("kind", "weight", F.explode(F.split(F.lower("v"), r"[\s,;/]+")).alias("w")).groupBy("kind", "w").agg(F.sum("weight").alias("n"))
    words = raw.withColumn("w", F.when(F.col("kind") == "place", F.regexp_replace(F.regexp_replace("w", r"[.]+$", ""), "[’']", "")).otherwise(F.replace("w", F.lit("’"), F.lit("'"))))
    stop = tuple(w for w in L.STOP if len(w) > 2)
    fit = (
        F.when(F.col("kind") == "name", F.col("w").rlike(r"^[^\d.]+$") & ~F.col("w").isin(*L.TITLES, *L.PARTICLES, *stop, *L.FIRM_WORDS, *L.NAME_LABELS, "tbc", "unknown", "known"))
        .when(F.col("kind") == "place", F.col("w").rlike(r"^[\p{L}-]+$") & ~F.col("w").isin(*stop)).otherwise(True)
    )
    least = F.when(F.col("kind") == "name", LEAST["name"]).when(F.col("kind") == "place", LEAST["place"]).otherwise(LEAST["prefix"])
    return words.where((F.length("w") > 2) & fit).groupBy("kind", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def texts_of(models: DataFrame, fixtures: DataFrame) -> DataFrame:
    """place, rec_id, text."""
    value = F.get(F.map_values(F.map_filter("expected_values", lambda k, _: k == "claimant_name")), F.lit(0))
    a = models.select(F.lit("model").alias("place"), F.col("model_id").alias("rec_id"), F.col("plain_text").alias("text"))
    b = fixtures.select(F.lit("fixture").alias("place"), F.col("record_id").alias("rec_id"), value.alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & (F.col("text") != ""))


class _Over:
    def __init__(self, own: set[str], base: dict[str, int]):
        self.own, self.base = own, base

    def __contains__(self, w: str) -> bool:
        return w in self.own or w in self.base

    def get(self, w: str, default: int = 0) -> int:
        return 1 if w in self else default


def coder_of(base: dict[str, dict[str, int]], more: Iterable[tuple[str, str]] = ()) -> Coder:
    """A coder over the lexicons ``base`` and, over them, the entries that came with a text."""
    more = list(more)
    return Coder(*(_Over({w for kind, w in more if kind == k}, base[k]) if more else base[k] for k in LEAST))


def keys_of(text: str) -> set[tuple[str, str]]:
    """(kind, word) of all that a lexicon may be asked for in a text."""
    out = set()
    for tok in set(tokens_of(text)):
        w = tok.lstrip(" \t\n>|")
        base = w.lower().replace("’", "'").rstrip("'.")
        if w.isdigit():
            out.add(("prefix", w[1:5]))
        elif base:
            out |= {("name", base), ("place", base), ("place", base.replace("'", ""))}
    return out


def with_entries(src: DataFrame, rest: DataFrame) -> DataFrame:
    """``src`` with ``more``: the entries beyond the broadcast part that its text may ask for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, rec, text in zip(*(c.to_pylist() for c in b.columns)):
                keys = sorted(keys_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(keys), pa.string()), pa.array([rec] * len(keys), pa.int64()), pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string())], names=["place", "rec_id", "kind", "w"])

    asked = src.select("place", "rec_id", "text").mapInArrow(run, "place string, rec_id bigint, kind string, w string").join(rest.select("kind", "w"), ["kind", "w"])
    return src.join(asked.groupBy("place", "rec_id").agg(F.collect_set(F.struct("kind", "w")).alias("more")), ["place", "rec_id"], "left")


@lru_cache(maxsize=2)
def _tagger(holder) -> tuple[dict[str, dict[str, int]], Tagger]:
    base, coder, weights, solved = holder.value
    tagger = Tagger(coder, weights)
    tagger.solved.update(solved)
    return base, tagger


def train(models: DataFrame, fixtures: DataFrame, most: int = MOST_WORDS) -> tuple[tuple, DataFrame | None]:
    """(what is broadcast: lexicons, coder, weights and the segmentations of the sample's chunks; the entries beyond the bound, if any)."""
    top, rest = top_and_rest(lexicon(models, fixtures), "n", most)
    base: dict[str, dict[str, int]] = {k: {r["w"]: 1 for r in top if r["kind"] == k} for k in LEAST}
    texts = [r["plain_text"] for r in bounded_sample(models.select("plain_text", "model_id").where(F.col("plain_text").isNotNull()), "model_id", FIT_TEXTS)]
    more: list[tuple[str, str]] = []
    if rest is not None:
        asked = models.sparkSession.createDataFrame(sorted(set().union(*map(keys_of, texts))) or [("", "")], "kind string, w string")
        more = [(r["kind"], r["w"]) for r in rest.select("kind", "w").join(F.broadcast(asked), ["kind", "w"]).collect()]  # at most the words of the sample
    own: dict[str, dict[str, int]] = {k: base[k] | {w: 1 for kind, w in more if kind == k} for k in LEAST}
    coder = coder_of(own)
    data = labelled(texts, L.Proposer(own["name"], set(own["place"])), coder)
    weights = fit(data, coder)
    if more:
        return (base, coder_of(base), weights, {}), rest
    tagger = Tagger(coder, weights)
    for key, _ in data:
        tagger.best(key)
    return (base, coder, weights, tagger.solved), rest


def find_personal(models: DataFrame, fixtures: DataFrame, redacted: bool = False, most: int = MOST_WORDS) -> DataFrame:
    """place, rec_id, kind, surface of each distinct piece of personal data; with ``redacted`` place, rec_id, text with placeholders.

    Null and empty texts give no row; repeated rows of a record count once (texts that differ under one id count each); a text without
    personal data comes out unchanged. Texts are searched whole, whatever their length. most: entries of the lexicons that are broadcast; the result
    does not depend on it.
    """
    fitted, rest = train(models, fixtures, most)
    data = models.sparkSession.sparkContext.broadcast(fitted)
    src = texts_of(models, fixtures)
    src = src.withColumn("more", F.lit(None).cast("array<struct<kind:string,w:string>>")) if rest is None else with_entries(src, rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, common = _tagger(data)
        gc.disable()  # what is remembered is large, lasting and without cycles: looking through it again and again would find nothing
        for b in batches:
            found = []
            for text, more in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                tagger = Tagger(coder_of(base, ((x["kind"], x["w"]) for x in more)), common.weights) if more else common
                found.append(tagger.redacted(text) if redacted else [{"kind": k, "surface": s} for k, s in sorted(tagger.pieces(text))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string() if redacted else PIECES)], names=["place", "rec_id", "found"])

    src = src.select("place", "rec_id", "text", "more")
    out = src.mapInArrow(run, f"place string, rec_id bigint, found {'string' if redacted else 'array<struct<kind:string,surface:string>>'}").dropDuplicates()
    if redacted:
        return out.withColumnRenamed("found", "text")
    return out.select("place", "rec_id", F.explode("found").alias("x")).select("place", "rec_id", "x.kind", "x.surface")


PIECES = pa.list_(pa.struct([("kind", pa.string()), ("surface", pa.string())]))
