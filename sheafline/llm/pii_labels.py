"""Labels for the fit of the personal-data field: patterns that leave little doubt in running text.

There are no labelled texts, so the field of ``pii`` is fitted on a bounded sample that these patterns label. They look at a
sample only; what stands in the texts is decided by the field.
"""

from __future__ import annotations

import re

from sheafline.llm.address import BUSINESS_WORDS, STREET_KINDS, UNIT_WORDS

#: Longest pieces that the patterns label, in tokens.
NAME_TOKENS, ADDRESS_TOKENS = 6, 30

#: Words around personal data.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "mr.", "mrs.", "ms.", "dr."}
PARTICLES = {"de", "del", "da", "van", "der", "den", "von", "al", "st", "ap", "el", "bin", "la", "le", "ter"}
NAME_LABELS = {"client", "insured", "name", "claimant", "re", "from", "von", "handler", "witness", "dear", "hi", "hello", "morning", "i", "to", "policyholder", "driver", "de"}
PHONE_LABELS = {"tel", "telephone", "mobile", "mob", "phone", "t", "m", "ddi", "no", "number", "on", "line", "ring", "call", "from", "fax", "contact", "reached"}
REF_LABELS = {"ref", "reference", "claim", "card", "policy", "request", "subject", "betreff", "objet", "asunto", "file", "passport", "job", "instruction", "temat"}
FIRM_WORDS = {"law", "claims", "hire", "solicitors", "legal", "llp", "management", "accident", "ltd", "limited", "garage", "bodyshop", "coachworks", "autocare", "team", "group", "road", "street"}
STOP = set("above below the of and to a in is that it was for on are with as at be by this from or had not but have has which an were will been its their our we you he she they please can cannot who said left number dear sirs sir madam hello hi morning team any all no yes one two three mobile tel email vehicle reg registration vrm make model odometer mileage date received dated instruction reference claimant insured client contact telephone odometer after before until when while whom may must could would should there here".split())

_EMAIL = re.compile(r"[^\W_][\w.+'’-]*@[^\W_][\w-]*(?:\.[\w-]+)+")
_SPELLED = re.compile(_EMAIL.pattern + r"|[^\W_][\w.+'’-]*(?: dot [\w+'-]+)* ?(?:\[at\]|\(at\)|\{at\}| at ) ?[\w-]+(?:(?: ?(?:\[dot\]|\(dot\)| dot ) ?)[\w-]+)+|[^\W_][\w.+'’-]* ?(?:\[at\]|\(at\)|\{at\}) ?[\w-]+(?:\.[\w-]+)+", re.I)
_DIGIT = re.compile(r"\d")
_SIX = re.compile(r"\d\d[ -]?\d\d[ -]?\d\d")
_SPLIT = re.compile(r"[^\s,;:()<>\[\]{}\"“”/|@*=_!?\d.]+").findall
_PHONE = re.compile(r"(?<![\w+./:-])(?:\+44|0044|\(?0)[\d ().\-]{7,18}\d(?![\w])")
_DATE = re.compile(r"\d{1,2}[.-]\d{1,2}[.-]\d{4}\b|\d{4}-\d{2}-\d{2}")
_NI = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d](?![A-Za-z0-9])")
_LICENCE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]{4}[ -]?\d{6}[ -]?[A-Za-z][A-Za-z0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Za-z]{2,4}9{1,3}[ -]?\d{6}[ -]?[A-Za-z][A-Za-z0-9]{4}(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9/-])[A-Za-z]?\d{8,9}(?![A-Za-z0-9/-])")
_TOKEN = re.compile(r"[^\s,;:()<>\[\]{}\"“”/|@*=_!?©\d]*[^\W\d_][^\s,;:()<>\[\]{}\"“”/|@*=_!?\d]*")
_ADDR_TOKEN = re.compile(r"[A-Za-z]{1,2}\d[\dA-Za-z]? ?\d[A-Za-z]{2}(?![\w])|\d+[A-Za-z]?(?![\w])|[^\W\d_](?:[^\s,;:/|()<>]*[^\W\d_])?\.?|\S")
_POSTCODE = re.compile(r"^[A-Za-z]{1,2}\d[\dA-Za-z]? ?\d[A-Za-z]{2}$")
_KINDS_OF_STREET = {a for k, v in STREET_KINDS.items() for a in (k, *v.split())}
_FIXED_PLACES = _KINDS_OF_STREET | set(UNIT_WORDS) | set(BUSINESS_WORDS) | {"no", "north", "south", "east", "west", "n", "s", "e", "w"}
_LABEL_END = re.compile(r"(?:address|location|garage|inspect|located at|inspection at|repairer|bodyshop)\W*$", re.I)
_CODE_IN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,2}\d[\dA-Za-z]? ?\d[A-Za-z]{2}(?![\w])")
_LEFT = re.compile(r"([^\W\d_]+)[^\w]{0,4}$")
_RIGHT = re.compile(r"^[^\w]{0,3}([^\W\d_]+)")


class Segment:
    __slots__ = ("start", "end", "kind", "text", "feats")

    def __init__(self, start: int, end: int, kind: str, text: str, feats: tuple[str, ...]):
        self.start, self.end, self.kind, self.text, self.feats = start, end, kind, text, feats


def _around(text: str, a: int, b: int) -> tuple[str, str, bool, bool]:
    """Last word to the left (over one line end), first word to the right, begins and ends its line."""
    left = text[max(0, a - 40) : a]
    m = _LEFT.search(left)
    r = _RIGHT.search(text[b : b + 24])
    return (m[1].lower() if m else ""), (r[1].lower() if r else ""), not left.rpartition("\n")[2].strip(" >|*-"), text[b : b + 1] in ("", "\n", "\r")


def national(digits: str) -> str:
    d = re.sub(r"\D", "", digits)
    d = d[4:] if d.startswith("0044") else d[2:] if d.startswith("44") and len(d) > 10 else d
    return d.lstrip("0")


class Proposer:
    """The candidate segments of a text with their features."""

    def __init__(self, names: dict[str, int], places: set[str]):
        self.names, self.places = names, places | _FIXED_PLACES
        self.whole: dict[str, list] = {}

    def segments(self, text: str) -> list[Segment]:
        """Lines are looked at one by one; cheap tests keep most of them from the costly patterns."""
        out: list[Segment] = []
        mails: list[tuple[int, int]] = []
        begin = 0
        names = self.names
        digit: list[bool] = []
        label: list[bool] = []
        for line in text.split("\n"):
            end = begin + len(line)
            low = line.lower()
            label.append("ddress" in low or "ocat" in low or "arage" in low or "insp" in low or "epairer" in low or "odyshop" in low)
            spelled = "[at]" in low or "(at)" in low or " dot " in low or "{at}" in low
            if spelled or "@" in line:
                for m in (_SPELLED if spelled else _EMAIL).finditer(text, begin, end):
                    mails.append((m.start(), m.end()))
                    out.append(Segment(m.start(), m.end(), "EMAIL", m.group(), ("email", "email:@" if "@" in m.group() else "email:spelled")))
            digits = bool(_DIGIT.search(line))
            digit.append(digits)
            if digits:
                for m in _PHONE.finditer(text, begin, end):
                    out += self._phone(text, m)
                if _SIX.search(line):
                    for pattern, name in ((_NI, "ni"), (_LICENCE, "licence"), (_PASSPORT, "passport")):
                        for m in pattern.finditer(text, begin, end):
                            near = "passport" in text[max(0, m.start() - 24) : m.start()].lower()
                            if name == "passport" and not near:
                                continue
                            left, right, begins, ends = _around(text, m.start(), m.end())
                            out.append(Segment(m.start(), m.end(), "ID", m.group(), ("id:" + name, f"id:{name}:left={left}", f"id:{name}:line={begins}{ends}", f"id:near={near}")))
            for w in _SPLIT(low):
                if w in names or w in TITLES:
                    out += [x for x in self._names(text, begin, end) if not any(p <= x.start and x.end <= q for p, q in mails)]  # no name inside a mail address
                    break
            begin = end + 1
        out += self._addresses(text, digit, label)
        return out

    def _phone(self, text: str, m: re.Match) -> list[Segment]:
        s = m.group()
        while s.count("(") > s.count(")"):
            cut = s.rfind("(")
            s = s[:cut] if cut > 6 else s[cut + 1 :]
        s = s.strip(" .-")
        a = m.start() + text[m.start() : m.end()].find(s)
        found = []
        for piece in {s, re.split(r"  +", s)[0]}:
            d = re.sub(r"\D", "", piece)
            n = national(piece)
            if not 9 <= len(n) <= 10 or len(d) > 15 or _DATE.match(piece):
                continue
            left, right, begins, ends = _around(text, a, a + len(piece))
            plain = piece.isdigit()
            lab = "phone" if left in PHONE_LABELS else "ref" if left in REF_LABELS else "none"
            form = "plain" if plain else "grouped"
            found.append(Segment(a, a + len(piece), "PHONE", piece, ("phone", f"phone:{form}", f"phone:left={left}", f"phone:lab={lab}", f"phone:pre={n[:5]}", f"phone:pre3={n[:3]}:{form}", f"phone:n={len(n)}", f"phone:line={begins}{ends}", f"phone:wide={text[max(0, a - 2) : a] == '  '}")))
        return found

    def _names(self, text: str, begin: int, end: int) -> list[Segment]:
        names = self.names
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, begin, end)]
        low = [t[2].lower().rstrip(".'’") for t in tokens]
        low = [w[:-2] if w.endswith(("'s", "’s")) else w for w in low]
        hit = [w in names for w in low]
        out: list[Segment] = []
        n = len(tokens)
        used = -1
        for i in range(n):
            if (not hit[i] and not (low[i] in TITLES and i + 1 < n and not hit[i + 1])) or i <= used:
                continue
            titled = not hit[i]
            first = last = i + titled
            if titled:
                t = tokens[first]
                if not t[2][:1].isupper() or low[first] in STOP or t[0] - tokens[i][1] > 2 or "\n" in text[tokens[i][1] : t[0]] or low[i] in ("sir", "madam") or low[first] in FIRM_WORDS:
                    continue

            def joined(x: int, y: int) -> bool:
                gap = text[tokens[x][1] : tokens[y][0]]
                return gap == " "

            while first and first > used + 1 and joined(first - 1, first) and (hit[first - 1] or low[first - 1] in PARTICLES or re.fullmatch(r"[A-Z]\.?", tokens[first - 1][2])) and low[first - 1] not in TITLES and tokens[first - 1][2] != "I":
                first -= 1
            while first < last and low[first] in PARTICLES and tokens[first][2].islower() and not hit[first] and low[first] in ("de", "le", "la"):
                break
            while last + 1 < n and joined(last, last + 1) and last - first + 1 < NAME_TOKENS:
                w, k = tokens[last + 1][2], low[last + 1]
                if hit[last + 1] or (k in PARTICLES and last + 2 < n and joined(last + 1, last + 2)) or re.fullmatch(r"[A-Z]\.", w):
                    last += 1
                elif w[:1].isupper() and k not in STOP and k not in FIRM_WORDS and k not in TITLES and k not in NAME_LABELS and last == first and len(w) > 2 and (not w.isupper() or tokens[last][2].isupper()) and not tokens[last][2].endswith("."):
                    last += 1
                else:
                    break
            while last > first and (low[last] in PARTICLES or (len(low[last]) < 2 and not tokens[last][2].endswith("."))):
                last -= 1
            a, b = tokens[first][0], tokens[last][1]
            # surname first
            if first > used + 1 and first and text[tokens[first - 1][1] : a] == ", " and tokens[first - 1][2].isupper() and len(low[first - 1]) > 2 and low[first - 1] not in STOP | FIRM_WORDS and (hit[first - 1] or text[: tokens[first - 1][0]].rstrip(" ")[-1:] in (":", "")):
                f = first - 1
                while f > used + 1 and joined(f - 1, f) and (low[f - 1] in PARTICLES or (hit[f - 1] and tokens[f - 1][2].isupper())):
                    f -= 1
                first, a = f, tokens[f][0]
            elif last + 1 < n and text[b : tokens[last + 1][0]] == ", " and hit[last + 1] and text[a:b].isupper() and not tokens[last + 1][2].isupper() and len(low[last]) > 2:
                last += 1
                b = tokens[last][1]
            s = text[a:b]
            trimmed = s.rstrip("'’-–\"")
            if trimmed.endswith(".") and not re.search(r"(?:^|[ .])[A-Z]\.$", trimmed):
                trimmed = trimmed.rstrip(".")
            trimmed = re.sub(r"['’]s$", "", trimmed)
            b = a + len(trimmed)
            used = last
            left, right, begins, ends = _around(text, a, b)
            inside = list(range(first, last + 1))
            full = [k for k in inside if low[k] not in PARTICLES and len(low[k].rstrip(".")) > 1]  # initials and particles prove nothing
            share = sum(hit[k] for k in full) / max(1, len(full))
            title = first > 0 and low[first - 1] in TITLES and len(text[tokens[first - 1][1] : a]) <= 2
            case = "lower" if trimmed.islower() else "upper" if trimmed.isupper() else "mixed"
            out.append(Segment(a, b, "NAME", trimmed, (
                "name", f"name:n={len(inside)}", f"name:share={round(share, 1)}", f"name:left={left}", f"name:right={right if right in FIRM_WORDS else right[:4]}", f"name:firm={right in FIRM_WORDS and not ends}", f"name:title={title}",
                f"name:line={begins}{ends}", f"name:case={case}:{len(inside) > 1}", f"name:label={left in NAME_LABELS}",
            )))
        return out

    def _is_place(self, token: str) -> bool:
        t = token.lower().rstrip(".").replace("’", "'")
        return t in self.places or t.replace("'", "") in self.places or bool(_POSTCODE.match(token))

    def _addresses(self, text: str, digit: list[bool], label: list[bool]) -> list[Segment]:
        out: list[Segment] = []
        lines = text.split("\n")
        at = [0]
        for r in lines:
            at.append(at[-1] + len(r) + 1)
        k, n = 0, len(lines)
        while k < n:
            # an address begins where a label is, or with a number or postcode beside a kind of street
            near = label[k] or (k > 0 and label[k - 1])
            got = None
            if (near and (digit[k] or any(digit[k + 1 : k + 5]))) or (digit[k] and self._likely(lines[k])):
                got = self._address_from(lines, at, k, text)
            if got is None:
                k += 1
            else:
                out.append(got[0])
                k = got[1]
        return out

    @staticmethod
    def _likely(line: str) -> bool:
        return bool(_CODE_IN.search(line)) or any(w in _KINDS_OF_STREET for w in _SPLIT(line.lower()))

    def _tokens(self, line: str) -> list[tuple[int, int, str, str]]:
        """(start, end, token, class): p place word, n number, c postcode, u unknown word, s separator, x breaking sign."""
        if line in self.whole:
            return self.whole[line]
        out = []
        for m in _ADDR_TOKEN.finditer(line):
            w = m.group()
            if _POSTCODE.match(w):
                c = "c"
            elif re.fullmatch(r"\d{1,4}[A-Za-z]?", w):
                c = "n"
            elif w in ",;/":
                c = "s"
            elif not (w[0].isalpha()):
                c = "x"
            elif self._is_place(w):
                c = "p"
            else:
                c = "u"
            out.append((m.start(), m.end(), w, c))
        if len(self.whole) > 20_000:
            self.whole.clear()
        self.whole[line] = out
        return out

    def _address_from(self, lines: list[str], at: list[int], k: int, text: str):
        line = lines[k]
        toks = self._tokens(line)
        if not toks or not any(t[3] in "pc" for t in toks):
            return None
        best = None
        i = 0
        while i < len(toks):
            if toks[i][3] not in "pnc":
                i += 1
                continue
            j = self._run(toks, i)
            strong = self._strong(toks[i : j + 1])
            label = bool(_LABEL_END.search(line[: toks[i][0]])) or (not line[: toks[i][0]].strip(" >|") and k > 0 and bool(_LABEL_END.search(lines[k - 1])))
            ends = not line[toks[j][1] :].strip(" .\r")
            last, stop = (k, toks[j][1])
            body = toks[i : j + 1]
            if ends:
                m = k + 1
                while m < len(lines) and m - k < 7 and lines[m].strip() and self._continues(lines[m], body):
                    more = self._tokens(lines[m])
                    body = body + [(0, 0, "\n", "s")] + more
                    last, stop = m, more[-1][1]
                    m += 1
                    if not (strong or label) and self._strong(body):
                        strong = True
            strong = self._strong(body)
            words = sum(t[3] == "p" for t in body)
            if len(body) <= ADDRESS_TOKENS * 2 and (strong or (label and words >= 2)):
                while body and body[-1][3] in "sx":
                    body = body[:-1]
                a, b = at[k] + toks[i][0], at[last] + stop
                s = text[a:b].rstrip(" ,;/\r")
                if s.endswith(".") and not re.search(r"(?i)\b[a-z]{1,6}\.$", s):
                    s = s[:-1]
                b = a + len(s)
                code = any(t[3] == "c" for t in body)
                left = _around(text, a, b)[0]
                best = (Segment(a, b, "ADDRESS", s, ("addr", f"addr:code={code}", f"addr:strong={strong}", f"addr:label={label}", f"addr:lines={last - k}", f"addr:left={left}", f"addr:words={min(8, words)}", f"addr:unknown={min(3, sum(t[3] == 'u' for t in body))}", f"addr:ends={ends}")), max(last + (1 if last > k else 1), k + 1))
                return best
            i = j + 1
        return None

    def _run(self, toks, i: int) -> int:
        j = i
        k = i + 1
        while k < len(toks):
            c = toks[k][3]
            if c in "pnc":
                j = k
                k += 1
            elif c == "s":
                k += 1
            elif c == "u" and toks[k][2].lower().rstrip(".") not in STOP and len(toks[k][2]) > 2:
                # one unknown word (misspelt) may stand in an address: before more of it, or as the last part after a separator
                nxt = k + 1
                while nxt < len(toks) and toks[nxt][3] == "s":
                    nxt += 1
                if nxt < len(toks) and toks[nxt][3] in "pc":
                    k = nxt
                elif nxt >= len(toks) and toks[k - 1][3] == "s" and any(t[3] == "n" for t in toks[i:k]):
                    j = k
                    k = nxt
                else:
                    break
            else:
                break
        return j

    @staticmethod
    def _strong(toks) -> bool:
        if not any(t[3] in "pc" for t in toks):
            return False
        number = any(t[3] == "n" for t in toks)
        kind = any(t[3] == "p" and t[2].lower().rstrip(".").replace("'", "").replace("’", "") in _KINDS_OF_STREET for t in toks)
        code = any(t[3] == "c" for t in toks)
        return (number and kind and len(toks) >= 3) or (code and (number or kind) and len(toks) >= 3)

    def _continues(self, line: str, body) -> bool:
        toks = self._tokens(line)
        if not toks or any(t[3] == "x" for t in toks) or len(toks) > 14:
            return False
        bad = [t for t in toks if t[3] == "u"]
        good = [t for t in toks if t[3] in "pc"]
        if any(t[2].lower() in STOP or any(c.isdigit() for c in t[2]) for t in bad):
            return False
        if bad and (len(bad) > 1 or (not good and (len(toks) > 1 or line.strip().lower() in STOP or not any(t[3] == "n" for t in body)))):
            return False
        if bad and not good:
            return len(bad[0][2]) > 4 and bad[0][2][:1].isupper()
        if all(t[3] == "n" for t in toks):
            return False
        return bool(good)


def certain(s: Segment, prefixes: frozenset[str] | set[str] = frozenset()) -> int | None:
    """1 or 0 for a segment whose label or form leaves no doubt, else None. prefixes: beginnings of numbers that are set in groups."""
    f = set(s.feats)
    if s.kind == "EMAIL":
        return 1
    if s.kind == "PHONE":
        return 0 if "phone:lab=ref" in f or "phone:wide=True" in f else 1 if "phone:lab=phone" in f or "phone:grouped" in f else int(national(s.text)[:4] in prefixes)
    if s.kind == "ID":
        return 0 if "id:passport" in f and "id:near=False" in f else 1
    if s.kind == "ADDRESS":
        return 1 if "addr:strong=True" in f or "addr:label=True" in f else 0
    if "name:firm=True" in f:
        return 0
    if "name:title=True" in f or "name:label=True" in f or ("name:share=1.0" in f and "name:n=1" not in f):
        return 1
    return 1 if "name:line=TrueTrue" in f and "name:share=1.0" in f else None
