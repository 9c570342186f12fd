"""Whole records in one Arrow-batched pass.

A record combines thirteen rules with ladders of fallbacks and fuzzy labels; as one expression tree that costs the
optimizer more than the data cost the executors. Here the same tables that the Column builders read (``ladder``, the
gates of ``validate``) are read a batch at a time: labels are located for all documents of a batch together
(``similarity.Finder``), a ladder is climbed only for a field whose rule found nothing or something suspicious.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from sheafline.functions.normalize import MONTH_NAMES
from sheafline.functions.similarity import ratio
from sheafline.functions.text import DATE, LABEL_ONLY, NARRATIVE, POSTCODE, VRM
from sheafline.functions.validate import GATES
from sheafline.operators import ladder as S
from sheafline.schema import DATES, FIELD_ORDER

BLANKED = ("vrm", "vehicle_model", "claimant_name", "reference", "inspection_address")
_DASH = re.compile(r"\s[-–—]\s")


@lru_cache(maxsize=1_000)
def pattern(p: str) -> re.Pattern:
    return re.compile(p)


@lru_cache(maxsize=200_000)
def clean(s: str) -> str:
    s = re.sub(" {2,}", " ", s.replace("\r", " ").replace("\t", " "))
    return re.sub("\n{3,}", "\n\n", s).strip(" :\n")


def label_only(s: str) -> bool:
    v = clean(s).lower()
    return not v or v in LABEL_ONLY


def rejected(s: str, rejects: tuple[str, ...]) -> bool:
    v = clean(s).lower()
    return len(v) <= 2 or v in rejects


def narrative(s: str) -> bool:
    low = s.lower()
    return any(p in low for p in NARRATIVE)


def compact(s: str) -> str:
    return re.sub(r"\s+", "", s).upper()


@dataclass
class Found:
    value: str = ""
    rule_id: str | None = None
    confidence: float | None = None
    pos: int | None = None
    raw_value: str = ""
    issue: str | None = None


@dataclass
class Hit:
    """A label in a document: its line, how like it is, whether it stands there as written."""

    label: str
    line: int
    like: float
    exact: bool


@dataclass
class Doc:
    """lines: clean lines in flat order. near: label in lower case -> (line, similarity) of the labels that do not stand there as written."""

    lines: list[str]
    text: str
    raw_lines: list[str]
    as_of: dt.date
    near: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.low = [t.lower() for t in self.lines]
        self.joined = "\n".join(self.low)
        self.found: dict[str, Hit | None] = {}

    def find(self, label: str, least: float) -> Hit | None:
        if label not in self.found:
            want = label.lower().strip()
            if want in self.joined and (at := next((i for i, t in enumerate(self.low) if want in t), None)) is not None:
                self.found[label] = Hit(label, at, 1.0, True)
            else:
                self.found[label] = Hit(label, *self.near[want], False) if want in self.near else None
        hit = self.found[label]
        return hit if hit and hit.like >= least else None

    def hits(self, labels, least: float) -> Iterator[Hit]:
        return (h for label in labels or () if (h := self.find(label, least)))

    def beside(self, h: Hit) -> tuple[str, float, bool]:
        """(value, confidence, whether a delimiter ends the search) on the line of a label."""
        line, want = self.lines[h.line], h.label.lower().strip()
        dash = _DASH.search(line)
        cuts = [(i, i + 1) for i in (line.find(":"), line.find("|")) if i >= 0] + ([dash.span()] if dash else [])
        for a, b in cuts:
            like = ratio(want, line[:a].strip().lower())
            if like >= 0.7:
                return clean(line[b:]), max(h.like, like), True
        return (clean(line[self.low[h.line].find(want) + len(want) :]) if h.exact else ""), h.like, False

    def after(self, i: int, n: int | None = None) -> Iterator[tuple[int, str]]:
        """The lines that follow ``i`` and are more than a label, cleaned."""
        stop = len(self.lines) if n is None else min(i + 1 + n, len(self.lines))
        return ((k, clean(self.lines[k])) for k in range(i + 1, stop) if not label_only(self.lines[k]))


# ---- rules: a reader for each kind, None if nothing was found

RULES: dict[str, Callable[[Doc, dict], Found | None]] = {}


def rule(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        RULES[name] = f
        return f

    return add


def _labels(d: Doc, r: dict) -> Iterator[Hit]:
    return d.hits(r.get("labels"), 0.8)


@rule("label_same_line")
def same_line(d: Doc, r: dict) -> Found | None:
    tried = ((h, *d.beside(h)) for h in _labels(d, r))
    return next((Found(value, confidence=like, pos=h.line) for h, value, like, final in tried if final or value), None)


@rule("label_next_line")
def next_line(d: Doc, r: dict) -> Found | None:
    return next((Found(v, confidence=h.like, pos=i) for h in _labels(d, r) for i, v in d.after(h.line)), None)


@rule("label_same_or_next_line")
def same_or_next_line(d: Doc, r: dict) -> Found | None:
    got = same_line(d, r)
    return got if got and got.value else next_line(d, r)


@rule("between_labels")
def between_labels(d: Doc, r: dict) -> Found | None:
    start, end = ((r.get(k) or "").strip() for k in ("start_label", "end_label"))
    if not (start and end):
        return None
    inside = re.search(rf"{re.escape(start)}\s*:?\s*(.*?)\s*(?={re.escape(end)})", d.text, re.I | re.S)
    if inside and clean(inside[1]):
        return Found(clean(inside[1]), confidence=1.0)
    begins = [t.strip() for t in d.low]
    first = next((i for i, t in enumerate(begins) if t.startswith(start.lower())), None)
    if first is None:
        return Found(confidence=0.0)
    last = next((i for i in range(first + 1, len(begins)) if begins[i].startswith(end.lower())), len(begins))
    value = clean("\n".join(filter(None, map(clean, [d.lines[first].strip()[len(start) :], *d.lines[first + 1 : last]]))))
    return Found(value, confidence=float(bool(value)), pos=first if value else None)


@rule("fixed_line")
def fixed_line(d: Doc, r: dict) -> Found | None:
    if r.get("line_start") and r.get("line_end"):
        first = max(r["line_start"], 1)
        value = "\n".join(filter(None, map(clean, d.raw_lines[first - 1 : max(r["line_end"], first)])))
        return Found(value, confidence=float(bool(value)), pos=min(first, len(d.lines)) - 1 if value and d.lines else None)
    n = r.get("line_number") or 1
    value = clean(d.lines[n - 1]) if 1 <= n <= len(d.lines) else ""
    return Found(value, confidence=1.0, pos=n - 1) if value else None


@rule("fixed_line_label")
def fixed_line_label(d: Doc, r: dict) -> Found | None:
    n = r.get("line_number") or 1
    if not 1 <= n <= len(d.lines):
        return None
    places = ((d.low[n - 1].find(x.lower()), len(x)) for x in r.get("labels") or [])
    return next((Found(clean(d.lines[n - 1][at + size :]), confidence=1.0, pos=n - 1) for at, size in places if at >= 0), None)


@rule("line_offset")
def line_offset(d: Doc, r: dict) -> Found | None:
    k, h = int(r.get("offset") or 0), next(_labels(d, r), None)
    if h is None:
        return None
    side = range(h.line + 1, len(d.lines)) if k > 0 else range(h.line - 1, -1, -1)
    steps = [i for i in side if clean(d.lines[i])][: abs(k)]
    at = steps[-1] if steps else h.line
    return Found(clean(d.lines[at]), confidence=h.like, pos=at)


@rule("regex")
def regex(d: Doc, r: dict) -> Found | None:
    m = re.search(r["pattern"], d.text, re.I | re.M) if r.get("pattern") else None
    return Found(clean(m[min(m.re.groups, 1)]), confidence=1.0) if m else None


@rule("presence")
def presence(d: Doc, r: dict) -> Found | None:
    tokens = [t.strip().lower() for t in r.get("tokens") or [] if t and t.strip()]
    low, yes = d.text.lower(), r.get("value")
    return Found(("Yes" if yes is None else yes) if any(t in low for t in tokens) else r.get("absent_value") or "", confidence=1.0) if tokens else None


@rule("manual")
def manual(d: Doc, r: dict) -> Found | None:
    value = r.get("value") or ""
    return Found(d.as_of.strftime("%d/%m/%Y") if value.strip().lower() == "{today}" else value, confidence=1.0)


@rule("email_date")
def email_date(d: Doc, r: dict) -> Found | None:
    def day(h: Hit) -> str | None:
        m = re.search(r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", d.lines[h.line][max(d.low[h.line].find(h.label.lower()), 0) + (len(h.label) if h.exact else 0) :])
        try:
            return dt.date(*map(int, m.groups())).strftime("%d/%m/%Y") if m else None
        except ValueError:
            return None

    return next((Found(v, confidence=h.like, pos=h.line) for h in _labels(d, r) if (v := day(h))), None)


def apply_rule(d: Doc, r: dict | None) -> Found:
    r = r or {}
    name = r.get("kind") or "label_same_line"
    if name not in RULES:
        return Found(issue="invalid_rule_kind")
    try:
        got = RULES[name](d, r) or Found()
    except Exception:  # a rule of a user must not stop the batch  # noqa: BLE001
        return Found(issue="extraction_failure")
    got.rule_id = r.get("id") or "default"
    return got


# ---- ladders: for each kind of step the extractions it may give, the first counts

_PLATE = re.compile(VRM)


def plate(line: str, context: str | None = None) -> str | None:
    """The first plate of ``line``, None if it is none after all: too short, a word, or the beginning of a postcode."""
    m = _PLATE.search(line)
    if not m:
        return None
    v, near = compact(m[1]), line if context is None else context
    short = len(v) < 5 and not re.fullmatch(r"[A-Z]{1,3}[0-9]{1,3}[A-Z]{1,3}", v)
    return None if short or v in S.NO_PLATES or re.search(rf"\b{re.escape(m[1])}\s*[0-9][ABD-HJLNP-UW-Z]{{2}}\b", near, re.I) else clean(m[1])


def _beside(d: Doc, s: S.Beside) -> Iterator[Found]:
    for h in d.hits(s.labels, S.LEAST):
        own = d.beside(h)[0]
        if own and rejected(own, s.rejects):
            return
        options = [own] * bool(own) + [v for _, v in d.after(h.line, s.reach)]
        yield from (Found(v, s.rule_id, min(s.cap, h.like * s.factor), h.line) for v in options if not rejected(v, s.rejects))


def _plate_beside(d: Doc, s: S.PlateBeside) -> Iterator[Found]:
    return (Found(v, s.rule_id, min(s.cap, h.like * s.factor), i) for h in d.hits(s.labels, S.LEAST) for i, _ in d.after(h.line - 1, s.reach + 1) if (v := plate(d.lines[i])))


def _plate_in_text(d: Doc, s: S.PlateInText) -> Iterator[Found]:
    m = _PLATE.search(d.text)
    if m and (v := plate(m[0], d.text[max(0, m.start() - s.margin) : m.end() + s.margin])):
        yield Found(v, s.rule_id, s.confidence)


@lru_cache(maxsize=200_000)
def _form(s: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", s.lower().replace("’", "'")).split())


def _structured(d: Doc, s: S.Structured) -> Iterator[Found]:
    forms = [_form(x) for x in s.labels]
    for i, line in enumerate(d.lines):
        norm = _form(line)
        own = next((o for o in forms if (o in norm if " " in o else f"{norm} ".startswith(f"{o} "))), None)
        if own is None:
            continue
        whole = clean(line)
        same = clean(line.rpartition(":")[2]) if ":" in line else " ".join(whole.split()[own.count(" ") + 1 :]).strip(" :")
        options = [same] * (same not in ("", whole)) + ([v for _, v in d.after(i, 4)] if label_only(same) else [])
        v = next((v for v in options if not rejected(v, s.rejects)), None)
        if v is not None:
            if not (s.unless and pattern(s.unless).search(v)):
                yield Found(v, s.rule_id, s.confidence, i)
            return


def _lines(d: Doc, s: S.Lines) -> Iterator[Found]:
    def fits(i: int) -> bool:
        low = d.low[i]
        return (not s.words or any(w in low for w in s.words)) and low.startswith(s.begins) and not any(pattern(w).search(d.lines[i]) if w == POSTCODE else w in low for w in s.without)

    def value(line: str) -> str | None:
        if s.plate:
            return plate(line)
        m = next((m for p in s.patterns if (m := pattern(p).search(line))), None)
        v = clean(m[min(m.re.groups, 1)]) if m else None
        return None if v is None or (s.rejects is not None and rejected(v, s.rejects)) or (s.unless and pattern(s.unless).search(v)) else v

    n = len(d.lines)
    return (Found(v, s.rule_id, s.confidence, k) for i in range(min(n, s.head or n)) if fits(i) for k in range(i, min(i + s.reach, n)) if (v := value(d.lines[k])) is not None)


def _labelled(d: Doc, s: S.Labelled) -> Iterator[Found]:
    for i, line in enumerate(d.lines[: s.head]):
        m = pattern(s.label).match(line)
        if m and line[m.end() :].strip():
            if not rejected(line[m.end() :], s.rejects):
                yield Found(clean(line[m.end() :]), s.rule_id, s.confidence, i)
        elif m:
            fit = (x for x in d.after(i, 3) if re.search("[0-9]", x[1]) and pattern(s.fits).search(x[1]) and not x[1].lower().startswith("page "))
            yield from (Found(v, s.next_rule_id, s.next_confidence, k) for k, v in fit)


def _says(d: Doc, s: S.Says) -> Iterator[Found]:
    if pattern(s.pattern).search(d.text.lower()):
        yield Found(s.value, s.rule_id, s.confidence)


def _address_lines(d: Doc, first: int, reach: int, begun: bool) -> Iterator[str]:
    """The lines of an address from ``first`` on, up to its postcode or to what cannot belong to it."""
    for line in map(clean, d.lines[first : first + reach]):
        low = line.lower()
        if (not line and begun) or pattern(DATE).search(line) or low in S.ADDRESS_STOP_WORDS or low.startswith(S.ADDRESS_STOPS):
            return
        if line:
            begun = True
            yield line
        if pattern(POSTCODE).search(line):
            return


def _address_beside(d: Doc, s: S.AddressBeside) -> Iterator[Found]:
    coded = pattern(POSTCODE).search
    for h in d.hits(s.labels, S.LEAST):
        if narrative(d.lines[h.line]):
            continue
        own = d.beside(h)[0]
        rows = [own] * bool(own) + ([] if coded(own) else list(_address_lines(d, h.line + 1, s.reach, bool(own))))
        v = clean("\n".join(rows))
        if v and not narrative(v) and (coded(v) or len(rows) > 1):
            yield Found(v, s.rule_id, min(s.cap, h.like * s.factor), h.line)


def _address_above(d: Doc, s: S.AddressAbove) -> Iterator[Found]:
    at = next((i for i, t in enumerate(d.lines) if pattern(POSTCODE).search(t)), None)
    if at is None:
        return
    above = [v for v in map(clean, d.lines[max(0, at - s.reach) : at]) if v]
    fit = [len(v.split()) <= s.words and not any(x in v.lower() for x in S.ADDRESS_SKIPS) for v in above]
    end = next((k for k in range(len(above), 0, -1) if fit[k - 1]), 0)
    start = next((k for k in range(end, 0, -1) if not fit[k - 1]), 0)
    yield Found(clean("\n".join([*above[max(start, end - s.lines) : end], clean(d.lines[at])])), s.rule_id, s.confidence, at)


STEPS: dict[type, Callable[[Doc, object], Iterator[Found]]] = {
    S.Beside: _beside, S.PlateBeside: _plate_beside, S.PlateInText: _plate_in_text, S.Structured: _structured, S.Lines: _lines, S.Labelled: _labelled, S.Says: _says, S.AddressBeside: _address_beside, S.AddressAbove: _address_above,
}


def climb(d: Doc, name: str) -> Found:
    """What the ladder of a field yields."""
    found = (f for s in S.LADDERS.get(name, ()) for f in STEPS[type(s)](d, s) if f.value)
    return next(found, Found(rule_id=f"fallback_{name}", confidence=0.0))


# ---- normal forms and gates


def _day(p: dict[str, str]) -> dt.date | None:
    month = int(p["m"]) if p["m"].isdigit() else next((i for i, n in enumerate(MONTH_NAMES, 1) if p["m"].lower() in (n, n[:3])), 0)
    year = int(p["y"]) + (0 if len(p["y"]) > 2 else 1900 if int(p["y"]) >= 69 else 2000)
    try:
        return dt.date(year, month, int(p["d"]))
    except ValueError:
        return None


_SHAPES = [re.compile(p) for p in (
    r"(?P<d>\d{1,2})(?P<s>[/-])(?P<m>\d{1,2})(?P=s)(?P<y>\d{4}|\d{2})", r"(?P<d>\d{1,2})-(?P<m>[A-Za-z]{3,9})-(?P<y>\d{4}|\d{2})", r"(?P<d>\d{1,2}) (?P<m>[A-Za-z]{3,9}) (?P<y>\d{4})",
    r"(?P<m>[A-Za-z]{3,9}) (?P<d>\d{1,2}) (?P<y>\d{4})", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})",
)]


@lru_cache(maxsize=50_000)
def norm_date(value: str) -> str:
    raw = value.strip()
    t = re.sub(r"(\d+)\s*(?:st|nd|rd|th)\b", r"\1", raw, flags=re.I)
    t = " ".join(re.sub(r"(\d{1,2}/\d{2})(\d{4})\b", r"\1/\2", re.sub("^[^0-9A-Za-z]+", "", t)).replace(",", " ").split())
    day = next((day for p in _SHAPES if (m := p.fullmatch(t)) and (day := _day(m.groupdict()))), None)
    return f"{day:%d/%m}/{day.year:04d}" if day else raw


def norm_postcode(s: str) -> str:
    v = compact(s)
    return f"{v[:-3]} {v[-3:]}" if len(v) >= 5 else ""


def norm_address(value: str, force: bool = False) -> str:
    rows = [x.strip() for x in re.sub(r"\s*,\s*", "\n", re.sub("\r\n?", "\n", value.strip())).split("\n") if x.strip()]
    codes = list(pattern(POSTCODE).finditer(rows[-1])) if rows else []
    if len(rows) > 1:
        body, code = rows[:-1], norm_postcode(codes[0][0]) if codes else rows[-1]
    elif force and codes:
        m = next((m for m in codes if not rows[0][m.end() :].strip()), codes[0])
        head = rows[0][: m.start()].strip(" ,")
        body, code = [head] * bool(head), norm_postcode(m[0])
    else:
        body, code = rows, ""
    return "\n".join([*body[:4], *[""] * (4 - len(body[:4])), " ".join(body[4:]), code])


def _one_of(value: str, options: dict[str, tuple[str, ...]]) -> str:
    v = value.strip()
    return next((name for name, spellings in options.items() if v.lower() in spellings), v)


def _unit(value: str) -> str:
    low = value.strip().lower()
    return "Miles" if "mi" in low or low == "m" else "Km" if any(k in low for k in ("km", "kilometer", "kilometre")) else value.strip()


def _mileage(value: str) -> str:
    m = re.search("[0-9][0-9,]*", value)
    return m[0].replace(",", "") if m else ""


NORMAL: dict[str, Callable[[str, bool], str]] = {
    "vrm": lambda v, _: compact(v), "mileage": lambda v, _: _mileage(v), "vat_status": lambda v, _: _one_of(v, {"Yes": ("yes", "y", "true", "1"), "No": ("no", "n", "false", "0")}),
    "mileage_unit": lambda v, _: _unit(v), "inspection_address": norm_address, **dict.fromkeys(DATES, lambda v, _: norm_date(v)),
}


def suspicious(name: str, value: str, d: Doc) -> bool:
    """The gate of a field, as ``validate`` states it."""
    g, v = GATES.get(name), clean(value)
    if g is None or (not v and not g.blank):
        return False
    low = v.lower()
    if (g.label and v and label_only(v)) or v in g.values or len(v) < g.least or (g.shape and bool(re.fullmatch(g.shape, v)) == g.shape_is_bad) or any(p in low for p in g.phrases):
        return True
    if g.no_plate:
        own = compact(next(_plate_beside(d, S.LADDERS["vrm"][0]), Found()).value)
        return bool(own) and own in compact(v)
    return bool(g.goes_on) and bool(re.search(rf"\b{re.escape(v)}{g.goes_on}", d.text, re.I))


def extract(d: Doc, rules: dict[str, dict], provider: dict | None = None) -> dict[str, Found]:
    """The thirteen fields of a document: the rule, else the ladder; a suspicious value gives way to the ladder's if that is not suspicious."""
    provider = provider or {}
    force = bool(provider.get("force_postcode_for_inspection_address"))
    normal = lambda name, v: NORMAL[name](v, force) if name in NORMAL else v
    out = {}
    for name in FIELD_ORDER:
        ruled = apply_rule(d, rules.get(name))
        laddered = lru_cache(maxsize=1)(lambda name=name: climb(d, name))
        got = ruled if ruled.value or not laddered().value else laddered()
        value, raw = normal(name, got.value), got.value
        if suspicious(name, value, d):
            other = normal(name, laddered().value)
            if other and not suspicious(name, other, d):
                got, value, raw = laddered(), other, laddered().value
            elif name in BLANKED:
                value = ""
        if name == "work_provider" and not value:
            value = (provider.get("work_provider") or "").strip() or (provider.get("name") or "").strip()
        if name == "inspection_date" and provider.get("use_current_date_for_inspection_date"):
            value = d.as_of.strftime("%d/%m/%Y")
        out[name] = Found(value, got.rule_id, got.confidence, got.pos, raw, ruled.issue)
    return out
