"""Extraction rules: each kind is a builder of one Column over a document.

A document is seen through a ``View``: its clean lines (array of strings, in flat order), its plain text, its raw lines.
Labels are found as they are written, all in the JVM; misspelt ones are the business of ``batch``. Every builder returns
``struct<value, rule_id, confidence, pos>``; ``pos`` is the flat position of the line the value stands on, null where a
kind has none. A miss has the value ``''``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.binding import bind
from sheafline.functions.text import clean, is_label_only, strip

KINDS: dict[str, Callable[[View, dict, str], Column]] = {}


class View:
    def __init__(self, lines: Column, text: Column, raw_lines: Column, as_of: Column | None = None):
        self.lines, self.text, self.raw_lines = lines, text, raw_lines
        self.as_of = as_of if as_of is not None else F.current_date()


def kind(name: str) -> Callable:
    """Registers a builder for a kind of rule; users may add their own."""

    def add(f: Callable) -> Callable:
        KINDS[name] = f
        return f

    return add


def extraction(value: Column, rule_id: str | Column, confidence: Column | float | None, pos: Column | None = None) -> Column:
    lit = lambda x, t: x if isinstance(x, Column) else F.lit(x).cast(t)
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), lit(rule_id, "string").alias("rule_id"), lit(confidence, "double").alias("confidence"), (pos if pos is not None else F.lit(None)).cast("int").alias("pos"))


def miss(rule_id: str, confidence: float | None = None) -> Column:
    return extraction(F.lit(""), rule_id, confidence)


def first_of(candidates: Column, fallback: Column) -> Column:
    """The first struct of an array with a value that is not empty, else ``fallback``."""
    return F.coalesce(F.get(F.filter(candidates, lambda c: c["value"] != ""), F.lit(0)), fallback)


def at(lines: Column, i: Column) -> Column:
    return F.get(lines, i)


def located(view: View, label: Column) -> Column:
    """struct<label, idx, conf> of the first line that contains a label; null if none does."""
    where = F.array_position(F.transform(view.lines, lambda t: F.contains(F.lower(t), F.lower(strip(label)))), True)
    return F.when(where > 0, F.struct(label.alias("label"), (where - 1).cast("int").alias("idx"), F.lit(1.0).alias("conf")))


def same_line(view: View, hit: Column) -> Column:
    """struct<value, confidence, final> beside a located label. ``final``: a delimiter was found, so that even an empty value ends the search.

    The left side of a delimiter must resemble the label by 0.7. If it contains the label, the similarity is
    2|label| / (|label| + |left|), so exact hits need no comparison in Python.
    """
    line = at(view.lines, hit["idx"])
    label = F.lower(strip(hit["label"]))

    def after(left: Column, right: Column) -> Column:
        low = F.lower(strip(left))
        like = F.when(F.contains(low, label), 2 * F.length(label) / (F.length(label) + F.length(low)))
        return F.when(like >= 0.7, F.struct(clean(right).alias("value"), F.greatest(hit["conf"], like).alias("confidence"), F.lit(True).alias("final")))

    def cut(sign: str) -> Column:
        left = F.substring_index(line, sign, 1)
        return F.when(line.contains(sign), after(left, F.substr(line, F.length(left) + 2)))

    dash = r"^(.*?)\s[-–—]\s(.*)$"
    by_dash = F.when(line.rlike(dash), after(F.regexp_extract(line, dash, 1), F.regexp_extract(line, dash, 2)))
    tail = F.substr(line, F.instr(F.lower(line), label) + F.length(label))
    plain = F.struct(clean(tail).alias("value"), hit["conf"].alias("confidence"), F.lit(False).alias("final"))
    return F.coalesce(cut(":"), cut("|"), by_dash, plain)


def _labels(rule: dict) -> Column:
    names = [x for x in rule.get("labels") or [] if x and x.strip()]
    return F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")


def _by_label(view: View, rule: dict, rule_id: str, read: Callable[[Column], Column], threshold: float = 0.8) -> Column:
    """The first label in order for which ``read`` gives a struct that is not null."""
    tried = F.transform(_labels(rule), lambda n: bind(located(view, n), lambda h: F.when(h.isNotNull() & (h["conf"] >= threshold), read(h))))
    return F.coalesce(F.get(F.filter(tried, lambda c: c.isNotNull()), F.lit(0)), miss(rule_id))


@kind("label_same_line")
def label_same_line(view: View, rule: dict, rule_id: str) -> Column:
    def read(h: Column) -> Column:
        return bind(same_line(view, h), lambda s: F.when(s["final"] | (s["value"] != ""), extraction(s["value"], rule_id, s["confidence"], h["idx"])))

    return _by_label(view, rule, rule_id, read)


@kind("label_next_line")
def label_next_line(view: View, rule: dict, rule_id: str) -> Column:
    def read(h: Column) -> Column:
        later = F.transform(view.lines, lambda t, i: F.struct(clean(t).alias("v"), i.alias("i")))
        hit = F.get(F.filter(later, lambda x: (x["i"] > h["idx"]) & (x["v"] != "") & ~is_label_only(x["v"])), F.lit(0))
        return F.when(hit.isNotNull(), extraction(hit["v"], rule_id, h["conf"], hit["i"]))

    return _by_label(view, rule, rule_id, read)


@kind("label_same_or_next_line")
def label_same_or_next_line(view: View, rule: dict, rule_id: str) -> Column:
    return first_of(F.array(label_same_line(view, rule, rule_id)), label_next_line(view, rule, rule_id))


@kind("between_labels")
def between_labels(view: View, rule: dict, rule_id: str) -> Column:
    start, end = (strip_text(rule.get(k)) for k in ("start_label", "end_label"))
    if not start or not end:
        return miss(rule_id)
    by_regex = clean(F.regexp_extract(view.text, rf"(?isu){re.escape(start)}\s*:?\s*(.*?)\s*(?={re.escape(end)})", 1))
    low = F.transform(view.lines, lambda t: F.lower(strip(t)))
    first = F.array_position(F.transform(low, lambda t: F.startswith(t, F.lit(start.lower()))), True)
    rest = F.slice(view.lines, F.greatest(first + 1, F.lit(1)), F.size(view.lines))
    stop = F.array_position(F.transform(F.slice(low, F.greatest(first + 1, F.lit(1)), F.size(low)), lambda t: F.startswith(t, F.lit(end.lower()))), True)
    inner = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
    head = F.substr(strip(at(view.lines, (first - 1).cast("int"))), F.lit(len(start) + 1))
    joined = clean(F.array_join(F.filter(F.transform(F.concat(F.array(head), inner), clean), lambda t: t != ""), "\n"))
    by_lines = F.when(first > 0, extraction(joined, rule_id, F.when(joined != "", 1.0).otherwise(0.0), F.when(joined != "", first - 1)))
    return F.when(by_regex != "", extraction(by_regex, rule_id, 1.0)).otherwise(F.coalesce(by_lines, miss(rule_id, 0.0)))


def strip_text(s: str | None) -> str:
    return (s or "").strip()


@kind("fixed_line")
def fixed_line(view: View, rule: dict, rule_id: str) -> Column:
    a, b = rule.get("line_start"), rule.get("line_end")
    if a and b:
        first = max(a, 1)
        rows = F.filter(F.transform(F.slice(view.raw_lines, first, max(b, first) - first + 1), clean), lambda t: t != "")
        v = F.array_join(rows, "\n")
        span = F.least(F.lit(first - 1), F.size(view.lines) - 1)
        return extraction(v, rule_id, F.when(v != "", 1.0).otherwise(0.0), F.when((v != "") & (span >= 0), span))
    n = rule.get("line_number") or 1
    v = clean(at(view.lines, F.lit(n - 1))) if n >= 1 else F.lit("")
    return F.when(F.coalesce(v, F.lit("")) != "", extraction(v, rule_id, 1.0, F.lit(n - 1))).otherwise(miss(rule_id))


@kind("fixed_line_label")
def fixed_line_label(view: View, rule: dict, rule_id: str) -> Column:
    n = rule.get("line_number") or 1
    line = at(view.lines, F.lit(n - 1)) if n >= 1 else F.lit(None).cast("string")

    def read(name: Column) -> Column:
        where = F.instr(F.lower(line), F.lower(name))
        return F.when(where > 0, clean(F.substr(line, where + F.length(name))))

    v = F.get(F.filter(F.transform(_labels(rule), read), lambda x: x.isNotNull()), F.lit(0))
    return F.when(v.isNotNull(), extraction(v, rule_id, 1.0, F.lit(n - 1))).otherwise(miss(rule_id))


@kind("line_offset")
def line_offset(view: View, rule: dict, rule_id: str) -> Column:
    """Steps count lines that are not blank; beyond the ends the last one seen is taken, or the label's own."""
    k = int(rule.get("offset") or 0)

    def read(h: Column) -> Column:
        if k == 0:
            return extraction(clean(at(view.lines, h["idx"])), rule_id, h["conf"], h["idx"])
        filled = F.filter(F.transform(view.lines, lambda t, i: F.struct(clean(t).alias("v"), i.alias("i"))), lambda x: x["v"] != "")
        side = F.filter(filled, lambda x: (x["i"] > h["idx"]) if k > 0 else (x["i"] < h["idx"]))
        side = side if k > 0 else F.reverse(side)
        hit = F.get(side, F.least(F.lit(abs(k)), F.size(side)) - 1)
        return F.when(F.size(side) > 0, extraction(hit["v"], rule_id, h["conf"], hit["i"])).otherwise(extraction(clean(at(view.lines, h["idx"])), rule_id, h["conf"], h["idx"]))

    return _by_label(view, rule, rule_id, read)


def java_pattern(pattern: str) -> tuple[str, int]:
    """A user's pattern for Java, and the group that holds the value. Raises ``re.error`` if it is no pattern."""
    groups = re.compile(pattern).groups
    return "(?imu)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)), 1 if groups else 0


@kind("regex")
def regex(view: View, rule: dict, rule_id: str) -> Column:
    pattern, group = java_pattern(rule.get("pattern") or "")
    if not rule.get("pattern"):
        return miss(rule_id)
    v = clean(F.regexp_extract(view.text, pattern, group))
    return F.when(view.text.rlike(pattern), extraction(v, rule_id, 1.0)).otherwise(miss(rule_id))


@kind("presence")
def presence(view: View, rule: dict, rule_id: str) -> Column:
    tokens = [t.strip().lower() for t in rule.get("tokens") or [] if t and t.strip()]
    if not tokens:
        return miss(rule_id)
    low = F.lower(view.text)
    hit = F.exists(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(low, t))
    yes, no = rule.get("value"), rule.get("absent_value")
    return extraction(F.when(hit, F.lit("Yes" if yes is None else yes)).otherwise(F.lit(no or "")), rule_id, 1.0)


@kind("manual")
def manual(view: View, rule: dict, rule_id: str) -> Column:
    v = rule.get("value") or ""
    if v.strip().lower() == "{today}":
        return extraction(F.date_format(view.as_of, "dd/MM/yyyy"), rule_id, 1.0)
    return extraction(F.lit(v), rule_id, 1.0)


@kind("email_date")
def email_date(view: View, rule: dict, rule_id: str) -> Column:
    def read(h: Column) -> Column:
        line = at(view.lines, h["idx"])
        tail = F.substr(line, F.instr(F.lower(line), F.lower(h["label"])) + F.length(h["label"]))
        d = F.try_to_date(F.nullif(F.regexp_extract(tail, r"\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1), F.lit("")), "yyyy-M-d")
        return F.when(d.isNotNull(), extraction(F.date_format(d, "dd/MM/yyyy"), rule_id, h["conf"], h["idx"]))

    return _by_label(view, rule, rule_id, read)


def build(view: View, rule: dict | None) -> tuple[Column, str | None]:
    """(extraction, code of an error found while planning); unknown kinds and broken patterns give a miss without rule_id."""
    rule = rule or {}
    name, rule_id = rule.get("kind") or "label_same_line", rule.get("id") or "default"
    if name not in KINDS:
        return extraction(F.lit(""), F.lit(None).cast("string"), None), "invalid_rule_kind"
    try:
        return KINDS[name](view, rule, rule_id), None
    except (re.error, ValueError, TypeError):
        return extraction(F.lit(""), F.lit(None).cast("string"), None), "extraction_failure"


def labels_of(rules: dict[str, dict]) -> list[str]:
    """The labels that a set of rules looks for."""
    return list(dict.fromkeys(x for r in rules.values() for x in (r or {}).get("labels") or [] if x and x.strip()))
