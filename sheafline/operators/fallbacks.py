"""Extraction without rules: the steps of ``ladder`` as Columns, one builder for each kind of step. Each gives an extraction, or null if the step yields nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions import normalize as N
from sheafline.functions.binding import bind
from sheafline.functions.text import DATE, POSTCODE, VRM, clean, is_label_only, is_narrative, is_rejected, label_form
from sheafline.operators import ladder as S
from sheafline.operators.rules import View, at, extraction, located, miss, same_line

def _array(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(x) for x in values))


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda t, i: F.struct(t.alias("t"), i.alias("i")))


def _window(lines: Column, first: Column, n: int) -> Column:
    """The next ``n`` numbered lines from ``first`` on."""
    return F.slice(_numbered(lines), F.greatest(first + 1, F.lit(1)), n)


def _hit(values: Column) -> Column:
    return F.get(F.filter(values, lambda c: c.isNotNull()), F.lit(0))


def bad_vrm(candidate: Column, context: Column) -> Column:
    v = N.vrm(candidate)
    short = (F.length(v) < 5) & ~v.rlike("^[A-Z]{1,3}[0-9]{1,3}[A-Z]{1,3}$")
    goes_on = F.rlike(context, F.concat(F.lit(r"(?i)\b\Q"), candidate, F.lit(r"\E\s*[0-9][ABD-HJLNP-UW-Z]{2}\b")))
    return short | goes_on | v.isin(*S.NO_PLATES)


def _plate(line: Column, pos: Column, rule_id: str, conf: Column | float) -> Column:
    return bind(F.regexp_extract(line, VRM, 1), lambda m: F.when((m != "") & ~bad_vrm(m, line), extraction(clean(m), rule_id, conf, pos)))


def _hits(view: View, labels: tuple[str, ...], read: Callable[[Column], Column]) -> Column:
    """The first of what ``read`` makes of the places of the labels."""
    return _hit(F.transform(_array(labels), lambda name: bind(located(view, name), lambda h: F.when(h.isNotNull() & (h["conf"] >= S.LEAST), read(h)))))


def plate_beside(view: View, s: S.PlateBeside) -> Column:
    def read(h: Column) -> Column:
        near = F.filter(_window(view.lines, h["idx"], s.reach + 1), lambda x: ~is_label_only(x["t"]))
        return _hit(F.transform(near, lambda x: _plate(x["t"], x["i"], s.rule_id, F.least(F.lit(s.cap), h["conf"] * s.factor))))

    return _hits(view, s.labels, read)


def plate_in_text(view: View, s: S.PlateInText) -> Column:
    near = F.regexp_extract(view.text, f"(?s).{{0,{s.margin}}}{VRM}.{{0,{s.margin}}}", 0)
    return bind(near, lambda t: bind(F.regexp_extract(view.text, VRM, 1), lambda m: F.when((m != "") & ~bad_vrm(m, t), extraction(clean(m), s.rule_id, s.confidence))))


def beside(view: View, s: S.Beside) -> Column:
    def read(h: Column) -> Column:
        def chosen(found: Column) -> Column:
            own = F.coalesce(found["value"], F.lit(""))
            later = F.filter(F.transform(F.slice(view.lines, h["idx"] + 2, s.reach), clean), lambda t: (t != "") & ~is_label_only(t))
            options = F.filter(F.concat(F.filter(F.array(own), lambda t: t != ""), later), lambda t: ~is_rejected(t, s.rejects))
            stop = (own != "") & is_rejected(own, s.rejects)
            value = F.coalesce(F.get(options, F.lit(0)), F.lit(""))
            return F.when(stop | (value != ""), F.struct(stop.alias("stop"), value.alias("value"), F.least(F.lit(s.cap), h["conf"] * s.factor).alias("conf"), h["idx"].alias("idx")))

        return bind(same_line(view, h), chosen)

    return bind(_hits(view, s.labels, read), lambda c: F.when(~c["stop"], extraction(c["value"], s.rule_id, c["conf"], c["idx"])))


def structured(view: View, s: S.Structured) -> Column:
    options = _array(tuple(" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in x.lower()).split()) for x in s.labels))

    def read(x: Column) -> Column:
        norm = label_form(x["t"])
        own = lambda o: F.when(o.contains(" "), F.contains(norm, o)).otherwise((norm == o) | F.startswith(norm, F.concat(o, F.lit(" "))))

        def of(o: Column) -> Column:
            words = F.filter(F.split(clean(x["t"]), r"\s+"), lambda w: w != "")
            n = F.size(F.split(o, " "))
            same = F.when(x["t"].contains(":"), clean(F.substring_index(x["t"], ":", -1))).when(F.size(words) > n, clean(F.array_join(F.slice(words, n + 1, F.size(words)), " "))).otherwise("")
            later = F.filter(F.transform(F.slice(view.lines, x["i"] + 2, 4), clean), lambda t: (t != "") & ~is_label_only(t))
            own_value = F.filter(F.array(same), lambda t: (t != "") & (t != clean(x["t"])))
            tries = F.concat(own_value, F.when((same == "") | is_label_only(same), later).otherwise(F.array().cast("array<string>")))
            return F.get(F.filter(tries, lambda t: ~is_rejected(t, s.rejects)), F.lit(0))

        v = bind(F.get(F.filter(options, own), F.lit(0)), lambda o: F.when(o.isNotNull(), of(o)))
        return bind(v, lambda t: F.when(t.isNotNull(), extraction(t, s.rule_id, s.confidence, x["i"])))

    first = _hit(F.transform(_numbered(view.lines), read))
    return first if s.unless is None else bind(first, lambda e: F.when(~e["value"].rlike(s.unless), e))


def in_lines(view: View, s: S.Lines) -> Column:
    def match(x: Column) -> Column:
        def of(pattern: str) -> Column:
            group = 1 if "(" in pattern.replace("(?", "") else 0
            return F.when(x["t"].rlike(pattern), F.regexp_extract(x["t"], pattern, group))

        def judged(m: Column) -> Column:
            ok = m.isNotNull()
            if s.plate:
                ok = ok & ~bad_vrm(m, x["t"])
            if s.rejects is not None:
                ok = ok & ~is_rejected(m, s.rejects)
            if s.unless:
                ok = ok & ~clean(m).rlike(s.unless)
            return F.when(ok, extraction(clean(m), s.rule_id, s.confidence, x["i"]))

        return bind(F.coalesce(*map(of, s.patterns)), judged)

    def read(x: Column) -> Column:
        low, ok = F.lower(x["t"]), F.lit(True)
        if s.words:
            ok = ok & _contains_any(low, s.words)
        for w in s.without:
            ok = ok & ~(x["t"].rlike(w) if w == POSTCODE else low.contains(w))
        if s.begins:
            ok = ok & F.startswith(low, F.lit(s.begins))
        return F.when(ok, match(x) if s.reach == 1 else _hit(F.transform(_window(view.lines, x["i"], s.reach), match)))

    lines = _numbered(view.lines) if s.head is None else F.slice(_numbered(view.lines), 1, s.head)
    return _hit(F.transform(lines, read))


def labelled(view: View, s: S.Labelled) -> Column:
    full, bare = s.label + r"(.+?)\s*$", s.label + "$"

    def next_line(y: Column) -> Column:
        fit = lambda t: t.rlike("[0-9]") & t.rlike(s.fits) & ~is_label_only(t) & ~F.startswith(F.lower(t), F.lit("page "))
        return bind(clean(y["t"]), lambda t: F.when(fit(t), extraction(t, s.next_rule_id, s.next_confidence, y["i"])))

    def read(x: Column) -> Column:
        v = clean(F.regexp_extract(x["t"], full, 1))
        return F.when(x["t"].rlike(full), F.when(~is_rejected(v, s.rejects), extraction(v, s.rule_id, s.confidence, x["i"]))).when(x["t"].rlike(bare), _hit(F.transform(_window(view.lines, x["i"] + 1, 3), next_line)))

    return _hit(F.transform(F.slice(_numbered(view.lines), 1, s.head), read))


def says(view: View, s: S.Says) -> Column:
    return F.when(F.lower(view.text).rlike(s.pattern), extraction(F.lit(s.value), s.rule_id, s.confidence))


def _coded(t: Column) -> Column:
    return t.rlike(POSTCODE)


def address_beside(view: View, s: S.AddressBeside) -> Column:
    def read(h: Column) -> Column:
        def built(found: Column) -> Column:
            own = F.coalesce(found["value"], F.lit(""))
            start = F.struct(F.filter(F.array(own), lambda t: t != "").alias("got"), F.lit(False).alias("done"))

            def step(acc: Column, t: Column) -> Column:
                low = F.lower(t)
                stop = t.rlike(DATE) | low.isin(*S.ADDRESS_STOP_WORDS) | reduce(lambda a, b: a | b, (F.startswith(low, F.lit(p)) for p in S.ADDRESS_STOPS))
                end = acc["done"] | ((t == "") & (F.size(acc["got"]) > 0)) | ((t != "") & stop)
                take = ~end & (t != "")
                return F.struct(F.when(take, F.concat(acc["got"], F.array(t))).otherwise(acc["got"]).alias("got"), (end | (take & _coded(t))).alias("done"))

            got = F.when(_coded(own), start["got"]).otherwise(F.aggregate(F.transform(F.slice(view.lines, h["idx"] + 2, s.reach), clean), start, step)["got"])
            fits = lambda v, g: (v != "") & ~is_narrative(v) & (_coded(v) | (F.size(g) >= 2))
            return bind(got, lambda g: bind(clean(F.array_join(g, "\n")), lambda v: F.when(fits(v, g), extraction(v, s.rule_id, F.least(F.lit(s.cap), h["conf"] * s.factor), h["idx"]))))

        return F.when(~is_narrative(at(view.lines, h["idx"])), bind(same_line(view, h), built))

    return _hits(view, s.labels, read)


def address_above(view: View, s: S.AddressAbove) -> Column:
    def block(x: Column) -> Column:
        before = F.reverse(F.filter(F.transform(F.slice(view.lines, F.greatest(x["i"] - s.reach + 1, F.lit(1)), F.least(x["i"], F.lit(s.reach))), clean), lambda t: t != ""))
        start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("done"))

        def step(acc: Column, t: Column) -> Column:
            unfit = _contains_any(F.lower(t), S.ADDRESS_SKIPS) | (F.size(F.split(t, r"\s+")) > s.words)
            done = acc["done"] | (unfit & (F.size(acc["got"]) > 0)) | (F.size(acc["got"]) >= s.lines)
            return F.struct(F.when(~done & ~unfit, F.concat(F.array(t), acc["got"])).otherwise(acc["got"]).alias("got"), done.alias("done"))

        got = F.aggregate(before, start, step)["got"]
        return F.when(_coded(x["t"]), extraction(clean(F.array_join(F.concat(got, F.array(clean(x["t"]))), "\n")), s.rule_id, s.confidence, x["i"]))

    return _hit(F.transform(_numbered(view.lines), block))


BUILDERS: dict[type, Callable] = {
    S.Beside: beside, S.PlateBeside: plate_beside, S.Structured: structured, S.Lines: in_lines, S.Labelled: labelled, S.PlateInText: plate_in_text, S.Says: says, S.AddressBeside: address_beside, S.AddressAbove: address_above,
}


def fallback(view: View, field: str) -> Column:
    """What the ladder of a field yields; fields without one always miss."""
    return F.coalesce(*(BUILDERS[type(s)](view, s) for s in S.LADDERS.get(field, ())), miss(f"fallback_{field}", 0.0))


def label_plate(view: View) -> Column:
    """The value of the first step for plates, null if it yields none."""
    return plate_beside(view, S.LADDERS["vrm"][0])["value"]
