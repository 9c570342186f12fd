"""Normal forms of field values as Column expressions. Null counts as empty; the result is never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.binding import bind
from sheafline.functions.text import POSTCODE, strip

#: Date formats in the order they are tried, with the shapes that admit them.
_MONTHS = r"[A-Za-z]{3,9}"
FORMATS = (
    ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("d/M/yy", r"\d{1,2}/\d{1,2}/\d{2}"), ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"), ("d-M-yy", r"\d{1,2}-\d{1,2}-\d{2}"),
    ("d-MMM-yyyy", rf"\d{{1,2}}-{_MONTHS}-\d{{4}}"), ("d-MMM-yy", rf"\d{{1,2}}-{_MONTHS}-\d{{2}}"), ("d MMM yyyy", rf"\d{{1,2}} {_MONTHS} \d{{4}}"), ("MMM d yyyy", rf"{_MONTHS} \d{{1,2}} \d{{4}}"), ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"),
)
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def vrm(c: Column) -> Column:
    return F.upper(F.regexp_replace(_text(c), r"(?U)\s+", ""))


def mileage(c: Column) -> Column:
    """The first run of digits, commas inside it left out."""
    return F.replace(F.regexp_extract(_text(c), "([0-9][0-9,]*)", 1), F.lit(","), F.lit(""))


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda c, m: c.when((low == m[1]) | (low == m[1][:3]), m[0]), enumerate(MONTH_NAMES[1:], 2), F.when((low == MONTH_NAMES[0]) | (low == MONTH_NAMES[0][:3]), 1))


def date(c: Column) -> Column:
    """``dd/mm/yyyy`` if one of the formats reads the value, else the value without outer white space. Two-digit years from 69 on are of the last century."""
    raw = strip(_text(c))
    t = F.regexp_replace(raw, r"(?i)([0-9]+)\s*(?:st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, "^[^0-9A-Za-z]+", ""), r"([0-9]{1,2}/[0-9]{2})([0-9]{4})\b", "$1/$2")
    t = strip(F.regexp_replace(F.replace(t, F.lit(","), F.lit(" ")), r"\s+", " "))

    def read(x: Column) -> Column:
        out = F.lit(None).cast("date")
        for fmt, shape in FORMATS:
            parts = F.split(x, "[/ -]")
            y, m, d = {"d": (2, 1, 0), "M": (2, 0, 1), "y": (0, 1, 2)}[fmt[0]]
            part = lambda i: F.get(parts, F.lit(i))
            n = part(y).try_cast("int")
            year = F.when(F.length(part(y)) == 2, n + F.when(n >= 69, 1900).otherwise(2000)).otherwise(n)
            month = _month_number(part(m)) if "MMM" in fmt else part(m).try_cast("int")
            got = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(d), 2, "0"))
            out = F.coalesce(out, F.when(x.rlike(f"^{shape}$") & month.isNotNull(), got.try_cast("date")))
        return out

    return bind(F.struct(raw.alias("raw"), t.alias("t")), lambda s: bind(read(s["t"]), lambda d: F.coalesce(F.date_format(d, "dd/MM/yyyy"), s["raw"])))


def vat_status(c: Column) -> Column:
    v = strip(_text(c))
    low = F.lower(v)
    return F.when(low.isin("yes", "y", "true", "1"), "Yes").when(low.isin("no", "n", "false", "0"), "No").otherwise(v)


def mileage_unit(c: Column) -> Column:
    v = strip(_text(c))
    low = F.lower(v)
    return F.when(low.contains("mi") | (low == "m"), "Miles").when(low.contains("km") | low.contains("kilometer") | low.contains("kilometre"), "Km").otherwise(v)


def postcode(c: Column) -> Column:
    """``OUT INW``; empty for less than five characters."""
    v = vrm(c)
    return F.when(F.length(v) < 5, "").otherwise(F.concat(F.substr(v, F.lit(1), F.length(v) - 3), F.lit(" "), F.right(v, F.lit(3))))


def address(c: Column, force_postcode: Column | bool = False) -> Column:
    """Six lines: up to five of body, the last for the postcode.

    Of several lines the last one gives the sixth: its postcode, or all of it if it has none. One line alone keeps
    its postcode unless ``force_postcode``; then the postcode is taken out and what follows it is lost.
    """
    force = force_postcode if isinstance(force_postcode, Column) else F.lit(force_postcode)
    t = F.regexp_replace(F.regexp_replace(strip(_text(c)), "\r\n?", "\n"), r"\s*,\s*", "\n")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")

    def six(a: Column) -> Column:
        n = F.size(a)
        last = F.coalesce(F.get(a, n - 1), F.lit(""))
        code = F.regexp_extract(last, f"({POSTCODE})", 1)
        at_end = F.regexp_extract(last, f"({POSTCODE})\\s*$", 1)
        single = n == 1
        one = F.when(at_end != "", at_end).otherwise(code)
        cut = F.btrim(F.substr(last, F.lit(1), F.greatest(F.when(at_end != "", F.length(F.regexp_replace(last, f"{POSTCODE}\\s*$", ""))).otherwise(F.instr(last, code) - 1), F.lit(0))), F.lit(" ,"))
        taken = single & force & (one != "")
        body = F.when(taken, F.filter(F.array(cut), lambda x: x != "")).when(single, a).otherwise(F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
        sixth = F.when(taken, postcode(one)).when(single, "").when(code != "", postcode(code)).otherwise(last)

        def lay(s: Column) -> Column:
            b = s["body"]
            at = lambda i: F.coalesce(F.get(b, F.lit(i)), F.lit(""))
            fifth = F.array_join(F.slice(b, 5, F.greatest(F.size(b) - 4, F.lit(0))), " ")
            return F.concat_ws("\n", at(0), at(1), at(2), at(3), fifth, s["sixth"])

        return F.when(n == 0, "\n" * 5).otherwise(bind(F.struct(body.alias("body"), sixth.alias("sixth")), lay))

    return bind(lines, six)


NORMALISERS = {
    "vrm": vrm, "mileage": mileage, "incident_date": date, "instruction_date": date, "inspection_date": date, "vat_status": vat_status, "mileage_unit": mileage_unit, "inspection_address": address,
}
