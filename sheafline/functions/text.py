"""Text primitives as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

#: Patterns of postcodes, dates and plates, words that are only labels, phrases of narratives in addresses.
#: They hold for Java and for Python alike, so blanks are spelled out (Java's \s knows only those of ASCII).
_S = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
POSTCODE = rf"\b[A-Za-z]{{1,2}}[0-9][A-Za-z0-9]?{_S}*[0-9][ABD-HJLNP-UW-Zabd-hjlnp-uw-z]{{2}}\b"
DATE = (
    rf"(?i)\b(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{1,2}}(?:st|nd|rd|th)?{_S}+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*{_S}+[0-9]{{2,4}}"
    r"|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\b"
)
VRM = rf"(?i)\b(?!VAT\b)(?!TEL\b)(?!REF\b)([A-Z]{{2}}[0-9]{{2}}{_S}?[A-Z]{{3}}|[A-Z][0-9]{{1,3}}{_S}?[A-Z]{{3}}|[A-Z]{{3}}{_S}?[0-9]{{1,3}}[A-Z]?|[A-Z]{{1,3}}{_S}?[0-9]{{1,4}})\b"
LABEL_ONLY = (
    "name", "model", "make/model", "make", "vehicle", "registration", "reg", "reference", "ref", "date", "client", "claimant", "our client", "our insured", "your ref", "our ref", "post code", "postcode",
)
NARRATIVE = (
    "introducer", "i have advised", "please make arrangements", "please arrange", "provide a report", "recovery of damages", "circumstances of the accident",
    "\ntele:", "\ntel:", "\nmobile", "\nvehicle:", "\nreg:",
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Tabs and returns to blanks, runs of blanks and of line feeds shortened, ends freed of blanks, colons and line feeds."""
    c = F.regexp_replace(F.translate(c, "\r\t", "  "), " {2,}", " ")
    return F.btrim(F.regexp_replace(c, "\n{3,}", "\n\n"), F.lit(" :\n"))


def search_form(c: Column) -> Column:
    """Lower case, signs to blanks, one blank between words."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\n ]+", " "), "[\n ]+", " "))


def label_form(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(F.lower(c), F.lit("’"), F.lit("'")), "[^a-z0-9]+", " "))


def strip_html(c: Column) -> Column:
    """The text of an HTML fragment; entities that no built-in decodes are left to ``sources.markup``."""
    for a, b in (("\x91", "'"), ("\x92", "'"), ("\x93", '"'), ("\x94", '"'), ("\x96", "-"), ("\x97", "-"), ("\x85", "...")):
        c = F.replace(c, F.lit(a), F.lit(b))
    # what is not shown leaves a blank, so that the words on either side stay apart
    for hidden in (r"(?is)<style[^>]*>.*?</style\s*>", r"(?is)<script[^>]*>.*?</script\s*>", "(?s)<!--.*?-->", r"(?i)<\?xml[^>]*\?>", "(?i)<!doctype[^>]*>"):
        c = F.regexp_replace(c, hidden, " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</td\s*>", "\t"), "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&pound;", "£"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    c = F.replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), F.lit("\x00"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def looks_like_html(c: Column) -> Column:
    return F.lower(F.substring(F.ltrim(c), 1, 200)).rlike(r"<html|<body|<!doctype|<o:p|<v:")


def safe_filename(c: Column) -> Column:
    """Never null or empty: what is left of nothing is ``export``."""
    c = F.replace(strip(F.regexp_replace(c, "[^A-Za-z0-9._ -]", "")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("export"))


def source_stem(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)[^\p{Alnum}._-]", "_")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("document"))


def split_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda t: F.btrim(F.regexp_replace(t, "[\r\n]", ""))), lambda t: t != "")


def two_labels(c: Column) -> Column:
    """struct(start, end) of ``a||b``, or of the first two lines that are not blank, else of two empty strings."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda t: t != "")
    bars = F.split(c, r"\|\|", 2)
    pick = lambda a, i: strip(F.coalesce(F.get(a, F.lit(i)), F.lit("")))
    many = F.size(lines) >= 2
    first = F.when(c.contains("||"), pick(bars, 0)).when(many, pick(lines, 0)).otherwise("")
    second = F.when(c.contains("||"), pick(bars, 1)).when(many, pick(lines, 1)).otherwise("")
    return F.struct(first.alias("start"), second.alias("end"))


def ordinal_date(c: Column) -> Column:
    """``15/04/2026`` as ``15th April 2026``; anything else stays."""
    d = F.try_to_date(F.when(c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), c), "d/M/yyyy")
    n = F.dayofmonth(d)
    suffix = F.when(n.between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.when(d.isNotNull(), F.concat(n.cast("string"), suffix, F.date_format(d, " MMMM yyyy"))).otherwise(c)


def address_lines(c: Column) -> Column:
    """At most six lines, split at line feeds or, without any, at commas."""
    parts = F.when(c.contains("\n"), F.split(c, "\n")).otherwise(F.split(c, ","))
    return F.slice(F.filter(F.transform(parts, strip), lambda t: t != ""), 1, 6)


def address_block(c: Column) -> Column:
    """Three slots: of more lines the first, the second and the last."""
    a = address_lines(c)
    at = lambda i: F.coalesce(F.get(a, F.lit(i)), F.lit(""))
    return F.array(at(0), at(1), F.when(F.size(a) > 3, F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))).otherwise(at(2)))


def is_label_only(c: Column) -> Column:
    return F.lower(clean(c)).isin(*LABEL_ONLY) | (clean(c) == "")


def is_rejected(c: Column, rejects: tuple[str, ...] = ()) -> Column:
    v = F.lower(clean(c))
    return (F.length(v) <= 2) | (v.isin(*rejects) if rejects else F.lit(False))


def is_narrative(c: Column) -> Column:
    low = F.lower(c)
    out = low.contains(NARRATIVE[0])
    for p in NARRATIVE[1:]:
        out = out | low.contains(p)
    return out


def split_lines(c: Column) -> Column:
    """Lines at any line end, without a last empty one."""
    a = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)


def line_structs(c: Column, keep_first: bool = True) -> Column:
    """array<struct<text, line_index>> of the lines that are not blank; line_index counts all lines. With ``keep_first`` later repeats (without regard to case) are dropped."""
    rows = F.transform(split_lines(c), lambda t, i: F.struct(strip(F.translate(t, "\r\t", "  ")).alias("text"), i.alias("line_index")))
    rows = F.filter(rows, lambda x: x["text"] != "")
    if not keep_first:
        return rows
    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<text:string,line_index:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x["text"])
        new = ~F.array_contains(acc["seen"], low)
        return F.struct(
            F.when(new, F.concat(acc["seen"], F.array(low))).otherwise(acc["seen"]).alias("seen"),
            F.when(new, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(rows, empty, step)["out"]


def is_human(c: Column) -> Column:
    """A line that people would write: of usual length, printable, with letters or at least four digits and few odd signs."""
    size = F.length(c)
    count = lambda kind: size - F.length(F.regexp_replace(c, f"[{kind}]", ""))
    letters, digits = count(r"\p{L}"), count(r"\p{Nd}")
    odd = F.length(F.regexp_replace(c, r"[\p{L}\p{N}\p{Z}\s.,:;/_()&'@£#-]", ""))
    printable = ~c.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]")
    return size.between(2, 220) & printable & (letters + digits >= 2) & ((letters > 0) | (digits >= 4)) & (odd <= F.greatest(F.lit(3), F.floor(size / 8)))
