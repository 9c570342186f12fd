"""SQL of the queries over rules and fallbacks, for DuckDB, put together from the same tables of steps that the queries read."""

from __future__ import annotations

import re

from sheafline.functions import text as X
from sheafline.functions.validate import CLAIMANT_PHRASES, MODEL_PHRASES, REFERENCE_PHRASES
from sheafline.operators import ladder as S

#: White space as Unicode has it, in the words of RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def re2(pattern: str) -> str:
    """A pattern of Java for RE2, as the inside of an SQL string."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, chr(13) || chr(9), '  '), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' :' || chr(10))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '" + w.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for w in words) + ")"


def label_only(x: str) -> str:
    return f"lower({clean(x)}) IN " + names((*X.LABEL_ONLY, ""))


def rejected(x: str, rejects: tuple[str, ...]) -> str:
    return f"(length({clean(x)}) <= 2 OR lower({clean(x)}) IN " + names((*rejects, "")) + ")"


#: c: all lines of each document; u: those that are not blank, repeats numbered by k; l: the clean lines in flat order, later repeats dropped.
ALL_LINES = rf"""WITH d AS (SELECT model_id, regexp_split_to_array(coalesce(plain_text, ''), '{ENDS}') AS a FROM document_models),
e AS (SELECT model_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i FROM d),
c AS (SELECT model_id, i, {strip("translate(t, chr(13) || chr(9), '  ')")} AS t FROM e)"""
FIRST_LINES = ALL_LINES + ", u AS (SELECT model_id, i, t, row_number() OVER (PARTITION BY model_id, lower(t) ORDER BY i) AS k FROM c WHERE t <> '')"
LINES = FIRST_LINES + ", l AS MATERIALIZED (SELECT model_id, t, CAST(row_number() OVER (PARTITION BY model_id ORDER BY i) - 1 AS INTEGER) AS pos FROM u WHERE k = 1)"


def hits(name: str, labels: tuple[str, ...]) -> str:
    """CTE ``name`` (o, b, model_id, pos, t): the first line that holds each label."""
    rows = ", ".join(f"({i}, '" + x.lower().strip().replace("'", "''") + "')" for i, x in enumerate(labels))
    return f"{name}0 AS (SELECT k.o, k.b, l.model_id, min(l.pos) AS pos FROM l JOIN (VALUES {rows}) k(o, b) ON contains(lower(l.t), k.b) GROUP BY ALL), {name} AS (SELECT h.*, l.t FROM {name}0 h JOIN l USING (model_id, pos))"


def _like(left: str) -> str:
    low = f"lower({strip(left)})"
    return f"(contains({low}, b) AND 2.0 * length(b) / (length(b) + length({low})) >= 0.7)"


_DASH = r"^(.*?)\s[-–—]\s(.*)$"
_CUTS = [("contains(t, ':')", "split_part(t, ':', 1)", "substr(t, length(split_part(t, ':', 1)) + 2)"), ("contains(t, '|')", "split_part(t, '|', 1)", "substr(t, length(split_part(t, '|', 1)) + 2)"),
         (f"regexp_matches(t, '{_DASH}')", f"regexp_extract(t, '{_DASH}', 1)", f"regexp_extract(t, '{_DASH}', 2)")]
#: What stands beside the label ``b`` on the line ``t``, and whether a delimiter ends the search.
BESIDE = "CASE " + " ".join(f"WHEN {has} AND {_like(left)} THEN {clean(right)}" for has, left, right in _CUTS) + f" ELSE {clean('substr(t, instr(lower(t), b) + length(b))')} END"
FINAL = "(" + " OR ".join(f"({has} AND {_like(left)})" for has, left, _ in _CUTS) + ")"
EXTRACTION = "model_id, value, rule_id, confidence, CAST(pos AS INTEGER) AS pos"


def rule(ctes: str, value: str = "s", confidence: str = "x.confidence") -> str:
    """The rows of a rule whose extraction is the CTE ``value`` (model_id, value, pos, confidence)."""
    return f"{ctes} SELECT m.model_id, coalesce(x.value, '') AS value, 'default' AS rule_id, CAST({confidence} AS DOUBLE) AS confidence, CAST(x.pos AS INTEGER) AS pos FROM document_models m LEFT JOIN {value} x USING (model_id)"


def _first_by_label(source: str) -> str:
    return f"SELECT model_id, arg_min(value, o) AS value, arg_min(pos, o) AS pos, 1.0 AS confidence FROM {source} GROUP BY 1"


def same_line(labels: tuple[str, ...]) -> str:
    return f"{LINES}, {hits('h', labels)}, s0 AS (SELECT o, model_id, pos, {BESIDE} AS value, {FINAL} AS final FROM h), s AS ({_first_by_label('s0 WHERE final OR value <> chr(39) || chr(39)')})".replace("chr(39) || chr(39)", "''")


def next_line(labels: tuple[str, ...], name: str = "s") -> str:
    return f"{name}1 AS (SELECT h.o, h.model_id, min(l.pos) AS pos FROM {name}h h JOIN l ON l.model_id = h.model_id AND l.pos > h.pos WHERE NOT {label_only('l.t')} GROUP BY ALL), {name}2 AS (SELECT o, model_id, pos, {clean('l.t')} AS value FROM {name}1 JOIN l USING (model_id, pos)), {name} AS ({_first_by_label(f'{name}2')})"


def rule_same_line(labels: tuple[str, ...]) -> str:
    return rule(same_line(labels))


def rule_next_line(labels: tuple[str, ...]) -> str:
    return rule(f"{LINES}, {hits('sh', labels)}, {next_line(labels)}")


def rule_same_or_next(labels: tuple[str, ...]) -> str:
    both = f"{same_line(labels)}, {hits('nh', labels)}, {next_line(labels, 'n')}, z AS (SELECT * FROM s WHERE value <> '' UNION ALL SELECT * FROM n WHERE model_id NOT IN (SELECT model_id FROM s WHERE value <> ''))"
    return rule(both, "z")


def rule_between(start: str, end: str) -> str:
    a, b = start.lower(), end.lower()
    inner = clean(f"regexp_extract(coalesce(plain_text, ''), '(?is){re.escape(start)}\\s*:?\\s*(.*?)\\s*(?:{re.escape(end)})', 1)")
    rows = f"CASE WHEN l.pos = f.pos THEN {clean(f'substr({strip(chr(108) + chr(46) + chr(116))}, {len(start) + 1})')} ELSE {clean('l.t')} END"
    return (
        f"{LINES}, r AS (SELECT model_id, {inner} AS value FROM document_models), f AS (SELECT model_id, min(pos) AS pos FROM l WHERE starts_with(lower(t), '{a}') GROUP BY 1),"
        f" g AS (SELECT f.model_id, min(l.pos) AS stop FROM f JOIN l ON l.model_id = f.model_id AND l.pos > f.pos AND starts_with(lower(l.t), '{b}') GROUP BY 1),"
        f" w AS (SELECT l.model_id, l.pos, f.pos AS first, {rows} AS v FROM f JOIN l USING (model_id) LEFT JOIN g USING (model_id) WHERE l.pos >= f.pos AND l.pos < coalesce(g.stop, 1000000000)),".replace("FROM f JOIN l USING (model_id)", "FROM f JOIN l ON l.model_id = f.model_id").replace("LEFT JOIN g USING (model_id)", "LEFT JOIN g ON g.model_id = f.model_id")
        + f" j AS (SELECT model_id, first, {clean('string_agg(v, chr(10) ORDER BY pos) FILTER (v <> chr(0))')} AS value FROM w GROUP BY ALL),".replace("chr(0)", "''")
        + " s AS (SELECT r.model_id, CASE WHEN r.value <> '' THEN r.value ELSE coalesce(j.value, '') END AS value, CASE WHEN r.value = '' AND coalesce(j.value, '') <> '' THEN j.first END AS pos, CASE WHEN r.value <> '' OR coalesce(j.value, '') <> '' THEN 1.0 ELSE 0.0 END AS confidence FROM r LEFT JOIN j USING (model_id))"
        " SELECT m.model_id, x.value, 'default' AS rule_id, CAST(x.confidence AS DOUBLE) AS confidence, CAST(x.pos AS INTEGER) AS pos FROM document_models m JOIN s x USING (model_id)"
    )


def rule_fixed_range(first: int, last: int) -> str:
    raw = f"list_filter(list_transform(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END[{first}:{last}], lambda x: {clean('x')}), lambda x: x <> '')"
    return (
        f"{LINES}, n AS (SELECT model_id, count(*) AS n FROM l GROUP BY 1), s AS (SELECT model_id, array_to_string({raw}, chr(10)) AS value FROM d)"
        f" SELECT s.model_id, s.value, 'default' AS rule_id, CASE WHEN s.value <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CAST(CASE WHEN s.value <> '' THEN least({first - 1}, n.n - 1) END AS INTEGER) AS pos FROM s LEFT JOIN n USING (model_id)"
    )


def rule_fixed_line(n: int) -> str:
    return rule(f"{LINES}, s AS (SELECT model_id, pos, {clean('t')} AS value, 1.0 AS confidence FROM l WHERE pos = {n - 1} AND {clean('t')} <> '')")


def rule_fixed_label(n: int, labels: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{x.lower()}')" for i, x in enumerate(labels))
    return rule(f"{LINES}, h AS (SELECT k.o, l.model_id, l.pos, {clean('substr(t, instr(lower(t), b) + length(b))')} AS value FROM l JOIN (VALUES {rows}) k(o, b) ON l.pos = {n - 1} AND contains(lower(l.t), k.b)), s AS ({_first_by_label('h')})")


def rule_offset(label: str, k: int) -> str:
    return rule(
        f"{LINES}, {hits('h', (label,))}, f AS (SELECT h.model_id, h.pos AS p, l.pos, {clean('l.t')} AS value, row_number() OVER (PARTITION BY h.model_id ORDER BY l.pos) AS n FROM h JOIN l ON l.model_id = h.model_id AND l.pos > h.pos AND {clean('l.t')} <> ''),"
        f" q AS (SELECT model_id, arg_max(value, n) AS value, max(pos) AS pos FROM f WHERE n <= {k} GROUP BY 1), s AS (SELECT h.model_id, coalesce(q.value, {clean('h.t')}) AS value, coalesce(q.pos, h.pos) AS pos, 1.0 AS confidence FROM h LEFT JOIN q USING (model_id))"
    )


def rule_email_date(labels: tuple[str, ...]) -> str:
    day = r"try_strptime(nullif(regexp_extract(substr(t, instr(lower(t), b) + length(b)), '\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})', 1), ''), '%Y-%m-%d')"
    return rule(f"{LINES}, {hits('h', labels)}, v AS (SELECT o, model_id, pos, strftime({day}, '%d/%m/%Y') AS value FROM h), s AS ({_first_by_label('v WHERE value IS NOT NULL')})")


# ---- fallbacks: a CTE for each step, (model_id, value, rule_id, confidence, pos)

PLATE_CORE = re2(re.sub(r"\(\?!\w+\\b\)", "", X.VRM))


def _plate(t: str, context: str) -> str:
    """The first plate of ``t``, null if it is none: RE2 cannot look ahead, so plates that begin with a forbidden word are taken out."""
    m = f"list_filter(regexp_extract_all({t}, '{PLATE_CORE}', 1), lambda x: NOT regexp_matches(x, '(?i)^(?:VAT|TEL|REF)\\b'))[1]"
    v = f"upper(regexp_replace({m}, '{WS}+', '', 'g'))"
    bad = f"(length({v}) < 5 AND NOT regexp_matches({v}, '^[A-Z]{{1,3}}[0-9]{{1,3}}[A-Z]{{1,3}}$')) OR {v} IN {names(S.NO_PLATES)} OR regexp_matches({context}, '(?i)\\b' || regexp_escape({m}) || '\\s*[0-9][ABD-HJLNP-UW-Z]{{2}}\\b')"
    return f"CASE WHEN {m} IS NOT NULL AND NOT ({bad}) THEN {clean(m)} END"


def _row(name: str, source: str, s, value: str = "value", confidence: str | None = None, rule_id: str | None = None) -> str:
    return f"{name} AS (SELECT model_id, {value} AS value, '{rule_id or s.rule_id}' AS rule_id, CAST({confidence or s.confidence} AS DOUBLE) AS confidence, pos FROM {source})"


def _step(name: str, s) -> str:
    """The CTEs of a step; the last has its name."""
    if isinstance(s, S.Beside):
        later = f"SELECT b.o, b.model_id, l.pos - b.pos AS r, {clean('l.t')} AS v FROM {name}b b JOIN l ON l.model_id = b.model_id AND l.pos BETWEEN b.pos + 1 AND b.pos + {s.reach} WHERE NOT {label_only('l.t')}"
        return (
            f"{hits(name + 'h', s.labels)}, {name}b AS (SELECT o, model_id, pos, {BESIDE} AS own FROM {name}h), {name}v AS (SELECT o, model_id, arg_min(v, r) AS v FROM (SELECT o, model_id, 0 AS r, own AS v FROM {name}b WHERE own <> '' UNION ALL {later}) WHERE NOT {rejected('v', s.rejects)} GROUP BY ALL),"
            f" {name}d AS (SELECT b.o, b.model_id, b.pos, own <> '' AND {rejected('own', s.rejects)} AS stop, coalesce(v.v, '') AS v FROM {name}b b LEFT JOIN {name}v v USING (o, model_id)), {name}f AS (SELECT model_id, arg_min(stop, o) AS stop, arg_min(v, o) AS value, arg_min(pos, o) AS pos FROM {name}d WHERE stop OR v <> '' GROUP BY 1), "
            + _row(name, f"{name}f WHERE NOT stop", s, confidence=str(min(s.cap, s.factor)))
        )
    if isinstance(s, S.PlateBeside):
        return (
            f"{hits(name + 'h', s.labels)}, {name}p AS (SELECT h.o, h.model_id, l.pos, {_plate('l.t', 'l.t')} AS value FROM {name}h h JOIN l ON l.model_id = h.model_id AND l.pos BETWEEN h.pos AND h.pos + {s.reach} WHERE NOT {label_only('l.t')}),"
            f" {name}f AS (SELECT model_id, arg_min(value, o * 1000000 + pos) AS value, arg_min(pos, o * 1000000 + pos) AS pos FROM {name}p WHERE value IS NOT NULL GROUP BY 1), " + _row(name, f"{name}f", s, confidence=str(min(s.cap, s.factor)))
        )
    if isinstance(s, S.PlateInText):
        # the text is cut in three at the first plate that no forbidden word begins
        first = f"list_filter(regexp_extract_all(coalesce(plain_text, ''), '{PLATE_CORE}', 1), lambda x: NOT regexp_matches(x, '(?i)^(?:VAT|TEL|REF)\\b'))[1]"
        at = "regexp_extract(plain_text, '(?is)^(.*?)\\b' || regexp_escape(m) || '\\b', 1)"
        near = f"right({at}, {s.margin}) || substr(plain_text, length({at}) + 1, length(m) + {s.margin})"
        return f"{name}m AS (SELECT model_id, plain_text, {first} AS m FROM document_models), {name}n AS (SELECT model_id, m, {near} AS near FROM {name}m WHERE m IS NOT NULL), {name}f AS (SELECT model_id, NULL AS pos, {_plate('m', 'near')} AS value FROM {name}n), " + _row(name, f"{name}f WHERE value IS NOT NULL", s)
    if isinstance(s, S.Structured):
        forms = [" ".join(re.sub("[^a-z0-9]+", " ", x.lower()).split()) for x in s.labels]
        options = "[" + ", ".join(f"'{f}'" for f in forms) + "]"
        norm = "trim(regexp_replace(replace(lower(t), '’', ''''), '[^a-z0-9]+', ' ', 'g'))"
        own = f"list_filter({options}, lambda o: CASE WHEN contains(o, ' ') THEN contains(norm, o) ELSE norm = o OR starts_with(norm, o || ' ') END)[1]"
        words = f"list_filter(regexp_split_to_array({clean('t')}, '\\s+'), lambda w: w <> '')"
        n = "len(string_split(own, ' '))"
        same = f"CASE WHEN contains(t, ':') THEN {clean('string_split(t, chr(58))[-1]')} WHEN len({words}) > {n} THEN {clean(f'array_to_string({words}[{n} + 1:], chr(32))')} ELSE '' END"
        later = f"SELECT b.model_id, b.pos, l.pos - b.pos AS r, {clean('l.t')} AS v FROM {name}s b JOIN l ON l.model_id = b.model_id AND l.pos BETWEEN b.pos + 1 AND b.pos + 4 WHERE {label_only('b.same')} AND NOT {label_only('l.t')}"
        unless = f" AND NOT regexp_matches(value, '{re2(s.unless)}')" if s.unless else ""
        return (
            f"{name}n AS (SELECT *, {norm} AS norm FROM l), {name}o AS (SELECT *, {own} AS own FROM {name}n), {name}s AS (SELECT model_id, pos, t, {same} AS same FROM {name}o WHERE own IS NOT NULL),"
            f" {name}v AS (SELECT model_id, pos, arg_min(v, r) AS value FROM (SELECT model_id, pos, 0 AS r, same AS v FROM {name}s WHERE same <> '' AND same <> {clean('t')} UNION ALL {later}) WHERE NOT {rejected('v', s.rejects)} GROUP BY ALL),"
            f" {name}f AS (SELECT model_id, arg_min(value, pos) AS value, min(pos) AS pos FROM {name}v GROUP BY 1), " + _row(name, f"{name}f WHERE true{unless}", s)
        )
    if isinstance(s, S.Lines):
        fit = [f"l.pos < {s.head}"] * (s.head is not None) + [any_of("lower(l.t)", s.words)] * bool(s.words) + [f"starts_with(lower(l.t), '{s.begins}')"] * bool(s.begins)
        fit += [f"NOT regexp_matches(l.t, '{re2(w)}')" if w == X.POSTCODE else f"NOT contains(lower(l.t), '{w}')" for w in s.without]
        one = lambda p: f"WHEN regexp_matches(k.t, '{re2(p)}') THEN {clean(chr(32) + f'regexp_extract(k.t, {chr(39)}{re2(p)}{chr(39)}, {1 if chr(40) in p.replace(chr(40) + chr(63), str()) else 0})')}"
        value = _plate("k.t", "k.t") if s.plate else "CASE " + " ".join(map(one, s.patterns)) + " END"
        good = "value IS NOT NULL" + (f" AND NOT {rejected('value', s.rejects)}" if s.rejects is not None else "") + (f" AND NOT regexp_matches(value, '{re2(s.unless)}')" if s.unless else "")
        return (
            f"{name}k AS (SELECT l.model_id, l.pos AS i, k.pos, {value} AS value FROM l JOIN l k ON k.model_id = l.model_id AND k.pos BETWEEN l.pos AND l.pos + {s.reach - 1} WHERE {' AND '.join(fit or ['true'])}),"
            f" {name}f AS (SELECT model_id, arg_min(value, i * 1000 + pos - i) AS value, arg_min(pos, i * 1000 + pos - i) AS pos FROM {name}k WHERE {good} GROUP BY 1), " + _row(name, f"{name}f", s)
        )
    if isinstance(s, S.Labelled):
        full, bare = re2(s.label) + r"(.+?)\s*$", re2(s.label) + "$"
        own = f"SELECT model_id, pos AS i, 0 AS r, pos, {clean(f'regexp_extract(t, {chr(39)}{full}{chr(39)}, 1)')} AS value, '{s.rule_id}' AS rule_id, {s.confidence} AS confidence FROM l WHERE pos < {s.head} AND regexp_matches(t, '{full}')"
        later = f"SELECT h.model_id, h.pos AS i, l.pos - h.pos AS r, l.pos, {clean('l.t')} AS value, '{s.next_rule_id}' AS rule_id, {s.next_confidence} AS confidence FROM l h JOIN l ON l.model_id = h.model_id AND l.pos BETWEEN h.pos + 1 AND h.pos + 3 WHERE h.pos < {s.head} AND regexp_matches(h.t, '{bare}') AND NOT regexp_matches(h.t, '{full}') AND NOT {label_only('l.t')} AND regexp_matches({clean('l.t')}, '[0-9]') AND regexp_matches({clean('l.t')}, '{s.fits}') AND NOT starts_with(lower({clean('l.t')}), 'page ')"
        order = "i * 1000 + r"
        return f"{name}k AS ({own} AND NOT {rejected(f'regexp_extract(t, {chr(39)}{full}{chr(39)}, 1)', s.rejects)} UNION ALL {later}), {name} AS (SELECT model_id, arg_min(value, {order}) AS value, arg_min(rule_id, {order}) AS rule_id, CAST(arg_min(confidence, {order}) AS DOUBLE) AS confidence, arg_min(pos, {order}) AS pos FROM {name}k GROUP BY 1)"
    if isinstance(s, S.Says):
        # a border of words as Unicode has it: RE2's own knows only ASCII
        border = r"(?:^|$|[^\p{L}\p{N}_])"
        p = re.sub(r"\\b", lambda _: border, s.pattern)
        return _row(name, f"(SELECT model_id, NULL AS pos FROM document_models WHERE regexp_matches(lower(coalesce(plain_text, '')), '{p}'))", s, value=f"'{s.value}'")
    if isinstance(s, S.AddressBeside):
        low = f"lower({clean('l.t')})"
        coded = lambda x: f"regexp_matches({x}, '{re2(X.POSTCODE)}')"
        stop = f"(regexp_matches({clean('l.t')}, '{re2(X.DATE)}') OR {low} IN {names(S.ADDRESS_STOP_WORDS)} OR " + " OR ".join(f"starts_with({low}, '{p}')" for p in S.ADDRESS_STOPS) + ")"
        return (
            f"{hits(name + 'h', s.labels)}, {name}b AS (SELECT o, model_id, pos, {BESIDE} AS own FROM {name}h WHERE NOT {any_of('lower(t)', X.NARRATIVE)}),"
            # lines of the window, where the first that ends the address stands, where the first postcode
            f" {name}w AS (SELECT b.o, b.model_id, l.pos - b.pos AS r, {clean('l.t')} AS v, ({clean('l.t')} <> '' AND {stop}) AS bad, {coded(clean('l.t'))} AS code FROM {name}b b JOIN l ON l.model_id = b.model_id AND l.pos BETWEEN b.pos + 1 AND b.pos + {s.reach} WHERE NOT {coded('b.own')}),"
            f" {name}e AS (SELECT *, min(CASE WHEN bad OR (v = '' AND (SELECT x.own FROM {name}b x WHERE x.o = w.o AND x.model_id = w.model_id) <> '') THEN r END) OVER p AS ended, min(CASE WHEN code THEN r END) OVER p AS coded FROM {name}w w WINDOW p AS (PARTITION BY o, model_id)),"
            f" {name}r AS (SELECT o, model_id, string_agg(v, chr(10) ORDER BY r) AS more, count(*) AS n FROM {name}e WHERE v <> '' AND r < coalesce(ended, 99) AND r <= coalesce(coded, 99) GROUP BY ALL),"
            f" {name}j AS (SELECT b.o, b.model_id, b.pos, {clean('concat_ws(chr(10), nullif(b.own, chr(0)), r.more)')} AS value, (b.own <> '')::INT + coalesce(r.n, 0) AS n FROM {name}b b LEFT JOIN {name}r r USING (o, model_id)),".replace("chr(0)", "''")
            + f" {name}f AS (SELECT model_id, arg_min(value, o) AS value, arg_min(pos, o) AS pos FROM {name}j WHERE value <> '' AND NOT {any_of('lower(value)', X.NARRATIVE)} AND ({coded('value')} OR n >= 2) GROUP BY 1), " + _row(name, f"{name}f", s, confidence=str(min(s.cap, s.factor)))
        )
    assert isinstance(s, S.AddressAbove)
    unfit = f"({any_of('lower(v)', S.ADDRESS_SKIPS)} OR len(regexp_split_to_array(v, '\\s+')) > {s.words})"
    return (
        f"{name}c AS (SELECT model_id, min(pos) AS pos FROM l WHERE regexp_matches(t, '{re2(X.POSTCODE)}') GROUP BY 1), {name}w AS (SELECT c.model_id, c.pos AS p, l.pos, {clean('l.t')} AS v FROM {name}c c JOIN l ON l.model_id = c.model_id AND l.pos BETWEEN c.pos - {s.reach} AND c.pos - 1),"
        f" {name}u AS (SELECT *, {unfit} AS unfit FROM {name}w WHERE v <> ''), {name}t AS (SELECT *, max(CASE WHEN NOT unfit THEN pos END) OVER (PARTITION BY model_id) AS last FROM {name}u), {name}x AS (SELECT *, max(CASE WHEN unfit AND pos < last THEN pos END) OVER (PARTITION BY model_id) AS bar FROM {name}t),"
        f" {name}y AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY pos DESC) AS k FROM {name}x WHERE pos <= last AND pos > coalesce(bar, -1)), {name}a AS (SELECT model_id, string_agg(v, chr(10) ORDER BY pos) AS above FROM {name}y WHERE k <= {s.lines} GROUP BY 1),"
        f" {name}f AS (SELECT c.model_id, c.pos, {clean(f'concat_ws(chr(10), a.above, {clean(chr(108) + chr(46) + chr(116))})')} AS value FROM {name}c c JOIN l USING (model_id, pos) LEFT JOIN {name}a a USING (model_id)), " + _row(name, f"{name}f", s)
    )


def fallback(field: str) -> str:
    steps = S.LADDERS[field]
    parts = [_step(f"q{i}", s) for i, s in enumerate(steps)]
    union = " UNION ALL ".join(f"SELECT {i} AS step, model_id, value, rule_id, confidence, pos FROM q{i}" for i in range(len(steps)))
    pick = ", ".join(f"arg_min({c}, step) AS {c}" for c in ("value", "rule_id", "confidence")) + ", arg_min(coalesce(pos, -1), step) AS pos"
    return (
        f"{LINES}, {', '.join(parts)}, z AS (SELECT model_id, {pick} FROM ({union}) WHERE value <> '' GROUP BY 1)"
        f" SELECT m.model_id, coalesce(z.value, '') AS value, coalesce(z.rule_id, 'fallback_{field}') AS rule_id, coalesce(z.confidence, 0.0::DOUBLE) AS confidence, CAST(nullif(z.pos, -1) AS INTEGER) AS pos FROM document_models m LEFT JOIN z USING (model_id)"
    )


# ---- gates over extracted values


def gate(field: str) -> str:
    v = clean("coalesce(e.value, '')")
    label = f"({v} <> '' AND {label_only(v)})"
    tests = {
        "reference": f"{v} <> '' AND ({label} OR regexp_full_match({v}, '[A-Za-z!?]{{1,10}}') OR {any_of(f'lower({v})', REFERENCE_PHRASES)})",
        "claimant_name": f"{v} <> '' AND ({label} OR regexp_full_match({v}, '(?i)[A-Z]{{1,3}}[0-9]{{1,3}}\\s?[A-Z]{{3}}') OR {any_of(f'lower({v})', CLAIMANT_PHRASES)})",
        "vehicle_model": f"{label} OR {v} IN (',', '.', '-') OR length({v}) <= 1 OR coalesce(p.plate <> '' AND contains(upper(regexp_replace({v}, '{WS}+', '', 'g')), p.plate), false) OR {any_of(f'lower({v})', MODEL_PHRASES)}",
        "vrm": f"{v} <> '' AND ((length({v}) < 5 AND NOT regexp_full_match({v}, '[A-Z]{{1,3}}[0-9]{{1,3}}[A-Z]{{1,3}}')) OR coalesce(regexp_matches(m.plain_text, '(?i)\\b' || regexp_escape({v}) || '\\s*[0-9][A-Z]{{2}}\\b'), false))",
        "inspection_address": f"{v} <> '' AND {any_of(f'lower({v})', X.NARRATIVE)}",
        "incident_date": f"{v} <> '' AND NOT regexp_full_match({v}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')",
    }
    value = "upper(regexp_replace(coalesce(value, ''), '" + WS + "+', '', 'g'))" if field == "vrm" else "value"
    return f"""WITH e AS (SELECT record_id, model_id, {value} AS value FROM field_extractions WHERE field_key = '{field}'),
p AS (SELECT model_id, max(upper(regexp_replace(coalesce(value, ''), '{WS}+', '', 'g'))) AS plate FROM field_extractions WHERE field_key = 'vrm' GROUP BY 1)
SELECT e.record_id, e.value, ({tests[field]}) AS suspicious FROM e LEFT JOIN document_models m USING (model_id) LEFT JOIN p USING (model_id)"""
