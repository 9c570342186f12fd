"""The queries of the core, by name, and the SQL they are held against (DuckDB on the same tables)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import normalize as N
from sheafline.functions import text as X
from sheafline.functions.similarity import similarity
from sheafline.functions.validate import issues_of, suspicious
from sheafline.operators import catalog as C
from sheafline.operators import detect as D
from sheafline.operators import fallbacks as K
from sheafline.operators import record as R
from sheafline.operators import rules as U
from sheafline.operators.ladder import LADDERS
from sheafline.operators.timestamps import date_cases, dates_of, estimate_zones, find_dates
from sheafline.plans import core_sql as Q
from sheafline.schema import FIELD_ORDER, FIELDS, REQUIRED
from sheafline.session import table
from sheafline.sinks import exports
from sheafline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The day that stands for today, so that results do not depend on the day of a run.
AS_OF = dt.date(2026, 4, 15)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_models").select("model_id", "plain_text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return R.documents_of(_models(spark, d))


def _raw(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return table(spark, d, "field_extractions").where(F.col("field_key").isin(*fields)).select("record_id", "field_key", "raw_value")


# ---- problem 1


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fe, fx, models = (table(spark, d, n) for n in ("field_extractions", "expected_fixtures", "document_models"))
    return find_dates(fe, fx, models).select("record_id", "normal_form")  # a time without any zone is no case here


@query()
def p1_zone_sources(spark: SparkSession, d: str) -> DataFrame:
    """How many dates are placed by which knowledge of their zone."""
    got = dates_of(*(table(spark, d, n) for n in ("field_extractions", "expected_fixtures", "document_models")), estimate_missing=True)
    return got.groupBy("field", "zone_from").agg(F.count("*").alias("cases"))


@query()
def p1_zones(spark: SparkSession, d: str) -> DataFrame:
    """For each zone that offices state, the zone that the times of their instructions alone would suggest: estimated against known."""
    cases = date_cases(*(table(spark, d, n) for n in ("field_extractions", "expected_fixtures", "document_models")))
    own = cases.where((F.col("field") == "instruction_date") & F.col("sent_at").isNotNull())
    zones = tuple(sorted(r[0] for r in own.where("tz_name is not null").select("tz_name").distinct().limit(1_000).collect()))  # names of zones: about 600 exist
    return estimate_zones(own, "tz_name", "spelling", order="record_id", sent="sent_at", arrived="arrived_at", zones=zones)


# ---- text primitives

_STRIP = r"' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0'"
_CLEAN = "trim(regexp_replace(regexp_replace(translate({0}, chr(13) || chr(9), '  '), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' :' || chr(10))"


@query(f"SELECT record_id, {_CLEAN.format('raw_value')} AS cleaned FROM field_extractions WHERE raw_value IS NOT NULL")
def clean_val(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_extractions").where("raw_value is not null").select("record_id", X.clean(F.col("raw_value")).alias("cleaned"))


@query("SELECT provider_id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS label, regexp_replace(lower(name), '[^a-z0-9_ ]+', ' ', 'g') AS low FROM provider_catalog")
def label_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "provider_catalog").select("provider_id", X.label_form(F.col("name")).alias("label"), F.regexp_replace(F.lower("name"), "[^a-z0-9_ ]+", " ").alias("low"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\n ]+', ' ', 'g'), '[\\n ]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL")
def search_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.search_form(F.col("text")).alias("norm"))


@query("SELECT model_id, coalesce(nullif(replace(trim(regexp_replace(source_path, '[^A-Za-z0-9._ -]', '', 'g')), ' ', '_'), ''), 'export') AS name FROM document_models")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_models").select("model_id", X.safe_filename(F.col("source_path")).alias("name"))


@query(Q.ALL_LINES + " SELECT model_id, CAST(i AS INTEGER) AS line_index, t AS text FROM c WHERE t <> ''")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _models(spark, d).select("model_id", F.explode(X.line_structs(F.col("plain_text"), keep_first=False)).alias("x"))
    return rows.select("model_id", "x.line_index", "x.text")


@query(Q.FIRST_LINES + " SELECT model_id, CAST(i AS INTEGER) AS line_index, t AS text FROM u WHERE k = 1")
def line_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("model_id", F.explode(X.line_structs(F.col("plain_text"))).alias("x")).select("model_id", "x.line_index", "x.text")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS has_props FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNotNull().alias("has_props"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN day(l_shipdate) IN (1, 21, 31) THEN day(l_shipdate) || 'st' WHEN day(l_shipdate) IN (2, 22) THEN day(l_shipdate) || 'nd' WHEN day(l_shipdate) IN (3, 23) THEN day(l_shipdate) || 'rd' ELSE day(l_shipdate) || 'th' END || strftime(l_shipdate, ' %B %Y') AS worded FROM lineitem")
def date_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.ordinal_date(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("worded"))


_HTML = "'<!doctype html><html><style>p {x: y}</style><!-- c > d --><p>' || replace(coalesce(plain_text, ''), chr(10), '</p><br/>') || chr(133) || '<script>1</script></td>&pound;&nbsp;</html>'"
_SQL_HTML = _HTML
for _a, _b in (("chr(133)", "'...'"), ("chr(145)", "''''"), ("chr(146)", "''''"), ("chr(147)", "'\"'"), ("chr(148)", "'\"'"), ("chr(150)", "'-'"), ("chr(151)", "'-'")):
    _SQL_HTML = f"replace({_SQL_HTML}, {_a}, {_b})"
for _a, _b in ((r"(?is)<style[^>]*>.*?</style\s*>", "' '"), (r"(?is)<script[^>]*>.*?</script\s*>", "' '"), ("(?s)<!--.*?-->", "' '"), (r"(?i)<\?xml[^>]*\?>", "' '"), ("(?i)<!doctype[^>]*>", "' '"), (r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "chr(10)"), (r"(?i)</td\s*>", "chr(9)"), ("<[^>]+>", "' '")):
    _SQL_HTML = f"regexp_replace({_SQL_HTML}, '{_a}', {_b}, 'g')"
for _a, _b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&pound;", "'£'"), ("&amp;", "'&'")):
    _SQL_HTML = f"replace({_SQL_HTML}, '{_a}', {_b})"
_SQL_HTML = Q.strip(f"regexp_replace(regexp_replace(replace({_SQL_HTML}, chr(160), ' '), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')")


@query(f"SELECT model_id, regexp_matches(lower(substr(ltrim({_HTML}), 1, 200)), '<html|<body|<!doctype|<o:p|<v:') AS is_html, {_SQL_HTML} AS text FROM document_models")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.coalesce("plain_text", F.lit("")), F.lit("\n"), F.lit("</p><br/>"))
    h = F.concat(F.lit("<!doctype html><html><style>p {x: y}</style><!-- c > d --><p>"), text, F.lit("\x85<script>1</script></td>&pound;&nbsp;</html>"))
    return _models(spark, d).select("model_id", h.alias("h")).select("model_id", X.looks_like_html(F.col("h")).alias("is_html"), X.strip_html(F.col("h")).alias("text"))


_COUNT = "(length(t) - length(regexp_replace(t, '[{0}]', '', 'g')))"
_LETTERS, _DIGITS = _COUNT.format(r"\p{L}"), _COUNT.format(r"\p{Nd}")
_SQL_HUMAN = (
    r"length(t) BETWEEN 2 AND 220 AND NOT regexp_matches(t, '[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}]') AND NOT regexp_matches(replace(t, ' ', ''), '\p{Zs}') AND " + f"{_LETTERS} + {_DIGITS} >= 2 AND ({_LETTERS} > 0 OR {_DIGITS} >= 4)"
    r" AND length(regexp_replace(t, '[\p{L}\p{N}\p{Z}\s.,:;/_()&''@£#-]', '', 'g')) <= greatest(3, length(t) // 8)"
)


@query(Q.ALL_LINES + f" SELECT model_id, CAST(i AS INTEGER) AS line_index, ({_SQL_HUMAN}) AS human FROM c WHERE t <> ''")
def human_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _models(spark, d).select("model_id", F.explode(X.line_structs(F.col("plain_text"), keep_first=False)).alias("x"))
    return rows.select("model_id", "x.line_index", X.is_human(F.col("x.text")).alias("human"))


@query()
def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "work_provider").select("record_id", F.round(similarity(F.lower("raw_value"), F.lit("hollin gate law")), 6).alias("ratio"))


# ---- normal forms

_VRM = "upper(regexp_replace(coalesce(raw_value, ''), '\\s+', '', 'g'))"


@query(f"SELECT record_id, {_VRM} AS vrm FROM field_extractions WHERE field_key = 'vrm'")
def norm_vrm(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "vrm").select("record_id", N.vrm(F.col("raw_value")).alias("vrm"))


@query("SELECT record_id, replace(regexp_extract(coalesce(raw_value, ''), '[0-9][0-9,]*', 0), ',', '') AS mileage FROM field_extractions WHERE field_key = 'mileage'")
def norm_mileage(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "mileage").select("record_id", N.mileage(F.col("raw_value")).alias("mileage"))


_SQL_DATE = r"""
WITH a AS (SELECT record_id, trim(coalesce(raw_value, ''), ' ' || chr(9) || chr(10) || chr(13)) AS raw FROM field_extractions WHERE field_key IN ('incident_date', 'instruction_date', 'inspection_date')),
b AS (SELECT record_id, raw, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(raw, '([0-9]+)\s*(?:st|nd|rd|th)\b', '\1', 'gi'), '^[^0-9A-Za-z]+', ''), '([0-9]{1,2}/[0-9]{2})([0-9]{4})\b', '\1/\2', 'g'), ',', ' '), '\s+', ' ', 'g')) AS t FROM a),
c AS (SELECT record_id, raw, CASE
 WHEN regexp_full_match(t, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN try_strptime(t, '%d/%m/%Y') WHEN regexp_full_match(t, '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}') THEN try_strptime(t, '%d-%m-%Y')
 WHEN regexp_full_match(t, '[0-9]{1,2}([/-])[0-9]{1,2}[/-][0-9]{2}') THEN try_strptime(regexp_replace(replace(t, '-', '/'), '/([0-9]{2})$', CASE WHEN right(t, 2) >= '69' THEN '/19\1' ELSE '/20\1' END), '%d/%m/%Y')
 WHEN regexp_full_match(t, '[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}') THEN try_strptime(t, '%d-%b-%Y') WHEN regexp_full_match(t, '[0-9]{1,2}-[A-Za-z]{4,9}-[0-9]{4}') THEN try_strptime(t, '%d-%B-%Y')
 WHEN regexp_full_match(t, '[0-9]{1,2} [A-Za-z]{3} [0-9]{4}') THEN try_strptime(t, '%d %b %Y') WHEN regexp_full_match(t, '[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}') THEN try_strptime(t, '%d %B %Y')
 WHEN regexp_full_match(t, '[A-Za-z]{3} [0-9]{1,2} [0-9]{4}') THEN try_strptime(t, '%b %d %Y') WHEN regexp_full_match(t, '[A-Za-z]{4,9} [0-9]{1,2} [0-9]{4}') THEN try_strptime(t, '%B %d %Y')
 WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(t, '%Y-%m-%d') END AS d FROM b)
SELECT record_id, coalesce(strftime(d, '%d/%m/%Y'), raw) AS day FROM c
"""


@query(_SQL_DATE)
def norm_date(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "incident_date", "instruction_date", "inspection_date").select("record_id", N.date(F.col("raw_value")).alias("day"))


@query("SELECT record_id, CASE WHEN lower(trim(v)) IN ('yes', 'y', 'true', '1') THEN 'Yes' WHEN lower(trim(v)) IN ('no', 'n', 'false', '0') THEN 'No' ELSE trim(v) END AS vat FROM (SELECT record_id, coalesce(raw_value, '') AS v FROM field_extractions WHERE field_key = 'vat_status')")
def norm_vat(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "vat_status").select("record_id", N.vat_status(F.col("raw_value")).alias("vat"))


@query("SELECT record_id, CASE WHEN lower(v) LIKE '%mi%' OR lower(trim(v)) = 'm' THEN 'Miles' WHEN lower(v) LIKE '%km%' OR lower(v) LIKE '%kilomet_r%' THEN 'Km' ELSE trim(v) END AS unit FROM (SELECT record_id, coalesce(raw_value, '') AS v FROM field_extractions WHERE field_key = 'mileage_unit')")
def norm_unit(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "mileage_unit").select("record_id", N.mileage_unit(F.col("raw_value")).alias("unit"))


_POST = r"\b[A-Za-z]{1,2}[0-9][A-Za-z0-9]?\s*[0-9][ABD-HJLNP-UW-Zabd-hjlnp-uw-z]{2}\b"


@query(f"SELECT record_id, CASE WHEN length(c) < 5 THEN '' ELSE substr(c, 1, length(c) - 3) || ' ' || right(c, 3) END AS code FROM (SELECT record_id, upper(regexp_replace(regexp_extract(coalesce(raw_value, ''), '{_POST}', 0), '\\s+', '', 'g')) AS c FROM field_extractions WHERE field_key = 'inspection_address')")
def postcode(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "inspection_address").select("record_id", N.postcode(F.regexp_extract(F.coalesce("raw_value", F.lit("")), X.POSTCODE, 0)).alias("code"))


_SQL_ADDRESS = rf"""
WITH a AS (SELECT record_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(raw_value, '')), '\s*,\s*', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM field_extractions WHERE field_key = 'inspection_address'),
b AS (SELECT record_id, l, len(l) AS n, coalesce(l[-1], '') AS last, upper(regexp_replace(regexp_extract(coalesce(l[-1], ''), '{_POST}', 0), '\s+', '', 'g')) AS c FROM a),
e AS (SELECT record_id, CASE WHEN n <= 1 THEN l ELSE l[1:n-1] END AS body, CASE WHEN n <= 1 THEN '' WHEN c <> '' THEN substr(c, 1, length(c) - 3) || ' ' || right(c, 3) ELSE last END AS s FROM b)
SELECT record_id, coalesce(body[1], '') || chr(10) || coalesce(body[2], '') || chr(10) || coalesce(body[3], '') || chr(10) || coalesce(body[4], '') || chr(10) || coalesce(array_to_string(body[5:], ' '), '') || chr(10) || s AS address FROM e
"""


@query(_SQL_ADDRESS)
def norm_address(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "inspection_address").select("record_id", N.address(F.col("raw_value")).alias("address"))


# ---- checks


def _values(spark: SparkSession, d: str) -> DataFrame:
    fe = table(spark, d, "field_extractions").groupBy("model_id", "field_key").agg(F.max("value").alias("value"))
    return fe.groupBy("model_id").pivot("field_key", list(FIELD_ORDER)).agg(F.first("value"))


_BLANK = lambda f: f"trim({f}) = ''"
_BAD_DATE = lambda f: f"(NOT regexp_full_match({f}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') OR try_strptime({f}, '%d/%m/%Y') IS NULL)"
_ISSUES = [(f, "missing_required_field", _BLANK(f)) for f in FIELD_ORDER if f in REQUIRED]
_ISSUES += [(f, "invalid_date_format", f"NOT {_BLANK(f)} AND {_BAD_DATE(f)}") for f in ("incident_date", "instruction_date", "inspection_date")]
_ISSUES += [(f, code, f"NOT {_BLANK(f)} AND NOT ({ok})") for f, code, ok in (
    ("vrm", "invalid_vrm", "regexp_full_match(upper(regexp_replace(vrm, '\\s+', '', 'g')), '[A-Z0-9]{2,8}')"), ("mileage", "invalid_mileage", "regexp_full_match(mileage, '[0-9]+')"),
    ("vat_status", "invalid_vat", "vat_status IN ('Yes', 'No')"), ("mileage_unit", "invalid_mileage_unit", "mileage_unit IN ('Miles', 'Km')"),
)]
_WIDE = "v AS (SELECT model_id, field_key, max(value) AS value FROM field_extractions GROUP BY ALL), w AS (SELECT model_id, " + ", ".join(f"coalesce(max(value) FILTER (field_key = '{f}'), '') AS {f}" for f in FIELD_ORDER) + " FROM v GROUP BY model_id)"


@query(f"WITH {_WIDE} SELECT model_id, concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{f}:{code}' END" for f, code, test in _ISSUES) + ") AS issues FROM w")
def validate_issues(spark: SparkSession, d: str) -> DataFrame:
    i = _values(spark, d).select("model_id", issues_of({f: F.col(f) for f in FIELD_ORDER}).alias("i"))
    return i.select("model_id", F.array_join(F.transform("i", lambda x: F.concat(x["field"], F.lit(":"), x["code"])), "|").alias("issues"))


@query(f"WITH {_WIDE} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, '{code}' AS code, '{'error' if code == 'missing_required_field' else 'warning'}' AS severity, count(*) AS n FROM w WHERE {test}" for f, code, test in _ISSUES) + ") WHERE n > 0")
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    w = _values(spark, d)
    return w.select(F.explode(issues_of({f: F.col(f) for f in FIELD_ORDER})).alias("x")).groupBy("x.field", "x.code", "x.severity").agg(F.count("*").alias("n"))


# ---- detection

_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\n ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_HIT = "((lower(trim(q)) <> '' AND contains(m.low, lower(trim(q)))) OR (" + _NORM.format("q") + " <> '' AND contains(m.norm, " + _NORM.format("q") + ")))"
_SQL_DETECT = rf"""
WITH m AS (SELECT model_id, lower(plain_text) AS low, {_NORM.format("plain_text")} AS norm FROM document_models),
p AS (SELECT provider_id, coalesce(priority, 0) AS priority, coalesce(detect.required_phrases, []) AS req, coalesce(detect.optional_phrases, []) AS opt, coalesce(detect.negative_phrases, []) AS neg,
 coalesce(detect.minimum_confidence, 0.75) AS least FROM provider_catalog WHERE coalesce(enabled, true)),
s AS (SELECT m.model_id, p.provider_id, p.priority, len(req) AS n_req, least, CASE WHEN len(opt) = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * (len(list_filter(opt, lambda q: {_HIT})) / len(opt)) END AS conf
 FROM m, p WHERE len(list_filter(req, lambda q: NOT {_HIT})) = 0 AND len(list_filter(neg, lambda q: {_HIT})) = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY conf DESC, priority DESC, n_req DESC, provider_id) AS r FROM s WHERE conf >= least)
SELECT m.model_id, k.provider_id, round(coalesce(k.conf, 0.0), 6) AS confidence FROM m LEFT JOIN k ON m.model_id = k.model_id AND k.r = 1
"""


_SQL_BEST = _SQL_DETECT.partition("SELECT m.model_id, k.provider_id")[0] + " SELECT m.model_id, k.provider_id, coalesce(c.name, 'Unknown / Unmapped') AS provider_name, round(coalesce(k.conf, 0.0), 6) AS confidence, coalesce(k.terms, '') AS terms FROM m LEFT JOIN k ON m.model_id = k.model_id AND k.r = 1 LEFT JOIN provider_catalog c ON c.provider_id = k.provider_id"
_SQL_BEST = _SQL_BEST.replace("AS conf\n", f"AS conf, array_to_string(list_concat(req, list_filter(opt, lambda q: {_HIT})), '|') AS terms\n", 1)


def _best(df: DataFrame) -> DataFrame:
    return df.select("model_id", "provider_id", "provider_name", F.round("confidence", 6).alias("confidence"), F.array_join("matched_terms", "|").alias("terms"))


@query(_SQL_BEST)
def detect_providers(spark: SparkSession, d: str) -> DataFrame:
    return _best(D.detect(_models(spark, d), table(spark, d, "provider_catalog")))


@query(_SQL_BEST)
def detect_by_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The plan for large catalogs, here in blocks of ten providers."""
    return _best(D.detect_blocks(_models(spark, d), table(spark, d, "provider_catalog"), block=10))


_SQL_EXPLAIN = _SQL_DETECT.partition("s AS (")[0] + f"""x AS (SELECT m.model_id, p.*, list_filter(req, lambda q: {_HIT}) AS hr, list_filter(opt, lambda q: {_HIT}) AS ho, list_filter(neg, lambda q: {_HIT}) AS hn FROM m, p)
SELECT model_id, provider_id, array_to_string(list_concat(hr, ho), '|') AS matched_terms, coalesce(array_to_string(list_filter(req, lambda q: NOT list_contains(hr, q)), '|'), '') AS missing_terms, coalesce(array_to_string(hn, '|'), '') AS rejected_terms,
 len(hr) = len(req) AND len(hn) = 0 AND CASE WHEN len(opt) = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * (len(ho) / len(opt)) END >= least AS eligible FROM x WHERE len(hr) + len(ho) + len(hn) > 0
"""


@query(_SQL_EXPLAIN)
def detect_explain(spark: SparkSession, d: str) -> DataFrame:
    c = D.candidates(_models(spark, d), table(spark, d, "provider_catalog"), "model_id")
    return c.select("model_id", "provider_id", *(F.array_join(t, "|").alias(t) for t in ("matched_terms", "missing_terms", "rejected_terms")), "eligible")


@query("SELECT model_id, coalesce(provider_id, (SELECT min(provider_id) FROM provider_catalog)) AS used FROM (" + _SQL_DETECT + ")")
def detect_unmatched(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "provider_catalog")
    return D.resolve(D.detect(_models(spark, d), c), c, "first").select("model_id", F.col("used_provider").alias("used"))


# ---- rules, exact path


def _rule(spark: SparkSession, d: str, rule: dict) -> DataFrame:
    e, _ = U.build(R.view_of(as_of=F.lit(AS_OF)), rule)
    return _docs(spark, d).select("model_id", e.alias("e")).select("model_id", *(F.col(f"e.{c}").alias(c) for c in ("value", "rule_id", "confidence", "pos")))


@query(Q.rule_same_line(("Odometer",)))
def rule_same_line(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "label_same_line", "labels": ["Odometer"]})


@query(Q.rule_next_line(("Incident date",)))
def rule_next_line(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "label_next_line", "labels": ["Incident date"]})


@query(Q.rule_same_or_next(("Our Insured", "Location", "Reference")))
def rule_same_or_next(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "label_same_or_next_line", "labels": ["Our Insured", "Location", "Reference"]})


@query(Q.rule_between("Our Insured:", "Vehicle"))
def rule_between(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "between_labels", "start_label": "Our Insured:", "end_label": "Vehicle"})


@query(Q.rule_fixed_line(3))
def rule_fixed_line(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "fixed_line", "line_number": 3})


@query(Q.rule_fixed_range(2, 4))
def rule_fixed_range(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "fixed_line", "line_start": 2, "line_end": 4})


@query(Q.rule_fixed_label(2, ("From:", "Dated", "Date:")))
def rule_fixed_label(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "fixed_line_label", "line_number": 2, "labels": ["From:", "Dated", "Date:"]})


@query(Q.rule_offset("Location", 2))
def rule_offset(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "line_offset", "labels": ["Location"], "offset": 2})


@query(r"SELECT model_id, trim(regexp_extract(plain_text, '(?i)claim no: *([A-Z0-9/-]+)', 1), ' :') AS value, 'default' AS rule_id, CASE WHEN regexp_matches(plain_text, '(?i)claim no: *([A-Z0-9/-]+)') THEN 1.0::DOUBLE END AS confidence, CAST(NULL AS INTEGER) AS pos FROM document_models")
def rule_regex(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "regex", "pattern": r"claim no: *([A-Z0-9/-]+)"})


@query("SELECT model_id, CASE WHEN contains(lower(plain_text), 'miles') OR contains(lower(plain_text), 'mileage') THEN 'Miles' ELSE 'Km' END AS value, 'default' AS rule_id, 1.0::DOUBLE AS confidence, CAST(NULL AS INTEGER) AS pos FROM document_models")
def rule_presence(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "presence", "tokens": ["miles", "mileage"], "value": "Miles", "absent_value": "Km"})


@query("SELECT model_id, '15/04/2026' AS value, 'default' AS rule_id, 1.0::DOUBLE AS confidence, CAST(NULL AS INTEGER) AS pos FROM document_models")
def rule_manual(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "manual", "value": "{today}"})


@query(Q.rule_email_date(("Date:", "Sent:")))
def rule_email_date(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, {"kind": "email_date", "labels": ["Date:", "Sent:"]})


@query()
def rule_fuzzy_label(spark: SparkSession, d: str) -> DataFrame:
    return R.rerun_rule(_docs(spark, d), "vrm", {"kind": "label_same_or_next_line", "labels": ["Vehcle Reglstration", "Registraton"]}, as_of=AS_OF)


# ---- fallbacks


def _fallback(spark: SparkSession, d: str, field: str) -> DataFrame:
    e = K.fallback(R.view_of(), field)
    return _docs(spark, d).select("model_id", e.alias("e")).select("model_id", *(F.col(f"e.{c}").alias(c) for c in ("value", "rule_id", "confidence", "pos")))


for _name, _key in (("vrm", "vrm"), ("reference", "reference"), ("incident_date", "incident_date"), ("instruction_date", "instruction_date"), ("address", "inspection_address"), ("claimant", "claimant_name"), ("model", "vehicle_model"), ("vat", "vat_status"), ("unit", "mileage_unit")):
    assert _key in LADDERS
    QUERIES[f"fallback_{_name}"] = lambda spark, d, f=_key: _fallback(spark, d, f)
    ORACLES[f"fallback_{_name}"] = Q.fallback(_key)


# ---- gates


def _gate(spark: SparkSession, d: str, field: str) -> DataFrame:
    """The gate of a field over the values that stand in the extractions; a model is held against the plate of its document."""
    fe = table(spark, d, "field_extractions")
    value = N.vrm(F.col("value")) if field == "vrm" else F.col("value")
    plates = fe.where("field_key = 'vrm'").groupBy("model_id").agg(F.max(N.vrm(F.col("value"))).alias("plate"))
    rows = fe.where(F.col("field_key") == field).select("record_id", "model_id", value.alias("value")).join(_models(spark, d), "model_id", "left").join(plates, "model_id", "left")
    return rows.select("record_id", "value", suspicious(field, F.col("value"), F.col("plain_text"), F.col("plate")).alias("suspicious"))


for _name, _key in (("reference", "reference"), ("claimant", "claimant_name"), ("model", "vehicle_model"), ("vrm", "vrm"), ("address", "inspection_address"), ("date", "incident_date")):
    QUERIES[f"gate_{_name}"] = lambda spark, d, f=_key: _gate(spark, d, f)
    ORACLES[f"gate_{_name}"] = Q.gate(_key)


# ---- records


def _records(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "provider_catalog")
    providers = [r.asDict(recursive=True) for r in catalog.select("provider_id", "name", "work_provider").orderBy("provider_id").collect()]
    return R.extract_records(R.documents_of(D.detect(_models(spark, d), catalog)), providers, as_of=AS_OF)


@query()
def extract_record(spark: SparkSession, d: str) -> DataFrame:
    return R.wide(_records(spark, d))


@query()
def record_long(spark: SparkSession, d: str) -> DataFrame:
    return R.long(_records(spark, d)).select("model_id", "provider_id", "field_pos", "field_key", "value", "rule_id", "confidence", "line_index", F.size("issues").alias("n_issues"))


def _wide_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).na.fill("", list(FIELD_ORDER))


_OVER = {"claimant_name": "claimant_name", "vrm": "vrm", "incident_date": "incident_date", "inspection_address": "inspection_address"}


@query(f"WITH {_WIDE}, r AS (SELECT model_id, " + ", ".join(f"max(expected_values['{f}']) AS r_{f}" for f in _OVER) + " FROM expected_fixtures GROUP BY 1) SELECT w.model_id, " + ", ".join(f"CASE WHEN trim(coalesce(r.r_{f}, '')) <> '' THEN r.r_{f} ELSE w.{f} END AS {f}" if f in _OVER else f"w.{f}" for f in FIELD_ORDER) + " FROM w LEFT JOIN r USING (model_id)")
def engineer_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The fixtures stand for reports; what they do not hold is blank in them."""
    e = table(spark, d, "expected_fixtures").groupBy("model_id").agg(*(F.max(F.col("expected_values")[f]).alias(f"r_{f}") for f in _OVER))
    report = e.select("model_id", *((F.col(f"r_{f}") if f in _OVER else F.lit("")).alias(f) for f in FIELD_ORDER))
    return R.overlay(_wide_values(spark, d), report, "model_id").select("model_id", *FIELD_ORDER)


_LABEL_WORDS = "('name', 'model', 'reference', 'ref', 'vehicle', 'claimant')"
_FLAGS = [("model_contains_vrm", "vrm <> '' AND contains(upper(regexp_replace(vehicle_model, '\\s+', '', 'g')), upper(regexp_replace(vrm, '\\s+', '', 'g')))")]
_FLAGS += [(f"{f}_looks_like_label", f"trim(lower({f})) IN {_LABEL_WORDS}") for f in ("claimant_name", "vehicle_model", "reference")]
_FLAGS += [(f"{f}_not_normalised", f"{f} <> '' AND NOT regexp_full_match({f}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')") for f in ("incident_date", "instruction_date", "inspection_date")]
_FLAG_LIST = "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{flag}' END" for flag, test in _FLAGS) + ")"


@query(f"WITH {_WIDE} SELECT model_id, {_FLAG_LIST} AS flags FROM w")
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.audit_flags(_wide_values(spark, d)).select("model_id", F.array_join("flags", "|").alias("flags"))


@query(f"WITH {_WIDE} SELECT count(*) AS documents, count(*) FILTER ({_FLAG_LIST} <> '') AS flagged, count(*) FILTER (" + " AND ".join(f"trim({f}) <> ''" for f in REQUIRED) + ") AS complete, CAST(sum(" + " + ".join(f"(trim({f}) <> '')::INT" for f in FIELD_ORDER) + ") AS BIGINT) AS filled_fields FROM w")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    w = _wide_values(spark, d)
    return R.audit_summary(w.join(R.audit_flags(w), "model_id")).select("documents", "flagged", "complete", "filled_fields")


@query("SELECT provider_id, field_key, count(*) AS documents, count(*) FILTER (trim(value) <> '') AS filled, CAST(grouping(provider_id, field_key) AS BIGINT) AS level FROM field_extractions GROUP BY CUBE (provider_id, field_key)")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return R.scorecard(table(spark, d, "field_extractions").select("provider_id", "field_key", "value")).withColumn("level", F.col("level").cast("bigint"))


@query("SELECT provider_id, CASE WHEN provider_id IN (SELECT provider_id FROM provider_catalog WHERE priority >= 10) THEN 'changed' ELSE name END AS name, CAST(row_number() OVER (ORDER BY provider_id) - 1 AS INTEGER) AS catalog_pos FROM provider_catalog UNION ALL SELECT 'zz_new', 'changed', CAST((SELECT count(*) FROM provider_catalog) AS INTEGER)")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = table(spark, d, "provider_catalog")
    base = p.select("provider_id", "name", (F.row_number().over(Window.orderBy("provider_id")) - 1).cast("int").alias("catalog_pos"))
    new = spark.createDataFrame([("zz_new",)], "provider_id string")
    inc = p.where("priority >= 10").select("provider_id").unionByName(new).select("provider_id", F.lit("changed").alias("name"), F.lit(0).alias("catalog_pos"))
    return C.upsert(base, inc).select("provider_id", "name", "catalog_pos")


@query("SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS catalog_pos, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS provider_id, trim(name) AS name, 'label_same_line' AS vrm_kind, 'Ref' AS start_label FROM provider_catalog")
def catalog_migrate(spark: SparkSession, d: str) -> DataFrame:
    old = {"providers": [{"name": r[0], "detect_phrases": list(r[1] or []), "field_rules": {"vrm": {"method": "labels", "config": "Reg, VRM"}, "reference": {"method": "two_labels", "config": "Ref||Date"}}} for r in table(spark, d, "provider_catalog").select("name", "detect.required_phrases").collect()]}
    return C.to_frame(spark, old).select("catalog_pos", "provider_id", "name", F.col("field_rules")["vrm"]["kind"].alias("vrm_kind"), F.col("field_rules")["reference"]["start_label"].alias("start_label"))


@query()
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """Every record, with what keeps it from being exported or its JSON."""
    j = exports.export_json(R.wide(_records(spark, d)), "model_id")
    return j.select("model_id", F.array_join("problems", "|").alias("problems"), "json")


@query("SELECT model_id, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '\\.[^.]*$', 0) END AS unique_name FROM (SELECT model_id, source_type || '.json' AS name, row_number() OVER (PARTITION BY source_type ORDER BY model_id) AS k FROM document_models)")
def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_models").select("model_id", F.concat("source_type", F.lit(".json")).alias("name"))
    return exports.unique_names(rows, "name", "model_id").select("model_id", "unique_name")


@query()
def docx_letter(spark: SparkSession, d: str) -> DataFrame:
    """Letters written and read again."""
    made = exports.letters(_wide_values(spark, d), "model_id", F.lit(AS_OF).cast("timestamp"))
    files = made.select(F.concat(F.col("model_id").cast("string"), F.lit(".docx")).alias("path"), "content")
    return readers.read_content(files).select("source_path", "plain_text", F.size("lines").alias("n_lines"), "reader_error")


@query()
def email_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Mails as files: each plain text is a message of headers and body, read by the EML reader."""
    m = table(spark, d, "document_models").where("source_type = 'eml'").select(F.concat(F.col("model_id").cast("string"), F.lit(".eml")).alias("path"), F.encode(F.concat(F.lit("MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n"), F.col("plain_text")), "UTF-8").alias("content"))
    return readers.read_content(m).select("source_path", F.size("lines").alias("n_lines"), F.element_at("metadata", "email_source_type").alias("kind"), "reader_error")


@query("SELECT f.model_id, f.record_id, k.key AS field_key, CASE WHEN coalesce(e.value, '') = k.value THEN 'equal' WHEN coalesce(e.value, '') = '' AND list_contains(coalesce(f.allowed_blank_fields, []), k.key) THEN 'blank' ELSE 'differs' END AS outcome FROM expected_fixtures f, unnest(map_entries(expected_values)) AS t(k) LEFT JOIN (SELECT model_id, field_key, max(value) AS value FROM field_extractions GROUP BY ALL) e ON e.model_id = f.model_id AND e.field_key = k.key")
def fixture_compare(spark: SparkSession, d: str) -> DataFrame:
    """Expected against extracted values; a blank is allowed where the fixture says so."""
    e = table(spark, d, "field_extractions").groupBy("model_id", "field_key").agg(F.max("value").alias("value"))
    f = table(spark, d, "expected_fixtures").select("model_id", "record_id", "allowed_blank_fields", F.explode("expected_values").alias("field_key", "want"))
    got = F.coalesce("value", F.lit(""))
    allowed = F.coalesce(F.array_contains("allowed_blank_fields", F.col("field_key")), F.lit(False))
    return f.join(e, ["model_id", "field_key"], "left").select("model_id", "record_id", "field_key", F.when(got == F.col("want"), "equal").when((got == "") & allowed, "blank").otherwise("differs").alias("outcome"))


# ---- primitives and sinks over extracted values

_STEM = "coalesce(nullif(regexp_replace(source_path, '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}._-]', '_', 'g'), ''), 'document')"
_TOKENS = "list_filter(list_transform(string_split(raw_value, ','), lambda x: trim(regexp_replace(x, '[\\r\\n]', '', 'g'))), lambda x: x <> '')"
_FILLED = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: " + Q.strip("x") + "), lambda x: x <> '')"


@query(f"SELECT model_id, {_STEM} AS stem FROM document_models")
def source_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_models").select("model_id", X.source_stem(F.col("source_path")).alias("stem"))


@query(f"SELECT record_id, array_to_string({_TOKENS}, '|') AS tokens FROM field_extractions WHERE raw_value IS NOT NULL")
def split_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_extractions").where("raw_value is not null").select("record_id", F.array_join(X.split_tokens(F.col("raw_value")), "|").alias("tokens"))


_TWO = "CASE WHEN contains(raw_value, '||') THEN {0} WHEN len(l) >= 2 THEN l[{1}] ELSE '' END"


@query(f"SELECT record_id, {_TWO.replace('{0}', Q.strip("split_part(raw_value, '||', 1)")).replace('{1}', '1')} AS first, {_TWO.replace('{0}', Q.strip("substr(raw_value, instr(raw_value, '||') + 2)")).replace('{1}', '2')} AS second FROM (SELECT record_id, raw_value, {_FILLED('raw_value')} AS l FROM field_extractions WHERE raw_value IS NOT NULL)")
def two_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "field_extractions").where("raw_value is not null").select("record_id", X.two_labels(F.col("raw_value")).alias("x"))
    return rows.select("record_id", F.col("x.start").alias("first"), F.col("x.end").alias("second"))


_ADDRESS_PARTS = lambda c: f"list_filter(list_transform(string_split({c}, CASE WHEN contains({c}, chr(10)) THEN chr(10) ELSE ',' END), lambda x: " + Q.strip("x") + "), lambda x: x <> '')[1:6]"
_SLOTS = "coalesce({0}[1], '') AS line1, coalesce({0}[2], '') AS line2, CASE WHEN len({0}) > 3 THEN {0}[len({0})] ELSE coalesce({0}[3], '') END AS line3"


@query(f"SELECT record_id, array_to_string(l, '|') AS lines, {_SLOTS.format('l')} FROM (SELECT record_id, {_ADDRESS_PARTS('raw_value')} AS l FROM field_extractions WHERE field_key = 'inspection_address' AND raw_value IS NOT NULL)")
def address_block(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw(spark, d, "inspection_address").where("raw_value is not null").withColumn("b", X.address_block(F.col("raw_value")))
    return rows.select("record_id", F.array_join(X.address_lines(F.col("raw_value")), "|").alias("lines"), *(F.col("b")[i].alias(f"line{i + 1}") for i in range(3)))


_REJECTS = ("name", "client", "our client", "claimant")


@query(f"SELECT record_id, {Q.label_only('raw_value')} AS only_label, {Q.rejected('raw_value', _REJECTS)} AS rejected, {Q.any_of('lower(raw_value)', X.NARRATIVE)} AS narrative FROM field_extractions WHERE raw_value IS NOT NULL")
def value_tests(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("raw_value")
    return table(spark, d, "field_extractions").where("raw_value is not null").select("record_id", X.is_label_only(v).alias("only_label"), X.is_rejected(v, _REJECTS).alias("rejected"), X.is_narrative(v).alias("narrative"))


@query("SELECT record_id, " + ", ".join(f"coalesce(expected_values['{f}'], '') AS {f}" for f in FIELD_ORDER) + " FROM expected_fixtures")
def record_from_map(spark: SparkSession, d: str) -> DataFrame:
    return exports.record_from_map(table(spark, d, "expected_fixtures"), "record_id", "expected_values")


_SAFE = lambda c: "coalesce(nullif(replace(" + Q.strip(f"regexp_replace({c}, '[^A-Za-z0-9._ -]', '', 'g')") + ", ' ', '_'), ''), 'export')"


@query(f"WITH {_WIDE} SELECT model_id, concat_ws('_', '20260415_000000', {_SAFE('work_provider')}, {_SAFE('vrm')}) AS folder, {_SAFE('work_provider')} || '_' || {_SAFE('vrm')} || '.json' AS name FROM w")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    return _wide_values(spark, d).select("model_id", exports.output_folder(F.lit(AS_OF).cast("timestamp")).alias("folder"), exports.bundle_name(".json").alias("name"))


_SQL_PROBLEMS = [("work_provider", "trim(work_provider) = ''"), ("vrm", "trim(vrm) = ''")] + [(f, f"{f} <> '' AND NOT regexp_full_match({f}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')") for f in ("incident_date", "instruction_date", "inspection_date")]
_SQL_PROBLEMS += [
    ("inspection_address", "NOT regexp_full_match(inspection_address, '[^\\n]*(\\n[^\\n]*){5}')"), ("vat_status", "vat_status NOT IN ('', 'Yes', 'No')"), ("mileage", "NOT regexp_full_match(mileage, '[0-9]*')"), ("mileage_unit", "mileage_unit NOT IN ('', 'Miles', 'Km')"),
]
_PROBLEMS = "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{f}' END" for f, test in _SQL_PROBLEMS) + ")"


@query(f"WITH {_WIDE.partition(', w AS')[0]}, x AS (SELECT" + _WIDE.partition("w AS (SELECT")[2].rstrip(")") + f"), w AS (SELECT * REPLACE (replace(split_part(inspection_address, chr(10), 1), ',', ' ') || repeat(chr(10), 5) AS inspection_address) FROM x) SELECT model_id, {_PROBLEMS} AS problems, CASE WHEN {_PROBLEMS} = '' THEN CAST(json_object(" + ", ".join(f"'{name}', {f}" for f, name in FIELDS.items()) + ") AS VARCHAR) END AS json FROM w")
def export_values(spark: SparkSession, d: str) -> DataFrame:
    """The export of extracted values, their addresses brought to six lines."""
    six = F.concat(F.replace(F.substring_index("inspection_address", "\n", 1), F.lit(","), F.lit(" ")), F.lit("\n" * 5))
    j = exports.export_json(_wide_values(spark, d).withColumn("inspection_address", six), "model_id")
    return j.select("model_id", F.array_join("problems", "|").alias("problems"), "json")


_ORDINAL = "CASE WHEN regexp_full_match({0}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AND try_strptime({0}, '%d/%m/%Y') IS NOT NULL THEN day(try_strptime({0}, '%d/%m/%Y')) || CASE WHEN day(try_strptime({0}, '%d/%m/%Y')) BETWEEN 10 AND 20 THEN 'th' WHEN day(try_strptime({0}, '%d/%m/%Y')) % 10 = 1 THEN 'st' WHEN day(try_strptime({0}, '%d/%m/%Y')) % 10 = 2 THEN 'nd' WHEN day(try_strptime({0}, '%d/%m/%Y')) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(try_strptime({0}, '%d/%m/%Y'), ' %B %Y') ELSE {0} END"


@query(f"WITH {_WIDE}, b AS (SELECT *, {_ADDRESS_PARTS('inspection_address')} AS l FROM w) SELECT model_id, '15th April 2026' AS today, {_ORDINAL.format('incident_date')} AS incident, {_ORDINAL.format('inspection_date')} AS inspection, {_SLOTS.format('l')} FROM b")
def letter_values(spark: SparkSession, d: str) -> DataFrame:
    return exports.letter_values(_wide_values(spark, d), F.lit(AS_OF).cast("timestamp")).select("model_id", "today", "incident", "inspection", "line1", "line2", "line3")


@query("SELECT model_id, 'hollin_gate' AS used FROM document_models")
def provider_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The provider that a user names, by any of its names, without regard to case."""
    return D.resolve(_models(spark, d), table(spark, d, "provider_catalog"), explicit="HOLLIN_GATE").select("model_id", F.col("used_provider").alias("used"))


@query("SELECT source_path, source_type, plain_text, len(coalesce(reader_notes, [])) AS n_notes FROM document_models")
def document_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON and back."""
    m = table(spark, d, "document_models").select("source_path", "source_type", "plain_text", "reader_notes", "metadata")
    back = exports.document_from_json(exports.document_json(m), "json")
    return back.select("source_path", "source_type", "plain_text", F.size(F.coalesce("reader_notes", F.array().cast("array<string>"))).cast("bigint").alias("n_notes"))


_PARAGRAPHS = (
    "'15th April 2026'", "'Our reference: ' || reference", "'Registration: ' || vrm", "'Vehicle: ' || vehicle_model", "'For: ' || claimant_name", "'We have been asked by ' || work_provider || ' to inspect this vehicle after the event of ' || incident || '.'",
    "'The inspection is to take place on ' || inspection || ' at:'", "line1", "line2", "line3",
)
_SQL_LETTER = f"""WITH {_WIDE}, b AS (SELECT *, {_ADDRESS_PARTS('inspection_address')} AS l FROM w), z AS (SELECT *, {_ORDINAL.format("incident_date")} AS incident, {_ORDINAL.format("inspection_date")} AS inspection, {_SLOTS.format("l")} FROM b),
p AS (SELECT model_id, list_filter([{", ".join(Q.strip(x) for x in _PARAGRAPHS)}], lambda x: x <> '') AS p FROM z)
SELECT model_id || '.docx' AS source_path, array_to_string(p, chr(10)) AS plain_text, len(list_distinct(list_transform(p, lambda x: lower(x)))) AS n_lines, CAST(NULL AS VARCHAR) AS reader_error FROM p"""
ORACLES["docx_letter"] = _SQL_LETTER
