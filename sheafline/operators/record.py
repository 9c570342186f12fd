"""Assembly of records: rule, fallback, normal form, gate, overrides, checks; one row a document, no shuffle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import normalize as N
from sheafline.functions.text import line_structs, split_lines
from sheafline.functions.validate import issues_of
from sheafline.functions.similarity import Finder
from sheafline.operators import batch, ladder
from sheafline.operators.rules import View, build, labels_of
from sheafline.schema import DATES, FIELD_ORDER, FIELDS, REQUIRED

#: Rules for providers without their own; a parameter.
DEFAULT_RULES: dict[str, dict] = {
    "vrm": {"id": "vrm", "kind": "label_same_line", "labels": ["Vehicle Registration", "Vehicle reg", "VRM"]},
    "vehicle_model": {"id": "model", "kind": "label_same_line", "labels": ["Make/Model", "Vehicle Make", "Our client's vehicle"]},
    "claimant_name": {"id": "claimant", "kind": "label_same_or_next_line", "labels": ["Client Name", "Our Client:", "Our Insured", "Claimant", "Name:", "Re:"]},
    "reference": {"id": "reference", "kind": "label_same_or_next_line", "labels": ["Our Ref:", "Claim No", "Our reference", "Ref -", "Reference"]},
    "incident_date": {"id": "incident", "kind": "label_same_or_next_line", "labels": ["Date of Accident", "Accident Date", "Date of loss", "Incident date", "Acc date"]},
    "instruction_date": {"id": "instructed", "kind": "label_same_line", "labels": ["Instruction Date", "Received", "Dated", "Date:"]},
    "inspection_address": {"id": "address", "kind": "label_same_or_next_line", "labels": ["Inspection Address", "Where to inspect", "Vehicle located at", "Location", "Garage"]},
    "mileage": {"id": "mileage", "kind": "label_same_line", "labels": ["Recorded mileage", "Odometer", "Mileage"]},
}


def documents_of(models: DataFrame) -> DataFrame:
    """``models`` with ``lines`` (struct array of clean lines), ``texts`` (their texts) and ``raw_lines``. Null texts count as empty."""
    t = F.coalesce(F.col("plain_text"), F.lit(""))
    return models.withColumn("lines", line_structs(t)).withColumn("texts", F.transform("lines", lambda x: x["text"])).withColumn("raw_lines", split_lines(t))


def view_of(as_of: Column | None = None) -> View:
    return View(F.col("texts"), F.coalesce(F.col("plain_text"), F.lit("")), F.col("raw_lines"), as_of)


def normalised(field: str, value: Column, force_postcode: Column | bool = False) -> Column:
    if field == "inspection_address":
        return N.address(value, force_postcode)
    return N.NORMALISERS[field](value) if field in N.NORMALISERS else F.coalesce(value, F.lit(""))


FIELD_STRUCT = "struct<value:string,raw_value:string,rule_id:string,confidence:double,pos:int>"


#: Documents read at a time.
AT_A_TIME = 256


def _readers(b: pa.RecordBatch, finder: Finder | None, day: dt.date) -> Iterator[tuple[int, batch.Doc]]:
    """(row, document) of a batch with plain_text, texts and raw_lines."""
    text, lines, raw = (b.column(b.schema.get_field_index(n)) for n in ("plain_text", "texts", "raw_lines"))
    for a in range(0, b.num_rows, AT_A_TIME):
        part = [x or [] for x in lines.slice(a, AT_A_TIME).to_pylist()]
        near = finder.locate(part) if finder else [{}] * len(part)
        for i, (t, ls, r, n) in enumerate(zip(text.slice(a, AT_A_TIME).to_pylist(), part, raw.slice(a, AT_A_TIME).to_pylist(), near)):
            yield a + i, batch.Doc(ls, t, r or [], day, n)


def extract_records(docs: DataFrame, catalog: list[dict] | None = None, rules: dict[str, dict] | None = None, fuzzy: bool = True, as_of: dt.date | None = None, key: str = "model_id", spread: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, provider_id, lines, fields (struct of 13 extractions), diagnostics and issues of each row of ``docs``.

    docs: key, provider_id (of ``detect``), plain_text and the columns of ``documents_of``.
    catalog: providers as dicts with provider_id, name, work_provider, field_rules and flags; a provider without rules gets ``rules``.
    carry: columns of ``docs`` that are passed on.
    spread: the documents are first shuffled by key over all cores, since the work on each far outweighs moving it and files
    may have few splits.
    An error of a rule is kept as a diagnostic even if a fallback fills the field. Null texts give records without values.
    """
    base = DEFAULT_RULES if rules is None else rules
    by_id = {p["provider_id"]: p for p in catalog or []}
    day = as_of or dt.date.today()
    src = docs.select(key, "provider_id", F.coalesce("plain_text", F.lit("")).alias("plain_text"), F.transform("lines", lambda x: x["line_index"]).alias("at"), "texts", "raw_lines", *carry)
    kind = dict(src.dtypes)[key]
    if spread:
        src = src.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    labels = list(dict.fromkeys([*labels_of(base), *(x for p in by_id.values() for x in labels_of(p.get("field_rules") or {})), *ladder.ALL_LABELS]))
    fields = ", ".join(f"{f}: {FIELD_STRUCT}" for f in FIELD_ORDER)
    schema = f"`{key}` {kind}, provider_id string, at array<int>, fields struct<{fields}>, diagnostics array<struct<field:string,code:string>>" + "".join(f", `{c}` {dict(src.dtypes)[c]}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.struct([("value", pa.string()), ("raw_value", pa.string()), ("rule_id", pa.string()), ("confidence", pa.float64()), ("pos", pa.int32())])
        finder = Finder(labels, ladder.LEAST) if fuzzy else None
        for b in batches:
            ids = b.column(b.schema.get_field_index("provider_id")).to_pylist()
            rows, notes = [], []
            for i, doc in _readers(b, finder, day):
                p = by_id.get(ids[i]) or {}
                got = batch.extract(doc, p.get("field_rules") or base, p)
                rows.append({f: {"value": x.value, "raw_value": x.raw_value, "rule_id": x.rule_id, "confidence": x.confidence, "pos": x.pos} for f, x in got.items()})
                notes.append([{"field": f, "code": x.issue} for f, x in got.items() if x.issue])
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([
                b.column(names.index(key)), b.column(names.index("provider_id")), b.column(names.index("at")), pa.array(rows, pa.struct([(f, shape) for f in FIELD_ORDER])),
                pa.array(notes, pa.list_(pa.struct([("field", pa.string()), ("code", pa.string())]))), *(b.column(names.index(c)) for c in carry),
            ], names=[key, "provider_id", "at", "fields", "diagnostics", *carry])

    df = src.mapInArrow(run, schema)
    return df.withColumn("issues", issues_of({f: F.col(f"fields.{f}.value") for f in FIELD_ORDER}))


def wide(records: DataFrame, key: str = "model_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, provider_id, the values of the 13 fields as columns and the columns carried."""
    return records.select(key, "provider_id", *carry, *(F.col(f"fields.{f}.value").alias(f) for f in FIELD_ORDER))


def _of_field(field: str) -> Column:
    return F.filter("issues", lambda x: x["field"] == field)


def long(records: DataFrame, key: str = "model_id") -> DataFrame:
    """A row for each field: key, provider_id, field_pos, field_key, value, raw_value, rule_id, confidence, pos, page_index, line_index and the issues of the field."""
    rows = F.array(*(F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("field_key"), F.col(f"fields.{f}").alias("e"), _of_field(f).alias("issues")) for i, f in enumerate(FIELD_ORDER)))
    df = records.select(key, "provider_id", "at", F.explode(rows).alias("r"))
    span = F.get("at", F.col("r.e.pos"))
    return df.select(key, "provider_id", "r.field_pos", "r.field_key", *(F.col(f"r.e.{c}").alias(c) for c in ("value", "raw_value", "rule_id", "confidence", "pos")), span.alias("line_index"), F.col("r.issues").alias("issues"))


def overlay(base: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """``base`` (wide) with every field but the work provider taken from ``report`` where that is not blank; base rows without a report stay."""
    r = report.select(F.col(key), *(F.col(f).alias(f"_r_{f}") for f in FIELD_ORDER))
    j = base.join(r, key, "left")
    take = lambda f: F.when(F.trim(F.coalesce(F.col(f"_r_{f}"), F.lit(""))) != "", F.col(f"_r_{f}")).otherwise(F.col(f))
    return j.select(*(take(c).alias(c) if c in FIELDS and c != "work_provider" else c for c in base.columns))


def audit_flags(records: DataFrame, key: str = "model_id") -> DataFrame:
    """key, flags: signs of wrong extraction in a wide record."""
    v = lambda f: F.coalesce(F.col(f), F.lit(""))
    flags = [F.when((v("vrm") != "") & F.contains(N.vrm(v("vehicle_model")), N.vrm(v("vrm"))), F.lit("model_contains_vrm"))]
    flags += [F.when(F.lower(F.trim(v(f))).isin("name", "model", "reference", "ref", "vehicle", "claimant"), F.lit(f"{f}_looks_like_label")) for f in ("claimant_name", "vehicle_model", "reference")]
    flags += [F.when((v(f) != "") & ~v(f).rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.lit(f"{f}_not_normalised")) for f in DATES]
    return records.select(key, F.array_compact(F.array(*flags)).alias("flags"))


def audit_summary(records: DataFrame) -> DataFrame:
    """One row: documents, documents with a flag, documents with all required fields, filled fields."""
    flagged = F.size(F.col("flags")) > 0
    complete = F.forall(F.array(*(F.trim(F.coalesce(F.col(f), F.lit(""))) for f in REQUIRED)), lambda x: x != "")
    filled = sum(((F.trim(F.coalesce(F.col(f), F.lit(""))) != "").cast("int") for f in FIELD_ORDER), F.lit(0))
    return records.agg(F.count("*").alias("documents"), F.count_if(flagged).alias("flagged"), F.count_if(complete).alias("complete"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled_fields"))


def scorecard(long_records: DataFrame) -> DataFrame:
    """Extension: fill rate by provider and field, with subtotals of the cube."""
    return long_records.cube("provider_id", "field_key").agg(F.count("*").alias("documents"), F.count_if(F.trim(F.col("value")) != "").alias("filled"), F.grouping_id().alias("level"))


def rerun_rule(docs: DataFrame, field: str, rule: dict, fuzzy: bool = True, as_of: dt.date | None = None, key: str = "model_id") -> DataFrame:
    """key, value (normalised), raw_value, confidence, pos, error of one rule, without gate or fallback. Without ``fuzzy`` it is a column expression."""
    day = as_of or dt.date.today()
    if not fuzzy:
        e, code = build(view_of(F.lit(day)), rule)
        return docs.select(key, e.alias("e")).select(key, normalised(field, F.col("e.value")).alias("value"), F.col("e.value").alias("raw_value"), F.col("e.confidence").alias("confidence"), F.col("e.pos").alias("pos"), F.lit(code).cast("string").alias("error"))
    src = docs.select(key, F.coalesce("plain_text", F.lit("")).alias("plain_text"), "texts", "raw_lines")
    kind = dict(src.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(labels_of({field: rule}), ladder.LEAST)
        for b in batches:
            got = [batch.apply_rule(doc, rule) for _, doc in _readers(b, finder, day)]
            cols = [pa.array([getattr(g, n) for g in got], t) for n, t in (("value", pa.string()), ("confidence", pa.float64()), ("pos", pa.int32()), ("issue", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "raw_value", "confidence", "pos", "error"])

    found = src.mapInArrow(run, f"`{key}` {kind}, raw_value string, confidence double, pos int, error string")
    return found.select(key, normalised(field, F.col("raw_value")).alias("value"), "raw_value", "confidence", "pos", "error")


__all__ = ["extract_records", "wide", "long", "overlay", "audit_flags", "audit_summary", "scorecard", "rerun_rule", "documents_of"]
