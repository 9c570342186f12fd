"""Detection, rules, fallbacks and records; the column builders against the batched reader."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheafline.operators import batch
from sheafline.operators import detect as D
from sheafline.operators import fallbacks as K
from sheafline.operators import ladder as S
from sheafline.operators import record as R
from sheafline.operators import rules as U
from sheafline.schema import FIELD_ORDER

DAY = dt.date(2026, 4, 15)
DOCS = [
    "Subject: Our ref: AB/12/X9\nAcme Law\nOur Ref: Q123-01\nClient Name: Mr Jo Bloggs\nVehicle Registration: AB12 CDE\nMake/Model: Ford Fiesta\nDate of Accident: 3rd March 2024\nReceived: 05/03/2024\nInspection Address: Unit 4, 1 High St\nTown\nAB1 2DE\nMileage: 12,345 miles\nVAT: no vat\n",
    "Reference:\n9912345\nOur Insured:\nMs Ada L\nRegistration\n\nK123 ABC\nVehicle: Volvo V70\naccident date\n2024-01-02\nLocation:\nThe Yard\n2 Mill Lane\nXY9 9ZZ\nOdometer 90k km\n",
    "Dr Who Person is available at noon\nthe vehicle AB12CDE was hit\nclaim 445566 opened 01/02/2024\nplease arrange a visit\nBig Garage\nMill Road\nXY9 9ZZ\n",
    "", "x\n\n\n", "Re: client\nname\nref\n", "RTA on 5 May 2024\nVRM: TEL 12\nReg: VAT 123\nOur client's vehicle - Saab 900\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return R.documents_of(spark.createDataFrame(list(enumerate(DOCS)), "model_id long, plain_text string").withColumn("provider_id", F.lit("a"))).persist()


def batch_docs(docs):
    return {r["model_id"]: batch.Doc(r["texts"], r["plain_text"], r["raw_lines"], DAY) for r in docs.collect()}


RULES = [
    {"kind": "label_same_line", "labels": ["Vehicle Registration", "Our Ref"]}, {"kind": "label_next_line", "labels": ["Reference", "Our Insured"]}, {"kind": "label_same_or_next_line", "labels": ["Location", "Inspection Address"]},
    {"kind": "between_labels", "start_label": "Our Insured", "end_label": "Vehicle"}, {"kind": "between_labels", "start_label": "Reference", "end_label": "nowhere"}, {"kind": "fixed_line", "line_number": 2}, {"kind": "fixed_line", "line_start": 1, "line_end": 3},
    {"kind": "fixed_line_label", "line_number": 3, "labels": ["Ref:", "Our"]}, {"kind": "line_offset", "labels": ["Location", "VRM"], "offset": 2}, {"kind": "line_offset", "labels": ["Location"], "offset": -2}, {"kind": "line_offset", "labels": ["Location"], "offset": 99},
    {"kind": "line_offset", "labels": ["Location"], "offset": 0}, {"kind": "regex", "pattern": r"^claim (\d+)"}, {"kind": "regex", "pattern": r"(?P<x>AB\d+) ?CDE"}, {"kind": "presence", "tokens": ["km"], "value": "Km", "absent_value": "Miles"}, {"kind": "presence", "tokens": []},
    {"kind": "manual", "value": "{today}"}, {"kind": "manual", "value": "fixed"}, {"kind": "email_date", "labels": ["accident date", "opened"]}, {"kind": "nonsense"}, {"kind": "regex", "pattern": "("}, {},
]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.get("kind", "none") + str(RULES.index(r)))
def test_rule_columns_equal_batch(spark, docs, rule):
    e, code = U.build(R.view_of(F.lit(DAY)), rule)
    got = {r["model_id"]: (r["e"]["value"], r["e"]["pos"]) for r in docs.select("model_id", e.alias("e")).collect()}
    want = {i: batch.apply_rule(d, rule) for i, d in batch_docs(docs).items()}
    assert got == {i: (w.value, w.pos) for i, w in want.items()}
    assert {code} == {w.issue for w in want.values()}


@pytest.mark.parametrize("field", sorted(S.LADDERS))
def test_fallback_columns_equal_batch(spark, docs, field):
    got = {r["model_id"]: (r["e"]["value"], r["e"]["rule_id"]) for r in docs.select("model_id", K.fallback(R.view_of(), field).alias("e")).collect()}
    want = {i: batch.climb(d, field) for i, d in batch_docs(docs).items()}
    assert got == {i: (w.value, w.rule_id) for i, w in want.items()}


def test_record(spark, docs):
    provider = {"provider_id": "a", "name": "Acme", "work_provider": "", "use_current_date_for_inspection_date": True}
    rec = R.extract_records(docs, [provider], as_of=DAY)
    w = {r["model_id"]: r.asDict() for r in R.wide(rec).collect()}
    first = w[0]
    assert (first["vrm"], first["reference"], first["claimant_name"], first["incident_date"], first["mileage"], first["work_provider"], first["inspection_date"]) == ("AB12CDE", "AB/12/X9", "Mr Jo Bloggs", "03/03/2024", "12345", "Acme", "15/04/2026")
    assert first["inspection_address"].count("\n") == 5
    assert w[1]["vrm"] == "K123ABC" and w[1]["vehicle_model"] == "Volvo V70"
    assert w[3]["vrm"] == "" and w[3]["vehicle_model"] == ""
    long = R.long(rec)
    assert long.count() == len(DOCS) * 13 and [r[0] for r in long.where("model_id = 0").orderBy("field_pos").select("field_key").collect()] == list(FIELD_ORDER)
    flags = R.audit_flags(R.wide(rec))
    assert R.audit_summary(R.wide(rec).join(flags, "model_id")).head()["documents"] == len(DOCS)
    assert R.extract_records(docs.limit(0), [provider]).count() == 0


def test_own_rules_of_a_provider_and_their_errors(spark, docs):
    p = {"provider_id": "a", "name": "A", "work_provider": "A", "field_rules": {"vrm": {"kind": "manual", "value": "zz99 zzz"}, "reference": {"kind": "odd"}}}
    r = R.extract_records(docs.where("model_id = 0"), [p], as_of=DAY).head()
    assert r["fields"]["vrm"]["value"] == "ZZ99ZZZ" and [(x["field"], x["code"]) for x in r["diagnostics"]] == [("reference", "invalid_rule_kind")]
    assert r["fields"]["reference"]["value"] == "AB/12/X9"


def test_fuzzy_rule(spark, docs):
    got = {r["model_id"]: r["value"] for r in R.rerun_rule(docs, "vrm", {"kind": "label_same_line", "labels": ["Vehcle Reglstration"]}).collect()}
    assert got[0] == "AB12CDE" and got[3] == ""
    exact = {r["model_id"]: r["value"] for r in R.rerun_rule(docs, "vrm", {"kind": "label_same_line", "labels": ["Vehicle Registration"]}, fuzzy=False).collect()}
    assert exact[0] == "AB12CDE"


def test_overlay(spark):
    schema = "k long, " + ", ".join(f"{f} string" for f in FIELD_ORDER)
    base = spark.createDataFrame([(1, *["b"] * 13), (2, *["b"] * 13)], schema)
    rep = spark.createDataFrame([(1, "r", "r", None, " ", *["r"] * 9)], schema)
    got = {r["k"]: r for r in R.overlay(base, rep, "k").collect()}
    assert (got[1]["work_provider"], got[1]["vrm"], got[1]["vehicle_model"], got[1]["claimant_name"], got[1]["reference"]) == ("b", "r", "b", "b", "r") and got[2]["vrm"] == "b"


CATALOG = "provider_id string, name string, work_provider string, enabled boolean, priority int, detect struct<required_phrases:array<string>,optional_phrases:array<string>,negative_phrases:array<string>,minimum_confidence:double>"


def test_detection(spark):
    cat = spark.createDataFrame([
        ("a", "A", None, True, 0, (["Acme Law"], ["vat", "zebra"], [], 0.75)), ("b", "B", None, True, 5, (["acme"], [], ["yard"], None)), ("c", "C", None, True, 5, (["acme", "law"], [], [], None)),
        ("d", "D", None, False, 99, ([], [], [], None)), ("e", "E", None, None, None, (["o'neill & sons"], None, None, None)),
    ], CATALOG)
    docs = spark.createDataFrame([(1, "ACME  law vat"), (2, "acme yard"), (3, None), (4, "From O’Neill / sons"), (5, "o neill sons")], "k long, plain_text string")
    one = {r["k"]: (r["provider_id"], round(r["confidence"], 6), r["matched_terms"]) for r in D.detect(docs, cat).collect()}
    two = {r["k"]: (r["provider_id"], round(r["confidence"], 6), r["matched_terms"]) for r in D.detect_blocks(docs, cat, block=2).collect()}
    assert one == two
    assert one[1] == ("c", 1.0, ["acme", "law"]) and one[2] == (None, 0.0, []) and one[3] == (None, 0.0, []) and one[5][0] == "e"
    assert D.detect(docs, cat.limit(0)).where("provider_id is null").count() == 5
    first = D.resolve(D.detect(docs, cat), cat, "first").where("k = 3").head()["used_provider"]
    assert first == "a" and D.resolve(D.detect(docs, cat), cat).where("k = 3").head()["used_provider"] is None
    with pytest.raises(ValueError):
        D.resolve(docs, cat, explicit="nobody")
    said = {(r["k"], r["provider_id"]): (r["matched_terms"], r["missing_terms"], r["rejected_terms"], r["eligible"]) for r in D.candidates(docs, cat, "k", block=3).collect()}
    assert said[(2, "b")] == (["acme"], [], ["yard"], False) and said[(1, "c")] == (["acme", "law"], [], [], True) and said[(2, "c")] == (["acme"], ["law"], [], False)
    assert not any(k == 3 for k, _ in said) and D.candidates(docs, cat.limit(0), "k").count() == 0
