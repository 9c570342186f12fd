"""Text primitives, normal forms and checks, against plain Python."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafline.functions import normalize as N
from sheafline.functions import text as X
from sheafline.functions.similarity import Finder, ratio
from sheafline.functions.validate import issues_of, suspicious
from sheafline.operators import batch
from sheafline.schema import FIELD_ORDER


def col(spark, values, f, kind="string"):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


VALUES = [None, "", "  ", " a\t b:\n", "x\r\ny", "A  B   C", "é“q”", ":\n:", "line\n\n\n\nend", "a" * 20_000]


def test_clean_matches_python(spark):
    got = col(spark, VALUES, X.clean)
    assert got[0] is None and got[1:] == [batch.clean(v) for v in VALUES[1:]]


def test_names_and_tokens(spark):
    assert col(spark, ["A b/c?.json", "", None, "###"], X.safe_filename) == ["A_bc.json", "export", "export", "export"]
    assert col(spark, ["a, b\n,,c", ""], X.split_tokens) == [["a", "b", "c"], []]
    assert [tuple(r) for r in col(spark, ["a||b", "x\n\ny\nz", "one"], X.two_labels)] == [("a", "b"), ("x", "y"), ("", "")]
    assert col(spark, ["01/04/2026", "12/04/2026", "22/04/2026", "31/02/2026", "soon"], X.ordinal_date) == ["1st April 2026", "12th April 2026", "22nd April 2026", "31/02/2026", "soon"]
    assert col(spark, ["a,b,c,d,e", "a\nb"], X.address_block) == [["a", "b", "e"], ["a", "b", ""]]


def test_html(spark):
    h = "<html><style>x{}</style><p>Dear&nbsp;Sir &amp; Madam</p><br/>a<td>1</td><td>2</td><!-- no --></html>"
    assert col(spark, [h], X.strip_html) == ["Dear Sir & Madam\n\na 1 2"]
    assert col(spark, [h, "plain", None], X.looks_like_html) == [True, False, None]


def test_lines(spark):
    rows = col(spark, ["a\n\nA\r\nb ", "", None, "one line"], X.line_structs)
    assert [[(x["text"], x["line_index"]) for x in r] if r is not None else None for r in rows] == [[("a", 0), ("b", 3)], [], None, [("one line", 0)]]


DATES = ["12th March 2024", "19/122024", "31/02/2024", "5-Apr-69", "5-April-68", "April 5, 2024", "2024-3-9", "1/2/24", "Sept 5 2024", "", None, "  03-04-2024", "(1 May 2024", "2 MAY 2024", "1/2/2024 10:00"]


def test_dates_match_python(spark):
    assert col(spark, DATES, N.date) == [batch.norm_date(d or "") for d in DATES]
    assert batch.norm_date("5-Apr-69") == "05/04/1969" and batch.norm_date("5-April-68") == "05/04/2068"


ADDRESSES = ["", None, "one line", "x, AB1 2DE", "a\nb\nc\nd\ne\nf\nAB12DE rest", "12 High St AB1 2DE later", "a,,b", "AB1 2DE", "AB1 2DE and AB2 3EF"]


@pytest.mark.parametrize("force", [False, True])
def test_addresses_match_python(spark, force):
    assert col(spark, ADDRESSES, lambda c: N.address(c, force)) == [batch.norm_address(a or "", force) for a in ADDRESSES]
    assert all(a.count("\n") == 5 for a in (batch.norm_address(x or "", force) for x in ADDRESSES))


def test_other_values(spark):
    assert col(spark, ["ab12 cde", None], N.vrm) == ["AB12CDE", ""]
    assert col(spark, ["about 12,345 miles", "none", None], N.mileage) == ["12345", "", ""]
    assert col(spark, ["Y", "false", " maybe "], N.vat_status) == ["Yes", "No", "maybe"]
    assert col(spark, ["mi", "m", "KM", "leagues"], N.mileage_unit) == ["Miles", "Miles", "Km", "leagues"]


def test_issues_and_gates(spark):
    row = dict.fromkeys(FIELD_ORDER, "") | {"vrm": "A!", "incident_date": "31/02/2024", "mileage": "x", "vat_status": "maybe", "mileage_unit": "Miles", "reference": "R1"}
    df = spark.createDataFrame([tuple(row[f] for f in FIELD_ORDER)], ", ".join(f"{f} string" for f in FIELD_ORDER))
    codes = [x["code"] for x in df.select(issues_of({f: F.col(f) for f in FIELD_ORDER})).head()[0]]
    assert codes == ["missing_required_field"] * 4 + ["invalid_date_format", "invalid_vrm", "invalid_mileage", "invalid_vat"]
    doc = batch.Doc(["Reg: AB12 CDE"], "Reg: AB12 CDE at AB1 2DE", [], None)
    cases = [("claimant_name", "AB12 CDE"), ("claimant_name", "Jo Bloggs"), ("vehicle_model", ""), ("vehicle_model", "Ford AB12CDE"), ("vehicle_model", "Ford Fiesta"), ("vrm", "AB1"), ("vrm", "AB12CDE"), ("reference", "please"), ("reference", "R/1"), ("incident_date", "x"), ("inspection_address", "the introducer said")]
    df = spark.createDataFrame([(f, v) for f, v in cases], "f string, v string")
    got = [df.where(F.col("f") == f).where(F.col("v") == v).select(suspicious(f, F.col("v"), F.lit(doc.text), F.lit("AB12 CDE"))).head()[0] for f, v in cases]
    assert got == [batch.suspicious(f, v, doc) for f, v in cases]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(string.ascii_lowercase + " :", max_size=30), max_size=6), st.text(string.ascii_lowercase + " ", min_size=1, max_size=12))
def test_locate_equals_unbounded_search(lines, label):
    """The bounds of ``Finder`` lose nothing against comparing everything."""
    if not label.strip():
        return
    target, size = label.strip(), len(label.split())
    best, where = 0.0, None
    for i, t in enumerate(lines):
        low = t.strip()
        words = low.split()
        for w in [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(low) > len(target) + 5 else [low]:
            r = ratio(target, w)
            if r > best:
                best, where = r, i
    want = (where, best) if where is not None and best >= 0.72 else None
    assert Finder([label], 0.72).locate([lines])[0].get(label.lower().strip()) == want
