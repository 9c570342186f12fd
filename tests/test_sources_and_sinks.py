"""Readers, exports, catalog, stream, command line and the driver contract."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline.operators import catalog as C
from sheafline.schema import FIELD_ORDER, FIELDS
from sheafline.sinks import exports as X
from sheafline.sources import markup, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def docx_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The Title</dc:title></c>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Head')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {W}>{p('Foot')}{p('body two')}</w:ftr>")
        box = f"<w:p><w:r><w:txbxContent>{p('In a box')}</w:txbxContent></w:r></w:p>"
        table = "<w:tbl><w:tr><w:tc>" + p("Reg") + "</w:tc><w:tc>" + p("AB12 CDE") + "</w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Body ', 'one')}{p('Body two')}{table}{box}</w:body></w:document>")
        z.writestr("word/media/image1.png", b"\x89PNG")
    return out.getvalue()


EML = b"Subject: Hello\r\nFrom: A <a@x.example>\r\nTo: b@x.example\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<html><p>Dear Sir</p><p>Dear sir</p><p>caf\xc3\xa9</p></html>"


def test_readers(spark):
    doc = b"\xd0\xcf\x11\xe0" + b"\x00" * 64 + ("Our client was hit at the junction and the bumper is damaged beyond repair today.".encode("utf-16-le")) + b"\x01\x02" + b"Vehicle registration AB12 CDE and more text"
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}Our reference \'a31,000 applies to this matter and nothing else.\par Please inspect the vehicle at the yard of the repairer without delay.}"
    files = [("a.docx", docx_file()), ("b.EML", EML), ("c.doc", doc), ("r.doc", rtf), ("d.txt", b"x"), ("e.docx", b"broken"), ("f.eml", None), ("g.doc", b"\x00\x01"), ("h.msg", b"x")]
    rows = {r["source_path"]: r for r in readers.read_content(spark.createDataFrame(files, "path string, content binary")).collect()}
    a = rows["a.docx"]
    assert [(x["text"], x["block_id"]) for x in a["lines"]] == [("The Title", "header"), ("Head", "header"), ("Body one", "body"), ("Body two", "body"), ("Reg | AB12 CDE", "table_0"), ("In a box", "textbox"), ("Foot", "footer")]
    assert rows["b.EML"]["plain_text"].startswith("Subject: Hello\nFrom: A <a@x.example>\nTo: b@x.example\n\nDear Sir")
    assert [x["text"] for x in rows["b.EML"]["lines"]][-1] == "café" and sum(x["text"].lower() == "dear sir" for x in rows["b.EML"]["lines"]) == 1
    assert "bumper is damaged" in rows["c.doc"]["plain_text"] and "£1,000" in rows["r.doc"]["plain_text"]
    assert [rows[k]["reader_error"] for k in ("a.docx", "d.txt", "e.docx", "f.eml", "g.doc")] == [None, "unsupported_format", "reader_error", None, "reader_error"]
    assert rows["h.msg"]["reader_error"] in ("dependency_missing", "reader_error")
    img = readers.images(spark.createDataFrame(files[:1] + files[5:6], "path string, content binary")).collect()
    assert [(r["source_path"], r["name"], bytes(r["image"])) for r in img] == [("a.docx", "image1.png", b"\x89PNG")]


def test_markup():
    assert markup.decode(b"caf\xe9") == "café" and markup.decode("é".encode()) == "é" and markup.decode(None) == ""
    assert markup.html_text("a&eacute;<br>b") == "aé\nb"
    assert markup.html_text("a<style>x</style>b<!-- c -->d\x85") == "a b d..." and markup.html_text("<tr><td>1</td><td>2</td></tr>") == "1 2"
    assert markup.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}{\f1 Times;}}{\*\x y}It\rquote s \'a31\par two\tab x}") == "It's £1\ntwo\tx"
    assert markup.rtf_text(r"{\rtf1 one\par two \~x}", mail=True) == "one two x"
    line = b"The Vehicle was seen at the yard of the repairer on the second of May in the rain"
    twice = line + b"\x00\x01" + line.upper() + b"\x00\x02" + "£ and some more words here".encode("utf-16-le")
    assert markup.scrape(twice) == line.decode() + "\n£ and some more words here"
    assert markup.human("a_b (x)") and not markup.human("+++%%%*** a1") and not markup.human("a\tb")
    assert not markup.human("\x00\x01") and not markup.human("12") and markup.human("AB12 CDE")
    assert readers.needs_ocr(2, [1, 1]) and not readers.needs_ocr(3, [1, 1, 1]) and not readers.needs_ocr(1, [2])
    assert readers.uni("/uni0041b") == "Ab"


def wide(spark, **values):
    row = dict.fromkeys(FIELD_ORDER, "") | {"work_provider": "Acme", "vrm": "AB12CDE", "inspection_address": "\n" * 5} | values
    return spark.createDataFrame([(1, *(row[f] for f in FIELD_ORDER))], "k long, " + ", ".join(f"{f} string" for f in FIELD_ORDER))


def test_export_json(spark):
    good = X.export_json(wide(spark, reference="é"), "k").head()
    assert list(json.loads(good["json"])) == list(FIELDS.values()) and json.loads(good["json"])["Reference"] == "é" and good["problems"] == []
    bad = X.export_json(wide(spark, work_provider=" ", mileage="x", incident_date="soon"), "k").head()
    assert bad["json"] is None and bad["problems"] == ["work_provider", "incident_date", "mileage"]


def test_letters_read_back(spark):
    made = X.letters(wide(spark, reference="R & D <1>", inspection_address="a\nb\nc\nd\n\nAB1 2DE", incident_date="03/04/2024"), "k", F.lit("2026-04-15").cast("timestamp"))
    got = readers.read_content(made.select(F.col("name").alias("path"), "content")).head()
    assert got["source_path"] == "Acme_AB12CDE.docx" and "R & D <1>" in got["plain_text"] and "3rd April 2024" in got["plain_text"] and "15th April 2026" in got["plain_text"]


def test_round_trips_and_names(spark):
    docs = readers.read_content(spark.createDataFrame([("b.eml", EML)], "path string, content binary"))
    back = X.document_from_json(X.document_json(docs), "json")
    assert [r.asDict(True) for r in back.select(*docs.columns).collect()] == [r.asDict(True) for r in docs.collect()]
    names = spark.createDataFrame([(1, "a.json"), (2, "a.json"), (3, "b"), (4, "b"), (5, "a.json")], "k long, name string")
    assert [r["unique_name"] for r in X.unique_names(names, "name", "k").orderBy("k").collect()] == ["a.json", "a_2.json", "b", "b_2", "a_3.json"]
    m = spark.createDataFrame([(1, {"vrm": "X", "odd": "y"}), (2, None)], "k long, m map<string,string>")
    assert [(r["vrm"], r["reference"]) for r in X.record_from_map(m, "k", "m").orderBy("k").collect()] == [("X", ""), ("", "")]


OLD = {"providers": [{
    "name": "Acme & Co", "detect_phrases": ["Acme"], "colour": "red", "engineer_report": True,
    "field_rules": {
        "vrm": {"method": "labels", "config": "Reg, VRM"}, "reference": {"method": "two_labels", "config": "Ref||Date"}, "claimant_name": {"config": "Client"}, "mileage": {"method": "fixed_position", "config": "3-5"}, "work_provider": {"method": "manual_input", "config": " Acme Ltd "},
        "vat_status": {"method": "labels", "config": "vat, registered"}, "mileage_unit": {"method": "x", "config": "km, kilometres"}, "incident_date": {"method": "single_label_offset", "config": "Date||-2"}, "inspection_date": {"method": "fixed_position_label", "config": "4||On"}, "instruction_date": {"method": "email_date", "config": "Sent, on"}, "odd": {"config": "x"},
    },
}, {"name": "***"}]}


def test_migration_and_catalog(spark):
    new = C.migrate(OLD)["providers"]
    r = new[0]["field_rules"]
    assert (new[0]["id"], new[1]["id"], new[0]["work_provider"], new[0]["metadata"]) == ("acme__co", "provider", "Acme Ltd", {"colour": "red"})
    assert (r["vrm"]["kind"], r["claimant_name"]["kind"], r["reference"]["start_label"], r["mileage"]["line_start"], r["vat_status"]["kind"], r["mileage_unit"]["value"], r["incident_date"]["offset"], r["inspection_date"]["line_number"], r["instruction_date"]["labels"]) == ("label_same_line", "label_same_or_next_line", "Ref", 3, "presence", "Km", -2, 4, ["Sent, on"])
    assert "odd" not in r and len(C.check({"providers": [{"id": "X", "field_rules": {"vrm": {"kind": "no", "labels": [""]}}}]})) == 4
    frame = C.to_frame(spark, OLD)
    inc = C.to_frame(spark, {"schema_version": 2, "providers": [{"id": "zeta", "name": "Z"}, {"id": "acme__co", "name": "Changed"}]})
    got = C.upsert(frame, inc).orderBy("catalog_pos").collect()
    assert [(x["provider_id"], x["name"], x["catalog_pos"]) for x in got] == [("acme__co", "Changed", 0), ("provider", "***", 1), ("zeta", "Z", 2)]
    assert [x["provider_id"] for x in C.delete(frame, "ACME & co").collect()] == ["provider"]
    changed = C.set_rule(C.set_value(frame, "provider", "priority", 7), "provider", "vrm", {"id": "v", "kind": "manual", "value": "x", "labels": ["l"]}).where("provider_id = 'provider'").head()
    assert changed["priority"] == 7 and changed["field_rules"]["vrm"]["value"] == "x"
    assert C.load(spark).count() == 1


def test_drop_folder(spark, tmp_path):
    from sheafline.streaming import dropfolder

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx_file())
    (tmp_path / "in/bad.docx").write_bytes(b"x")
    got = {}
    cat = C.load(spark).select("provider_id", "name", "work_provider", "enabled", "priority", "detect", "catalog_pos")
    q = dropfolder.run(spark, str(tmp_path / "in"), cat, lambda df, n: got.update({r["doc_id"].rpartition("/")[2]: r for r in df.collect()}), str(tmp_path / "ck"), fuzzy=False)
    q.awaitTermination(120)
    assert q.exception() is None and set(got) == {"a.docx", "bad.docx"} and got["a.docx"]["vrm"] == "AB12CDE" and got["bad.docx"]["reader_error"] == "reader_error"


def test_command_line(spark, tmp_path, capsys):
    from sheafline import cli

    (tmp_path / "a.docx").write_bytes(docx_file())
    assert cli.main(["version"]) == 0
    assert cli.main(["read", str(tmp_path)]) == 0
    assert cli.main(["process", str(tmp_path), "--provider", "nobody"]) == 4
    assert cli.main(["process", str(tmp_path), "--fail-on-missing"]) == 5
    assert cli.main(["providers", "list"]) == 0
    assert '"vrm":"AB12CDE"' in capsys.readouterr().out


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "sheafline"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "sheafline.llm" not in f.read_text(encoding="utf-8"), f


@pytest.mark.parametrize("name", ["norm_date", "detect_providers", "rule_next_line", "scorecard"])
def test_queries_equal_sql(spark, name):
    import glob
    import os

    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    con.execute(f"create table want as {e.oracle_sql()[name]}")
    got = e.queries()[name](spark, d)
    cols = sorted(got.columns)
    want = sorted(map(str, con.execute(f"select {', '.join(cols)} from want").fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == want


def test_command_line_writes(spark, tmp_path):
    import json

    from sheafline import cli
    from sheafline.sinks.exports import docx

    inbox, reports = tmp_path / "in", tmp_path / "reports"
    inbox.mkdir()
    reports.mkdir()
    lines = ["Acme Law", "Our Ref: Q123-01", "Client Name: Mr Jo Bloggs", "Vehicle Registration: AB12 CDE", "Make/Model: Ford Fiesta", "Date of Accident: 3rd March 2024", "Received: 05/03/2024", "Inspection Address: Unit 4, 1 High St, Town, AB1 2DE"]
    (inbox / "a.docx").write_bytes(docx(lines))
    (reports / "r.docx").write_bytes(docx(["Acme Law", "Vehicle Registration: AB12 CDE", "Make/Model: Ford Fiesta Zetec", "Mileage: 12,345 miles"]))
    catalog = tmp_path / "catalog.json"
    catalog.write_text(json.dumps({"schema_version": 2, "providers": [{"id": "acme", "name": "Acme", "work_provider": "Acme Law", "enabled": True, "detect": {"required_phrases": ["acme law"]}}]}))
    assert cli.main(["rules", "set", "--catalog", str(catalog), "--id", "acme", "--field", "reference", "--rule", json.dumps({"id": "r", "kind": "label_same_line", "labels": ["Our Ref"]})]) == 0
    assert cli.main(["providers", "set", "--catalog", str(catalog), "--id", "acme", "--column", "priority", "--value", "7"]) == 0
    assert cli.main(["providers", "export", "--catalog", str(catalog), "--out", str(tmp_path / "copy.json")]) == 0
    kept = json.loads((tmp_path / "copy.json").read_text())["providers"][0]
    assert kept["priority"] == 7 and kept["field_rules"]["reference"]["labels"] == ["Our Ref"] and kept["id"] == "acme"
    assert cli.main(["rules", "set", "--catalog", str(catalog), "--id", "nobody", "--field", "vrm", "--rule", "{}"]) == 4
    catalog.write_text(json.dumps({"schema_version": 2, "providers": [{k: v for k, v in kept.items() if k != "field_rules"}]}))
    out, full = tmp_path / "out", tmp_path / "records"
    assert cli.main(["process", str(inbox), "--catalog", str(catalog), "--engineer-report", str(reports), "--out-dir", str(out), "--records-dir", str(full), "--docx", "--images"]) == 0
    made = sorted(p.name for p in out.rglob("*") if p.is_file())
    assert len(made) == 2 and {m.rpartition(".")[2] for m in made} == {"docx", "json"}
    record = json.loads(next(out.rglob("*.json")).read_text())
    assert record["VRM"] == "AB12CDE" and record["Vehicle Model"] == "Ford Fiesta Zetec" and record["Mileage"] == "12345" and record["Reference"] == "Q123-01"
    assert [p.name for p in full.rglob("*.json")] == ["a.docx.json"]
    assert cli.main(["extract", str(inbox), "--catalog", str(catalog), "--include-document", "--out", str(tmp_path / "long")]) == 0
    assert spark.read.json(str(tmp_path / "long")).where("plain_text like 'Acme Law%'").count() == 13
