"""Command line: read, detect, extract, process, audit, providers, rules, export, images, version.

Exit codes: 0 done, 1 some file failed, 2 usage, 4 unknown provider, 5 required fields missing (with --fail-on-missing).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators import catalog as C
from sheafline.operators import record as R
from sheafline.operators.detect import detect, resolve
from sheafline.functions.text import source_stem
from sheafline.schema import REQUIRED
from sheafline.sinks import exports as X
from sheafline.sources import readers

VERSION = "0.1.0"


def _session() -> SparkSession:
    return SparkSession.builder.appName("sheafline").getOrCreate()


def _records(spark: SparkSession, a: argparse.Namespace, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    catalog = C.load(spark, a.catalog)
    docs = readers.read_content(readers.scan(spark, path or a.path, a.recursive)).persist()
    matched = detect(docs.withColumn("plain_text", F.coalesce("plain_text", F.lit(""))), catalog)
    used = resolve(matched, catalog, a.on_unmatched, a.provider).withColumn("provider_id", F.col("used_provider"))
    ready = R.documents_of(used).withColumnRenamed("source_path", "doc_id")
    return docs, R.extract_records(ready, C.rows(catalog), key="doc_id")


def _with_report(spark: SparkSession, a: argparse.Namespace, wide: DataFrame) -> DataFrame:
    """``wide`` with the engineer's reports laid over it: a single report over a single record, else by plate."""
    report = R.wide(_records(spark, a, a.engineer_report)[1], "doc_id").drop("doc_id", "provider_id")
    if wide.count() == 1 and report.count() == 1:
        return R.overlay(wide.withColumn("_key", F.lit(1)), report.withColumn("_key", F.lit(1)), "_key").drop("_key")
    by_plate = report.where(F.col("vrm") != "").dropDuplicates(["vrm"])
    return R.overlay(wide.withColumn("_key", F.col("vrm")), by_plate.withColumn("_key", F.col("vrm")), "_key").drop("_key")


def _print(df: DataFrame, limit: int) -> None:
    for r in df.limit(limit).toJSON().collect():
        print(r)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sheafline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("read", "detect", "extract", "process", "audit", "export", "images"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--catalog")
        s.add_argument("--provider")
        s.add_argument("--on-unmatched", choices=("none", "first"), default="none")
        s.add_argument("--recursive", action="store_true")
        s.add_argument("--out")
        s.add_argument("--show", type=int, default=20)
        s.add_argument("--fail-on-missing", action="store_true")
        s.add_argument("--format", choices=("json", "docx"), default="json")
        s.add_argument("--engineer-report", help="process: file or folder of reports laid over the records")
        s.add_argument("--out-dir", help="process: a folder for each record with its JSON, and with --docx its letter, with --images its pictures")
        s.add_argument("--records-dir", help="process: the full record of each file as JSON")
        s.add_argument("--docx", action="store_true")
        s.add_argument("--images", action="store_true")
        s.add_argument("--include-document", action="store_true", help="extract: the lines of the document beside its record")
    s = sub.add_parser("providers")
    s.add_argument("action", choices=("list", "show", "import", "check", "delete", "export", "set"))
    s.add_argument("--catalog")
    s.add_argument("--incoming")
    s.add_argument("--id")
    s.add_argument("--replace", action="store_true")
    s.add_argument("--column", help="set: the column, with --value as JSON")
    s.add_argument("--value")
    s.add_argument("--out")
    s = sub.add_parser("rules")
    s.add_argument("action", choices=("show", "run", "set"))
    s.add_argument("--id")
    s.add_argument("--out")
    s.add_argument("path", nargs="?")
    s.add_argument("--catalog")
    s.add_argument("--field")
    s.add_argument("--rule", help="a rule as JSON")
    s.add_argument("--recursive", action="store_true")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    spark = _session()
    if a.command == "providers":
        return _providers(spark, a)
    if a.command == "rules":
        if a.action == "show":
            _print(C.load(spark, a.catalog).select("provider_id", "field_rules"), 10_000)
        elif a.action == "set":
            catalog = C.load(spark, a.catalog)
            if not catalog.where(F.col("provider_id") == a.id).limit(1).count():
                return 4
            _save(C.set_rule(catalog, a.id, a.field, json.loads(a.rule)), a.out or a.catalog)
        else:
            docs = readers.read_content(readers.scan(spark, a.path, a.recursive)).withColumnRenamed("source_path", "doc_id")
            _print(R.rerun_rule(R.documents_of(docs), a.field, json.loads(a.rule), key="doc_id"), 10_000)
        return 0
    if a.command == "images":
        out = readers.images(readers.scan(spark, a.path, a.recursive))
        out.write.mode("overwrite").parquet(a.out) if a.out else _print(out.select("source_path", "name"), a.show)
        return 0
    if a.command in ("read", "detect"):
        docs = readers.read_content(readers.scan(spark, a.path, a.recursive))
        out = docs if a.command == "read" else detect(docs, C.load(spark, a.catalog)).select("source_path", "provider_id", "provider_name", "confidence", "matched_terms")
        out.write.mode("overwrite").json(a.out) if a.out else _print(out, a.show)
        return int(docs.where(F.col("reader_error").isNotNull()).limit(1).count())
    try:
        docs, records = _records(spark, a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 4
    wide = R.wide(records, "doc_id").persist()
    if a.engineer_report:
        wide = _with_report(spark, a, wide).persist()
    if a.command == "audit":
        flagged = wide.join(R.audit_flags(wide, "doc_id"), "doc_id")
        X.write_audit(X.record_json(records, "doc_id"), docs.where("plain_text is not null"), R.audit_summary(flagged), a.out or "audit")
    elif a.command == "export" and a.format == "docx":
        X.letters(wide, "doc_id", F.current_timestamp()).write.mode("overwrite").parquet(a.out or "letters")
    elif a.command == "export":
        out = X.export_json(wide, "doc_id")
        out.write.mode("overwrite").json(a.out) if a.out else _print(out, a.show)
    elif a.command == "process" and (a.out_dir or a.records_dir):
        if a.records_dir:
            name = F.concat(source_stem(F.regexp_extract("doc_id", r"([^/]+)$", 1)), F.lit(".json"))
            full = X.record_json(records, "doc_id").select("doc_id", name.alias("name"), F.encode("json", "UTF-8").alias("content"))
            X.write_files(X.unique_names(full, "name", "doc_id").select(F.lit(".").alias("folder"), F.col("unique_name").alias("name"), "content"), a.records_dir)
        if a.out_dir:
            pictures = readers.images(readers.scan(spark, a.path, a.recursive)) if a.images else None
            X.write_files(X.bundles(wide, "doc_id", F.current_timestamp(), pictures, a.docx), a.out_dir)
    else:
        out = R.long(records, "doc_id") if a.command == "extract" else wide
        if a.command == "extract" and a.include_document:
            out = out.join(docs.select(F.col("source_path").alias("doc_id"), "source_type", "plain_text", "lines"), "doc_id", "left")
        out.write.mode("overwrite").json(a.out) if a.out else _print(out, a.show)
    if docs.where(F.col("reader_error").isNotNull()).limit(1).count():
        return 1
    missing = F.exists(F.array(*(F.col(f) for f in REQUIRED)), lambda v: F.trim(v) == "")
    return 5 if a.fail_on_missing and wide.where(missing).limit(1).count() else 0


def _save(catalog: DataFrame, path: str) -> None:
    text = C.to_json(catalog)  # read in full before the file is replaced
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _providers(spark: SparkSession, a: argparse.Namespace) -> int:
    catalog = C.load(spark, a.catalog)
    if a.action == "check":
        with open(a.catalog, encoding="utf-8") as f:
            said = C.check(C.migrate(json.load(f)))
        print("\n".join(said))
        return int(bool(said))
    if a.action == "import":
        catalog = C.upsert(catalog, C.load(spark, a.incoming), replace=a.replace)
    elif a.action in ("export", "set"):
        if a.action == "set":
            if not catalog.where(F.col("provider_id") == a.id).limit(1).count():
                return 4
            catalog = C.set_value(catalog, a.id, a.column, json.loads(a.value))
        if a.out or a.action == "set":
            _save(catalog, a.out or a.catalog)
        else:
            print(C.to_json(catalog))
        return 0
    elif a.action == "delete":
        catalog = C.delete(catalog, a.id)
    elif a.action == "show":
        catalog = catalog.where((F.lower("provider_id") == a.id.lower()) | (F.lower("name") == a.id.lower()))
        if not catalog.limit(1).count():
            return 4
    out = catalog.orderBy("catalog_pos")
    out.coalesce(1).write.mode("overwrite").json(a.out) if a.out else _print(out if a.action == "show" else out.select("provider_id", "name", "priority", "enabled"), 10_000)
    return 0


if __name__ == "__main__":
    sys.exit(main())
