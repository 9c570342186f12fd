"""Exports: ordered JSON, letters, full records and documents as JSON, paths that do not collide."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafline.functions.text import address_block, ordinal_date, safe_filename
from sheafline.schema import DATES, DOCUMENT, FIELD_ORDER, FIELDS
from sheafline.session import cut


def _v(f: str) -> Column:
    return F.coalesce(F.col(f), F.lit(""))


def export_problems() -> Column:
    """What keeps a wide record from being exported: always checked, never silently dropped."""
    tests = [("work_provider", F.trim(_v("work_provider")) == ""), ("vrm", F.trim(_v("vrm")) == "")]
    tests += [(f, ~_v(f).rlike(r"^$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$")) for f in DATES]
    tests += [("inspection_address", ~_v("inspection_address").rlike(r"^[^\n]*(\n[^\n]*){5}$")), ("vat_status", ~_v("vat_status").isin("", "Yes", "No")),
              ("mileage", ~_v("mileage").rlike("^$|^[0-9]+$")), ("mileage_unit", ~_v("mileage_unit").isin("", "Miles", "Km"))]
    return F.array_compact(F.array(*(F.when(bad, F.lit(f)) for f, bad in tests)))


def export_json(records: DataFrame, key: str) -> DataFrame:
    """key, problems, json: the 13 fields by display name, in order, nulls as empty strings; json is null where there are problems."""
    body = F.to_json(F.struct(*(_v(f).alias(FIELDS[f]) for f in FIELD_ORDER)), {"ignoreNullFields": "false"})
    p = records.withColumn("problems", export_problems())
    return p.select(key, "problems", F.when(F.size("problems") == 0, body).alias("json"))


def record_json(records: DataFrame, key: str) -> DataFrame:
    return records.select(key, F.to_json(F.struct(*(c for c in records.columns if c != key)), {"ignoreNullFields": "false"}).alias("json"))


def document_json(docs: DataFrame) -> DataFrame:
    return docs.select("source_path", F.to_json(F.struct(*(c for c in docs.columns)), {"ignoreNullFields": "false"}).alias("json"))


def document_from_json(df: DataFrame, column: str) -> DataFrame:
    """Inverse of ``document_json``; malformed text gives a row of nulls."""
    return df.select(F.from_json(column, DOCUMENT).alias("d")).select("d.*")


def record_from_map(df: DataFrame, key: str, values: str) -> DataFrame:
    """A wide record from a map of values; unknown keys are dropped, missing ones are empty."""
    return df.select(key, *(F.coalesce(F.get(F.map_values(F.map_filter(values, lambda k, _: k == F.lit(f))), F.lit(0)), F.lit("")).alias(f) for f in FIELD_ORDER))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``unique_name``: later rows of one name get ``_2``, ``_3`` and so on (before the suffix of a file); a null name stays null.

    Rows are cut into ranges of (name, order) and numbered within them from where the ranges before ended, so that a name
    that many rows share is not numbered in one task.
    """
    ranges = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), name, order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("count").over(Window.partitionBy(name).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy(name, "_range").count().withColumn("_before", F.coalesce(before, F.lit(0))).drop("count")
    n = F.row_number().over(Window.partitionBy(name, "_range").orderBy(order)) + F.col("_before")
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    unique = F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix))
    return ranges.join(starts, [name, "_range"], "left").withColumn("unique_name", unique).select(*df.columns, "unique_name")


def output_folder(as_of: Column) -> Column:
    """``yyyyMMdd_HHmmss_{work provider}_{vrm}``."""
    return F.concat_ws("_", F.date_format(as_of, "yyyyMMdd_HHmmss"), safe_filename(_v("work_provider")), safe_filename(_v("vrm")))


def bundle_name(suffix: str) -> Column:
    return F.concat(safe_filename(_v("work_provider")), F.lit("_"), safe_filename(_v("vrm")), F.lit(suffix))


#: Paragraphs of the letter; braces hold the columns of ``letter_values``. A parameter.
LETTER = (
    "{today}", "Our reference: {reference}", "Registration: {vrm}", "Vehicle: {vehicle_model}", "For: {claimant_name}", "",
    "We have been asked by {work_provider} to inspect this vehicle after the event of {incident}.", "The inspection is to take place on {inspection} at:", "{line1}", "{line2}", "{line3}",
)


def letter_values(records: DataFrame, as_of: Column) -> DataFrame:
    block = address_block(_v("inspection_address"))
    return records.withColumns({
        "today": ordinal_date(F.date_format(as_of, "dd/MM/yyyy")), "incident": ordinal_date(_v("incident_date")), "inspection": ordinal_date(_v("inspection_date")),
        "line1": block[0], "line2": block[1], "line3": block[2],
    })


def docx(paragraphs: list[str]) -> bytes:
    """A minimal word-processing file of plain paragraphs."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        files = {
            "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {w}><w:body>{body}</w:body></w:document>',
        }
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def letters(records: DataFrame, key: str, as_of: Column, template: tuple[str, ...] = LETTER) -> DataFrame:
    """key, name, content: a DOCX letter for each wide record."""
    values = letter_values(records, as_of)
    names = sorted({n for p in template for n in reduce(lambda a, b: a + [b.split("}")[0]], p.split("{")[1:], [])})
    src = values.select(key, bundle_name(".docx").alias("name"), *(F.coalesce(F.col(n), F.lit("")).alias(f"v_{n}") for n in names))
    kind = dict(src.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i + 2).to_pylist() for i, n in enumerate(names)}
            out = [docx([p.format(**{n: cols[n][i] for n in names}) for p in template]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=[key, "name", "content"])

    return src.mapInArrow(run, f"`{key}` {kind}, name string, content binary")


def write_audit(records: DataFrame, texts: DataFrame, summary: DataFrame, folder: str) -> None:
    """records/ and summary/ as JSON lines, texts/ as text."""
    records.write.mode("overwrite").json(f"{folder}/records")
    texts.select("plain_text").write.mode("overwrite").text(f"{folder}/texts")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def bundles(records: DataFrame, key: str, as_of: Column, images: DataFrame | None = None, docx: bool = False) -> DataFrame:
    """folder, name, content: what is written for each wide record that may be exported: its JSON, its letter, its pictures (source_path, name, image).

    A folder is named by time, work provider and plate; the folders of equal names are numbered.
    """
    good = records.join(export_json(records, key).where(F.col("json").isNotNull()).select(key, "json"), key)
    named = unique_names(good.withColumn("folder", output_folder(as_of)), "folder", key).drop("folder").withColumnRenamed("unique_name", "folder")
    files = named.select("folder", bundle_name(".json").alias("name"), F.encode("json", "UTF-8").alias("content"))
    if docx:
        files = files.unionByName(letters(named, key, as_of).join(named.select(key, "folder"), key).select("folder", "name", "content"))
    if images is not None:
        n = F.row_number().over(Window.partitionBy("source_path").orderBy("name"))
        suffix = F.concat(F.lit("."), F.coalesce(F.nullif(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("bin")))
        numbered = images.select("source_path", "image", F.concat(F.lit("_img_"), n.cast("string"), suffix).alias("_end"))
        files = files.unionByName(named.join(numbered, F.col(key) == F.col("source_path")).select("folder", F.concat(bundle_name(""), "_end").alias("name"), F.col("image").alias("content")))
    return files


def write_files(files: DataFrame, out: str) -> int:
    """Writes rows of folder, name and content below ``out``, a path that all hosts share; returns how many. A file that stands is replaced, so that a task may be repeated."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, name, content in zip(*(c.to_pylist() for c in b.columns)):
                os.makedirs(os.path.join(out, folder), exist_ok=True)
                with open(os.path.join(out, folder, name), "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("folder", "name", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
