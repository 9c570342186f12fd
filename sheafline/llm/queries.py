"""The queries of this subpackage, by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm.address import address_records, linked_records, same_places
from sheafline.llm.mail import find_old_lines, new_text
from sheafline.llm.mixing import mix
from sheafline.llm.mojibake import garbled_rows
from sheafline.llm.pii import find_personal
from sheafline.llm.reading import hard_documents, reading_levels
from sheafline.llm.scans import repair_scans
from sheafline.llm.tokens import encode_corpus
from sheafline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_old_lines(table(spark, sf_dir, "document_models"))


def p2_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_text(table(spark, sf_dir, "document_models"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_places(address_records(table(spark, sf_dir, "field_extractions"), table(spark, sf_dir, "expected_fixtures")))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_records(address_records(table(spark, sf_dir, "field_extractions"), table(spark, sf_dir, "expected_fixtures")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(table(spark, sf_dir, "document_lines"))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(table(spark, sf_dir, "document_lines"), texts=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "document_models"), table(spark, sf_dir, "expected_fixtures"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "document_models"), table(spark, sf_dir, "expected_fixtures"), redacted=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_rows(*(table(spark, sf_dir, n) for n in ("document_models", "document_lines", "documents")))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_rows(*(table(spark, sf_dir, n) for n in ("document_models", "document_lines", "documents")), restored=True)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Domains of the sources of these tables, the upper level of the trees.
DOMAINS = {
    "instruction_letters": "correspondence", "garage_messages": "correspondence", "claims_notes": "correspondence",
    "engineer_reports": "technical", "valuation_sheets": "technical", "salvage_bulletins": "technical", "training_notes": "technical",
    "policy_wordings": "legal", "court_bundles": "legal",
    "help_pages": "public", "driver_interviews": "public", "hire_invoices": "finance",
}


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domains=DOMAINS)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domains=DOMAINS)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_new_text": p2_new_text, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_texts": p4_texts, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_restored": p6_restored, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels}
ORACLES: dict[str, str] = {}
