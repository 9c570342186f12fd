"""Shapes of documents, rules, matches and records."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of a record in the order of evaluation and export, with their display names; those that must be filled.
FIELDS = {
    "work_provider": "Work Provider", "vrm": "VRM", "vehicle_model": "Vehicle Model", "claimant_name": "Claimant Name", "reference": "Reference", "incident_date": "Incident Date",
    "instruction_date": "Instruction Date", "inspection_date": "Inspection Date", "accident_circumstances": "Accident Circumstances", "inspection_address": "Inspection Address",
    "vat_status": "VAT Status", "mileage": "Mileage", "mileage_unit": "Mileage Unit",
}
FIELD_ORDER = tuple(FIELDS)
REQUIRED = ("work_provider", "vrm", "vehicle_model", "claimant_name", "reference", "incident_date", "instruction_date")
DATES = ("incident_date", "instruction_date", "inspection_date")

SPAN = T.StructType([T.StructField("page_index", T.IntegerType()), T.StructField("line_index", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
LINE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("line_index", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("block_id", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("field", "severity", "code", "message")])
EXTRACTION = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("raw_value", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("source_span", SPAN), T.StructField("issues", T.ArrayType(ISSUE)),
])
RULE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("start_label", T.StringType()), T.StructField("end_label", T.StringType()),
    T.StructField("line_number", T.IntegerType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("pattern", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("value", T.StringType()), T.StructField("absent_value", T.StringType()),
])
DETECT = T.StructType([
    T.StructField("required_phrases", T.ArrayType(T.StringType())), T.StructField("optional_phrases", T.ArrayType(T.StringType())),
    T.StructField("negative_phrases", T.ArrayType(T.StringType())), T.StructField("minimum_confidence", T.DoubleType()),
])
PROVIDER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("work_provider", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("priority", T.IntegerType()),
    T.StructField("engineer_report", T.BooleanType()), T.StructField("use_current_date_for_inspection_date", T.BooleanType()), T.StructField("force_postcode_for_inspection_address", T.BooleanType()),
    T.StructField("detect", DETECT), T.StructField("field_rules", T.MapType(T.StringType(), RULE)), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
DOCUMENT = T.StructType([
    T.StructField("source_path", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("plain_text", T.StringType()), T.StructField("lines", T.ArrayType(LINE)),
    T.StructField("raw_lines", T.ArrayType(T.StringType())), T.StructField("reader_notes", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reader_error", T.StringType()),
])
