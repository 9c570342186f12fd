"""The provider catalog: loading, migration of the older layout, upsert, edits. Catalogs are small; frames of them carry ``catalog_pos``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheafline.schema import FIELDS, PROVIDER

ROW = T.StructType([T.StructField("catalog_pos", T.IntegerType()), T.StructField("provider_id", T.StringType()), *PROVIDER.fields[1:]])
SEED = [{"id": "general", "name": "General", "work_provider": "General", "enabled": True, "priority": -100, "detect": {"required_phrases": [], "optional_phrases": ["inspection", "vehicle"], "negative_phrases": [], "minimum_confidence": 0.75}, "field_rules": {}, "metadata": {}}]
#: The older methods and the kinds that replace them.
METHODS = {
    "single_label": "label_same_or_next_line", "labels": "label_same_line", "multiline_labels": "label_same_line", "two_labels": "between_labels", "fixed_position": "fixed_line", "fixed_position_label": "fixed_line_label",
    "single_label_offset": "line_offset", "email_date": "email_date", "manual_input": "manual", "fixed_value": "manual",
}
KNOWN_KEYS = {"name", "detect_phrases", "field_rules", "engineer_report", "use_current_date_for_inspection_date", "force_postcode_for_inspection_address"}


def slug(name: str) -> str:
    s = re.sub(r"[^a-z0-9_-]", "", name.lower().replace(" ", "_"))
    return "provider" if not s else s if s[0].isalnum() else f"p_{s}"


def _tokens(config: str) -> list[str]:
    return [t for t in (x.replace("\r", "").replace("\n", "").strip() for x in config.split(",")) if t]


def _number(s: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d+)", s)
    return int(m[1]) if m else default


def migrate_rule(field: str, method: str, config: str) -> dict:
    """A rule of the older layout in the present one."""
    config = config or ""
    if field == "vat_status":
        return {"kind": "presence", "tokens": _tokens(config), "value": "Yes", "absent_value": "No"}
    if field == "mileage_unit":
        km = "km" in config.lower()
        return {"kind": "presence", "tokens": _tokens(config), "value": "Km" if km else "Miles", "absent_value": "Miles" if km else "Km"}
    kind = METHODS.get(method or "single_label", "label_same_line")
    if kind == "between_labels":
        if "||" in config:
            start, end = (x.strip() for x in config.split("||", 1))
        else:
            rows = [x.strip() for x in config.splitlines() if x.strip()]
            start, end = rows[:2] if len(rows) > 1 else ("", "")
        return {"kind": kind, "start_label": start, "end_label": end}
    if kind == "fixed_line":
        m = re.match(r"\s*(\d+)\s*-\s*(\d+)", config)
        return {"kind": kind, "line_start": int(m[1]), "line_end": int(m[2])} if m else {"kind": kind, "line_number": max(_number(config, 1), 1)}
    if kind in ("fixed_line_label", "line_offset"):
        a, _, b = config.partition("||")
        return {"kind": kind, "line_number": _number(a, 1), "labels": [b.strip()]} if kind == "fixed_line_label" else {"kind": kind, "labels": [a.strip()], "offset": _number(b, 0)}
    if kind == "email_date":
        return {"kind": kind, "labels": [config.strip()]}
    if kind == "manual":
        return {"kind": kind, "value": config.strip()}
    return {"kind": kind, "labels": _tokens(config)}


def migrate(old: dict) -> dict:
    """A catalog of the older layout (``schema_version`` below 2) in the present one. Unknown keys of a provider go to its metadata, rules of unknown fields are dropped."""
    if (old.get("schema_version") or 1) >= 2:
        return old
    out = []
    for p in old.get("providers") or []:
        name = (p.get("name") or "").strip()
        rules = {f: {"id": f} | migrate_rule(f, r.get("method"), r.get("config")) for f, r in (p.get("field_rules") or {}).items() if f in FIELDS}
        own = ((p.get("field_rules") or {}).get("work_provider") or {}).get("config") or ""
        flags = {k: bool(p.get(k)) for k in ("engineer_report", "use_current_date_for_inspection_date", "force_postcode_for_inspection_address")}
        out.append({
            "id": slug(name), "name": name, "work_provider": own.strip() or name, "enabled": True, "priority": 0, **flags,
            "detect": {"required_phrases": [x for x in p.get("detect_phrases") or [] if x], "optional_phrases": [], "negative_phrases": [], "minimum_confidence": 0.75},
            "field_rules": rules, "metadata": {k: str(v) for k, v in p.items() if k not in KNOWN_KEYS},
        })
    return {"schema_version": 2, "providers": out}


def check(catalog: dict) -> list[str]:
    """What is wrong or doubtful in a catalog: ids, empty labels, unknown kinds, providers that fit every document."""
    from sheafline.operators.rules import KINDS

    said, seen = [], set()
    for p in catalog.get("providers") or []:
        if not re.match(r"^[a-z0-9][a-z0-9_-]*$", p.get("id") or "") or p["id"] in seen:
            said.append(f"id {p.get('id')!r} is malformed or stands twice")
        seen.add(p.get("id"))
        if not (p.get("detect") or {}).get("required_phrases"):
            said.append(f"{p.get('id')}: requires nothing, so it fits every document")
        for f, r in (p.get("field_rules") or {}).items():
            if r.get("kind", "label_same_line") not in KINDS:
                said.append(f"{p.get('id')}.{f}: unknown kind {r.get('kind')!r}")
            if any(not (x or "").strip() for x in r.get("labels") or []):
                said.append(f"{p.get('id')}.{f}: an empty label would fit every line")
    return said


def to_frame(spark: SparkSession, catalog: dict) -> DataFrame:
    names = [f.name for f in PROVIDER.fields[1:]]
    rows = []
    for i, p in enumerate(migrate(catalog).get("providers") or []):
        rules = {f: {k.name: r.get(k.name) for k in PROVIDER["field_rules"].dataType.valueType.fields} for f, r in (p.get("field_rules") or {}).items()}
        d = p.get("detect") or {}
        detect = {k: d.get(k) for k in ("required_phrases", "optional_phrases", "negative_phrases", "minimum_confidence")}
        row = {n: p.get(n) for n in names} | {"field_rules": rules, "detect": detect, "metadata": {k: str(v) for k, v in (p.get("metadata") or {}).items()}}
        rows.append((i, p.get("id"), *(row[n] for n in names)))
    return spark.createDataFrame(rows, ROW)


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The catalog in a JSON file (older layouts migrated), or the seed without one."""
    import json

    if path is None:
        return to_frame(spark, {"schema_version": 2, "providers": SEED})
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return to_frame(spark, json.loads(text))


def upsert(catalog: DataFrame, incoming: DataFrame, key: str = "provider_id", replace: bool = False) -> DataFrame:
    """``incoming`` rows take the place of rows of the same key; new ones are appended in their order. With ``replace`` only they remain. Both sides have ``catalog_pos`` and equal columns."""
    if replace:
        return incoming
    rest = [c for c in catalog.columns if c not in (key, "catalog_pos")]
    a = catalog.select(key, F.col("catalog_pos").alias("_p"), F.struct(*rest).alias("_a"))
    b = incoming.select(key, F.col("catalog_pos").alias("_q"), F.struct(*rest).alias("_b"))
    j = a.join(b, key, "full").withColumn("_row", F.coalesce("_b", "_a"))
    order = Window.orderBy(F.col("_p").isNull(), F.coalesce("_p", "_q"))  # a catalog is small
    return j.withColumn("catalog_pos", (F.row_number().over(order) - 1).cast("int")).select("catalog_pos", key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*catalog.columns)


def delete(catalog: DataFrame, selector: str) -> DataFrame:
    """Without the providers of this id or name."""
    return catalog.where(~((F.lower("provider_id") == selector.lower()) | (F.lower(F.coalesce("name", F.lit(""))) == selector.lower())))


def set_value(catalog: DataFrame, provider_id: str, column: str, value) -> DataFrame:
    return catalog.withColumn(column, F.when(F.col("provider_id") == provider_id, F.lit(value)).otherwise(F.col(column)))


def set_rule(catalog: DataFrame, provider_id: str, field: str, rule: dict) -> DataFrame:
    """One rule of one provider replaced."""
    kind = PROVIDER["field_rules"].dataType.valueType
    new = F.struct(*((F.array(*(F.lit(x) for x in rule[f.name])) if isinstance(rule.get(f.name), list) else F.lit(rule.get(f.name))).cast(f.dataType).alias(f.name) for f in kind.fields))
    others = F.map_filter(F.coalesce("field_rules", F.create_map().cast(PROVIDER["field_rules"].dataType)), lambda k, _: k != field)
    return catalog.withColumn("field_rules", F.when(F.col("provider_id") == provider_id, F.map_concat(others, F.create_map(F.lit(field), new))).otherwise(F.col("field_rules")))


def rows(catalog: DataFrame) -> list[dict]:
    """The catalog as dicts, for ``extract_records``."""
    return [r.asDict(recursive=True) for r in catalog.orderBy(*(["catalog_pos"] if "catalog_pos" in catalog.columns else ["provider_id"])).collect()]


def to_json(catalog: DataFrame) -> str:
    """The catalog as a JSON file of the present layout, which ``load`` reads; nulls are left out."""
    import json

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None}
        return [bare(v) for v in x] if isinstance(x, list) else x

    providers = [bare({"id" if k == "provider_id" else k: v for k, v in r.items() if k != "catalog_pos"}) for r in rows(catalog)]
    return json.dumps({"schema_version": 2, "providers": providers}, ensure_ascii=False, indent=2)
