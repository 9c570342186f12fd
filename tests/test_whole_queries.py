"""Queries over texts with signs of many kinds, against their SQL and against plain Python."""

import re

import pytest

from sheafline.plans.core_queries import ORACLES, QUERIES

TEXTS = [
    "Mileage 12,000 miles\nmileage 12,000 MILES\n\nend", "£120 – café\n£120 – CAFÉ\nthe “quote”  10 km", "a\r\nb\x0bc d　\n A", "10 kmé", "été\x85ÉTÉ 5 mi", "tab\there_x", "", None, "naïve\nZoë 3 kilometres",
]
NAMES = ("search_norm", "read_lines", "line_dedup_keep_first", "fallback_unit")


def brute(name):
    out = set()
    for i, t in enumerate(TEXTS):
        lines = [(n, x.strip()) for n, x in enumerate((t or "").splitlines()) if x.strip()]
        if name == "search_norm" and t is not None:
            out.add((i, re.sub(r"\s+", " ", re.sub(r"[^\w\n ]+", " ", t.lower())).strip(" ")))
        elif name == "read_lines":
            out |= {(i, n, x.replace("\t", " ")) for n, x in lines}
        elif name == "line_dedup_keep_first":
            first = {}
            for n, x in lines:
                first.setdefault(x.replace("\t", " ").lower(), (i, n, x.replace("\t", " ")))
            out |= set(first.values())
        elif name == "fallback_unit":
            low = (t or "").lower()
            out.add((i, "Km" if re.search(r"\b(?:km|kilomet(?:er|re)s?)\b", low) else "Miles" if re.search(r"\b(?:miles?|mi)\b", low) else ""))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_all_texts_have_their_rows(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    for table, key, text in (("documents", "doc_id", "text"), ("document_models", "model_id", "plain_text")):
        spark.createDataFrame(list(enumerate(TEXTS)), f"{key} long, {text} string").coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    short = {r[:2] for r in got} if name == "fallback_unit" else got
    assert short == brute(name)
    con = duckdb.connect()
    for table in ("documents", "document_models"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    of_sql = set(con.execute(ORACLES[name]).fetchall())
    assert of_sql == got
