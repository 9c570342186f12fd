"""Detection of the provider of a document by the phrases of a catalog.

Two plans for one result, neither with a join, a shuffle or a row for a pair. Catalogs up to ``IN_ROW`` are scored inside each
row, as a literal array; larger ones a block of providers at a time in an Arrow pass that looks each phrase up once
and keeps the best candidate of a document, so that what is broadcast at once is bounded whatever the catalog's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.binding import bind
from sheafline.functions.text import search_form, strip

try:
    import ahocorasick
except ImportError:  # phrases are then sought one by one
    ahocorasick = None

#: Providers scored in the row, and those of a block.
IN_ROW, BLOCK = 200, 20_000
UNKNOWN = "Unknown / Unmapped"


def prepared(catalog: DataFrame) -> DataFrame:
    """The enabled providers with lists of (as written, search form) phrases; catalog_pos breaks ties (order of id if absent)."""
    if "catalog_pos" not in catalog.columns:
        from pyspark.sql.window import Window

        catalog = catalog.withColumn("catalog_pos", F.row_number().over(Window.orderBy("provider_id")) - 1)
    both = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.struct(p.alias("term"), F.lower(strip(p)).alias("low"), search_form(p).alias("norm")))
    d = F.col("detect")
    return catalog.where(F.coalesce("enabled", F.lit(True))).select(
        "provider_id", "name", "catalog_pos", F.coalesce("priority", F.lit(0)).alias("priority"), both(d["required_phrases"]).alias("required"), both(d["optional_phrases"]).alias("optional"),
        both(d["negative_phrases"]).alias("negative"), F.coalesce(d["minimum_confidence"], F.lit(0.75)).alias("minimum"),
    )


def _has(low: Column, norm: Column, p: Column) -> Column:
    return ((p["low"] != "") & low.contains(p["low"])) | ((p["norm"] != "") & norm.contains(p["norm"]))


def _score(low: Column, norm: Column, r) -> Column:
    """The candidate a provider makes, null if it is rejected."""
    hits = F.filter(r["optional"], lambda p: _has(low, norm, p))
    n = F.size(r["optional"])
    conf = F.when(n == 0, F.lit(1.0)).otherwise(F.lit(0.8) + F.lit(0.2) * (F.size(hits) / n))
    ok = F.forall(r["required"], lambda p: _has(low, norm, p)) & ~F.exists(r["negative"], lambda p: _has(low, norm, p)) & (conf >= r["minimum"])
    terms = F.transform(F.concat(r["required"], hits), lambda p: p["term"])
    return F.when(ok, F.struct(
        conf.alias("confidence"), r["priority"].alias("priority"), F.size(r["required"]).alias("n_required"), (-r["catalog_pos"]).alias("neg_pos"),
        r["provider_id"].alias("provider_id"), r["name"].alias("provider_name"), terms.alias("matched_terms"),
    ))


def _literal(rows: list) -> Column:
    phrases = lambda ps: F.array(*(F.struct(*(F.lit(p[k]).alias(k) for k in ("term", "low", "norm"))) for p in ps)) if ps else F.array().cast("array<struct<term:string,low:string,norm:string>>")
    return F.array(*(
        F.struct(
            F.lit(r["provider_id"]).alias("provider_id"), F.lit(r["name"]).alias("name"), F.lit(r["catalog_pos"]).alias("catalog_pos"), F.lit(r["priority"]).alias("priority"),
            phrases(r["required"]).alias("required"), phrases(r["optional"]).alias("optional"), phrases(r["negative"]).alias("negative"), F.lit(r["minimum"]).alias("minimum"),
        ) for r in rows
    ))


def _named(best: Column) -> list[Column]:
    return [
        best["provider_id"].alias("provider_id"), F.coalesce(best["provider_name"], F.lit(UNKNOWN)).alias("provider_name"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(best["matched_terms"], F.array().cast("array<string>")).alias("matched_terms"),
    ]


def detect(docs: DataFrame, catalog: DataFrame, text: str = "plain_text") -> DataFrame:
    """``docs`` with provider_id, provider_name, confidence, matched_terms of the best provider: highest confidence, then priority, then number of required phrases, then first in the catalog.

    Documents that none fits (null and empty texts, unless a provider requires nothing) get a null id and confidence 0.
    """
    rows = prepared(catalog).orderBy("catalog_pos").limit(IN_ROW + 1).collect()
    keep = [c for c in docs.columns if c not in ("provider_id", "provider_name", "confidence", "matched_terms")]
    if len(rows) > IN_ROW:
        return detect_blocks(docs, catalog, text)
    if not rows:
        return docs.select(*keep, F.lit(None).cast("string").alias("provider_id"), F.lit(UNKNOWN).alias("provider_name"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("matched_terms"))
    t = F.coalesce(F.col(text), F.lit(""))
    forms = F.struct(F.lower(t).alias("low"), search_form(t).alias("norm"))
    best = bind(forms, lambda f: F.array_max(F.filter(F.transform(_literal(rows), lambda r: _score(f["low"], f["norm"], r)), lambda c: c.isNotNull())))
    return docs.withColumn("_best", best).select(*keep, *_named(F.col("_best")))


class Scorer:
    """Scores documents against a block of providers; a phrase that several providers share is sought once."""

    def __init__(self, providers: list[dict]):
        self.providers = providers
        self.terms: dict[tuple[str, str], int] = {}
        for p in providers:
            for kind in ("required", "optional", "negative"):
                p[kind] = [(self.terms.setdefault((q["low"], q["norm"]), len(self.terms)), q["term"]) for q in p[kind]]
        # only providers whose first required phrase stands in a text can fit it; those that require nothing always may
        self.always = [p for p in providers if not p["required"]]
        self.by_first: dict[int, list[dict]] = {}
        for p in providers:
            if p["required"]:
                self.by_first.setdefault(p["required"][0][0], []).append(p)
        self.by_term: dict[int, list[dict]] = {}
        for p in providers:
            for i in {i for kind in ("required", "optional", "negative") for i, _ in p[kind]}:
                self.by_term.setdefault(i, []).append(p)
        self.seek = [self._machine(0), self._machine(1)]

    def _machine(self, k: int):
        of: dict[str, list[int]] = {}
        for term, i in self.terms.items():
            if term[k]:
                of.setdefault(term[k], []).append(i)
        if ahocorasick is None or not of:
            return lambda text: (i for w, ids in of.items() if w in text for i in ids)
        machine = ahocorasick.Automaton()
        for w, ids in of.items():
            machine.add_word(w, ids)
        machine.make_automaton()
        return lambda text: (i for _, ids in machine.iter(text) for i in ids)

    def hits(self, low: str, norm: str) -> set[int]:
        return {*self.seek[0](low), *self.seek[1](norm)}

    @staticmethod
    def candidate(p: dict, hits: set[int]) -> dict | None:
        if not all(i in hits for i, _ in p["required"]) or any(i in hits for i, _ in p["negative"]):
            return None
        found = [term for i, term in p["optional"] if i in hits]
        confidence = 0.8 + 0.2 * (len(found) / len(p["optional"])) if p["optional"] else 1.0
        if confidence < p["minimum"]:
            return None
        return {"confidence": confidence, "priority": p["priority"], "n_required": len(p["required"]), "neg_pos": -p["catalog_pos"], "provider_id": p["provider_id"], "provider_name": p["name"], "matched_terms": [t for _, t in p["required"]] + found}

    def best(self, low: str, norm: str) -> dict | None:
        hits = self.hits(low, norm)
        fit = (c for p in (*self.always, *(p for i in hits for p in self.by_first.get(i, ()))) if (c := self.candidate(p, hits)))
        return max(fit, key=lambda c: (c["confidence"], c["priority"], c["n_required"], c["neg_pos"]), default=None)

    def explained(self, low: str, norm: str) -> list[dict]:
        """What speaks for and against each provider of which the text holds a phrase, in the order of the catalog."""
        hits = self.hits(low, norm)
        near = {p["catalog_pos"]: p for i in hits for p in self.by_term[i]}
        return [{
            "provider_id": p["provider_id"], "matched_terms": [t for k in ("required", "optional") for i, t in p[k] if i in hits], "missing_terms": [t for i, t in p["required"] if i not in hits],
            "rejected_terms": [t for i, t in p["negative"] if i in hits], "eligible": self.candidate(p, hits) is not None,
        } for _, p in sorted(near.items())]


_CANDIDATE = pa.struct([("confidence", pa.float64()), ("priority", pa.int32()), ("n_required", pa.int32()), ("neg_pos", pa.int32()), ("provider_id", pa.string()), ("provider_name", pa.string()), ("matched_terms", pa.list_(pa.string()))])
_EXPLAINED = pa.list_(pa.struct([("provider_id", pa.string()), *((c, pa.list_(pa.string())) for c in ("matched_terms", "missing_terms", "rejected_terms")), ("eligible", pa.bool_())]))
_CANDIDATE_SQL = "struct<confidence:double,priority:int,n_required:int,neg_pos:int,provider_id:string,provider_name:string,matched_terms:array<string>>"
_EXPLAINED_SQL = "array<struct<provider_id:string,matched_terms:array<string>,missing_terms:array<string>,rejected_terms:array<string>,eligible:boolean>>"


@lru_cache(maxsize=4)
def _scorer(holder) -> Scorer:
    return Scorer([{k: [dict(q) for q in v] if isinstance(v, list) else v for k, v in p.items()} for p in holder.value])


def _blocks(catalog: DataFrame, block: int) -> Iterator[list[dict]]:
    p = prepared(catalog).persist()
    for first in range(0, (p.agg(F.max("catalog_pos")).head()[0] or 0) + 1, block):
        yield [r.asDict(recursive=True) for r in p.where(F.col("catalog_pos").between(first, first + block - 1)).collect()]
    p.unpersist()


def _scored(docs: DataFrame, text: str, rows: list[dict], column: str, explain: bool) -> DataFrame:
    """``docs`` with what the scorer of a block of providers says of each document."""
    held = docs.sparkSession.sparkContext.broadcast(rows)
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.withColumns({"_low": F.lower(t), "_norm": search_form(t)})
    kind = _EXPLAINED if explain else _CANDIDATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held)
        say = scorer.explained if explain else scorer.best
        for b in batches:
            n = b.num_columns
            got = pa.array([say(low, norm) for low, norm in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist())], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], got], names=[*b.schema.names[: n - 2], column])

    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return src.mapInArrow(run, f"{fields}, `{column}` {_EXPLAINED_SQL if explain else _CANDIDATE_SQL}")


def detect_blocks(docs: DataFrame, catalog: DataFrame, text: str = "plain_text", block: int = BLOCK) -> DataFrame:
    """``detect`` for catalogs of any size."""
    keep = [c for c in docs.columns if c not in ("provider_id", "provider_name", "confidence", "matched_terms")]
    out, best = docs.select(*keep), F.lit(None).cast(_CANDIDATE_SQL)
    for k, rows in enumerate(_blocks(catalog, block)):
        out = _scored(out, text, rows, f"_best{k}", explain=False)
        best = F.array_max(F.array_compact(F.array(best, F.col(f"_best{k}"))))
    return out.withColumn("_best", best).select(*keep, *_named(F.col("_best")))


def candidates(docs: DataFrame, catalog: DataFrame, key: str, text: str = "plain_text", block: int = BLOCK) -> DataFrame:
    """A diagnostic row for each document and each enabled provider of which it holds a phrase: matched, missing and rejected terms, whether it is eligible."""
    out = docs.select(key, text)
    names = []
    for k, rows in enumerate(_blocks(catalog, block)):
        names.append(f"_said{k}")
        out = _scored(out, text, rows, names[-1], explain=True)
    said = F.concat(*names) if names else F.array().cast(_EXPLAINED_SQL)
    return out.select(key, F.explode_outer(said).alias("c")).where("c is not null").select(key, "c.*")


def resolve(matches: DataFrame, catalog: DataFrame, on_unmatched: str = "none", explicit: str | None = None) -> DataFrame:
    """``matches`` with the provider used for extraction: the explicit one (by id, name or work provider, without regard to case; unknown ones raise), the detected one, or with ``on_unmatched='first'`` the first of the catalog."""
    if on_unmatched not in ("none", "first"):
        raise ValueError("on_unmatched is 'none' or 'first'")
    if explicit is not None:
        want = explicit.lower()
        same = reduce(lambda a, b: a | b, (F.lower(c) == want for c in ("provider_id", "name", "work_provider")))
        order = "catalog_pos" if "catalog_pos" in catalog.columns else "provider_id"
        row = catalog.where(same).orderBy(order).select("provider_id").head()
        if row is None:
            raise ValueError(f"no provider {explicit!r}")
        return matches.withColumn("used_provider", F.lit(row[0]))
    if on_unmatched == "first":
        order = "catalog_pos" if "catalog_pos" in catalog.columns else "provider_id"
        row = catalog.orderBy(order).select("provider_id").head()
        return matches.withColumn("used_provider", F.coalesce("provider_id", F.lit(row[0] if row else None)))
    return matches.withColumn("used_provider", F.col("provider_id"))
