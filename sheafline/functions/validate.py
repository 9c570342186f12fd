"""Checks of field values, and the gates that hold a value suspicious."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions import normalize as N
from sheafline.functions.text import NARRATIVE, clean, is_label_only
from sheafline.schema import DATES, FIELD_ORDER, FIELDS, REQUIRED

#: Phrases that show a value to be something else.
CLAIMANT_PHRASES = ("accident:", "client:", "stationary at", "proceedings ", "defendant", "claimant was")
MODEL_PHRASES = (
    "please", "accident", "claimant", "defendant", "vehicle is currently located", "currently located", "introducer", " is called ", "source:", "provide a report", "report detailing", "costs of repair", "cost of replacement",
)
REFERENCE_PHRASES = ("proclaim", "sign off", "engineers report", "please ", "before preparing", "your reports", "electronic basis", "report and fee")
MESSAGES = {
    "missing_required_field": "is required", "invalid_date_format": "is no date of the form dd/mm/yyyy", "invalid_vrm": "is no registration mark", "invalid_mileage": "is no whole number",
    "invalid_vat": "is neither Yes nor No", "invalid_mileage_unit": "is neither Miles nor Km",
}


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in phrases))


def _issue(field: str, severity: str, code: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(f"{FIELDS[field]} {MESSAGES[code]}").alias("message"))


def issues_of(values: dict[str, Column]) -> Column:
    """array of issues in the order of the fields; ``values`` may lack fields, which then are not checked."""
    v = {f: F.coalesce(c, F.lit("")) for f, c in values.items()}
    blank = {f: F.trim(c) == "" for f, c in v.items()}
    rows = [F.when(blank[f], _issue(f, "error", "missing_required_field")) for f in FIELD_ORDER if f in v and f in REQUIRED]
    rows += [F.when(~blank[f] & (F.try_to_date(F.when(v[f].rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), v[f]), "d/M/yyyy").isNull()), _issue(f, "warning", "invalid_date_format")) for f in FIELD_ORDER if f in v and f in DATES]
    tests = (("vrm", "invalid_vrm", ~N.vrm(v["vrm"]).rlike("^[A-Z0-9]{2,8}$") if "vrm" in v else None), ("mileage", "invalid_mileage", ~v["mileage"].rlike("^[0-9]+$") if "mileage" in v else None),
             ("vat_status", "invalid_vat", ~v["vat_status"].isin("Yes", "No") if "vat_status" in v else None), ("mileage_unit", "invalid_mileage_unit", ~v["mileage_unit"].isin("Miles", "Km") if "mileage_unit" in v else None))
    rows += [F.when(~blank[f] & bad, _issue(f, "warning", code)) for f, code, bad in tests if bad is not None]
    return F.array_compact(F.array(*rows))


@dataclass(frozen=True)
class Gate:
    """What makes a value of a field suspicious. Patterns hold for Java and for Python alike.

    label: a mere label; values: these; least: shorter than this; shape: matching it whole (shape_is_bad) or not matching it; phrases: holding one of
    them; no_plate: holding the plate that stands beside a label; goes_on: followed by this in the text; blank: whether an empty value is judged.
    """

    label: bool = False
    values: tuple[str, ...] = ()
    least: int = 0
    shape: str = ""
    shape_is_bad: bool = True
    phrases: tuple[str, ...] = ()
    no_plate: bool = False
    goes_on: str = ""
    blank: bool = False


#: The gates.
GATES: dict[str, Gate] = {
    **dict.fromkeys(DATES, Gate(shape="[0-9]{2}/[0-9]{2}/[0-9]{4}", shape_is_bad=False)),
    "claimant_name": Gate(label=True, shape=r"(?i)[A-Z]{1,3}[0-9]{1,3}\s?[A-Z]{3}", phrases=CLAIMANT_PHRASES),
    "vehicle_model": Gate(label=True, values=(",", ".", "-"), least=2, phrases=MODEL_PHRASES, no_plate=True, blank=True),
    # four signs or fewer, unless they are letters, figures, letters
    "vrm": Gate(shape=r"(?![A-Z]{1,3}[0-9]{1,3}[A-Z]{1,3}$).{1,4}", goes_on=r"\s*[0-9][A-Z]{2}\b"),
    "reference": Gate(label=True, shape="[A-Za-z!?]{1,10}", phrases=REFERENCE_PHRASES),
    "inspection_address": Gate(phrases=NARRATIVE),
}


def suspicious(field: str, value: Column, text: Column, label_vrm: Column) -> Column:
    """Whether a normalised value is more likely something else; false for fields without a gate. label_vrm: the plate beside a label, or null."""
    g = GATES.get(field)
    if g is None:
        return F.lit(False)
    v = clean(F.coalesce(value, F.lit("")))
    bad = F.length(v) < g.least
    if g.label:
        bad = bad | ((v != "") & is_label_only(v))
    if g.values:
        bad = bad | v.isin(*g.values)
    if g.shape:
        flag, body = ("(?i)", g.shape[4:]) if g.shape.startswith("(?i)") else ("", g.shape)
        like = v.rlike(f"(?s){flag}^(?:{body})$")
        bad = bad | (like if g.shape_is_bad else ~like)
    if g.phrases:
        bad = bad | _any(v, g.phrases)
    if g.no_plate:
        bad = bad | F.coalesce((label_vrm != "") & F.contains(N.vrm(v), N.vrm(label_vrm)), F.lit(False))
    if g.goes_on:
        bad = bad | F.coalesce(F.rlike(text, F.concat(F.lit(r"(?i)\b\Q"), v, F.lit(r"\E" + g.goes_on))), F.lit(False))
    return bad if g.blank else (v != "") & bad


__all__ = ["GATES", "issues_of", "suspicious"]
