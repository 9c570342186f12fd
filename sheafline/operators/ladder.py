"""What is tried for a field without a rule, as data.

A ladder is a tuple of steps in the order they are tried; the first that yields a value wins. Both readers of a ladder,
the Column builders of ``fallbacks`` and the batched reader of ``batch``, hold one function for each kind of step and no
knowledge of any field.
"""

from __future__ import annotations

from dataclasses import dataclass

from sheafline.functions.text import DATE, POSTCODE, VRM

#: Labels in the order they are tried, and words of contexts.
VRM_LABELS = ("vehicle registration number", "vehicle registration", "registration", "vehicle reg", "client reg", "vrm", "reg")
VRM_CONTEXT = ("reg", "registration", "vrm", "vehicle")
REFERENCE_LABELS = ("reference", "ref", "claim no", "claim number", "case number", "our ref", "your ref")
REFERENCE_CONTEXT = ("reference", "claim", "ref", "case")
CLAIMANT_STRUCTURED = ("our insured", "our client", "re client", "client")
CLAIMANT_LABELS = ("our insured", "our client", "client name", "claimant name", "policyholder", "client", "claimant", "name")
MODEL_STRUCTURED = ("make/model", "make model", "our client's vehicle", "our clients vehicle", "client vehicle", "vehicle make", "vehicle model", "make")
MODEL_LABELS = ("vehicle model", "make/model", "make and model", "our client's vehicle", "our clients vehicle", "client vehicle", "vehicle make", "make", "model")
ADDRESS_LABELS = ("inspection address", "address", "location", "repairer", "garage", "bodyshop")
ADDRESS_STOPS = ("tel:", "tele:", "telephone:", "mobile", "email:", "vehicle:", "reg:")
ADDRESS_STOP_WORDS = ("tel", "telephone", "email")
ADDRESS_SKIPS = ("available at", "introducer", "please make arrangements", "please arrange", "provide a report", "i have advised")
INCIDENT_CONTEXT = ("accident", "incident", "rta", "collision", "loss")
INSTRUCTION_CONTEXT = ("instruct", "received", "sent", "date")
NAME_REJECTS, MODEL_REJECTS, VEHICLE_REJECTS, REFERENCE_REJECTS = ("name", "client", "our client", "claimant"), ("model", "make", "vehicle", "vehicle model", "make/model"), ("vehicle", "model", "make/model"), ("ref", "reference", "our ref", "your ref")
NO_PLATES = ("CLIENT", "VEHICLE", "REG", "MODEL")
#: Least similarity of a label.
LEAST = 0.72


@dataclass(frozen=True)
class Beside:
    """The value beside the first label found, or on the ``reach`` lines after it; a rejected value beside a label ends the step. confidence = min(cap, similarity * factor)."""

    labels: tuple[str, ...]
    rule_id: str
    cap: float
    factor: float
    reach: int = 3
    rejects: tuple[str, ...] = ()


@dataclass(frozen=True)
class PlateBeside:
    """The first plate on the line of a label or on the ``reach`` lines after it."""

    labels: tuple[str, ...]
    rule_id: str
    cap: float
    factor: float
    reach: int = 3


@dataclass(frozen=True)
class Structured:
    """The value after a label that begins a line (a label of several words: anywhere in it), after the last colon or the words of the label, else on the four lines after it. unless: shape of values not taken."""

    labels: tuple[str, ...]
    rule_id: str
    rejects: tuple[str, ...]
    unless: str | None = None
    confidence: float = 0.86


@dataclass(frozen=True)
class Lines:
    """The first match of one of the patterns in the first ``head`` lines that hold one of ``words`` and none of ``without``, or on the ``reach`` lines from there on.

    begins: what the line must begin with; plate: the match must pass as a plate; rejects, unless: values not taken.
    """

    patterns: tuple[str, ...]
    rule_id: str
    confidence: float
    head: int | None = None
    reach: int = 1
    words: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    begins: str = ""
    plate: bool = False
    rejects: tuple[str, ...] | None = None
    unless: str | None = None


@dataclass(frozen=True)
class Labelled:
    """A label at the beginning of one of the first ``head`` lines: the value on it, or if there is none the first fitting one of the three lines after it."""

    label: str
    rule_id: str
    confidence: float
    next_rule_id: str
    next_confidence: float
    fits: str
    rejects: tuple[str, ...]
    head: int = 30


@dataclass(frozen=True)
class PlateInText:
    """The first plate of the whole text, judged by the ``margin`` characters around it."""

    rule_id: str
    confidence: float
    margin: int = 20


@dataclass(frozen=True)
class Says:
    """A fixed value if the text in lower case holds the pattern."""

    pattern: str
    value: str
    rule_id: str
    confidence: float


@dataclass(frozen=True)
class AddressBeside:
    """The lines from a label to a postcode or to a line that ends an address."""

    labels: tuple[str, ...]
    rule_id: str
    cap: float
    factor: float
    reach: int = 7


@dataclass(frozen=True)
class AddressAbove:
    """The first postcode with up to three lines of address above it."""

    rule_id: str
    confidence: float
    reach: int = 5
    lines: int = 3
    words: int = 9


def _date(words: tuple[str, ...], field: str) -> tuple:
    return Lines((DATE,), f"fallback_{field}_context", 0.7, words=words, reach=3), Lines((DATE,), f"fallback_{field}_top_date", 0.5, head=12)


_PLATE = r"(?i)^[A-Z]{1,3}[0-9]{1,3}\s?[A-Z]{3}$"
_REF = r"(?i)^\s*(?:our|your)?\s*ref(?:erence)?\s*:\s*"
LADDERS: dict[str, tuple] = {
    "vrm": (
        PlateBeside(VRM_LABELS, "fallback_vrm_label", 0.88, 0.9),
        Lines((VRM,), "fallback_vrm_context", 0.78, words=VRM_CONTEXT, without=("located", "postcode", POSTCODE), plate=True),
        PlateInText("fallback_vrm_document", 0.52),
    ),
    "reference": (
        Lines((r"(?i)\bour\s+ref\s*:\s*([A-Z0-9./-]+)", r"(?i)\b([A-Z]{1,4}(?:/[A-Z0-9.-]{1,8}){2,})\b"), "fallback_reference_subject", 0.78, head=10, begins="subject:"),
        Labelled(_REF, "fallback_reference_exact_label", 0.84, "fallback_reference_next_line", 0.76, "(?i)^[A-Z0-9./ -]+$", REFERENCE_REJECTS),
        Beside(REFERENCE_LABELS, "fallback_reference", 0.9, 0.85),
        Lines((r"(?i)\b((?:[A-Z]{2,6}[-/ ]?)?[0-9]{4,}[A-Z0-9/-]*)\b",), "fallback_reference_pattern", 0.65, head=25, words=REFERENCE_CONTEXT),
    ),
    "claimant_name": (
        Structured(CLAIMANT_STRUCTURED, "fallback_claimant_structured", NAME_REJECTS, unless=_PLATE),
        Lines((r"\b((?:Mr|Mrs|Miss|Ms|Mx|Dr)\s+[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){0,4})\s+is\s+available\b",), "fallback_claimant_available", 0.74),
        Structured(CLAIMANT_STRUCTURED, "fallback_claimant_structured", NAME_REJECTS),
        Beside(CLAIMANT_LABELS, "fallback_claimant_name", 0.9, 0.85, rejects=("name", "claimant", "client", "claimant name")),
    ),
    "vehicle_model": (
        Lines((r"(?i)^\s*Vehicle\s*:\s*(.+?)\s*$",), "fallback_vehicle_model_exact_vehicle", 0.78, rejects=VEHICLE_REJECTS, unless=r"(?i)^\s*(?:[A-Z]\s*){1,3}(?:[0-9]\s*){1,3}(?:[A-Z]\s*){3}$"),
        Structured(MODEL_STRUCTURED, "fallback_vehicle_model_structured", MODEL_REJECTS),
        Beside(MODEL_LABELS, "fallback_vehicle_model", 0.9, 0.85, rejects=MODEL_REJECTS),
    ),
    "inspection_address": (AddressBeside(ADDRESS_LABELS, "fallback_inspection_address", 0.82, 0.8), AddressAbove("fallback_address_postcode_block", 0.6)),
    "vat_status": (Says(r"\b(?:no|not|non)\s+vat\b|vat\s+(?:no|not|none|exempt)", "No", "fallback_vat_negative", 0.65), Says("vat", "Yes", "fallback_vat_positive", 0.55)),
    "mileage_unit": (Says(r"\b(?:km|kilomet(?:er|re)s?)\b", "Km", "fallback_mileage_unit", 0.6), Says(r"\b(?:miles?|mi)\b", "Miles", "fallback_mileage_unit", 0.6)),
    "incident_date": _date(INCIDENT_CONTEXT, "incident_date"),
    "instruction_date": _date(INSTRUCTION_CONTEXT, "instruction_date"),
}
ALL_LABELS = tuple(dict.fromkeys(label for steps in LADDERS.values() for s in steps if isinstance(s, Beside | PlateBeside | AddressBeside) for label in s.labels))
