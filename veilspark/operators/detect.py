"""Detectors without a model: checksums and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PATTERNS, find_labelled, iban_ok, luhn_ok
from .spans import drop_overlaps

_SPAN = "array<struct<start_pos:int,end_pos:int,label:string,score:double>>"

#: Patterns of the baseline, in the order that breaks ties.
BASELINE = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "swift_bic_code": r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card_number": r"\b(?:\d[ -]?){13,19}\b",
    "phone_number": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?",
    "date_of_birth": r"\b\d{4}-\d{2}-\d{2}\b",
    "local_latlng": r"-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}",
    "api_key": r"\b[A-Za-z0-9_\-]{24,}\b",
    "user_name": r"(?<![\w@])@[A-Za-z0-9_]{3,}\b",
    "name": r"\b[A-Z][a-z]{1,15}(?:[ -][A-Z][a-z]{1,15}){1,2}\b",
}


def _spans(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start_pos"].alias("start_pos"), h["end_pos"].alias("end_pos"), h["label"].alias("label"), F.lit(1.0).alias("score"))).cast(_SPAN)


def validator_spans(text: Column | str) -> Column:
    """Spans of the validating detector: card numbers (Luhn), IBANs (modulo 97), e-mail and network addresses, identity numbers; overlaps dropped, longest first."""
    sound = lambda h: F.when(h["label"] == "credit_card_number", luhn_ok(h["surface"])).when(h["label"] == "iban", iban_ok(h["surface"])).otherwise(True)
    return drop_overlaps(_spans(F.filter(find_labelled(text, PATTERNS), sound)), longest_first=True)


def baseline_spans(text: Column | str) -> Column:
    """Spans of thirteen plain patterns, overlaps dropped, longest first."""
    return drop_overlaps(_spans(find_labelled(text, BASELINE)), longest_first=True)
