"""Column builders over text: find-all with offsets, checksums, surfaces, placeholders."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of the checksum and pattern detectors, in the order that breaks ties.
PATTERNS = {
    "credit_card_number": r"(?<![\d\-])(?:\d[ \-]?){12,18}\d(?![\d\-])",
    "iban": r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b",
    "email": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "ssn": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
}
#: Fixed value: what counts as an address on the web.
URL = r"https?://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_HITS = "array<struct<start_pos:int,end_pos:int,label:string,surface:string>>"


def find_labelled(text: Column | str, patterns: Mapping[str, str]) -> Column:
    """array<struct<start_pos, end_pos, label, surface>> of all matches of each pattern, in the order of patterns, those of one pattern from the left and none inside another; offsets in code points, \\w, \\d
    and \\b by Unicode. Regular expressions with positions are nothing the JVM offers as a column, so all patterns share one pass over Arrow batches. Any character may occur in the text; null has no matches."""
    compiled = [(k, re.compile(p)) for k, p in patterns.items()]

    @F.arrow_udf(_HITS)
    def find(texts: pa.Array) -> pa.Array:
        starts, ends, labels, surfaces, counts = [], [], [], [], [0]
        for t in texts.to_pylist():
            if t:
                for label, p in compiled:
                    for m in p.finditer(t):
                        starts.append(m.start())
                        ends.append(m.end())
                        labels.append(label)
                        surfaces.append(m.group())
            counts.append(len(starts))
        fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(labels, pa.string()), pa.array(surfaces, pa.string())]
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start_pos", "end_pos", "label", "surface"]))

    return find(_column(text))


def find_all(text: Column | str, pattern: str) -> Column:
    """array<struct<start_pos, end_pos, label, surface>> of all matches of one pattern; the label is empty."""
    return find_labelled(text, {"": pattern})


def luhn_ok(surface: Column | str) -> Column:
    """13 to 19 digits with a valid Luhn check digit; other characters are ignored."""
    digits = F.regexp_replace(_column(surface), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_ok(surface: Column | str) -> Column:
    """15 to 34 characters, two letters and two digits first, and 1 modulo 97 once rotated by four."""
    s = F.upper(F.regexp_replace(_column(surface), " ", ""))
    rotated = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    # two-digit letters shift by 100, digits by 10
    step = lambda acc, c: F.when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)
    mod = F.aggregate(F.split(rotated, ""), F.lit(0), step)
    return F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (mod == 1)


def surface_of(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """text[start:end]."""
    a, b = _column(start), _column(end)
    return F.substring(_column(text), a + 1, b - a)


def surface_key(surface: Column | str) -> Column:
    """Trimmed and in lower case. Full case folding differs for a few letters (sharp s); lower case is used throughout."""
    return F.lower(F.trim(_column(surface)))


def normal_surface(surface: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_column(surface), r"\s+", " ")))


def placeholder(label: Column | str, number: Column | str) -> Column:
    return F.concat(F.lit("["), F.upper(_column(label)), F.lit("_"), _column(number).cast("string"), F.lit("]"))


def placeholders_in(text: Column | str, strict: bool = False) -> Column:
    """Placeholders in order of appearance. strict leaves digits out of the type's name, so that types like IPV4 are not met."""
    return F.regexp_extract_all(_column(text), F.lit(r"(\[[A-Z_]+_\d+\])" if strict else r"(\[[A-Z0-9_]+_\d+\])"), 1)


def is_ascii(s: Column | str) -> Column:
    return ~_column(s).rlike(r"[^\x00-\x7F]")


def token_bucket(s: Column | str) -> Column:
    """'1', '2' or '3+' tokens split at white space; none counts as one."""
    n = F.size(F.split(F.trim(F.regexp_replace(_column(s), r"\s+", " ")), " "))
    return F.when(n <= 1, "1").when(n == 2, "2").otherwise("3+")


def snap(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """struct<start_pos, end_pos>: widened over word characters to both sides, then freed of trailing full stops, apostrophes and hyphens."""
    t, a, b = _column(text), _column(start), _column(end)
    left = F.length(F.regexp_extract(F.reverse(F.substring(t, F.lit(1), a)), r"^[A-Za-z0-9.@_\-+/#'&]*", 0))
    right = F.length(F.regexp_extract(F.substring(t, b + 1, F.length(t)), r"^[A-Za-z0-9.@_\-+/#'&]*", 0))
    x, y = a - left, b + right
    kept = F.length(F.regexp_replace(F.substring(t, x + 1, y - x), r"[.'\-]+\z", ""))
    return F.struct(x.cast("int").alias("start_pos"), (x + kept).cast("int").alias("end_pos"))
