"""Redaction with typed placeholders, the vault that reverses it, and the check of answers against the vault."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import placeholders_in
from ..schema import IDENTIFYING
from .spans import resolve_redaction

_STRETCH = [("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.string()), ("surface", pa.string()), ("ph", pa.string())]
_REDACTED = "struct<redacted:string,vault_size:int,stretches:array<struct<start_pos:int,end_pos:int,label:string,surface:string,ph:string>>>"


def _replaced(text: str, stretches: list[dict]) -> tuple[str, int, list[dict]]:
    numbers: dict[tuple[str, str], int] = {}
    used: dict[str, int] = {}
    parts, out, last = [], [], 0
    for s in stretches:
        a, b, label = s["start_pos"], min(s["end_pos"], len(text)), s["label"]
        if not 0 <= a < len(text):
            continue
        surface = text[a:b]
        key = label, surface.strip(" ").lower()
        if key not in numbers:
            numbers[key] = used[label] = used.get(label, 0) + 1
        ph = f"[{label.upper()}_{numbers[key]}]"
        parts += (text[last:a], ph)
        out.append({"start_pos": a, "end_pos": b, "label": label, "surface": surface, "ph": ph})
        last = b
    return "".join((*parts, text[last:])), len(numbers), out


def with_placeholders(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """docs: doc_id, text, spans. (doc_id, text, r: redacted, vault_size, stretches) of every document with text. Equal surfaces (trimmed, lower case) of a type share the number of their first appearance in the
    document. All of it stays inside the document, so nothing is shuffled: one pass over Arrow batches."""

    @F.arrow_udf(_REDACTED)
    def replace(texts: pa.Array, stretches: pa.Array) -> pa.Array:
        rows = [_replaced(*x) for x in zip(texts.to_pylist(), stretches.to_pylist())]
        fields = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.struct(_STRETCH)))]
        return pa.StructArray.from_arrays(fields, ["redacted", "vault_size", "stretches"])

    d = docs.where("text is not null").select("doc_id", "text", resolve_redaction("spans", types).alias("st"))
    return d.select("doc_id", "text", replace("text", "st").alias("r"))


def numbered(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """One row per stretch to be replaced: doc_id, start_pos, end_pos, label, surface, ph."""
    return with_placeholders(docs, types).select("doc_id", F.explode("r.stretches").alias("s")).select("doc_id", "s.*")


def vault(stretches: DataFrame) -> DataFrame:
    """(doc_id, ph, surface): the first surface of each placeholder. Kept apart from redacted texts; no default sink writes it."""
    return stretches.groupBy("doc_id", "ph").agg(F.min(F.struct("start_pos", "surface")).alias("m")).select("doc_id", "ph", "m.surface")


def redact(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """(doc_id, n_spans, vault_size, redacted) of every document with text."""
    return with_placeholders(docs, types).select("doc_id", F.size("r.stretches").alias("n_spans"), "r.vault_size", "r.redacted")


def rehydrate(texts: DataFrame, entries: DataFrame, column: str = "redacted") -> DataFrame:
    """(doc_id, text): each vault entry replaced literally, the longest placeholder first."""
    per = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("ph")).alias("k"), "ph", "surface"))).alias("v"))
    back = F.aggregate(F.coalesce("v", F.array().cast("array<struct<k:int,ph:string,surface:string>>")), F.col(column), lambda t, e: F.replace(t, e["ph"], e["surface"]))
    return texts.join(per, "doc_id", "left").select("doc_id", back.alias("text"))


def check_answers(answers: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """answers: row_id, doc_id, answer. (row_id, expected, intact, missing, unknown, trustworthy): vault placeholders found, missing, and placeholders the vault does not know."""
    per = entries.groupBy("doc_id").agg(F.sort_array(F.collect_set("ph")).alias("known"))
    a = answers.join(per, "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))).withColumn("found", F.array_distinct(F.coalesce(placeholders_in("answer", strict), F.array().cast("array<string>"))))
    a = a.select("row_id", F.size("known").alias("expected"), F.sort_array(F.array_intersect("known", "found")).alias("intact"), F.sort_array(F.array_except("known", "found")).alias("missing"), F.sort_array(F.array_except("found", "known")).alias("unknown"))
    return a.withColumn("trustworthy", (F.size("missing") == 0) & (F.size("unknown") == 0))
