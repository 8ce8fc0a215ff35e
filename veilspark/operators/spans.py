"""Span algebra: overlap resolution, merging, coverage. Spans stay nested in their document; all offsets are half-open code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_T = "array<struct<start_pos:int,end_pos:int,label:string,score:double>>"


def nested(spans: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, spans): one row per document; a document's spans are bounded by its text."""
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", *fields))).alias("spans"))


def usable(spans: Column | str) -> Column:
    """Non-null spans with end > start."""
    return F.filter(spans, lambda s: s.isNotNull() & (s["end_pos"] > s["start_pos"]))


def _ordered(spans: Column, longest_first: bool) -> Column:
    """Sorted by start, then end (or longest first), then position in the list."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start_pos"].alias("a"), (-s["end_pos"] if longest_first else s["end_pos"]).alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def drop_overlaps(spans: Column | str, longest_first: bool = False) -> Column:
    """Greedy: in order, a span stays if it starts at or behind the end of the last that stayed. Gold data takes the shortest of those that start together, detections
    the longest."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    ordered = _ordered(usable(spans), longest_first)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, s: F.when(s["start_pos"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end_pos"], F.lit(-1)), F.concat(acc, F.array(s))).otherwise(acc))


def merge_union(spans: Column | str, priority: Sequence[str] = ()) -> Column:
    """Overlapping spans merged into their union; the label goes to a priority label, among equals to the longer one; the score is the largest."""
    spans = (F.col(spans) if isinstance(spans, str) else spans).cast(_T)
    ordered = _ordered(usable(spans), True)
    first = lambda c: F.array_contains(F.array(*map(F.lit, priority)), c) if priority else F.lit(False)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = (s["end_pos"] - s["start_pos"]) > (last["end_pos"] - last["start_pos"])
        takes = (first(s["label"]) & ~first(last["label"])) | ((first(s["label"]) == first(last["label"])) & longer)
        merged = F.struct(last["start_pos"].alias("start_pos"), F.greatest(last["end_pos"], s["end_pos"]).alias("end_pos"), F.when(takes, s["label"]).otherwise(last["label"]).alias("label"), F.greatest(last["score"], s["score"]).alias("score"))
        return F.when((F.size(acc) > 0) & (s["start_pos"] < last["end_pos"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast(_T), step)


def resolve_redaction(spans: Column | str, types: Sequence[str]) -> Column:
    """The stretches to be replaced: spans of the given types; an overlapping one that reaches further extends the last, which keeps its label."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    out = "array<struct<start_pos:int,end_pos:int,label:string>>"
    ordered = _ordered(F.filter(usable(spans), lambda s: s["label"].isin(*types)), True)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(s["start_pos"].cast("int").alias("start_pos"), s["end_pos"].cast("int").alias("end_pos"), s["label"].alias("label"))
        longer = F.struct(last["start_pos"].alias("start_pos"), s["end_pos"].cast("int").alias("end_pos"), last["label"].alias("label"))
        return (
            F.when((F.size(acc) == 0) | (s["start_pos"] >= last["end_pos"]), F.concat(acc, F.array(own)))
            .when(s["end_pos"] > last["end_pos"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
            .otherwise(acc)
        )

    return F.aggregate(ordered, F.array().cast(out), step)


def merged_intervals(spans: Column | str, length: Column | None = None) -> Column:
    """Disjoint, sorted array<struct<start_pos, end_pos>> that cover the same characters, clamped to [0, length)."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    out = "array<struct<start_pos:int,end_pos:int>>"
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, length) if length is not None else c).cast("int")
    flat = F.sort_array(F.filter(F.transform(usable(spans), lambda s: F.struct(clamp(s["start_pos"]).alias("start_pos"), clamp(s["end_pos"]).alias("end_pos"))), lambda s: s["end_pos"] > s["start_pos"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start_pos"].alias("start_pos"), F.greatest(last["end_pos"], s["end_pos"]).alias("end_pos"))
        return F.when((F.size(acc) > 0) & (s["start_pos"] <= last["end_pos"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(flat, F.array().cast(out), step)


def covered(intervals: Column | str, start: Column, end: Column) -> Column:
    """Characters of [start, end) inside disjoint intervals."""
    return F.aggregate(intervals, F.lit(0), lambda n, m: n + F.greatest(F.lit(0), F.least(end, m["end_pos"]) - F.greatest(start, m["start_pos"])))


def first_overlapping(spans: Column | str, start: Column, end: Column) -> Column:
    """The first span in list order that shares a character with [start, end); null if none."""
    return F.try_element_at(F.filter(spans, lambda s: (s["start_pos"] < end) & (s["end_pos"] > start)), F.lit(1))


def islands(tokens: DataFrame, text_gap: int = 1) -> DataFrame:
    """Neighbouring tokens of one document and type, apart by white space only, as one span: (doc_id, start_pos, end_pos, label, score = least of the tokens', tokens).

    tokens: doc_id, start_pos, end_pos, label, score, begins (true breaks), gap_blank (the gap before it is blank)."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", "label")
    breaks = (F.lag("label").over(w).isNull()) | (F.lag("label").over(w) != F.col("label")) | F.col("begins") | ~F.col("gap_blank")
    return (
        tokens.withColumn("island", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("label").alias("label"), F.bround(F.min("score"), 4).alias("score"), F.count("*").alias("tokens"))
        .drop("island")
    )


def best_window(tokens: DataFrame) -> DataFrame:
    """Tokens seen by several overlapping windows: of each (doc_id, start_pos, end_pos) the one with the largest p_pii, the first window on ties, with that window's label
    and p_ident."""
    best = F.max(F.struct("p_pii", (-F.col("window")).alias("back"), "label", "p_ident")).alias("m")
    return tokens.groupBy("doc_id", "start_pos", "end_pos").agg(best).select("doc_id", "start_pos", "end_pos", "m.p_pii", "m.label", "m.p_ident")
