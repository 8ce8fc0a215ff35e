"""Residual risk: what survives redaction, weighed by a scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IDENTIFYING, THRESHOLD
from .detect import validator_spans
from .spans import merged_intervals


_WORD, _TWO_DIGITS = re.compile(r"\S+"), re.compile(r"[0-9]{2}")


class TokenScorer(Protocol):
    """Any model: adds `tokens` array<struct<start_pos, end_pos, p_pii, label, p_ident>> to a table with `text`."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    """Any detector: an array<struct<start_pos, end_pos, label, score>> of a text column."""

    def __call__(self, text: Column | str) -> Column: ...


#: Texts whose words a Python worker holds at once.
ROWS = 500
_TOKENS = "array<struct<start_pos:int,end_pos:int,p_pii:double,label:string,p_ident:double>>"


def feature_scorer(docs: DataFrame) -> DataFrame:
    """A stand-in scorer without a model: tokens at white space, a logistic of four features (capital, digits, sign, length). Its quality says nothing about a trained one's.
    Models run in Arrow batches; so does this: features of all tokens of a batch at once."""

    def scored(texts: pa.Array) -> pa.Array:
        spans, words, counts = [], [], [0]
        for t in texts.to_pylist():
            for m in _WORD.finditer(t or ""):
                spans.append(m.span())
                words.append(m.group())
            counts.append(len(words))
        at = np.array(spans, np.int32).reshape(len(spans), 2)
        digits = np.fromiter((_TWO_DIGITS.search(w) is not None for w in words), bool, len(words))
        sign = np.fromiter(("@" in w for w in words), bool, len(words))
        capital = np.fromiter(("A" <= w[0] <= "Z" for w in words), bool, len(words))
        p = 1 / (1 + np.exp(-(-4.0 + 1.5 * capital + 2.0 * digits + 4.0 * sign + 0.05 * np.minimum(at[:, 1] - at[:, 0], 20))))
        label = np.where(sign, "email", np.where(digits, "phone_number", "name")).astype(object)
        fields = [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(p), pa.array(label, pa.string()), pa.array(0.9 * p)]
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start_pos", "end_pos", "p_pii", "label", "p_ident"]))

    @F.arrow_udf(_TOKENS)
    def score(texts: pa.Array) -> pa.Array:
        # the words of ROWS texts at a time are Python objects
        return pa.concat_arrays([scored(texts.slice(i, ROWS)) for i in range(0, max(1, len(texts)), ROWS)])

    return docs.withColumn("tokens", score("text"))


def at_threshold(p: Column | str, threshold: float = THRESHOLD) -> Column:
    """Whether a posterior reaches the threshold; equal counts."""
    return (F.col(p) if isinstance(p, str) else p) >= threshold


_DECODED = "array<struct<start_pos:int,end_pos:int,label:string,score:double,tokens:bigint>>"


def _decoded(texts: pa.Array, tokens: pa.ListArray, threshold: float) -> pa.ListArray:
    """_DECODED of each row of an Arrow batch, over the tokens of all its rows at once."""
    rows = len(tokens)
    t, counts = tokens.flatten(), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), counts)
    # nulls don't reach the threshold; Spark's order puts NaN above every number
    p = t.field("p_pii")
    kept = np.nonzero(p.is_valid().to_numpy(zero_copy_only=False) & ~(p.to_numpy(zero_copy_only=False) < threshold))[0]
    p, row = p.to_numpy(zero_copy_only=False)[kept], row[kept]
    start, end = (t.field(c).to_numpy(zero_copy_only=False)[kept] for c in ("start_pos", "end_pos"))
    tags = t.field("label").take(pa.array(kept)).dictionary_encode()
    named = tags.dictionary.to_pylist()
    types = sorted({re.sub("^[BI]-", "", x) for x in named})
    # the last entries are for a null
    kind = np.array([*(types.index(re.sub("^[BI]-", "", x)) for x in named), -1])[tags.indices.fill_null(len(named)).to_numpy()]
    begins = np.array([*(x.startswith("B-") for x in named), False])[tags.indices.fill_null(len(named)).to_numpy()]
    joined = np.zeros(len(kept), bool)
    joined[1:] = (row[1:] == row[:-1]) & (kept[1:] == kept[:-1] + 1) & (kind[1:] == kind[:-1]) & ~begins[1:]
    at, text = -1, None
    for k in np.nonzero(joined)[0]:
        if row[k] != at:
            at, text = row[k], texts[row[k]].as_py()
        gap = text[end[k - 1] : start[k]] if text else ""
        joined[k] = not gap or gap.isspace()
    first = np.nonzero(~joined)[0]
    if not len(first):
        first = np.zeros(0, np.int64)
        spans = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)]
    else:
        spans = [np.minimum.reduceat(start, first), np.maximum.reduceat(end, first), np.fmin.reduceat(p, first), np.diff(np.append(first, len(kept)))]
    label = pa.array([*types, None], pa.string()).take(pa.array(kind[first] % (len(types) + 1)))
    fields = [pa.array(spans[0].astype(np.int32)), pa.array(spans[1].astype(np.int32)), label, pa.array(spans[2]), pa.array(spans[3].astype(np.int64))]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start_pos", "end_pos", "label", "score", "tokens"]))


def decoded(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text, tokens in order. (doc_id, start_pos, end_pos, label, score, tokens): neighbouring tokens at the threshold, of one type and apart by white space only, as one span. A token below the threshold, or
    one whose label begins with B-, breaks; the type is the label without its B- or I-. A row is decoded by itself in its Arrow batch: neither texts nor tokens are shuffled."""

    @F.arrow_udf(_DECODED)
    def spans(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([_decoded(texts.slice(i, ROWS), tokens.slice(i, ROWS), threshold) for i in range(0, max(1, len(texts)), ROWS)])

    return docs.select("doc_id", F.inline(spans("text", "tokens"))).withColumn("score", F.bround("score", 4))


def with_survivors(docs: DataFrame, spans: str = "pred", redacted_only: bool = False, types: Sequence[str] = IDENTIFYING, name: str = "surviving") -> DataFrame:
    """docs with the array `name` of the tokens not wholly inside spans. By default spans of every label hide a token, though only identifying ones are removed; redacted_only
    counts just those. The mask is a column of its own, so that it is made once per document and not once per token."""
    s = F.filter(spans, lambda x: x["label"].isin(*types)) if redacted_only else F.col(spans)
    mask = f"_mask_{name}"
    d = docs.withColumn(mask, merged_intervals(s))
    d = d.withColumn(f"_out{mask}", _uncovered(F.col("tokens.start_pos"), F.col("tokens.end_pos"), F.col(f"{mask}.start_pos"), F.col(f"{mask}.end_pos")))
    return d.withColumn(name, F.filter("tokens", lambda t, i: F.get(F.col(f"_out{mask}"), i))).drop(mask, f"_out{mask}")


def _outside(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the stretches [a, b) stick out of the disjoint, sorted intervals [x, y): by the covered length up to each place."""
    if not len(x):
        return b > a
    before = np.concatenate(([0], np.cumsum(y - x)))

    def upto(p: np.ndarray) -> np.ndarray:
        k = np.searchsorted(x, p, side="right")
        return before[k] - np.where(k > 0, np.maximum(0, y[k - 1] - p), 0)

    return upto(b) - upto(a) < b - a


def _uncovered(*columns: Column) -> Column:
    """_outside as a column over arrays, in Arrow batches."""

    @F.pandas_udf("array<boolean>")
    def flags(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_outside(*v) if v[0] is not None and len(v[0]) else np.zeros(0, bool) for v in zip(a, b, x, y)])

    return flags(*columns)


def raw_risk(tokens: Column | str) -> Column:
    """Expected identifying tokens: the sum of p_ident."""
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + t["p_ident"])


#: Characters stripped off a word before it is looked at, and what counts as capitalised and as a run of digits.
_STRIPPED, _CAPITALISED, _RUN = ".,;:!?()[]\"'", re.compile(r"^[A-Z][a-z]{1,20}$"), re.compile(r"\d{2,}")
_COUNTS = ("surviving_chars", "surviving_words", "surviving_capitalised", "surviving_digit_runs")
#: The six statistics that need no model.
NO_MODEL = (*_COUNTS, "spans", "capitals_and_digits")


def _counts(text: str | None, starts: list[int], ends: list[int]) -> tuple[int, int, int, int]:
    if not text:
        return 0, 0, 0, 0
    words = [m.span() for m in _WORD.finditer(text)]
    a, b = np.array(words, np.int64).reshape(len(words), 2).T
    left = _outside(a, b, np.array(starts, np.int64), np.array(ends, np.int64))
    capitals = runs = 0
    for k in np.nonzero(left)[0]:
        w = text[a[k] : b[k]].strip(_STRIPPED)
        capitals += _CAPITALISED.match(w) is not None
        runs += _RUN.search(w) is not None
    return len(text) - sum(ends) + sum(starts), int(left.sum()), capitals, runs


def surviving_statistics(docs: DataFrame, spans: str = "pred") -> DataFrame:
    """(doc_id, ...) counts that need no model: characters outside the spans; words at white space that aren't wholly hidden; of these, those whose whole form (hidden characters too, outer punctuation stripped) is
    capitalised, and those that hold two digits in a row; spans; and the sum of the two before. In Arrow batches, linear in the text."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:int" for c in _COUNTS) + ">")
    def count(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = [_counts(*x) for x in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist())]
        cols = np.array(rows, np.int32).reshape(len(rows), len(_COUNTS)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], list(_COUNTS))

    d = docs.where("text is not null").select("doc_id", "text", spans, merged_intervals(spans, F.length("text")).alias("hidden"))
    d = d.withColumn("c", count("text", "hidden.start_pos", "hidden.end_pos"))
    d = d.select("doc_id", "c.*", F.size(F.filter(spans, lambda s: s.isNotNull())).alias("spans"))
    return d.withColumn("capitals_and_digits", F.col("surviving_capitalised") + F.col("surviving_digit_runs"))


def flag_statistics(docs: DataFrame, thresholds: Sequence[float], tokens: str = "surviving", key: str = "doc_id") -> DataFrame:
    """(key, posterior, tokens, flag_<t>...): of the surviving tokens the sum of p_pii, their number, and how many lie above each threshold."""
    above = lambda t: F.size(F.filter(tokens, lambda x: x["p_pii"] > t))
    flags = [above(t).alias("flag_" + f"{t:g}".replace("0.", "")) for t in thresholds]
    return docs.select(key, F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x["p_pii"]).alias("posterior"), F.size(tokens).alias("tokens"), *flags)


def detected(docs: DataFrame, scorer: Callable[[DataFrame], DataFrame] = feature_scorer, detector: Detector = validator_spans, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with `tokens` and `spans`: those decoded from the scorer's tokens, united with the detector's; the detector's labels come first where they overlap."""
    from .spans import merge_union

    d = scorer(docs.where("text is not null")).withColumn("sure", detector("text"))
    found = decoded(d, threshold).groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "label", "score")).alias("found"))
    kind = "array<struct<start_pos:int,end_pos:int,label:string,score:double>>"
    d = d.join(found, "doc_id", "left").withColumn("all", F.concat(F.coalesce(F.col("found").cast(kind), F.array().cast(kind)), F.col("sure").cast(kind)))
    return d.withColumn("spans", merge_union("all", ("credit_card_number", "iban", "email", "ipv4", "ipv6", "ssn"))).drop("found", "sure", "all")
