"""Scores of detections against gold annotation, and of the gate against what leaked."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IDENTIFYING
from .spans import covered, drop_overlaps, first_overlapping, merged_intervals, usable
from .stats import at_coverage, auc, max_coverage, ordered_position, random_gate


def gold_rows(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """docs: doc_id, gold, pred (arrays of spans). One row per gold span of the types: doc_id, start_pos, end_pos, label, caught (all characters inside predicted spans of the types),
    masked (characters inside them), found_label (label of the first predicted span that overlaps)."""
    masked = merged_intervals(F.filter("pred", lambda s: s["label"].isin(*types)))
    rows = docs.select("doc_id", masked.alias("mask"), "pred", F.explode(F.filter(drop_overlaps("gold"), lambda s: s["label"].isin(*types))).alias("g"))
    n = covered("mask", F.col("g.start_pos"), F.col("g.end_pos"))
    return rows.select("doc_id", "g.start_pos", "g.end_pos", "g.label", n.alias("masked"), first_overlapping("pred", F.col("g.start_pos"), F.col("g.end_pos"))["label"].alias("found_label")).withColumn("caught", F.col("masked") == F.col("end_pos") - F.col("start_pos"))


def over_redaction(docs: DataFrame) -> DataFrame:
    """Predicted spans that touch no gold character: doc_id, start_pos, end_pos, label."""
    # two steps: beside a generator, struct fields built in the same select lose their names
    p = docs.select("doc_id", "pred", merged_intervals("gold").alias("goldmask")).select("doc_id", "goldmask", F.explode(usable("pred")).alias("p"))
    return p.where(covered("goldmask", F.col("p.start_pos"), F.col("p.end_pos")) == 0).select("doc_id", "p.start_pos", "p.end_pos", "p.label")


_PER_DOCUMENT = ("predicted", "gold", "caught", "leaked", "partly", "typed", "over", "gold_chars", "masked_chars")


def _held(intervals: list[tuple[int, int]], start: int, end: int) -> int:
    """Characters of [start, end) inside disjoint, sorted intervals."""
    k = bisect.bisect_right(intervals, (start, start)) - 1
    n = 0
    for a, b in intervals[max(k, 0) :]:
        if a >= end:
            break
        n += max(0, min(b, end) - max(a, start))
    return n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(a, 0), b) for a, b in spans if b > max(a, 0)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _measures(gold: list[dict | None], pred: list[dict | None], types: frozenset[str]) -> tuple[int, ...]:
    g = [(s["start_pos"], s["end_pos"], i, s["label"]) for i, s in enumerate(gold or ()) if s is not None and s["end_pos"] > s["start_pos"]]
    p = [(s["start_pos"], s["end_pos"], s["label"]) for s in pred or () if s is not None]
    usable = [(a, b) for a, b, _ in p if b > a]
    hidden, annotated = _merged([(a, b) for a, b, label in p if b > a and label in types]), _merged([(a, b) for a, b, *_ in g])
    n = caught = partly = typed = chars = masked = 0
    last = -1
    for a, b, _, label in sorted(g, key=lambda s: s[:3]):
        if a < last:
            continue
        last = b
        if label not in types:
            continue
        held = _held(hidden, a, b)
        n, chars, masked = n + 1, chars + b - a, masked + held
        if held == b - a:
            caught += 1
            typed += next((x for s, e, x in p if s < b and e > a), None) == label
        else:
            partly += held > 0
    over = sum(_held(annotated, a, b) == 0 for a, b in usable)
    return len(usable), n, caught, n - caught, partly, typed, over, chars, masked


def per_document(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """One row per document: predicted, gold, caught, leaked, partly, typed, over, gold_chars, masked_chars; what gold_rows and over_redaction say, counted. It all stays inside the document, so the nested spans are read once, in
    Arrow batches, and nothing is exploded or joined."""
    known = frozenset(types)

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in _PER_DOCUMENT) + ">")
    def count(gold: pa.Array, pred: pa.Array) -> pa.Array:
        rows = np.array([_measures(x, y, known) for x, y in zip(gold.to_pylist(), pred.to_pylist())], np.int64).reshape(-1, len(_PER_DOCUMENT))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(_PER_DOCUMENT))

    return docs.select("doc_id", count("gold", "pred").alias("c")).select("doc_id", "c.*")


def scorecard(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    """One row of measures over all documents; rates are null where there is nothing to divide by."""
    d = per_document(docs, types)
    s = d.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "caught", "leaked", "partly", "typed", "predicted", "over", "gold_chars", "masked_chars")),
        F.count_if(F.col("gold") > 0).alias("docs_with_gold"), F.count_if(F.col("leaked") > 0).alias("docs_with_leak"), F.count("*").alias("docs"),
    )
    rate = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return s.select("*", rate("caught", "gold").alias("recall"), rate("typed", "gold").alias("typed_recall"), rate("docs_with_leak", "docs_with_gold").alias("doc_leak_rate"), rate("over", "predicted").alias("over_rate"), rate("masked_chars", "gold_chars").alias("masked_fraction"))


def per_type(docs: DataFrame, types: Sequence[str] = IDENTIFYING) -> DataFrame:
    g = gold_rows(docs, types).groupBy("label").agg(F.count("*").alias("gold"), F.count_if(~F.col("caught")).alias("leaked"), F.count_if(F.col("caught") & (F.col("found_label") == F.col("label"))).alias("typed"))
    return g.withColumn("recall", F.bround(1 - F.col("leaked") / F.col("gold"), 4))


def risk_coverage(df: DataFrame, risk: str, leaked: str, budgets: Sequence[float]) -> DataFrame:
    """All budgets in one pass. Per budget: forwarded (risk <= budget), held, leaks among each, rates (null for none), whether the rate among the forwarded keeps the budget."""
    r = df.agg(F.count("*").alias("documents"), *(c.alias(f"{a}{i}") for i, b in enumerate(budgets) for f in (F.col(risk) <= float(b),) for a, c in (("f", F.count_if(f)), ("l", F.count_if(f & F.col(leaked))), ("h", F.count_if(~f & F.col(leaked))))))
    parts = F.array(*(F.struct(F.lit(float(b)).alias("budget"), "documents", F.col(f"f{i}").alias("forwarded"), F.col(f"l{i}").alias("leaks"), F.col(f"h{i}").alias("leaks_held")) for i, b in enumerate(budgets)))
    r = r.select(F.explode(parts).alias("x")).select("x.*")
    r = r.withColumn("held", F.col("documents") - F.col("forwarded")).withColumn("coverage", F.bround(F.col("forwarded") / F.col("documents"), 4))
    return r.withColumn("leak_rate", F.bround(F.try_divide("leaks", "forwarded"), 4)).withColumn("leak_rate_held", F.bround(F.try_divide("leaks_held", "held"), 4)).withColumn("budget_respected", F.try_divide("leaks", "forwarded") <= F.col("budget"))


def reliability_bins(df: DataFrame, risk: str, leaked: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count slices of max(1, rows // bins) in the order of risk (one more slice where that leaves a rest): bin, n, predicted, observed, both rounded to 4 digits."""
    pos = ordered_position(df, risk, [key])
    size = F.greatest(F.lit(1), F.floor(F.col("total") / bins))
    b = F.floor((F.col("position") - 1) / size).alias("bin")
    return pos.groupBy(b).agg(F.count("*").alias("n"), F.bround(F.avg(risk), 4).alias("predicted"), F.bround(F.avg(F.col(leaked).cast("double")), 4).alias("observed"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """From the rounded bin means, and how many bins are conservative."""
    n = F.sum("n")
    return bins.agg(F.bround(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / n, 4).alias("ece"), F.count_if(F.col("predicted") >= F.col("observed")).alias("conservative_bins"), F.count("*").alias("bins"))


def arm_report(df: DataFrame, statistic: str, leaked: str, key: str, coverages: Sequence[float], exposures: Sequence[int]) -> DataFrame:
    """(measure, at, value) of one arm: base rate, AUC, leaks and leak rate at each coverage beside a random gate's, and the largest coverage within each exposure."""
    base = df.agg(F.avg(F.col(leaked).cast("double")).alias("p"), F.count("*").alias("n"))
    first = base.select(F.lit("base_rate").alias("measure"), F.lit(0.0).alias("at"), F.col("p").alias("value")).unionByName(auc(df, statistic, leaked).select(F.lit("auc").alias("measure"), F.lit(0.0).alias("at"), F.col("auc").alias("value")))
    cov = at_coverage(df, statistic, leaked, key, coverages).join(F.broadcast(base))
    _, sd = random_gate(F.col("p"), F.col("k"), F.col("n"))
    parts = F.array(*(F.struct(F.lit(name).alias("measure"), F.col("coverage").alias("at"), c.cast("double").alias("value")) for name, c in (("leaks", F.col("leaks")), ("leak_rate", F.col("leak_rate")), ("random_rate", F.col("p")), ("random_sd", sd))))
    rows = cov.select(F.explode(parts).alias("x")).select("x.*")
    exp = max_coverage(df, statistic, leaked, key, exposures).join(F.broadcast(base)).select(F.lit("coverage_within").alias("measure"), F.col("budget").cast("double").alias("at"), F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")).alias("value"))
    return first.unionByName(rows).unionByName(exp)


def instrument_check(recomputed: DataFrame, published: DataFrame, key: str) -> None:
    """Refuse to go on unless a recomputed report equals the published one, cell by cell and null-safe, over the union of keys."""
    cells = [c for c in published.columns if c != key]
    r, p = recomputed.select(key, *cells).alias("r"), published.alias("p")
    differ = F.lit(False)
    for c in cells:
        differ = differ | ~F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    bad = r.join(p, F.col(f"r.{key}") == F.col(f"p.{key}"), "full_outer").where(differ).limit(5).collect()
    if bad:
        raise ValueError(f"the recomputed report differs from the published one: {bad}")


def best_statistic(rows: DataFrame, statistics: Sequence[str], leaked: str) -> DataFrame:
    """(statistic, auc, place) of each statistic and of its negation, by falling AUC, ties by name. Statistics are stacked, so one ranking serves them all."""
    stack = F.expr(f"stack({len(statistics)}, {', '.join(f'{c!r}, double({c})' for c in statistics)}) as (statistic, score)")
    a = auc(rows.select(leaked, stack), "score", leaked, ["statistic"]).where("auc is not null")
    both = a.select("statistic", "auc").unionByName(a.select(F.concat("statistic", F.lit(" (negated)")).alias("statistic"), (1 - F.col("auc")).alias("auc")))
    # two rows a statistic
    return both.withColumn("auc", F.round("auc", 9)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("auc"), "statistic")))


def drift(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(key, a, b, delta, same) over the union of the keys of two flattened reports: null against null is the same, null against a value isn't."""
    x, y = a.select(key, F.col(value).cast("double").alias("a")), b.select(key, F.col(value).cast("double").alias("b"))
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("b") - F.col("a")) <= tolerance, F.lit(False))
    return x.join(y, key, "full_outer").select(key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), same.alias("same"))


def flattened(report: DataFrame, *keys: str) -> DataFrame:
    """(measure, value) of a small wide report: a row for each numeric column, named by the keys' values and the column."""
    cols = [c for c, t in report.dtypes if c not in keys and t in ("int", "bigint", "double", "float")]
    parts = F.array(*(F.struct(F.concat_ws(".", *(F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in keys), F.lit(c)).alias("measure"), F.col(c).cast("double").alias("value")) for c in cols))
    return report.select(F.explode(parts).alias("x")).select("x.*")


def tail(df: DataFrame, key: str, parts: int = 10) -> DataFrame:
    """The last max(1, rows // parts) rows by key; none of an empty table."""
    pos = ordered_position(df.withColumn("_key", F.col(key).cast("double")), "_key", [key])
    return pos.where(F.col("position") > F.col("total") - F.greatest(F.lit(1), F.floor(F.col("total") / parts))).drop("_key", "position", "total")
