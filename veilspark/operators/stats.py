"""Statistics as column expressions and DataFrame operators. Nothing is approximate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normal quantiles of the two-sided 95 % and the one-sided 95 % bound.
Z_TWO_SIDED, Z_ONE_SIDED = 1.959963984540054, 1.645


def wilson(k: Column, n: Column, z: float = Z_TWO_SIDED) -> tuple[Column, Column]:
    """Wilson interval of k in n, clamped to [0, 1]; null for n = 0."""
    n, k = n.cast("double"), k.cast("double")
    p = F.try_divide(k, n)
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


def wilson_upper(k: Column, n: Column, z: float = Z_ONE_SIDED) -> Column:
    """One-sided upper bound; 1 for n <= 0."""
    return F.coalesce(wilson(k, n, z)[1], F.lit(1.0))


def jeffreys_mean(k: Column, n: Column) -> Column:
    return (k + 0.5) / (n + 1)


#: Rows a range of an ordered scan is meant to hold.
RANGE_ROWS = 1_000_000


def _number(value: Column, cuts: list[float], side: str = "left") -> Column:
    """How many of the sorted cuts lie below value (side right: at or below it), by bisection in Arrow batches; 0 for null."""
    edges = np.array(cuts)

    @F.arrow_udf("int")
    def find(values: pa.Array) -> pa.Array:
        v = values.fill_null(float("-inf")).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, v, side=side).astype(np.int32))

    return find(value.cast("double")) if cuts else F.lit(0)


def _cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    return df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))


def _ranges(df: DataFrame, rows: int | None) -> int:
    return max(64, -(-df.count() // (rows or RANGE_ROWS)))


def in_ranges(df: DataFrame, score: str, tie: str | None = None, rows: int | None = None) -> DataFrame:
    """df with `range` and `part`, whose order is that of score: scores are cut at quantiles into as many ranges as the rows ask for. A score so common that it fills a range has one of its own, cut into parts by
    the numeric column tie."""
    n = _ranges(df, rows)
    cuts = _cuts(df, score, n)
    common = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    # before, at and behind each common score
    below, upto = _number(F.col(score), common), _number(F.col(score), common, "right")
    out = df.withColumn("range", _number(F.col(score), sorted(set(cuts))) + below + upto)
    if not common or tie is None:
        return out.withColumn("part", F.lit(0))
    return out.withColumn("part", F.when(upto > below, _number(F.col(tie), sorted(set(_cuts(df, tie, n))))).otherwise(0))


def ordered_position(df: DataFrame, score: str, ties: Sequence[str], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with `position`, from 1, in the order of score and ties (within each group of `by`), and `total`. No task sorts all rows, even where one score is that of most (the first tie, a number, cuts it up);
    only the counts of the ranges are summed up in one place."""
    cut = in_ranges(df, score, ties[0] if ties else None, rows)
    at = ["range", "part"]
    counts = cut.groupBy(*by, *at).agg(F.count("*").alias("n"))
    counts = counts.withColumn("offset", F.sum("n").over(Window.partitionBy(*by).orderBy(*at)) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*by))).drop("n")
    w = Window.partitionBy(*by, *at).orderBy(score, *ties)
    return cut.join(counts, [*by, *at]).withColumn("position", F.row_number().over(w) + F.col("offset")).drop(*at, "offset")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks, from counts per distinct score, ranked range by range; null if one class is missing."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    per = in_ranges(per.withColumn(score, F.col(score).cast("double")), score, rows=rows)
    sums = per.groupBy(*by, "range").agg(F.sum("n").alias("m"))
    sums = sums.withColumn("before", F.sum("m").over(Window.partitionBy(*by).orderBy("range")) - F.col("m")).drop("m")
    below = F.sum("n").over(Window.partitionBy(*by, "range").orderBy(score)) - F.col("n")
    ranked = per.join(sums, [*by, "range"]).withColumn("rank", F.col("before") + below + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    value = F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))))
    return out.select(*by, F.col("n"), F.col("p").alias("positives"), value.alias("auc"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """df with `p_holm`: step-down adjusted over all rows. The family is a handful of tests."""
    w = Window.orderBy(p, key)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("step", step).withColumn("p_holm", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def fisher_two_sided(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df with `p_fisher`, the probability of a table with the same margins that is no likelier than the observed one (likelihoods within 1e-7 in logarithms count as equal).

    Factorials are a table of summed logarithms up to the largest total of the batch; a row's support, all values of its upper left cell, is one vector of them."""

    @F.pandas_udf("double")
    def p(*cells: pd.Series) -> pd.Series:
        tables = np.stack([x.to_numpy(np.int64) for x in cells], axis=1)
        fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(1, int(tables.sum(1).max(initial=0))) + 1)))))
        out = np.ones(len(tables))
        for k, (up_left, up_right, low_left, low_right) in enumerate(tables):
            row, column, rest = up_left + up_right, up_left + low_left, low_right - up_left
            support = np.arange(max(0, -rest), min(row, column) + 1)
            # all terms that don't depend on the cell cancel out
            weight = -(fact[support] + fact[row - support] + fact[column - support] + fact[rest + support])
            share = np.exp(weight - weight.max())
            seen = weight[up_left - support[0]]
            out[k] = min(1.0, share[weight <= seen + 1e-7].sum() / share.sum())
        return pd.Series(out)

    return df.withColumn("p_fisher", p(a, b, c, d))


def random_gate(p: Column, k: Column, n: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of the leak rate among k of n documents drawn at random, when a share p leaks."""
    return p, F.when((k > 0) & (n > 1), F.sqrt(p * (1 - p) / k * (n - k) / (n - 1)))


def random_gate_samples(df: DataFrame, leaked: str, key: str, coverages: Sequence[float], seeds: int = 20) -> DataFrame:
    """(coverage, k, mean, sd): leak rates among k rows drawn at random, over as many draws as seeds; a draw takes the rows in the order of a digest of key and seed."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string"))), 1, 13), 16, 10).cast("double")
    drawn = df.select(key, F.col(leaked).cast("long").alias("leak"), F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn("draw", digest)
    pos = ordered_position(drawn, "draw", [key], ["seed"])
    rate = _leaks_at(pos, coverages, ["seed"]).withColumn("rate", F.try_divide("leaks", "k"))
    return rate.groupBy("coverage", "k").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"))


def _leaks_at(pos: DataFrame, coverages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, coverage, k, leaks) from position, total and leak: every coverage in one pass over the rows."""
    k = lambda c: F.bround(F.lit(float(c)) * F.col("total"), 0).cast("long")
    sums = pos.groupBy(*by).agg(F.first("total").alias("total"), *(F.coalesce(F.sum(F.when(F.col("position") <= k(c), F.col("leak"))), F.lit(0)).alias(f"l{i}") for i, c in enumerate(coverages))).where("total is not null")
    parts = F.array(*(F.struct(F.lit(float(c)).alias("coverage"), k(c).alias("k"), F.col(f"l{i}").alias("leaks")) for i, c in enumerate(coverages)))
    return sums.select(*by, F.explode(parts).alias("x")).select(*by, "x.*")


def at_coverage(df: DataFrame, score: str, leaked: str, key: str, coverages: Sequence[float]) -> DataFrame:
    """(coverage, k, leaks, leak_rate) among the k lowest scores, k = half-even round of coverage times rows. No rows for an empty table."""
    pos = ordered_position(df, score, [key]).select("position", "total", F.col(leaked).cast("long").alias("leak"))
    return _leaks_at(pos, coverages).withColumn("leak_rate", F.try_divide("leaks", "k"))


def max_coverage(df: DataFrame, score: str, leaked: str, key: str, budgets: Sequence[int]) -> DataFrame:
    """(budget, k): how many of the lowest scores can be taken before more than budget of them leak: the position before the leak that exceeds it."""
    pos = ordered_position(df, score, [key]).withColumn("position", F.col("position").cast("double"))
    total = pos.agg(F.coalesce(F.max("total"), F.lit(0)).alias("all"))
    nth = ordered_position(pos.where(F.col(leaked)).select(F.col("position").alias("at")), "at", []).select("at", F.col("position").alias("nth"))
    grid = df.sparkSession.createDataFrame([(int(b),) for b in budgets], "budget long")
    hit = F.broadcast(grid).join(nth, F.col("nth") == F.col("budget") + 1).select("budget", "at")
    return F.broadcast(grid).join(hit, "budget", "left").join(F.broadcast(total)).select("budget", F.coalesce(F.col("at") - 1, F.col("all")).cast("long").alias("k"))
