"""Calibration of raw risk by pooled adjacent violators, and the gate that uses it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BUDGET
from .stats import in_ranges, jeffreys_mean, wilson_upper

MIN_BLOCK = 25
BLOCKS = "right_edge double, leaks double, n long"


def corners(weight: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Indices of the corners of the greatest convex minorant of the points (weight, height), both cumulated and beginning with 0. Its slopes are the isotonic means."""
    kept = [0]
    for k in range(1, len(weight)):
        # a corner that doesn't lie under the chord from the one before it to the new point is none
        while len(kept) > 1:
            i, j = kept[-2:]
            if (height[j] - height[i]) * (weight[k] - weight[i]) < (height[k] - height[i]) * (weight[j] - weight[i]):
                break
            del kept[-1]
        kept.append(k)
    return np.array(kept)


def pool_adjacent(pdf: pd.DataFrame, min_block: int = MIN_BLOCK) -> pd.DataFrame:
    """pdf: x, y, n in ascending order of x; a row may carry several observations (n), y of them leaking. (right_edge, leaks, n) of the isotonic blocks, neighbours of one mean being one block. Each block is as many
    of these as it takes to hold min_block observations; what is left at the end joins the last."""
    n, y, x = (pdf[c].to_numpy() for c in ("n", "y", "x"))
    weight, height = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(y)))
    at = corners(weight, height)
    ends, held = [], 0
    for k in at[1:]:
        if weight[k] - held >= min_block:
            ends.append(k)
            held = weight[k]
    if len(n) and (not ends or ends[-1] != len(n)):
        ends[-1:] = [len(n)]
    ends = np.array(ends, np.int64)
    before = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return pd.DataFrame({"right_edge": x[ends - 1], "leaks": height[ends] - height[before], "n": (weight[ends] - weight[before]).astype("int64")})


def _pooled_ties(df: DataFrame, raw: str, leaked: str) -> DataFrame:
    # within one x, those that don't leak come first and end up in one block with those that do, so a row per (x, leaked) is enough
    return df.where(F.col(raw).isNotNull() & F.col(leaked).isNotNull()).groupBy(F.col(raw).cast("double").alias("x"), F.col(leaked).cast("int").alias("leak")).agg(F.count("*").alias("n")).withColumn("y", (F.col("leak") * F.col("n")).cast("double"))


def fit(df: DataFrame, raw: str, leaked: str, min_block: int = MIN_BLOCK, rows: int | None = None) -> DataFrame:
    """(block, right_edge, n, leaks, p_hat, p_upper). Rows are counted per distinct x first, each range of x is pooled on its own (blocks pooled inside a range
    are pooled in the whole as well), and the corners that remain, a small power of the rows, are pooled once more."""
    counted = in_ranges(_pooled_ties(df, raw, leaked), "x", rows=rows)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        return pool_adjacent(pdf.sort_values(["x", "leak"]), 1)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pool_adjacent(pdf.assign(mean=pdf["leaks"] / pdf["n"]).sort_values(["right_edge", "mean"]).rename(columns={"right_edge": "x", "leaks": "y"}), min_block)

    blocks = counted.groupBy("range").applyInPandas(local, BLOCKS).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(last, BLOCKS)
    w = Window.orderBy("right_edge", F.col("leaks") / F.col("n"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    n, k = F.col("n").cast("double"), F.col("leaks")
    return blocks.select((F.row_number().over(w) - 1).alias("block"), "right_edge", "n", F.col("leaks").cast("long").alias("leaks"), F.max(jeffreys_mean(k, n)).over(run).alias("p_hat"), F.max(wilson_upper(k, n)).over(run).alias("p_upper"))


def predict(df: DataFrame, blocks: DataFrame, raw: str, upper: bool = True) -> DataFrame:
    """df with `risk`: of the first block whose right edge is at or above raw, the last block beyond; null where raw is null or there are no blocks. Blocks are corners of a convex curve of at least MIN_BLOCK rows each, a
    few thousand for 10^10 rows; each row finds its own by bisection."""
    found = sorted((float(r.right_edge), int(r.block), float(r.p)) for r in blocks.select("right_edge", "block", F.col("p_upper" if upper else "p_hat").alias("p")).collect())
    edges, values = np.array([e for e, _, _ in found]), np.array([p for *_, p in found])

    @F.arrow_udf("double")
    def risk(raws: pa.Array) -> pa.Array:
        none = np.asarray(raws.is_null())
        if not len(edges):
            return pa.nulls(len(raws), pa.float64())
        at = np.searchsorted(edges, raws.fill_null(0.0).to_numpy(zero_copy_only=False), side="left")
        return pa.array(values[np.minimum(at, len(edges) - 1)], pa.float64(), mask=none)

    return df.withColumn("risk", risk(F.col(raw).cast("double")))


def save(blocks: DataFrame, path: str, threshold: float, fitted_on: str) -> None:
    """Blocks as JSON, with the detection threshold they hold for."""
    blocks.coalesce(1).withColumn("threshold", F.lit(threshold)).withColumn("fitted_on", F.lit(fitted_on)).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """Saved blocks; refused at another threshold than they were fitted for."""
    b = spark.read.schema("block int, right_edge double, n long, leaks long, p_hat double, p_upper double, threshold double, fitted_on string").json(path)
    if b.where(F.col("threshold").isNull() | (F.abs(F.col("threshold") - threshold) > 1e-12)).limit(1).count():
        raise ValueError("the calibration was fitted at another threshold")
    return b.drop("threshold", "fitted_on")


def naive_risk(total: Column) -> Column:
    return 1 - F.exp(-total)


#: The two routes, and the two reasons with the risk and the budget to three places.
HOSTED, LOCAL = "hosted_model", "local_model"
WITHIN, EXCEEDS = "residual leak risk %.3f is within the %.3f budget", "residual leak risk %.3f exceeds the %.3f budget -- answering locally"


def decide(df: DataFrame, risk: str = "risk", budget: float = BUDGET) -> DataFrame:
    """df with forward (on the unrounded risk; equal to the budget counts as within), route and reason; all three null where the risk is."""
    f = F.col(risk) <= budget
    reason = lambda form: F.format_string(form, F.col(risk), F.lit(float(budget)))
    return df.withColumn("forward", f).withColumn("route", F.when(f, HOSTED).when(~f, LOCAL)).withColumn("reason", F.when(f, reason(WITHIN)).when(~f, reason(EXCEEDS)))


def decisions(df: DataFrame, expected: str, blocks: DataFrame | None = None, budget: float = BUDGET, upper: bool = True) -> DataFrame:
    """df with `decision`, a struct of forward, risk and risk_naive (5 places), expected_surviving_identifier_tokens (4 places), budget, route and reason. Without blocks the naive risk decides."""
    d = df.withColumn("_naive", naive_risk(F.col(expected)))
    d = predict(d, blocks, expected, upper).withColumnRenamed("risk", "_risk") if blocks is not None else d.withColumn("_risk", F.col("_naive"))
    d = decide(d, "_risk", budget)
    parts = F.struct(
        "forward", F.round("_risk", 5).alias("risk"), F.round("_naive", 5).alias("risk_naive"), F.round(expected, 4).alias("expected_surviving_identifier_tokens"), F.lit(float(budget)).alias("budget"), "route", "reason"
    )
    return d.withColumn("decision", parts).drop("_naive", "_risk", "forward", "route", "reason")
