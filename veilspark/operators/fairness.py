"""Contrasts of leak rates between groups of gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ascii, normal_surface, token_bucket
from .stats import fisher_two_sided, holm, wilson

NAMES = ("name", "first_name", "last_name")


def with_groups(rows: DataFrame, training_surfaces: DataFrame) -> DataFrame:
    """rows: label, surface, leaked. Adds seen (the normalised surface occurs in training), ascii, bucket."""
    seen = training_surfaces.select(normal_surface("surface").alias("key")).distinct().withColumn("seen", F.lit(True))
    r = rows.withColumn("key", normal_surface("surface")).join(seen, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return r.withColumn("ascii", is_ascii("surface")).withColumn("bucket", token_bucket("surface"))


def contrast_table(rows: DataFrame) -> DataFrame:
    """Seven contrasts (a against b) with recall, Wilson intervals, gap, Fisher's p and Holm's over the seven. One pass over the rows."""
    name = F.col("label").isin(*NAMES)
    single = F.col("bucket") == "1"
    groups: list[tuple[str, Column, Column]] = [
        ("C1", name, ~name),
        ("C2", F.col("label") == "last_name", F.col("label") == "name"),
        ("C3", name & ~F.col("seen"), name & F.col("seen")),
        ("C4", name & ~F.col("ascii"), name & F.col("ascii")),
        ("C5", name & single & ~F.col("seen"), name & single & F.col("seen")),
        ("C6", name & single & ~F.col("ascii"), name & single & F.col("ascii")),
        ("C7", single & (F.col("label") == "last_name"), single & (F.col("label") == "first_name")),
    ]
    aggs = [F.count_if(cond & extra).alias(f"{c}_{side}{what}") for c, a, b in groups for side, cond in (("a", a), ("b", b)) for what, extra in (("n", F.lit(True)), ("k", F.col("leaked")))]
    one = rows.agg(*aggs)
    parts = F.array(*(F.struct(F.lit(c).alias("contrast"), *(F.col(f"{c}_{x}").alias(x) for x in ("an", "ak", "bn", "bk"))) for c, _, _ in groups))
    t = one.select(F.explode(parts).alias("c")).select("c.*")
    lo_a, hi_a = wilson(F.col("an") - F.col("ak"), F.col("an"))
    lo_b, hi_b = wilson(F.col("bn") - F.col("bk"), F.col("bn"))
    recall = lambda k, n: 1 - F.try_divide(F.col(k).cast("double"), F.col(n).cast("double"))
    t = t.withColumn("recall_a", recall("ak", "an")).withColumn("recall_b", recall("bk", "bn")).withColumn("low_a", lo_a).withColumn("high_a", hi_a).withColumn("low_b", lo_b).withColumn("high_b", hi_b).withColumn("gap", F.col("recall_a") - F.col("recall_b"))
    t = t.withColumn("ok_a", F.col("an") - F.col("ak")).withColumn("ok_b", F.col("bn") - F.col("bk"))
    return holm(fisher_two_sided(t, "ok_a", "ak", "ok_b", "bk"), "p_fisher", "contrast").drop("ok_a", "ok_b")


def seen_split(rows: DataFrame) -> DataFrame:
    """Leaks among seen and unseen surfaces."""
    return rows.groupBy("seen").agg(F.count("*").alias("n"), F.count_if("leaked").alias("leaked"))
