"""The stateless gate over a stream of documents: the same column pipeline as in batch, per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.calibrate import decide, decisions, naive_risk
from ..operators.detect import validator_spans
from ..operators.redact import redact, with_placeholders
from ..operators.risk import detected, feature_scorer, raw_risk, with_survivors
from ..schema import BUDGET, THRESHOLD
from ..sources.io import gate_payload


def gate(docs: DataFrame, scorer: Callable[[DataFrame], DataFrame] = feature_scorer) -> DataFrame:
    """docs: doc_id, text. (doc_id, n_spans, vault_size, redacted, risk, forward, route, reason), uncalibrated."""
    d = docs.where("text is not null").withColumn("spans", validator_spans("text"))
    risk = with_survivors(scorer(d), "spans").select("doc_id", naive_risk(raw_risk("surviving")).alias("risk"))
    return decide(redact(d).join(risk, "doc_id"))


def payload(docs: DataFrame, scorer: Callable[[DataFrame], DataFrame] = feature_scorer, blocks: DataFrame | None = None, threshold: float = THRESHOLD, budget: float = BUDGET) -> DataFrame:
    """docs: doc_id, text. (doc_id, payload): what the gate says about each document with text, as JSON: characters, identifiers_found, spans, redacted, vault_size, calibrated and decision. The vault isn't in it."""
    d = detected(docs, scorer, threshold=threshold)
    d = with_survivors(d, "spans").withColumn("expected", raw_risk("surviving")).drop("tokens", "surviving")
    red = with_placeholders(d).select("doc_id", "r.redacted", "r.vault_size")
    made = decisions(d, "expected", blocks, budget).join(red, "doc_id").select("doc_id", F.length("text").alias("characters"), F.size("spans").alias("identifiers_found"), "spans", "redacted", "vault_size", F.lit(blocks is not None).alias("calibrated"), "decision")
    return gate_payload(made)


def run(spark: SparkSession, source: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Read documents as they arrive, gate each micro-batch and hand it to sink(decisions, batch number)."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: sink(gate(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, time: str = "arrived_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Decisions per window of arrival and route, with a watermark for late rows; works on a stream and in batch."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "route").agg(F.count("*").alias("decisions")).select(F.col("w.start").alias("window_start"), "route", "decisions")
