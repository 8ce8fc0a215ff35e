"""Answering behind the gate: which model sees a document, and what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .redact import check_answers, rehydrate

#: A model: prompts in, answers out.
Model = Callable[[list[str]], list[str]]


def answer(decisions: DataFrame, question: str, local: Model, hosted: Model | None = None) -> DataFrame:
    """decisions: doc_id, text, redacted, forward. (doc_id, route, answer, took_seconds): forwarded documents go to the hosted model in their redacted form, all others, and all where there
    is no hosted model, to the local one. Documents without a decision are held."""
    split = decisions.withColumn("route", F.when(F.coalesce("forward", F.lit(False)) & F.lit(hosted is not None), "hosted").otherwise("local"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for route, model, column in (("hosted", hosted, "redacted"), ("local", local, "text")):
                part = b[b["route"] == route]
                if len(part):
                    t = time.time()
                    said = model([f"{question}\n\n{x}" for x in part[column]])
                    out.append(pd.DataFrame({"doc_id": part["doc_id"], "route": route, "answer": said, "took_seconds": (time.time() - t) / len(part)}))
            if out:
                yield pd.concat(out)

    return split.select("doc_id", "text", "redacted", "route").mapInPandas(run, "doc_id long, route string, answer string, took_seconds double")


def restored(answers: DataFrame, entries: DataFrame) -> DataFrame:
    """answers with placeholders put back, and whether the answer can be trusted: (doc_id, answer, trustworthy)."""
    checked = check_answers(answers.select(F.col("doc_id").alias("row_id"), "doc_id", "answer"), entries).select(F.col("row_id").alias("doc_id"), "trustworthy")
    return rehydrate(answers, entries, "answer").withColumnRenamed("text", "answer").join(checked, "doc_id")
