"""Tokens, overlapping windows over them, and their labels for training."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BIO_LABELS, IDENTIFIER_TYPES

#: Tokens per window and tokens that consecutive windows share.
MAX_LENGTH, STRIDE = 384, 96


def tokenize(docs: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """(doc_id, token, start_pos, end_pos): one row per match, numbered from 0, offsets in code points; in Arrow batches, linear in the text."""
    import re

    rx = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, m.start(), m.end()) for i, t in zip(b["doc_id"], b["text"]) if t for k, m in enumerate(rx.finditer(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "token", "start_pos", "end_pos"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, token int, start_pos int, end_pos int")


def windows(tokens: DataFrame, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """tokens with `window`: each token in every window that holds it. Window w starts at w * (max_length - stride); the last one is the first to reach the last token."""
    step = max_length - stride
    if step < 1:
        raise ValueError("the shared part must be shorter than the window")
    n = tokens.groupBy("doc_id").agg((F.max("token") + 1).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - max_length) / step)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("token") - max_length) / step) + 1).cast("int")
    held = F.sequence(first, F.least(F.floor(F.col("token") / step).cast("int"), last))
    return tokens.join(n.select("doc_id", last.alias("last_window"), "n"), "doc_id").withColumn("last", F.col("last_window")).select("doc_id", "token", "start_pos", "end_pos", F.explode(held).alias("window"))


def bio_labels(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """tokens with `label` and `label_id`: of the first gold span in order that a token shares a character with, B at its first token and I after, O elsewhere.

    gold: doc_id, spans. Spans stay nested, so a token looks at its document's spans only."""
    first = F.try_element_at(F.filter("spans", lambda s: s.isNotNull() & (s["start_pos"] < F.col("end_pos")) & (s["end_pos"] > F.col("start_pos"))), F.lit(1))
    t = tokens.join(gold.select("doc_id", "spans"), "doc_id", "left").withColumn("hit", first).drop("spans")
    begins = F.col("start_pos") <= F.col("hit.start_pos")
    t = t.withColumn("label", F.when(F.col("hit.label").isin(*IDENTIFIER_TYPES), F.concat(F.when(begins, "B-").otherwise("I-"), F.col("hit.label"))).otherwise("O")).drop("hit")
    return t.withColumn("label_id", F.coalesce(F.array_position(F.array(*map(F.lit, BIO_LABELS)), F.col("label")).cast("int") - 1, F.lit(0)))
