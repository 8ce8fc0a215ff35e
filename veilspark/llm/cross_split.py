"""Problem 4: the same or near-same records across splits, by minwise hashing with banded buckets.

Each text has every span of `spans` replaced by its label in square brackets (spans that are null, empty, past the end, or overlap an earlier one are left
out), is brought to normal form and shingled into all substrings of 12 code points. 192 minwise values make BANDS bands of ROWS values; documents that agree
in a band share a bucket. Only pairs of one training document with one evaluation document are formed; those whose one-bit sketches agree too little are dropped and the
others verified by the exact Jaccard similarity of whole texts. At a similarity of .63 the bands miss a pair with probability 3e-4, at .7 with 2e-6.

Equal masked texts of one side are one class before the buckets are joined, so a large group of copies meets each evaluation class once; members are expanded after
verification. Buckets are joined, never collected; AQE splits skewed ones.

Null splits, texts of under min_chars code points and null texts take no part. A document without shingles (its normal form has under 12 code points) is similar to
nothing. Split names are compared trimmed and in lower case. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_arrow, spread
from .near_duplicates import _agree, verified
from .shingles import band_keys, class_key, codes_of, distinct, minwise, normal_form, one_bit_sketch, window_hashes

ROWS, BANDS = 4, 48


def masked(text: str, spans: Iterable[dict] | None) -> str:
    """text with each usable span replaced by [label]; spans are taken by start, then end; of two that overlap the earlier one stays."""
    out, last = [], 0
    n = len(text)
    usable = [s for s in spans or () if s is not None and s["start_pos"] is not None and s["end_pos"] is not None and 0 <= s["start_pos"] < s["end_pos"] <= n]
    for s in sorted(usable, key=lambda s: (s["start_pos"], s["end_pos"])):
        if s["start_pos"] >= last:
            out += (text[last : s["start_pos"]], f"[{s['label']}]")
            last = s["end_pos"]
    out.append(text[last:])
    return "".join(out)


def masked_texts(df: DataFrame, min_chars: int = 200) -> DataFrame:
    """(doc_id, text): masked texts of the documents long enough as stored."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([masked(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.string())], ["doc_id", "text"])

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)), fn, "doc_id long, text string")


def signatures(df: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id, side (train or eval), class key, size, sketch and bands of each document that takes part."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sides, cols, bands = [], [], [], []
        for i, t, spans, side in zip(*(c.to_pylist() for c in batch.columns)):
            s = normal_form(masked(t, spans))
            sh = distinct(window_hashes(codes_of(s), 12))
            if not len(sh):
                continue
            m = minwise(sh)
            ids.append(i)
            sides.append(side)
            cols.append((*np.frombuffer(class_key(s), np.int64), len(sh), *one_bit_sketch(m)))
            bands.append(band_keys(m, BANDS, ROWS))
        a = np.array(cols, np.int64).reshape(len(ids), 6)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.bool_()), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), *(pa.array(a[:, k]) for k in (3, 4, 5)), lists], ["doc_id", "train", "c1", "c2", "n12", "s1", "s2", "s3", "bands"])

    split = F.lower(F.trim("split"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans", (split == "train").alias("train")).where(
        F.col("doc_id").isNotNull() & split.isin("train", "dev", "test") & (F.length("text") >= min_chars)
    )
    return map_arrow(spread(docs), fn, "doc_id long, train boolean, c1 long, c2 long, n12 int, s1 long, s2 long, s3 long, bands array<long>")


def class_links(df: DataFrame, threshold: float = 0.6, min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) from the representative of a training class to that of an evaluation class; members (doc_id, train, rep) of all classes of
    two and more. A representative is the least id of its class on its side."""
    sig = cut(signatures(df, min_chars))
    rep = sig.groupBy("c1", "c2", "train").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = cut(sig.select("doc_id", "train", "c1", "c2").join(rep.where("copies > 1"), ["c1", "c2", "train"]).select("doc_id", "train", "rep").distinct())
    others = members.where("doc_id <> rep").select("doc_id")
    reps = sig.join(broadcast_if_small(others, 100_000), "doc_id", "left_anti")
    # the rarer side first: a bucket without an evaluation document is dropped by the join
    evals = reps.where("not train").select("doc_id", F.explode("bands").alias("key"))
    train = reps.where("train").select("doc_id", F.explode("bands").alias("key"))
    pairs = train.alias("a").join(evals.alias("b"), "key").select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    light = reps.select("doc_id", "n12", "s1", "s2", "s3")
    a, b = light.alias("a"), light.alias("b")
    close = (
        pairs.join(a, F.col("x") == F.col("a.doc_id")).join(b, F.col("y") == F.col("b.doc_id"))
        .where((F.least("a.n12", "b.n12") >= F.greatest("a.n12", "b.n12") * F.lit(threshold)) & _agree("a", "b"))
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    ids = (close := cut(close)).select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()
    texts = masked_texts(df.join(broadcast_if_small(ids, 1_000_000), "doc_id", "left_semi"), min_chars)
    return verified(close, texts, threshold), members


def cross_split_pairs(df: DataFrame, threshold: float = 0.6, min_chars: int = 200) -> DataFrame:
    """(train_id, eval_id) of all overlapping pairs, copies expanded on both sides."""
    links, members = class_links(df, threshold, min_chars)
    for side, train in (("a", True), ("b", False)):
        m = members.where(F.col("train") == train).select(F.col("rep").alias(side), F.col("doc_id").alias("m"))
        links = links.join(m, side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
    return links.select(F.col("a").alias("train_id"), F.col("b").alias("eval_id")).distinct()


def cross_split_report(df: DataFrame, threshold: float = 0.6, min_chars: int = 200) -> DataFrame:
    """Per split and source of the evaluation side: split, source, documents (with text long enough), overlapping documents, confirmed pairs. Pairs are counted by the sizes of the training classes;
    copies aren't expanded."""
    links, members = class_links(df, threshold, min_chars)
    sizes = members.where("train").groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("copies"))
    per = links.join(sizes, "a", "left").groupBy("b").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n"))
    copies = members.where("not train").select(F.col("rep").alias("b"), F.col("doc_id").alias("m"))
    hits = per.join(copies, "b", "left").groupBy(F.coalesce("m", "b").alias("doc_id")).agg(F.sum("n").alias("n"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("split")).alias("split"), "source").where("split in ('dev', 'test')").where(df["text"].isNotNull() & (F.length(df["text"]) >= min_chars))
    return (
        docs.join(hits, "doc_id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("documents"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    )
