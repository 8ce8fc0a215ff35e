"""Problem 9: filling fixed-capacity containers, by first-fit decreasing over a tournament tree, in randomised groups of documents.

Sizes are tokens of the plan's tokenizer, by the tokenization automaton; a text is split once for all tokenizers of the plan. Documents are dealt to groups of
about GROUP_DOCS by a hash of their id and the plan; each group is packed on its own, by decreasing size (ties by id), each item into the
first container with room, which the tree of largest free rooms finds in logarithmic time. Groups bound what a task holds; the room they leave
unused besides is one partly filled container each.

A text larger than the capacity is divided into full containers and a rest; the rest is an item like any other. Texts of no tokens (null, empty) take no room and lie
in their group's first container. Plans with a null or unusable tokenizer or capacity have no containers. A row given twice is packed twice. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import map_arrow, spread
from .tokenize import TOKENIZER_DIR, automaton, split_texts

GROUP_DOCS = 4096
PLANS_AT_ONCE = 64


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, items taken in the order given; no item is larger than the capacity."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        room[node] -= size
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return out


def token_counts(df: DataFrame, tokenizers: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n: array of token counts, in the order of tokenizers)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        engines = [automaton(t, folder) for t in tokenizers]
        for a in engines:
            a.split([])
        words, counts = split_texts(batch.column(1).to_pylist())
        n = np.stack([a.count_words(words, counts) for a in engines], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(engines)), pa.array(n.ravel().astype(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "n"])

    return map_arrow(spread(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), fn, "doc_id long, n array<long>")


def pack(df: DataFrame, plan: DataFrame, folder: str = TOKENIZER_DIR, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(plan_id, container_id, doc_id, part, first_token, n_tokens): which tokens of which text lie in which container."""
    # the plan is a table of settings, not data that grows; PLANS_AT_ONCE rows of it share one pass over the texts
    plans = [p for p in plan.select("plan_id", "tokenizer", "capacity_tokens").distinct().orderBy("plan_id", "tokenizer", "capacity_tokens").collect() if p.plan_id is not None and p.tokenizer and (p.capacity_tokens or 0) > 0]
    return reduce(DataFrame.unionByName, (_pack(df, plans[i : i + PLANS_AT_ONCE], folder, group_docs) for i in range(0, max(1, len(plans)), PLANS_AT_ONCE)))


def _pack(df: DataFrame, plans: list[Row], folder: str, group_docs: int) -> DataFrame:
    names = sorted({p.tokenizer for p in plans})
    schema = "plan_id int, container_id long, doc_id long, part int, first_token long, n_tokens long"
    if not plans:
        return df.sparkSession.createDataFrame([], schema)
    groups = max(1, -(-df.count() // group_docs))

    def fn(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select([])
        plan_id, group, capacity = (table.column(k)[0].as_py() for k in ("plan_id", "group", "capacity"))
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        items = np.nonzero((rest > 0) | (n == 0))[0]
        items = items[np.lexsort((ids[items], -rest[items]))]
        bins = np.array(first_fit_decreasing(rest[items].tolist(), capacity), np.int64)
        first = int(bins.max()) + 1 if len(bins) else 0
        rows = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        doc = np.concatenate((ids[rows], ids[items]))
        parts = np.concatenate((part, full[items]))
        box = np.concatenate((first + np.arange(len(rows)), bins)) + (np.int64(group) << 32)
        size = np.concatenate((np.full(len(rows), capacity), rest[items]))
        return pa.table({"plan_id": pa.array(np.full(len(doc), plan_id), pa.int32()), "container_id": pa.array(box, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "part": pa.array(parts, pa.int32()), "first_token": pa.array(parts * capacity, pa.int64()), "n_tokens": pa.array(size, pa.int64())})

    choice = F.array(*(F.struct(F.lit(p.plan_id).cast("int").alias("plan_id"), F.lit(names.index(p.tokenizer)).alias("k"), F.lit(p.capacity_tokens).cast("long").alias("capacity")) for p in plans))
    sized = token_counts(df, names, folder).select("doc_id", "n", F.explode(choice).alias("p"))
    sized = sized.select("p.plan_id", "p.capacity", "doc_id", F.expr("n[p.k]").alias("n"), F.pmod(F.xxhash64("doc_id", "p.plan_id"), F.lit(groups)).alias("group"))
    return sized.groupBy("plan_id", "group").applyInArrow(fn, schema)


def fill(packed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per plan: containers used, the least number any packing needs, and the share of the room that is filled."""
    used = packed.groupBy("plan_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    return used.join(plan.select("plan_id", "tokenizer", "capacity_tokens").distinct(), "plan_id").select(
        "plan_id", "tokenizer", "capacity_tokens", "containers", "tokens", "largest",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"),
    )
