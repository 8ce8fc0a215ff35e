"""Problem 6: splitting oversized items at natural boundaries, by lexical cohesion.

A piece may end at a paragraph, sentence or word boundary. At each paragraph and sentence boundary the words in a block before it are compared with those in
a block after it (cosine of counts); the depth of a valley is how far the similarity lies under the peaks to its left and right. In the size window of a piece, from half
the limit to the limit, the deepest valley is taken (a paragraph's end counts a little deeper, ties go to the later one); without such a boundary the last word boundary, and
without that the limit itself. The next piece begins `overlap` code points before the end of this one.

Sizes are code points. A null limit or one under 1 gives no pieces, a null overlap is 0, one of the limit or more is cut to the limit less one, so that each
piece advances. Texts within the limit, empty and null texts aren't oversized and give no rows. Texts of any length are cut whole, one at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow

BLOCK_WORDS = 24
PARAGRAPH_BONUS = 0.1
#: Ids per bucket of the range join.
RANGE_BUCKET = 1024
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"\n+[ \t\r]*|[.!?…।؟][\"'”’»)\]]*[ \t]+(?=[\W\d_]*[^\W\d_a-z])|[。！？][」”』]*")
_SPACE = re.compile(r"\s+")


def _block_similarity(words: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Cosine of the word counts of the blocks before and after each gap (an index into words)."""
    pad = np.concatenate((np.full(BLOCK_WORDS, -1), words, np.full(BLOCK_WORDS, -2)))
    at = gaps[:, None] + np.arange(BLOCK_WORDS)[None, :]
    left, right = pad[at], pad[at + BLOCK_WORDS]
    lv, rv = left >= 0, right >= 0
    cross = ((left[:, :, None] == right[:, None, :]) & lv[:, :, None]).sum(axis=(1, 2))
    ll = ((left[:, :, None] == left[:, None, :]) & lv[:, :, None]).sum(axis=(1, 2))
    rr = ((right[:, :, None] == right[:, None, :]) & rv[:, :, None]).sum(axis=(1, 2))
    return cross / np.sqrt(np.maximum(1, ll * rr))


def _depths(sim: np.ndarray) -> np.ndarray:
    """How far each similarity lies under the nearest peaks to its left and right."""
    out = np.zeros(len(sim))
    for values, where in ((sim, slice(None)), (sim[::-1], slice(None, None, -1))):
        climb = np.zeros(len(values))
        for i in range(1, len(values)):
            # while the curve falls towards i, the peak is the one its left neighbour has
            climb[i] = climb[i - 1] + values[i - 1] - values[i] if values[i] <= values[i - 1] else 0.0
        out += climb[where]
    return out


def cohesion(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the paragraph and sentence boundaries, depth of each)."""
    marks = [(m.end(), m.group()[0] == "\n") for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]
    if not marks:
        return np.zeros(0, np.int64), np.zeros(0)
    pos = np.array([p for p, _ in marks], np.int64)
    ids: dict[str, int] = {}
    starts, words = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        words.append(ids.setdefault(m.group().lower(), len(ids)))
    gaps = np.searchsorted(np.array(starts, np.int64), pos)
    w = np.array(words, np.int64)
    sim = np.concatenate([_block_similarity(w, gaps[i : i + 512]) for i in range(0, len(gaps), 512)])
    return pos, _depths(sim) + PARAGRAPH_BONUS * np.array([p for _, p in marks])


def pieces(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """[start, end) of each piece of an oversized text; none if it is within the limit."""
    if not text or not limit or limit < 1 or len(text) <= limit:
        return []
    overlap = min(max(overlap or 0, 0), limit - 1)
    pos, depth = cohesion(text)
    out, start = [], 0
    while len(text) - start > limit:
        least = max(start + overlap + 1, start + limit // 2)
        lo, hi = np.searchsorted(pos, (least, start + limit + 1))
        if hi > lo:
            near = depth[lo:hi]
            end = int(pos[lo + len(near) - 1 - int(np.argmax(near[::-1]))])
        else:
            spaces = [m.end() for m in _SPACE.finditer(text, start + overlap + 1, start + limit) if m.end() <= start + limit]
            end = spaces[-1] if spaces else start + limit
        out.append((start, end))
        start = end - overlap
    out.append((start, len(text)))
    return out


def covered(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each document with each run whose range holds it: a range join by buckets of ids, so neither side is crossed with the other."""
    r = runs.where("first_doc_id <= last_doc_id").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_doc_id") / RANGE_BUCKET), F.floor(F.col("last_doc_id") / RANGE_BUCKET))))
    r = broadcast_if_small(r, 200_000)
    return docs.withColumn("bucket", F.floor(F.col("doc_id") / RANGE_BUCKET)).join(r, "bucket").where("doc_id between first_doc_id and last_doc_id").drop("bucket")


def _runs(deploy_cost: DataFrame) -> DataFrame:
    """Each run once: of rows that differ under one id the least, nulls first."""
    rest = [*(F.col(c).cast("long").alias(c) for c in ("first_doc_id", "last_doc_id", "windows")), *(F.col(c).cast("int").alias(c) for c in ("window_chars", "overlap_chars"))]
    return deploy_cost.where("run_id is not null").groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.min(F.struct(*rest)).alias("r")).select("run_id", "r.*")


def split_runs(documents: DataFrame, deploy_cost: DataFrame) -> DataFrame:
    """(run_id, doc_id, piece, start_pos, end_pos) of every oversized document of every run."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for run, doc, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            for k, (a, b) in enumerate(pieces(text, limit, overlap)):
                for c, v in zip(cols, (run, doc, k, a, b)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["run_id", "doc_id", "piece", "start_pos", "end_pos"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = covered(docs, _runs(deploy_cost)).where("window_chars >= 1 and length(text) > window_chars").select("run_id", "doc_id", "text", "window_chars", "overlap_chars")
    return map_arrow(rows, fn, "run_id long, doc_id long, piece int, start_pos int, end_pos int")


def window_check(documents: DataFrame, deploy_cost: DataFrame) -> DataFrame:
    """Per run: documents with text in its range, the windows it recorded, the fewest windows its limits allow (cuts at the limit itself) and the pieces cut at natural
    boundaries (a text within the limit is one of each)."""
    runs = _runs(deploy_cost)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n")).where("n > 0")
    step = "window_chars - least(greatest(coalesce(overlap_chars, 0), 0), window_chars - 1)"
    least = F.sum(F.expr(f"if(n <= window_chars, 1, 1 + ceil((n - window_chars) / ({step})))"))
    of_docs = covered(docs, runs).groupBy("run_id").agg(F.count("*").alias("documents"), F.sum(F.expr("if(n <= window_chars, 1, 0)")).alias("whole"), least.alias("least"))
    cut = split_runs(documents, deploy_cost).groupBy("run_id").agg(F.count("*").alias("cut"))
    usable = "window_chars >= 1"
    return (
        runs.join(of_docs, "run_id", "left").join(cut, "run_id", "left")
        .select("run_id", F.coalesce("documents", F.lit(0)).alias("documents"), "windows", F.expr(f"if({usable}, coalesce(least, 0), null)").alias("fewest_windows"), F.expr(f"if({usable}, coalesce(whole, 0) + coalesce(cut, 0), null)").alias("pieces"))
    )
