"""Shared plumbing of the training-data operators: Arrow batches, code points, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled at once inside a Python worker; bounds its memory whatever the length of the texts.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input has fewer partitions than the cluster has cores (a few small files);
    larger inputs keep their scan partitions and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < 2 * df.rdd.getNumPartitions() <= cores or df.rdd.getNumPartitions() == 1 < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in spark.checkpoint.dir; only where it is unset (local tests) one is made."""
    sc = spark.sparkContext
    # the files of a checkpoint go when nothing refers to it any more
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = f"/tmp/veilspark-checkpoints/{uuid.uuid4().hex}"
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; fn may return None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(lengths: np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `most` units in all; a single longer row stands alone."""
    i, n = 0, len(lengths)
    cum = np.concatenate(([0], np.cumsum(lengths)))
    while i < n:
        j = int(np.searchsorted(cum, cum[i] + most, side="right")) - 1
        j = max(j, i + 1)
        yield i, j
        i = j


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets into them) of a string column, straight from the Arrow buffers; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    if not (wide or pa.types.is_string(col.type)):
        col = col.cast(pa.large_string())
        wide = True
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8)[off[0] : off[-1]] if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points as uint32, row offsets into them) of a string column, decoded for the whole buffer at once."""
    data, off = string_bytes(col)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return codes, starts[off]


def to_strings(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of code_points, again for the whole buffer at once."""
    raw = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; counts no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only behind a check of the size; otherwise the join shuffles as usual."""
    return F.broadcast(df) if small_enough(df, most_rows) else df
