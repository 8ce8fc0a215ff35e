"""Readers and guarded writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CORPUS, SPAN


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small input has fewer partitions than half the cores; larger inputs keep their scan partitions and aren't shuffled."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if 2 * n <= cores else df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of one JSON document per line; a line that does not fit the schema fails the read, a missing doc_type is the empty string."""
    return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path).na.fill("", ["doc_type"])


def read_corpus_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A source corpus with columns generated_text, pii_spans (JSON text or array) and document_type."""
    df = spark.read.parquet(path)
    spans = F.col("pii_spans")
    if dict(df.dtypes)["pii_spans"] == "string":
        spans = F.from_json(spans, "array<struct<start:int,end:int,label:string>>")
    spans = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start_pos"), s["end"].cast("int").alias("end_pos"), s["label"].alias("label")))
    return df.select(F.col("generated_text").alias("text"), spans.alias("spans"), F.coalesce("document_type", F.lit("")).alias("doc_type"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the session names in spark.checkpoint.dir; only local sessions without it get one of their own. Files of a checkpoint go when nothing refers to it any more."""
    sc = spark.sparkContext
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
    """df written once to the shared folder: for tables that several passes read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_document(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, text) of one document, given as it is or as a UTF-8 file; exactly one of the two. ValueError for both or neither, a missing file, and one that isn't UTF-8."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a file, not both")
    if path is not None:
        try:
            rows = spark.read.format("binaryFile").load(path).select("content").collect()
            text = bytes(rows[0].content).decode("utf-8")
        except (AnalysisException, IndexError, UnicodeDecodeError) as e:
            raise ValueError(f"{path} can't be read as UTF-8 text: {type(e).__name__}") from e
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key; files have no order of their own."""
    return df.orderBy(key).limit(n)


#: Folders that hold no sources of their own.
SKIPPED = (".git", "__pycache__", "node_modules", ".venv")


def _files(spark: SparkSession, folder: str, excluded: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    keep = F.lit(True)
    for e in (*excluded, *SKIPPED):
        keep = keep & ~F.col("path").contains(f"/{e.strip('/')}/")
    return files.where(keep)


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".py", ".md", ".sh", ".txt"), most_bytes: int = 512 * 1024, excluded: Sequence[str] = ()) -> DataFrame:
    """(path, bytes, text) of text files below a folder, none larger than most_bytes, none below a folder named in excluded or SKIPPED; undecodable bytes are replaced."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return _files(spark, folder, excluded).where(ends & (F.col("length") <= most_bytes)).select("path", F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def inventory(spark: SparkSession, folder: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder but those excluded."""
    return _files(spark, folder, excluded).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unreadable(spark: SparkSession, folder: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(path, bytes) of the files below a folder that aren't UTF-8 text."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return _files(spark, folder, excluded).where(~valid).select("path", F.col("length").alias("bytes"))


def manifest(spark: SparkSession, paths: Sequence[str], rows: bool = False) -> DataFrame:
    """(path, bytes, sha256) of files or of all files below folders; with rows also the lines of each."""
    found = reduce(DataFrame.unionByName, (inventory(spark, p) for p in paths)).where("path not like '%/\\_SUCCESS' and path not like '%.crc'")
    if not rows:
        return found
    counts = reduce(DataFrame.unionByName, (spark.read.text(p).select(F.col("_metadata.file_path").alias("path")) for p in paths)).groupBy("path").agg(F.count("*").alias("rows"))
    return found.join(counts, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def write_jsonl(df: DataFrame, path: str, inputs: Sequence[str] = ()) -> DataFrame:
    """Write text, spans and doc_type as JSON lines; returns the manifest (path, bytes, sha256, rows, is_input): each file written with its rows, and the digests of the inputs named."""
    df.select("text", "spans", "doc_type").write.mode("errorifexists").json(path)
    out = manifest(df.sparkSession, [path], rows=True).withColumn("is_input", F.lit(False))
    if inputs:
        out = out.unionByName(manifest(df.sparkSession, inputs).withColumn("rows", F.lit(None).cast("long")).withColumn("is_input", F.lit(True)))
    return out


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_guarded(df: DataFrame, path: str, leaks: Callable[[DataFrame], DataFrame]) -> None:
    """Write df only if leaks(df) finds nothing; otherwise refuse and write nothing. df is made once, and what was looked at is what is written; an existing folder isn't overwritten."""
    made = cut(df)
    if leaks(made).limit(1).count():
        raise PermissionError("refused: the data to be written still holds what it must not")
    made.write.mode("errorifexists").json(path)


def gate_payload(decisions: DataFrame) -> DataFrame:
    """The default JSON output of the gate: a fixed choice of columns, the vault not among them."""
    keep = ["characters", "identifiers_found", "spans", "redacted", "vault_size", "calibrated", "decision"]
    return decisions.select("doc_id", F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("payload"))


__all__ = ["SPAN", "cut", "ensure_checkpoint_dir", "gate_payload", "head", "inventory", "manifest", "read_corpus_parquet", "read_document", "read_files", "read_jsonl", "read_table", "spread", "unreadable", "write_guarded", "write_jsonl", "write_report"]
