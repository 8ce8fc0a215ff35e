"""Exact and near copies: two-stage digests, line-hash index, set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, first_id, copies) of texts that occur more than once. The cheap key (length) goes before the digest only of texts whose length recurs."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.length(text).alias("n"), F.col(text).alias("text"))
    lengths = d.groupBy("n").count().where("count > 1").select("n")
    d = d.join(lengths, "n", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"))
    per = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(per, "digest")


def line_hashes(text: Column | str, least: int = 8) -> Column:
    """Distinct 16-digit prefixes of the SHA-1 of each line, white space collapsed, lines of under `least` characters left out."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= least), lambda x: F.substring(F.sha1(x), 1, 16)))


def line_classes(docs: DataFrame, threshold: float = 0.5, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, shared, jaccard), a < b, between classes whose sets of line hashes reach the threshold, each class named by its least document; members (doc_id, rep, n), a row per document with
    lines, n their number. Documents with equal sets are one class and are looked up once, so copies cost nothing; lines are looked up by prefix (a pair at the threshold shares one of the rarest lines of each)."""
    d = docs.where("text is not null").select("doc_id", line_hashes("text", least).alias("h")).where("size(h) > 0").groupBy("doc_id").agg(F.min("h").alias("h")).withColumn("key", F.sha1(F.concat_ws("", F.sort_array("h"))))
    rep = d.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.sort_array("h")).alias("h"))
    member = d.select("key", "doc_id").join(rep.select("key", "rep", F.size("h").alias("n")), "key").select("doc_id", "rep", "n")
    token = rep.select("rep", F.size("h").alias("n"), F.explode("h").alias("line"))
    df = token.groupBy("line").agg(F.count("*").alias("df")).where("df > 1")
    met = token.join(df, "line").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "line"))).alias("t"))
    # lines nobody else has are rarer still: they come first in the order and shorten the prefix
    prefix = met.withColumn("p", F.col("n") - F.ceil(F.col("n") * threshold) + 1 - (F.col("n") - F.size("t"))).where("p > 0")
    keys = prefix.select("rep", "n", F.explode(F.slice("t", 1, F.col("p").cast("int"))).alias("t")).select("rep", "n", "t.line")
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, (F.col("a.line") == F.col("b.line")) & (F.col("a.rep") < F.col("b.rep")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    sets = rep.select("rep", "h")
    shared = F.size(F.array_intersect("ha", "hb"))
    links = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b")
        .select("a", "b", shared.alias("shared"), (F.size("ha") + F.size("hb") - shared).alias("union"))
        .where(F.col("shared") >= F.col("union") * threshold)
    )
    return links.select("a", "b", "shared", (F.col("shared") / F.col("union")).alias("jaccard")), member


def line_similarity(docs: DataFrame, threshold: float = 0.5, least: int = 8) -> DataFrame:
    """(a, b, shared, jaccard, copies_a, copies_b): a row for each pair of classes that reach the threshold, with the documents in either, and one (a = b, jaccard 1) for each class of several documents. No pair of
    copies is formed; line_classes tells who belongs to a class."""
    links, member = line_classes(docs, threshold, least)
    sizes = member.groupBy("rep").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    same = sizes.where("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"))
    side = lambda x: sizes.select(F.col("rep").alias(x), F.col("copies").alias(f"copies_{x}"))
    return same.unionByName(links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", "jaccard", "copies_a", "copies_b"))


def line_counts(docs: DataFrame, by: str) -> DataFrame:
    """Lines that are neither blank nor comments (starting with #), per group."""
    lines = docs.where("text is not null").select(by, F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(~F.trim("line").startswith("#") & (F.length(F.trim("line")) > 0)).groupBy(by).agg(F.count("*").alias("lines"))
