"""The pN_ queries and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answers, cross_split, language, near_duplicates, normalize, packing, personal, sentences, splitting, tokenize
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "documents"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = normalize.found_rows(table(spark, sf_dir, "documents"), "doc_id").withColumn("table_name", F.lit("documents"))
    spans = normalize.found_rows(table(spark, sf_dir, "predicted_span"), "span_id").withColumn("table_name", F.lit("predicted_span"))
    return docs.unionByName(spans).select("table_name", "row_id")


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in the one form."""
    docs = normalize.normalise(table(spark, sf_dir, "documents"), "doc_id").withColumn("table_name", F.lit("documents"))
    spans = normalize.normalise(table(spark, sf_dir, "predicted_span"), "span_id").dropDuplicates(["row_id", "text"]).withColumn("table_name", F.lit("predicted_span"))
    return docs.unionByName(spans).select("table_name", "row_id", "text")


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = language.weights_of(table(spark, sf_dir, "documents"))
    pairs = answers.pairs_of(table(spark, sf_dir, "demo_run"), table(spark, sf_dir, "answer"))
    # both tables go through the operator at once; the sign of the key keeps their ids apart
    keyed = pairs.withColumn("row_id", F.expr("if(table_name = 'answer', -row_id - 1, row_id)"))
    found = answers.find_defects(keyed, weights)
    return found.select(F.expr("if(row_id < 0, 'answer', 'demo_run')").alias("table_name"), F.expr("if(row_id < 0, -row_id - 1, row_id)").alias("row_id"), "defect")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).where("defect is not null")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).groupBy("table_name", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_report(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_items(personal.detect(table(spark, sf_dir, "documents")))


def _key(spark: SparkSession) -> str:
    """The secret named in veilspark.personal.key; else one for this run, which links values within its result only."""
    return spark.conf.get("veilspark.personal.key", None) or secrets.token_hex(32)


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(table(spark, sf_dir, "documents"), _key(spark)).select("doc_id", F.col("redacted").alias("text"), F.size("items").alias("items"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values met in several documents, by their placeholders."""
    return personal.links(personal.redact(table(spark, sf_dir, "documents"), _key(spark)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece = 0").select("run_id", "doc_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "deploy_cost"))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.window_check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "deploy_cost"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(language.classify(table(spark, sf_dir, "documents")))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = language.classify(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "main_lang", "confidence", F.explode("segments").alias("s")).select("doc_id", "main_lang", "confidence", "s.start_pos", "s.end_pos", "s.lang", F.col("s.confidence").alias("segment_confidence"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_plan"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "pack_plan")
    return packing.fill(packing.pack(table(spark, sf_dir, "documents"), plan), plan)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_sentences(spark, sf_dir).select("doc_id", "start_pos")


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_BLANK = "[ \\t\\n\\r\\f\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+".replace("\\\\", "\\")
#: From a CTE src (doc_id, s) of texts: their distinct shingles g and the number of each, n.
_SHINGLES = f"""t AS (SELECT *, trim(regexp_replace(lower(s), '{_BLANK}', ' ', 'g'), ' ') AS u FROM src),
g AS (SELECT DISTINCT doc_id, hash(substring(u, i, 12)) AS h FROM (SELECT doc_id, u, unnest(range(1, length(u) - 10)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)"""
_MASKED = """sp AS (SELECT doc_id, s.start_pos AS st, s.end_pos AS en, s.label AS lb, row_number() OVER (PARTITION BY doc_id ORDER BY s.start_pos, s.end_pos, i) AS rn
  FROM (SELECT doc_id, text, unnest(spans) AS s, generate_subscripts(spans, 1) AS i FROM documents WHERE length(text) >= 200) WHERE s IS NOT NULL AND s.start_pos >= 0 AND s.end_pos > s.start_pos AND s.end_pos <= length(text)),
kp AS (SELECT doc_id, rn, st, en, lb, en AS last, true AS keep FROM sp WHERE rn = 1
  UNION ALL SELECT sp.doc_id, sp.rn, sp.st, sp.en, sp.lb, CASE WHEN sp.st >= kp.last THEN sp.en ELSE kp.last END, sp.st >= kp.last FROM kp JOIN sp ON sp.doc_id = kp.doc_id AND sp.rn = kp.rn + 1),
pc AS (SELECT kp.doc_id, kp.st, kp.en, substring(d.text, coalesce(lag(kp.en) OVER w, 0) + 1, kp.st - coalesce(lag(kp.en) OVER w, 0)) || '[' || coalesce(kp.lb, 'None') || ']' AS piece
  FROM kp JOIN documents d USING (doc_id) WHERE kp.keep WINDOW w AS (PARTITION BY kp.doc_id ORDER BY kp.st)),
mt AS (SELECT doc_id, string_agg(piece, '' ORDER BY st) AS head, max(en) AS en FROM pc GROUP BY doc_id),
src AS (SELECT d.doc_id, lower(trim(d.split, ' ')) AS split, d.source, coalesce(mt.head, '') || substring(d.text, coalesce(mt.en, 0) + 1) AS s FROM documents d LEFT JOIN mt USING (doc_id) WHERE length(d.text) >= 200)"""
_CROSS = f"""WITH RECURSIVE {_MASKED}, {_SHINGLES},
tr AS (SELECT g.* FROM g JOIN src USING (doc_id) WHERE split = 'train'), ev AS (SELECT g.* FROM g JOIN src USING (doc_id) WHERE split IN ('dev', 'test')),
j AS (SELECT tr.doc_id AS a, ev.doc_id AS b, count(*) AS k FROM tr JOIN ev USING (h) GROUP BY ALL),
pr AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.6 * (x.n + y.n - k))"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries SQL can express over whole tables; the others are tested by brute force, round trips and held-out accuracy."""
    return {
        "p1_found": f"""WITH src AS (SELECT doc_id, text AS s FROM documents WHERE length(text) >= 200), {_SHINGLES}, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.6 * (x.n + y.n - k)""",
        "p4_found": f"{_CROSS} SELECT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM pr",
        "p4_report": f"""{_CROSS}, hit AS (SELECT b AS doc_id, count(*) AS n FROM pr GROUP BY b)
SELECT src.split, src.source, count(*) AS documents, count(hit.n) AS overlapping, coalesce(sum(hit.n), 0)::BIGINT AS pairs FROM src LEFT JOIN hit USING (doc_id) WHERE src.split IN ('dev', 'test') GROUP BY ALL""",
        "p6_found": """SELECT DISTINCT run_id, doc_id FROM (SELECT DISTINCT run_id, first_doc_id, last_doc_id, window_chars FROM deploy_cost WHERE window_chars >= 1) r
JOIN documents d ON d.doc_id BETWEEN r.first_doc_id AND r.last_doc_id AND length(d.text) > r.window_chars""",
    }
