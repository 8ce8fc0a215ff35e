"""One query per operator over the standard tables, with its SQL in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import calibrate, dedupe, evaluate, fairness, pathredact, redact, risk, spans, stats, tokens
from ..operators.detect import BASELINE, baseline_spans, validator_spans
from ..schema import IDENTIFIER_TYPES
from ..sources.io import cut, read_table, spread
from .oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register fn under its name; integers come out as longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))

    _QUERIES[fn.__name__] = run
    return run


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def _texts(s: SparkSession, d: str, *more: str) -> DataFrame:
    """doc_id, text and more, for work on every character."""
    return spread(_docs(s, d).where("text is not null").select("doc_id", "text", *more))


def _pred(s: SparkSession, d: str) -> DataFrame:
    """Predicted spans, rows delivered twice once."""
    return read_table(s, d, "predicted_span").select("span_id", "doc_id", "start_pos", "end_pos", "label", "score").distinct()


def _both(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text, gold, pred: nested per document."""
    p = spans.nested(_pred(s, d), "label", "score").withColumnRenamed("spans", "pred")
    empty = F.array().cast("array<struct<start_pos:int,end_pos:int,label:string,score:double>>")
    gold = F.coalesce("spans", F.array().cast("array<struct<start_pos:int,end_pos:int,label:string>>"))
    return _docs(s, d).select("doc_id", "text", "lang", "split", gold.alias("gold")).join(p, "doc_id", "left").withColumn("pred", F.coalesce("pred", empty))


def _gate(s: SparkSession, d: str) -> DataFrame:
    """The last decision with a risk of each document, with whether the document leaked."""
    g = read_table(s, d, "gate_decision").where("risk is not null")
    w = Window.partitionBy("doc_id").orderBy(F.desc("decided_at"), F.desc("risk"), F.desc("risk_naive"), F.desc("expected_surviving_identifier_tokens"), F.desc("budget"))
    g = g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "risk", "risk_naive", F.col("expected_surviving_identifier_tokens").alias("expected"), "budget", "forwarded")
    leak = evaluate.per_document(_both(s, d)).select("doc_id", (F.col("leaked") > 0).alias("leaked"))
    # a slim table that several passes read
    return cut(g.join(leak, "doc_id"))


# --- scans, projections -------------------------------------------------------------------------------------------------------------------------------------------------


@query
def scan_gold_spans(s, d):
    """Column-pruned scan of the annotation, exploded."""
    return _docs(s, d).select("doc_id", F.posexplode("spans").alias("i", "s")).where("s is not null").select("doc_id", F.col("i"), "s.start_pos", "s.end_pos", "s.label")


@query
def spans_json_roundtrip(s, d):
    j = F.from_json(F.to_json("spans"), "array<struct<start_pos:int,end_pos:int,label:string>>")
    return _docs(s, d).where("spans is not null").select("doc_id", F.size(j).alias("n"), F.coalesce(F.aggregate(F.filter(j, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x["start_pos"]), F.lit(0)).alias("starts"))


@query
def surfaces_projected(s, d):
    """Surface of each predicted span against its recorded text."""
    p = read_table(s, d, "predicted_span").select("span_id", "doc_id", "start_pos", "end_pos", F.col("text").alias("recorded")).distinct()
    j = p.join(_docs(s, d).select("doc_id", "text"), "doc_id").where("text is not null and start_pos >= 0 and end_pos > start_pos and end_pos <= length(text)")
    own = X.surface_of("text", "start_pos", "end_pos")
    return j.select("span_id", (own == F.col("recorded")).alias("same"), F.length(own).alias("n"))


@query
def tail_split_dev(s, d):
    """The last 2,000 training documents by id are the development tail."""
    return _docs(s, d).where("split = 'train'").select("doc_id", "source").orderBy(F.desc("doc_id")).limit(2000)


@query
def head_slice(s, d):
    return _docs(s, d).select("doc_id", "doc_type").orderBy("doc_id").limit(800)


# --- detection ----------------------------------------------------------------------------------------------------------------------------------------------------------


def _hits(s: SparkSession, d: str, pattern: str, keep: Callable | None = None) -> DataFrame:
    h = X.find_all("text", pattern)
    h = F.filter(h, lambda x: keep(x["surface"])) if keep else h
    return _texts(s, d).select("doc_id", h.alias("h")).where("size(h) > 0").select("doc_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: x["surface"]), "|").alias("surfaces"))


@query
def detect_email(s, d):
    return _hits(s, d, X.PATTERNS["email"])


@query
def detect_ipv4(s, d):
    return _hits(s, d, X.PATTERNS["ipv4"])


@query
def detect_ipv6(s, d):
    return _hits(s, d, X.PATTERNS["ipv6"])


@query
def detect_ssn(s, d):
    return _hits(s, d, X.PATTERNS["ssn"])


@query
def detect_card_luhn(s, d):
    return _hits(s, d, X.PATTERNS["credit_card_number"], X.luhn_ok)


@query
def detect_iban_mod97(s, d):
    return _hits(s, d, X.PATTERNS["iban"], X.iban_ok)


@query
def extracted_urls(s, d):
    """Addresses on the web; the stored texts hold few, so each has a sentence behind it that names one, made of the document's source."""
    t = _texts(s, d, "source").select("doc_id", F.concat("text", F.lit("\nsee https://"), F.regexp_replace(F.coalesce("source", F.lit("none")), r"[^A-Za-z0-9.-]", "-"), F.lit(".example/a?b=1, or http://x.example.")).alias("text"))
    h = t.select("doc_id", X.find_all("text", X.URL).alias("h"))
    return h.select("doc_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: x["surface"]), "|").alias("surfaces"))


@query
def detect_name_bigram(s, d):
    return _hits(s, d, BASELINE["name"])


@query
def detection_offsets(s, d):
    """Offsets of e-mail addresses, in code points; the surface read back at them."""
    h = _texts(s, d).select("doc_id", "text", F.explode(X.find_all("text", X.PATTERNS["email"])).alias("h"))
    return h.groupBy(F.col("h.surface").alias("surface")).agg(F.count("*").alias("n"), F.count_if(X.surface_of("text", "h.start_pos", "h.end_pos") == F.col("h.surface")).alias("at_offset"))


@query
def validators_by_label(s, d):
    v = _texts(s, d).select(F.explode(validator_spans("text")).alias("s"))
    return v.groupBy("s.label").agg(F.count("*").alias("spans"), F.sum(F.col("s.end_pos") - F.col("s.start_pos")).alias("chars"))


@query
def baseline_spans_by_label(s, d):
    v = _texts(s, d).select(F.explode(baseline_spans("text")).alias("s"))
    return v.groupBy("s.label").agg(F.count("*").alias("spans"), F.sum(F.col("s.end_pos") - F.col("s.start_pos")).alias("chars"))


@query
def hybrid_union(s, d):
    """Predicted spans united with the validators' and merged, the validators' labels first."""
    b = spread(_both(s, d).where("text is not null").select("doc_id", "text", "pred"))
    kind = "array<struct<start_pos:int,end_pos:int,label:string,score:double>>"
    m = spans.merge_union(F.concat(F.col("pred").cast(kind), validator_spans("text")), ("credit_card_number", "iban", "email", "ipv4", "ipv6", "ssn"))
    return b.select(F.explode(m).alias("m")).groupBy("m.label").agg(F.count("*").alias("spans"), F.sum(F.col("m.end_pos") - F.col("m.start_pos")).alias("chars"))


# --- span algebra -------------------------------------------------------------------------------------------------------------------------------------------------------


@query
def gold_overlap_drop(s, d):
    k = _docs(s, d).select("doc_id", F.explode(spans.drop_overlaps("spans")).alias("k"))
    return k.select("doc_id", "k.start_pos", "k.end_pos", "k.label")


@query
def overlap_drop_longest_first(s, d):
    k = spans.nested(_pred(s, d), "label", "score", "span_id").select("doc_id", F.explode(spans.drop_overlaps("spans", True)).alias("k"))
    return k.select("doc_id", "k.start_pos", "k.end_pos", "k.label")


@query
def union_merge_priority(s, d):
    m = spans.nested(_pred(s, d), "label", "score").select("doc_id", F.explode(spans.merge_union("spans", ("email", "iban"))).alias("m"))
    return m.select("doc_id", "m.start_pos", "m.end_pos", "m.label", "m.score")


@query
def span_coverage(s, d):
    """Per document: characters under any predicted span, merged intervals, gold characters covered."""
    b = _both(s, d).withColumn("mask", spans.merged_intervals("pred")).withColumn("g", spans.merged_intervals("gold"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, m: n + m["end_pos"] - m["start_pos"])
    inside = F.aggregate("g", F.lit(0).cast("long"), lambda n, m: n + spans.covered("mask", m["start_pos"], m["end_pos"]))
    return b.select("doc_id", total("mask").alias("pred_chars"), F.size("mask").alias("intervals"), total("g").alias("gold_chars"), inside.alias("covered"))


@query
def span_drop_audit(s, d):
    """Gold spans that overlap resolution drops, by label, and how many of their characters the kept ones still cover."""
    kept = spans.drop_overlaps("spans")
    b = _docs(s, d).where("spans is not null").select("doc_id", F.filter("spans", lambda x: x.isNotNull() & (x["end_pos"] > x["start_pos"])).alias("raw"), kept.alias("kept"))
    r = b.select("doc_id", F.posexplode("raw").alias("i", "r"), "kept")
    same = F.exists("kept", lambda k: (k["start_pos"] == F.col("r.start_pos")) & (k["end_pos"] == F.col("r.end_pos")) & (k["label"].eqNullSafe(F.col("r.label"))))
    dropped = r.where(~same).select("r.label", (F.col("r.end_pos") - F.col("r.start_pos")).alias("n"), spans.covered(spans.merged_intervals("kept"), F.greatest(F.lit(0), F.col("r.start_pos")), F.col("r.end_pos")).alias("c"))
    return dropped.groupBy("label").agg(F.count("*").alias("dropped"), F.sum("n").alias("chars"), F.sum("c").alias("covered"))


@query
def snap_to_words(s, d):
    """Predicted spans widened to word borders, on those inside their text."""
    p = _pred(s, d).join(_docs(s, d).select("doc_id", "text"), "doc_id").where("text is not null and start_pos >= 0 and end_pos > start_pos and end_pos <= length(text)")
    return p.select("span_id", X.snap("text", "start_pos", "end_pos").alias("w")).select("span_id", "w.start_pos", "w.end_pos")


@query
def token_bio_islands(s, d):
    """Predicted spans taken as tokens: neighbours of one label, one character apart at most, coalesced."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", "label", "score")
    t = _pred(s, d).drop("span_id").distinct().where("end_pos > start_pos")
    gap = F.col("start_pos") - F.lag("end_pos").over(w)
    t = t.withColumn("gap_blank", F.coalesce(gap <= 1, F.lit(True))).withColumn("begins", F.lit(False))
    return spans.islands(t).where("tokens > 1")


@query
def window_dedupe_max_posterior(s, d):
    """Tokens seen by several windows: spans delivered for one place, the best score's label."""
    t = read_table(s, d, "predicted_span").select("doc_id", "start_pos", "end_pos", F.col("score").alias("p_pii"), "label", (F.col("score") * 0.5).alias("p_ident"), F.col("span_id").alias("window"))
    return spans.best_window(t)


@query
def bio_encoding(s, d):
    """Tokens at white space labelled against the annotation, counted per label."""
    docs = _texts(s, d)
    gold = _docs(s, d).select("doc_id", spans.drop_overlaps("spans").alias("spans"))
    return tokens.bio_labels(tokens.tokenize(docs), gold).groupBy("label", "label_id").agg(F.count("*").alias("tokens"))


@query
def token_windows(s, d):
    """Overlapping windows of 384 tokens, 96 shared: per document, windows and tokens seen twice."""
    w = tokens.windows(tokens.tokenize(_texts(s, d)))
    return w.groupBy("doc_id").agg((F.max("window") + 1).alias("windows"), F.count("*").alias("seen"), F.countDistinct("token").alias("tokens"))


# --- redaction ----------------------------------------------------------------------------------------------------------------------------------------------------------


def _for_redaction(s: SparkSession, d: str) -> DataFrame:
    return _both(s, d).select("doc_id", "text", F.col("pred").alias("spans"))


@query
def redact_documents(s, d):
    return redact.redact(_for_redaction(s, d))


@query
def vault_entries(s, d):
    return redact.vault(redact.numbered(_for_redaction(s, d)))


@query
def rehydrate_roundtrip(s, d):
    """Rehydrated texts against the originals, equal but for letter case and outer white space of repeated surfaces."""
    docs = _for_redaction(s, d)
    back = redact.rehydrate(redact.redact(docs), redact.vault(redact.numbered(docs)))
    return back.withColumnRenamed("text", "back").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", (F.col("back") == F.col("text")).alias("same"), F.length("back").alias("n"))


@query
def placeholder_integrity(s, d):
    """Placeholders of recorded answers against the vault of their document."""
    runs = read_table(s, d, "demo_run").select(F.col("demo_id").alias("row_id"), "doc_id", F.col("answer_as_returned").alias("answer")).dropDuplicates(["row_id"])
    c = redact.check_answers(runs, redact.vault(redact.numbered(_for_redaction(s, d))))
    return c.select("row_id", "expected", F.size("intact").alias("intact"), F.size("missing").alias("missing"), F.size("unknown").alias("unknown"), "trustworthy")


# --- risk ---------------------------------------------------------------------------------------------------------------------------------------------------------------


@query
def no_ml_statistics(s, d):
    return risk.surviving_statistics(spread(_both(s, d).select("doc_id", "text", "pred")))


@query
def surviving_characters(s, d):
    b = _both(s, d).where("text is not null").select("doc_id", F.length("text").alias("n"), spans.merged_intervals("pred", F.length("text")).alias("m"))
    return b.select("doc_id", (F.col("n") - F.aggregate("m", F.lit(0), lambda a, x: a + x["end_pos"] - x["start_pos"])).alias("surviving_chars"))


@query
def surviving_risk(s, d):
    """Tokens that survive, by the stand-in scorer: count, raw and naive risk under either mask."""
    b = risk.feature_scorer(spread(_both(s, d).where("text is not null").select("doc_id", "text", "pred")))
    rows = risk.with_survivors(risk.with_survivors(b, name="a"), redacted_only=True, name="r")
    raw = rows.select("doc_id", F.size("tokens").alias("tokens"), F.size("a").alias("surviving"), F.size("r").alias("surviving_redacted_only"), risk.raw_risk("a").alias("raw"))
    return raw.select("doc_id", "tokens", "surviving", "surviving_redacted_only", F.round("raw", 6).alias("raw_risk"), F.round(calibrate.naive_risk(F.col("raw")), 6).alias("naive_risk"))


@query
def naive_risk_check(s, d):
    """Recorded naive risk against 1 - exp(-expected tokens)."""
    g = read_table(s, d, "gate_decision").where("risk_naive is not null and expected_surviving_identifier_tokens is not null")
    err = F.abs(calibrate.naive_risk(F.col("expected_surviving_identifier_tokens")) - F.col("risk_naive"))
    return g.select((err < 1e-3).alias("close")).groupBy("close").agg(F.count("*").alias("n"))


@query
def gate_routes(s, d):
    """Decisions recomputed from risk and budget against the recorded ones; three-valued where risk is null."""
    g = read_table(s, d, "gate_decision").select("doc_id", "risk", "budget", "forwarded", "route", "decided_at").distinct()
    return g.groupBy((F.col("risk") <= F.col("budget")).alias("recomputed"), "forwarded", "route").agg(F.count("*").alias("n"))


# --- scorecards ---------------------------------------------------------------------------------------------------------------------------------------------------------


@query
def scorecard(s, d):
    return evaluate.scorecard(_both(s, d))


@query
def per_type_scorecard(s, d):
    return evaluate.per_type(_both(s, d))


@query
def over_redaction_anti_join(s, d):
    return evaluate.over_redaction(_both(s, d)).groupBy("label").agg(F.count("*").alias("n"))


@query
def doc_any_leak(s, d):
    return evaluate.per_document(_both(s, d)).select("doc_id", "gold", "leaked", (F.col("leaked") > 0).alias("leak"))


@query
def gold_first_overlap(s, d):
    """Each kept identifying gold span with the label of the first predicted span that overlaps it."""
    return evaluate.gold_rows(_both(s, d)).groupBy("label", "found_label").agg(F.count("*").alias("n"))


@query
def label_rollup(s, d):
    """Label frequencies per split and in all."""
    x = _docs(s, d).select(F.coalesce("split", F.lit("none")).alias("split"), F.explode("spans").alias("s")).where("s.label is not null").select("split", F.col("s.label").alias("label"))
    r = x.rollup("label", "split").agg(F.count("*").alias("n"))
    return r.where("label is not null").withColumn("split", F.coalesce("split", F.lit("all")))


@query
def vocab_two_way_diff(s, d):
    """Labels in the data but not in the vocabulary, and the other way round."""
    known = s.createDataFrame([(t,) for t in IDENTIFIER_TYPES], "label string")
    used = _docs(s, d).select(F.explode("spans").alias("s")).select("s.label").where("label is not null").unionByName(read_table(s, d, "predicted_span").select("label").where("label is not null")).distinct()
    a = used.join(F.broadcast(known), "label", "left_anti").withColumn("side", F.lit("data only"))
    return a.unionByName(known.join(used, "label", "left_anti").withColumn("side", F.lit("vocabulary only")))


@query
def report_full_outer(s, d):
    """Gold against predicted counts per label over the union of keys, with null-safe equality."""
    g = _docs(s, d).select(F.explode("spans").alias("s")).where("s.label is not null").groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("gold"))
    p = _pred(s, d).where("label is not null").groupBy("label").agg(F.count("*").alias("predicted"))
    return g.join(p, "label", "full_outer").select("label", "gold", "predicted", F.col("gold").eqNullSafe(F.col("predicted")).alias("same"))


# --- statistics ---------------------------------------------------------------------------------------------------------------------------------------------------------

_SCORES = ("risk", "risk_naive", "expected")


def _stacked(s: SparkSession, d: str) -> DataFrame:
    return _gate(s, d).select("doc_id", "leaked", F.expr(f"stack({len(_SCORES)}, {', '.join(f'{c!r}, {c}' for c in _SCORES)}) as (statistic, score)"))


@query
def auc_by_statistic(s, d):
    a = stats.auc(_stacked(s, d), "score", "leaked", ["statistic"])
    return a.select("statistic", "n", "positives", F.round("auc", 9).alias("auc"))


@query
def best_statistic_two_signs(s, d):
    """The statistic, or its negation, with the largest AUC; ties by name."""
    a = stats.auc(_stacked(s, d), "score", "leaked", ["statistic"]).where("auc is not null")
    both = a.select("statistic", "auc").unionByName(a.select(F.concat("statistic", F.lit(" (negated)")).alias("statistic"), (1 - F.col("auc")).alias("auc")))
    return both.select("statistic", F.round("auc", 9).alias("auc")).orderBy(F.desc("auc"), "statistic").limit(1)


@query
def leak_rate_at_coverage(s, d):
    return stats.at_coverage(_gate(s, d), "risk", "leaked", "doc_id", [0.1, 0.25, 0.5, 0.6365, 0.9]).withColumn("leak_rate", F.round("leak_rate", 9))


@query
def max_coverage_within_exposure(s, d):
    return stats.max_coverage(_gate(s, d), "risk", "leaked", "doc_id", [0, 1, 5, 20, 10**9])


@query
def arm_reports(s, d):
    """The report of each statistic."""
    g = _gate(s, d)
    parts = [evaluate.arm_report(g, c, "leaked", "doc_id", [0.25, 0.6365], [5, 20]).withColumn("arm", F.lit(c)) for c in _SCORES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("arm", "measure", "at", F.round("value", 9).alias("value"))


_BUDGETS = (0.02, 0.045, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3)


@query
def risk_coverage_budgets(s, d):
    return evaluate.risk_coverage(_gate(s, d), "risk", "leaked", _BUDGETS)


@query
def random_gate_closed_form(s, d):
    rc = evaluate.risk_coverage(_gate(s, d), "risk", "leaked", _BUDGETS)
    p = (F.col("leaks") + F.col("leaks_held")) / F.col("documents")
    mean, sd = stats.random_gate(p, F.col("forwarded"), F.col("documents"))
    return rc.select("budget", "forwarded", F.round(mean, 9).alias("mean"), F.round(sd, 9).alias("sd"))


@query
def reliability_bins(s, d):
    return evaluate.reliability_bins(_gate(s, d), "risk", "leaked", "doc_id")


@query
def ece(s, d):
    return evaluate.expected_calibration_error(evaluate.reliability_bins(_gate(s, d), "risk", "leaked", "doc_id"))


@query
def wilson_by_lang(s, d):
    r = evaluate.per_document(_both(s, d)).join(_docs(s, d).select("doc_id", "lang"), "doc_id").where("lang is not null").groupBy("lang").agg(F.sum("gold").alias("n"), F.sum("leaked").alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return r.select("lang", "n", "k", F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"), F.round(stats.wilson_upper(F.col("k"), F.col("n")), 9).alias("upper"))


def _rows(s: SparkSession, d: str) -> DataFrame:
    g = evaluate.gold_rows(_both(s, d)).join(_docs(s, d).select("doc_id", "text", "split"), "doc_id").where("text is not null and start_pos >= 0 and end_pos <= length(text)")
    return g.select("doc_id", "split", "label", X.surface_of("text", "start_pos", "end_pos").alias("surface"), (~F.col("caught")).alias("leaked"))


@query
def fairness_contrasts(s, d):
    """Seven contrasts on the held-out splits, surfaces of the training split as seen."""
    r = _rows(s, d)
    t = fairness.contrast_table(fairness.with_groups(r.where("split in ('dev', 'test')"), r.where("split = 'train'")))
    return t.select("contrast", "an", "ak", "bn", "bk", *(F.round(c, 6).alias(c) for c in ("recall_a", "recall_b", "gap", "p_fisher", "p_holm")))


@query
def seen_unseen_split(s, d):
    r = _rows(s, d)
    return fairness.seen_split(fairness.with_groups(r.where("split in ('dev', 'test')"), r.where("split = 'train'")))


@query
def surface_buckets(s, d):
    r = _rows(s, d)
    return r.select(X.token_bucket("surface").alias("bucket"), X.is_ascii("surface").alias("ascii"), "leaked").groupBy("bucket", "ascii").agg(F.count("*").alias("n"), F.count_if("leaked").alias("leaked"))


@query
def deployment_projection(s, d):
    """Leaks if every name leaked at the rate of unseen names."""
    r = _rows(s, d)
    g = fairness.with_groups(r.where("split in ('dev', 'test')"), r.where("split = 'train'"))
    name = F.col("label").isin(*fairness.NAMES)
    a = g.agg(F.count("*").alias("spans"), F.count_if("leaked").alias("leaks"), F.count_if(name).alias("names"), F.count_if(name & F.col("leaked")).alias("name_leaks"), F.count_if(name & ~F.col("seen")).alias("unseen"), F.count_if(name & ~F.col("seen") & F.col("leaked")).alias("unseen_leaks"))
    projected = F.col("leaks") - F.col("name_leaks") + F.col("names") * F.try_divide("unseen_leaks", "unseen")
    return a.select("*", F.round(projected, 6).alias("projected_leaks"), F.round(1 - F.try_divide(projected, F.col("spans")), 6).alias("projected_recall"))


@query
def posterior_flags(s, d):
    """Documents flagged by their expected surviving tokens at three thresholds, with the leaks among them."""
    g = _gate(s, d)
    cols = [c for t in (0.01, 0.05, 0.2) for c in (F.count_if(F.col("expected") >= t).alias(f"flag_{str(t)[2:]}"), F.count_if((F.col("expected") >= t) & F.col("leaked")).alias(f"leaks_{str(t)[2:]}"))]
    return g.agg(F.count("*").alias("documents"), F.countDistinct("risk").alias("distinct_risks"), F.round(F.avg("risk"), 9).alias("mean"), F.round(F.stddev_pop("risk"), 9).alias("sd"), *cols)


@query
def calibrator_blocks(s, d):
    b = calibrate.fit(_gate(s, d), "expected", "leaked")
    return b.select("block", "right_edge", "n", "leaks", F.round("p_hat", 9).alias("p_hat"), F.round("p_upper", 9).alias("p_upper"))


@query
def calibrated_decisions(s, d):
    """The decision as it is published: risks rounded, route and reason."""
    g = _gate(s, d).select("doc_id", "expected", "leaked")
    p = calibrate.decisions(g, "expected", calibrate.fit(g, "expected", "leaked"))
    return p.select("doc_id", "decision.*")


@query
def naive_decisions(s, d):
    """The decision without a calibration, for every document with an expectation."""
    g = read_table(s, d, "gate_decision").where("expected_surviving_identifier_tokens is not null").groupBy("doc_id").agg(F.max("expected_surviving_identifier_tokens").alias("expected"))
    return calibrate.decisions(g, "expected", budget=0.3).select("doc_id", "decision.*")


@query
def decoded_spans(s, d):
    """Spans decoded from the stand-in scorer's tokens at a threshold."""
    return risk.decoded(risk.feature_scorer(_texts(s, d)), 0.12)


@query
def gate_payloads(s, d):
    """What the gate says about each document as JSON; the keys of it, and the length read back."""
    from ..streaming.gate_stream import payload

    p = payload(_texts(s, d))
    return p.select("doc_id", F.array_join(F.json_object_keys("payload"), ",").alias("keys"), F.get_json_object("payload", "$.characters").cast("long").alias("characters"))


def _no_model(s: SparkSession, d: str) -> DataFrame:
    b = _both(s, d)
    leak = evaluate.per_document(b).select("doc_id", (F.col("leaked") > 0).alias("leaked"))
    return risk.surviving_statistics(spread(b.select("doc_id", "text", "pred"))).join(leak, "doc_id")


@query
def best_no_model_statistic(s, d):
    """Six statistics that need no model and their negations, ranked by AUC."""
    return evaluate.best_statistic(cut(_no_model(s, d)), risk.NO_MODEL, "leaked")


@query
def token_flags_auc(s, d):
    """Posterior sum, token count and tokens above each threshold, of the tokens that survive, ranked by AUC under both signs."""
    b = _both(s, d)
    t = risk.with_survivors(risk.feature_scorer(spread(b.where("text is not null").select("doc_id", "text", "pred"))))
    leak = evaluate.per_document(b).select("doc_id", (F.col("leaked") > 0).alias("leaked"))
    f = risk.flag_statistics(t, (0.01, 0.05, 0.2)).withColumn("posterior", F.round("posterior", 6))
    return evaluate.best_statistic(cut(f.join(leak, "doc_id")), ("posterior", "tokens", "flag_01", "flag_05", "flag_2"), "leaked")


@query
def random_gate_samples(s, d):
    """Leak rates of twenty random gates at three coverages."""
    r = stats.random_gate_samples(_gate(s, d), "leaked", "doc_id", [0.25, 0.5, 0.6365])
    return r.select("coverage", "k", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query
def report_drift(s, d):
    """The scorecard of the dev split against that of the test split, measure by measure."""
    b = _both(s, d)
    of = lambda x: evaluate.flattened(evaluate.scorecard(b.where(F.col("split") == x)))
    r = evaluate.drift(of("dev"), of("test"), "measure", "value")
    return r.select("measure", "a", "b", F.round("delta", 6).alias("delta"), "same")


@query
def label_frequencies(s, d):
    """Labels of the annotation by falling frequency, ties by name."""
    n = _docs(s, d).select(F.explode("spans").alias("s")).where("s.label is not null").groupBy("s.label").agg(F.count("*").alias("n"))
    # labels are a vocabulary
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


@query
def tail_tenth(s, d):
    """The last tenth of the training documents, one at least, as the development tail of a limited run."""
    return evaluate.tail(_docs(s, d).where("split = 'train'").select("doc_id", "source"), "doc_id")


@query
def latency_percentiles(s, d):
    """Nearest-rank percentiles, median, mean and extremes of answering times per model; attempts delivered twice once."""
    a = read_table(s, d, "answer").select("answer_id", "model", "took_seconds").distinct().where("took_seconds is not null and model is not null")
    ranks = [F.expr(f"percentile_disc({q}) within group (order by took_seconds)").alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return a.groupBy("model").agg(F.count("*").alias("n"), *ranks, F.median("took_seconds").alias("median"), F.min("took_seconds").alias("least"), F.max("took_seconds").alias("most"), F.round(F.avg("took_seconds"), 9).alias("mean"))


@query
def throughput_thirds(s, d):
    """Answers per second in the first and the last third by arrival, per model."""
    a = read_table(s, d, "answer").select("answer_id", "model", "took_seconds").distinct().where("took_seconds is not null and model is not null").groupBy("answer_id").agg(F.min("model").alias("model"), F.min("took_seconds").alias("t"))
    pos = stats.ordered_position(a.withColumn("at", F.col("answer_id").cast("double")), "at", [], ["model"])
    third = F.floor(F.col("total") / 3)
    x = pos.withColumn("part", F.when(F.col("position") <= third, "first").when(F.col("position") > F.col("total") - third, "last")).where("part is not null")
    return x.groupBy("model", "part").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*").cast("double"), F.sum("t")), 6).alias("per_second"))


@query
def deploy_rates(s, d):
    """Timed passes by device: runs, documents, characters per second."""
    r = read_table(s, d, "deploy_cost").select("run_id", "device_name", "documents", "characters", "run_seconds").distinct().where("run_seconds > 0")
    return r.groupBy("device_name").agg(F.count("*").alias("runs"), F.sum("documents").alias("documents"), F.round(F.sum("characters") / F.sum("run_seconds"), 3).alias("chars_per_second"))


# --- copies, files ------------------------------------------------------------------------------------------------------------------------------------------------------


@query
def exact_duplicates_sha(s, d):
    return dedupe.exact_copies(_docs(s, d)).select("doc_id", "digest", "first_id", "copies")


@query
def near_duplicates_line_jaccard(s, d):
    """Classes of documents whose sets of lines are alike, with the documents in each."""
    return dedupe.line_similarity(_docs(s, d)).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"), "copies_a", "copies_b")


@query
def line_class_members(s, d):
    """A row per document with lines: its class, and the number of links of the class to others."""
    links, members = dedupe.line_classes(_docs(s, d))
    n = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(n, "rep", "left").select("doc_id", "rep", F.col("n").alias("lines"), F.coalesce("links", F.lit(0)).alias("links"))


@query
def top10_similarity(s, d):
    return dedupe.line_similarity(_docs(s, d)).where("jaccard < 1").select("a", "b", F.round("jaccard", 6).alias("jaccard")).orderBy(F.desc("jaccard"), "a", "b").limit(10)


@query
def sloc_style_line_counts(s, d):
    return dedupe.line_counts(_docs(s, d).withColumn("split", F.coalesce("split", F.lit("none"))), "split")


#: Folders known by name, for the queries over stored texts.
_KNOWN = {"/srv/desk": "<desk>", "/srv/desk/in": "<in>", "/usr/share/desk": "<share>", "/tmp": "<never>"}


def _with_paths(s: SparkSession, d: str) -> DataFrame:
    """doc_id, t: the stored texts, each with sentences behind it that name paths of every kind: known folders one inside another and with neighbours of like names, other folders twice, system folders, and what is no path."""
    name = F.regexp_replace(F.coalesce("source", F.lit("none")), r"[^A-Za-z0-9_.-]", "_")
    planted = F.concat(
        F.lit("\nsee /srv/desk/in/"), name, F.lit(", /srv/desk/out/"), name, F.lit(" and /srv/desk2/in/"), name, F.lit("; /opt/acme/"), name, F.lit("/x.csv beside /opt/acme/"), name, F.lit("/y.csv. Not /usr/bin/env, /tmp/"), name,
        F.lit(", /opt/conda/bin, /run/x nor 12/34/5678, https://a.example/b/c or <in>/d/e; \ue000/usr/share/desk/f\ue001."),
    )
    return _texts(s, d, "source").select("doc_id", F.concat("text", planted).alias("t"))


@query
def path_redaction(s, d):
    """Stored texts with their absolute paths replaced, and whether doing it again changes anything."""
    r = _with_paths(s, d).select("doc_id", pathredact.redact_paths("t", _KNOWN).alias("once"))
    return r.select("doc_id", "once", (pathredact.redact_paths("once", _KNOWN) == F.col("once")).alias("stable"))


@query
def path_leaks(s, d):
    """What the leak finder meets, by stage: paths of the texts as stored, and redacted (no row if there is none)."""
    stages = F.array(F.struct(F.lit("stored").alias("stage"), F.col("t")), F.struct(F.lit("redacted").alias("stage"), pathredact.redact_paths("t", _KNOWN).alias("t")))
    x = _with_paths(s, d).select("doc_id", F.explode(stages).alias("x")).select("doc_id", "x.*")
    return pathredact.leaking_paths(x, "t", _KNOWN).groupBy("stage").agg(F.count("*").alias("leaking"), F.sum(F.size("paths")).alias("paths"))


@query
def decisions_per_day(s, d):
    """Decisions per day of arrival and route: the streaming aggregation, in batch."""
    g = read_table(s, d, "gate_decision").where("arrived_at is not null").select("doc_id", "route", "arrived_at", "decided_at").distinct()
    from ..streaming.gate_stream import arrivals

    return arrivals(g)


@query
def received_lag(s, d):
    """Seconds between receipt and loading, per channel of the source; sources nobody knows under 'unknown'."""
    c = read_table(s, d, "intake_source").select("source", "channel")
    x = _docs(s, d).where("received_at is not null and loaded_at is not null").join(c, "source", "left")
    return x.groupBy(F.coalesce("channel", F.lit("unknown")).alias("channel")).agg(F.count("*").alias("n"), F.sum(F.expr("timestampdiff(SECOND, date_trunc('second', received_at), date_trunc('second', loaded_at))")).alias("seconds"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


