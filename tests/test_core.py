"""Golden cases, each accepting check beside a control that must fail."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.operators import calibrate, dedupe, detect, evaluate, fairness, pathredact, redact, risk, spans, stats
from veilspark.schema import BIO_LABELS, IDENTIFIER_TYPES, IDENTIFYING
from veilspark.sources import io

PAY = "Please pay Anita Kulkarni at IBAN GB33BUKB20201555555555 today."
SPANS = "array<struct<start_pos:int,end_pos:int,label:string,score:double>>"


def doc(spark, *rows):
    return spark.createDataFrame([(i, t, [(a, b, label, 1.0) for a, b, label in s]) for i, (t, s) in enumerate(rows)], f"doc_id long, text string, spans {SPANS}")


def one(df):
    return df.collect()[0]


def test_vocabulary():
    assert len(IDENTIFIER_TYPES) == 29 and len(IDENTIFYING) == 25 and len(BIO_LABELS) == 59
    assert BIO_LABELS.index("B-email") == 1 + 2 * IDENTIFIER_TYPES.index("email")


def test_redaction_and_rehydration(spark):
    d = doc(spark, (PAY, [(11, 25, "name"), (34, 56, "iban")]), (PAY, []), ("", []), (None, [(0, 3, "name")]))
    got = {r.doc_id: r for r in redact.redact(d).collect()}
    assert got[0].redacted == "Please pay [NAME_1] at IBAN [IBAN_1] today." and got[0].vault_size == 2
    assert got[1].redacted == PAY and got[1].vault_size == 0 and got[2].redacted == "" and 3 not in got
    back = {r.doc_id: r.text for r in redact.rehydrate(redact.redact(d), redact.vault(redact.numbered(d))).collect()}
    assert back[0] == PAY


def test_equal_surfaces_share_a_placeholder(spark):
    t = "Anita Kulkarni called. ANITA Kulkarni is a customer. Ravi Menon is not."
    d = doc(spark, (t, [(0, 14, "name"), (23, 37, "name"), (53, 63, "name")]))
    r = one(redact.redact(d)).redacted
    assert r.count("[NAME_1]") == 2 and r.count("[NAME_2]") == 1 and "Menon" not in r


def test_overlapping_tail_is_removed(spark):
    d = doc(spark, ("Contact Anita Kulkarni Rao now.", [(8, 22, "name"), (14, 26, "last_name")]))
    assert one(redact.redact(d)).redacted == "Contact [NAME_1] now."


def test_spans_past_the_end_and_empty(spark):
    d = doc(spark, ("abc def", [(4, 99, "name"), (3, 3, "name"), (50, 60, "email")]))
    assert one(redact.redact(d)).redacted == "abc [NAME_1]"


def test_integrity_of_answers(spark):
    v = spark.createDataFrame([(0, "[NAME_1]", "A"), (0, "[IBAN_1]", "B"), (1, "[IPV4_1]", "C")], "doc_id long, ph string, surface string")
    a = spark.createDataFrame([(1, 0, "Paid [NAME_1] via [IBAN_1]."), (2, 0, "Paid [NAME_1] via GB00."), (3, 1, "from [IPV4_1]"), (4, 0, None)], "row_id long, doc_id long, answer string")
    got = {r.row_id: r for r in redact.check_answers(a, v).collect()}
    assert got[1].trustworthy and not got[2].trustworthy and got[2].missing == ["[IBAN_1]"] and got[3].trustworthy and not got[4].trustworthy
    strict = {r.row_id: r for r in redact.check_answers(a, v, strict=True).collect()}
    assert not strict[3].trustworthy and strict[1].trustworthy


@pytest.mark.parametrize(
    "a, b, want",
    [(9, 11, "Kanpur"), (9, 15, "Kanpur")],
)
def test_snap(spark, a, b, want):
    t = "from the Kanpur branch"
    r = one(spark.createDataFrame([(t, a, b)], "t string, a int, b int").select(X.snap("t", "a", "b").alias("s"))).s
    assert t[r.start_pos : r.end_pos] == want


def test_snap_strips_trailing_marks(spark):
    r = one(spark.createDataFrame([("see A- or", 4, 6)], "t string, a int, b int").select(X.snap("t", "a", "b").alias("s"))).s
    assert (r.start_pos, r.end_pos) == (4, 5)


def test_find_all_counts_code_points(spark):
    t = "\U0001f642 josé.garcía@example.com and ñandú@exämple.de, x@y"
    hits = one(spark.createDataFrame([(t,)], "t string").select(X.find_all("t", X.PATTERNS["email"]).alias("h"))).h
    assert [h.surface for h in hits] == ["josé.garcía@example.com", "ñandú@exämple.de"] and all(t[h.start_pos : h.end_pos] == h.surface for h in hits)
    assert one(spark.createDataFrame([(None,)], "t string").select(X.find_all("t", "a").alias("h"))).h == []


def test_validators(spark):
    t = "Mail me at jo@ex.org, card 4111 1111 1111 1111, not 4111 1111 1111 1112, IBAN DE89370400440532013000 not DE89370400440532013001, id 452-11-9834 not 000-11-9834, at 10.0.0.1 not 300.1.1.1, 2001:db8:0:0:0:0:0:1"
    got = one(spark.createDataFrame([(t,)], "t string").select(detect.validator_spans("t").alias("s"))).s
    assert {(s.label, t[s.start_pos : s.end_pos]) for s in got} == {
        ("email", "jo@ex.org"), ("credit_card_number", "4111 1111 1111 1111"), ("iban", "DE89370400440532013000"), ("ssn", "452-11-9834"), ("ipv4", "10.0.0.1"), ("ipv6", "2001:db8:0:0:0:0:0:1"),
    }


def test_detector_queries_against_a_loop(spark, tmp_path):
    import re

    from veilspark.plans import queries as Q

    texts = [
        "josé@hestermarkå.example, a@b.example; 01.99.00.56 and 10.0.0.1, not 1.2.3.456 or 300.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "run 41111111111111110000000, id 4111111111111111-7",
        "12345678901234567890 4111111111111111", "4111 1111 1111 1111 4111 1111 1111 1111", None, "nothing here",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(d)) % 10 == 0

    for name, label, keep in (("detect_email", "email", None), ("detect_ipv4", "ipv4", None), ("detect_card_luhn", "credit_card_number", luhn)):
        pattern = re.compile(X.PATTERNS[label])
        want = {i: [m.group() for m in pattern.finditer(t or "") if keep is None or keep(m.group())] for i, t in enumerate(texts)}
        got = {r.doc_id: (r.n, r.surfaces) for r in Q.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: (len(w), "|".join(w)) for i, w in want.items() if w}
    assert want[1] == ["4111 1111 1111 1111"] and not want[2]


def test_private_characters_move_nothing(spark):
    t = "\ue000 jo@ex.org \ue001\ue001, 10.0.0.1\ue000"
    df = spark.createDataFrame([(1, t, [(2, 5, "name", 1.0)])], f"doc_id long, text string, pred {SPANS}")
    got = one(df.select(detect.validator_spans("text").alias("s"))).s
    assert [(s.label, t[s.start_pos : s.end_pos]) for s in got] == [("email", "jo@ex.org"), ("ipv4", "10.0.0.1")]
    c = one(risk.surviving_statistics(df))
    assert (c.surviving_chars, c.surviving_words, c.surviving_digit_runs) == (len(t) - 3, 4, 1)


def test_words_with_digits_are_counted_once(spark):
    df = spark.createDataFrame([(1, "Ref 12/34/5678 a12b34 9", [])], f"doc_id long, text string, pred {SPANS}")
    c = one(risk.surviving_statistics(df))
    assert (c.surviving_digit_runs, c.surviving_capitalised, c.capitals_and_digits) == (2, 1, 3)


def test_decoding_of_tokens(spark):
    t = "Anna Bell\u00a0Cole, x Dora Eve"
    at = [(0, 4), (5, 9), (10, 15), (16, 17), (18, 22), (23, 26)]
    labels, p = ["B-name", "I-name", "I-name", "I-name", "B-name", "B-name"], [0.9, 0.3, 0.2, 0.1, 0.5, 0.6]
    toks = [(a, b, q, x, q) for (a, b), q, x in zip(at, p, labels)]
    df = spark.createDataFrame([(1, t, toks), (2, None, []), (3, "", [])], f"doc_id long, text string, tokens {risk._TOKENS}")
    got = sorted((r.start_pos, r.end_pos, r.label, r.score, r.tokens) for r in risk.decoded(df, 0.2).collect())
    # the threshold counts, a token under it and a B- break
    assert got == [(0, 15, "name", 0.2, 3), (18, 22, "name", 0.5, 1), (23, 26, "name", 0.6, 1)]


def test_decoding_stays_within_each_row(spark):
    # two texts share a batch; NaN reaches the threshold, null doesn't; a text that ends with a kept token doesn't join the next one's
    toks = lambda *x: [(a, b, q, l, q) for a, b, q, l in x]
    one_ = toks((0, 2, 0.5, "name"), (3, 5, float("nan"), "I-name"), (6, 8, None, "name"), (9, 11, 0.9, "name"))
    two = toks((0, 2, 0.7, "name"), (3, 5, 0.4, "name"), (7, 9, 0.3, "email"), (10, 12, 0.3, None))
    rows = [(1, "aa bb cc dd", one_), (2, "aa\x1fbb, cc dd", two), (3, "x", None), (4, "aa-bb", toks((0, 2, 0.7, "name"), (3, 5, 0.4, "name")))]
    df = risk.decoded(spark.createDataFrame(rows, f"doc_id long, text string, tokens {risk._TOKENS}").coalesce(1), 0.2)
    got = sorted(((r.doc_id, r.start_pos, r.end_pos, r.label, r.score, r.tokens) for r in df.collect()))
    assert got == [(1, 0, 5, "name", 0.5, 2), (1, 9, 11, "name", 0.9, 1), (2, 0, 5, "name", 0.4, 2), (2, 7, 9, "email", 0.3, 1), (2, 10, 12, None, 0.3, 1), (4, 0, 2, "name", 0.7, 1), (4, 3, 5, "name", 0.4, 1)]
    # texts and tokens aren't shuffled
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_payload_of_one_document(spark, tmp_path):
    import json

    from veilspark.streaming.gate_stream import payload

    (tmp_path / "d.txt").write_text(PAY)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    for kw in ({"text": PAY}, {"path": str(tmp_path / "d.txt")}):
        p = one(payload(io.read_document(spark, **kw))).payload
        x = json.loads(p)
        assert list(x) == ["characters", "identifiers_found", "spans", "redacted", "vault_size", "calibrated", "decision"] and x["characters"] == len(PAY) and not x["calibrated"]
        assert "GB33BUKB20201555555555" not in x["redacted"] and x["decision"]["route"] in ("hosted_model", "local_model") and x["vault_size"] >= 1
    for kw in ({}, {"text": "a", "path": "b"}, {"path": str(tmp_path / "none.txt")}, {"path": str(tmp_path / "bad.txt")}):
        with pytest.raises(ValueError):
            io.read_document(spark, **kw)


def test_drift_and_ranked_statistics(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 3.0)], "m string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 3.5), ("w", 0.0)], "m string, v double")
    got = {r.m: (r.delta, r.same) for r in evaluate.drift(a, b, "m", "v").collect()}
    assert got == {"x": (0.0, True), "y": (None, True), "z": (0.5, False), "w": (None, False)}
    assert {r.m: r.same for r in evaluate.drift(a, b, "m", "v", 0.5).collect()}["z"]
    rows = spark.createDataFrame([(i, -i, i % 2, i >= 40) for i in range(50)], "a int, b int, c int, leaked boolean")
    best = evaluate.best_statistic(rows, ("a", "b", "c"), "leaked").orderBy("place").collect()
    assert [r.statistic for r in best[:2]] == ["a", "b (negated)"] and best[0].auc == 1.0 and len(best) == 6


def test_luhn_length_bound(spark):
    got = spark.createDataFrame([("0",), ("4111111111111111",), ("4111111111111112",)], "s string").select(X.luhn_ok("s")).collect()
    assert [r[0] for r in got] == [False, True, False]


def _folds(spark, data, expr):
    df = spark.createDataFrame([(i, [(a, b, label, s) for a, b, label, s in x]) for i, x in enumerate(data)], f"i int, spans {SPANS}")
    return [[tuple(s) for s in r[1]] for r in df.select("i", expr).orderBy("i").collect()]


def test_span_folds_against_loops(spark):
    rng = random.Random(1)
    data = [[(a := rng.randint(0, 30), a + rng.randint(0, 8), rng.choice(["name", "email", "iban", "company"]), round(rng.random(), 2)) for _ in range(rng.randint(0, 9))] for _ in range(120)]

    def drop(x, longest):
        out, last = [], -1
        for s in sorted((s for s in x if s[1] > s[0]), key=lambda s: (s[0], -s[1] if longest else s[1])):
            if s[0] >= last:
                out.append(s)
                last = s[1]
        return out

    for longest in (False, True):
        assert _folds(spark, data, spans.drop_overlaps("spans", longest)) == [drop(x, longest) for x in data]

    def mask(x):
        return {c for a, b, *_ in x if b > a for c in range(a, b)}

    for x, m in zip(data, _folds(spark, data, spans.merged_intervals("spans"))):
        assert {c for a, b in m for c in range(a, b)} == mask(x) and all(p[1] < q[0] for p, q in itertools.pairwise(m))

    def union(x, first):
        out = []
        for a, b, label, s in sorted((s for s in x if s[1] > s[0]), key=lambda s: (s[0], -s[1])):
            if out and a < out[-1][1]:
                A, B, L, S = out[-1]
                takes = (label in first and L not in first) or ((label in first) == (L in first) and b - a > B - A)
                out[-1] = (A, max(B, b), label if takes else L, max(S, s))
            else:
                out.append((a, b, label, s))
        return out

    assert _folds(spark, data, spans.merge_union("spans", ("email",))) == [union(x, {"email"}) for x in data]


def test_measures_of_a_document_are_those_of_its_rows(spark):
    rng = random.Random(12)
    labels = ["name", "email", "company", "iban", None]
    span = lambda: (a := rng.randint(-1, 40), a + rng.randint(-1, 9), rng.choice(labels))
    rows = [(i, [None if rng.random() < 0.05 else span() for _ in range(rng.randint(0, 9))], [(*span(), 1.0) for _ in range(rng.randint(0, 9))]) for i in range(150)]
    df = spark.createDataFrame(rows, f"doc_id long, gold array<struct<start_pos:int,end_pos:int,label:string>>, pred {SPANS}")
    g = evaluate.gold_rows(df).groupBy("doc_id").agg(
        F.count("*").alias("gold"), F.count_if("caught").alias("caught"), F.count_if(~F.col("caught") & (F.col("masked") > 0)).alias("partly"),
        F.count_if(F.col("caught") & (F.col("found_label") == F.col("label"))).alias("typed"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("gold_chars"), F.sum("masked").alias("masked_chars"),
    )
    over = evaluate.over_redaction(df).groupBy("doc_id").agg(F.count("*").alias("over"))
    cols = ["gold", "caught", "partly", "typed", "gold_chars", "masked_chars", "over"]
    want = {r.doc_id: tuple(r[c] for c in cols) for r in df.select("doc_id").join(g, "doc_id", "left").join(over, "doc_id", "left").na.fill(0).collect()}
    got = {r.doc_id: tuple(r[c] for c in cols) for r in evaluate.per_document(df).collect()}
    assert got == want and all(r.leaked == r.gold - r.caught for r in evaluate.per_document(df).collect())


def test_scorecard(spark):
    kind = "array<struct<start_pos:int,end_pos:int,label:string>>"
    rows = [(0, [(0, 9, "name"), (0, 20, "email"), (30, 35, "company")], [(0, 9, "name", 1.0), (50, 60, "name", 1.0)]), (1, [(0, 9, "name")], [(0, 5, "name", 1.0)]), (2, [(0, 4, "name")], [(0, 4, "company", 1.0)]), (3, [], [])]
    s = one(evaluate.scorecard(spark.createDataFrame(rows, f"doc_id long, gold {kind}, pred {SPANS}")))
    # the longer email goes with the overlap; company isn't an identifying type, so it hides nothing
    assert (s.gold, s.caught, s.leaked, s.partly, s.over, s.docs_with_leak, s.docs) == (3, 1, 2, 1, 1, 2, 4) and s.recall == 0.3333
    empty = one(evaluate.scorecard(spark.createDataFrame([], f"doc_id long, gold {kind}, pred {SPANS}")))
    assert empty.docs == 0 and empty.recall is None


@pytest.mark.parametrize("labels, want", [([0, 0, 1, 1], 1.0), ([1, 1, 0, 0], 0.0), ([0, 0, 0, 0], None)])
def test_auc(spark, labels, want):
    df = spark.createDataFrame([(float(i), bool(y)) for i, y in enumerate(labels)], "s double, y boolean")
    assert one(stats.auc(df, "s", "y")).auc == want


def test_auc_against_pairs(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert one(stats.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y")).auc == pytest.approx(want)


def test_coverage_and_exposure(spark):
    df = spark.createDataFrame([(i, float(i), i in (3, 7)) for i in range(10)], "i long, s double, y boolean")
    assert {r.budget: r.k for r in stats.max_coverage(df, "s", "y", "i", [1, 0, 99]).collect()} == {1: 7, 0: 3, 99: 10}
    df = spark.createDataFrame([(0, 0.0, False), (1, 0.1, False), (2, 0.2, False), (3, 0.9, True), (4, 1.0, True)], "i long, s double, y boolean")
    assert {r.k: r.leak_rate for r in stats.at_coverage(df, "s", "y", "i", [0.6, 1.0]).collect()} == {3: 0.0, 5: 0.4}


def test_one_common_score_is_cut_by_ties(spark):
    df = spark.createDataFrame([(i, 0.5 if i % 10 else float(i)) for i in range(900)] + [(1000, None)], "i long, s double")
    cut = stats.in_ranges(df, "s", "i")
    assert cut.where("s = 0.5").select("range").distinct().count() == 1 and cut.groupBy("range", "part").count().agg({"count": "max"}).collect()[0][0] < 60
    got = [r.i for r in stats.ordered_position(df, "s", ["i"]).orderBy("position").collect()]
    assert got == [1000, *(i for _, i in sorted((0.5 if i % 10 else float(i), i) for i in range(900)))]


def test_auc_over_many_ranges(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.random(), rng.random() < 0.4) for _ in range(700)], "s double, y boolean")
    assert one(stats.auc(df, "s", "y", rows=3)).auc == pytest.approx(one(stats.auc(df, "s", "y")).auc)
    # scores are ordered within their ranges
    plan = stats.auc(df, "s", "y")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range" in plan


def test_ordered_position_is_a_permutation(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 97)) for i in range(300)], "i long, s double")
    got = [(r.s, r.i) for r in stats.ordered_position(df, "s", ["i"]).orderBy("position").collect()]
    assert got == sorted((float(i * 7919 % 97), i) for i in range(300))


@pytest.mark.parametrize("k, n", [(0, 10), (1, 10), (3, 17), (5, 10), (37, 78), (198, 3449)])
def test_wilson_solves_its_equation(spark, k, n):
    lo, hi = one(spark.createDataFrame([(k, n)], "k long, n long").select(*(c.alias(a) for c, a in zip(stats.wilson(F.col("k"), F.col("n")), "lh"))))
    for p in (lo, hi):
        assert (k / n - p) ** 2 == pytest.approx(stats.Z_TWO_SIDED**2 * p * (1 - p) / n, abs=1e-12)
    assert one(spark.createDataFrame([(0, 0)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n"))[0].alias("l"), stats.wilson_upper(F.col("k"), F.col("n")).alias("u"))) == (None, 1.0)


def test_fisher_and_holm(spark):
    df = spark.createDataFrame([("a", 3, 1, 1, 3), ("b", 0, 0, 10, 10), ("c", 25, 0, 0, 25)], "t string, a long, b long, c long, d long")
    got = {r.t: r.p_fisher for r in stats.fisher_two_sided(df, "a", "b", "c", "d").collect()}
    assert got["a"] == pytest.approx(0.4857142857) and got["b"] == pytest.approx(1.0) and got["c"] < 1e-12
    ps = spark.createDataFrame(list(dict(a=0.001, b=0.02, c=0.03, d=0.5, e=0.6, f=0.7, g=0.9).items()), "t string, p double")
    h = {r.t: r.p_holm for r in stats.holm(ps, "p", "t").collect()}
    assert h["a"] == pytest.approx(0.007) and h["b"] >= 0.05 and [h[k] for k in "abcdefg"] == sorted(h.values())


def _pooled_by_hand(rows, least):
    """Means pooled pair by pair, the leftmost violation first, until none is left; then blocks filled up to least."""
    blocks = [[x, y, n] for x, y, n in rows]
    while (bad := next((k for k in range(len(blocks) - 1) if blocks[k][1] * blocks[k + 1][2] >= blocks[k + 1][1] * blocks[k][2]), None)) is not None:
        x, y, n = blocks.pop(bad + 1)
        blocks[bad] = [x, blocks[bad][1] + y, blocks[bad][2] + n]
    out = []
    for x, y, n in blocks:
        if out and out[-1][2] < least:
            out[-1] = [x, out[-1][1] + y, out[-1][2] + n]
        else:
            out.append([x, y, n])
    if len(out) > 1 and out[-1][2] < least:
        x, y, n = out.pop()
        out[-1] = [x, out[-1][1] + y, out[-1][2] + n]
    return out


@pytest.mark.parametrize("least", [1, 5, 25, 1000])
def test_blocks_are_those_of_pooling_by_hand(least):
    rng = random.Random(least)
    for _ in range(60):
        rows = [(float(x), float(rng.randint(0, 2)), 2) for x in range(rng.randint(0, 40))]
        got = calibrate.pool_adjacent(pd.DataFrame(rows, columns=["x", "y", "n"]), least)
        assert [list(r) for r in got.itertuples(index=False)] == _pooled_by_hand(rows, least)


def test_calibration_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 3), rng.random() < 0.3) for _ in range(1500)]
    df = spark.createDataFrame(rows, "x double, y boolean")
    few, many = ([tuple(r) for r in calibrate.fit(df, "x", "y", rows=r).orderBy("block").collect()] for r in (10**6, 5))
    assert few == many


def test_each_risk_finds_its_block(spark):
    blocks = spark.createDataFrame([(0, 1.0, 0.1, 0.2), (1, 1.0, 0.3, 0.4), (2, 5.0, 0.6, 0.7)], "block int, right_edge double, p_hat double, p_upper double")
    df = spark.createDataFrame([(0.5,), (1.0,), (1.1,), (5.0,), (9.0,), (None,)], "x double")
    assert [r.risk for r in calibrate.predict(df, blocks, "x").collect()] == [0.2, 0.2, 0.7, 0.7, 0.7, None]
    assert [r.risk for r in calibrate.predict(df, blocks.where("false"), "x").collect()] == [None] * 6


def test_decision_as_published(spark):
    df = spark.createDataFrame([(0.1,), (3.0,), (None,)], "e double")
    a, b, c = (r.decision for r in calibrate.decisions(df, "e").collect())
    assert (a.forward, a.route, a.risk, a.reason) == (True, "hosted_model", 0.09516, "residual leak risk 0.095 is within the 0.120 budget")
    assert (b.forward, b.route, b.reason) == (False, "local_model", "residual leak risk 0.950 exceeds the 0.120 budget -- answering locally") and c.forward is None and c.reason is None and c.budget == 0.12


def _pava(pairs, least):
    return calibrate.pool_adjacent(pd.DataFrame([(x, float(y), 1) for x, y in sorted(pairs)], columns=["x", "y", "n"]), least)


def test_calibrator_equals_the_plain_fold(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(800)]
    want = _pava([(x, int(y)) for x, y in rows], 25)
    got = calibrate.fit(spark.createDataFrame(rows, "x double, y boolean"), "x", "y").orderBy("block").collect()
    assert [(r.right_edge, r.n, r.leaks) for r in got] == [(r.right_edge, r.n, r.leaks) for r in want.itertuples()]
    assert all(a.p_hat <= b.p_hat and a.p_upper <= b.p_upper for a, b in itertools.pairwise(got))


def test_calibration_is_never_zero_and_clamped(spark):
    df = spark.createDataFrame([(0.01 * i, False) for i in range(400)], "x double, y boolean")
    b = calibrate.fit(df, "x", "y")
    assert all(r.p_hat > 0 and r.p_upper > 0 for r in b.collect())
    p = calibrate.decide(calibrate.predict(spark.createDataFrame([(0.0,), (99.0,), (None,)], "x double"), b, "x")).collect()
    assert p[1].risk is not None and p[2].risk is None and p[2].forward is None and p[2].route is None


def test_budget_below_everything(spark):
    df = spark.createDataFrame([(0.5, True), (0.6, False)], "risk double, leaked boolean")
    r = one(evaluate.risk_coverage(df, "risk", "leaked", [0.1]))
    assert r.forwarded == 0 and r.leak_rate is None and r.budget_respected is None and r.leaks_held == 1


def test_risk_drops_where_spans_hide(spark):
    d = spark.createDataFrame([("Anna Bell", [(0, 9, "name", 1.0)]), ("Anna Bell", []), ("Anna Bell", [(0, 9, "company", 1.0)])], f"text string, pred {SPANS}")
    r = risk.with_survivors(risk.with_survivors(risk.feature_scorer(d), name="a"), redacted_only=True, name="b").select(risk.raw_risk("a").alias("a"), risk.raw_risk("b").alias("b")).collect()
    assert r[0].a == 0 and r[1].a > 0 and r[2].a == 0 and r[2].b > 0


def test_surviving_statistics(spark):
    t = "Meera Subramanian paid 4111 1111 on 2026-01-02 at Acme."
    d = spark.createDataFrame([(0, t, []), (1, t, [(0, len(t), "name", 1.0)])], f"doc_id long, text string, pred {SPANS}")
    a, b = risk.surviving_statistics(d).orderBy("doc_id").collect()
    # words that hold two digits in a row, the date once
    assert a.surviving_words == 9 and a.surviving_capitalised == 3 and a.surviving_digit_runs == 3 and a.spans == 0
    assert (b.surviving_chars, b.surviving_words, b.surviving_digit_runs, b.spans) == (0, 0, 0, 1)


def test_contrasts(spark):
    rows = [("name", f"S{i}", i % 2 == 0) for i in range(40)] + [("email", f"e{i}", False) for i in range(40)] + [("name", "José Ñ", True)]
    g = fairness.with_groups(spark.createDataFrame(rows, "label string, surface string, leaked boolean"), spark.createDataFrame([("s1",), ("S3 ",)], "surface string"))
    t = {r.contrast: r for r in fairness.contrast_table(g).collect()}
    assert len(t) == 7 and t["C1"].an == 41 and t["C1"].p_holm < 1e-4 and t["C3"].bn == 2 and t["C4"].an == 1 and t["C2"].recall_a is None


def test_surface_helpers(spark):
    got = spark.createDataFrame([("Jose",), ("José",), ("O'Brien x",), ("a b  c",), ("",)], "s string").select(X.is_ascii("s"), X.token_bucket("s")).collect()
    assert [tuple(r) for r in got] == [(True, "1"), (False, "1"), (True, "2"), (True, "3+"), (True, "1")]


def test_near_copy_by_lines(spark):
    lines = [f"a long enough line number {i}" for i in range(24)]
    near = [x if i % 6 else "rewritten altogether " + str(i) for i, x in enumerate(lines)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(near)), (3, "\n".join(reversed(lines))), (4, "nothing alike in here"), (5, None), (6, "")], "doc_id long, text string")
    got = {(r.a, r.b): r.jaccard for r in dedupe.line_similarity(df).collect()}
    # 1 and 3 have the same lines: one class
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1] == 1.0 and got[1, 2] == pytest.approx(20 / 28)
    assert dedupe.exact_copies(df).count() == 0


def test_line_similarity_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(f"sentence {rng.randint(0, 30):04d} of them" for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(100 + i, t) for i, t in docs[:20]]
    sets = {i: set(t.split("\n")) - {""} for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    links, members = dedupe.line_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    rep = {r.doc_id: r.rep for r in members.collect()}
    linked = {(r.a, r.b) for r in links.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(rep), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked}
    assert got == want and set(rep) == {i for i in sets if sets[i]}


def test_copies_make_no_pairs(spark):
    same = spark.createDataFrame([(i, "one line of text\nanother line of it") for i in range(300)], "doc_id long, text string")
    assert [tuple(r) for r in dedupe.line_similarity(same).collect()] == [(0, 0, 2, 1.0, 300, 300)]


def _other(folder):
    from hashlib import sha256

    return f"<other-{sha256(folder.encode()).hexdigest()[:6]}>/.../"


@pytest.mark.parametrize(
    "text, want",
    [
        ("open /home/me/work/a.txt and /home/me/work/b.txt", f"open {_other('/home/me/work')}a.txt and {_other('/home/me/work')}b.txt"), ("/srv/a/c, /srv/ab/c", f"<a>/c, {_other('/srv/ab')}c"), ("/srv/a and /srv/a/in/x and /srv/a/in", "<a> and <in>/x and <in>"),
        ("/opt/acme/secret/x.csv, /opt/conda/bin", f"{_other('/opt/acme/secret')}x.csv, /opt/conda/bin"), ("/tmp/x /run/y /var/tmp/z /usr/bin/env /usrx/y", f"/tmp/x /run/y /var/tmp/z /usr/bin/env {_other('/usrx')}y"), ("/usr/share/desk/f", "/usr/share/desk/f"),
        ("3/4, 12/34/5678, https://a.example/b/c, ../x/y, <a>/d/e, /one", "3/4, 12/34/5678, https://a.example/b/c, ../x/y, <a>/d/e, /one"), ("", ""), (None, None),
    ],
)
def test_paths(spark, text, want):
    known = {"/srv/a": "<a>", "/srv/a/in/": "<in>", "/usr/share/desk": "<share>", "/": "<root>"}
    df = spark.createDataFrame([(text,)], "t string")
    r = one(df.select(pathredact.redact_paths("t", known).alias("r"), pathredact.leaks("t", known).alias("l")))
    assert r.r == want and (len(r.l) > 0) == (text != want)
    once = spark.createDataFrame([(r.r,)], "t string")
    assert one(once.select(pathredact.redact_paths("t", known).alias("r"))).r == want and pathredact.leaking_paths(once, "t", known).count() == 0


def test_surveyed_head_and_tail(spark, tmp_path):
    from veilspark.plans import queries as Q

    spark.range(4500).selectExpr("id as doc_id", "if(id % 2 = 0, 'train', 'test') as split", "'a' as source", "'b' as doc_type").write.parquet(str(tmp_path / "documents.parquet"))
    tail, head = ([r.doc_id for r in Q.queries()[n](spark, str(tmp_path)).collect()] for n in ("tail_split_dev", "head_slice"))
    assert sorted(tail) == list(range(500, 4500, 2)) and sorted(head) == list(range(800))


def test_sources_and_guarded_sink(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.jsonl").write_text('{"text": "hé", "spans": [{"start_pos": 0, "end_pos": 2, "label": "name"}]}\n')
    df = io.read_jsonl(spark, str(tmp_path / "c"))
    assert one(df).doc_type == "" and one(df).spans[0].label == "name"
    m = io.write_jsonl(df, str(tmp_path / "out")).collect()
    assert [(x.rows, x.is_input) for x in m] == [(1, False)] and len(m[0].sha256) == 64
    both = io.write_jsonl(df.union(df), str(tmp_path / "out2"), [str(tmp_path / "c")]).collect()
    assert sum(x.rows or 0 for x in both) == 2 and [x.sha256 for x in both if x.is_input] == [x.sha256 for x in io.inventory(spark, str(tmp_path / "c")).collect()]
    leaks = lambda d: d.where("text like 'h%'")
    with pytest.raises(PermissionError):
        io.write_guarded(df, str(tmp_path / "no"), leaks)
    assert not (tmp_path / "no").exists()
    io.write_guarded(df.where("false"), str(tmp_path / "yes"), leaks)
    with pytest.raises(Exception):
        io.write_guarded(df.where("false"), str(tmp_path / "yes"), leaks)
    (tmp_path / "t/.git").mkdir(parents=True)
    (tmp_path / "t/old").mkdir()
    for n, b in (("a.py", b"x = 1"), ("b.md", b"\xff\xfe"), ("old/c.py", b"y"), (".git/d.py", b"z"), ("e.bin", b"\x00")):
        (tmp_path / "t" / n).write_bytes(b)
    assert {r.path.rsplit("/", 1)[1] for r in io.read_files(spark, str(tmp_path / "t"), excluded=["old"]).collect()} == {"a.py", "b.md"}
    assert [r.path.rsplit("/", 1)[1] for r in io.unreadable(spark, str(tmp_path / "t")).collect()] == ["b.md"]
    assert io.inventory(spark, str(tmp_path / "c")).count() == 1 and io.head(spark.range(9), "id", 2).count() == 2


def test_stream_equals_batch(spark, data, tmp_path):
    from veilspark.streaming import gate_stream

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    got = []
    q = gate_stream.run(spark, str(tmp_path / "in"), "doc_id long, text string", lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = gate_stream.gate(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_tokens_windows_and_labels(spark):
    from veilspark.operators import tokens

    d = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(20))), (1, "Anna Bell pays"), (2, ""), (3, None)], "doc_id long, text string")
    t = tokens.tokenize(d)
    w = tokens.windows(t, 8, 3).where("doc_id = 0").groupBy("window").agg(F.min("token").alias("a"), F.max("token").alias("b")).orderBy("window").collect()
    assert [(r.a, r.b) for r in w] == [(0, 7), (5, 12), (10, 17), (15, 19)]
    gold = spark.createDataFrame([(1, [(0, 9, "name"), (5, 14, "email")])], "doc_id long, spans array<struct<start_pos:int,end_pos:int,label:string>>")
    got = tokens.bio_labels(t, gold).where("doc_id = 1").orderBy("token").collect()
    assert [r.label for r in got] == ["B-name", "I-name", "I-email"] and got[0].label_id == BIO_LABELS.index("B-name")


def test_routing(spark):
    from veilspark.operators import route

    d = spark.createDataFrame([(0, "Anna", "[NAME_1]", True), (1, "Bob", "[NAME_1]", False), (2, "Cy", "[NAME_1]", None)], "doc_id long, text string, redacted string, forward boolean")
    echo = lambda kind: lambda prompts: [f"{kind}: {p.split(chr(10))[-1]}" for p in prompts]
    got = {r.doc_id: (r.route, r.answer) for r in route.answer(d, "Who?", echo("l"), echo("h")).collect()}
    assert got == {0: ("hosted", "h: [NAME_1]"), 1: ("local", "l: Bob"), 2: ("local", "l: Cy")}
    assert {r.route for r in route.answer(d, "Who?", echo("l")).collect()} == {"local"}
    v = spark.createDataFrame([(0, "[NAME_1]", "Anna")], "doc_id long, ph string, surface string")
    r = {x.doc_id: x for x in route.restored(route.answer(d, "Who?", echo("l"), echo("h")).where("doc_id = 0"), v).collect()}
    assert r[0].answer == "h: Anna" and r[0].trustworthy


def test_calibration_is_bound_to_its_threshold(spark, tmp_path):
    df = spark.createDataFrame([(0.01 * i, i % 7 == 0) for i in range(100)], "x double, y boolean")
    b = calibrate.fit(df, "x", "y")
    calibrate.save(b, str(tmp_path / "c"), 0.2, "test")
    assert calibrate.load(spark, str(tmp_path / "c"), 0.2).count() == b.count()
    with pytest.raises(ValueError):
        calibrate.load(spark, str(tmp_path / "c"), 0.5)


def test_instrument_check(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, 0.5)], "k string, n long, r double")
    evaluate.instrument_check(a, a, "k")
    with pytest.raises(ValueError):
        evaluate.instrument_check(a, a.where("k = 'x'"), "k")


def test_llm_is_not_imported_by_the_rest():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "veilspark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and ".llm" in p.read_text()]
