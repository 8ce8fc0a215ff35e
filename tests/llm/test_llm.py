"""Brute-force versions, round trips and edge cases of the training-data operators."""

import itertools
import os
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import answers, cross_split, language, near_duplicates, normalize, packing, personal, sentences, splitting, tokenize
from veilspark.llm import queries as Q
from veilspark.llm.common import code_points, to_strings
from veilspark.llm.shingles import jaccard, normal_form, shingle_set

DOCS = "doc_id long, text string, spans array<struct<start_pos:int,end_pos:int,label:string>>, doc_type string, split string, lang string, source string, n_chars long"


def docs(spark, texts, split="train", lang="en", spans=None):
    rows = [(i, t, spans, "Email", split, lang, "desk-1", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumn("a", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("token", F.lit("x"))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def edited(rng, text, share):
    out = []
    for w in text.split(" "):
        x = rng.random()
        if x < share / 3:
            continue
        out.append(words(rng, 1) if x < share * 2 / 3 else w)
        if x > 1 - share / 3:
            out.append(words(rng, 1))
    return " ".join(out)


def pairs_by_brute_force(texts, limit=0.6, least=200):
    sets = {i: shingle_set(normal_form(t)) for i, t in enumerate(texts) if t is not None and len(t) >= least}
    return {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= limit}


def corpus(rng, n=24):
    out = [None, "", "   ", "short", "x" * 250, " " * 300]
    for _ in range(n):
        t = words(rng, rng.randint(40, 160))
        out += [t, t, t.upper().replace(" ", "\n  "), *(edited(rng, t, s) for s in (0.03, 0.06, 0.1, 0.4))]
        w = t.split(" ")
        out.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2]))
    return out


def test_p1_against_brute_force(spark):
    texts = corpus(random.Random(1))
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs(spark, texts)).collect()}
    assert got == pairs_by_brute_force(texts)


def test_p1_hot_tokens_take_the_second_level(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    rng = random.Random(2)
    boiler = words(rng, 60)
    texts = [f"{boiler} {words(rng, 60)}" for _ in range(30)]
    texts += [edited(rng, t, 0.04) for t in texts[:10]]
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs(spark, texts)).collect()}
    assert got == pairs_by_brute_force(texts) and got


def test_p1_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 8)
    rng = random.Random(8)
    base = words(rng, 90)
    texts = [edited(rng, base, 0.03) for _ in range(40)] + [words(rng, 90) for _ in range(20)] + [base] * 3
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs(spark, texts)).collect()}
    assert got == pairs_by_brute_force(texts) and len(got) > 500


def test_p1_exact_scheme_loses_nothing(spark, monkeypatch):
    # short lines in another order: hardly a shingle of 32 is shared, three of five of those of 12 are
    monkeypatch.setattr(near_duplicates, "HOT", 4)
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        lines = [words(rng, 9)[:47].strip() for _ in range(8)]
        texts += ["\n".join(lines), "\n".join(rng.sample(lines, 8)), "\n".join(rng.sample(lines, 7))]
    texts += corpus(rng, 4)
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs(spark, texts), scheme=near_duplicates.exact(0.6)).collect()}
    assert got == pairs_by_brute_force(texts) and len(got) > 30


def reordered(rng, n):
    """Lists of short items and short lines in another order, and texts of few shingles over and over."""
    texts = []
    for _ in range(n):
        lines = [words(rng, 9)[:44].strip() for _ in range(rng.randint(6, 12))]
        items = [f"Item name: {words(rng, 3)[:10].strip()}" for _ in range(rng.randint(12, 40))]
        texts += ["\n".join(x) for y in (lines, items) for x in (y, rng.sample(y, len(y)), rng.sample(y, len(y)), rng.sample(y, len(y) * 4 // 5))]
    for _ in range(n):
        w = words(rng, 4)[: rng.randint(8, 24)]
        texts += [(w + "-") * 20, (w + "-") * 21 + words(rng, 1), (w + "-") * 19 + words(rng, 2)]
    return texts


def test_p1_short_lines_in_another_order_and_small_sets(spark):
    # most shingles of 12 are shared, hardly one of 32; sets of few shingles leave bins empty
    texts = reordered(random.Random(21), 40)
    want = pairs_by_brute_force(texts)
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs(spark, texts)).collect()}
    assert got == want and len(want) > 200


def test_p1_bands_by_the_threshold():
    for t in (0.4, 0.6, 0.8):
        b = near_duplicates.bands_for(t)
        p = t**4
        assert b % 4 == 0 and (1 - p) ** b + b * p * (1 - p) ** (b - 1) <= 1e-9
    with pytest.raises(ValueError):
        near_duplicates.bands_for(0.0)


def test_p1_sets_of_every_size_agree_in_enough_bands():
    # pairs at the threshold on both sides of the border between the kinds of minwise values
    from veilspark.llm.shingles import band_hashes, binned_values, small_values

    rng = np.random.default_rng(3)
    for n, make in ((10, small_values), (60, small_values), (190, small_values), (130, binned_values), (700, binned_values)):
        agree = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, n * 5, dtype=np.uint64)
            a, b = np.sort(u[: 4 * n]), np.sort(u[n:])
            agree.append(int((band_hashes(make(a, 704)) == band_hashes(make(b, 704))).sum()))
        # 22.8 of 176 on average
        assert 20 < np.mean(agree) < 26 and min(agree) >= 2


@pytest.mark.parametrize("hot", [2, 16, 1000])
def test_p1_levels_meet_each_other(spark, monkeypatch, hot):
    # sets drawn from few tokens: every level is taken by some document, and pairs between levels must be met
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    rng = random.Random(hot)
    rows = []
    for i in range(150):
        common = rng.sample(range(40), rng.randint(0, 12))
        own = rng.sample(range(40, 4000 if i % 3 else 70), rng.randint(4, 14))
        rows.append((i, [2 * t for t in {*common, *own}]))
    reps = spark.createDataFrame([(i, len(t), 0, 0, 0, sorted(t)) for i, t in rows], "doc_id long, n12 int, s1 long, s2 long, s3 long, tokens array<long>")
    scheme = near_duplicates.Scheme(((12, 0, 1 << 40),), None, 0.3, False)
    got = {(r.a, r.b) for r in near_duplicates._candidates(reps, 0.0, scheme).collect()}
    need = {i: max(1, -(-3 * len(t) // 10)) for i, t in rows}
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) >= max(need[i], need[j])}
    assert want <= got and want
    levels = {r.level for r in near_duplicates._leveled(reps, scheme).select("level").distinct().collect()}
    assert levels >= {2: {1, 2}, 16: {1, 3}, 1000: {1}}[hot]


def test_p1_groups(spark):
    texts = corpus(random.Random(3), 6)
    got = {r.doc_id: r for r in near_duplicates.near_duplicate_groups(docs(spark, texts)).collect()}
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_by_brute_force(texts):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in got}


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.connected(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_p1_empty(spark):
    assert near_duplicates.near_duplicate_pairs(docs(spark, ["a"]).where("false")).count() == 0
    assert near_duplicates.near_duplicate_groups(docs(spark, ["a"]).where("false")).count() == 0


def test_p4_masks_spans_and_crosses_splits_only(spark):
    rng = random.Random(4)
    t = words(rng, 60)
    a, b = f"Anna {t} Anna", f"Bertil {t} Bertil"
    rows = [
        (1, a, [(0, 4, "name"), (len(a) - 4, len(a), "name"), (2, 3, "x"), (5, 5, "x"), (9, 9999, "x"), None], "train"), (2, b, [(0, 6, "name"), (len(b) - 6, len(b), "name")], "dev"), (3, b, None, "train"), (4, a, None, None), (5, None, None, "test"),
        (6, words(rng, 60), None, "test"), (7, "short", None, "dev"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start_pos:int,end_pos:int,label:string>>, split string").withColumn("source", F.lit(None).cast("string"))
    assert cross_split.masked(a, [{"start_pos": 0, "end_pos": 4, "label": "name"}, {"start_pos": 2, "end_pos": 6, "label": "x"}]).startswith("[name] ")
    assert {(r.train_id, r.eval_id) for r in cross_split.cross_split_pairs(df).collect()} == {(1, 2), (3, 2)}
    rep = {(r.split, r.source): (r.documents, r.overlapping, r.pairs) for r in cross_split.cross_split_report(df).collect()}
    assert rep == {("dev", None): (1, 1, 2), ("test", None): (1, 0, 0)}
    assert cross_split.cross_split_pairs(df.where("false")).count() == 0


def test_p4_against_brute_force(spark):
    texts = corpus(random.Random(5))
    side = {i: ("train", "dev", "test", "train")[i % 4] for i in range(len(texts))}
    df = docs(spark, texts).withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "dev", "test", "train"))), (F.col("doc_id") % 4 + 1).cast("int")))
    want = {p for p in pairs_by_brute_force(texts) if (side[p[0]] == "train") != (side[p[1]] == "train")}
    assert {tuple(sorted((r.train_id, r.eval_id))) for r in cross_split.cross_split_pairs(df).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from("ȩ̣́́각ﬁ가ো​̈́ΩÅ"), max_size=12), max_size=8))
def test_p2_composition_is_unicodes(texts):
    got = to_strings(*normalize.nfkc(*code_points(pa.array(texts, pa.string())))).to_pylist()
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_p2_forms(spark):
    rows = [("plain text", "plain text", False), ("ｗｉｄｅ", "wide", True), ("café", "café", True), ("a​b", "ab", True), ("раypal", "paypal", True), ("слово и word", "слово и word", False), ("“q” – 5 € 🙂", "“q” – 5 € 🙂", False),
            ("👩‍💻", "👩‍💻", False), ("x\xa0y", "x y", True), (None, None, False), ("", "", False), ("Пpивeт", "Привет", True)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "row_id long, text string")
    got = normalize.normalise(df, "row_id").orderBy("row_id").collect()
    assert [(r.text, r.found) for r in got] == [r[1:] for r in rows]
    assert {r.row_id for r in normalize.found_rows(df, "row_id").collect()} == {i for i, r in enumerate(rows) if r[2]}


def test_p2_is_idempotent():
    texts = ["Ｔеst раgе", "é​̂", "ﬁнал", "각"]
    once = normalize.canonical(*code_points(pa.array(texts)))
    twice = normalize.canonical(*once)
    assert to_strings(*once).equals(to_strings(*twice))


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("Why?", None, "empty"), ("Why?", " ​", "empty"), ("Why?", "N/A", "empty"), ("Why?", "```\n```", "empty"), ("What is still open on case 12?", "**WHAT IS STILL OPEN ON CASE 12?**", "copy"),
        ("What is still open on case 12?", "I’m sorry, but I can’t help with that request. Is there anything else you need?", "refusal"), ("What is still open?", "The bank can't refund the loan until Monday.", None),
        ("What is still open?", "The agent must decline the loan because it was released.", None), ("请概括。", "我不能回答这个问题。", "refusal"), ("Was ist offen?", "Dazu kann ich keine Auskunft geben.", "refusal"),
        ("What is still open?", "The branch rejected the repayment holiday in two separat", "truncated"), ("What is still open?", "The branch called (on Monday", "truncated"), ("What is still open?", 'He said "we never', "truncated"),
        ("What is still open?", "It is done. 🙂", None), ("What is still open?", "It is done.\n\n--", None), ("What is still open?", "It is done. (ref. [CUSTOMER_ID_1])", None), ("What is still open?", "Open points:\n- the annual statement\n- the revised quote", None),
        ("What is still open?", "Open points:\n- the annual statement\n- the revised", "truncated"), ("What is still open?", "Open points:", "truncated"), (None, "It is done.", None), ("What is still open?", "It shows EUR 5, approx.", "truncated"),
    ],
)
def test_p3_defects(question, answer, defect):
    common, broken = {"the annual statement": 9, "the revised quote": 9, "the revised": 1}, {"the revised"}
    if answers.is_empty(answer):
        got = "empty"
    elif answers.is_copy(question, answer):
        got = "copy"
    elif answers.is_refusal(answer):
        got = "refusal"
    else:
        got = "truncated" if answers.is_truncated(answer, common, broken) else None
    assert got == defect


def test_p3_refusal_of_any_length():
    t = "I can't help with that request." + " Please contact the branch on the market square, or write to the desk that keeps your account." * 6
    assert len(t) > 400 and answers.is_refusal(t) and not answers.is_refusal(t + " The loan was paid back in full on Monday.")


@pytest.mark.parametrize(
    "answer, refused",
    [
        ("That is something I'm going to have to pass on.", True), ("I would prefer to leave this one unanswered.", True), ("Sorry, it is not something I can comment on.", True), ("This can't be answered by me.", True), ("The rules stop me from discussing the document.", True),
        ("Das ist mir leider nicht gestattet.", True), ("Je me vois contraint de m'abstenir.", True), ("Me niego a responder.", True), ("お答えしかねます。", True), ("我拒绝回答。", True),
        ("The agent must decline the loan.", False), ("The desk will pass on the request.", False), ("I'm sorry to hear about the loan; the bank can't refund it.", False), ("The policy doesn't let the branch share the file.", False), ("It cannot be told from the note who approved it.", False),
    ],
)
def test_p3_refusals_by_structure(answer, refused):
    assert answers.is_refusal(answer) == refused


def test_p3_scripts():
    assert answers.script("Что открыто по делу AB-12?") != answers.script("What is still open?") != 0 and answers.script("12 €") == 0 and answers.script("漢字 kanji") == 0
    assert answers.script("差出人の要望は何ですか") == answers.script("长期转账指令")


def test_p3_item_broken_inside_a_word(spark):
    # two answers have the whole item, one its beginning; a beginning at a word's end needs more of them
    got = _answers(spark, ["Open:\n- het leencontract", "Also open:\n- het leencontract", "Open:\n- het leencontra", "Open:\n- het", "Open:\n- 长期转账指令", "Still:\n- 长期转账指令", "Open:\n- 长期转账"])
    assert got == {i: "truncated" if i == 2 else None for i in range(7)}


def test_p3_pairs_of_both_tables(spark):
    runs = spark.createDataFrame([(1, "Q1?", "late", "2024-01-02"), (1, "Q1?", "early", "2024-01-01"), (None, "Q?", "x", None), (2, None, None, None)], "demo_id long, question string, answer_as_returned string, generated_at string")
    tries = spark.createDataFrame([(5, 1, "a", "2024-01-01"), (5, 1, "a", "2024-01-03"), (6, 99, None, None)], "answer_id long, demo_id long, text string, arrived_at string")
    got = {(r.table_name, r.row_id): (r.question, r.answer) for r in answers.pairs_of(runs, tries).collect()}
    assert got == {("demo_run", 1): ("Q1?", "early"), ("demo_run", 2): (None, None), ("answer", 5): ("Q1?", "a"), ("answer", 6): (None, None)}


def _answers(spark, answers_, more=None):
    """Defects of answers by row; more: answers beside them."""
    df = spark.createDataFrame([(i, None, a) for i, a in enumerate(answers_)], "row_id long, question string, answer string")
    found = answers.find_defects(df if more is None else df.unionByName(more), np.zeros((language.SLOTS, len(language.CODES)), np.float32))
    return {r.row_id: r.defect for r in found.where(f"row_id < {len(answers_)}").collect()}


def test_p3_broken_item_among_many_items(spark):
    # over 500,000 different items, each met once
    # different answers count once each
    more = spark.range(1000, 6000).selectExpr("id as row_id", "cast(null as string) as question", "array_join(transform(sequence(1, 101), k -> concat('- free text ', id, ' of ', k)), '\n') as answer")
    got = _answers(spark, [f"Open {i}:\n- the annual statement" for i in range(9)] + ["Open:\n- the annual state", "Open:\n- a free text"], more)
    assert got == {i: "truncated" if i == 9 else None for i in range(11)}


def test_p3_broken_item_before_many_of_the_same_beginning(spark):
    rare = [f"Points :\n- le directeur note que {i}" for i in range(100)]
    got = _answers(spark, [*rare, *(f"Points {i} :\n- le découvert autorisé" for i in range(9)), "Points :\n- le d"])
    assert [i for i, d in got.items() if d] == [109] and got[109] == "truncated"


def test_p3_tiles():
    assert answers.tiles(list("abcdefgh"), list("xxabcdyyefgh"), 3) == (8, 8) and answers.tiles(list("abc"), list("cab"), 3) == (0, 0)


def test_p5_items(spark):
    t = "Dear Ms. Quillane, write to ivy.quillane [at] desk (dot) example or call +44 7700 900 123. SSN on file: 737-65-5959. Ivy Quillane lives at Flat 3, 12 Old Toll Road, Port Hallow 00978. TCK 555-0173-70."
    a = personal.build_automaton({"Ivy"}, {"Quillane"})
    got = {(k, t[x:y]) for x, y, k in personal.find(t, a)}
    assert got == {("name", "Quillane"), ("email", "ivy.quillane [at] desk (dot) example"), ("phone", "+44 7700 900 123"), ("identity_number", "737-65-5959"), ("name", "Ivy Quillane"), ("street_address", "Flat 3, 12 Old Toll Road, Port Hallow 00978")}
    df = docs(spark, [t, None, "", "Iv​y Quillane"])
    r = personal.redact(df, "sixteen letters!", ({"Ivy"}, {"Quillane"})).orderBy("doc_id").collect()
    assert [[(i.start_pos, i.end_pos, i.kind) for i in x["items"]] for x in r] == [[tuple(i) for i in x["items"]] for x in personal.detect(df, ({"Ivy"}, {"Quillane"})).orderBy("doc_id").collect()]
    assert r[1].redacted is None and r[2].redacted == "" and [(i.start_pos, i.end_pos) for i in r[3].items] == [(0, 13)]
    assert "Quillane" not in r[0].redacted and r[0].redacted.endswith("TCK 555-0173-70.") and "[EMAIL " in r[0].redacted
    g, f = personal.fit_names(df.where("false"))
    assert not g and not f


def test_p5_impossible_numbers_are_none():
    a = personal.build_automaton(set(), set())
    got = [t for t in ("000-12-3456", "666-12-3456", "737-00-5959", "737-65-0000", "737-65-5959", "666 12 3456") if personal.find(f"SSN: {t}.", a)]
    assert got == ["737-65-5959"]


@pytest.mark.parametrize("value", ["00000000T", "23076178-J", "X-1234567-L", "86 095 742 719", "111222333", "11010519491231002X", "2345 6789 0124", "112-233-445 95", "RSSMRA85T10A562S", "737-65-5959", "1 62 05 99 659 328 87", "A-123-4567"])
def test_p5_pseudonyms_keep_the_check(value):
    check = personal.check_of(value)
    got = personal.pseudonym(value, b"k")
    assert got != value and personal.check_of(got) == check and [c.isalnum() for c in got] == [c.isalnum() for c in value]
    assert value in ("23076178-J", "1 62 05 99 659 328 87", "A-123-4567") or check != -1


def test_p5_pseudonyms_with_checks_are_a_permutation():
    from veilspark.llm.personal import CHECKS, pseudonym

    values = {f"{n:08d}{'TRWAGMYFPDXBNJZSQVHLCKE'[(n + (n % 3 == 0)) % 23]}" for n in range(300)}
    got = {pseudonym(v, b"k") for v in values}
    assert len(got) == len(values) and len(CHECKS) == 10
    assert sum(personal.check_of(v) == 0 for v in got) == sum(personal.check_of(v) == 0 for v in values) == 200


def test_p5_dates_are_permuted_in_their_notation(spark):
    t = "Born 07/04/1948, seen 1948-04-07 [2.3.2020], not 99.99.2020, 12/2020, 1.2.3.2020 or 1.1.1700. SSN: 737-65-5959."
    assert [t[a:b] for a, b in personal.dates(t)] == ["07/04/1948", "1948-04-07", "2.3.2020", "99.99.2020", "1.1.1700"]
    x = personal.written_pseudonym("07/04/1948", b"k")
    y = personal.written_pseudonym("1948-04-07", b"k")
    assert x.split("/") == y.split("-")[::-1] and x != "07/04/1948" and personal.written_pseudonym("1.1.1700", b"k") is None and personal.written_pseudonym("99.99.2020", b"k") is None
    r = personal.redact(docs(spark, [t]), "sixteen letters!", (set(), set())).collect()[0]
    assert len(r["items"]) == 1 and r.redacted.count("[DATE ") == 3 and "1948" not in r.redacted and "99.99.2020, 12/2020, 1.2.3.2020 or 1.1.1700" in r.redacted


def test_p5_equal_values_are_linked(spark):
    df = docs(spark, ["Write to ivy@desk.example or 737-65-5959.", "From IVY@desk.example: ivy@desk.example", "737-65-5959 and 737-65-5950"])
    key = "sixteen letters!"
    got = {(r.kind, r.occurrences, r.documents) for r in personal.links(personal.redact(df, key, (set(), set()))).collect()}
    assert got == {("email", 3, 2), ("identity_number", 2, 2)}
    with pytest.raises(ValueError):
        personal.redact(df, "short", (set(), set()))


def test_p5_names_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(personal, "FIT_DOCS", 10, raising=False)
    texts = [f"{'Ivy Quillane' if i % 13 == 0 else 'No one'} called; 王{'小明芳'[i % 3]} and {'李张'[i % 2]}{'小明芳'[i % 3]} too." for i in range(40)]
    ann = [[(0, 12, "name"), (21, 23, "name"), (28, 30, "name")] if i % 13 == 0 else [(15, 17, "name"), (22, 24, "name")] for i in range(40)]
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(texts, ann))], "doc_id long, text string, spans array<struct<start_pos int, end_pos int, label string>>")
    g, f = personal.fit_names(df)
    assert "Ivy" in g and "Quillane" in f and {"王", "李", "张"} <= f and {"小", "明", "芳"} <= g


def test_p5_pseudonyms_are_a_permutation_within_the_format():
    import datetime as dt

    key = b"k"
    got = {personal.pseudonym(f"A-{i:02d}", key) for i in range(100)}
    assert len(got) == 100 and all(len(g) == 4 and g[0].isupper() and g[1] == "-" for g in got)
    assert personal.pseudonym("+44 7700", key) == personal.pseudonym("+44 7700", key) != personal.pseudonym("+44 7700", b"other")
    assert sorted(personal.feistel(i, 37, key, "t") for i in range(37)) == list(range(37))
    days = {personal.pseudonym_date(dt.date(2020, 1, 1) + dt.timedelta(i), key) for i in range(366)}
    assert len(days) == 366


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\n!", min_size=0, max_size=300), st.integers(1, 60), st.integers(-3, 70))
def test_p6_pieces(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    if len(text) <= limit:
        assert got == []
        return
    share = min(max(overlap, 0), limit - 1)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= limit for a, b in got)
    assert all(q[0] == p[1] - share and q[1] > p[1] for p, q in itertools.pairwise(got))


def test_p6_runs(spark):
    d = spark.createDataFrame([(i, "word " * 50 if i % 2 else "x") for i in range(10)] + [(11, None)], "doc_id long, text string")
    runs = [(1, 0, 3, 9, 100, 10), (1, 0, 3, 9, 100, 10), (2, 5, 99, None, None, 0), (3, None, 4, 1, 10, 0), (4, 8, 9, 2, 40, None)]
    r = spark.createDataFrame(runs, "run_id long, first_doc_id long, last_doc_id long, windows long, window_chars int, overlap_chars int")
    got = {(x.run_id, x.doc_id) for x in splitting.split_runs(d, r).collect()}
    assert got == {(1, 1), (1, 3), (4, 9)}
    w = {x.run_id: x for x in splitting.window_check(d, r).collect()}
    assert w[1].documents == 4 and w[1].fewest_windows == 2 + 2 * 3 and w[2].pieces is None and w[3].documents == 0


def test_p6_letters_that_grow_in_lower_case():
    # the capital with a dot has two code points in lower case; boundaries must not move
    t = "İİİİİİİİ first words of one topic here. " * 6 + "Other things are told there. " * 6
    pos, _ = splitting.cohesion(t)
    assert all(t[p - 1] == " " and t[p].isupper() for p in pos)


def test_p6_a_run_given_twice_with_other_limits_is_the_same_each_time(spark):
    d = spark.createDataFrame([(1, "word " * 50)], "doc_id long, text string")
    rows = [(1, 0, 9, 3, 90, 10), (1, 0, 9, 3, 60, 10)]
    got = [splitting.split_runs(d, spark.createDataFrame(x, "run_id long, first_doc_id long, last_doc_id long, windows long, window_chars int, overlap_chars int")).count() for x in (rows, rows[::-1])]
    assert got[0] == got[1] > 4


def test_p7_languages(spark, data, tmp_path):
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    w = language.fit(df)
    extra = docs(spark, ["The branch approved the loan agreement on Monday morning after a short delay. It was fine.", "Die Filiale genehmigte den Darlehensvertrag am Montagmorgen nach kurzer Verzögerung.", None, "", "12345", "The branch approved the loan agreement on Monday morning.\n\nDie Kreditabteilung stornierte den Darlehensvertrag nach dem alten Tarif."])
    got = {r.doc_id: r for r in language.classify(extra, w).collect()}
    assert got[0].main_lang == "en" and got[1].main_lang == "de" and 2 not in got and got[4].main_lang is None and {s.lang for s in got[5].segments} == {"en", "de"} and 0 < got[0].confidence <= 1
    bad = {(r.doc_id, r.true_lang) for r in language.mislabelled(language.classify(extra, w)).collect()}
    assert bad == {(1, "de"), (5, "en"), (5, "de")}
    assert language.weights_of(df) is language.weights_of(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"))
    language.save_weights(w, spark, str(tmp_path / "w"))
    assert np.array_equal(language.load_weights(spark, str(tmp_path / "w")), w)
    # held-out accuracy on documents the fit didn't see: labels are right in nine of ten and more
    rows = language.classify(df, w).where("lang is not null and n_chars >= 200").collect()
    assert sum(r.lang == r.main_lang for r in rows) > 0.9 * len(rows)


def test_p7_time_in_proportion_to_length():
    began = time.process_time()
    dots, token = "." * 40_000, "x" * 40_000
    assert language.units(f"Inhalt{dots}7 Seiten. Ende.{dots} Neu") == [(0, 40_016), (40_016, 80_022), (80_022, 80_025)]
    assert language._usable(f"{token} und mail@b.de {token}") == f"{token} und   {token}"
    # the two took 78 s before
    assert time.process_time() - began < 5


def test_p7_units_and_addresses_as_by_plain_patterns():
    split = re.compile(r"[.!?]+[\"”»)\]]*[^\S\n]+|[।؟]\s+|[。！？]+(?![」』”])")
    mail = re.compile(r"[!-~]+ ?(?:@|\(at\)|\[at\]) ?[!-~]+(?:(?: ?[(\[]dot[)\]] ?| dot )[a-z-]+)*|[!-~]+ at [a-z0-9-]+(?:\.[a-z-]+)+")
    rng = random.Random(7)
    alphabet = [*"ab.!? \t\"”»)]।؟。！？」』 9@-", "abc. ", "...", " at ", " at b.de", "x@y.de", "(at)", "[at]", " dot ", "(dot)"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        assert [m.span() for m in language._SPLIT.finditer(t)] == [m.span() for m in split.finditer(t)], t
        assert language._usable(t) == (mail.sub(" ", t) if "@" in t or " at " in t or "(at)" in t or "[at]" in t else t), t


def test_p7_scores_of_a_batch_are_those_of_each_text():
    rng = random.Random(8)
    few = ["", " ", "a", "Die Bank.", "b" * 3, "наш банк", "銀行の口座", *(words(rng, rng.randint(1, 9)) for _ in range(40))]
    weights = np.random.default_rng(8).standard_normal((language.SLOTS, len(language.CODES))).astype(np.float32)
    got, letters = language.scores(few, weights)
    for t, g, n in zip(few, got, letters):
        slots, starts, own = language.presence([t])
        assert len(set(slots)) == len(slots) == starts[1] and own[0] == n == len(t.replace(" ", "").replace(".", ""))
        assert np.allclose(g, weights[slots].sum(0) / np.sqrt(max(1, len(slots))), atol=1e-5)
    # more rows than a number of 32 bits holds beside the slot
    slots, starts, own = language.presence(few)
    many, at, n = language.presence([*few, *[""] * (1 << 15)])
    assert np.array_equal(many[: len(slots)], slots) and np.array_equal(at[: len(few) + 1], starts) and np.array_equal(n[: len(few)], own)


def test_p8_round_trip_and_library(spark):
    if not os.path.exists(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json"):
        pytest.skip("no vocabularies")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", None, " ", "<|endoftext|> hi", "a" * 500, "x" * 3000 + "\n\n\n  y", "Überweisung 第二期款项 नमस्ते 🙂👍🏽 it's we'll", *("".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4E80), 32))) for _ in range(80)) for _ in range(60))]
    got = {r.doc_id: r.ids for r in tokenize.encode(docs(spark, texts)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokenize.decode(tokenize.encode(docs(spark, texts))).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))


def test_p8_table_decides_alone(monkeypatch):
    if not os.path.exists(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json"):
        pytest.skip("no vocabularies")
    a = tokenize.automaton("byte_bpe_50k")
    rng = random.Random(10)
    pieces = [bytes(rng.choice(b"aeinorst th,.0123\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(400)] + [b" the", b"aaaa" * 50]
    want = [a.walk(p) for p in pieces]
    assert all(b"".join(a.bytes_of[t] for t in w) == p for p, w in zip(pieces, want))
    # what has been read once is read again by the table only, in a single pass
    monkeypatch.setattr(a, "step", None)
    assert [a.walk(p) for p in pieces] == want and a.walk(b" the") == a.walk(b" the")
    monkeypatch.undo()
    # starting the table anew changes no result
    monkeypatch.setattr(tokenize, "KEPT_STATES", 50)
    assert [a.walk(p) for p in pieces] == want and len(a.begun) < 5000


def test_p9_packing(spark):
    texts = ["word " * n for n in (0, 1, 5, 40, 60, 99, 300, 7, 7, 7)] + [None]
    plan = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_multi_50k", 128), (3, None, 64), (4, "byte_bpe_50k", 0)], "plan_id int, tokenizer string, capacity_tokens int")
    rows = packing.pack(docs(spark, texts), plan).collect()
    for p, cap in ((1, 64), (2, 128)):
        mine = [r for r in rows if r.plan_id == p]
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= cap and {r.doc_id for r in mine} == set(range(11))
        for i in range(11):
            parts = sorted((r.part, r.first_token, r.n_tokens) for r in mine if r.doc_id == i)
            assert [x[0] for x in parts] == list(range(len(parts))) and (len(parts) == 1 or all(x[2] == cap for x in parts[:-1]))
    assert {r.plan_id for r in rows} == {1, 2}
    assert packing.fill(packing.pack(docs(spark, texts), plan), plan).count() == 2


def test_p9_any_number_of_plans(spark, monkeypatch):
    monkeypatch.setattr(packing, "PLANS_AT_ONCE", 2)
    plan = spark.createDataFrame([(i, "byte_bpe_50k", 16 + i) for i in range(5)], "plan_id int, tokenizer string, capacity_tokens int")
    rows = packing.pack(docs(spark, ["one two three", "four"]), plan)
    assert {(r.plan_id, r.doc_id) for r in rows.collect()} == {(i, k) for i in range(5) for k in range(2)} and packing.fill(rows, plan).count() == 5


def test_p9_first_fit():
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
    bins, want = [], []
    for s in sizes:
        k = next((i for i, room in enumerate(bins) if room >= s), len(bins))
        if k == len(bins):
            bins.append(64)
        bins[k] -= s
        want.append(k)
    assert packing.first_fit_decreasing(sizes, 64) == want


LEARNED = {"en": {"a": {"mr": 0.0, "inc": 0.2, "approx": 0.0}, "c": {("no", "##")}, "s": {"The"}, "l": {"the"}}}


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. The two.", ["One. ", "The two."]), ("Mr. Smith came. The end", ["Mr. Smith came. ", "The end"]), ("Sold to X Inc. The rest", ["Sold to X Inc. ", "The rest"]), ("Case No. 5 is 3.14 now.", ["Case No. 5 is 3.14 now."]),
        ("1. The first\n- second. The third", ["1. The first\n", "- second. ", "The third"]), ('"Stop. Now." wrote he.', ['"Stop. Now." wrote he.']), ('"Stop. Now." The end.', ['"Stop. Now." ', "The end."]), ("你好。再见!", ["你好。", "再见!"]),
        ("“失败了。请再试。”他说。好", ["“失败了。请再试。”他说。", "好"]), ("Wait ... a bit. J. Smith", ["Wait ... a bit. ", "J. Smith"]), ("2024-01-02\tX Inc. The\t5", ["2024-01-02\tX Inc. The\t5"]), ("  \n\r\n ", []), ("", []), ("Why?! Because", ["Why?! ", "Because"]), ("なぜですか?QQ58へ送金した。", ["なぜですか?", "QQ58へ送金した。"]), ("see a?b=1 now", ["see a?b=1 now"]),
    ],
)
def test_p10_boundaries(text, want):
    b = sentences.boundaries(text, "en", LEARNED)
    assert [text[x:y] for x, y in zip(b, [*b[1:], len(text)])] == [w if w.strip() else w for w in want] or [text[x:y].strip() for x, y in zip(b, [*b[1:], len(text)])] == [w.strip() for w in want]


def test_p10_learns_and_splits(spark):
    texts = [f"Mr. Smith paid {i} euro to the branch. The branch thanked Mr. Jones warmly. They left the branch then." for i in range(60)] + [None, "", "\n"]
    df = docs(spark, texts)
    learned = sentences.learn(df)
    assert "mr" in learned["en"]["a"] and "branch" not in learned["en"]["a"]
    got = sentences.split(df, learned).where("doc_id = 0").orderBy("start_pos").collect()
    assert [texts[0][r.start_pos : r.end_pos] for r in got] == ["Mr. Smith paid 0 euro to the branch.", "The branch thanked Mr. Jones warmly.", "They left the branch then."]
    assert sentences.split(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_every_query_runs(spark, data, name):
    df = Q.queries()[name](spark, data)
    assert df.count() >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    got = Q.queries()[name](spark, data).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, res.fetchall()))


def test_longest_tasks_keep_texts_whole():
    t = "The desk replied. " * 20_000
    assert len(sentences.boundaries(t, "en", LEARNED)) == 20_000
    assert splitting.pieces(t, 1000, 10)[-1][1] == len(t)
    codes, off = code_points(pa.array([t, "ﬁ" * 100_000]))
    assert np.diff(normalize.canonical(codes, off)[1]).tolist() == [len(t), 200_000]
