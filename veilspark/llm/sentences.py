"""Problem 10: sentence boundaries, from abbreviations, collocations and sentence starters learned without supervision per language.

First pass, over all documents: per language (as labelled; besides, for all together) each word is counted with and without a final period, and each pair of a
word with a final period and the word after it. Log-likelihood ratios then give
* abbreviations: words that keep their period more than chance allows, weighed by length and inner periods;
* sentence starters: words that follow a certain sentence end more often than chance allows;
* collocations: pairs across a period that belong together.
What is learned is a vocabulary: abbreviations, their collocations, starters, and those words seen in lower case that are met behind an abbreviation.

Second pass: each period, question or exclamation mark is classified with these statistics. A line end always ends a sentence. Marks inside a quotation do not divide
the sentence around it; a quotation that ends in a mark ends the sentence if a capital follows. Scripts without capitals or spaces end sentences at
their own full stops. List marks and speakers open the sentence they introduce. A line that is a table row is one sentence.

Null, empty and blank texts have no sentences. Texts are read whole; a row given twice yields its sentences twice; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, spread
from .languages import label_language

#: Thresholds of the log-likelihood ratios.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: An abbreviation ends a sentence only if it is followed by a sentence starter at least this often.
LEAST_FINAL = 0.04
#: A word that is followed by a starter this often is the last of sentences, not an abbreviation.
MOSTLY_FINAL = 0.5

_LINE = "⏎"
_OPEN = "([{<\"'“„«‘‚¿¡「『"
_CLOSE = ")]}>\"'”“»’」』,;:"
_NUMBER = re.compile(r"^[+\-–#]?[\d.,:/\-]*\d[\d.,:/\-]*$")
_ALL = "*"
#: What counts as a word in the statistics; codes, amounts and unspaced scripts do not.
_PLAIN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿](?:[.'’-]{0,2}[^\W\d_぀-ヿ㐀-鿿])*")


def _word_type(word: str) -> tuple[str, bool]:
    """(type in lower case with numbers as one type, whether it ends in a period)."""
    w = word.strip(_OPEN + _CLOSE)
    dot = w.endswith(".") and not w.endswith("..")
    if dot:
        w = w[:-1]
    return ("##" if _NUMBER.match(w) else w.lower()), dot


def count_words(df: DataFrame) -> DataFrame:
    """(lang, kind, a, b, n): kind t: type a without (b = '') or with (b = '.') period; p: type a with period before b; s: b after a certain sentence end; u: capitalised b
    inside a sentence; l: b in lower case."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[str]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[label_language(lang) or "und"].append(text)
        total: Counter = Counter()
        for lang, texts in by.items():
            words = f" {_LINE} ".join(texts).replace("\n", f" {_LINE} ").split()
            types = {}
            for w, n in Counter(words).items():
                t = _word_type(w)
                if t[0] != "##" and not _PLAIN.fullmatch(t[0]):
                    t = ("", False)
                types[w] = t
                if t[0]:
                    total[lang, "t", t[0], "." if t[1] else ""] += n
                    if w[0].islower():
                        total[lang, "l", "", w.strip(_CLOSE).rstrip(".")] += n
            for (a, b), n in Counter([(a, b) for a, b in zip(words, words[1:]) if a[-1] == "." and b != _LINE]).items():
                ta, dot = types[a]
                if not dot:
                    continue
                nxt = b.lstrip(_OPEN).rstrip(_CLOSE + ".")
                if not nxt or not (nxt[0].isdigit() or _PLAIN.fullmatch(nxt)):
                    continue
                total[lang, "p", ta, "##" if nxt[0].isdigit() else nxt] += n
                if len(ta) > 5 and ta.isalpha() and not a[0].isupper():
                    total[lang, "s", "", "##" if nxt[0].isdigit() else nxt] += n
        keys = list(total)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([total[k] for k in keys], pa.int64())], ["lang", "kind", "a", "b", "n"])

    docs = spread(df.select("lang", F.col("text").cast("string").alias("text")).where("text is not null"))
    per = map_arrow(docs, fn, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    return per


def _llr(k11, k1, k2, n):
    """Dunning's log-likelihood ratio of k11 among k1, against k2 of n in all, as a column: how much likelier two rates are than one."""
    p = F.greatest(F.least(k2 / n, F.lit(1 - 1e-9)), F.lit(1e-12))
    p1 = F.greatest(F.least(k11 / k1, F.lit(1 - 1e-9)), F.lit(1e-12))
    rest = F.greatest(n - k1, F.lit(1.0))
    p2 = F.greatest(F.least((k2 - k11) / rest, F.lit(1 - 1e-9)), F.lit(1e-12))
    like = lambda k, m, q: k * F.log(q) + (m - k) * F.log(1 - q)
    return -2 * (like(k11, k1, p) + like(k2 - k11, rest, p) - like(k11, k1, p1) - like(k2 - k11, rest, p2))


def learn(df: DataFrame) -> dict[str, dict]:
    """Per language, and for all under '*': abbreviations (with how often a starter follows), collocations, starters, words seen in lower case."""
    counts = count_words(df)
    counts = cut(counts.unionByName(counts.withColumn("lang", F.lit(_ALL)).groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))))
    words = counts.where("kind = 't'").groupBy("lang", "a").agg(F.sum(F.expr("if(b = '.', n, 0)")).alias("dot"), F.sum("n").alias("n"))
    sums = words.groupBy("lang").agg(F.sum("dot").alias("dots"), F.sum("n").alias("all"))
    w = words.where("dot > 0").join(F.broadcast(sums), "lang")
    q = F.lit(0.99)
    p = F.col("dots") / F.col("all")
    plain = F.col("n") - F.col("dot")
    ratio = -2 * ((F.col("dot") * F.log(p) + plain * F.log(1 - p)) - (F.col("dot") * F.log(q) + plain * F.log(1 - q)))
    length = F.length(F.regexp_replace("a", r"\.", ""))
    inner = F.length("a") - length
    # the penalty of the plain occurrences: length to their power, told in logarithms
    score = F.log(F.greatest(ratio, F.lit(1e-300))) - length + F.log(inner + 1) - plain * F.log(F.greatest(length, F.lit(1)))
    letters = F.col("a").rlike(r"^[\p{L}][\p{L}\p{M}.\-'’]*$")
    abbr = w.where(letters & (F.col("dot") >= 3) & (score >= F.log(F.lit(ABBREVIATION)))).select("lang", "a")
    # starters: against their share of all words
    total = counts.where("kind = 's'").groupBy("lang").agg(F.sum("n").alias("ends"))
    lower_words = words.select("lang", F.col("a").alias("low"), F.col("n").alias("seen"))
    s = counts.where("kind = 's' and b <> '##'").select("lang", "b", F.col("n").alias("k")).withColumn("low", F.lower("b")).join(lower_words, ["lang", "low"]).join(F.broadcast(total), "lang").join(F.broadcast(sums.select("lang", "all")), "lang")
    llr = _llr(F.col("k").cast("double"), F.col("ends").cast("double"), F.col("seen").cast("double"), F.col("all").cast("double"))
    starters = s.where((F.col("k") >= 3) & (F.col("k") / F.col("ends") > F.col("seen") / F.col("all")) & (llr > STARTER)).select("lang", F.lit("").alias("a"), "b", F.lit("s").alias("kind"))
    # collocations: an abbreviation or number and a word that seldom opens sentences, or any word and a number that makes up most of what follows its period
    known = abbr.unionByName(sums.select("lang", F.lit("##").alias("a"))).withColumn("known", F.lit(True))
    opens = counts.where("kind = 's'").select("lang", "b", F.col("n").alias("opens"))
    left = words.select("lang", "a", F.col("dot").alias("left"))
    c = counts.where((F.col("kind") == "p") & (F.col("n") >= 3) & F.col("a").rlike(r"^(##|[\p{L}][\p{L}\p{M}.\-'’]*)$")).join(known, ["lang", "a"], "left").join(left, ["lang", "a"])
    c = c.where("if(b = '##', a <> '##' and (known or n > 0.5 * left), known)").join(opens, ["lang", "b"], "left").where("b = '##' or coalesce(opens, 0) < 0.2 * n")
    c = c.withColumn("low", F.lower("b")).join(lower_words, ["lang", "low"]).join(F.broadcast(sums.select("lang", "all")), "lang")
    llr = _llr(F.col("n").cast("double"), F.col("left").cast("double"), F.greatest("seen", "n").cast("double"), F.col("all").cast("double"))
    colls = c.where((F.col("n") / F.col("left") > F.col("seen") / F.col("all")) & (llr > COLLOCATION)).select("lang", "a", "b", F.lit("c").alias("kind"))
    followed = counts.where("kind = 'p'").join(abbr, ["lang", "a"], "left_semi").join(starters.select("lang", "b", F.lit(1).alias("is")), ["lang", "b"], "left").groupBy("lang", "a").agg((F.sum(F.coalesce("is", F.lit(0)) * F.col("n")) / F.sum("n")).alias("rate"))
    # only words met behind an abbreviation of the language, or of all, are ever looked up
    pairs = counts.where("kind = 'p'")
    behind = pairs.join(abbr, ["lang", "a"], "left_semi").unionByName(pairs.join(abbr.where(F.col("lang") == _ALL).select("a"), "a", "left_semi"))
    small = counts.where("kind = 'l' and n >= 2").join(behind.select("lang", F.lower("b").alias("b")).distinct(), ["lang", "b"], "left_semi")
    rows = (
        abbr.join(followed, ["lang", "a"], "left").select("lang", F.lit("a").alias("kind"), "a", F.lit("").alias("b"), F.coalesce("rate", F.lit(1.0)).alias("rate"))
        .unionByName(starters.unionByName(colls).select("lang", "kind", "a", "b", F.lit(0.0).alias("rate")))
        .unionByName(small.select("lang", F.lit("l").alias("kind"), F.lit("").alias("a"), "b", F.lit(0.0).alias("rate")))
    )
    out: dict[str, dict] = defaultdict(lambda: {"a": {}, "c": set(), "s": set(), "l": set()})
    for r in rows.collect():
        if r.kind == "a":
            out[r.lang]["a"][r.a] = r.rate
        elif r.kind == "c":
            out[r.lang]["c"].add((r.a, r.b))
        else:
            out[r.lang][r.kind].add(r.b)
    return dict(out)


_BREAK = re.compile(r"[\r\n  \x0b\x0c\x85]+")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”"\n]*[“”"]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|‹[^›\n]*›')
_MARK = re.compile(r"[.!?…．!?]+[)\]}”»’\"']*(?=\s)|[。！？｡؟।॥!?…]+[)\]}”»’」』）]*(?=\S)|[。！？｡؟।॥]+[)\]}”»’」』）]*(?=\s)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_LIST_MARK = re.compile(r"^\s*[(\[]?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)\]]{1,2}$")
_TABLE_ROW = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})\s*(?:\t|\||;|[^\S\n]{2,})")
_OPENING = set("([{<\"'“„«‘‚¿¡「『")
_EMPTY = {"a": {}, "c": frozenset(), "s": frozenset(), "l": frozenset()}


def boundaries(text: str | None, lang: str, learned: dict[str, dict]) -> list[int]:
    """Position of the first character of each sentence of text."""
    if not text:
        return []
    own, every = learned.get(lang, _EMPTY), learned.get(_ALL, _EMPTY)
    out: list[int] = []
    at = 0
    for m in (*_BREAK.finditer(text), None):
        end = m.start() if m else len(text)
        line = text[at:end]
        body = line.lstrip()
        if body:
            start = at + len(line) - len(body)
            out.append(start)
            if not _TABLE_ROW.match(line):
                _line_boundaries(line, at, own, every, out)
        at = m.end() if m else end
    return out


def _line_boundaries(line: str, base: int, own: dict, every: dict, out: list[int]) -> None:
    quoted = [q.span() for q in _QUOTED.finditer(line)] if any(c in line for c in '"“„«「『‹') else []
    k = 0
    n = len(line)
    for m in _MARK.finditer(line):
        a, b = m.span()
        while k < len(quoted) and quoted[k][1] <= a:
            k += 1
        inside = k < len(quoted) and quoted[k][0] < a
        if inside and b < quoted[k][1]:
            continue
        nxt = b
        while nxt < n and line[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        follow = nxt
        while follow < n and (line[follow] in _OPENING):
            follow += 1
        if follow >= n:
            continue
        c = line[follow]
        if c.islower():
            continue
        if inside:
            # the quotation closes here: the sentence ends only if a capital opens another
            if not (c.isupper() and nxt > b):
                continue
            out.append(base + nxt)
            continue
        mark = line[a]
        if nxt == b and mark in "!?…" and not _CJK.match(c) and not (a and _CJK.match(line[a - 1])):
            continue
        if c in ",;:)]}”»、，；：）—–-" and not (c in "—–-" and nxt > b):
            continue
        if mark == "." or mark == "．":
            if _keeps_on(line, a, b, follow, own, every):
                continue
        out.append(base + nxt)


def _keeps_on(line: str, a: int, b: int, follow: int, own: dict, every: dict) -> bool:
    """Whether the sentence goes on after the period at a."""
    s = a
    while s > 0 and not line[s - 1].isspace():
        s -= 1
    word = line[s:a].lstrip(_OPEN)
    if _LIST_MARK.match(line[: a + 1]):
        return True
    if line[a : a + 2] == "..":
        return not line[follow].isupper()
    if b - a > 1 and line[a + 1] in ")]}":
        # a closing bracket after the period: the sentence ends unless it is an abbreviation's
        pass
    if not word:
        return False
    e = follow
    while e < len(line) and not line[e].isspace():
        e += 1
    nxt = line[follow:e].rstrip(_CLOSE + ".")
    if nxt[:1].isdigit():
        nxt = "##"
    kind = "##" if _NUMBER.match(word) else word.lower()
    if len(word) == 1 and word.isalpha() and (word.isupper() or kind in own["a"] or kind in every["a"]) and not _CJK.match(word):
        return not (nxt in own["s"] and LEAST_FINAL <= own["a"].get(kind, 0))
    if kind == "##":
        return ((kind, nxt) in own["c"] or (kind, nxt) in every["c"]) and nxt not in own["s"] and nxt not in every["s"]
    rate = own["a"].get(kind)
    if rate is None:
        rate = every["a"].get(kind)
        if rate is None:
            return (kind, nxt) in own["c"] or (kind, nxt) in every["c"]
    if nxt == "##" or rate < LEAST_FINAL:
        return True
    if rate >= MOSTLY_FINAL:  # a word that happens to end sentences only
        return False
    if nxt in own["s"] or nxt in every["s"]:
        return False
    if (kind, nxt) in own["c"]:
        return True
    c = line[follow]
    if c.isalpha() and not c.isupper():
        return True
    low = nxt.lower()
    return not (low in own["l"] and nxt != low)


def split(df: DataFrame, learned: dict[str, dict] | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence; end_pos is behind its last character other than white space."""
    known = learn(df) if learned is None else learned

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, ends, counts = [], [], []
        for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            b = boundaries(text, label_language(lang) or "und", known)
            counts.append(len(b))
            starts += b
            ends += [x + len(text[x:y].rstrip()) for x, y in zip(b, [*b[1:], len(text or "")])]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return map_arrow(spread(df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")), fn, "doc_id long, start_pos int, end_pos int")
