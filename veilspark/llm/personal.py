"""Problem 5: personal information inside free text.

Detection runs on a folded copy of the text with a position for each of its code points: invisible characters dropped, compatibility forms and look-alike letters in mixed words
put in their plain form, so disguised items are met at their place in the text as stored.

* email, phone, identity_number, street_address: grammars over formats and, where a bare number would be ambiguous, the words that introduce it;
* name: a lexicon of given and family names, fitted on the gold annotation of all documents and looked up by one Aho-Corasick pass; neighbouring hits and initials are assembled
  into full names, in either order.

Replacement (redact, which asks for a secret key): numbers keep their format; their digits and letters are permuted by a keyed Feistel network over the whole value, so equal values get equal
pseudonyms in all documents and different values different ones. A number whose check digit holds (CHECKS) becomes another whose check digit holds, one whose doesn't another whose doesn't.
Dates written in numbers are permuted within the calendar and keep their notation; they are no items, and those with the month in words stay. Names, addresses and e-mail addresses become a typed placeholder with
a keyed tag of 80 bits, alike for equal values. Without the key nothing of this can be undone; who has it can undo numbers and dates.

Null and empty texts have no items and stay as they are. Where items overlap, those with a word or format of their own win over bare numbers and names, then the earlier, then the longer. A row given twice yields its items twice.
"""

from __future__ import annotations

import base64
import bisect
import datetime as dt
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, cut, map_arrow, slices, spread, to_strings
from .normalize import LATIN, _compose_pairs, _fold_lookalikes, _put_rows, _rows_with, _take_rows, invisible, tables

KINDS = ("email", "phone", "identity_number", "street_address", "name")
#: Sightings of a name in the annotation that the lexicon asks for.
LEAST_SEEN = 3

_S = r"[ \t]"
_DOT = rf"(?:\.|{_S}?(?:\[dot\]|\(dot\)|\{{dot\}}){_S}?|{_S}dot{_S})"
_AT = rf"(?:{_S}?(?:@|\(at\)|\[at\]|\{{at\}}){_S}?|{_S}at{_S})"
#: An address from its sign on; the part before it is found backwards.
EMAIL_SIGN = rf"(?P<at>{_AT})[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![A-Za-z0-9_+-]|[\w.+-]*{_S}?(?:@|\[at\]|\(at\)|\{{at\}}|at [\w-]+\.[a-z]))"
EMAIL_LOCAL = r"[A-Za-z0-9_](?:[A-Za-z0-9_.+-]*[A-Za-z0-9_])?$"
PHONE = "|".join([
    rf"(?:\+|00)[1-9]\d{{0,2}}[ .\-/]?\(0?\d{{0,4}}\)[ .\-]?\d(?:[ .\-/]?\d){{4,12}}",
    rf"(?:\+|00)[1-9]\d{{0,2}}(?:[ .\-/]?\d){{6,13}}",
    r"(?:1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}",
    r"(?:1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}",
    r"(?:1 )?\d{3} \d{3} \d{4}",
    r"07\d{3}[ \-]?\d{3}[ \-]?\d{3}",
    r"0\d(?:[ .\-]\d\d){4}",
    r"\(0\d{1,5}\)[ \-]?\d(?:[ \-]?\d){4,9}",
    r"0\d{2,4}[/ \-]\d{4,8}(?:[ \-]\d{1,5})?",
    r"0\d{2,4}[/ ]\d{2,4}(?:[ \-]\d{2,4}){1,2}",
])
#: Words that introduce a number of a person, in the twelve languages.
IDENTITY_WORDS = [
    "identity number", "identity card", "ssn", "social security", "tax number", "tax id", "national id", "passport", "driving licence", "driving license", "driver's license",
    "steuer-id", "Steuer-ID", "Steuer-Id", "steuernummer", "personalausweis", "reisepass", "führerschein", "ausweis",
    "sécurité sociale", "numéro fiscal", "passeport", "permis", "carte d'identité",
    "documento de identidad", "dni", "nif", "pasaporte", "permiso", "carné",
    "identificação", "contribuinte", "passaporte", "carta", "cartão de cidadão",
    "codice fiscale", "passaporto", "patente", "carta d'identità",
    "burgerservicenummer", "bsn", "paspoort", "rijbewijs",
    "удостоверени", "паспорт", "права", "снилс", "инн",
    "身份证号码", "身份证", "护照号", "驾驶证号", "個人番号", "旅券番号", "免許証番号", "マイナンバー",
    "पहचान संख्या", "पासपोर्ट", "लाइसेंस", "رقم الهوية", "الهوية", "جواز السفر", "رخصة القيادة", "الرخصة",
]
_SHAPES = "|".join([
    r"(?!000|666)\d{3}[-. ](?!00)\d{2}[-. ](?!0000)\d{4}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{4} \d{4} \d{4}", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?",
    r"\d{3}-\d{3}-\d{3}[ -]\d{2}", r"\d{17}[\dXx]", r"\d{14}", r"\d{13}", r"\d{15}", r"\d{8}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{3} \d{3} \d{3}(?: \d{1,3})?", r"[A-Z]-\d{3}-\d{4}", r"[A-Z]{5}\d{6}\d?[A-Z]{0,2}\d?[A-Z]{0,2}",
    r"[A-Z]{1,2} ?\d{6,8}", r"\d{2} \d{2} \d{6}", r"\d{9,12}", r"[A-Z0-9]{8,16}",
])
IDENTITY_AFTER = rf"[^\W\d_]{{0,6}}(?P<gap>[^\n\d]{{0,22}}?)(?<![A-Za-z0-9])(?P<id>{_SHAPES})(?![A-Za-z0-9])"
#: Shapes that no other number has; area 000 or 666, group 00 and serial 0000 are never given out.
IDENTITY_ALONE = r"(?:\d{3}-\d{3}-\d{3} \d{2}|(?!000|666)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{8}-?[A-Z])(?![A-Za-z0-9_-])"
#: These scans begin with a set of characters, which the search skips to; what may not stand before is looked at afterwards.
_LETTERED = re.compile(r"[A-Z](?:[A-Z]{5}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|-\d{3}-\d{4}|[A-Z]{4}\d{6}[A-Z]{2})(?![A-Za-z0-9_-])")
_BEFORE_LETTERED = re.compile(r"[A-Za-z0-9_.-]")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_POST = r"(?:,? (?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|\d{5}(?:-\d{4})?)(?![A-Za-z0-9_]))?"
_TOWN_EN = rf"(?:,? {_CAP}(?: (?!ZZ\d|[A-Z]{{1,2}}\d){_CAP}){{0,2}})?"
#: Addresses that begin with a digit.
ADDRESS_DIGIT = "|".join([
    rf"\d+[A-Za-z]? (?:St\. )?(?:{_CAP} ){{1,3}}?(?:Street|Road|Lane|Avenue|Drive|Close|Court|Way|Place|Square|Terrace|Crescent|Gardens|Row|Walk|Hill|Grove|Mews|Parade|Boulevard)(?![\w]){_TOWN_EN}{_POST}",
    rf"\d+(?: (?:bis|ter))? (?:rue|place|avenue|boulevard|chemin|allée|quai|impasse|route|cours|square|passage) [^\n,;]{{2,40}}?, \d{{5}} {_CAP}",
    r"\d+, [ऀ-ॿ]+(?: [ऀ-ॿ]+){0,3}, [ऀ-ॿ]+ \d{6}",
    r"\d+ (?:شارع|طريق|حي|ميدان|زقاق|درب)(?: [؀-ۿ]+){1,3}?، مدينة [؀-ۿ]+",
])
#: German and Dutch addresses from the house number on; the street is found backwards.
ADDRESS_NUMBER = rf"\d+ ?[a-z]?, (?:\d{{5}}|\d{{4}} [A-Z]{{2}}) {_CAP}(?: {_CAP})?"
_STREET = re.compile(r"(?:(?:(?:Am|An der|Auf der|Im|In der|Zur|Zum|Alte|Alter|Neue|Neuer|Kleine|Große|Hinter dem|Lange|Korte|Oude|Nieuwe) )?[A-ZÄÖÜ][\wäöüß\-]+) $")
_FLAT = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, $")
#: What an address may begin with besides, and how it goes on from there.
ADDRESS_WORDS = {
    **dict.fromkeys("calle avenida paseo travesía plaza camino ronda carretera glorieta rua largo praça travessa alameda via vicolo piazza corso viale".split(), rf"(?= )[^\n,;]{{2,40}}?, \d+[a-z]?, \d{{4,5}}(?:-\d{{3}})? {_CAP}(?: (?:{_CAP}|de|del|do|da|di|la))*(?<! de)(?<! del)(?<! do)(?<! da)(?<! di)(?<! la)"),
    **dict.fromkeys(("P.O. Box", "PO Box"), rf" \d+{_TOWN_EN}{_POST}"),
    "г. ": r"[А-ЯЁ][\w\-]+(?: [А-ЯЁ][\w\-]+)?, \d{6}, (?:ул|пер|пр|просп|наб|пл|б-р|ш)\. [А-ЯЁ][\w\-]+(?: [А-ЯЁ][\w\-]+)?, д\. \d+(?:, (?:кв|корп)\. \d+)*",
}
ADDRESS_CITY = re.compile(r"市(?:[㐀-鿿]{1,6}?(?:路|街|巷|大道|道|里|弄)\d+号(?:\d+(?:室|楼|单元))?|[㐀-鿿぀-ヿー]{1,8}?\d+(?:-\d+){1,3}(?:号室?)?)")
_CITY = re.compile(r"(?:(?<=住在)|(?<=[はへに:： \n]))[㐀-鿿]{2,4}$|[㐀-鿿]{2}$")
_CASE = re.compile(r"(?:TCK|Ref\.?|Case|Ticket|case|ticket|IBAN|BIC|[A-Z]{2,4}[-/])\s?$")
#: Numbers of other kinds, passed over whole: bank accounts, cards, network addresses.
OTHER_DIGIT = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{3,4}(?![A-Za-z0-9])|\d{15,19}(?![A-Za-z0-9])(?!\d)|\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_IBAN = re.compile(r"[A-Z][A-Z]\d{2}(?<![A-Za-z0-9][A-Z]{2}\d{2})(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9a-f]{1,4}:){5,7}[0-9a-f]{1,4}(?![A-Za-z0-9:])")
_COLONS = re.compile(r":[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:")
_SIGN_PLACE = re.compile(r"[@(\[{]")
_START = re.compile(r"[+(]?\d+")
_BY_DIGIT = re.compile(rf"(?P<address>{ADDRESS_DIGIT})|(?P<number>{ADDRESS_NUMBER})|(?P<other>{OTHER_DIGIT})|(?P<alone>{IDENTITY_ALONE})|(?P<phone>(?:{PHONE})(?![A-Za-z0-9_/]|[.,\-]\d| \d))")
_SIGN = re.compile(EMAIL_SIGN)
_LOCAL = re.compile(EMAIL_LOCAL)
_IDENTITY = re.compile(IDENTITY_AFTER)
_BY_WORD = {w: re.compile(r) for w, r in ADDRESS_WORDS.items()}
_FRENCH = re.compile(r"\b(?:le|la|du|des|une|les|au|aux|est|et|a appelé|habite|demande)\b")
_INITIAL = re.compile(r"(?<![^\W_])[^\W\d_]\.[ \t]$")
_CJK = re.compile(r"^[぀-ヿ㐀-鿿]+$")
_FULL_ONLY = re.compile(r"^[ऀ-ॿ؀-ۿ]")
_NAME_OK = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ॿ'’\-])*")


@cache
def _plain_table() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0x1FFFF)]:
        n = unicodedata.normalize("NFKC", chr(cp))
        if len(n) == 1 and cp != 0x2026:
            out[cp] = ord(n)
    return out


def folded(texts: list[str]) -> tuple[list[str], list[np.ndarray | None]]:
    """(folded texts, positions of their code points in the texts as stored; None where they are the same). ASCII stays as it is."""
    plain, positions = list(texts), [None] * len(texts)
    some = np.array([i for i, t in enumerate(texts) if not t.isascii()], np.int64)
    if len(some):
        codes, off = code_points(pa.array([texts[i] for i in some], pa.string()))
        rows = np.nonzero(_rows_with(_foldable()[codes], off))[0]
        if len(rows):
            for i, t, p in zip(some[rows], *_folded(*_take_rows(codes, off, rows))):
                plain[i], positions[i] = t, p
    return plain, positions


@cache
def _foldable() -> np.ndarray:
    """Code points that folding may change or drop, or whose presence may change others."""
    t = tables()
    return (_plain_table() != np.arange(0x110000)) | (t.ccc > 0) | (t.kind == 2) | (t.script > LATIN)


def _folded(codes: np.ndarray, off: np.ndarray) -> tuple[list[str], list[np.ndarray | None]]:
    gone = invisible(codes)
    marks = np.nonzero((tables().ccc[codes] > 0) & ~gone)[0]
    marks = marks[(marks > 0) & ~np.isin(marks, off)]
    if len(marks):
        new = _compose_pairs(codes[marks - 1], codes[marks])
        codes = codes.copy()
        codes[marks[new > 0] - 1] = new[new > 0]
        gone[marks[new > 0]] = True
    keep = np.nonzero(~gone)[0]
    cum = np.concatenate(([0], np.cumsum(~gone)))
    new_off = cum[off]
    plain = _plain_table()[codes[keep]]
    rows = np.nonzero(_rows_with(tables().script[plain] > LATIN, new_off))[0]
    if len(rows):
        some, some_off = _take_rows(plain, new_off, rows)
        plain, _ = _put_rows(plain, new_off, rows, _fold_lookalikes(some, some_off), some_off)
    texts = to_strings(plain, new_off).to_pylist()
    short = np.diff(off) != np.diff(new_off)
    return texts, [np.append(keep[new_off[i] : new_off[i + 1]] - off[i], off[i + 1] - off[i]) if short[i] else None for i in range(len(texts))]


def _name_parts(surface: str, label: str) -> list[tuple[str, str]]:
    """(kind, part) of an annotated surface: given and family names, unspaced full names (cjk), and what is annotated otherwise (other)."""
    s = unicodedata.normalize("NFKC", " ".join(surface.split()))
    if label == "other":
        return [("other", s)]
    if label == "last_name":
        return [("family", s)]
    if label == "first_name":
        return [] if " " in s else [("given", s)]
    if any(c.isdigit() or c in "@<>|;/" for c in s):
        return []
    if _CJK.match(s):
        return [("cjk", s)]
    if m := re.fullmatch(r"([^,]+), (\S+)", s):
        return [("family", m[1]), ("given", m[2])]
    if m := re.fullmatch(r"[^\W\d_]\. (.+)", s):
        return [("family", m[1])]
    if " " in s:
        x, y = s.split(" ", 1)
        return [("given", x), ("family", y)]
    return []


def count_names(df: DataFrame) -> DataFrame:
    """(part, given, family, cjk, other): how often each part is annotated, over all documents; parts that can be no name for want of sightings left out."""
    label = F.col("s.label")
    counts = (
        df.where("text is not null and size(spans) > 0").select("text", F.explode("spans").alias("s"))
        .where(label.isNotNull() & F.expr("s.start_pos >= 0 and s.end_pos > s.start_pos and s.end_pos - s.start_pos <= 40 and s.end_pos <= length(text)"))
        .select(F.expr("substring(text, s.start_pos + 1, s.end_pos - s.start_pos)").alias("surface"), F.when(label.isin("name", "first_name", "last_name"), label).otherwise("other").alias("label"))
        .groupBy("surface", "label").agg(F.count("*").alias("n"))
        .where("label <> 'other' or n > 1")
    )

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        surfaces, labels, ns = (c.to_pylist() for c in batch.columns)
        rows = [(kind, part, n) for s, x, n in zip(surfaces, labels, ns) for kind, part in _name_parts(s, x)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "part", "n"])

    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    parts = map_arrow(counts, fn, "kind string, part string, n long").groupBy("part").agg(*map(of, ("given", "family", "cjk", "other")))
    return parts.where(f"given >= {LEAST_SEEN} or family >= {LEAST_SEEN} or cjk > 1")


def unspaced_cuts(full: DataFrame) -> DataFrame:
    """part -> (head, tail) of unspaced full names: the cut both of whose sides are met with several others, the best if there are more."""
    cuts = full.where("length(part) > 1").select("part", F.explode(F.expr("sequence(1, length(part) - 1)")).alias("k")).select("part", "k", F.expr("substring(part, 1, k)").alias("head"), F.expr("substring(part, k + 1)").alias("tail"))
    met = cuts.where("length(part) <= 6")
    heads, tails = met.groupBy("head").agg(F.count("*").alias("n")).where("n > 2"), met.groupBy("tail").agg(F.count("*").alias("m")).where("m > 2")
    both = cuts.join(heads, "head").join(tails, "tail")
    return both.groupBy("part").agg(F.max(F.struct(F.expr("n * m").alias("x"), F.expr("-k").alias("k"), "head", "tail")).alias("b")).select("b.head", "b.tail").distinct()


def count_met(df: DataFrame, words: set[str]) -> dict[str, int]:
    """How often each of words stands by itself in the texts of all documents."""
    shared = df.sparkSession.sparkContext.broadcast(sorted(words))
    built: dict[str, ahocorasick.Automaton] = {}

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "a" not in built:
            built["a"] = ahocorasick.Automaton()
            for w in shared.value:
                built["a"].add_word(w, w)
            built["a"].make_automaton()
        n: Counter = Counter()
        for t in batch.column(0):
            t = t.as_py()
            n.update(w for last, w in built["a"].iter(t) if _sides_free(t, last + 1 - len(w), last + 1))
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    if not words:
        return {}
    return {r.word: r.n for r in map_arrow(spread(df.select("text").where("text is not null")), fn, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def fit_names(df: DataFrame) -> tuple[set[str], set[str]]:
    """(given names, family names) from the gold annotation of all documents. A surface counts if it is annotated as a name most of the times it is annotated at all, and most of the times
    it is met: else the more documents, the more words annotated by mistake would reach LEAST_SEEN."""
    counted = cut(count_names(df))
    given, family, other = Counter(), Counter(), Counter()
    for r in counted.where(f"given >= {LEAST_SEEN} or family >= {LEAST_SEEN}").collect():
        given[r.part], family[r.part], other[r.part] = r.given, r.family, r.other

    def good(c: Counter, words: int) -> set[str]:
        cut_off = {t for s, n in c.items() if n >= 20 for t in (s[:-1], s[1:], s[:-2], s[2:]) if 5 * c[t] < n}
        return {s for s, n in c.items() if s not in cut_off and n >= LEAST_SEEN and n > 2 * other[s] and len(s) > 1 and len(s.split()) <= words and all(_NAME_OK.fullmatch(w) for w in s.split())}

    g, f = good(given, 1), good(family, 3)
    met = count_met(df, {s for s in g | f if not _CJK.match(s)})
    g, f = ({s for s in x if 2 * (given[s] + family[s]) > met.get(s, 0)} for x in (g, f))
    # a name that is met in both places goes where it is met more; a family name with a given name in front isn't one
    both = g & f
    g -= {s for s in both if family[s] > given[s]}
    f -= {s for s in both if family[s] <= given[s]}
    f = {s for s in f if not (" " in s and s.split(" ", 1)[0] in g)}
    f = {s for s in f if not (" " in s and s.split(" ", 1)[0] in f)} | {s for s in f if " " in s and family[s] >= 10 and family[s] * 3 >= family[s.split(" ", 1)[0]]}
    for r in unspaced_cuts(counted.where("cjk > 1").select("part")).collect():
        f.add(r.head)
        g.add(r.tail)
    return g, f


def build_automaton(given: set[str], family: set[str]) -> ahocorasick.Automaton:
    """One automaton of names, words that introduce identity numbers, and words addresses begin with."""
    a = ahocorasick.Automaton()
    for words, kind in ((IDENTITY_WORDS, "I"), (ADDRESS_WORDS, "A")):
        for w in words:
            for form in {w, w.capitalize(), w.upper() if kind == "I" else w}:
                a.add_word(form, (len(form), kind, w))
    for words, kind in ((given, "G"), (family, "F")):
        for w in words:
            for form in {w, w.upper()}:
                a.add_word(form, (len(form), kind, w))
    a.make_automaton()
    return a


def find_names(text: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """[start, end) of each name of a person, from the hits (start, -end, kind) of the lexicon."""
    hits.sort()
    flat, end = [], -1
    for a, b, kind in hits:
        if a >= end:
            flat.append((a, -b, kind))
            end = -b
    out, k = [], 0
    while k < len(flat):
        a, b, kind = flat[k]
        k += 1
        full = False
        if k < len(flat):
            c, d, other = flat[k]
            gap = text[b:c]
            if kind != other and ((gap.isspace() and len(gap) <= 2 and "\n" not in gap and kind == "G") or (kind == "F" and re.fullmatch(r",[ \t]{1,2}", gap)) or (not gap and kind == "F" and _CJK.match(text[a]))):
                b, full = d, True
                k += 1
        first = text[a]
        if not full and (_CJK.match(first) or _FULL_ONLY.match(first)):
            continue
        if not full and kind == "F" and (m := _INITIAL.search(text, max(0, a - 4), a)):
            # M. is a title in French
            if not (m.group()[0] == "M" and len(_FRENCH.findall(text, max(0, a - 120), a + 120)) > 1):
                a = m.start()
        out.append((a, b))
    return out


def _sides_free(text: str, a: int, b: int) -> bool:
    """Whether no letter, digit or joining mark touches [a, b)."""
    if a and (text[a - 1].isalnum() or text[a - 1] in "_@" or text[a - 1] in ".-'’" and a > 1 and text[a - 2].isalnum()):
        return False
    if b < len(text):
        c = text[b]
        if c.isalnum() or c in "_@" or c == "-" and b + 1 < len(text) and text[b + 1].isalnum() or ord(c) > 0x300 and unicodedata.category(c)[0] == "M":
            return False
    return True


def _signs(text: str) -> list[re.Match]:
    """Matches of EMAIL_SIGN, from the left, none inside another."""
    places = [m.start() for m in _SIGN_PLACE.finditer(text)]
    at = text.find("at", 1)
    while at > 0:
        if text[at - 1] in " \t" and text[at + 2 : at + 3] in (" ", "\t"):
            places.append(at)
        at = text.find("at", at + 2)
    out, end = [], 0
    for p in sorted(places):
        for a in (p - 1, p) if p > end and text[p - 1] in " \t" else (p,):
            if a >= end and (m := _SIGN.match(text, a)):
                out.append(m)
                end = m.end()
                break
    return out


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """[start, end) and kind of each item of a folded text."""
    found: list[tuple[int, int, str]] = []
    names, passed = [], [m.span() for m in _IBAN.finditer(text)]
    if _COLONS.search(text):
        passed += [m.span() for m in _IPV6.finditer(text)]
    for last, (size, kind, word) in automaton.iter(text):
        a, b = last + 1 - size, last + 1
        if kind == "I":
            if (a == 0 or not text[a - 1].isalpha() or _CJK.match(text[a])) and (m := _IDENTITY.match(text, b)) and sum(map(str.isdigit, m.group("id"))) >= 5:
                found.append((*m.span("id"), "identity_number"))
        elif kind == "A":
            if (a == 0 or not text[a - 1].isalnum()) and (m := _BY_WORD[word].match(text, b)):
                found.append((a, m.end(), "street_address"))
        elif _CJK.match(text[a]) or _sides_free(text, a, b):
            names.append((a, -b, kind))
    for m in _LETTERED.finditer(text):
        if m.start() == 0 or not _BEFORE_LETTERED.match(text[m.start() - 1]):
            found.append((*m.span(), "identity_number"))
    for m in _signs(text):
        local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        if local and not (m.group("at").strip() == "at" and "." not in local.group() and not any(c.isdigit() or c in "_-" for c in local.group()) and m.end() - m.start() < 9):
            found.append((local.start(), m.end(), "email"))
    for m in ADDRESS_CITY.finditer(text):
        if c := _CITY.search(text, max(0, m.start() - 5), m.start()):
            found.append((c.start(), m.end(), "street_address"))
    at = 0
    n = len(text)
    for s in _START.finditer(text):
        a = s.start()
        if a < at or (a and (text[a - 1].isascii() and text[a - 1].isalnum() or text[a - 1] in "_/+-€$£" or text[a - 1] in ".," and a > 1 and text[a - 2].isdigit())):
            continue
        if s.end() - a < 3 and s.end() < n and text[s.end()] in "\n\t:;%)]":
            continue
        m = _BY_DIGIT.match(text, a)
        if not m:
            continue
        b = at = m.end()
        what = m.lastgroup
        if what == "other":
            passed.append((a, b))
        elif what == "address":
            f = _FLAT.search(text, max(0, a - 20), a)
            found.append((f.start() if f else a, b, "street_address"))
        elif what == "number":
            if st := _STREET.search(text, max(0, a - 48), a):
                found.append((st.start(), b, "street_address"))
            else:
                at = s.end()
        elif _CASE.search(text, max(0, a - 8), a):
            continue
        elif what == "alone":
            found.append((a, b, "identity_number"))
        elif 7 <= sum(map(str.isdigit, text[a:b])) <= 16:
            found.append((a, b, "phone"))
    names.sort()
    found += [(a, b, "name") for a, b in find_names(text, names)]
    found += [(a, b, "") for a, b in passed]
    # who claims an item by a word or format of its own comes before bare numbers and names
    rank = {"identity_number": 0, "street_address": 0, "email": 0, "": 1, "phone": 2, "name": 2}
    found.sort(key=lambda x: (rank[x[2]], x[0], -x[1]))
    taken: list[tuple[int, int, str]] = []
    for a, b, k in found:
        i = bisect.bisect_left(taken, (a, b, k))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            taken.insert(i, (a, b, k))
    return [x for x in taken if x[2]]


@cache
def _mac_key(key: bytes) -> bytes:
    return hashlib.blake2b(key).digest()


def _tag(key: bytes, text: str) -> bytes:
    """A keyed 128-bit digest."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=_mac_key(key)).digest()


def _digest(key: bytes, tweak: str, i: int, half: int) -> int:
    return int.from_bytes(_tag(key, f"{tweak}|{i}|{half}"), "big")


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 10) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over a * b >= size, walked until it lands inside."""
    if size < 2:
        return value
    a = max(1, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in range(rounds):
            if i % 2:
                left = (left + _digest(key, tweak, i, right)) % a
            else:
                right = (right + _digest(key, tweak, i, left)) % b
        value = left * b + right
        if value < size:
            return value


def _digits(value: str) -> list[int]:
    return [int(c) for c in value if c.isdigit()]


def _dihedral(i: int, j: int) -> int:
    """The product in the symmetry group of a pentagon, turns 0 to 4 and flips 5 to 9."""
    turn = i + j if i < 5 else i - j
    return turn % 5 + 5 * ((i < 5) != (j < 5))


#: The permutation of the Indian number's check digit; values of the characters at odd places of the Italian code (digits and letters A to J, then K to Z); letters of the Spanish number.
_VERHOEFF = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
_ODD_PLACES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21), (2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
_SPANISH = "TRWAGMYFPDXBNJZSQVHLCKE"


def _check_pentagon(v: str) -> str:
    c = 0
    for i, d in enumerate(reversed(_digits(v))):
        for _ in range(i + 1 & 7):
            d = _VERHOEFF[d]
        c = _dihedral(c, d)
    return str(c if c in (0, 5, 6, 7, 8, 9) else 5 - c)


def _check_german(v: str) -> str:
    p = 10
    for d in _digits(v):
        p = ((d + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _check_japanese(v: str) -> str:
    rest = sum(d * w for d, w in zip(_digits(v), (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2))) % 11
    return str(0 if rest < 2 else 11 - rest)


def _check_italian(v: str) -> str:
    even = lambda c: int(c) if c.isdigit() else ord(c) - 65
    odd = lambda c: _ODD_PLACES[0][even(c)] if even(c) < 10 else _ODD_PLACES[1][even(c) - 10]
    return chr(65 + sum((even if i % 2 else odd)(c) for i, c in enumerate(v)) % 26)


def _weighted(v: str, weights: tuple[int, ...]) -> int:
    return sum(d * w for d, w in zip(_digits(v), weights))


#: Shapes of identity numbers with a check, how many characters at the end it takes, and the check of what stands before it ("" where there is none).
CHECKS: tuple[tuple[re.Pattern, int, Callable[[str], str]], ...] = (
    (re.compile(r"\d{8}-?[A-Z]"), 1, lambda v: _SPANISH[int("".join(map(str, _digits(v)))) % 23]),
    (re.compile(r"[XYZ]-?\d{7}-?[A-Z]"), 1, lambda v: _SPANISH[int("XYZ".index(v[0]) * 10**7 + int("".join(map(str, _digits(v))))) % 23]),
    (re.compile(r"[12] \d\d \d\d \d\d \d{3} \d{3} \d\d"), 2, lambda v: f"{97 - int(''.join(map(str, _digits(v)))) % 97:02d}"),
    (re.compile(r"\d\d \d{3} \d{3} \d{3}"), 1, _check_german),
    (re.compile(r"\d{9}"), 1, lambda v: str(_weighted(v, (9, 8, 7, 6, 5, 4, 3, 2)) % 11).replace("10", "")),
    (re.compile(r"\d{17}[\dX]"), 1, lambda v: "10X98765432"[_weighted(v, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)) % 11]),
    (re.compile(r"\d{4} \d{4} \d{4}"), 1, _check_pentagon),
    (re.compile(r"\d{4} ?\d{4} ?\d{4}"), 1, _check_japanese),
    (re.compile(r"\d{3}-\d{3}-\d{3}[ -]\d\d"), 2, lambda v: f"{_weighted(v, (9, 8, 7, 6, 5, 4, 3, 2, 1)) % 101 % 100:02d}"),
    (re.compile(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]"), 1, _check_italian),
)
_GIVEN_OUT = re.compile(r"(?!000|666)\d{3}([-. ])(?!00)\d{2}\1(?!0000)\d{4}")


def check_of(value: str) -> int:
    """Which of CHECKS the number meets, the first if several; -1 for none, -2 for one of the shape of a social security number that can have been given out."""
    if _GIVEN_OUT.fullmatch(value):
        return -2
    return next((k for k, (shape, n, check) in enumerate(CHECKS) if shape.fullmatch(value) and check(value[:-n]) == value[-n:]), -1)


def _permuted(value: str, key: bytes, tweak: str) -> str:
    bases = [10 if c.isascii() and c.isdigit() else 26 if "A" <= c <= "Z" else 0 for c in value]
    number, size = 0, 1
    for c, base in zip(value, bases):
        if base:
            number = number * base + (int(c) if base == 10 else ord(c) - 65)
            size *= base
    number = feistel(number, size, key, tweak + "".join("9" if b == 10 else "A" if b else c for c, b in zip(value, bases)))
    out = []
    for c, base in zip(reversed(value), reversed(bases)):
        if base:
            number, d = divmod(number, base)
            out.append(str(d) if base == 10 else chr(65 + d))
        else:
            out.append(c)
    return "".join(reversed(out))


def pseudonym(value: str, key: bytes) -> str:
    """value with its digits and Latin capitals permuted as one number in their mixed base; all else stays, and the format is the tweak. A number that meets a check is permuted without it and gets the new
    one; the permutation is walked until the result meets the same check, or none like the value, so it stays a permutation."""
    own = check_of(value)
    shape, n, check = CHECKS[own] if own >= 0 else (None, 0, None)
    while True:
        if shape is None:
            value = _permuted(value, key, "")
        else:
            body = _permuted(value[:-n], key, f"{own}|")
            value = body + check(body) if shape.fullmatch(body + value[-n:]) else body + value[-n:]
            if not shape.fullmatch(value):
                continue
        if check_of(value) == own:
            return value


_DATE = re.compile(r"\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}(?![\w]|[-/.]\d)|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4}(?![\w]|[-/.]\d)|\d{4}年\d{1,2}月\d{1,2}日")
_NUMBERS = re.compile(r"\d+|\D+")


def dates(text: str) -> list[tuple[int, int]]:
    """[start, end) of the dates written in numbers."""
    return [m.span() for m in _DATE.finditer(text) if m.start() == 0 or not (text[m.start() - 1].isalnum() and text[m.start() - 1].isascii() or text[m.start() - 1] in "_-/.,:")]


def pseudonym_date(value: dt.date, key: bytes, first: dt.date = dt.date(1900, 1, 1), last: dt.date = dt.date(2099, 12, 31)) -> dt.date:
    """A date permuted within the calendar from first to last; one outside stays."""
    return value if not first <= value <= last else first + dt.timedelta(days=feistel((value - first).days, (last - first).days + 1, key, "date"))


def written_pseudonym(value: str, key: bytes) -> str | None:
    """A written date permuted, in its notation: the day comes before the month unless that is no date. None for one that isn't in the calendar."""
    parts = _NUMBERS.findall(value)
    fields = parts[::2]
    order = "ymd" if len(fields[0]) == 4 else "dmy"
    for o in (order,) if order == "ymd" else (order, "mdy"):
        at = dict(zip(o, range(3)))
        try:
            day = dt.date(*(int(fields[at[c]]) for c in "ymd"))
        except ValueError:
            continue
        new = pseudonym_date(day, key)
        if new == day and not 1900 <= day.year <= 2099:
            return None
        for c, n in zip("ymd", (new.year, new.month, new.day)):
            # two places stay two places; one place may become two
            parts[2 * at[c]] = f"{n:0{len(fields[at[c]])}d}"
        return "".join(parts)
    return None


@lru_cache(maxsize=100_000)
def placeholder(kind: str, surface: str, key: bytes) -> str:
    if kind in ("phone", "identity_number"):
        return f"[{kind.upper()} {pseudonym(surface, key)}]"
    if kind == "date":
        new = written_pseudonym(surface, key)
        return surface if new is None else f"[DATE {new}]"
    return f"[{kind.upper()} {base64.b32encode(_tag(key, f'{kind}|' + ' '.join(surface.casefold().split()))[:10]).decode()}]"


def _run(df: DataFrame, names: tuple[set[str], set[str]] | None, secret: bytes | None) -> DataFrame:
    given, family = fit_names(df) if names is None else names
    shared = df.sparkSession.sparkContext.broadcast((sorted(given), sorted(family)))
    built: dict[str, ahocorasick.Automaton] = {}

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "a" not in built:
            built["a"] = build_automaton(*map(set, shared.value))
        col = batch.column(1)
        items, redacted = [], []
        for i, j in slices(np.maximum(1, np.asarray(pa.compute.fill_null(pa.compute.utf8_length(col), 0)))):
            stored = col.slice(i, j - i).to_pylist()
            for t, p, s in zip(*folded([t or "" for t in stored]), stored):
                if s is None:
                    items.append([])
                    redacted.append(None)
                    continue
                found = find(t, built["a"])
                own = []
                for a, b, k in found:
                    # an item ends behind its last code point: dropped ones inside belong to it, those behind it don't
                    x, y = (a, b) if p is None else (int(p[a]), int(p[b - 1]) + 1)
                    own.append({"start_pos": x, "end_pos": y, "kind": k})
                items.append(own)
                if secret is None:
                    continue
                for i_, (a, b, k) in zip(own, found):
                    i_["placeholder"] = placeholder(k, t[a:b], secret)
                # a date inside an item goes with it
                taken = [(a, b) for a, b, _ in found]
                cuts = [(i_["start_pos"], i_["end_pos"], i_["placeholder"]) for i_ in own]
                for a, b in dates(t):
                    k = bisect.bisect_left(taken, (a, b))
                    if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                        cuts.append((*((a, b) if p is None else (int(p[a]), int(p[b - 1]) + 1)), placeholder("date", t[a:b], secret)))
                out, last = [], 0
                for x, y, new in sorted(cuts):
                    out += (s[last:x], new)
                    last = y
                redacted.append("".join((*out, s[last:])))
        kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), *([("placeholder", pa.string())] if secret is not None else [])]))
        cols = {"doc_id": batch.column(0), "items": pa.array(items, kind)} | ({"redacted": pa.array(redacted, pa.string())} if secret is not None else {})
        return pa.RecordBatch.from_pydict(cols)

    more, text = (", placeholder string", ", redacted string") if secret is not None else ("", "")
    return map_arrow(spread(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), fn, f"doc_id long, items array<struct<start_pos int, end_pos int, kind string{more}>>{text}")


def detect(df: DataFrame, names: tuple[set[str], set[str]] | None = None) -> DataFrame:
    """(doc_id, items array of start_pos, end_pos, kind) of every row."""
    return _run(df, names, None)


def redact(df: DataFrame, key: str, names: tuple[set[str], set[str]] | None = None) -> DataFrame:
    """(doc_id, items array of start_pos, end_pos, kind, placeholder; redacted text) of every row. key: a secret of 16 characters at least."""
    if not key or len(key) < 16:
        raise ValueError("redaction needs a secret key of 16 characters at least")
    return _run(df, names, key.encode())


def links(redacted: DataFrame) -> DataFrame:
    """(kind, placeholder, occurrences, documents) of the placeholders met in several documents: the same value in each of them."""
    i = redacted.select("doc_id", F.explode("items").alias("i")).groupBy("i.kind", "i.placeholder", "doc_id").agg(F.count("*").alias("n"))
    return i.groupBy("kind", "placeholder").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents")).where("documents > 1")


def found_items(detected: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind), a row per occurrence."""
    return detected.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.start_pos", "i.end_pos", "i.kind")
