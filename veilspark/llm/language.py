"""Problem 7: missing or wrong language labels, by string-kernel classification.

Kernel: blended spectrum of presence, the number of distinct n-grams of 1 to 4 code points two texts share, over the root of the product of their own numbers (n-grams are
hashed to SLOTS slots). Nyström landmarks span the feature space; one-versus-rest kernel ridge regression on it gives a weight per landmark and language. Scores
are the matrix product of presence, landmarks and weights; landmarks and weights are multiplied once, so that scoring a batch is one product of its sparse
presence matrix with a SLOTS x 12 matrix.

Fit: on the sentences of about FIT_DOCS documents (2 * FIT_DOCS at most) of up to FIT_CHARS code points whose label names one of the languages, chosen by a hash of their id, at most FIT_UNITS sentences; sentences and documents the
first fit puts elsewhere than their label are left out of the second. Everything else reads all rows and whole texts.

Each sentence (or heading) is scored after its text is brought to one form, without digits, punctuation, codes and addresses. A document's main language is the one of most of its
letters; a sentence of another language needs a clear margin over the main one. Table rows, single words and lines of names have no language.

Null, empty and blank texts have no language and no rows. Confidence is the softmax of the scores. A row given twice is classified twice.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, spread
from .languages import CODES, label_language
from .normalize import canonical
from .sentences import _TABLE_ROW

ORDERS = (1, 2, 3, 4)
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
#: Bounds of the fit: documents (of FIT_CHARS code points at most each), sentences, landmarks.
FIT_DOCS, FIT_CHARS, FIT_UNITS, LANDMARKS = 4000, 20_000, 9000, 360
RIDGE = 1e-3
#: Scores to probabilities.
SHARPNESS = 8.0
#: A foreign sentence must score this much more than the main language, by its number of letters.
MARGIN = ((14, 0.55), (24, 0.35), (40, 0.25), (1 << 30, 0.18))
#: Least confidence of a foreign sentence.
LEAST_CONFIDENCE = 0.75
SLICE = 250_000

_UNIT = re.compile(r"[^\r\n]+")
# begins with the set of all marks, so that the scan for the next one is a plain search; a run of Latin marks is tried at its start only, which decides for all of it
_SPLIT = re.compile(r"[.!?।؟。！？](?:(?<=[.!?])(?<![.!?]{2})[.!?]*+[\"”»)\]]*[^\S\n]+|(?<=[।؟])\s+|(?<=[。！？])[。！？]*(?![」』”]))")
#: An address, or a token that no address starts in: what fails at its first character fails at all others.
_MAIL = re.compile(r"([!-~]+ ?(?:@|\(at\)|\[at\]) ?[!-~]+(?:(?: ?[(\[]dot[)\]] ?| dot )[a-z-]+)*|[!-~]+ at [a-z0-9-]+(?:\.[a-z-]+)+)|[!-~]+")
#: What an address without a sign or bracket holds.
_SPELT = re.compile(r" at [a-z0-9-]+\.[a-z-]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


@cache
def _fold_table() -> np.ndarray:
    """Code point -> its letter in lower case; marks stay, all else is a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or cp > 0x323AF:
            continue
        c = chr(cp)
        if c.isalpha() or (cp > 0x300 and unicodedata.category(c)[0] == "M"):
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_ROW_STARTS = frozenset("0123456789 \t")
_ROW = re.compile(_TABLE_ROW.pattern.removeprefix("^"))


def units(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences and headings of a text, table rows left out."""
    out = []
    for m in _UNIT.finditer(text):
        a, b = m.span()
        if text[a] in _ROW_STARTS and _ROW.match(text, a):
            continue
        at = a
        for s in _SPLIT.finditer(text, a, b):
            k = s.start()
            # a Latin mark ends a sentence behind a word of three letters or a closing mark
            if text[k] in ".!?" and not (text[max(0, k - 3) : k].isalpha() and k - at > 2 or text[k - 1] in ")]”»\""):
                continue
            out.append((at, s.end()))
            at = s.end()
        if at < b:
            out.append((at, b))
    return out


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot ids, row starts into them, letters per row): the distinct hashed n-grams of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, off = canonical(codes, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))))
    rows = np.repeat(np.arange(len(texts)), np.diff(off))
    c = _fold_table()[codes]
    # ASCII tokens with a digit or sign of a code in them say nothing about the language
    token = (codes > 0x20) & (codes < 0x7F)
    start = token.copy()
    start[1:] &= ~token[:-1]
    start[off[:-1][off[:-1] < len(codes)]] = token[off[:-1][off[:-1] < len(codes)]]
    number = np.cumsum(start)
    code = ((codes >= 0x30) & (codes < 0x3A)) | (codes == 0x40) | (codes == 0x5F) | (codes == 0x2F)
    bad = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
    bad[number[code]] = True
    bad[0] = False
    c[bad[number] & token] = 0x20
    space = c == 0x20
    letters = np.bincount(rows[~space], minlength=len(texts))
    # one space between words and around each row
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = ~space | ~np.concatenate(([True], space[:-1])) & ~first
    c, rows = c[keep], rows[keep]
    at = np.searchsorted(rows, np.arange(len(texts)))
    c, rows = np.insert(c, at, 0x20), np.insert(rows, at, np.arange(len(texts)))
    at += np.arange(len(texts))
    # row and slot in one number, 32 bits wide while the rows fit; n-grams across a border of rows and lone spaces go to the end
    kind = np.uint32 if len(texts) < 1 << 32 - SLOT_BITS else np.uint64
    rows = rows.astype(kind) << kind(SLOT_BITS)
    border = at[1:]
    key = np.empty(sum(max(0, len(c) - k + 1) for k in ORDERS), kind)
    none, done = kind(np.iinfo(kind).max), 0
    h = np.zeros(len(c), np.uint32)
    for k in ORDERS:
        n = len(c) - k + 1
        if n <= 0:
            break
        h = h[:n] * np.uint32(0x01000193) + (c[k - 1 :] + np.uint32(k)) * np.uint32(0x9E3779B1)
        g = h * np.uint32(0x85EBCA6B)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0xC2B2AE35)
        g >>= np.uint32(32 - SLOT_BITS)
        part = key[done : done + n]
        np.bitwise_or(rows[:n], g, out=part)
        if k == 1:
            part[c == 0x20] = none
        for j in range(1, k):
            across = border - j
            part[across[(across >= 0) & (across < n)]] = none
        done += n
    key.sort()
    key = key[: np.searchsorted(key, none)]
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    starts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64).astype(kind) << kind(SLOT_BITS)) if len(texts) else np.zeros(1, np.int64)
    return (key & kind(SLOTS - 1)).astype(np.int64), starts, letters


def _row_sums(matrix: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The product of the presence matrix with matrix."""
    out = np.zeros((len(starts) - 1, matrix.shape[1]), np.float32)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(matrix[slots], starts[:-1][full], axis=0)
    return out


def _column_sums(columns: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """_row_sums of the transpose of columns, a few columns of many slots: one column at a time stays in the cache."""
    out = np.zeros((len(starts) - 1, len(columns)), np.float32)
    full = starts[1:] > starts[:-1]
    if full.any():
        at = starts[:-1][full]
        values, sums = np.empty(len(slots), np.float32), np.empty((len(columns), len(at)), np.float32)
        for k, column in enumerate(columns):
            np.add.reduceat(np.take(column, slots, out=values, mode="clip"), at, out=sums[k])
        out[full] = sums.T
    return out


def scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each text and language, letters of each text)."""
    outs, letters = [], []
    columns = np.ascontiguousarray(weights.T, np.float32)
    for i, j in slices(np.array([len(t) + 2 for t in texts]), SLICE):
        slots, starts, n = presence(texts[i:j])
        own = np.sqrt(np.maximum(1, np.diff(starts)))[:, None]
        outs.append(_column_sums(columns, slots, starts) / own)
        letters.append(n)
    if not outs:
        return np.zeros((0, len(CODES)), np.float32), np.zeros(0, np.int64)
    return np.concatenate(outs), np.concatenate(letters)


def fit_weights(texts: list[str], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """SLOTS x languages: landmarks times their ridge weights."""
    rng = np.random.default_rng(seed)
    slots, starts, _ = presence(texts)
    size = np.sqrt(np.maximum(1, np.diff(starts)))
    per = max(1, LANDMARKS // max(1, len(np.unique(labels))))
    marks = np.concatenate([rng.permutation(np.nonzero(labels == k)[0])[:per] for k in np.unique(labels)])
    z = np.zeros((SLOTS, len(marks)), np.float32)
    for j, r in enumerate(marks):
        z[slots[starts[r] : starts[r + 1]], j] = 1 / size[r]
    knm = _blocks(z, slots, starts) / size[:, None]
    kmm = knm[marks]
    value, vector = np.linalg.eigh((kmm + kmm.T).astype(np.float64) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = knm @ root
    y = np.where(labels[:, None] == np.arange(len(CODES))[None, :], 1.0, -1.0 / (len(CODES) - 1))
    # each language weighs the same
    w = 1 / np.bincount(labels, minlength=len(CODES))[labels]
    a = phi.T @ (phi * w[:, None]) + RIDGE * np.eye(phi.shape[1])
    alpha = root @ np.linalg.solve(a, phi.T @ (y * w[:, None]))
    # by columns, as scores reads them
    return np.asfortranarray(z @ alpha.astype(np.float32), np.float32)


def _blocks(z: np.ndarray, slots: np.ndarray, starts: np.ndarray, rows: int = 256) -> np.ndarray:
    return np.concatenate([_row_sums(z, slots[starts[i] : starts[min(i + rows, len(starts) - 1)]], starts[i : i + rows + 1] - starts[i]) for i in range(0, len(starts) - 1, rows)])


def _usable(t: str) -> str:
    """t without e-mail addresses."""
    return _MAIL.sub(lambda m: " " if m[1] else m[0], t) if "@" in t or "(at)" in t or "[at]" in t or _SPELT.search(t) else t


def fit(df: DataFrame) -> np.ndarray:
    """Weights from a bounded sample of the labelled documents; languages without labelled text score as none."""
    labelled = df.where(f"text is not null and lang is not null and length(text) between 60 and {FIT_CHARS}")
    every = max(1, labelled.count() // FIT_DOCS)
    mark = F.xxhash64("doc_id")
    rows = labelled.where(F.pmod(mark, F.lit(every)) == 0).select("doc_id", "lang", "text").orderBy(mark, "doc_id").limit(2 * FIT_DOCS).collect()
    texts, docs, labels = [], [], []
    for k, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
        code = label_language(r.lang)
        if code:
            for a, b in units(r.text):
                t = _usable(r.text[a:b])
                if sum(map(len, _LETTERS.findall(t))) >= (8 if _CJK.search(t) else 25):
                    texts.append(t)
                    docs.append(k)
                    labels.append(CODES.index(code))
    labels, docs = np.array(labels, np.int64), np.array(docs, np.int64)
    if not len(labels):
        return np.zeros((SLOTS, len(CODES)), np.float32)
    rng = np.random.default_rng(3)
    # as many of each language
    share = max(50, FIT_UNITS // len(CODES))
    pick = np.sort(np.concatenate([rng.permutation(np.nonzero(labels == k)[0])[:share] for k in np.unique(labels)]))
    texts, docs, labels = [texts[i] for i in pick], docs[pick], labels[pick]
    first = fit_weights(texts, labels)
    got, letters = scores(texts, first)
    by_doc = np.zeros((docs.max() + 1, len(CODES)))
    np.add.at(by_doc, docs, got * letters[:, None])
    sound = (got.argmax(1) == labels) & (by_doc.argmax(1)[docs] == labels)
    if sound.sum() < len(np.unique(labels)) * 5:
        return first
    return fit_weights([texts[i] for i in np.nonzero(sound)[0]], labels[sound])


_FITTED: dict[tuple, np.ndarray] = {}


def weights_of(df: DataFrame) -> np.ndarray:
    """The weights fitted on df, kept for the session: queries over the same files fit once."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(sorted(df.inputFiles())))
    if key not in _FITTED:
        if len(_FITTED) > 8:
            _FITTED.clear()
        _FITTED[key] = fit(df)
    return _FITTED[key]


def save_weights(weights: np.ndarray, spark: SparkSession, path: str) -> None:
    """Weights as a small table, a row for each slot that isn't zero."""
    rows = [(int(k), weights[k].tolist()) for k in np.nonzero(np.abs(weights).sum(1))[0]]
    spark.createDataFrame(rows, "slot int, weights array<float>").coalesce(1).write.mode("errorifexists").parquet(path)


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    """Weights saved before; at most SLOTS rows."""
    out = np.zeros((SLOTS, len(CODES)), np.float32, order="F")
    for r in spark.read.parquet(path).collect():
        out[r.slot] = r.weights
    return out


def _margin(letters: int) -> float:
    return next(m for n, m in MARGIN if letters <= n)


def segments(text: str, spans: list[tuple[int, int]], got: np.ndarray, letters: np.ndarray, probability: np.ndarray) -> tuple[int, list[tuple[int, int, int, float]]]:
    """(main language, [(start, end, language, confidence)]) of a document from the scores and probabilities of its units; neighbours of one language are one segment."""
    if not letters.any():
        return -1, []
    total = (got * np.minimum(letters, 400)[:, None]).sum(0)
    main = int(total.argmax())
    best = got.argmax(1)
    # the main language is that of most letters
    held = np.bincount(best, weights=letters, minlength=len(CODES))
    if held.argmax() != main and held.max() > 1.2 * held[main]:
        main = int(held.argmax())
    out: list[list] = []
    for k, ((a, b), lang, n, sure) in enumerate(zip(spans, best.tolist(), letters.tolist(), probability[:, main].tolist())):
        if not n:
            continue
        if lang != main:
            t = text[a:b]
            words = [w for w in _LETTERS.findall(_usable(t)) if len(w) > 1 or not w.isascii() or w.islower()]
            scaled = n * (3 if _CJK.search(t) else 1)
            plain = sum(w[0].islower() or w.lower() == w.upper() for w in words)
            if (len(words) < 2 and not _CJK.search(t)) or scaled < 10 or plain == 0 or got[k, lang] - got[k, main] < _margin(scaled) or probability[k, lang] < LEAST_CONFIDENCE:
                lang = main
            else:
                sure = float(probability[k, lang])
        if out and out[-1][2] == lang:
            last = out[-1]
            w = last[4]
            last[3] = (last[3] * w + sure * n) / (w + n)
            last[1], last[4] = b, w + n
        else:
            out.append([a, b, lang, sure, n])
    by_lang = [0] * len(CODES)
    for s in out:
        by_lang[s[2]] += s[4]
    return by_lang.index(max(by_lang)), [tuple(s[:4]) for s in out]


def classify(df: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, lang, n_chars, main_lang, confidence, segments) of every document with text; segments: start_pos, end_pos, lang, confidence."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(weights_of(df) if weights is None else weights)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, texts = (c.to_pylist() for c in batch.columns[1:])
        flat, spans = [], []
        for t in texts:
            u = units(t)
            spans.append(u)
            flat += [_usable(t[a:b]) for a, b in u]
        got, letters = scores(flat, shared.value)
        probability = np.exp(SHARPNESS * (got - got.max(1, keepdims=True)))
        probability /= probability.sum(1, keepdims=True)
        mains, sure, parts, ends, at = [], [], [], [0], 0
        for t, u in zip(texts, spans):
            here = slice(at, at := at + len(u))
            main, segs = segments(t, u, got[here], letters[here], probability[here])
            own = [s for s in segs if s[2] == main]
            size = sum(s[1] - s[0] for s in own)
            mains.append(CODES[main] if main >= 0 else None)
            sure.append(sum(s[3] * (s[1] - s[0]) for s in own) / size if size else None)
            parts += segs
            ends.append(len(parts))
        start, end, lang, confidence = zip(*parts) if parts else ((), (), (), ())
        kinds = _ARROW.field("segments").type
        inner = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip((start, end, [CODES[k] for k in lang], confidence), kinds.value_type)], fields=list(kinds.value_type))
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([label_language(x) for x in labels], pa.string()), pa.array([len(t.strip()) for t in texts], pa.int32()), pa.array(mains, pa.string()),
            pa.array(sure, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kinds),
        ], schema=_ARROW)

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return map_arrow(spread(docs), fn, "doc_id long, lang string, n_chars int, main_lang string, confidence double, segments array<struct<start_pos int, end_pos int, lang string, confidence double>>")


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int32()), ("main_lang", pa.string()), ("confidence", pa.float64()),
    ("segments", pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))),
])


def mislabelled(classified: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, true_lang): documents whose label names no language or a wrong one, or that hold several languages; a row per language."""
    langs = classified.where(F.col("main_lang").isNotNull() & (F.col("n_chars") >= min_chars)).withColumn("langs", F.array_distinct(F.transform("segments", lambda s: s["lang"])))
    return langs.where("lang is null or lang <> main_lang or size(langs) > 1").select("doc_id", F.explode("langs").alias("true_lang")).distinct()
