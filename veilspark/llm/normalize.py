"""Problem 2: visually identical text with different characters, brought to one form without per-row string calls.

Arrow text becomes one array of code points; everything after that is a gather from a lookup table, a cumulative sum of expansion offsets or a masked
assignment over the whole batch:

1. compatibility decomposition: each code point's expansion is gathered at offsets from the cumulated expansion lengths;
2. marks are put in canonical order by one stable sort on (starter number, combining class);
3. marks are composed in rounds, the k-th mark of every starter at once, looked up as (starter, mark) in a sorted table; then starters with starters (Hangul and a few
   vowel signs);
4. invisible format characters go, but a joiner between two emoji stays; rows that lost one are composed again;
5. in words (runs of letters) that mix Latin, Cyrillic and Greek letters, letters become their look-alikes in the one script all of them can be written in (the row's main script first). In rows with
   such a word and Latin as the main script, words made of look-alikes only become Latin, too.

Rows without a code point that any step could touch are passed by. A row is found if its text differs from its compatibility composition, or holds an invisible
format character (category Cf, but for joiners between emoji) or a mixed word.

Null texts stay null and are not found, nor are empty ones. Texts of any length are processed whole; a batch is cut by rows only. A row given twice is normalised twice and found once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_arrow, slices, spread, to_strings

#: Cyrillic and Greek letters that look like a Latin one, in pairs.
CYRILLIC_LOOKALIKES = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ԌG ԚQ ԜW Һh аa еe оo рp сc уy хx ѕs іi јj һh ԛq ԝw ԁd ӏl Ӏl ѵv гr пn"
GREEK_LOOKALIKES = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp υu ιi αa κk γy χx ϲc ϳj τt ηn ωw όó έé ίí ύú άá"
LATIN, CYRILLIC, GREEK = 1, 2, 3
_ZWJ = 0x200D
_TOP = sys.maxunicode + 1
_HANGUL = (0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28)


@cache
def tables() -> SimpleNamespace:
    """The lookup tables, made from the interpreter's Unicode data once per worker process."""
    size = np.ones(_TOP, np.uint8)
    start = np.arange(_TOP, dtype=np.int64)
    extra: list[int] = []
    ccc = np.zeros(_TOP, np.uint8)
    changed = np.zeros(_TOP, bool)
    kind = np.zeros(_TOP, np.uint8)  # 1 letter, 2 Cf, 4 emoji-like
    script = np.zeros(_TOP, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    for cp in range(0x80, _TOP):
        if 0x3400 <= cp <= 0x9FFF or 0xD800 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xF0000:
            continue
        c = chr(cp)
        if (k := unicodedata.combining(c)) != 0:
            ccc[cp] = k
        if d := unicodedata.decomposition(c) or (0xAC00 <= cp <= 0xD7A3 and "x"):
            full = unicodedata.normalize("NFKD", c)
            size[cp], start[cp] = len(full), _TOP + len(extra)
            extra += map(ord, full)
            changed[cp] = unicodedata.normalize("NFKC", c) != c
            if d[0] not in "<x":
                parts = [int(x, 16) for x in d.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", "".join(map(chr, parts))) == c:
                    pairs[parts[0], parts[1]] = cp
        cat = unicodedata.category(c)
        if cat == "Cf":
            kind[cp] = 2
        elif cat in ("So", "Sk"):
            kind[cp] = 4
        elif cat[0] == "L":
            kind[cp] = 1
            name = unicodedata.name(c, "")
            script[cp] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2F800), (0x30000, 0x32000)):
        kind[lo:hi] = 1
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B)):
        kind[lo:hi], script[lo:hi] = 1, LATIN
    kind[0xFE0F] = 4
    flat = np.concatenate((np.arange(_TOP, dtype=np.uint32), np.array(extra, np.uint32)))
    keys = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)
    composed = np.array([pairs[int(k) >> 21, int(k) & 0x1FFFFF] for k in keys], np.uint32)
    second = np.zeros(_TOP, bool)  # may merge with the character before it
    second[keys & 0x1FFFFF] = True
    second[0x1161:0x1176] = second[0x11A8:0x11C3] = True
    alike = np.zeros((4, _TOP), np.uint32)  # of a letter, in each script
    for text, own in ((CYRILLIC_LOOKALIKES, CYRILLIC), (GREEK_LOOKALIKES, GREEK)):
        for a, b in text.split():
            alike[LATIN, ord(a)] = ord(b)
            if not alike[own, ord(b)]:
                alike[own, ord(b)] = ord(a)
    for cp in np.nonzero(alike[LATIN])[0]:
        latin, other = int(alike[LATIN, cp]), CYRILLIC if script[cp] == GREEK else GREEK
        alike[other, cp] = alike[other, latin]
    touched = changed | second | (ccc > 0) | (kind == 2)
    return SimpleNamespace(size=size, start=start, flat=flat, ccc=ccc, changed=changed, kind=kind, script=script, keys=keys, composed=composed, second=second, alike=alike, touched=touched)


def _compose_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composition of each pair, 0 where there is none."""
    t = tables()
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    out = np.where(t.keys[at] == key, t.composed[at], 0).astype(np.uint32)
    s, lead, vowel, tail, nl, nv, nt = _HANGUL
    a64, b64 = a.astype(np.int64), b.astype(np.int64)
    lv = (a64 >= lead) & (a64 < lead + nl) & (b64 >= vowel) & (b64 < vowel + nv)
    out[lv] = s + ((a64[lv] - lead) * nv + (b64[lv] - vowel)) * nt
    lvt = (a64 >= s) & (a64 < s + nl * nv * nt) & ((a64 - s) % nt == 0) & (b64 > tail) & (b64 < tail + nt)
    out[lvt] = a64[lvt] + (b64[lvt] - tail)
    return out


def _compose_marks(codes: np.ndarray, ccc: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes with starters composed, kept) after composing each starter with the marks that follow it. head: starts of segments."""
    kept = np.ones(len(codes), bool)
    at = np.nonzero(head)[0]
    count = np.diff(np.append(at, len(codes))) - 1
    live = (count > 0) & (ccc[at] == 0)
    at, count = at[live], count[live]
    last = np.zeros(len(at), np.uint8)
    codes = codes.copy()
    k = 1
    while len(at):
        mark, cls = codes[at + k], ccc[at + k]
        new = _compose_pairs(codes[at], mark)
        new[(last >= cls) & (last > 0)] = 0
        hit = new > 0
        codes[at[hit]] = new[hit]
        kept[at[hit] + k] = False
        last = np.where(hit, last, cls)
        k += 1
        go = count >= k
        at, count, last = at[go], count[go], last[go]
    return codes, kept


def nfkc(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compatibility composition of the rows codes[offsets[i]:offsets[i + 1]]."""
    t = tables()
    size = t.size[codes].astype(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    out = t.flat[np.arange(total) - np.repeat(end - size - t.start[codes], size)]
    offsets = np.concatenate(([0], end))[offsets]
    ccc = t.ccc[out]
    row_start = np.zeros(total + 1, bool)
    row_start[offsets] = True
    head = (ccc == 0) | row_start[:-1]
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~row_start[1:-1]).any():
        # a row that starts with marks has them in a segment of their own
        seg = np.cumsum((ccc == 0) | row_start[:-1])
        seg_class = np.where(ccc == 0, 0, ccc)
        order = np.argsort(seg << 8 | seg_class, kind="stable")
        out, ccc = out[order], ccc[order]
    while True:
        out, kept = _compose_marks(out, ccc, head)
        # starters that follow a starter directly
        live = np.nonzero(kept)[0]
        nxt = live[1:]
        ok = (ccc[live[:-1]] == 0) & (ccc[nxt] == 0) & t.second[out[nxt]] & ~row_start[nxt]
        if len(nxt) and len(offsets):
            # no row border, even of empty rows, lies between
            ok &= np.cumsum(row_start)[nxt] == np.cumsum(row_start)[live[:-1]]
        new = np.zeros(len(nxt), np.uint32)
        if ok.any():
            new[ok] = _compose_pairs(out[live[:-1][ok]], out[nxt[ok]])
        hit = new > 0
        hit[1:] &= ~hit[:-1]
        if hit.any():
            out[live[:-1][hit]] = new[hit]
            kept[nxt[hit]] = False
            head[nxt[hit]] = False
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        out, ccc, head = out[kept], ccc[kept], head[kept]
        row_start = np.zeros(len(out) + 1, bool)
        row_start[offsets] = True
        head = head | row_start[:-1]
        if not hit.any():
            return out, offsets


def _words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of letters, number of their word, letters per word and script)."""
    t = tables()
    letter = t.kind[codes] == 1
    at = np.nonzero(letter)[0]
    row_start = np.zeros(len(codes) + 1, bool)
    row_start[offsets] = True
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | row_start[at[1:]]
    word = np.cumsum(first) - 1
    n = int(word[-1]) + 1 if len(word) else 0
    count = np.bincount(word * 4 + t.script[codes[at]], minlength=4 * n).reshape(n, 4)
    return at, word, count


def invisible(codes: np.ndarray) -> np.ndarray:
    """Which code points are invisible format characters; a joiner between two emoji isn't one."""
    t = tables()
    kind = t.kind[codes]
    bad = kind == 2
    zwj = np.nonzero(codes == _ZWJ)[0]
    zwj = zwj[(zwj > 0) & (zwj < len(codes) - 1)]
    bad[zwj[(kind[zwj - 1] == 4) & (kind[zwj + 1] == 4)]] = False
    return bad


def _rows_with(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cum = np.concatenate(([0], np.cumsum(mask)))
    return cum[offsets[1:]] > cum[offsets[:-1]]


def _take_rows(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = offsets[rows + 1] - offsets[rows]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return codes[np.arange(total) + np.repeat(offsets[rows] - end + size, size)], np.concatenate(([0], end))


def _put_rows(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, new: np.ndarray, new_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace whole rows."""
    size = np.diff(offsets)
    start, source = offsets[:-1].copy(), np.concatenate((codes, new))
    size[rows] = np.diff(new_offsets)
    start[rows] = len(codes) + new_offsets[:-1]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return source[np.arange(total) + np.repeat(start - end + size, size)], np.concatenate(([0], end))


def _same_rows(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray) -> np.ndarray:
    size = np.diff(ao)
    same = size == np.diff(bo)
    rows = np.nonzero(same)[0]
    x, xo = _take_rows(a, ao, rows)
    y, _ = _take_rows(b, bo, rows)
    same[rows] = ~_rows_with(x != y, xo)
    return same


def defects(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a changed sequence, an invisible format character or a mixed word."""
    t = tables()
    found = _rows_with(t.changed[codes] | invisible(codes), offsets)
    rows = np.nonzero(_rows_with(t.second[codes] | (t.ccc[codes] > 0), offsets) & ~found)[0]
    if len(rows):
        a, ao = _take_rows(codes, offsets, rows)
        found[rows[~_same_rows(a, ao, *nfkc(a, ao))]] = True
    rows = np.nonzero(_rows_with(t.script[codes] > LATIN, offsets) & ~found)[0]
    if len(rows):
        a, ao = _take_rows(codes, offsets, rows)
        at, word, count = _words(a, ao)
        mixed = (count[:, 1:] > 0).sum(axis=1) > 1
        mark = np.zeros(len(a), bool)
        mark[at[mixed[word]]] = True
        found[rows[_rows_with(mark, ao)]] = True
    return found


def _fold_lookalikes(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    t = tables()
    at, word, count = _words(codes, offsets)
    if not len(at):
        return codes
    mixed = (count[:, 1:] > 0).sum(axis=1) > 1
    row_of = np.searchsorted(offsets, at, side="right") - 1
    script = t.script[codes[at]]
    rows = len(offsets) - 1
    has_mixed = np.bincount(row_of, weights=mixed[word], minlength=rows) > 0
    by_script = np.bincount(row_of * 4 + script, minlength=4 * rows).reshape(rows, 4)
    latin_row = has_mixed & (by_script[:, LATIN] > 2 * (by_script[:, CYRILLIC] + by_script[:, GREEK]))
    # a word goes to a script all its letters can be written in: the row's main one, else the one most of them are in; failing that, to the one most are in
    able = np.stack([np.bincount(word, weights=(script > 0) & (script != k) & (t.alike[k, codes[at]] == 0)) == 0 for k in (LATIN, CYRILLIC, GREEK)], axis=1)
    row_main = by_script[:, 1:].argmax(axis=1)
    first_row = np.zeros(len(count), np.int64)
    first_row[word] = row_of
    score = count[:, 1:] + able * 1_000_000_000
    score[np.arange(len(count)), row_main[first_row]] += able[np.arange(len(count)), row_main[first_row]] * 500_000_000
    main = 1 + score.argmax(axis=1)
    letters = np.bincount(word)
    alike = np.bincount(word, weights=(t.alike[LATIN, codes[at]] > 0) & (script > LATIN))
    whole = (alike == letters)[word] & latin_row[row_of]
    to = np.where(mixed[word], main[word], np.where(whole, LATIN, 0))
    new = np.where((to > 0) & (script > 0) & (script != to), t.alike[to, codes[at]], 0)
    out = codes.copy()
    out[at[new > 0]] = new[new > 0]
    return out


def canonical(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of each row."""
    t = tables()
    rows = np.nonzero(_rows_with(t.touched[codes] | (t.script[codes] > LATIN), offsets))[0]
    if not len(rows):
        return codes, offsets
    a, ao = nfkc(*_take_rows(codes, offsets, rows))
    bad = invisible(a)
    if bad.any():
        lost = np.nonzero(_rows_with(bad, ao))[0]
        keep = ~bad
        a, ao = a[keep], np.concatenate(([0], np.cumsum(keep)))[ao]
        a, ao = _put_rows(a, ao, lost, *nfkc(*_take_rows(a, ao, lost)))
    return _put_rows(codes, offsets, rows, _fold_lookalikes(a, ao), ao)


def normalise(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """(row_id, text, found) of every row: its text in the one form, and whether it held a defect."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(1)
        parts, founds = [], []
        for i, j in slices(np.maximum(1, np.asarray(pa.compute.fill_null(pa.compute.utf8_length(col), 0)))):
            codes, offsets = code_points(col.slice(i, j - i))
            founds.append(defects(codes, offsets))
            parts.append(to_strings(*canonical(codes, offsets)))
        out = pa.concat_arrays(parts)
        if col.null_count:
            out = pa.compute.if_else(pa.compute.is_null(col), pa.scalar(None, pa.string()), out)
        return pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(np.concatenate(founds))], ["row_id", "text", "found"])

    return map_arrow(spread(df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))), fn, "row_id long, text string, found boolean")


def found_rows(df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """(row_id) of the rows that held a defect, each once."""
    return normalise(df.where(F.col(text).isNotNull()), row_id, text).where("found").select("row_id").distinct()
