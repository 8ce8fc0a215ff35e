"""Problem 8: encoding with a public byte-level BPE tokenizer, by a tokenization automaton.

Compilation. The automaton starts as one state with a loop on every byte. Each merge (u, v), in order of rank, is a gadget: the state that follows u loses its
arc v, in a copy that only u leads to, and every state with an arc u gets an arc uv to where v led. A token sequence is what greedy merging
gives exactly if it is a path of the finished automaton. The copies are persistent: what a gadget takes away is one entry
(u, v) -> rank of `lost`, and the state after uv is the state after v as it was at that rank, so an arc of the finished automaton is there unless one of the gadgets along the
right spine of the token before and the left spine of the token after took it (`has_arc`).

That automaton reads tokens; `step` makes it deterministic over bytes. A state is what may still come of the bytes read so far: the tokens begun (nodes of the vocabulary's
trie), each with the state of the automaton it was begun in, and the label of the one arc that ends here (any beginning of a text has exactly one path). States
and their transitions go into the table the first time they are met and stay there.

Encoding. Text is split by the tokenizer's pattern; each distinct piece is read once, one table entry for each byte, without a step back; the labels of its path are
then emitted from the last to the first. Decoding emits the labels' bytes.

Null and empty texts give an empty list; special tokens' strings are ordinary text; white space is encoded like any other. A row given twice is encoded twice. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread

#: Where the vocabulary files lie.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces a worker keeps; beyond that it starts anew, which changes no result.
KEPT_PIECES = 600_000
#: States a worker keeps; beyond that the table starts anew, which changes no result either.
KEPT_STATES = 400_000
_SHIFT = 20
_NODE_BITS = 24
_NODE = (1 << _NODE_BITS) - 1


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _ranked_pair(piece: bytes, rank: dict[bytes, int], below: int) -> tuple[bytes, ...]:
    """Greedy merging of piece by the ranks under `below`; of a token it leaves the two parts it is merged from."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        best = min((r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1], below)) <= below)
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return tuple(parts)


def load_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """(token bytes -> id, merges in order of rank) of a byte-level file: JSON with its merges, or ranks from which the merges follow."""
    if path.endswith(".json"):
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return {raw[t]: i for t, i in model["vocab"].items() if t in raw}, [(raw[a], raw[b]) for a, b in merges]
    with open(path, "rb") as f:
        ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    merges = []
    for token, i in sorted(ids.items(), key=lambda x: x[1]):
        if len(token) > 1:
            pair = _ranked_pair(token, ids, i)
            if len(pair) == 2:
                merges.append(pair)
    return ids, merges


class Automaton:
    """The compiled automaton of one vocabulary, with the pieces encoded so far."""

    def __init__(self, path: str):
        ids, merges = load_vocabulary(path)
        size = max(ids.values()) + 1
        self.bytes_of = [b""] * size
        for b, i in ids.items():
            self.bytes_of[i] = b
        far = 1 << 40
        rank, left, right = [-1] * size, [-1] * size, [-1] * size
        lost: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            u, v, w = ids[a], ids[b], ids[a + b]
            if rank[w] < 0 and len(self.bytes_of[w]) > 1:
                rank[w], left[w], right[w] = k, u, v  # enter: the state after w is that after v, as of rank k
            lost.setdefault(u << _SHIFT | v, k)
        self.lost = lost
        # spines: (token, rank of the next larger one in the spine)
        self.before: list[tuple[tuple[int, int], ...]] = [()] * size
        self.after: list[tuple[tuple[int, int], ...]] = [()] * size
        for t in range(size):
            for spine, side in ((self.before, right), (self.after, left)):
                out, s, limit = [], t, far
                while s >= 0:
                    out.append((s << _SHIFT if side is right else s, limit))
                    limit, s = rank[s], side[s]
                spine[t] = tuple(out)
        self.trie: dict[int, int] = {}
        self.label: list[int] = [-1]
        for b, i in ids.items():
            node = 0
            for c in b:
                key = node << 8 | c
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(self.label)
                    self.label.append(-1)
                node = nxt
            self.label[node] = i
        self.inner = {key >> 8 for key in self.trie}
        self.length = [len(b) for b in self.bytes_of]
        self.restart()
        self.forget()

    def restart(self) -> None:
        """The table with its first state only: nothing read, the root of the trie, no token before."""
        self.arcs: dict[int, bool] = {}
        self.table: dict[int, int] = {}
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self.begun: list[tuple[int, ...]] = [(0,)]
        self.ending: list[int] = [-1]

    def forget(self) -> None:
        self.pieces = _Pieces(self)
        self.labels = array("i")
        self.ends = array("q", [0])

    def has_arc(self, token: int, following: int) -> bool:
        """Whether the state after token has an arc for the following one."""
        key = token << _SHIFT | following
        known = self.arcs.get(key)
        if known is None:
            lost = self.lost
            known = True
            for s, before in self.before[token]:
                for r, after in self.after[following]:
                    k = lost.get(s | r)
                    # the gadget took the arc before s grew into a larger token, and not after r had grown into one
                    if k is not None and k < before and k <= after:
                        known = False
            self.arcs[key] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte, made and entered in the table."""
        trie, label = self.trie, self.label
        out, ending = [], -1
        for x in self.begun[state]:
            node = trie.get((x & _NODE) << 8 | byte)
            if node is not None:
                before = x >> _NODE_BITS
                if ending < 0 and label[node] >= 0 and (not before or self.has_arc(before - 1, label[node])):
                    ending = label[node]
                if node in self.inner:
                    out.append(before << _NODE_BITS | node)
        out.append((ending + 1) << _NODE_BITS)
        key = tuple(out)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.begun)
            self.begun.append(key)
            self.ending.append(ending)
        self.table[state << 8 | byte] = to
        return to

    def walk(self, piece: bytes) -> list[int]:
        """Labels of the one path through the automaton that spells piece."""
        if len(self.begun) > KEPT_STATES:
            self.restart()
        table, state, path = self.table, 0, []
        for byte in piece:
            to = table.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            path.append(state)
        out, at = [], len(piece)
        while at:
            token = self.ending[path[at - 1]]
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row offsets into them)."""
        words, counts = self.split(texts)
        which = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
        ends = np.frombuffer(self.ends, np.int64)
        labels = np.frombuffer(self.labels, np.int32)
        start, size = ends[which], ends[which + 1] - ends[which]
        out_end = np.cumsum(size)
        total = int(out_end[-1]) if len(out_end) else 0
        flat = labels[np.arange(total) - np.repeat(out_end - size - start, size)] if total else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], out_end))[np.concatenate(([0], np.cumsum(counts)))]
        del ends, labels
        return flat, offsets

    def count_words(self, words: list[str], counts: list[int]) -> np.ndarray:
        """Tokens of each text, given its pieces."""
        which = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
        ends = np.frombuffer(self.ends, np.int64)
        sizes = np.concatenate(([0], np.cumsum(ends[which + 1] - ends[which])))
        at = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(sizes[at])

    def split(self, texts: list[str | None]) -> tuple[list[str], list[int]]:
        if len(self.pieces) > KEPT_PIECES:
            self.forget()
        return split_texts(texts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_SPLIT = regex.compile(PATTERN)


def split_texts(texts: list[str | None]) -> tuple[list[str], list[int]]:
    words: list[str] = []
    counts = []
    for t in texts:
        n = len(words)
        if t:
            words += _SPLIT.findall(t)
        counts.append(len(words) - n)
    return words, counts


class _Pieces(dict):
    """Piece -> its number; a new one is walked through the automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, piece: str) -> int:
        a = self.automaton
        a.labels.extend(a.walk(piece.encode("utf-8", "replace")))
        a.ends.append(len(a.labels))
        self[piece] = n = len(a.ends) - 2
        return n


@cache
def automaton(name: str, folder: str = TOKENIZER_DIR) -> Automaton:
    """One per worker process and vocabulary."""
    for suffix in (".json", ".tiktoken"):
        if os.path.exists(p := os.path.join(folder, name + suffix)):
            return Automaton(p)
    raise FileNotFoundError(f"no byte-level vocabulary {name} in {folder}")


def encode(df: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, off = automaton(tokenizer, folder).encode_batch(batch.column(1).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return map_arrow(spread(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))), fn, "doc_id long, ids array<int>")


def decode(df: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the labels' bytes, joined. Unpaired bytes become U+FFFD."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = automaton(tokenizer, folder)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.decode(x) if x is not None else None for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), fn, "doc_id long, text string")
