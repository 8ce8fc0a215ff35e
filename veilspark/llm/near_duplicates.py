"""Problem 1: near-duplicate records, by bands of minwise values, or by adaptive multi-match prefixes without any chance of a loss.

Similarity is the Jaccard coefficient of the sets of all 12-code-point substrings of the normal form (lower case, white space
runs to one space, trimmed). The search the queries use takes minwise values of that very set, in bands of ROWS; a pair is a candidate if it agrees in LEAST_BANDS bands and in a one-bit sketch. For two
texts at the threshold to be lost, whatever they hold, the permutations must be unlucky: a probability of MISS in the bands (176 of them at .6) and less than that in the sketch (FAR standard deviations);
above the threshold it falls fast (at .65 by a factor of a thousand). Small sets take each value from a permutation of its own, larger ones BINS values from one; sets near the border carry both kinds. Where even that chance must not be, give exact(threshold).
Candidate search by a Scheme:

* Each document has a set of N tokens. A similar document shares at least o = ceil(share * N) of them, so of its tokens in one global order, the rarest first (by
  document frequency, ties by hash), the first N - o + l of each hold l shared ones: the prefix of match level l. Tokens that nobody else has come first in the
  order and can't be shared; they need no posting, and a document with fewer than o others is similar to nothing.
* Tokens held by more than HOT documents are costly. At level l a document looks up the others of its prefix singly and the costly ones in combinations of l. Each document
  estimates its candidates at levels 1 to LEVELS (counts of its single tokens, number of combinations times what one is likely to meet) and takes the cheapest. So that pairs
  between levels are met, it also offers the combinations of lower levels to those who ask for them, without asking itself.
* PRACTICAL, which no query takes: 32-code-point shingles (12-code-point ones for texts of under 96 code points in normal form; texts of 96 to 170 carry both families), the 40 of least hash,
  of which a fifth must be shared. EXACT (see exact()): all 12-code-point shingles and the threshold itself, which loses no pair. In the practical scheme two texts at a
  similarity of .63 share half of their tokens or more in this project's data (.37 as a Jaccard coefficient): fewer than a fifth of 40 then has a probability of 3e-6; at .25 it is 3e-3. Its
  candidates must also agree in a 192-bit one-bit minwise sketch of the 12-code-point shingles (a similarity of .63 is lost with probability 1e-6).
* Candidates are verified exactly on whole texts.

Equal normal forms are one class, represented by its least id; classes are joined, members are expanded afterwards.

Nulls and texts of under `min_chars` code points take no part. Texts whose normal form has under 12 code points have no shingles and are
similar to nothing. Repeated doc_ids with equal text count once. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_arrow, spread
from .shingles import BINNED, BINS, LEAST_AGREEMENT, ROWS, SMALL, band_hashes, binned_values, class_key, codes_of, distinct, jaccard, minwise, normal_form, one_bit_sketch, shingle_set, small_values, window_hashes

#: Documents a token may be held by before it counts as costly.
HOT = 128
#: The highest match level a document may take.
LEVELS = 3
_ANY = 1 << 40
#: Bands in which candidates agree, and the probability with which a pair at the threshold may agree in fewer.
LEAST_BANDS, MISS = 2, 1e-9
#: Longs of the one-bit sketch that candidates must also agree in, to within FAR standard deviations of what the threshold has on average.
LONGS, FAR = 8, 6.4
#: Bands that travel in one block.
BLOCK = 4


@dataclass(frozen=True)
class Scheme:
    """families: (width of a shingle, least and most code points of the texts that carry it), two at most; most: tokens kept of a family, those of least hash (None: all);
    share: of its tokens that a document has in common with a similar one; sketch: whether candidates must agree in their sketches."""

    families: tuple[tuple[int, int, int], ...]
    most: int | None
    share: float
    sketch: bool


PRACTICAL = Scheme(((32, 96, _ANY), (12, 0, 169)), 40, 0.2, True)


def exact(threshold: float) -> Scheme:
    """The scheme that loses nothing: two sets whose Jaccard coefficient is the threshold share that part of either."""
    return Scheme(((12, 0, _ANY),), None, threshold, False)


_SKETCH = "doc_id long, c1 long, c2 long, n12 int, s1 long, s2 long, s3 long"


def _tokens(codes: np.ndarray, scheme: Scheme) -> np.ndarray:
    out = []
    for family, (width, least, longest) in enumerate(scheme.families):
        if least <= len(codes) <= longest:
            # the least bit tells the families apart
            h = window_hashes(codes, width) & ~np.uint64(1) | np.uint64(family)
            if scheme.most and len(h) > 4 * scheme.most:
                low = distinct(np.partition(h, 4 * scheme.most - 1)[: 4 * scheme.most])
                h = low if len(low) >= scheme.most else h
            out.append(distinct(h)[: scheme.most])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signatures(df: DataFrame, min_chars: int = 200, scheme: Scheme = PRACTICAL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document that takes part: class key, number of shingles, sketch and tokens."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cols, toks = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = normal_form(t)
            codes = codes_of(s)
            sh = distinct(window_hashes(codes, 12))
            if not len(sh):
                continue
            key = np.frombuffer(class_key(s), np.int64)
            ids.append(i)
            cols.append((key[0], key[1], len(sh), *one_bit_sketch(minwise(sh))))
            toks.append(_tokens(codes, scheme).view(np.int64))
        a = np.array(cols, np.int64).reshape(len(ids), 6)
        off = np.concatenate(([0], np.cumsum([len(x) for x in toks]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), *(pa.array(a[:, k]) for k in (3, 4, 5)), lists], ["doc_id", "c1", "c2", "n12", "s1", "s2", "s3", "tokens"])

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
    return map_arrow(spread(docs), fn, _SKETCH + ", tokens array<long>")


def _agree(a: str, b: str) -> F.Column:
    same = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in (1, 2, 3)))
    return F.lit(192) - same >= LEAST_AGREEMENT


def _combined(hot: str, k: int, active: str) -> str:
    """SQL of the keys of all k-combinations of the token array hot."""
    if k == 2:
        keys = f"flatten(transform({hot}, (x, i) -> transform(slice({hot}, i + 2, size({hot})), y -> xxhash64(x, y))))"
    else:
        keys = f"flatten(transform({hot}, (x, i) -> flatten(transform(slice({hot}, i + 2, size({hot})), (y, j) -> transform(slice({hot}, i + j + 3, size({hot})), z -> xxhash64(x, y, z))))))"
    return f"transform({keys}, x -> struct(x as key, {active} as active))"


def _leveled(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n12, sketch, level, and the tokens each document looks up: rare (of the prefix of its level), hot1, hot2, hot3 (the costly ones of each level's prefix)."""
    posting = reps.select("doc_id", F.explode("tokens").alias("token"))
    df = posting.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    met = posting.join(df.hint("shuffle_merge"), "token")
    t = met.groupBy("doc_id", F.expr("token & 1").alias("family")).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    sizes = F.expr("transform(array(0L, 1L), f -> size(filter(tokens, x -> x & 1 = f)))")
    light = reps.select("doc_id", "n12", "s1", "s2", "s3", sizes.alias("sizes"))
    own = t.join(light, "doc_id").withColumn("n", F.expr("sizes[int(family)]")).withColumn("o", F.greatest(F.lit(1), F.ceil(F.col("n") * scheme.share - 1e-9)).cast("int")).where("size(t) >= o")
    own = own.withColumn("r", F.expr(f"size(filter(t, x -> x.df <= {HOT}))"))
    # what a combination of l costly tokens is likely to meet; where nearly all tokens are costly, the document is one of a large group of near copies, which share their combinations as well
    alike = "5 * (size(t) - r) >= 4 * n"
    for k in range(1, LEVELS + 1):
        length = f"(size(t) - o + {k})"
        rare = f"aggregate(slice(t, 1, least({length}, r)), 0L, (s, x) -> s + x.df)"
        own = own.withColumn(f"hot{k}", F.expr(f"if({k} <= o and {length} > r, transform(slice(t, r + 1, {length} - r), x -> x.token), array())"))
        h = f"bigint(size(hot{k}))"
        if k == 1:
            cost = f"{rare} + aggregate(slice(t, r + 1, greatest({length} - r, 0)), 0L, (s, x) -> s + x.df)"
        else:
            ways = f"{h} * ({h} - 1) div 2" if k == 2 else f"{h} * ({h} - 1) * ({h} - 2) div 6"
            offered = "" if k == 2 else " + bigint(size(hot2)) * (size(hot2) - 1) div 2"
            cost = f"if({k} > o, null, {rare} + ({ways}) * (1 + if({alike}, t[least(r, size(t) - 1)].df, {HOT // 4 ** (k - 1)})){offered})"
        own = own.withColumn(f"cost{k}", F.expr(cost))
    best = "least(" + ", ".join(f"cost{k}" for k in range(1, LEVELS + 1)) + ")"
    own = own.withColumn("level", F.expr("case " + " ".join(f"when cost{k} = {best} then {k}" for k in range(1, LEVELS + 1)) + " end"))
    own = own.withColumn("rare", F.expr("transform(slice(t, 1, least(size(t) - o + level, r)), x -> x.token)"))
    return own.select("doc_id", "n12", "s1", "s2", "s3", "level", "rare", *(F.expr(f"if(level >= {k}, hot{k}, array())").alias(f"hot{k}") for k in range(1, LEVELS + 1)))


def _candidates(reps: DataFrame, threshold: float, scheme: Scheme = PRACTICAL) -> DataFrame:
    """Pairs (a, b), a < b, of representatives that share enough prefix tokens and whose sizes (and sketches) allow the threshold."""
    keys = ["transform(rare, x -> struct(x as key, true as active))", "transform(hot1, x -> struct(x as key, level = 1 as active))", *(_combined(f"hot{k}", k, f"level = {k}") for k in range(2, LEVELS + 1))]
    rows = _leveled(reps, scheme).select("doc_id", "n12", "s1", "s2", "s3", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("k")).select("doc_id", "n12", "s1", "s2", "s3", "k.key", "k.active")
    rows = cut(rows)  # three sides of the joins below read this
    asking, offered = rows.where("active").drop("active"), rows.where("not active").drop("active")
    fit = F.least("a.n12", "b.n12") >= F.greatest("a.n12", "b.n12") * F.lit(threshold)
    if scheme.sketch:
        fit = fit & _agree("a", "b")
    # those who only offer a combination don't meet each other
    found = asking.alias("a").join(asking.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")) & fit).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
    between = asking.alias("a").join(offered.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") != F.col("b.doc_id")) & fit).select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))
    return found.union(between).distinct()


def bands_for(threshold: float, miss: float = MISS) -> int:
    """Bands of ROWS minwise values with which a pair at the threshold agrees in fewer than LEAST_BANDS of them with a probability of at most miss; a multiple of BINS / ROWS."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and be at most 1")
    p, step = threshold**ROWS, BINS // ROWS
    b = step
    while sum(comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(LEAST_BANDS)) > miss:
        b += step
    return b


def banded_signatures(df: DataFrame, threshold: float, min_chars: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document that takes part: class key, number of shingles, and the keys of its bands and its sketch as a small set, as a binned one, or both."""
    bands = bands_for(threshold)
    # two sets that reach the threshold are both small or both binned
    small, values_made = max(SMALL, int(BINNED / threshold) + 1), max(bands * ROWS, 64 * LONGS)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, sizes, found = [], [], [], ([], [], [], [])
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = normal_form(t)
            sh = distinct(window_hashes(codes_of(s), 12))
            if not len(sh):
                continue
            ids.append(i)
            keys.append(np.frombuffer(class_key(s), np.int64))
            sizes.append(len(sh))
            for k, values in enumerate((small_values(sh, values_made) if len(sh) <= small else None, binned_values(sh, values_made) if len(sh) >= BINNED else None)):
                found[k].append(None if values is None else band_hashes(values[: bands * ROWS]).tobytes())
                found[2 + k].append(None if values is None else one_bit_sketch(values[: 64 * LONGS]))
        k = np.array(keys, np.int64).reshape(len(ids), 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in found[:2]), *(pa.array(x, pa.list_(pa.int64())) for x in found[2:])], ["doc_id", "c1", "c2", "n12", "small", "binned", "small_bits", "binned_bits"])

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
    return map_arrow(spread(docs), fn, "doc_id long, c1 long, c2 long, n12 int, small binary, binned binary, small_bits array<long>, binned_bits array<long>")


def _planes(ids: np.ndarray) -> bytes:
    """Longs with their first bytes, then their second bytes, and so on: most of these repeat, and the shuffle compresses them."""
    return ids.view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _equal_keys(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ids with equal keys and sizes at most `apart` apart, the lesser first."""
    order = np.argsort(keys, kind="stable")
    keys, ids, sizes = keys[order], ids[order], sizes[order].astype(np.int16)
    at, d = np.arange(len(keys)), 0
    while len(at):
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        x = at[np.abs(sizes[at] - sizes[at + d]) <= apart]
        for i in range(0, len(x), 500_000):
            a, b = ids[x[i : i + 500_000]], ids[x[i : i + 500_000] + d]
            yield np.minimum(a, b), np.maximum(a, b)


def _banded_candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of representatives that agree in LEAST_BANDS bands and whose sizes and sketches allow the threshold. BLOCK bands of a batch of documents travel in one row."""
    bands = bands_for(threshold)
    apart = int(np.log(1 / threshold) / np.log(1.1)) + 1

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        sizes = (np.log(batch.column(1).to_numpy()) / np.log(1.1)).astype(np.uint8)
        out = []
        for kind in (0, 1):
            col = batch.column(2 + kind)
            has = col.is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                m = np.frombuffer(b"".join(x for x in col.to_pylist() if x is not None), np.uint32).reshape(-1, bands)
                own, size = _planes(ids[has]), sizes[has].tobytes()
                out += [(kind * bands + k, own, size, m[:, k : k + BLOCK].T.tobytes()) for k in range(0, bands, BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["band", "ids", "sizes", "keys"]) if out else None

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[_longs(i), np.frombuffer(n, np.uint8), np.frombuffer(k, np.uint32).reshape(BLOCK, -1)] for b in batches for i, n, k in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "keys")))]
        ids, sizes = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        held, rows = [], 0
        for k in range(BLOCK):
            for x in _equal_keys(np.concatenate([p[2][k] for p in parts]), ids, sizes, apart):
                held.append(x)
                rows += len(x[0])
                if rows >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b"])

    cut_up = map_arrow(reps.select("doc_id", "n12", "small", "binned"), blocks, "band int, ids binary, sizes binary, keys binary")
    found = cut_up.groupBy("band").applyInArrow(pairs, "a long, b long").where("a < b")
    pairs_met = found.groupBy("a", "b").agg(F.count("*").alias("agree")).where(F.col("agree") >= LEAST_BANDS).select("a", "b")
    same = (1 + threshold) / 2
    least = int(64 * LONGS * same - FAR * (64 * LONGS * same * (1 - same)) ** 0.5)
    bits = reps.select("doc_id", "small_bits", "binned_bits")
    for side in ("a", "b"):
        pairs_met = pairs_met.join(bits.select(F.col("doc_id").alias(side), F.col("small_bits").alias(f"s{side}"), F.col("binned_bits").alias(f"l{side}")), side)
    differ = lambda k: F.expr(f"aggregate(zip_with({k}a, {k}b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs_met.where(64 * LONGS - F.coalesce(differ("s"), differ("l")) >= least).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose texts' exact Jaccard similarity reaches the threshold. texts: doc_id, text in normal form or not."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        seen: dict[int, np.ndarray] = {}
        out = []
        for i, j, x, y in zip(a, b, ta, tb):
            if len(seen) > 500:
                seen.clear()
            for k, t in ((i, x), (j, y)):
                if k not in seen:
                    seen[k] = shingle_set(normal_form(t))
            out.append(jaccard(seen[i], seen[j]))
        keep = [k for k, v in enumerate(out) if v >= threshold]
        return pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), pa.array([out[k] for k in keep], pa.float64())], ["a", "b", "similarity"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    few = cut(texts.join(broadcast_if_small(ids, 1_000_000), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    both = pairs.join(few.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(few.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return map_arrow(both.select("a", "b", "ta", "tb"), fn, "a long, b long, similarity double")


def _classes(df: DataFrame, threshold: float, min_chars: int, scheme: Scheme | None) -> tuple[DataFrame, DataFrame]:
    """(representatives with signature, membership doc_id -> rep); the signatures are written once."""
    sig = cut(signatures(df, min_chars, scheme) if scheme else banded_signatures(df, threshold, min_chars))
    rep = sig.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = sig.select("doc_id", "c1", "c2").join(rep.where("copies > 1"), ["c1", "c2"]).select("doc_id", "rep").distinct()
    others = members.where("doc_id <> rep").select("doc_id")
    return sig.join(broadcast_if_small(others, 100_000), "doc_id", "left_anti"), members


def class_links(df: DataFrame, threshold: float = 0.6, min_chars: int = 200, scheme: Scheme | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between class representatives, members (doc_id, rep) of the classes of two and more."""
    reps, members = _classes(df, threshold, min_chars, scheme)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") >= min_chars)
    found = _candidates(reps, threshold, scheme) if scheme else _banded_candidates(reps, threshold)
    return verified(cut(found), texts, threshold), members


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.6, min_chars: int = 200, scheme: Scheme | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: all pairs of documents above the threshold, copies expanded."""
    links, members = class_links(df, threshold, min_chars, scheme)
    members = cut(members)
    links = links.select("a", "b")

    def expanded(side: str, at: DataFrame) -> DataFrame:
        m = members.select(F.col("rep").alias(side), F.col("doc_id").alias("m"))
        return at.join(m, side, "left").withColumn(side, F.coalesce("m", side)).drop("m")

    across = expanded("b", expanded("a", links))
    x, y = members.alias("x"), members.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    return across.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).union(within.select("a", "b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b): root is the least node of its component. Star contraction: each round hooks every node and its
    neighbours to the least of them, so the rounds grow with the logarithm of the longest chain."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: greater neighbours to the least of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours to the least
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        edges = new


def near_duplicate_groups(df: DataFrame, threshold: float = 0.6, min_chars: int = 200, scheme: Scheme | None = None) -> DataFrame:
    """One row per document of at least min_chars code points: doc_id, group_id (the least id it is linked to, over chains of links) and n_links, the links
    between different texts that its text has. Copies share their representative's group."""
    links, members = class_links(df, threshold, min_chars, scheme)
    links, members = cut(links), cut(members)
    roots = connected(links)
    count = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id").distinct()
    return (
        docs.join(members, "doc_id", "left")
        .withColumn("rep", F.coalesce("rep", "doc_id"))
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .join(count, "rep", "left")
        .select("doc_id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
