"""Exact n-gram Jaccard join by universe partition and pigeonhole, down to classes of linked documents.

Two sets of sizes r <= s with Jaccard similarity of at least t differ in at most H = floor((1-t)/(1+t) * (r+s)) tokens.
The token universe (64-bit hashes of word n-grams) is cut into m segments, m growing with the size band of the larger
set. H differences spoil at most H segments, so of any H+1 segments in which a set has tokens at least one is equal in
both sets. Each document is indexed by the contents of its first H+1 non-empty segments (in universe order) in the scheme
of its own band, and in that of the next band when a partner can be there. The allocation takes the cheapest cover in
rows: a whole segment costs one row and covers one difference; only a document whose tokens fall into too few segments
adds one-deletion neighbourhoods (segments of c >= 2 tokens: c more rows, one more difference covered), and single tokens
if even those do not suffice.

Candidates are verified exactly, in two steps that never list all pairs of a group:

1. In every bucket of equal segment contents all members are compared with one pivot; verified links join components.
   Buckets that still hold several components do so again with another pivot, a few times: that is linear in the rows of
   the buckets and joins the groups of near copies whose members differ from the first pivot. Buckets of the same members
   ask the same and are kept once, with their number as weight.
2. Only buckets that still hold several components are looked at again, with all their members. Above BLOCK members a bucket
   is not compared as a whole. A pair of its documents either shares a cold token (one that at most HOT of the documents of
   such buckets have), and then one among the first n - ceil(t n) + 1 tokens of both, cold ones first: these few tokens are
   buckets of their own. Or it shares none, and then all cold tokens of both are differences, so that at least one of the two
   is light: it has so few cold tokens that they fit in its part of H. Only light documents are compared with the members of
   their large buckets, block with block, each block of about BLOCK rows, every pair of blocks by itself and streamed.

Before a pair is verified, parity sketches are compared (one bit per token position, xor of the set): the bits in which two
sketches differ never exceed the sets' difference, so most pairs are refuted without their texts, those of step 2 inside
the task and without being emitted.

Each document is indexed by some segments more than H+1, so a linked pair meets not once but in more buckets than the
fewer of these spares. A pair (pivot, member) meets where the one is the other's pivot, and elsewhere at most as often as
either is no pivot; a member that is in fewer buckets than any of its bucket's members asks for links with none of them.
Such pairs and members are dropped by counting, before sketches are sent.

Passages that very many documents share make hot buckets. A
document whose hot buckets are no more than these extra ones is covered: H+1 of its cold buckets remain, so a partner is
met there (of two covered documents the one whose indexed range of segments ends first meets the other). In a hot bucket
step 2 therefore compares a document only if one of the pair is not covered.

Sets of equal documents are joined first, by a 128-bit hash.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import discard, durable, save_table

from .common import pick

U64 = np.uint64
SEGMENTS_PER_TOKEN = 0.38  # of the largest size of a band: enough that full-size sets have more than H+1 non-empty segments
EXTRA = 0.12  # share of segments indexed beyond H+1
KEY_BITS = 48  # of a bucket's key; two contents of one key cost a comparison, not a result
BROADCAST_ROWS = 2_000_000  # ids, 16 MB
PIVOTS = 2  # further pivots per bucket before members are compared with each other
HOT = 64  # a bucket with more members is hot
FAN = 4096  # pairs of one document that a task verifies; more are spread
BLOCK = 2048  # a bucket with more members is compared block with block
PIECE = 1 << 20  # bytes of a text hashed at a time


@dataclass(frozen=True)
class JaccardRule:
    """Similarity ``part / whole`` and the length of a shingle in words."""

    part: int = 75
    whole: int = 100
    words: int = 5

    def difference(self, sizes):
        """Most tokens in which linked sets of this total size differ."""
        return (self.whole - self.part) * sizes // (self.whole + self.part)

    @property
    def growth(self) -> Fraction:
        return Fraction(self.whole, self.part)


# ---------------------------------------------------------------- sets of one text

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(1)
def _places(count: int) -> np.ndarray:
    """An odd factor per place of a byte in its word."""
    return _mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTES = _mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FACTORS = _mix(np.arange(1, 65, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BLANK_AT = re.compile(rb"[\x20\x09-\x0D]")


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word, in order: the sum of byte values times place factors, mixed."""
    raw, out, low = np.frombuffer(bytearray(data), np.uint8), [np.zeros(0, U64)], 0
    while low < len(data):
        cut = _BLANK_AT.search(data, low + PIECE)  # a word is never cut
        high = cut.start() if cut else len(data)
        inside = np.concatenate([[False], ~_BLANK[raw[low:high]], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        lengths = edges[1::2] - edges[::2]
        if len(lengths):
            first = np.cumsum(lengths) - lengths
            place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
            factors = _places(1 << max(10, int(lengths.max()).bit_length()))
            out.append(_mix(np.add.reduceat(_BYTES[raw[low:high][inside[1:-1]]] * factors[place], first)))
        low = high
    return np.concatenate(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one shingle of all its words."""
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only, and the six blanks only
    if not len(h):
        return h
    k = min(n, len(h))
    count = len(h) - k + 1
    out = np.full(count, k, U64)
    for j in range(k):
        out += h[j:j + count] * (_FACTORS[j] if j < len(_FACTORS) else _places(1 << n.bit_length())[j])
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def band_of(sizes):
    """Band b holds the sizes in (2^(b-1), 2^b]."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype("int64")


def segments_of(band: int) -> int:
    return max(4, int(np.ceil(SEGMENTS_PER_TOKEN * (1 << band))))


def schemes(tokens: np.ndarray, rule: JaccardRule) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Per scheme this set takes part in: band, differences to cover plus one, segments to take, segment per token, first
    token of each non-empty segment."""
    n = len(tokens)
    largest = int(n * rule.growth)
    for band in range(int(band_of(n)), int(band_of(largest)) + 1):
        need = int(rule.difference(n + min(largest, 1 << band))) + 1
        segment = ((tokens >> U64(32)) * U64(segments_of(band))) >> U64(32)  # rising, as tokens are sorted
        starts = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1])
        yield band, need, need + int(EXTRA * need) + 2, segment, starts


def spare_buckets(tokens: np.ndarray, rule: JaccardRule) -> int:
    """How many buckets of this set may be hot before it is no longer covered."""
    return min((min(take, len(starts)) - need for _, need, take, _, starts in schemes(tokens, rule)), default=0)


def signatures(tokens: np.ndarray, rule: JaccardRule) -> np.ndarray:
    """Bucket keys under which this set is indexed: see the module text."""
    n = len(tokens)
    if not n:
        return np.zeros(0, "int64")
    mixed = _mix(tokens + U64(0x2545F4914F6CDD1D))
    out = []
    for band, need, take, segment, starts in schemes(tokens, rule):
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mixed, starts)
            place = _mix(segment[starts] + U64((band + 1) << 40))
            if len(starts) >= need:
                out.append(_mix(content[:take] ^ place[:take]))
                continue
            sizes = np.diff(np.append(starts, n))
            wide = np.repeat(sizes >= 2, sizes)
            out += [_mix(content ^ place), _mix((np.repeat(content, sizes)[wide] - mixed[wide]) ^ np.repeat(place, sizes)[wide])]
            if np.minimum(sizes, 2).sum() < need:
                out.append(_mix(mixed ^ _mix(np.full(n, 77 + band, U64))))
    return np.unique(np.concatenate(out) >> U64(64 - KEY_BITS)).view("int64")


def sketch_bits(n: int) -> int:
    """Bits of the parity sketch: a power of two, so that sketches of two sizes can be folded; 2 to 4 per token, and more
    for small sets, where a near miss must be told from a link by a few tokens."""
    return max(1024, 64 << max(0, int(band_of(n)) - 5))


def sketch(tokens: np.ndarray) -> bytes:
    """Bit i is the parity of the number of tokens at i."""
    bits = sketch_bits(len(tokens))
    at = np.bincount((_mix(tokens + U64(11)) & U64(bits - 1)).astype("int64"), minlength=bits) & 1
    return np.packbits(at.astype("u1"), bitorder="little").tobytes()


def fold(matrix: np.ndarray, words: int) -> np.ndarray:
    """Halve rows of 64-bit words by xor until they are ``words`` long; parities add up the same way."""
    while matrix.shape[1] > words:
        half = matrix.shape[1] // 2
        matrix = matrix[:, :half] ^ matrix[:, half:]
    return matrix


# ---------------------------------------------------------------- Spark steps

def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of the set."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(np.ascontiguousarray(tokens)))


def _describe(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["row"].tolist(), batch["_text"].tolist()):
                tokens = shingle_set(text if isinstance(text, str) else None, rule.words)
                if len(tokens):
                    rows.append((key, len(tokens), *set_key(tokens), spare_buckets(tokens, rule), sketch(tokens)))
                else:
                    rows.append((key, 0, 0, 0, 0, None))
            yield pd.DataFrame(rows, columns=["row", "n", "k1", "k2", "spare", "sketch"])

    return run


def _index(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # sets this task has indexed already; copies need no second index
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch["row"].tolist(), batch["_text"].tolist()):
                tokens = shingle_set(text if isinstance(text, str) else None, rule.words)
                if not len(tokens) or (name := set_key(tokens)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                keys.append(signatures(tokens, rule))
                rows.append(np.full(len(keys[-1]), key, "int64"))
            if keys:
                yield pd.DataFrame({"sig": np.concatenate(keys), "row": np.concatenate(rows)})

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


BUCKETS = "sig long, pivot long, row long, members array<long>"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, row) sorted by sig: the buckets of two and more. Of two members: a row without a sig (-1); of up to BLOCK:
    a row with its sorted members; of more: a row per member, the pivot too, as they come."""
    names = ["sig", "pivot", "row", "members"]

    def single(sig, pivot, row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(pivot, pa.int64()), pa.array(row, pa.int64()), pa.nulls(len(row), pa.list_(pa.int64()))], names=names)

    def whole(sig: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = _runs(sig)
        counts = np.diff(cuts)
        many = np.repeat(counts > 1, counts)
        sig, row, counts = sig[many], row[many], counts[counts > 1]
        row = row[np.lexsort((row, sig))]
        first = np.cumsum(counts) - counts
        two = first[counts == 2]
        if len(two):
            yield single(np.full(len(two), -1), row[two], row[two + 1])
        more = counts > 2
        if more.any():
            at = first[more]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[more])]), pa.int32()), pa.array(row[np.repeat(more, counts)], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(row[at]), pa.array(np.full(len(at), -1)), lists], names=names)

    sig, row, large = np.zeros(0, "i8"), np.zeros(0, "i8"), None  # the last bucket so far; the key and pivot of a large one
    for batch in batches:
        sig, row = np.concatenate([sig, batch["sig"].to_numpy()]), np.concatenate([row, batch["row"].to_numpy()])
        if large and len(sig):
            end = int(np.searchsorted(sig, large[0], "right"))
            yield single(sig[:end], np.full(end, large[1]), row[:end])
            sig, row = sig[end:], row[end:]
            large = None if len(sig) else large
        if not len(sig):
            continue
        last = int(np.searchsorted(sig, sig[-1]))
        yield from whole(sig[:last], row[:last])
        sig, row = sig[last:], row[last:]
        if len(sig) > BLOCK:
            large = (int(sig[0]), int(row.min()))
            yield single(sig, np.full(len(sig), large[1]), row)
            sig, row = sig[:0], row[:0]
    yield from whole(sig, row)


def _intersections(left: np.ndarray, right: np.ndarray) -> int:
    return len(np.intersect1d(left, right, assume_unique=True))


def _verify(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (a, b), the row of a itself first; texts of a group come one by one, only a's set is held."""
        now, base = None, None
        for batch in batches:
            links = []
            for a, b, text in zip(batch["a"].tolist(), batch["b"].tolist(), batch["_text"].tolist()):
                tokens = shingle_set(text, rule.words)
                if a == b:
                    now, base = a, tokens
                elif a == now:
                    both = _intersections(base, tokens)
                    if rule.whole * both >= rule.part * (len(base) + len(tokens) - both):
                        links.append((a, b))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which each sketch of ``x`` differs from each of ``y``, all folded to the shortest."""
    words = min(map(len, [*x, *y])) // 8
    fx, fy = (np.vstack([fold(np.frombuffer(s, "<u8")[None, :], words) for s in side]) for side in (x, y))
    out = np.zeros((len(x), len(y)), "int32")
    for w in range(words):
        out += np.bitwise_count(fx[:, w, None] ^ fy[None, :, w])
    return out


def _differences(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which the sketches of each pair differ, folded to the shorter of the two."""
    words = np.minimum([len(s) // 8 for s in x], [len(s) // 8 for s in y]) if x else np.zeros(0, int)
    out = np.zeros(len(x), "int64")
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        for lo in range(0, len(at), 4096):
            some = at[lo:lo + 4096]
            fx, fy = (np.vstack([fold(np.frombuffer(side[k], "<u8")[None, :], w) for k in some]) for side in (x, y))
            out[some] = np.bitwise_count(fx ^ fy).sum(1, dtype="i8")
    return out


def _not_refuted(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            na, nb = batch["na"].to_numpy("i8"), batch["nb"].to_numpy("i8")
            batch = batch[rule.part * np.maximum(na, nb) <= rule.whole * np.minimum(na, nb)]
            apart = _differences(batch["sa"].tolist(), batch["sb"].tolist())
            yield batch.loc[apart <= rule.difference(batch["na"].to_numpy("i8") + batch["nb"].to_numpy("i8")), ["a", "b"]]

    return run


def _cross_pairs(rule: JaccardRule, block: int = 512):
    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        hot = len(rows) > HOT
        rows = rows.sort_values("n", kind="stable")
        ids, comps, sizes, covered, sketches = rows["row"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy(), rows["covered"].to_numpy(), rows["sketch"].tolist()
        # One of a pair is outside the largest component, and in a hot bucket one is not covered: the fewer rows lead.
        names, counts = np.unique(comps, return_counts=True)
        outside = comps != names[counts.argmax()]
        first = np.flatnonzero(~covered if hot and (~covered).sum() < outside.sum() else outside)
        for lo in range(0, len(first), block):
            x = first[lo:lo + block]
            low, high = int(-(-sizes[x[0]] // rule.growth)), int(sizes[x[-1]] * rule.growth)
            for lo2 in range(int(np.searchsorted(sizes, low)), int(np.searchsorted(sizes, high, "right")), block):
                y = np.arange(lo2, min(lo2 + block, len(ids)))
                different = comps[x][:, None] != comps[None, y]
                if hot:
                    different &= ~(covered[x][:, None] & covered[None, y])
                if not different.any():
                    continue
                ok = different & (_apart([sketches[i] for i in x], [sketches[i] for i in y]) <= rule.difference(sizes[x][:, None] + sizes[None, y]))
                ok &= rule.part * np.maximum(sizes[x][:, None], sizes[None, y]) <= rule.whole * np.minimum(sizes[x][:, None], sizes[None, y])
                i, j = np.nonzero(ok)
                if len(i):
                    a, b = ids[x[i]], ids[y[j]]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def cold(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All pairs of many small buckets at once: rows at distance 1, 2, ... that have the same sig."""
        sig, ids, comps, sizes = (rows[c].to_numpy() for c in ("sig", "row", "comp", "n"))
        found = []
        for d in range(1, HOT):
            i = np.flatnonzero(sig[d:] == sig[:-d])
            if not len(i):
                break
            j = i + d
            ok = (comps[i] != comps[j]) & (rule.part * np.maximum(sizes[i], sizes[j]) <= rule.whole * np.minimum(sizes[i], sizes[j]))
            found.append(np.stack([i[ok], j[ok]]))
        if not found:
            return
        i, j = np.concatenate(found, 1)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)  # a pair meets in many buckets
        i, j, a, b = i[once], j[once], a[once], b[once]
        sketches = rows["sketch"].tolist()
        ok = _differences([sketches[k] for k in i], [sketches[k] for k in j]) <= rule.difference(sizes[i].astype("i8") + sizes[j])
        yield pd.DataFrame({"a": a[ok], "b": b[ok]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by sig: every pair of a bucket from two components that no bound refutes."""
        held: list[pd.DataFrame] = []  # parts of the bucket that the next batch may go on with

        def settle(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cuts = _runs(rows["sig"].to_numpy())
            counts = np.diff(cuts)
            large = counts > HOT
            yield from cold(rows[np.repeat(~large, counts)])
            for k in np.flatnonzero(large):
                yield from pairs(rows.iloc[cuts[k]:cuts[k + 1]])

        for batch in batches:
            sig = batch["sig"].to_numpy()
            if held and held[0]["sig"].iloc[0] == sig[0] == sig[-1]:
                held.append(batch)
                continue
            last = int(np.flatnonzero(sig != sig[-1])[-1]) + 1 if sig[0] != sig[-1] else 0
            if held or last:
                yield from settle(pd.concat([*held, batch.iloc[:last]]))
            held = [batch.iloc[last:]]
        if held:
            yield from settle(pd.concat(held))

    return run


def _tokens(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.iloc[lo:lo + 500]
                sets = [shingle_set(text if isinstance(text, str) else None, rule.words) for text in some["_text"].tolist()]
                yield pd.DataFrame({"sig": np.concatenate(sets).view("int64"), "row": np.repeat(some["row"].to_numpy("i8"), [len(x) for x in sets])})

    return run


def _block_pairs(rule: JaccardRule, step: int = 512):
    def compare(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(x), step):
            for lo2 in range(0, len(y), step):
                u, v = x.iloc[lo:lo + step], y.iloc[lo2:lo2 + step]
                n, m, cu, cv = u["n"].to_numpy("i8")[:, None], v["n"].to_numpy("i8")[None], u["cold"].to_numpy("i8")[:, None], v["cold"].to_numpy("i8")[None]
                most = rule.difference(n + m)
                ok = (u["comp"].to_numpy()[:, None] != v["comp"].to_numpy()[None]) & (cu + cv <= most) & (rule.part * np.maximum(n, m) <= rule.whole * np.minimum(n, m))
                ok &= ~(u["covered"].to_numpy(bool)[:, None] & v["covered"].to_numpy(bool)[None])
                if not ok.any():
                    continue
                i, j = np.nonzero(ok & (_apart(u["sketch"].tolist(), v["sketch"].tolist()) <= most))
                a, b = u["row"].to_numpy()[i], v["row"].to_numpy()[j]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (block, right): the left rows of a pair of blocks are held, the right ones stream past them."""
        now, left = None, []
        for batch in batches:
            cuts = _runs(batch["block"].to_numpy() * 2 + batch["right"].to_numpy("i8"))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows = batch.iloc[lo:hi]
                if rows["block"].iloc[0] != now:
                    now, left = rows["block"].iloc[0], []
                if not rows["right"].iloc[0]:
                    left.append(rows)
                elif left:
                    left = [pd.concat(left)]
                    yield from compare(left[0], rows)

    return run


def _blocks(rows: DataFrame, rule: JaccardRule) -> DataFrame:
    """Rows of large buckets (sig, row, comp, n, covered, cold, sketch), repeated for each pair of blocks they take part in.

    A bucket is cut by kind (light or not, in its largest component or not), by size band (linked sizes are at most one
    band apart) and by a salt of the row. Two that are not light, or two of the largest component, need not meet.
    """
    sizes = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("sig").agg(F.max(F.struct("_n", "comp")).alias("_m")).select("sig", F.col("_m.comp").alias("_main"))
    light = (rule.whole - rule.part) * F.col("n") >= (rule.whole + rule.part) * F.col("cold")
    own = rows.join(main, "sig").withColumns({
        "kind": light.cast("int") * 2 + (F.col("comp") != F.col("_main")).cast("int"),
        "band": F.floor(F.log(F.col("n").cast("double")) / math.log(float(rule.growth) * 1.001))}).drop("_main")
    groups = durable(own.groupBy("sig", "kind", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k")), "groups")
    x, y = (groups.select("sig", *[F.col(c).alias(c + side) for c in ("kind", "band", "k")]) for side in ("1", "2"))
    meets = x.join(y, "sig").filter("abs(band1 - band2) <= 1 AND (kind1 >= 2 OR kind2 >= 2) AND (kind1 % 2 = 1 OR kind2 % 2 = 1)")
    meets = meets.filter("kind1 < kind2 OR (kind1 = kind2 AND band1 <= band2)").withColumn("same", F.expr("kind1 = kind2 AND band1 = band2"))
    sides = []
    for mine, right, salts, others in (("1", False, ("s", "o"), "sequence(if(same, s, 0L), k2 - 1)"), ("2", True, ("o", "s"), "sequence(0L, if(same, s, k1 - 1))")):
        placed = own.join(meets.withColumnsRenamed({"kind" + mine: "kind", "band" + mine: "band"}), ["sig", "kind", "band"])
        placed = placed.withColumnsRenamed({"kind": "kind" + mine, "band": "band" + mine}).withColumn("s", F.pmod(F.xxhash64("row", F.lit(5)), F.col("k" + mine)))
        block = F.shiftright(F.xxhash64("sig", "kind1", "band1", salts[0], "kind2", "band2", salts[1]), 1)
        sides.append(placed.withColumn("o", F.explode(F.expr(others))).select(
            block.alias("block"), F.lit(right).alias("right"), "row", "comp", "n", "covered", "cold", "sketch"))
    return sides[0].unionByName(sides[1])


def _only_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Without the texts of other rows, if that needs no shuffle of texts; the join that follows does it all anyway."""
    return texts.join(F.broadcast(wanted), "row", "left_semi") if wanted.count() <= BROADCAST_ROWS else texts


def _links(pairs: DataFrame, texts: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a < b) whose sets really link; each text is sent once per pair it is second in, and as first once per FAN pairs."""
    asked = durable(pairs.union(pairs.select("a", F.col("a").alias("b"))).distinct(), "asked")
    texts = _only_of(texts, asked.select(F.col("b").alias("row")).distinct())
    heavy = durable(asked.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("_k")).filter("_k > 1"), "heavy")
    spread = asked.join(F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy, "a", "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long")))
    spread = spread.select("a", "b", F.explode(F.expr("if(a = b, sequence(0L, _k - 1), array(pmod(xxhash64(b), _k)))")).alias("_salt"))
    sent = spread.join(texts.select(F.col("row").alias("b"), "_text"), "b").select("a", "b", "_salt", "_text")
    ordered = (sent.repartition("a", "_salt").withColumn("_other", F.col("a") != F.col("b"))
               .sortWithinPartitions("a", "_salt", "_other", "b").select("a", "b", "_text"))
    return ordered.mapInPandas(_verify(rule), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, comp) of every row that has a link, comp being the smallest row reachable.

    Each round sends every row to the smallest label among its neighbours and then to that label's own label, which
    halves the depth of label chains; it ends when no label changes. Rounds are stored, nothing comes to the driver but
    a count.
    """
    both = durable(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "links")
    labels, path = save_table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        lowered = labels.join(near, "x").select("x", F.least("l", "m").alias("l2"), "l")
        # hooking: the old label's root also learns the smaller label
        hooks = lowered.filter("l2 < l").groupBy(F.col("l").alias("x")).agg(F.min("l2").alias("h"))
        hooked = lowered.join(hooks, "x", "left").select("x", F.least("l2", F.coalesce("h", "l2")).alias("l2"), "l")
        jump = hooked.select(F.col("x").alias("l2"), F.col("l2").alias("j"))
        nxt, nxt_path = save_table(hooked.join(jump, "l2", "left").select("x", F.least("l2", F.coalesce("j", "l2")).alias("l"), F.col("l").alias("old")), "labels")
        changed = nxt.filter("l <> old").limit(1).count()
        discard(labels.sparkSession, path)
        labels, path = nxt.select("x", "l"), nxt_path
        if not changed:
            return labels.select(F.col("x").alias("row"), F.col("l").alias("comp"))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """The table with a number per row, stored once so that every later step sees the same numbers."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def jaccard_classes(docs: DataFrame, rule: JaccardRule = JaccardRule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row.

    Null and empty texts have no shingles and are linked with nothing; equal sets are linked; repeated rows (same doc_id)
    each get a row, of one component when their texts are equal or linked; rows with a null doc_id are not joined and get
    a null component; an empty table gives no rows.
    """
    rows = numbered(pick(docs, doc_id=doc_id, _text=text), "row")
    known = rows.filter("doc_id IS NOT NULL")
    described, final = linked_rows(known.select("row", "_text"), rule)
    placed = final.join(known.select("row", "doc_id"), "row")
    lowest = durable(placed.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "lowest")
    lowest = F.broadcast(lowest) if lowest.count() <= BROADCAST_ROWS else lowest
    named = final.join(lowest, "comp").select("row", "component_id")
    return (described.join(known.select("row", "doc_id"), "row").join(named, "row", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
            .unionByName(rows.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("n_shingles"),
                                                              F.lit(None).cast("long").alias("component_id"))))


def linked_rows(known: DataFrame, rule: JaccardRule = JaccardRule()) -> tuple[DataFrame, DataFrame]:
    """Of stored rows (row, _text) with distinct numbers: (row, n, ...) of each, and (row, comp) of each that has a link."""
    described = durable(known.mapInPandas(_describe(rule), "row long, n int, k1 long, k2 long, spare int, sketch binary"), "sets")
    sized = described.filter("n > 0")

    # Equal sets: the smallest row stands for all.
    heads = (sized.groupBy("k1", "k2").agg(F.min("row").alias("head"), F.max("row").alias("_last"))
             .filter("head <> _last").select("k1", "k2", "head"))
    copies = durable(sized.select("row", "k1", "k2").join(heads, ["k1", "k2"]).filter("row <> head").select("row", "head").distinct(), "copies")

    def to_head(df: DataFrame, column: str) -> DataFrame:
        other = copies.select(F.col("row").alias(column), F.col("head").alias("_head"))
        return df.join(other, column, "left").withColumn(column, F.coalesce("_head", column)).drop("_head")

    keyed = known.mapInPandas(_index(rule), "sig long, row long")
    buckets = durable(keyed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_buckets, BUCKETS), "buckets")
    facts = sized.select("row", "n", "sketch")
    texts = known.select("row", "_text")

    # Buckets of equal members are one bucket of that weight. k: members without the pivot, of large ones at least BLOCK.
    equal = buckets.filter("members IS NOT NULL").groupBy("members").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("w"))
    members = durable(equal.select("sig", "w", (F.size("members") - 1).alias("k"), F.col("members")[0].alias("pivot"), F.explode("members").alias("row")).unionByName(
        buckets.filter("members IS NULL AND sig >= 0").select("sig", F.lit(1).cast("long").alias("w"), F.lit(BLOCK).alias("k"), "pivot", "row")), "members")
    spokes = durable(buckets.filter("sig < 0").groupBy("pivot", "row").agg(F.count(F.lit(1)).alias("c")).unionByName(
        members.filter("row <> pivot").groupBy("pivot", "row").agg(F.sum("w").alias("c"))).groupBy("pivot", "row").agg(F.sum("c").alias("c")), "spokes")
    # Of each row: its buckets of three and more, those of them that are hot, and all buckets in which it is not the pivot
    # (large ones have any member as pivot, so they count in any case).
    counts = members.groupBy("row").agg(
        F.sum("w").alias("t"), F.sum(F.when(F.col("k") >= HOT, F.col("w")).otherwise(0)).alias("hot"),
        F.sum(F.when((F.col("k") >= BLOCK) & (F.col("row") == F.col("pivot")), F.col("w")).otherwise(0)).alias("leads"))
    about = durable(sized.select("row", "n", "spare").join(counts, "row", "left").join(spokes.groupBy("row").agg(F.sum("c").alias("h")), "row", "left")
                    .fillna(0, ["t", "hot", "leads", "h"]).select("row", "n", "spare", "t", (F.col("h") + F.col("leads")).alias("h"),
                                                                  ((F.col("hot") == 0) | (F.col("hot") <= F.col("spare"))).alias("covered")), "about")

    def possible(pairs: DataFrame, meetings) -> DataFrame:
        """Pairs (pivot, row) of fitting sizes that may meet in more buckets than the fewer of their spares."""
        for side, key in (("a", "pivot"), ("b", "row")):
            pairs = pairs.join(about.select(F.col("row").alias(key), *[F.col(c).alias(c + side) for c in ("n", "spare", "t", "h")]), key)
        fits = rule.part * F.greatest("na", "nb") <= rule.whole * F.least("na", "nb")
        return pairs.filter(fits & (meetings > F.least("sparea", "spareb"))).select("pivot", "row")

    # Step 1: every member of a bucket against a pivot, first the smallest row, then others.
    def really(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a < b)."""
        with_a = pairs.join(facts.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        with_b = with_a.join(facts.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        return durable(_links(durable(with_b.mapInPandas(_not_refuted(rule), "a long, b long"), "pairs"), texts, rule), "links")

    def linked_to(pairs: DataFrame) -> DataFrame:
        """Links among (pivot, row) pairs."""
        first = to_head(to_head(pairs.select(F.col("pivot").alias("a"), F.col("row").alias("b")), "a"), "b")
        first = first.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return really(first)

    def labelled(df: DataFrame, comps: DataFrame) -> DataFrame:
        label = comps.select(F.col("row").alias("_h"), "comp")
        return to_head(df.withColumn("_h", F.col("row")), "_h").join(label, "_h", "left").withColumn("comp", F.coalesce("comp", "_h")).drop("_h")

    links = linked_to(possible(spokes, F.col("c") + F.least("ha", F.col("hb") - F.col("c"))))
    comps = durable(components(links), "comps")

    # Two that no bucket has as pivot and member meet in buckets of three and more only.
    counted = members.select("sig", "k", "row").join(about.select("row", "spare", "t", "covered"), "row")
    few = counted.groupBy("sig").agg(F.min("spare").alias("_s"))
    active = durable(counted.join(few, "sig").filter("t > _s").select("sig", "k", "row", "covered"), "active")

    def still_mixed(comps: DataFrame) -> DataFrame:
        """Members, with their components, of buckets that hold several; they only get fewer."""
        now = labelled(active, comps)
        sigs = now.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).cast("int").alias("size")).filter("_lo <> _hi")
        return durable(now.join(sigs.select("sig", "size"), "sig"), "active")

    for turn in range(PIVOTS):
        mixed = still_mixed(comps)
        active = mixed.select("sig", "k", "row", "covered")
        chosen = mixed.filter("size > 2").groupBy("sig").agg(F.min(F.struct(
            F.xxhash64("row", F.pmod("sig", F.lit(4)), F.lit(turn)).alias("h"), F.col("row").alias("pivot"), F.col("comp").alias("_c"))).alias("_p"))
        again = mixed.join(chosen.select("sig", "_p.pivot", "_p._c"), "sig").filter("comp <> _c").select("pivot", "row").distinct()
        links = durable(links.union(linked_to(possible(again, F.least("ta", "tb")))), "links")
        comps = durable(components(links), "comps")

    # Step 2: buckets whose members are still apart.
    mixed = still_mixed(comps)
    wanted = mixed.groupBy("sig").agg(F.max(~F.col("covered") | (F.col("k") < HOT)).alias("_w")).filter("_w").select("sig")
    full = mixed.join(wanted, "sig", "left_semi")
    bounded = full.filter(F.col("size") <= BLOCK).join(facts, "row").select("sig", "row", "comp", "n", "covered", "sketch")
    second = durable(bounded.repartition("sig").sortWithinPartitions("sig").mapInPandas(_cross_pairs(rule), "a long, b long").distinct(), "pairs")
    more = durable(_links(second, texts, rule), "links")
    large = durable(to_head(full.filter(F.col("size") > BLOCK), "row").select("sig", "row", "comp", "covered").distinct(), "large")
    if large.limit(1).count():
        more = more.union(_large_links(large, facts, texts, rule, really))

    all_links = links.union(more).union(copies.select(F.col("head").alias("a"), F.col("row").alias("b")))
    return described, components(all_links)


def _large_links(large: DataFrame, facts: DataFrame, texts: DataFrame, rule: JaccardRule, really) -> DataFrame:
    """Links between components among the rows of large buckets (sig, row, comp, covered): by cold tokens, then by blocks."""
    rows = durable(large.select("row", "comp").distinct().join(facts.select("row", "n"), "row"), "members")
    tokens = durable(_only_of(texts, rows.select("row")).join(rows.select("row"), "row", "left_semi").select("row", "_text")
                     .mapInPandas(_tokens(rule), "sig long, row long"), "tokens")
    common = durable(tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT).select("sig"), "common")
    cold = tokens.join(F.broadcast(common) if common.count() <= BROADCAST_ROWS else common, "sig", "left_anti")
    held = durable(cold.groupBy("row").agg(F.sort_array(F.collect_list("sig")).alias("_cold")).join(rows, "row").select(
        "row", "comp", "n", F.size("_cold").alias("cold"),
        F.slice("_cold", F.lit(1), (F.col("n") - F.ceil(rule.part * F.col("n") / rule.whole) + 1).cast("int")).alias("_first")), "cold")
    first = held.select(F.explode("_first").alias("sig"), "row", "comp", "n")
    x, y = (first.select("sig", *[F.col(c).alias(name + c) for c in ("row", "comp", "n")]) for name in ("a_", "b_"))
    near = x.join(y, "sig").filter((F.col("a_row") < F.col("b_row")) & (F.col("a_comp") != F.col("b_comp"))
                                   & (rule.part * F.greatest("a_n", "b_n") <= rule.whole * F.least("a_n", "b_n")))
    by_token = really(near.select(F.col("a_row").alias("a"), F.col("b_row").alias("b")).distinct())

    counted = rows.join(held.select("row", "cold"), "row", "left").select("row", "n", F.coalesce("cold", F.lit(0)).alias("cold"))
    few = (rule.whole - rule.part) * (F.col("n") + F.ceil(F.col("n") * rule.whole / rule.part)) >= (rule.whole + rule.part) * F.col("cold")
    inside = durable(large.join(counted.filter(few), "row"), "inside")
    blocks = _blocks(inside.join(facts.select("row", "sketch"), "row"), rule)
    found = blocks.repartition("block").sortWithinPartitions("block", "right").mapInPandas(_block_pairs(rule), "a long, b long")
    return by_token.union(durable(_links(durable(found.distinct(), "pairs"), texts, rule), "links"))
