"""Byte-level byte-pair encoding with a rank queue, and decoding.

The merge loop of one pre-token keeps its symbols in a linked list and its candidate merges in a queue over merge ranks:
a three-level bitmap says which ranks have candidates, find-first-set on the levels gives the lowest rank in constant
time, and a rank's bucket is a heap of list positions, so that the leftmost pair of the lowest rank merges next. Entries
are never removed when a neighbour merges first; an entry whose pair no longer has the bucket's rank is skipped. The cost
per merge does not grow with the pre-token's length, so a pre-token of a megabyte is as cheap per byte as a short one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import Generations, pick

NONE = 1 << 30
CACHE_PIECES = 250_000


class RankQueue:
    """Positions queued by rank; ``pop`` gives the leftmost position of the lowest rank."""

    __slots__ = ("top", "middle", "low", "buckets")

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self.low = [0] * words
        self.middle = [0] * ((words + 63) // 64)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        if not self.low[word]:
            group = word >> 6
            if not self.middle[group]:
                self.top |= 1 << group
            self.middle[group] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def lowest(self) -> int:
        """The lowest rank with a bucket; -1 if there is none."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        m = self.middle[group]
        word = (group << 6) + (m & -m).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Drop the empty bucket of a rank."""
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            group = word >> 6
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)


class Bpe:
    """Ranks of byte strings, and the encoding of one pre-token with them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)  # empty between pre-tokens

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: in each, merge the pair of lowest rank, leftmost first, until no pair has a rank.

        The pre-tokens lie in one linked list with barriers between them and share the queue; they do not affect each
        other, as a merge only looks at its own neighbours.
        """
        get = self.ranks.get
        out: list = [get(p) for p in pieces]
        out = [None if r is None else [r] for r in out]
        work = [p for p, r in zip(pieces, out) if r is None and p]
        if not work:
            return [r or [] for r in out]
        data, n = b"".join(work), sum(map(len, work))
        end = list(range(1, n + 1))  # the symbol at i spans data[i:end[i]]; end[i] is also the next position
        before = list(range(-1, n))
        pair = [get(data[i:i + 2], NONE) for i in range(n)]  # rank of the symbol at i with the next
        limit: list[int] = []  # end of the pre-token around i
        for p in work:
            before[len(limit)] = -1
            stop = len(limit) + len(p)
            pair[stop - 1] = NONE
            limit += [stop] * len(p)
        queue = self.queue
        buckets, push = queue.buckets, queue.push
        for i, r in enumerate(pair):
            if r != NONE:
                push(r, i)
        while (rank := queue.lowest()) >= 0:
            bucket, lower = buckets[rank], False
            while bucket and not lower:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale: the pair at i has changed
                gone = end[i]
                after = end[i] = end[gone]
                pair[gone] = NONE
                if after < limit[i]:
                    before[after] = i
                    r = pair[i] = get(data[i:end[after]], NONE)
                    if r != NONE:
                        push(r, i)
                        lower = r < rank
                else:
                    pair[i] = NONE
                p = before[i]
                if p >= 0:
                    r = get(data[p:after], NONE)
                    if r != pair[p]:
                        pair[p] = r
                        if r != NONE:
                            push(r, p)
                            lower = lower or r < rank
            if not bucket:
                queue.close(rank)
        ranks, at, made = self.ranks, 0, iter(work)
        for k, r in enumerate(out):
            if r is None:
                ids = []
                if pieces[k]:
                    stop = at + len(next(made))
                    while at < stop:
                        to = end[at]
                        ids.append(ranks[data[at:to]])
                        at = to
                out[k] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


class TextBpe:
    """Whole texts: the pattern cuts pre-tokens; each distinct one is encoded once while it stays in the bounded cache.

    A text is first cut before single blanks that a visible character follows, where the pattern always cuts too; other
    texts go to the pattern whole.
    """

    def __init__(self, path: str, pattern: str, cache: int = CACHE_PIECES):
        self.bpe, self.pattern = Bpe.from_file(path), regex.compile(pattern)
        self.unsafe = regex.compile(r" (?=\s|$)")
        self.pieces = Generations(lambda new: self.bpe.encode_all([p.encode() for p in new]), cache)
        self.chunks = Generations(self._chunks, cache * 3 // 2)

    def _finish(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), self.bpe.decode(ids)

    def _chunks(self, chunks: list[str]) -> list[tuple[int, str, bytes]]:
        """Chunks led by a blank, cut as one text: a pre-token that begins with the blank begins a chunk."""
        found = self.pattern.findall(" " + " ".join(chunks))
        out: list[list[int]] = []
        for p, ids in zip(found, self.pieces.values(found)):
            if p[0] == " ":
                out.append(ids)
            else:
                out[-1] = out[-1] + ids
        if len(out) != len(chunks):
            raise ValueError("a chunk was not cut at its blank")
        return list(map(self._finish, out))

    def split(self, text: str) -> list[int]:
        found = self.pattern.findall(text)
        return [i for ids in self.pieces.values(found) for i in ids] if found else []

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded bytes."""
        heads: list[list] = []
        led: list[list[str]] = []
        for text in texts:
            first, rest = "", []
            if text and self.unsafe.search(text):
                first = text
            elif text:
                first, *rest = text.split(" ")
            heads.append([self._finish(self.split(first))] if first else [])
            led.append(rest)
        flat = self.chunks.values([c for rest in led for c in rest])
        out, at = [], 0
        for head, rest in zip(heads, led):
            parts = head + flat[at:at + len(rest)]
            at += len(rest)
            ids = ",".join([p[1] for p in parts])
            out.append((sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()))
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return self.digests([text])[0]


_CODERS: dict[tuple[str, str], TextBpe] = {}


def coder(path: str, pattern: str) -> TextBpe:
    """The worker's encoder; it outlives tasks, as Spark reuses Python workers."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TextBpe(path, pattern)
    return _CODERS[path, pattern]


def _some(texts: list[str | None], chars: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters, one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the token ids (array of ints) of every whole text; a null text has none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = coder(ranks_file, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "ids": [encode.split(t) if isinstance(t, str) else [] for t in batch["_text"].tolist()]})

    return pick(docs, doc_id=doc_id, _text=text).mapInPandas(run, "doc_id long, ids array<int>")


def digest_texts(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no ids, digests of nothing); repeated rows each get a row; an empty table gives none.
    Row by row and without a shuffle; each worker holds two bounded caches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = coder(ranks_file, pattern)
        for batch in batches:
            rows = []
            for some in _some([t if isinstance(t, str) else None for t in batch["_text"].tolist()]):
                rows += encode.digests(some)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [r[0] for r in rows],
                                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return pick(docs, doc_id=doc_id, _text=text).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
