"""Best-fit-decreasing packing of token ids into windows of a fixed length.

A document that is longer than a window is first cut into full windows, each a sequence of its own. The remainders of a
partition, longest first, go to the open window with the least room that still holds them; a segment tree over remaining
capacities finds it in a few steps. What stays open at the end is filled up by cutting: the pieces of the emptiest
windows are poured into the room of the others.

Every partition of the input packs on its own, so nothing is shuffled, a lost task is simply run again with the same
result, and the remainders of one partition (less than a window per document, two bytes an id where the vocabulary allows) are all that is held at once.
A partition leaves at most one window unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick
from .tokens import encoder

SEQUENCE_BITS = 33  # sequence_id: number of the partition above, number of the sequence in it below


class CapacityTree:
    """Counts of open windows per remaining capacity 1..size, with "least capacity >= n that has one" in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of at least ``need``; None if there is none."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first right neighbour with windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def pack(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items with these lengths; sequences count from 0, offsets are gapless."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    n = 0
    for item, length in enumerate(lengths):
        full = length // window
        for k in range(full):
            pieces.append((item, k * window, window, n, 0))
            n += 1
        if length % window:
            rest.append((length % window, item, full * window))
    rest.sort(key=lambda r: (-r[0], r[1]))
    tree, held, first = CapacityTree(window), {}, n
    for length, item, start in rest:
        found = tree.take(length)
        if found is None:
            room, w = window, n
            held[w] = []
            n += 1
        else:
            room, w = found
        held[w].append((item, start, length))
        if room > length:
            tree.put(room - length, w)
    pieces += _settle(held, window, first)
    return pieces


def _settle(held: dict[int, list[tuple[int, int, int]]], window: int, first: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pour the emptiest windows into the room of the fullest, cutting pieces, and number what remains from ``first`` on."""
    fill = {w: sum(p[2] for p in parts) for w, parts in held.items()}
    order = sorted(held, key=lambda w: (-fill[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        room, donor = window - fill[order[i]], held[order[j]]
        if room == 0:
            i += 1
        elif not donor:
            j -= 1
        else:
            item, start, length = donor.pop()
            cut = min(room, length)
            held[order[i]].append((item, start + length - cut, cut))
            if cut < length:
                donor.append((item, start, length - cut))
            fill[order[i]] += cut
            fill[order[j]] -= cut
    numbers = {w: first + k for k, w in enumerate(w for w in sorted(held) if held[w])}
    for w, parts in held.items():
        offset = 0
        for item, start, length in parts:
            yield item, start, length, numbers[w], offset
            offset += length


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded as the library does by default, so an added token spelled out in a text becomes that token. A null or
    empty text is one piece holding just ``end_id``; a null id stays null; repeated rows are packed each; an empty table
    gives no pieces. ``sequence_id`` is unique over partitions, not dense. Ids leave the task only as the
    checksum of each piece (unsigned crc32 of little-endian 32-bit ids).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_file)
        kept = "<u2" if max(len(encode.led) - 1, end_id) < 1 << 16 else "<u4"
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        end = int(end_id).to_bytes(4, "little")
        ids: list = []
        lengths: list[int] = []
        tails: list[bytes] = []
        serial = 0
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for key, words in zip(batch["doc_id"].astype("Int64"), batch["_text"].tolist()):
                raw = (encode.ids(words) if isinstance(words, str) else b"") + end
                total = len(raw) // 4
                cut = total - total % window
                for start in range(0, cut, window):
                    rows.append((key, start, window, zlib.crc32(raw[4 * start:4 * (start + window)]), total, base + serial, 0))
                    serial += 1
                if cut < total:
                    ids.append((key, cut, total))
                    lengths.append(total - cut)
                    tails.append(np.frombuffer(raw, "<u4", offset=4 * cut).astype(kept).tobytes())
            if rows:
                yield _frame(rows, columns)
        rows = []
        places = pack(lengths, window)
        places.sort()
        now, tail = -1, b""
        for item, start, length, sequence, offset in places:
            if item != now:
                now, tail = item, np.frombuffer(tails[item], kept).astype("<u4").tobytes()
            key, cut, total = ids[item]
            rows.append((key, cut + start, length, zlib.crc32(tail[4 * start:4 * (start + length)]), total, base + serial + sequence, offset))
            if len(rows) == 10_000:
                yield _frame(rows, columns)
                rows = []
        if rows:
            yield _frame(rows, columns)

    return pick(docs, doc_id=doc_id, _text=text).mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
    return out
