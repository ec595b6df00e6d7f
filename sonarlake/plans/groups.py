"""Work inside groups that are small by nature, such as the boxes of one image.

Rows of different keys never meet, so a key with few rows is shuffled once and worked on by the task that holds it, many
keys at a time in NumPy. Keys with more rows than ``SMALL`` are handed back to be joined by distributed means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonarlake.plans.durable import save_table

SMALL = 1024  # rows of a key that one task may hold
PAIRS = 1 << 20  # pairs of rows worked on together; at least one key


def split_by_size(tables: Sequence[DataFrame], keys: Sequence[str], limit: int | None = None) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows of keys with at most ``limit`` rows in all, and those of larger keys and null keys (None: no such key)."""
    rows = tables[0].select(*keys)
    for other in tables[1:]:
        rows = rows.unionAll(other.select(*keys))
    apart = F.count(F.lit(1)) > (SMALL if limit is None else limit)
    for k in keys:
        apart = apart | F.col(k).isNull()
    big = save_table(rows.groupBy(*keys).agg(apart.alias("_big")).filter("_big").select(*[F.col(k).alias(f"_big_{k}") for k in keys]), "big")[0]
    if big.isEmpty():
        return list(tables), None
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_big_{k}"))
    part = lambda how: [df.join(F.broadcast(big), on, how) for df in tables]  # noqa: E731  at most one row per ``limit`` rows
    return part("left_anti"), part("left_semi")


Work = Callable[[pa.Table, np.ndarray], pa.Table]


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], work: Work, schema: StructType) -> DataFrame:
    """``work`` on tables of whole keys, their rows in ``order``; it gets the number of rows of each key."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_whole_groups(list(keys), work), schema)


def _whole_groups(keys: list[str], work: Work):
    def firsts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def done(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(first, t.num_rows))
        slab = np.cumsum(sizes * sizes) // PAIRS
        cuts = np.append(np.flatnonzero(np.diff(slab, prepend=-1)), len(sizes))
        for a, b in zip(cuts[:-1], cuts[1:]):
            end = first[b] if b < len(first) else t.num_rows
            yield from work(t.slice(first[a], end - first[a]), sizes[a:b]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of a batch may go on in the next one
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            first = firsts(t)
            yield from done(t.slice(0, first[-1]), first[:-1])
            held = t.slice(first[-1])
        if held is not None:
            yield from done(held, np.zeros(1, dtype=np.int64))

    return run


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN: comparisons with it are false."""
    return t.column(name).cast(pa.float64()).to_numpy()


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b), a before b, of all pairs of rows of one key."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.arange(len(first))
    after = first + np.repeat(sizes, sizes) - rows - 1
    a = np.repeat(rows, after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def iou_of_rows(box: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``functions.boxes.iou``, for rows a and b."""
    x1, y1, x2, y2 = box
    area = (x2 - x1) * (y2 - y1)
    inter = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b])) * np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
    union = area[a] + area[b] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def first_member(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest row number of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def first_come(n: int, earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Rows that a loop "keep unless it conflicts with an earlier kept row" keeps."""
    open_, kept = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    while len(later):
        now = open_.copy()
        now[later] = False
        kept |= now
        out = now.copy()
        out[later[now[earlier]]] = True
        open_ &= ~out
        left = open_[earlier] & open_[later]
        earlier, later = earlier[left], later[left]
    return kept | open_
