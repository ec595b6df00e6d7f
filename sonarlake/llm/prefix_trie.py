"""Trie of conversation prefixes with counts per node, in tables of perfect-hash slots.

Every prefix of a conversation has a 128-bit digest: two running sums of mixed turn hashes, the turn's place mixed in. A
conversation is cut into segments of at most ``span`` turns; equal segments under one starting prefix are grouped, with the
number and the smallest id of their conversations. Sorted by path and numbered, the segments are dealt in chunks of
``chunk`` rows, each with the last row of the chunk before, so no prefix, however common, makes a large task.

Inside a chunk the distinct prefix digests get the slots of a minimal perfect hash; every entry is checked against the
digest, parent and last turn kept in its slot. Counts are scattered into flat arrays by slot and added up through the array
of parent slots, deepest level first. The row before tells which prefixes were counted elsewhere, and all values are sums,
so a prefix that spans chunks is put together by adding its parts. What segments beyond the first add to the prefixes above
them is carried down each conversation by one ordered running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import dense_index, running_sums, with_chunks
from sonarlake.plans.totals import with_totals

from .common import BLANK_RE, pick
from .token_store import PerfectHash, _mix

SPAN, CHUNK = 64, 8192
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns

def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, no (from 1, by turn, nulls first, equal turns by hash), two hashes and a check hash of (role, text), words."""
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id IS NOT NULL")
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    words = F.size(F.filter(F.split(said[1], BLANK_RE), lambda w: w != "")).cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.xxhash64(F.lit(k), *said).alias(n) for k, n in enumerate(("ha", "hb", "fp"))], words.alias("words"))
    return durable(dense_index(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("ha"), F.col("hb")], "no", start=1).drop("turn"), "turns")


def borrow_starts(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt from the first h turns of c - c % every (those there are) and its own after its first h.

    h is the unsigned crc32 of the decimal id modulo ``most + 1``. Returns the turns (with ``pos`` and ``length``) and all
    conversations with their lengths, those without turns included.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    entry = F.struct("no", "ha", "hb", "fp", "words")
    heads = (turns.filter((F.col("no") <= most) & (base == F.col("conv_id"))).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(entry)).alias("start")))
    convs = own.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int").alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("start", F.filter("start", lambda s: s["no"] <= F.col("h")))
    convs = convs.withColumn("taken", F.coalesce(F.size("start"), F.lit(0)))
    convs = durable(convs.select("conv_id", "h", "taken", "start", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length")), "rebuilt")
    rest = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("no > h")
    columns = ["ha", "hb", "fp", "words"]
    kept = rest.select("conv_id", (F.col("no") - F.col("h") + F.col("taken")).cast("long").alias("pos"), "length", *columns)
    lent = convs.select("conv_id", "length", F.explode("start").alias("s")).select("conv_id", F.col("s.no").cast("long").alias("pos"), "length", *[f"s.{c}" for c in columns])
    return kept.unionByName(lent), convs.select("conv_id", "length")


# ---------------------------------------------------------------- segments

def _wrapped(total: Column) -> Column:
    """A decimal sum as the signed 64-bit number it is modulo 2^64."""
    half, whole = (F.lit(str(2 ** k)).cast("decimal(38,0)") for k in (63, 64))
    return (F.pmod(total + half, whole) - half).cast("long")


def _lists(batch, name: str, kind: str = "int64") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _offsets(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray([len(x) for x in column.to_pylist()], "int64") if column.null_count else np.diff(column.offsets.to_numpy()).astype("int64")
    return np.concatenate([[0], np.cumsum(lengths)])


def _split(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(flat))


SEGMENT = "conv_id long, band long, length long, n int, a array<long>, b array<long>, f array<long>, w array<long>"
_SEGMENT_TYPES = pa.schema([("conv_id", pa.int64()), ("band", pa.int64()), ("length", pa.int64()), ("n", pa.int32())] + [(c, pa.list_(pa.int64())) for c in "abfw"])


def _relative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of mixed turn hashes inside each segment (wrapping 64-bit), from its turns in order."""
    for batch in batches:
        turns = batch.column("turns")
        at = np.concatenate([[0], np.cumsum(np.diff(turns.offsets.to_numpy()))]).astype("int64")
        flat = turns.flatten()
        pos, ha, hb, fp, words = (flat.field(k).to_numpy(zero_copy_only=False).astype("int64") for k in range(5))
        place = _mix(pos.view("uint64"), 21)
        out = []
        for h in (ha, hb):
            run = np.cumsum(_mix(h.view("uint64") ^ place, 22), dtype="uint64")
            before = np.concatenate([np.zeros(1, "uint64"), run])[at[:-1]]
            out.append((run - np.repeat(before, np.diff(at))).view("int64"))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("band"), batch.column("length"), pa.array(np.diff(at).astype("int32")),
                                          *[_split(x, at) for x in (*out, fp, words)]], schema=_SEGMENT_TYPES)


def _absolute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the digest of the prefix before the segment to its running sums."""
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        at = _offsets(batch, "a")
        for lane, start in (("a", "aa"), ("b", "ab")):
            own = _lists(batch, lane).view("uint64") + np.repeat(columns[start].to_numpy().astype("int64").view("uint64"), np.diff(at))
            columns[lane] = _split(own.view("int64"), at)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _segments(turns: DataFrame, convs: DataFrame, span: int) -> DataFrame:
    """One row per conversation and ``span`` turns: digests of its prefixes (a, b), start digest (aa, ab), checks and words."""
    band = F.floor((F.col("pos") - 1) / span).cast("long")
    cut = turns.groupBy("conv_id", band.alias("band")).agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("pos", "ha", "hb", "fp", "words"))).alias("turns"))
    empty = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("band"), "length", F.array().cast(dict(cut.dtypes)["turns"]).alias("turns"))
    rel = durable(cut.unionByName(empty).select("conv_id", "band", "length", "turns").mapInArrow(_relative, SEGMENT), "segments")
    long = rel.filter(F.col("length") > span)
    tail = {t: F.coalesce(F.try_element_at(F.col(c), F.lit(-1)), F.lit(0)).cast("decimal(38,0)") for t, c in (("ta", "a"), ("tb", "b"))}
    sums = running_sums(long.select("conv_id", "band", *[v.alias(k) for k, v in tail.items()]), ["conv_id"], ["band"], {"sa": "ta", "sb": "tb"})
    starts = sums.filter("band > 0").select("conv_id", "band", _wrapped(F.col("sa") - F.col("ta")).alias("aa"), _wrapped(F.col("sb") - F.col("tb")).alias("ab"))
    later = rel.filter("band > 0").join(starts, ["conv_id", "band"])
    zero = F.lit(0).cast("long")
    known = rel.filter("band = 0").withColumns({"aa": zero, "ab": zero}).unionByName(later)
    known = known.mapInArrow(_absolute, SEGMENT + ", aa long, ab long")
    return durable(known.withColumn("ends", (F.col("band") * span + F.col("n") == F.col("length")).cast("long")), "paths")


# ---------------------------------------------------------------- chunks

PART = ("kind int, a long, b long, depth long, pa long, pb long, fp long, words long, n_convs long, conv_id long, parent_conv long, edge int, "
        "n_children long, saved long, n_leaves long")
_PART_TYPES = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.int64()) for c in PART.split(", ")])
NODE, AMOUNT, CARRIED = 0, 1, 2


def _same(keys: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray]) -> None:
    """Every entry must find in its slot what was put there."""
    for kept, own in pairs:
        if (kept[keys] != own).any():
            raise ValueError("two prefixes share a digest")


class Rows:
    """Segment rows of one band in path order as flat arrays; ``own`` tells the rows of this chunk from the one before it."""

    def __init__(self, table: pa.Table, band: int, span: int):
        self.band, self.span = band, span
        self.own, self.n, self.ends, self.conv = (table.column(c).to_numpy().astype("int64") for c in ("own", "n_convs", "n_ends", "first"))
        self.at = _offsets(table, "a")
        self.size = np.diff(self.at)
        self.a, self.b, self.f, self.w = (_lists(table, c) for c in "abfw")
        self.aa, self.ab = (table.column(c).to_numpy().astype("int64") for c in ("aa", "ab"))

    def parts(self) -> pa.Table:
        rows, size, at = len(self.own), self.size, self.at
        row = np.repeat(np.arange(rows), size)
        place = np.arange(len(self.a)) - at[:-1][row]
        # slots: entries first, then the starts of the rows
        a, b = np.concatenate([self.a, self.aa]), np.concatenate([self.b, self.ab])
        key = _mix(a.view("uint64") ^ _mix(b.view("uint64"), 31), 32)
        slots = PerfectHash.build(np.unique(key))
        slot = slots.slots(key)
        node, start = slot[:len(self.a)], slot[len(self.a):]
        m = slots.n
        na, nb, depth, parent, fp, words = (np.full(m, v, "int64") for v in (0, 0, 0, -1, 0, 0))
        na[slot], nb[slot] = a, b
        depth[start] = self.band * self.span
        up = np.where(place > 0, np.r_[0, node[:-1]], start[row]) if len(node) else node
        depth[node], parent[node], fp[node], words[node] = self.band * self.span + place + 1, up, self.f, self.w
        _same(slot, (na, a), (nb, b))
        _same(node, (parent, up), (fp, self.f), (words, self.w), (depth, self.band * self.span + place + 1))
        top = np.zeros(m, bool)
        top[start] = True
        # what the row before shares with a row
        before = np.arange(rows) - 1
        linked = (before >= 0) & (self.aa == self.aa[before]) & (self.ab == self.ab[before])
        twin = at[:-1][before[row]] + place
        known = linked[row] & (place < size[before[row]])
        known[known] = self.a[twin[known]] == self.a[known]
        fresh = ~known & (self.own[row] == 1)
        last = np.where(size > 0, node[np.maximum(at[1:] - 1, 0)] if len(node) else start, start)
        longer = linked & (size > size[before]) & ((size[before] == 0) | (last[before] == node[np.minimum(at[:-1] + np.maximum(size[before] - 1, 0), max(0, len(node) - 1))] if len(node) else False))
        ending = (size < self.span) | (self.n == self.ends)
        extended = np.r_[longer[1:], False]
        leaf = ((self.own == 1) & ending & ~extended).astype("int64")
        leaf -= ((self.own == 0) & ending & extended).astype("int64")  # its own chunk could not see the row after it
        # flat arrays by slot, added up from the deepest level to the starts
        n, kids, saved, leaves = (np.zeros(m, "int64") for _ in range(4))
        conv = np.full(m, np.iinfo("int64").max)
        mine = self.own == 1
        np.add.at(n, last[mine], self.n[mine])
        np.minimum.at(conv, last[mine], self.conv[mine])
        np.add.at(leaves, last, leaf)
        np.add.at(kids, parent[node[fresh]], 1)
        np.subtract.at(saved, node[fresh], self.w[fresh])
        order = np.argsort(-depth, kind="stable")
        order = order[parent[order] >= 0]
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
            saved[level] += n[level] * words[level]
            for values in (n, saved, leaves):
                np.add.at(values, parent[level], values[level])
            np.minimum.at(conv, parent[level], conv[level])
        edge = top.copy()
        for r in {0, rows - 1}:
            edge[node[at[r]:at[r + 1]]] = True
        outer = top & (self.band > 0)
        for values in (n, saved, leaves):
            values[outer] = 0
        conv[outer] = np.iinfo("int64").max
        seen = np.zeros(m, bool)  # what only the row before holds belongs to its own chunk
        seen[node[self.own[row] == 1]] = True
        seen |= top | (leaves != 0)
        nothing = conv == np.iinfo("int64").max
        inner = np.where(parent >= 0, parent, 0)
        hidden = (parent < 0) | edge[inner]
        root_like = parent < 0
        columns = [np.full(m, NODE), na, nb, depth, pa.array(na[inner], mask=root_like), pa.array(nb[inner], mask=root_like), pa.array(fp, mask=root_like),
                   pa.array(words, mask=root_like), n, pa.array(conv, mask=nothing), pa.array(conv[inner], mask=hidden), edge.astype("int64"), kids, saved, leaves]
        table = pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_PART_TYPES.names).cast(_PART_TYPES).filter(pa.array(seen))
        if self.band == 0:
            return table
        spent = np.zeros(rows, "int64")
        np.add.at(spent, row, np.where(self.own[row] == 1, self.n[row] * self.w, 0) - np.where(fresh, self.w, 0))
        late = np.r_[np.where(self.own[:1] == 0, leaf[:1], 0), np.zeros(rows - 1, "int64")]
        gain = np.where(mine, leaf, 0)
        if rows > 1:
            gain[1] += late[0]
        empty = pa.nulls(int(mine.sum()), pa.int64())
        amounts = {"kind": np.full(int(mine.sum()), AMOUNT), "conv_id": self.conv[mine], "depth": np.full(int(mine.sum()), self.band), "saved": spent[mine], "n_leaves": gain[mine]}
        extra = pa.table([pa.array(amounts[c]) if c in amounts else empty for c in _PART_TYPES.names], names=_PART_TYPES.names).cast(_PART_TYPES)
        return pa.concat_tables([table, extra])


def _chunk_parts(span: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        bands = table.column("band").to_numpy()
        out = []
        for band in np.unique(bands):
            rows = table.filter(pa.array(bands == band))
            if (rows.column("own").to_numpy() == 1).any():
                out.append(Rows(rows, int(band), span).parts())
        return pa.concat_tables(out) if out else _PART_TYPES.empty_table()

    return run


def _carried(paths: DataFrame, amounts: DataFrame, span: int) -> DataFrame:
    """What later segments of a conversation add to the prefixes of its earlier ones, one row per prefix."""
    long = paths.filter(F.col("length") > span).join(amounts.select("conv_id").distinct(), "conv_id", "left_semi")
    own = amounts.select("conv_id", F.col("depth").alias("band"), "saved", "n_leaves")
    rows = long.select("conv_id", "band").join(own, ["conv_id", "band"], "left").na.fill(0, ["saved", "n_leaves"])
    sums = running_sums(rows, ["conv_id"], [F.desc("band")], {"s": "saved", "l": "n_leaves"})
    above = sums.select("conv_id", "band", (F.col("s") - F.col("saved")).alias("saved"), (F.col("l") - F.col("n_leaves")).alias("n_leaves")).filter("saved <> 0 OR n_leaves <> 0")
    node = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    nodes = F.arrays_zip("a", "b")
    touched = long.join(above, ["conv_id", "band"]).select("saved", "n_leaves", F.explode(F.when(F.col("band") == 0, F.concat(F.array(node), nodes)).otherwise(nodes)).alias("_n"))
    return touched.groupBy("_n.a", "_n.b").agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves")).withColumn("kind", F.lit(CARRIED))


# ---------------------------------------------------------------- ids that end at a node

def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to 4096 ids of one node as comma-joined text, from rows in order."""
    for batch in batches:
        a, b, ids = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, "int64")
        cut = np.unique(np.concatenate([cut, *[np.arange(s, e, 4096) for s, e in zip(cut, np.r_[cut[1:], len(a)])]])).astype("int64") if len(cut) else cut
        text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cut, np.r_[cut[1:], len(a)])]
        yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], names=["a", "b", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its fragments, streamed in order."""
    node, state = None, None
    done: list[tuple[int, int, str]] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
        yield out()
        done = []
    if node is not None:
        done.append((*node, state.hexdigest()))
    yield out()


def _ends(paths: DataFrame) -> DataFrame:
    """Hash of the ascending ids of the conversations that end at a node; a node's ids are first joined in ordered runs by many tasks."""
    last = [F.coalesce(F.try_element_at(F.col(c), F.lit(-1)), F.lit(0)).alias(c) for c in "ab"]
    ids = paths.filter("ends = 1").select(*last, "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    runs = ids.mapInArrow(_fragments, "a long, b long, first long, ids string")
    return runs.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashes, "a long, b long, ends_sha256 string")


# ---------------------------------------------------------------- the trie

def prefix_trie(turns: DataFrame, convs: DataFrame, span: int = SPAN, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix: node, parent (hexadecimal digests), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds conv_id, pos (1, 2, ... without gaps), length, ha, hb, fp, words; ``convs`` every conv_id with its length.
    Conversations without turns are members of the root only; a table without conversations has no nodes. Rows without a
    conv_id take no part; null roles and texts count as empty; equal turn numbers are ordered by hash.
    """
    paths = _segments(turns, convs, span)
    last = [F.coalesce(F.try_element_at(F.col(c), F.lit(-1)), F.lit(0)).alias(f"z{c}") for c in "ab"]
    grouped = paths.select("*", *last).groupBy("band", "aa", "ab", "n", "za", "zb").agg(
        F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"), F.min("conv_id").alias("first"), *[F.first(c).alias(c) for c in "abfw"])
    ordered = dense_index(grouped.drop("za", "zb", "n"), [], ["band", "aa", "ab", "a"], "place")
    dealt = with_chunks(ordered, "place", chunk, before=1).withColumn("own", F.col("_own").cast("int")).drop("_own")
    columns = ["place", "own", "band", "aa", "ab", "n_convs", "n_ends", "first", *"abfw"]
    parts = durable(dealt.groupBy("_chunk").applyInArrow(lambda t: _chunk_parts(span)(t.select(columns)), PART), "parts")
    carried = _carried(paths, parts.filter(F.col("kind") == AMOUNT), span)
    zero, none = F.lit(0).cast("long"), F.lit(None)
    every = parts.filter(F.col("kind") == NODE).unionByName(carried.select(
        "kind", "a", "b", *[none.cast("long").alias(c) for c in ("depth", "pa", "pb", "fp", "words")], zero.alias("n_convs"), none.cast("long").alias("conv_id"),
        none.cast("long").alias("parent_conv"), F.lit(0).alias("edge"), zero.alias("n_children"), "saved", "n_leaves"))
    checks = ("depth", "pa", "pb", "fp", "words")
    merged = every.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in checks], *[F.min(c).alias(f"_{c}") for c in checks], *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "saved", "n_leaves")],
        F.min("conv_id").alias("conv_id"), F.max("parent_conv").alias("parent_conv"), F.max("edge").alias("edge"))
    equal = F.lit(True)
    for c in checks:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    merged = merged.withColumn("depth", F.when(equal, F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long")))
    nodes = durable(merged.drop("fp", "words", *[f"_{c}" for c in checks]), "nodes")

    known = nodes.filter("depth = 0 OR (depth > 1 AND parent_conv IS NOT NULL)")
    root = nodes.filter("depth = 0").agg(F.min("conv_id").alias("parent_conv"))
    first = with_totals(nodes.filter("depth = 1").drop("parent_conv"), root)
    edges = nodes.filter("edge = 1").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv"))
    asked = nodes.filter("depth > 1 AND parent_conv IS NULL").drop("parent_conv").join(edges, ["pa", "pb"])
    whole = known.unionByName(first).unionByName(asked).join(_ends(paths), ["a", "b"], "left")

    def name(x: str, y: str) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))

    return whole.select(name("a", "b").alias("node"), name("pa", "pb").alias("parent"), "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
                        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
