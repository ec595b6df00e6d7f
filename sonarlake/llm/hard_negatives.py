"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster and a block of candidates the candidates are sorted once by an upper
bound of their inner product with any member: the cone around the members' mean has the half angle ``t``, a candidate of
norm ``n`` at the angle ``a`` from that mean scores at most ``n * cos(max(0, a - t))`` times the member's norm. All members
walk this one list from its top and each stops as soon as the bound of what is left is below what it still needs, which
certifies its result.

Two walks are made. The first is among rows of the anchor's label and gives its positives; the second is among all rows
and gives, per positive, the best rows of other labels whose score lies in the band that the positive's score sets.

Work is dealt by (cluster, block): clusters are cut to at most ``cluster`` anchors and candidates to blocks of about
``block`` rows by a stored row number, so neither a frequent label nor a pile of equal vectors makes a large task. Blocks
return at most the k best each, and a ranked window keeps the k best of all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable

from .common import pick

#: Larger integer components could make a score that is no 64-bit number.
LARGEST = 1 << 28


@dataclass(frozen=True)
class MiningRule:
    """``positives`` best rows of the same label, then per positive ``negatives`` rows of other labels between ``low`` and ``high`` percent of its score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    cluster: int = 512
    block: int = 16_384
    #: Rows and rounds for choosing cluster centres on the driver; a bound, whatever the table's size.
    sample: int = 4096
    centres: int = 256
    rounds: int = 5


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` per component; null for a vector that is null, has a null or non-finite component, or leaves +-2^28."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fits = F.forall(scaled, lambda x: F.coalesce((x >= -float(LARGEST)) & (x < float(LARGEST)), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda x: F.floor(x).cast("bigint")))


# ---------------------------------------------------------------- the walk

def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in floating point only where no sum can leave its exact range."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), "int64")
    if x.shape[1] * float(np.abs(x).max()) * float(np.abs(y).max()) < 2.0 ** 53:
        return (x.astype("float64") @ y.astype("float64").T).astype("int64")
    return x @ y.T


def upper_bounds(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Per candidate row a bound of its inner product with any member, divided by the member's norm."""
    def unit(a):
        size = np.linalg.norm(a, axis=1)
        return size, a / np.where(size > 0, size, 1.0)[:, None]

    size, x_unit = unit(x.astype("float64"))
    _, m_unit = unit(members.astype("float64"))
    axis = m_unit.mean(axis=0)
    length = float(np.linalg.norm(axis))
    if length < 1e-9:
        return size
    axis /= length
    half = float(np.arccos(np.clip(m_unit @ axis, -1, 1)).max())
    angle = np.arccos(np.clip(x_unit @ axis, -1, 1))
    return size * np.cos(np.maximum(angle - half, 0.0)) + 1e-7 * (size + 1.0)


class SharedList:
    """Candidates of one block, sorted by their bound for one cluster of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, members: np.ndarray, tile: int = 1024):
        bound = upper_bounds(x, members)
        order = np.lexsort((ids, -bound))
        self.ids, self.labels, self.x, self.bound = ids[order], labels[order], x[order], bound[order]
        self.members, self.tile, self.seen = members, tile, 0
        self.norms = np.linalg.norm(members.astype("float64"), axis=1)

    def best(self, asks: np.ndarray, allowed, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best allowed candidates of every ask with least <= score <= most: ask number, candidate id, score.

        ``asks`` holds each ask's member; ``allowed(rows, asks)`` tells which candidates (places in the list) count.
        """
        need = least.astype("float64")
        held = (np.zeros(0, "int64"),) * 3
        norms = self.norms[asks]
        for at in range(0, len(self.ids), self.tile):
            live = np.flatnonzero(self.bound[at] * norms + 1e-6 * (1 + np.abs(need)) >= need)
            if not len(live):
                break
            rows = np.arange(at, min(at + self.tile, len(self.ids)))
            self.seen += len(rows) * len(live)
            members, where = np.unique(asks[live], return_inverse=True)
            score = _dots(self.x[rows], self.members[members])[:, where]
            hit = (score >= need[live]) & (score <= most[live]) & allowed(rows, live)
            r, c = np.nonzero(hit)
            ask = np.concatenate([held[0], live[c]])
            found = np.concatenate([held[1], self.ids[rows[r]]])
            value = np.concatenate([held[2], score[r, c]])
            order = np.lexsort((found, -value, ask))
            ask, found, value = ask[order], found[order], value[order]
            first = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]]) if len(ask) else np.zeros(0, "int64")
            place = np.arange(len(ask)) - np.repeat(first, np.diff(np.r_[first, len(ask)]))
            keep = place < k
            full = place == k - 1
            need[ask[full]] = np.maximum(need[ask[full]], value[full])
            held = (ask[keep], found[keep], value[keep])
        return held


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("int64")
    return flat.reshape(table.num_rows, len(flat) // table.num_rows)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype("int64")


def _positives(k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        who, ids, x = _numbers(anchors, "vec_id"), _numbers(rows, "vec_id"), _matrix(rows)
        shared = SharedList(ids, _numbers(rows, "label"), x, _matrix(anchors))
        open_ = np.full(len(who), np.iinfo("int64").min), np.full(len(who), np.iinfo("int64").max)
        ask, found, score = shared.best(np.arange(len(who)), lambda r, a: shared.ids[r][:, None] != who[a][None, :], *open_, k)
        return pa.table([who[ask], found, score], schema=schema)

    return run


def _negatives(rule: MiningRule):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_no", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        who, labels = _numbers(anchors, "vec_id"), _numbers(anchors, "label")
        shared = SharedList(_numbers(rows, "vec_id"), _numbers(rows, "label"), _matrix(rows), _matrix(anchors))
        scores = [s.as_py() for s in anchors.column("scores")]
        ask = [(m, no, s) for m, own in enumerate(scores) for no, s in enumerate(own)]
        member = np.array([a[0] for a in ask], "int64")
        least = np.array([-(-rule.low * s // 100) for _, _, s in ask], "int64")
        most = np.array([rule.high * s // 100 for _, _, s in ask], "int64")
        open_ = np.flatnonzero(least <= most)
        if not len(open_):
            return schema.empty_table()
        got, found, score = shared.best(member[open_], lambda r, a: shared.labels[r][:, None] != labels[member[open_[a]]][None, :],
                                        least[open_], most[open_], rule.negatives)
        number = np.array([a[1] for a in ask], "int64")[open_[got]]
        return pa.table([who[member[open_[got]]], number, found, score], schema=schema)

    return run


# ---------------------------------------------------------------- dealing out

def _centres(anchors: DataFrame, rule: MiningRule, count: int) -> dict[int, np.ndarray]:
    """Per vector length a few directions, by rounds of spherical means over a bounded sample of anchors."""
    picked = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rule.sample).select("dim", "v").collect()
    wanted = max(1, min(rule.centres, math.ceil(count / rule.cluster)))
    out = {}
    for dim in {r.dim for r in picked}:
        own = [r.v for r in picked if r.dim == dim]
        x = np.array(own, "float64").reshape(len(own), dim)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        centre = x[:wanted].copy()
        for _ in range(rule.rounds):
            near = (x @ centre.T).argmax(axis=1)
            for c in range(len(centre)):
                mean = x[near == c].sum(axis=0)
                if np.linalg.norm(mean) > 1e-9:
                    centre[c] = mean / np.linalg.norm(mean)
        out[dim] = centre
    return out


def _assign(anchors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Anchors with the number of the nearest centre."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32())])

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            cluster = np.zeros(len(dims), "int32")
            for dim in np.unique(dims):
                centre = centres.get(int(dim))
                if centre is not None and dim:
                    at = np.flatnonzero(dims == dim)
                    x = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim).astype("float64")
                    cluster[at] = (x @ centre.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], schema=schema)

    return anchors.select("vec_id", "label", "dim", "v").mapInArrow(run, "vec_id long, label long, dim int, v array<bigint>, cluster int")


def _pairs(anchors: DataFrame, rows: DataFrame, keys: list[str], rule: MiningRule) -> tuple[DataFrame, DataFrame]:
    """Both sides with (keys, group, block): every group of anchors meets every block of candidates of its keys once."""
    crowd = anchors.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n"))
    parts = crowd.withColumn("_parts", F.ceil(F.col("_n") / rule.cluster).cast("int"))
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rule.block).cast("int").alias("_blocks"))
    grouped = anchors.join(parts, [*keys, "cluster"]).join(blocks, keys)
    group = F.struct("cluster", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int").alias("part"))
    left = (grouped.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .drop("_n", "_parts", "_blocks", "cluster"))
    listed = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).groupBy(*keys).agg(
        F.collect_list(F.struct("cluster", "part")).alias("_groups"))
    right = (rows.join(blocks, keys).join(listed, keys).withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
             .withColumn("group", F.explode("_groups")).select(*keys, "group", "block", *[c for c in ("vec_id", "label", "v") if c not in keys]))
    return left, right


def mine(vectors: DataFrame, is_anchor: Column, rule: MiningRule = MiningRule(), vec_id: str = "vec_id", vector: str = "vector",
         label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``vector`` holds arrays of whole numbers (see ``whole_numbers``), ``is_anchor`` is an expression of the column vec_id.
    Scores are exact integer inner products; higher ones come first, ties by smaller id. Rows with a null id, label or
    vector take no part, and vectors of different lengths never meet. Repeated rows are candidates each; of repeated
    anchor ids the row of lowest length, label and vector is the anchor, and rows of its own id are no positives of it. An
    anchor without positives or without rows in the band gives no rows, and so does an empty table.
    """
    rows = pick(vectors, vec_id=vec_id, label=label, v=vector).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = durable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("v").alias("dim"), "v",
                               F.monotonically_increasing_id().alias("row")), "candidates")
    chosen = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("dim", "label", "v")).alias("_a"))
    chosen = durable(chosen.select("vec_id", "_a.label", "_a.dim", "_a.v"), "anchors")
    anchors = durable(_assign(chosen, _centres(chosen, rule, chosen.count())), "clustered")

    left, right = _pairs(anchors, rows, ["dim", "label"], rule)
    keys = ["dim", "label", "group", "block"]
    found = left.groupBy(*keys).cogroup(right.withColumn("label_", F.col("label")).groupBy(*keys)).applyInArrow(
        _positives(rule.positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = durable(found.withColumn("positive_no", F.row_number().over(order) - 1).filter(F.col("positive_no") < rule.positives)
                        .withColumn("positive_no", F.col("positive_no").cast("long")), "positives")

    asks = positives.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive_no", "positive_score"))),
                                                          lambda p: p["positive_score"]).alias("scores"))
    left, right = _pairs(anchors.join(asks, anchors["vec_id"] == asks["anchor_id"]).drop("anchor_id"), rows, ["dim"], rule)
    keys = ["dim", "group", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _negatives(rule), "anchor_id long, positive_no long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_no").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.negatives)
    return best.join(positives, ["anchor_id", "positive_no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
