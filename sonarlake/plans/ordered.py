"""Order-dependent work on groups of any size.

A window partitioned by a survey puts the whole survey into one task. The helpers here range-partition the rows by
(keys, order), so a long survey spreads over many tasks, and carry only one small row per (key, slice) across slices.
``order`` must be a total order inside a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

SLICE_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence, slices: int | None, keep: Sequence[str] | None = None) -> DataFrame:
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(slices, *cols) if slices else df.repartitionByRange(*cols)
    placed = ranged.sortWithinPartitions(*cols).withColumn("_place", F.monotonically_increasing_id())
    placed = placed if keep is None else placed.select(*dict.fromkeys([*keys, *keep]), "_place")
    return durable(placed, "ordered").withColumn("_slice", F.shiftright("_place", SLICE_BITS))


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "idx", start: int = 0,
                slices: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Consecutive numbers ``start, start+1, ...`` per key in ``order``; same result as ``row_number``.

    ``keep`` names the columns wanted beside the keys; columns that only order are then not stored.
    """
    rows = _sliced(df, keys, order, slices, keep)
    by_key = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        rows.groupBy(*keys, "_slice")
        .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_key), F.lit(0)))
        .drop("_n")
    )
    if not keys:
        heads = F.broadcast(heads)  # one short row per slice
    return (
        rows.join(heads, [*keys, "_slice"])
        .withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + F.lit(start))
        .drop("_place", "_slice", "_first", "_before")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, str | Column],
                 slices: int | None = None) -> DataFrame:
    """Add ``name`` = inclusive running sum of an expression per key in ``order``."""
    inputs = {f"_in_{n}": (F.col(e) if isinstance(e, str) else e) for n, e in sums.items()}
    rows = _sliced(df.withColumns(inputs), keys, order, slices)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    heads = rows.groupBy(*keys, "_slice").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    heads = heads.select(*keys, "_slice",
                         *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    joined = rows.join(heads, [*keys, "_slice"])
    return (
        joined.withColumns({n: F.sum(f"_in_{n}").over(inside) + F.col(f"_before_{n}") for n in sums})
        .drop("_place", "_slice", *inputs, *[f"_before_{n}" for n in sums])
    )


def with_chunks(df: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut an indexed sequence into chunks that also see ``before``/``after`` neighbouring rows.

    Rows near a cut are repeated in the chunk next to it (``_own`` is false there), so a window over (key, ``_chunk``)
    sees every neighbour it needs and no task holds more than ``size + before + after`` rows of a key.
    """
    i = F.col(index).cast("bigint")
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor((i - after) / F.lit(float(size))).cast("bigint"))
    hi = F.floor((i + before) / F.lit(float(size))).cast("bigint")
    own = F.floor(i / F.lit(float(size))).cast("bigint")
    return df.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_chunk") == own)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], name: str = "q") -> DataFrame:
    """Linearly interpolated quantiles per key as rows (keys, ``<name>_no``, ``<name>``), for any number of distinct values.

    Equal values are counted first; a range-partitioned running count then tells which two values each quantile lies
    between, so no task sees a whole group (the built-in exact percentile gathers a group's distinct values).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    placed = running_sums(counts, [*keys, "_one"], [value], {"_upto": "_n"})
    totals = counts.groupBy(*keys, "_one").agg(F.sum("_n").alias("_all"))
    asked = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    at = lambda x: x["q"] * (F.col("_all") - 1)
    start = F.col("_upto") - F.col("_n")
    hits = lambda pos: (pos >= start) & (pos < F.col("_upto"))
    rows = placed.join(totals, [*keys, "_one"]).withColumn("_a", F.explode(F.filter(
        asked, lambda x: hits(F.floor(at(x))) | hits(F.ceil(at(x))))))
    pos = F.col("_a.q") * (F.col("_all") - 1)
    pair = rows.groupBy(*keys, F.col("_a.no").alias(f"{name}_no")).agg(
        F.max(F.when(hits(F.floor(pos)), F.col(value))).alias("_lo"), F.max(F.when(hits(F.ceil(pos)), F.col(value))).alias("_hi"),
        F.first(pos - F.floor(pos)).alias("_f"))
    return pair.select(*keys, f"{name}_no", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))
