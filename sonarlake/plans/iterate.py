"""Two iterative building blocks: connected components and order-respecting independent sets.

Every round is a set of joins and aggregates whose result is stored, so lineage stays short and a lost executor only
costs the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import discard, save_table


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b",
                         label: str = "component") -> DataFrame:
    """Smallest reachable node id per node. ``edges`` are undirected; isolated nodes keep their own id.

    Alternating "large star" and "small star" rewiring: each round links nodes to the smallest neighbour they know of,
    so path lengths shrink geometrically and the edge count never grows.
    """
    spark = nodes.sparkSession
    current, path = save_table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        linked = both.join(low, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(
                low.select("u", F.col("_m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    signature = None
    while True:
        nxt, nxt_path = save_table(star(star(current, True), False), "edges")
        discard(spark, path)
        current, path = nxt, nxt_path
        stat = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stat) == signature:
            break
        signature = tuple(stat)
    root = current.groupBy("u").agg(F.min("v").alias("_root"))
    return (nodes.join(root, nodes[node] == root["u"], "left")
            .withColumn(label, F.coalesce("_root", node)).drop("u", "_root"))


def first_come_set(items: DataFrame, conflicts: DataFrame, node: str = "id") -> DataFrame:
    """Items a sequential "keep unless it conflicts with an earlier kept item" loop would keep.

    ``conflicts`` has (earlier, later) pairs. Each round keeps the undecided items without an undecided earlier
    conflict and drops what conflicts with them; the outcome equals the loop's.
    """
    spark = items.sparkSession
    undecided, u_path = save_table(items.select(F.col(node).alias("n")), "undecided")
    pairs, p_path = save_table(conflicts.select("earlier", "later").distinct(), "conflicts")
    kept_parts: list[DataFrame] = []
    while True:
        blocked = pairs.select(F.col("later").alias("n")).distinct()
        now, _ = save_table(undecided.join(blocked, "n", "left_anti"), "kept")
        kept_parts.append(now)
        if pairs.isEmpty():
            break
        dropped = pairs.join(now, pairs["earlier"] == now["n"], "left_semi").select(F.col("later").alias("n")).distinct()
        dropped, d_path = save_table(dropped, "dropped")
        gone = now.unionByName(dropped)
        nxt_u, nu_path = save_table(undecided.join(gone, "n", "left_anti"), "undecided")
        nxt_p, np_path = save_table(
            pairs.join(gone, pairs["earlier"] == gone["n"], "left_anti")
            .join(gone, F.col("later") == gone["n"], "left_anti"), "conflicts")
        for old in (u_path, p_path, d_path):
            discard(spark, old)
        undecided, u_path, pairs, p_path = nxt_u, nu_path, nxt_p, np_path
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    return kept.select(F.col("n").alias(node))
