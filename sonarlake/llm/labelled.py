"""Bounded training samples: documents with labels, picked by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 1 modulo 3; such rows, and rows without an id, never train a model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, columns: dict[str, str], max_rows: int, only: Column | None = None) -> DataFrame:
    """Columns of up to ``max_rows`` labelled documents plus ``label`` (0/1); of repeated labels of an id the lowest counts.

    The sample is the ids of lowest hash, so it does not depend on the order of rows. It is at most ``max_rows`` rows of
    two numbers, which bounds the broadcast. Of documents that share an id the one of lowest hash trains, so the result has
    at most ``max_rows`` rows too, whatever the table.
    """
    chosen = pick(labels, doc_id="doc_id", label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    if only is not None:
        chosen = chosen.filter(only)
    chosen = (chosen.groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    found = pick(docs, doc_id="doc_id", **columns).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*columns).alias("_hash"), *columns, "label")).alias("_row"))
    return one.select("doc_id", "_row.*").drop("_hash")
