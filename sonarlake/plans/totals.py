"""One-row tables on every row, as scalar subqueries: no join, no broadcast and no constant key that the optimizer would fold."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with every column of the one-row table ``totals``; nulls if that table is empty."""
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
