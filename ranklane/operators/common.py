"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def one_row(df: DataFrame) -> dict:
    """Values of a one-row aggregate as Python scalars (bounded by design:
    a global aggregate yields exactly one row)."""
    row = df.first()
    return row.asDict() if row is not None else {}
