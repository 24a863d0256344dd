"""Helpers for results that compare across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r3(col) -> Column:
    """Rounded to three decimals by floor, which every engine does alike."""
    return (F.floor(F.col(col) * 1000 + 0.5) / 1000 if isinstance(col, str) else F.floor(col * 1000 + 0.5) / 1000).cast("double")


def total(value: str | Column, decimals: int | None = None) -> Column:
    """The sum. A sum of doubles depends on the order of the rows in its last digits, and so does a mean that lies just between two rounded
    ones; that of values with at most ``decimals`` decimals is exact. Cast it to double before dividing."""
    col = F.col(value) if isinstance(value, str) else value
    return F.sum(col if decimals is None else col.cast(f"decimal(18,{decimals})"))
