"""Arithmetic helpers that keep ANSI mode from failing on missing or zero values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(column: Column) -> Column:
    """NaN and null become 0 (double columns)."""
    return F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a double; 0 where either is missing or the denominator is 0."""
    return F.coalesce(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))
