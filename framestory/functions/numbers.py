"""Rounding and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column, places: int) -> Column:
    """Half-even rounding that first removes float noise below 1e-10.

    Sums of the same numbers in another order differ in the last bits; without
    the first step such noise decides ties.
    """
    scale = float(10 ** places)
    return F.rint(F.rint(col * 1e10) / 1e10 * scale) / scale + 0.0  # adding zero turns -0.0 into 0.0


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def rounded_number(x: float, places: int) -> float:
    """``rounded`` for a Python number."""
    scale = 10.0 ** places
    return round(round(x * 1e10) / 1e10 * scale) / scale + 0.0
