"""Result shaping for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.functions.numbers import rounded
from framestory.queries.sqlviews import R


def out(df: DataFrame, plain: str, floats: str = "", places: int = 6) -> DataFrame:
    """Named columns as they are, float columns rounded."""
    return df.select(*plain.split(), *[rounded(F.col(c), places).alias(c) for c in floats.split()])


def outs(plain: str, floats: str = "", places: int = 6) -> str:
    """The same select list as SQL."""
    return ", ".join(plain.split() + [f"{R(c, places)} AS {c}" for c in floats.split()])
