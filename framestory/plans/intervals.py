"""Interval overlap and nearest-in-time joins as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.plans.sequence import BLOCK_ROWS, index_rows, running_sums


def bucket(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(width)).cast("long")


def spread(df: DataFrame, lo: Column, hi: Column, width: float, name: str = "_b") -> DataFrame:
    """One copy of the row per time bucket its interval touches."""
    return df.withColumn(name, F.explode(F.sequence(bucket(lo, width), bucket(F.greatest(lo, hi), width))))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_iv: tuple[str, str],
                  right_iv: tuple[str, str], width: float, how: str = "inner",
                  condition: Column | None = None) -> DataFrame:
    """Pairs with overlapping closed intervals, each pair once.

    Both sides are spread over buckets of ``width``; a pair is kept only in the
    bucket where the later of the two starts lies, so no de-duplication pass is
    needed.  Column names of the two sides must differ except for ``keys``.
    """
    ls, le = left_iv
    rs, re = right_iv
    l = spread(left, F.col(ls), F.col(le), width)
    r = spread(right, F.col(rs), F.col(re), width)
    cond = ((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))
            & (F.col("_b") == bucket(F.greatest(F.col(ls), F.col(rs)), width)))
    if condition is not None:
        cond = cond & condition
    return l.join(r, [*keys, "_b"], how).where(cond).drop("_b")


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: str, start: str, end: str, width: float, block: int = BLOCK_ROWS) -> DataFrame:
    """How many closed intervals of the other side each one overlaps, without pairs.

    Others that overlap [s, e] are those starting by e less those ended before s:
    running counts over the starts and ends of both sides.  Returns the keys,
    ``side`` (0 left, 1 right), ``ident`` and ``others``.
    """
    sides = [d.select(*keys, F.col(ident), F.col(start).alias("_lo"), F.greatest(start, end).alias("_hi"), F.lit(i).alias("side")) for i, d in enumerate((left, right))]
    m = sides[0].unionByName(sides[1])
    m = m.withColumn("_m", F.explode(F.array(F.struct(F.col("_lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("_hi").alias("at"), F.lit(1).alias("kind")))))
    m = m.select(*keys, ident, "side", F.col("_m.at").alias("at"), F.col("_m.kind").alias("kind"))
    m = index_rows(m, keys, ["at", "kind", "side", ident], bucket(F.col("at"), width))
    of = lambda side, kind: ((F.col("side") == side) & (F.col("kind") == kind)).cast("long")
    m = running_sums(m, keys, {f"_n{s}{k}": of(s, k) for s in (0, 1) for k in (0, 1)}, block=block)
    started, ended = F.when(F.col("side") == 0, F.col("_n10")).otherwise(F.col("_n00")), F.when(F.col("side") == 0, F.col("_n11")).otherwise(F.col("_n01"))
    return m.groupBy(*keys, "side", ident).agg(
        (F.max(F.when(F.col("kind") == 1, started)) - F.max(F.when(F.col("kind") == 0, ended))).alias("others"))
