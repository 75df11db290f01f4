"""Nearest-in-order joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], slot_width: float,
            ident: str) -> DataFrame:
    """Queries with the payload of the fact whose ``at`` is nearest; the earlier fact wins ties.

    Of facts at the same place the largest payload is taken before a query, the
    smallest after it.

    Both sides are put on one line per key, cut into slots.  Inside a slot two
    windows carry the last fact before and the first fact after each query;
    across slots the first and last fact of every slot are carried, one row per
    slot.  ``ident`` names a unique column of the queries.  Queries without any
    fact get nulls.
    """
    keys = list(keys)
    pay = F.struct(F.col(at).alias("_at"), *payload)
    f = facts.select(*keys, F.col(at).alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(queries.schema[ident].dataType).alias(ident),
                     pay.alias("_fact"))
    q = queries.select(*keys, F.col(at).alias("_pos"), F.lit(1).alias("_kind"), ident, F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"))
    line = f.unionByName(q).withColumn("_slot", F.floor(F.col("_pos") / slot_width).cast("long"))
    ends = line.groupBy(*keys, "_slot").agg(F.max("_fact").alias("_last"), F.min("_fact").alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_slot")
    carry = ends.select(
        *keys, "_slot",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_before"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_after"))
    slot = Window.partitionBy(*keys, "_slot")
    seen = Window.unboundedPreceding, 0
    line = (line.withColumn("_b", F.last("_fact", ignorenulls=True).over(slot.orderBy("_pos", "_kind", "_fact").rowsBetween(*seen)))
            .withColumn("_a", F.last("_fact", ignorenulls=True).over(slot.orderBy(F.desc("_pos"), "_kind", F.desc("_fact")).rowsBetween(*seen)))
            .where(F.col("_kind") == 1).join(carry, [*keys, "_slot"])
            .withColumn("_before", F.coalesce("_b", "_carry_before")).withColumn("_after", F.coalesce("_a", "_carry_after")))
    gap_b, gap_a = F.col("_pos") - F.col("_before._at"), F.col("_after._at") - F.col("_pos")
    best = F.when(F.col("_after").isNull() | (gap_b <= gap_a), F.col("_before")).otherwise(F.col("_after"))
    hit = line.select(ident, best.alias("_best"))
    return queries.join(hit, ident).select(*queries.columns, *[F.col(f"_best.{c}").alias(c) for c in payload], F.col("_best._at").alias(at + "_found"))
