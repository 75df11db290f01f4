"""Ordered work per key that does not put a whole key into one task.

A plain ``Window.partitionBy(track).orderBy(time)`` sends every row of a track
to one task.  When one track or camera holds a large share of all rows that
task is the job.  The helpers here give the same results in two levels: rows
are cut into slots (a coarse monotone function of the order column) or blocks
(runs of equal length in row order); the heavy pass is partitioned by
(key, slot) and only one small row per slot is processed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000
KEY_GROUPS = 65_536


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slot: Column,
               name: str = "seq") -> DataFrame:
    """0-based row number per key in ``order``.

    ``slot`` must be non-decreasing along ``order``; rows are sorted per
    (key, slot), and slot sizes are accumulated per key.
    """
    keys = list(keys)
    d = df.withColumn("_slot", slot)
    sizes = d.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    return null_safe_join(local, offsets, [*keys, "_slot"]).withColumn(
        name, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_slot", "_off", "_rn")


def walk_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slot: Column, name: str = "seq",
              before: dict[str, str] | None = None, first: dict[str, Column] | None = None, short: int = BLOCK_ROWS,
              counted: DataFrame | None = None) -> DataFrame:
    """``index_rows`` for tables whose keys are mostly short, with looks back in the same pass; ``slot`` has no nulls.

    ``before`` names columns of the row before, ``first`` the place of the first
    row so far, the row itself included, that meets a condition.  Keys are dealt
    to ``KEY_GROUPS`` groups; only those in groups of more than ``short`` rows
    are cut into slots, so a key that stays in one piece has no more rows than that.
    ``counted`` has the same keys as often and is counted where ``df`` is costly.
    """
    keys, before, first = list(keys), before or {}, first or {}
    group = F.pmod(F.hash(*keys), F.lit(KEY_GROUPS))
    crowded = ((df if counted is None else counted).groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_many"))
               .where(F.col("_many") > short))
    w = Window.partitionBy(*keys, "_slot").orderBy(*order)

    def numbered(how: str) -> DataFrame:
        d = df.withColumn("_group", group).join(F.broadcast(crowded), "_group", how).withColumn("_slot", F.when(F.col("_many").isNotNull(), slot))
        d = d.withColumns({"_rn": F.row_number().over(w), **{k: F.lag(c).over(w) for k, c in before.items()}}).drop("_group", "_many")
        return d.withColumns({k: F.min(F.when(c, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in first.items()})

    ends = numbered("inner").groupBy(*keys, "_slot").agg(
        F.max("_rn").alias("_n"), *[F.max_by(c, "_rn").alias(f"_b_{k}") for k, c in before.items()], *[F.min(k).alias(f"_f_{k}") for k in first])
    along = Window.partitionBy(*keys).orderBy("_slot")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    carry = ends.select(*keys, "_slot", "_off", *[F.lag(f"_b_{k}").over(along).alias(f"_b_{k}") for k in before],
                        *[F.min(F.col("_off") + F.col(f"_f_{k}") - 1).over(past).alias(f"_f_{k}") for k in first])
    off = F.coalesce("_off", F.lit(0))
    return (numbered("left").join(carry, [*keys, "_slot"], "left")
            .withColumns({name: (off + F.col("_rn") - 1).cast("long"), **{k: F.when(F.col("_rn") == 1, F.col(f"_b_{k}")).otherwise(F.col(k)) for k in before},
                          **{k: F.least(f"_f_{k}", off + F.col(k) - 1) for k in first}})
            .drop("_slot", "_off", "_rn", *[f"_b_{k}" for k in before], *[f"_f_{k}" for k in first]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that are known to be non-null on both sides."""
    return left.join(right, list(keys), "inner")


def over_blocks(df: DataFrame, keys: Sequence[str], exprs: Callable[[WindowSpec], dict[str, Column]],
                back: int = 0, fwd: int = 0, seq: str = "seq", block: int = BLOCK_ROWS) -> DataFrame:
    """Window expressions that look at most ``back`` rows behind and ``fwd`` ahead.

    Rows are cut into blocks of ``block`` consecutive rows per key; rows near a
    block edge are also sent to the neighbouring block, so each (key, block)
    window is complete and no task sees more than ``block + back + fwd`` rows.
    """
    if max(back, fwd) > block:
        raise ValueError("block must be at least as long as the look-back and look-ahead")
    pos = F.pmod(F.col(seq), F.lit(block))
    home = F.floor(F.col(seq) / block).cast("long")
    dest = [home]
    if back:
        dest.append(F.when(pos >= block - back, home + 1))
    if fwd:
        dest.append(F.when((pos < fwd) & (home > 0), home - 1))
    d = df.withColumn("_home", home)
    if len(dest) == 1:
        d = d.withColumn("_blk", F.col("_home"))
    else:
        d = d.withColumn("_blk", F.explode(F.array_compact(F.array(*dest))))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    for name, col in exprs(w).items():
        d = d.withColumn(name, col)
    return d.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str, seq: str = "seq",
                block: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running total of ``value`` per key in ``seq`` order."""
    return running_sums(df, keys, {name: value}, seq, block)


def running_sums(df: DataFrame, keys: Sequence[str], values: dict[str, Column], seq: str = "seq", block: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running totals of several values per key in ``seq`` order, by one window and one table of blocks."""
    keys, names = list(keys), list(values)
    d = df.withColumn("_blk", F.floor(F.col(seq) / block).cast("long")).withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    sums = d.groupBy(*keys, "_blk").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_blk", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(names))])
    here = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_a{i}": F.sum(f"_v{i}").over(here) for i in range(len(names))}).join(carry, [*keys, "_blk"])
    d = d.withColumns({n: F.col(f"_c{i}") + F.col(f"_a{i}") for i, n in enumerate(names)})
    return d.drop("_blk", *[f"_{k}{i}" for k in "vac" for i in range(len(names))])


def fill_along(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slot: Column,
               value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row, going along ``order``.

    ``slot`` must be non-decreasing along ``order``.  Order by descending time
    with a negated slot to take the next value instead of the previous one.
    """
    keys = list(keys)
    d = df.withColumn("_slot", slot).withColumn("_v", value)
    here = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_acc", F.last("_v", ignorenulls=True).over(here))
    tails = (d.withColumn("_end", F.lead(F.lit(1)).over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
             .where(F.col("_end").isNull()).select(*keys, "_slot", F.col("_acc").alias("_tail")))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_slot", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return d.join(carry, [*keys, "_slot"]).withColumn(name, F.coalesce("_acc", "_carry")).drop(
        "_slot", "_v", "_acc", "_carry")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, width: float, name: str, upper: bool = False) -> DataFrame:
    """Exact interpolated median per key, or the upper of the two middle values.

    Equal values are counted together, the slot of width ``width`` that holds
    the middle is found from slot totals, and only that slot is sorted.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")).withColumn("_slot", F.floor(F.col("_v") / width).cast("long")))
    slots = counts.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    slots = (slots.withColumn("_cum", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(total))
             .withColumn("_lo", F.floor((F.col("_all") - 1) / 2)).withColumn("_hi", F.floor(F.col("_all") / 2))
             .where((F.col("_cum") > F.col("_lo")) & (F.col("_cum") - F.col("_n") <= F.col("_hi")))
             .select(*keys, "_slot", "_lo", "_hi", (F.col("_cum") - F.col("_n")).alias("_before")))
    in_slot = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    d = (counts.join(slots, [*keys, "_slot"])
         .withColumn("_to", F.col("_before") + F.sum("_c").over(in_slot)).withColumn("_from", F.col("_to") - F.col("_c")))
    low = F.max(F.when((F.col("_from") <= F.col("_lo")) & (F.col("_lo") < F.col("_to")), F.col("_v")))
    high = F.max(F.when((F.col("_from") <= F.col("_hi")) & (F.col("_hi") < F.col("_to")), F.col("_v")))
    return d.groupBy(*keys).agg((high if upper else (low + high) / 2).alias(name))


def score_slot(score: Column, tie_slot: Column, width: float = 1e-4) -> Column:
    """Slot for rows ordered by descending score, then by whatever ``tie_slot`` is monotone in.

    Rounded scores repeat a lot; rows whose score is a multiple of ``width`` are
    split further by ``tie_slot``, so a popular score is not one slot.
    """
    q = score / F.lit(width)
    exact = F.abs(q - F.rint(q)) < 1e-6
    return F.struct(F.when(exact, -F.rint(q)).otherwise(F.floor(-q)).cast("long").alias("s"), (~exact).cast("int").alias("e"),
                    F.when(exact, tie_slot.cast("long")).otherwise(F.lit(0)).alias("t"))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows per key with their place from 1.

    A row-number filter becomes a group limit that every map task applies before
    the shuffle, so a hot key sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("long"))
