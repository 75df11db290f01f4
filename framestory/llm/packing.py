"""Packing clips into reels: hierarchical residual best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.session import cut_lineage

TASK_ROWS, FAN_IN, NEARLY_FULL, LEAST_GAIN = 60_000, 8, 0.998, 0.002


def best_fit(fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items in the given order: each item's bin (the number of its first item), its place, and the bins' fills.

    Open bins are kept by residual; a bit mask of residuals in use gives the
    smallest that is large enough.  An item above the capacity has its own bin.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    owner, offset, total = np.zeros(len(fills), np.int64), np.zeros(len(fills), np.int64), np.zeros(len(fills), np.int64)
    for i, s in enumerate(fills.tolist()):
        room = mask >> s
        if s <= capacity and room:
            r = s + (room & -room).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
        else:
            b, r = i, capacity
        owner[i], offset[i] = b, total[b]
        total[b] += s
        if s <= r:
            open_bins[r - s].append(b)
            mask |= 1 << (r - s)
    return owner, offset, total


def _round(bins: DataFrame, capacity: int, parts: int, salt: int) -> DataFrame:
    """One round: ``(bin, into, shift, fill)`` for every open bin, packed within ``parts`` partitions."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pdf for pdf in frames if len(pdf)]
        if not rows:
            return
        own = pd.concat(rows).sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        names, fills = own["bin"].to_numpy(np.int64), own["fill"].to_numpy(np.int64)
        owner, offset, total = best_fit(fills, capacity)
        yield pd.DataFrame({"bin": names, "into": names[owner], "shift": offset, "fill": total[owner]})

    spread = bins.select("bin", "fill").withColumn("_p", F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(parts)))
    return cut_lineage(spread.repartition(parts, "_p").drop("_p").mapInPandas(run, "bin long, into long, shift long, fill long"))


def pack_clips(clips: DataFrame, length: str = "frames", capacity: int = 2048, task_rows: int = TASK_ROWS) -> DataFrame:
    """Clips packed into as few reels of at most ``capacity`` frames as best fit finds.

    Partitions pack their clips best-fit, longest first.  Reels that are nearly
    full are done; the others are items of their fill in the next round, in which
    partitions are merged ``FAN_IN`` to one, while a task gets about ``task_rows``
    items at most.  It ends with one partition, or when a round saves next to
    nothing.  Every column of ``clips`` stays; ``reel_id`` (long) and ``offset``
    (long, gapless from 0 in each reel) are added, replacing columns of these names.

    Null and negative lengths count 0 and take a place without frames; a clip
    above the capacity has a reel of its own; repeated rows are clips of their
    own; an empty table gives an empty result.
    """
    own = [c for c in clips.columns if c not in ("reel_id", "offset")]
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    items = cut_lineage(clips.select(F.struct(*own).alias("clip"), size.alias("fill")).withColumn("bin", F.monotonically_increasing_id()))
    place = items.select("clip", "bin", F.lit(0).cast("long").alias("offset"))
    full = int(capacity * NEARLY_FULL)
    bins = items.where(F.col("fill") < full).select("bin", "fill")
    n = bins.count()
    parts, salt = max(1, -(-n // task_rows)), 0
    while n:
        step = _round(bins, capacity, parts, salt)
        moved = step.select(F.col("bin").alias("_b"), "into", "shift")
        place = cut_lineage(place.join(moved, place["bin"] == moved["_b"], "left").select(
            "clip", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
        bins = step.where((F.col("bin") == F.col("into")) & (F.col("fill") < full)).select("bin", "fill")
        after = bins.count()
        if parts == 1 or after > n * (1 - LEAST_GAIN):
            break
        n, salt, parts = after, salt + 1, max(-(-after // task_rows), -(-parts // FAN_IN))
    return place.select("clip.*", F.col("bin").alias("reel_id"), "offset")
