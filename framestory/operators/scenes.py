"""Scene change scoring and segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.plans.fold import FOLD_BLOCK_ROWS, ordered_fold
from framestory.plans.sequence import BLOCK_ROWS, index_rows, over_blocks, running_sum

VIDEO = ["video_id"]


def _correlation_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - Pearson correlation of two histograms, in [0, 1]; constant histograms count as identical."""
    out = np.full(len(a), np.nan)
    both = (a.notna() & b.notna()).to_numpy()
    if both.any():
        x, y = np.stack(a[both].to_numpy()).astype("float64"), np.stack(b[both].to_numpy()).astype("float64")
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        den = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        corr = np.where(den < 1e-10, 1.0, (x * y).sum(axis=1) / np.where(den < 1e-10, 1.0, den))
        out[both] = np.clip(1.0 - corr, 0.0, 1.0)
    return pd.Series(out).astype(object).where(both, None)


def correlation_distance(a: Column, b: Column) -> Column:
    """Arrow batches through numpy: array lambdas are interpreted bin by bin and several times slower."""
    return F.pandas_udf(_correlation_distance, "double")(a, b)


def histogram_diff(frames: DataFrame, hist: str = "color_hist", block: int = BLOCK_ROWS) -> DataFrame:
    """Distance to the previous frame's histogram; null for the first frame."""
    d = over_blocks(frames, VIDEO, lambda w: {"_prev": F.lag(hist).over(w)}, back=1, block=block)
    return d.withColumn("histogram_diff", correlation_distance(F.col("_prev"), F.col(hist))).drop("_prev")


def composite_score(frames: DataFrame, pixel_weight: float = 0.4, histogram_weight: float = 0.6) -> DataFrame:
    if abs(pixel_weight + histogram_weight - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    return frames.withColumn("composite", pixel_weight * F.col("pixel_diff") + histogram_weight * F.col("histogram_diff"))


def adaptive_threshold(frames: DataFrame, window: int = 50, k: float = 1.5, prefill: float = 0.05, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean plus k deviations of the previous ``window`` composites.

    The window starts filled with ``prefill``; the part still filled with it is
    merged in closed form with the mean and deviation of the real rows.
    """
    def stats(w):
        past = w.rowsBetween(-window, -1)
        return {"_m": F.count("composite").over(past), "_a": F.avg("composite").over(past), "_s": F.stddev_pop("composite").over(past)}

    d = over_blocks(frames, VIDEO, stats, back=window, block=max(block, window))
    m, a = F.col("_m"), F.coalesce("_a", F.lit(prefill))
    mean = (m * a + (window - m) * prefill) / window
    m2 = m * F.coalesce("_s", F.lit(0.0)) * F.coalesce("_s", F.lit(0.0)) + (a - prefill) * (a - prefill) * m * (window - m) / window
    return d.withColumn("adaptive_threshold", mean + k * F.sqrt(m2 / window)).drop("_m", "_a", "_s")


def classify_scene_frame(frames: DataFrame, hard_cut: float = 0.70, duplicate: float = 0.02) -> DataFrame:
    """Hard cut, boundary, duplicate and keyframe flags with a reason.

    The first frame of a video is always a keyframe; a frame without features
    counts as a duplicate.
    """
    first = F.col("seq") == 0
    c, t = F.col("composite"), F.col("adaptive_threshold")
    missing = ~first & c.isNull()
    no = F.lit(False)
    d = (frames.withColumn("is_hard_cut", F.coalesce(~first & (c > hard_cut), no))
         .withColumn("is_boundary", F.coalesce(~first & ((c > hard_cut) | (c > t)), no))
         .withColumn("is_duplicate", missing | F.coalesce(~first & (c < duplicate), no))
         .withColumn("is_keyframe", first | (F.col("is_boundary") & ~F.col("is_duplicate"))))
    kind = (F.when(first, "first_frame").when(F.col("is_duplicate"), "duplicate").when(F.col("is_hard_cut"), "hard_cut")
            .when(F.col("is_boundary"), "adaptive_boundary").otherwise("normal"))
    text = F.when(first | missing, kind).otherwise(F.format_string("%s: composite=%.4f, threshold=%.4f", kind, c, t))
    return d.withColumn("decision", kind).withColumn("decision_reason", text)


SPACED_OUT = T.StructType([T.StructField("frame_number", T.LongType()), T.StructField("kept", T.BooleanType())])


def spaced_step(column: str, gap: float, name: str, strict: bool = False):
    """Keep a row when it lies far enough behind the last kept one; state is that row's value."""
    def step(state, rows, last):
        ref = state
        out = []
        for v, ident in zip(rows[column], rows[name]):
            far = ref is None or (v - ref > gap if strict else v - ref >= gap)
            if far:
                ref = v.item() if hasattr(v, "item") else v
            out.append({name: int(ident), "kept": bool(far)})
        return ref, out

    return step


def enforce_min_scene(frames: DataFrame, min_frames: int = 3, block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Final boundaries and keyframes: a boundary too close to the last kept one is neither.

    Only boundary candidates enter the fold; all other frames are unaffected.
    """
    cand = frames.where(F.col("is_boundary") & ~F.col("is_duplicate")).select("video_id", "frame_number")
    cand = index_rows(cand, VIDEO, ["frame_number"], F.floor(F.col("frame_number") / 65_536).cast("long"))
    kept = ordered_fold(cand, VIDEO, spaced_step("frame_number", min_frames, "frame_number"), SPACED_OUT, block=block)
    # The fold starts with a virtual boundary at -min_frames, so the first candidate is always kept.
    d = frames.join(kept.withColumnRenamed("kept", "_kept"), ["video_id", "frame_number"], "left")
    return (d.withColumn("scene_boundary", F.coalesce("_kept", F.lit(False)))
            .withColumn("final_keyframe", ~F.col("is_duplicate") & F.coalesce("_kept", F.lit(True))).drop("_kept"))


def scene_segments(frames: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Contiguous scenes between boundaries, with their keyframe count.

    A scene's end time is that of the frame right before the next boundary when
    such a frame exists, else its start time.
    """
    d = running_sum(frames, VIDEO, F.col("scene_boundary").cast("int"), "_boundaries", block=block)
    first = F.min(F.struct("seq", "frame_number", "timestamp_ms", "decision_reason"))
    s = d.groupBy("video_id", "_boundaries").agg(
        first.alias("_f"), F.max(F.struct("seq", "frame_number", "timestamp_ms")).alias("_l"),
        F.count(F.when(F.col("is_keyframe"), 1)).alias("keyframes"), F.count(F.lit(1)).alias("frames"))
    s = index_rows(s, VIDEO, ["_boundaries"], F.floor(F.col("_boundaries") / 65_536).cast("long"), "_i")
    s = over_blocks(s, VIDEO, lambda w: {"_next": F.lead("_f.frame_number").over(w)}, fwd=1, seq="_i", block=block)
    end = F.coalesce(F.col("_next") - 1, F.col("_l.frame_number"))
    return (s.withColumn("scene_index", F.col("_boundaries").cast("long"))
            .withColumn("start_frame", F.col("_f.frame_number")).withColumn("end_frame", end)
            .withColumn("start_ms", F.col("_f.timestamp_ms"))
            .withColumn("end_ms", F.when(F.col("_l.frame_number") == F.col("end_frame"), F.col("_l.timestamp_ms")).otherwise(F.col("start_ms")))
            .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
            .withColumn("boundary_reason", F.when(F.col("scene_index") == 0, "start_of_video").otherwise(F.col("_f.decision_reason")))
            .select("video_id", "scene_index", "start_frame", "end_frame", "start_ms", "end_ms", "duration_ms", "keyframes", "frames", "boundary_reason"))


def scene_metrics(frames: DataFrame) -> DataFrame:
    positive = F.when(F.col("composite") > 0, F.col("composite"))
    d = frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_frames"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicates"),
        F.count(F.when(F.col("final_keyframe"), 1)).alias("keyframes"), F.count(F.when(F.col("scene_boundary"), 1)).alias("boundaries"),
        F.count(F.when(F.col("is_hard_cut") & F.col("scene_boundary"), 1)).alias("hard_cuts"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("avg_composite"), F.coalesce(F.max(positive), F.lit(0.0)).alias("max_composite"))
    return (d.withColumn("duplicate_rate", F.col("duplicates") / F.col("total_frames"))
            .withColumn("reduction_ratio", F.when(F.col("keyframes") > 0, F.col("total_frames") / F.col("keyframes")).otherwise(0.0)))


def choose_detection_frames(frames: DataFrame, minimum: int = 30) -> DataFrame:
    """Keyframes when a video has enough of them, otherwise all its frames."""
    n = frames.groupBy("video_id").agg(F.count(F.when(F.col("final_keyframe"), 1)).alias("_k"))
    return (frames.join(n, "video_id").where((F.col("_k") < minimum) | F.col("final_keyframe"))
            .withColumn("frame_source", F.when(F.col("_k") >= minimum, "keyframes").otherwise("all_frames")).drop("_k"))
