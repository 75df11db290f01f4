"""Confidence dimensions and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions.numbers import clip01, rounded
from framestory.plans.intervals import bucket

TRACK = ["video_id", "track_id"]
DIMS = ["detection", "motion", "rule", "track_stability", "scene_reliability"]


def camera_frame_counts(events: DataFrame, camera: DataFrame, width: int = 512) -> DataFrame:
    """Camera-motion frames inside each event's inclusive frame range.

    Whole buckets are counted from per-bucket totals; only the two edge buckets
    of a range meet single frames, so long events do not multiply rows.
    """
    ranges = events.select("video_id", "start_frame", "end_frame").distinct()
    lo, hi = bucket(F.col("start_frame"), width), bucket(F.col("end_frame"), width)
    cam = camera.select("video_id", "frame_number").withColumn("_b", bucket(F.col("frame_number"), width))
    totals = cam.groupBy("video_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    spans = ranges.withColumn("_b", F.explode(F.sequence(lo, F.greatest(lo, hi)))).withColumn(
        "_edge", (F.col("_b") == lo) | (F.col("_b") == hi))
    keys = ["video_id", "start_frame", "end_frame"]
    inner = spans.where(~F.col("_edge")).join(totals, ["video_id", "_b"]).select(*keys, F.col("_n").alias("_k"))
    edge = (spans.where(F.col("_edge")).join(cam, ["video_id", "_b"])
            .where(F.col("frame_number").between(F.col("start_frame"), F.col("end_frame")))
            .select(*keys, F.lit(1).cast("long").alias("_k")))
    return inner.unionByName(edge).groupBy(*keys).agg(F.sum("_k").alias("camera_frames"))


def confidence_dims(events: DataFrame, tracks: DataFrame, profiles: DataFrame, camera: DataFrame,
                    full_stability: float = 10.0, full_penalty: float = 0.7) -> DataFrame:
    """The five dimensions of every event, unrounded."""
    t = tracks.select(*TRACK, F.col("avg_confidence").alias("_det"), F.col("n_obs").alias("_n"))
    p = profiles.select(*TRACK, F.col("motion_confidence").alias("_mot"))
    d = (events.join(t, TRACK, "left").join(p, TRACK, "left")
         .join(camera_frame_counts(events, camera), ["video_id", "start_frame", "end_frame"], "left"))
    share = F.coalesce(F.col("camera_frames"), F.lit(0)) / (F.col("end_frame") - F.col("start_frame") + 1)
    return (d.withColumn("detection", F.coalesce(F.col("_det"), F.col("confidence")))
            .withColumn("motion", F.coalesce(F.col("_mot"), F.lit(0.5)))
            .withColumn("rule", F.coalesce(F.col("rule_confidence"), F.lit(fixed.DEFAULT_RULE_PRIOR)))
            .withColumn("track_stability", F.coalesce(F.least(F.col("_n") / full_stability, F.lit(1.0)), F.lit(0.5)))
            .withColumn("scene_reliability", 1.0 - 0.6 * F.least(share / full_penalty, F.lit(1.0)))
            .drop("_det", "_n", "_mot", "camera_frames"))


def fuse(strategy: str = "weighted_linear", weights: tuple[float, ...] = fixed.FUSION_WEIGHTS["default"]) -> Column:
    """Fused confidence over the five dimension columns."""
    if abs(sum(weights) - 1.0) > 0.01:
        raise ValueError("fusion weights must sum to 1")
    cols = [F.col(c) for c in DIMS]
    if strategy == "weighted_linear":
        out = sum((c * w for c, w in zip(cols[1:], weights[1:])), cols[0] * weights[0])
    elif strategy == "geometric":
        parts = [F.pow(F.greatest(c, F.lit(1e-6)), F.lit(w)) for c, w in zip(cols, weights)]
        out = parts[0] * parts[1] * parts[2] * parts[3] * parts[4]
    elif strategy == "harmonic":
        parts = [F.lit(w) / F.greatest(c, F.lit(1e-6)) for c, w in zip(cols, weights)]
        out = 1.0 / (parts[0] + parts[1] + parts[2] + parts[3] + parts[4])
    elif strategy == "min":
        return F.least(*cols)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return clip01(out)


def with_fused(dims: DataFrame, strategy: str = "weighted_linear",
               weights: tuple[float, ...] = fixed.FUSION_WEIGHTS["default"]) -> DataFrame:
    """Dimensions and fused value, each rounded to 4 places after fusing."""
    d = dims.withColumn("_fused", fuse(strategy, weights))
    for c in DIMS:
        d = d.withColumn(c, rounded(F.col(c), 4))
    return d.withColumn("fused", rounded(F.col("_fused"), 4)).drop("_fused")


def fusion_filter(fused: DataFrame, minimum: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) events; kept events carry the fused value as confidence."""
    f = fused.withColumn("confidence", F.col("fused"))
    return f.where(F.col("fused") >= minimum), f.where(F.col("fused") < minimum)


def weakest_and_strongest(fused: DataFrame) -> DataFrame:
    """Name of the lowest and highest dimension; the earlier dimension wins ties."""
    low, high = F.least(*DIMS), F.greatest(*DIMS)

    def first_at(level: Column) -> Column:
        out = F.when(F.col(DIMS[0]) == level, DIMS[0])
        for d in DIMS[1:]:
            out = out.when(F.col(d) == level, d)
        return out

    return fused.withColumn("weakest", first_at(low)).withColumn("strongest", first_at(high))


def fusion_metrics(fused: DataFrame, minimum: float = 0.35) -> DataFrame:
    positive = F.when(F.col("fused") > 0, F.col("fused"))
    return fused.groupBy("video_id").agg(
        F.count(F.when(F.col("fused") >= minimum, 1)).alias("total_fused"),
        F.count(F.when(F.col("fused") < minimum, 1)).alias("total_discarded"),
        F.avg(positive).alias("avg_fused"), F.min(positive).alias("min_fused"), F.max(positive).alias("max_fused"),
        *[F.avg(c).alias("mean_" + c) for c in DIMS])
