"""Frame quality, brightness and lighting events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.functions.numbers import rounded
from framestory.plans.fold import FOLD_BLOCK_ROWS, ordered_fold
from framestory.plans.sequence import BLOCK_ROWS, fill_along, index_rows, over_blocks
from framestory.session import cut_lineage

LUMA_BINS = 256
QUALITY = ["normal", "low_light", "very_low_light", "unusable"]


def _luma(hist: pd.Series) -> pd.DataFrame:
    names = ["mean_luminance", "luminance_std", "dark_pixel_ratio", "histogram_spread"]
    out = pd.DataFrame(np.nan, index=range(len(hist)), columns=names)
    good = [i for i, x in enumerate(hist) if x is not None and len(x) == LUMA_BINS and not pd.isna(x).any() and np.sum(x) > 0]
    if good:
        out.iloc[good] = _luma_of(np.stack(hist.to_numpy()[good]).astype("int64"))[names].to_numpy()
    return out


def _luma_of(h: np.ndarray) -> pd.DataFrame:
    bins = np.arange(h.shape[1])
    n = h.sum(axis=1)
    mean = h @ bins / n
    spread = np.zeros(len(n))
    cum = h.cumsum(axis=1)
    for q, sign in ((0.95, 1.0), (0.05, -1.0)):
        pos = q * (n - 1)
        lo, hi = np.floor(pos), np.ceil(pos)
        at_lo, at_hi = ((cum <= r[:, None]).sum(axis=1) for r in (lo, hi))
        spread += sign * (at_lo + (at_hi - at_lo) * (pos - lo))
    return pd.DataFrame({"mean_luminance": mean, "luminance_std": np.sqrt(np.maximum(h @ (bins * bins) / n - mean * mean, 0.0)),
                         "dark_pixel_ratio": h[:, :30].sum(axis=1) / n, "histogram_spread": spread})


def luma_stats(frames: DataFrame, hist: str = "luma_hist") -> DataFrame:
    """Mean, deviation, dark share and p95 - p5 of a 256-bin luma histogram.

    A histogram that is null, incomplete, holds nulls or is empty gives nulls.
    256 steps of an interpreted array function per frame cost far more than one
    Arrow batch through numpy, so this one is a pandas UDF.
    """
    udf = F.pandas_udf(_luma, "mean_luminance double, luminance_std double, dark_pixel_ratio double, histogram_spread double")
    d = frames.withColumn("_l", udf(hist)).select("*", "_l.*").drop("_l")
    return d.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("mean_luminance", "luminance_std", "dark_pixel_ratio", "histogram_spread")})


def quality_class(frames: DataFrame, unusable_blur: float = 15.0, unusable_lum: float = 5.0, very_low_lum: float = 30.0,
                  very_low_dark: float = 0.60, low_lum: float = 60.0, low_dark: float = 0.30) -> DataFrame:
    lum, dark = F.col("mean_luminance"), F.col("dark_pixel_ratio")
    cls = (F.when((F.col("blur_score") < unusable_blur) | (lum < unusable_lum), "unusable")
           .when((lum < very_low_lum) & (dark >= very_low_dark), "very_low_light")
           .when((lum < low_lum) & (dark >= low_dark), "low_light").otherwise("normal"))
    return frames.withColumn("quality_class", cls).withColumn(
        "preprocessing", F.when(cls == "very_low_light", "clahe_gamma").when(cls == "low_light", "clahe").otherwise("off"))


def video_quality_report(classified: DataFrame, sample_rate: int = 1) -> DataFrame:
    """Per video: sampled means, class shares, dominant class and recommended preprocessing."""
    total = classified.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames"))
    s = classified.where(F.pmod(F.col("seq"), F.lit(sample_rate)) == 0)
    counts = {c: F.count(F.when(F.col("quality_class") == c, 1)) for c in QUALITY}
    d = s.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("mean_luminance").alias("mean_luminance"), F.avg("blur_score").alias("mean_blur_score"),
        *[e.alias("_" + c) for c, e in counts.items()])
    top = F.greatest(*["_" + c for c in QUALITY])
    dominant = F.when(F.col("_normal") == top, "normal")
    for c in QUALITY[1:]:
        dominant = dominant.when(F.col("_" + c) == top, c)
    d = (d.withColumn("low_light_ratio", (F.col("_low_light") + F.col("_very_low_light")) / F.col("_n"))
         .withColumn("very_low_light_ratio", F.col("_very_low_light") / F.col("_n"))
         .withColumn("unusable_ratio", F.col("_unusable") / F.col("_n")).withColumn("dominant_class", dominant)
         .withColumn("recommended", F.when(F.col("very_low_light_ratio") > 0.3, "clahe_gamma")
                     .when(F.col("low_light_ratio") > 0.3, "clahe").otherwise("off")))
    d = total.join(d, "video_id", "left").fillna(
        {"mean_luminance": 128.0, "mean_blur_score": 100.0, "low_light_ratio": 0.0, "very_low_light_ratio": 0.0,
         "unusable_ratio": 0.0, "dominant_class": "normal", "recommended": "off"})
    for c, p in (("mean_luminance", 2), ("mean_blur_score", 2), ("low_light_ratio", 3), ("very_low_light_ratio", 3), ("unusable_ratio", 3)):
        d = d.withColumn(c, rounded(F.col(c), p))
    return d.drop("_n", *["_" + c for c in QUALITY])


def drop_unusable(classified: DataFrame) -> DataFrame:
    """Frames that can be used; a video with none keeps all its frames."""
    some = classified.where(F.col("quality_class") != "unusable").select("video_id").distinct().withColumn("_some", F.lit(True))
    return (classified.join(some, "video_id", "left")
            .where(F.col("_some").isNull() | (F.col("quality_class") != "unusable")).drop("_some"))


def tag_detection_quality(det: DataFrame, classified: DataFrame) -> DataFrame:
    q = classified.select("video_id", "frame_number", F.col("quality_class").alias("lighting_condition"),
                          F.col("preprocessing").alias("preprocessing_mode"))
    return det.join(q, ["video_id", "frame_number"], "left").fillna({"lighting_condition": "unknown", "preprocessing_mode": "off"})


# Brightness ---------------------------------------------------------------------------


def forward_fill_brightness(frames: DataFrame, initial: float = 128.0, slot_frames: int = 4096) -> DataFrame:
    """Unreadable frames take the last readable brightness, 128 before the first."""
    d = fill_along(frames, ["video_id"], ["seq"], F.floor(F.col("seq") / slot_frames).cast("long"), F.col("brightness"), "raw_brightness")
    return d.withColumn("raw_brightness", F.coalesce("raw_brightness", F.lit(initial)))


def _middle(values: Column) -> Column:
    """Interpolated median of a short array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def median_smooth(frames: DataFrame, window: int = 5, block: int = BLOCK_ROWS) -> DataFrame:
    """Centred running median with shrinking edges."""
    half = window // 2
    d = over_blocks(frames, ["video_id"], lambda w: {
        "_near": F.collect_list("raw_brightness").over(w.rowsBetween(-half, half))}, back=half, fwd=half, block=block)
    return d.withColumn("smoothed", _middle(F.col("_near"))).drop("_near")


def rolling_baseline(frames: DataFrame, window_ms: float = 2000.0) -> DataFrame:
    """Median of the earlier smoothed values at most ``window_ms`` old, the row itself excluded.

    Rows without such a past take the median of the video's first ten values.
    Each row is also sent to the next time bucket, so a (video, bucket) window
    holds two buckets of frames whatever the length of the video.
    """
    t = F.floor(F.col("timestamp_ms") * 1000).cast("long")
    width = int(window_ms * 1000)
    d = frames.withColumn("_t", t).withColumn("_home", F.floor(F.col("_t") / width).cast("long"))
    d = d.withColumn("_b", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy("video_id", "_b").orderBy("_t").rangeBetween(-width, -1)
    d = d.withColumn("_past", F.collect_list("smoothed").over(w)).where(F.col("_b") == F.col("_home"))
    first = (frames.where(F.col("seq") < 10).groupBy("video_id").agg(F.collect_list("smoothed").alias("_f"))
             .withColumn("_first", _middle(F.col("_f"))).select("video_id", "_first"))
    return (d.join(first, "video_id").withColumn("baseline", F.when(F.size("_past") > 0, _middle(F.col("_past"))).otherwise(F.col("_first")))
            .drop("_t", "_home", "_b", "_past", "_first"))


def brightness_profile(frames: DataFrame) -> DataFrame:
    """Raw, smoothed and baseline brightness and their difference, rounded to 2 places."""
    d = rolling_baseline(median_smooth(forward_fill_brightness(frames)))
    d = d.withColumn("delta", rounded(F.col("smoothed") - F.col("baseline"), 2))
    for c in ("raw_brightness", "smoothed", "baseline"):
        d = d.withColumn(c, rounded(F.col(c), 2))
    return d


LIGHT_OUT = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("frame_number", T.LongType()), T.StructField("timestamp_ms", T.DoubleType()),
    T.StructField("brightness_before", T.DoubleType()), T.StructField("brightness_after", T.DoubleType()),
    T.StructField("delta", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("fired_seq", T.LongType())])


def lighting_step(threshold: float, min_run: int):
    """State: run lengths and pending starts for both directions.

    A pending start survives a change of sign and is cleared only by firing or
    by a frame inside the threshold.
    """
    names = ("light_turned_on", "light_turned_off")

    def step(state, rows, last):
        runs, starts = state or [[0, 0], [None, None]]
        out = []
        deltas = np.asarray(rows["delta"], float)
        outside = np.flatnonzero((deltas >= threshold) | (deltas <= -threshold))  # the others only clear what is pending
        far = [np.asarray(rows[c])[outside].tolist() for c in ("seq", "frame_number", "timestamp_ms", "baseline", "smoothed", "delta")]
        before_it = -1
        for at, seq, frame, t, base, smooth, delta in zip(outside.tolist(), *far):
            if at != before_it + 1:
                runs, starts = [0, 0], [None, None]
            before_it, side = at, 0 if delta >= threshold else 1
            runs[side] += 1
            runs[1 - side] = 0
            if starts[side] is None:
                starts[side] = [int(frame), float(t), float(base)]
            if runs[side] >= min_run:
                f, ms, before = starts[side]
                conf = min(0.97, 0.55 + abs(delta) / (threshold * 4) * 0.42)
                out.append({"event_type": names[side], "frame_number": f, "timestamp_ms": ms, "brightness_before": before,
                            "brightness_after": float(smooth), "delta": float(delta), "confidence": conf, "fired_seq": int(seq)})
                runs[side], starts[side] = 0, None
        if before_it + 1 != len(deltas):
            runs, starts = [0, 0], [None, None]
        return [runs, starts], out

    return step


def lighting_steps(thresholds: Sequence[float], min_run: int):
    """``lighting_step`` of several thresholds over the same rows; events carry their threshold."""
    steps = [(t, lighting_step(t, min_run)) for t in thresholds]

    def step(state, rows, last):
        states, out = [], []
        for (t, one), before in zip(steps, state or [None] * len(steps)):
            after, events = one(before, rows, last)
            states.append(after)
            out += [{**e, "threshold": t} for e in events]
        return states, out

    return step


def lighting_events(profile: DataFrame, threshold: float = 10.0, min_run: int = 2, block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Raw light-on and light-off events; videos with fewer than four frames have none."""
    return lighting_events_at(profile, (threshold,), min_run, block).drop("threshold")


def lighting_events_at(profile: DataFrame, thresholds: Sequence[float], min_run: int = 2, block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """``lighting_events`` for several thresholds, all in one pass; column ``threshold``."""
    long_enough = profile.where(F.col("seq") == 3).select("video_id")
    d = profile.select("video_id", "seq", "frame_number", "timestamp_ms", "baseline", "smoothed", "delta").join(long_enough, "video_id", "left_semi")
    events = T.StructType([*LIGHT_OUT.fields, T.StructField("threshold", T.DoubleType())])
    out = ordered_fold(d, ["video_id"], lighting_steps(thresholds, min_run), events, block=block)
    return out.withColumn("confidence", rounded(F.col("confidence"), 4))


MERGED_OUT = T.StructType(LIGHT_OUT.fields)


def merge_step(gap_ms: float):
    """Keep the more confident of same-type neighbours; the kept event is the next comparison point."""
    fields = [f.name for f in LIGHT_OUT.fields]

    def step(state, rows, last):
        kept = state
        out = []
        for values in zip(*(rows[c] for c in fields)):
            e = {k: (v.item() if hasattr(v, "item") else v) for k, v in zip(fields, values)}
            if kept is not None and e["event_type"] == kept["event_type"] and e["timestamp_ms"] - kept["timestamp_ms"] <= gap_ms:
                if e["confidence"] > kept["confidence"]:
                    kept = e
            else:
                if kept is not None:
                    out.append(kept)
                kept = e
        if last and kept is not None:
            out.append(kept)
        return kept, out

    return step


def merge_lighting(events: DataFrame, gap_ms: float = 800.0, block: int = FOLD_BLOCK_ROWS, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    d = index_rows(events, keys, ["fired_seq"], F.floor(F.col("fired_seq") / 65_536).cast("long"))
    return ordered_fold(d, keys, merge_step(gap_ms), MERGED_OUT, block=block)


def brightness_timeline(profile: DataFrame, points: int = 100) -> DataFrame:
    """About ``points`` evenly spaced rows per video."""
    n = profile.groupBy("video_id").agg((F.max("seq") + 1).alias("_n"))
    d = profile.join(n, "video_id").withColumn("_step", F.greatest(F.floor(F.col("_n") / points).cast("long"), F.lit(1)))
    return (d.where(F.pmod("seq", "_step") == 0)
            .select("video_id", "frame_number", rounded(F.col("timestamp_ms") / 1000, 2).alias("timestamp_s"),
                    *[rounded(F.col(c), 1).alias(c) for c in ("raw_brightness", "smoothed", "baseline", "delta")]))


def brightness_range(profile: DataFrame) -> DataFrame:
    return profile.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), rounded(F.min("raw_brightness"), 1).alias("min_brightness"),
        rounded(F.max("raw_brightness"), 1).alias("max_brightness"), rounded(F.avg("raw_brightness"), 1).alias("mean_brightness"))


def threshold_comparison(profile: DataFrame, thresholds: tuple[float, ...] = (10.0, 15.0, 20.0), gap_ms: float = 800.0) -> DataFrame:
    """Merged lighting events per video, type and threshold."""
    keys = ["threshold", "video_id"]
    events = cut_lineage(lighting_events_at(profile, [float(t) for t in thresholds]))
    return merge_lighting(events, gap_ms, keys=keys).groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("confidence").alias("max_confidence"))
