"""Ingest checks and frame sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory import fixed
from framestory.functions.text import hh_mm_ss
from framestory.plans.fold import FOLD_BLOCK_ROWS, ordered_fold
from framestory.plans.sequence import BLOCK_ROWS, over_blocks


def validate_video_rows(videos: DataFrame) -> DataFrame:
    """Errors and warnings per file; a wrong extension, emptiness or size ends the checks early."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    early = F.array_compact(F.array(
        F.when(~ext.isin(*fixed.VIDEO_EXTENSIONS), F.concat(F.lit("unsupported extension "), ext)),
        F.when(F.col("size_bytes") > fixed.MAX_FILE_BYTES, F.lit("file too large"))))
    early = F.when(F.col("size_bytes") == 0, F.array(F.lit("file is empty"))).otherwise(early)
    late = F.array_compact(F.array(
        F.when(F.col("duration_seconds") <= 0, F.lit("zero or unknown duration")),
        F.when((F.col("width") < 64) | (F.col("height") < 64), F.lit("resolution below 64x64")),
        F.when(F.col("fps") <= 0, F.lit("invalid fps"))))
    warn = F.array_compact(F.array(
        F.when(~F.lower("codec").isin(*fixed.VIDEO_CODECS), F.concat(F.lit("unknown codec "), F.lower("codec"))),
        F.when(F.col("fps") > 240, F.lit("very high fps"))))
    d = videos.withColumn("_early", early)
    stop = F.size("_early") > 0
    d = d.withColumn("errors", F.when(stop, F.col("_early")).otherwise(late)).withColumn(
        "warnings", F.when(stop, F.array().cast("array<string>")).otherwise(warn))
    return d.withColumn("is_valid", F.size("errors") == 0).drop("_early")


def processing_profile(videos: DataFrame) -> DataFrame:
    """Profile and frame skip by duration; an explicit setting wins."""
    s = F.col("duration_seconds")
    bands = [(30, "QUICK_TEST", 2), (300, "SHORT", 3), (600, "STANDARD", 5), (3600, "LONG", 10)]
    name, skip = None, None
    for limit, n, k in bands:
        name = F.when(s <= limit, n) if name is None else name.when(s <= limit, n)
        skip = F.when(s <= limit, k) if skip is None else skip.when(s <= limit, k)
    d = videos.withColumn("processing_profile", name.otherwise("EXTENDED"))
    return (d.withColumn("frame_skip", F.coalesce(F.col("frame_skip_setting"), skip.otherwise(15).cast("long")))
            .withColumn("skip_source", F.when(F.col("frame_skip_setting").isNotNull(), "settings")
                        .otherwise(F.concat(F.lit("profile:"), F.col("processing_profile")))))


def duration_profile(videos: DataFrame, frame_skip: int = 5) -> DataFrame:
    """Named duration band with interpolated processing time."""
    s = F.col("duration_seconds")
    name, est = None, None
    for i, (n, lo, hi, base) in enumerate(fixed.DURATION_BANDS):
        here = (s >= lo) & (s < hi)
        name = F.when(here, n) if name is None else name.when(here, n)
        if base is not None:
            nxt = fixed.DURATION_BANDS[i + 1][3] if i + 1 < len(fixed.DURATION_BANDS) else base * 2
            value = F.floor(base + (s - lo) / max(1.0, hi - lo) * ((nxt or base * 2) - base)).cast("long")
            est = F.when(here, value) if est is None else est.when(here, value)
    frames = F.greatest(F.floor(F.floor(s * F.col("fps")) / frame_skip).cast("long"), F.lit(1))
    return (videos.withColumn("profile", name.otherwise("Custom")).withColumn("estimated_processing_s", est)
            .withColumn("estimated_frames", frames)
            .withColumn("estimated_keyframes", F.greatest(F.floor(F.col("estimated_frames") / 5).cast("long"), F.lit(1)))
            .withColumn("duration_hms", hh_mm_ss(s)))


def fixed_stride_sample(frames: DataFrame, n: int, index: str = "seq") -> DataFrame:
    return frames.where(F.pmod(F.col(index), F.lit(n)) == 0)


@dataclass(frozen=True)
class SkipConfig:
    static_skip: int = 10
    low_skip: int = 6
    medium_skip: int = 3
    high_skip: int = 1
    protection_skip: int = 1
    ema_alpha: float = 0.25
    warmup: int = 25
    protection_threshold: float = 0.08
    protection_window: int = 15
    min_skip: int = 1
    max_skip: int = 15


def motion_tier(cfg: SkipConfig = SkipConfig()) -> tuple[Column, Column]:
    """(tier, raw skip) by motion fraction and warm-up, protection left aside."""
    m, warm = F.col("motion_fraction"), F.col("seq") < cfg.warmup
    tier = (F.when(warm, "MEDIUM_MOTION").when(m < 0.005, "STATIC").when(m < 0.020, "LOW_MOTION")
            .when(m < cfg.protection_threshold, "MEDIUM_MOTION").otherwise("HIGH_MOTION"))
    skip = (F.when(warm, cfg.medium_skip).when(m < 0.005, cfg.static_skip).when(m < 0.020, cfg.low_skip)
            .when(m < cfg.protection_threshold, cfg.medium_skip).otherwise(cfg.high_skip))
    return tier, F.when(warm, skip).otherwise(F.greatest(F.least(skip, F.lit(cfg.max_skip)), F.lit(cfg.min_skip)))


def protection(frames: DataFrame, cfg: SkipConfig = SkipConfig(), signals: DataFrame | None = None,
               block: int = BLOCK_ROWS) -> DataFrame:
    """Protection flags per frame from motion spikes and external signals.

    A trigger protects its own frame and the next ``window - 1``; whether a
    frame is protected depends only on that many frames before it.  Signals
    during warm-up take effect on the first frame after it.
    """
    spike = (F.col("motion_fraction") >= cfg.protection_threshold) & (F.col("seq") >= cfg.warmup)
    d = frames
    if signals is not None:
        ext = signals.select("video_id", "frame_number").distinct().withColumn("_ext", F.lit(True))
        d = d.join(ext, ["video_id", "frame_number"], "left").withColumn("_ext", F.coalesce("_ext", F.lit(False)))
    else:
        d = d.withColumn("_ext", F.lit(False))
    d = d.withColumn("_spike", spike)
    look = max(cfg.warmup, cfg.protection_window)

    def early(w):
        held = F.max((F.col("_ext")).cast("int")).over(w.rowsBetween(-cfg.warmup, 0)) == 1
        return {"_trigger": F.when(F.col("seq") < cfg.warmup, False).when(F.col("seq") == cfg.warmup, F.col("_spike") | held)
                .otherwise(F.col("_spike") | F.col("_ext"))}

    d = over_blocks(d, ["video_id"], early, back=look, block=max(block, look))

    def window(w):
        span = w.rowsBetween(-(cfg.protection_window - 1), 0)
        prior = w.rowsBetween(-(cfg.protection_window - 1), -1)
        return {"protected": F.max(F.col("_trigger").cast("int")).over(span) == 1,
                "new_window": F.col("_trigger") & (F.coalesce(F.max(F.col("_trigger").cast("int")).over(prior), F.lit(0)) == 0)}

    d = over_blocks(d, ["video_id"], window, back=look, block=max(block, look))
    return d.withColumn("protection_reason", F.when(F.col("protected"), F.when(F.col("_spike"), "motion_spike").otherwise("window"))).drop(
        "_ext", "_spike", "_trigger")


SKIP_OUT = T.StructType([
    T.StructField("frame_number", T.LongType()), T.StructField("smoothed_skip", T.LongType()),
    T.StructField("selected", T.BooleanType())])


def skip_step(cfg: SkipConfig):
    """Step function: smoothed skip and the selection counter.

    State is [smoothed value, counter].  Only unprotected frames after warm-up
    move the smoothed value.
    """
    def step(state, rows, last):
        ema, counter = state or [3.0, 0]
        out = []
        for frame, idx, raw, prot in zip(rows["frame_number"], rows["seq"], rows["raw_skip"], rows["protected"]):
            if prot:
                skip = cfg.protection_skip
            elif idx < cfg.warmup:
                skip = cfg.medium_skip
            else:
                ema = cfg.ema_alpha * int(raw) + (1.0 - cfg.ema_alpha) * ema
                skip = max(cfg.min_skip, min(cfg.max_skip, round(ema)))
            chosen = counter == 0
            if chosen:
                counter = skip
            counter = max(0, counter - 1)
            out.append({"frame_number": int(frame), "smoothed_skip": skip, "selected": chosen})
        return [ema, counter], out

    return step


def adaptive_skip(frames: DataFrame, cfg: SkipConfig = SkipConfig(), signals: DataFrame | None = None,
                  block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Tier, skip, protection and selection per frame (``seq`` = position in the video)."""
    tier, raw = motion_tier(cfg)
    d = protection(frames, cfg, signals).withColumn("motion_tier", tier).withColumn("raw_skip", raw)
    d = (d.withColumn("motion_tier", F.when(F.col("protected"), "PROTECTED").otherwise(F.col("motion_tier")))
         .withColumn("raw_skip", F.when(F.col("protected"), cfg.protection_skip).otherwise(F.col("raw_skip"))))
    chosen = ordered_fold(d.select("video_id", "frame_number", "seq", "raw_skip", "protected"), ["video_id"],
                          skip_step(cfg), SKIP_OUT, block=block)
    return d.join(chosen, ["video_id", "frame_number"])


def protection_triggers(signals: DataFrame) -> DataFrame:
    """Audit rows of external triggers: one per frame and kind of signal."""
    kinds = [("roi_proximity", "roi_proximity"), ("track_count_changed", "new_track_appeared"),
             ("brightness_change", "brightness_spike")]
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(r)) for c, r in kinds]))
    return signals.withColumn("reason", F.explode(reasons)).select("video_id", "frame_number", "reason")


def trigger_counts(triggers: DataFrame) -> DataFrame:
    return triggers.groupBy("video_id", "reason").agg(F.count(F.lit(1)).alias("triggers"))


TIERS = ["STATIC", "LOW_MOTION", "MEDIUM_MOTION", "HIGH_MOTION", "PROTECTED"]


def skip_stats(scored: DataFrame) -> DataFrame:
    d = scored.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("selected"), 1)).alias("selected_frames"),
        F.avg("motion_fraction").alias("avg_motion"), F.max("motion_fraction").alias("max_motion"),
        F.avg("smoothed_skip").alias("avg_skip"), F.min("smoothed_skip").alias("min_skip"), F.max("smoothed_skip").alias("max_skip"),
        F.count(F.when(F.col("new_window"), 1)).alias("protected_windows"),
        F.count(F.when(F.col("protected"), 1)).alias("protected_frames"),
        *[F.count(F.when(F.col("motion_tier") == t, 1)).alias("tier_" + t.lower()) for t in TIERS])
    return (d.withColumn("skipped_frames", F.col("frames") - F.col("selected_frames"))
            .withColumn("sampling_ratio", F.col("selected_frames") / F.col("frames")))


def sampling_strategy_compare(scored: DataFrame, burst: tuple[int, int], stride: int = 5) -> DataFrame:
    """Fixed stride against adaptive selection: selected frames, ratio and share kept inside a burst."""
    inside = F.col("seq").between(*burst)

    def row(name, cond):
        return scored.groupBy("video_id").agg(
            F.count(F.lit(1)).alias("frames"), F.count(F.when(cond, 1)).alias("selected_frames"),
            F.count(F.when(inside, 1)).alias("burst_frames"), F.count(F.when(inside & cond, 1)).alias("burst_selected")).withColumn(
            "strategy", F.lit(name))

    d = row(f"fixed_skip_{stride}", F.pmod(F.col("seq"), F.lit(stride)) == 0).unionByName(row("adaptive", F.col("selected")))
    return (d.withColumn("ratio", F.col("selected_frames") / F.col("frames"))
            .withColumn("burst_retention", F.when(F.col("burst_frames") > 0, F.col("burst_selected") / F.col("burst_frames")).otherwise(0.0)))


@dataclass(frozen=True)
class SweepVariant:
    name: str
    warmup: int
    static_skip: int
    ema_alpha: float
    protection_threshold: float
    protection_window: int
    low_skip: int = 6
    medium_skip: int = 3
    high_skip: int = 1


SWEEP_VARIANTS = tuple(SweepVariant(*v) for v in fixed.SWEEP_VARIANTS)


def _swept(v: SweepVariant, state: list, places: list[int], motion: list[float]) -> tuple[list, list[int]]:
    """State after the frames and the places of the selected ones; smoothed motion instead of smoothed skip.

    The state is [smoothed, protected left, next forced frame].
    """
    ema, left, due = state
    taken = []
    for idx, m in zip(places, motion):
        warm = idx < v.warmup
        ema = m if warm else v.ema_alpha * m + (1 - v.ema_alpha) * ema
        always, skip = (False, 1) if warm else (
            (False, v.static_skip) if ema < 0.01 else (False, v.low_skip) if ema < 0.04
            else (False, v.medium_skip) if ema < 0.08 else (True, v.high_skip))
        if left > 0:
            always, skip, left = True, 1, left - 1
        if m > v.protection_threshold and not warm:
            left = max(left, v.protection_window)
        if always or idx >= due:
            taken.append(idx)
            if not always and (idx != due or not warm):
                due = idx + skip
    return [ema, left, due], taken


def sweep_step(variants: Sequence[SweepVariant], burst: tuple[int, int]):
    """All parameter sets over the same rows; the state holds one of each, a block gives its counts, a row per set."""
    def step(state, rows, last):
        places, motion = rows["seq"].tolist(), rows["motion_fraction"].tolist()
        states, out = [], []
        for v, before in zip(variants, state or [[0.0, 0, 0]] * len(variants)):
            after, taken = _swept(v, before, places, motion)
            states.append(after)
            out.append({"variant": v.name, "frames": len(places), "selected_frames": len(taken),
                        "burst_selected": sum(burst[0] <= i <= burst[1] for i in taken)})
        return states, out

    return step


SWEEP_OUT = T.StructType([T.StructField("variant", T.StringType()), T.StructField("frames", T.LongType()),
                          T.StructField("selected_frames", T.LongType()), T.StructField("burst_selected", T.LongType())])


def skip_variant_sweep(frames: DataFrame, burst: tuple[int, int], variants: Sequence[SweepVariant] = SWEEP_VARIANTS,
                       block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Selected frames and burst retention per video and parameter set, all sets in one pass."""
    base = frames.select("video_id", "seq", "motion_fraction")
    d = ordered_fold(base, ["video_id"], sweep_step(variants, burst), SWEEP_OUT, block=block)
    d = d.groupBy("video_id", "variant").agg(*[F.sum(c).alias(c) for c in ("frames", "selected_frames", "burst_selected")])
    return (d.withColumn("selection_pct", F.col("selected_frames") / F.col("frames") * 100)
            .withColumn("burst_pct", F.col("burst_selected") / (burst[1] - burst[0] + 1) * 100))
