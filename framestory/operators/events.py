"""Event rules and the passes that reshape event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions.numbers import clip01, rounded
from framestory.functions.text import mm_ss_millis, title_case
from framestory.plans.sequence import BLOCK_ROWS, index_rows, over_blocks, running_sum, walk_rows

TRACK = ["video_id", "track_id"]
EVENT_ORDER = ["start_ms", "end_ms", "event_type", "event_id"]


def suppress_camera_tracks(tracks: DataFrame, overlap: DataFrame) -> DataFrame:
    """Drop tracks seen only in camera-motion frames."""
    return tracks.join(overlap.where(F.col("entirely_camera")).select(*TRACK), TRACK, "left_anti")


def apply_rules(tracks: DataFrame, profiles: DataFrame, min_confidence: float = 0.40, entry_frames: int = 2,
                rules: Sequence[tuple] = tuple(fixed.RULES)) -> DataFrame:
    """Every rule against every confirmed track.

    The rules become one array of conditional structs that is exploded, so the
    pass is a projection over the track table and needs no theta join.
    """
    p = profiles.select(*TRACK, "speed_class", "is_stationary", "has_approach", "has_recede", "motion_confidence")
    t = tracks.where(F.col("is_confirmed")).join(p, TRACK, "left")
    has = F.col("motion_confidence").isNotNull()
    fired = []
    for (name, etype, classes, speeds, still, approach, recede, min_ms, min_frames, new, ended, min_mc, prior) in rules:
        c = F.col("class_name").isin(*classes)
        if new:
            c = c & (F.col("n_obs") >= entry_frames)
        if ended:
            c = c & (F.col("state") == "ended")
        if min_ms > 0:
            c = c & (F.col("length_ms") >= min_ms)
        if min_frames > 0:
            c = c & (F.col("n_obs") >= min_frames)
        motion = F.col("motion_confidence") >= min_mc
        needs_motion = speeds is not None or still is not None or approach or recede
        if speeds is not None:
            motion = motion & F.col("speed_class").isin(*speeds)
        if still is not None:
            motion = motion & (F.col("is_stationary") == still)
        if approach:
            motion = motion & F.col("has_approach")
        if recede:
            motion = motion & F.col("has_recede")
        c = c & ((has & motion) if needs_motion else (~has | motion))
        fired.append(F.when(c, F.struct(F.lit(name).alias("rule_name"), F.lit(etype).alias("event_type"),
                                        F.lit(prior).alias("rule_confidence"))))
    conf = rounded(clip01(0.5 * F.col("avg_confidence") + 0.3 * F.coalesce(F.col("motion_confidence"), F.lit(0.5))
                          + 0.2 * F.least(F.col("n_obs") / 8.0, F.lit(1.0))), 4)
    return (t.withColumn("confidence", conf).where(F.col("confidence") >= min_confidence)
            .withColumn("_r", F.explode(F.array_compact(F.array(*fired))))
            .select(*TRACK, "class_name", "_r.*", "confidence", F.col("first_frame").alias("start_frame"),
                    F.col("last_frame").alias("end_frame"), F.col("first_ms").alias("start_ms"),
                    F.col("last_ms").alias("end_ms"))
            .withColumn("event_id", F.concat_ws("-", "video_id", "track_id", "rule_name")))


def union_passes(*passes: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), passes)


def replace_with_state_machine(events: DataFrame, machine: DataFrame) -> DataFrame:
    """For tracks the state machine handled, its person events replace those of other rules."""
    handled = machine.select(*TRACK).distinct().withColumn("_sm", F.lit(True))
    covered = F.col("event_type").isin(*fixed.STATE_MACHINE_TYPES) & (F.col("rule_name") != "activity_state_machine")
    kept = events.join(handled, TRACK, "left").where(~(F.coalesce(F.col("_sm"), F.lit(False)) & covered)).drop("_sm")
    return kept.unionByName(machine, allowMissingColumns=True)


def suppress_types(events: DataFrame, types: Sequence[str] = ("object_appeared", "object_disappeared")) -> DataFrame:
    return events.where(~F.col("event_type").isin(*types))


def merge_adjacent(events: DataFrame, gap_ms: float = 2500.0, keys: Sequence[str] = ("video_id", "track_id", "event_type"),
                   block: int = BLOCK_ROWS, slot_ms: float = 600_000.0) -> DataFrame:
    """Merge events whose start lies within ``gap_ms`` of the previous end.

    The merged row takes its fields from the first event, the end of the last
    one and the highest confidence.
    """
    keys = list(keys)
    d = index_rows(events, keys, ["start_ms", "end_ms", "event_id"], F.floor(F.col("start_ms") / slot_ms).cast("long"), "_seq")
    d = over_blocks(d, keys, lambda w: {"_prev": F.lag("end_ms").over(w)}, back=1, seq="_seq", block=block)
    new = F.when(F.col("start_ms") - F.col("_prev") <= gap_ms, 0).otherwise(1)
    d = running_sum(d, keys, new, "_run", seq="_seq", block=block)
    others = [c for c in events.columns if c not in (*keys, "end_ms", "confidence")]
    return (d.groupBy(*keys, "_run").agg(
        *[F.min_by(c, "_seq").alias(c) for c in others], F.max_by("end_ms", "_seq").alias("end_ms"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged_count")).drop("_run"))


def attach_identity(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Person label and entry direction by track, with a readable description."""
    d = events.join(persons.select(*TRACK, "person_label", "entry_direction"), TRACK, "left")
    label = F.coalesce(F.col("person_label"), F.concat(F.lit("Track-"), F.col("track_id").cast("string")))
    return d.withColumn("description", F.concat_ws(" ", label, F.lower(title_case(F.col("event_type")))))


def clamp_to_duration(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Start and end no later than the video's end; unknown durations clamp nothing."""
    d = events.join(durations.select("video_id", "duration_ms"), "video_id", "left")
    for c in ("start_ms", "end_ms"):
        d = d.withColumn(c, F.when(F.col("duration_ms") > 0, F.least(F.col(c), F.col("duration_ms"))).otherwise(F.col(c)))
    return d.drop("duration_ms")


def event_counts(events: DataFrame) -> DataFrame:
    """Counts by type, by track and in total, in one pass over the events."""
    return (events.groupingSets([["video_id", "event_type"], ["video_id", "track_id"], ["video_id"]],
                                "video_id", "event_type", "track_id")
            .agg(F.count(F.lit(1)).alias("events"), F.grouping_id().alias("_g"))
            .withColumn("grain", F.when(F.col("_g") == 1, "type").when(F.col("_g") == 2, "track").otherwise("video"))
            .withColumn("key", F.when(F.col("_g") == 1, F.col("event_type")).when(F.col("_g") == 2, F.col("track_id").cast("string")).otherwise("*"))
            .select("video_id", "grain", "key", "events"))


def event_category(t: Column) -> Column:
    return (F.when(t.isin(*fixed.TIMELINE_ACTIVITY), "activity").when(t.isin(*fixed.TIMELINE_LIGHTING), "lighting")
            .when(t.isin(*fixed.TIMELINE_INTERACTION), "interaction")
            .when(t.startswith("person_picked_up_") | t.startswith("person_placed_") | t.startswith("person_pocketed_")
                  | t.startswith("person_near_"), "interaction")
            .when(t.startswith("vehicle_"), "vehicle").otherwise("other"))


def display_fields(events: DataFrame) -> DataFrame:
    return (events.withColumn("display_name", title_case(F.col("event_type")))
            .withColumn("start_text", mm_ss_millis(F.col("start_ms"))).withColumn("category", event_category(F.col("event_type"))))


def anomaly_filter(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").rlike("|".join(fixed.ANOMALY_WORDS)))


def ordered_events(events: DataFrame, slot_ms: float = 600_000.0) -> DataFrame:
    """Events with ``seq``, their place in their track."""
    return walk_rows(events, TRACK, EVENT_ORDER, event_slot(slot_ms))


def event_slot(slot_ms: float = 600_000.0) -> Column:
    """Slot of an event's start; events without one come first."""
    return F.coalesce(F.floor(F.col("start_ms") / slot_ms).cast("long"), F.lit(-(1 << 62)))
