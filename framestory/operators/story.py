"""Story segments, continuity checks and segment interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions.numbers import clip01
from framestory.functions.text import mm_ss, title_case
from framestory.operators.events import EVENT_ORDER, TRACK, event_slot, ordered_events
from framestory.plans.intervals import overlap_pairs
from framestory.plans.sequence import BLOCK_ROWS, index_rows, running_sum, walk_rows


def is_entry(t: Column) -> Column:
    return t.isin(*fixed.ENTRY_TYPES)


def is_exit(t: Column) -> Column:
    return t.isin(*fixed.EXIT_TYPES)


def is_action(t: Column, compat: bool = False) -> Column:
    return t.isin(*(fixed.COMPAT_VALIDATOR_ACTIONS if compat else fixed.ACTION_TYPES))


def continuity(events: DataFrame, gap_ms: float = 10_000.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Per event: backward time, follows-terminal, invalid succession and large-gap flags.

    An event follows a terminal one when a terminal event lies at least two
    places before it, so the first terminal position of the track so far is enough.
    """
    d = walk_rows(events, TRACK, EVENT_ORDER, event_slot(), before={"_pt": "event_type", "_ps": "start_ms", "_pe": "end_ms"},
                  first={"_ft": is_exit(F.col("event_type"))}, short=block)
    pair = F.lit(False)
    for a, b in fixed.INVALID_SUCCESSIONS:
        pair = pair | ((F.col("_pt") == a) & (F.col("event_type") == b))
    no = F.lit(False)
    return (d.withColumn("backward", F.coalesce(F.col("start_ms") < F.col("_ps"), no))
            .withColumn("after_terminal", F.coalesce(F.col("seq") >= F.col("_ft") + 2, no))
            .withColumn("invalid_succession", F.coalesce(pair, no))
            .withColumn("large_gap", F.coalesce(F.col("start_ms") - F.col("_pe") > gap_ms, no))
            .withColumn("issues", F.col("backward").cast("int") + F.col("after_terminal").cast("int")
                        + F.col("invalid_succession").cast("int"))
            .drop("_pt", "_ps", "_pe", "_ft"))


def story_segments(events: DataFrame, checked: DataFrame | None = None, full_events: float = 5.0,
                   full_ms: float = 5000.0) -> DataFrame:
    """One segment per (video, track) with completeness and narrative score.

    Events stay in their own table; ``segment_events`` is the bridge, so no
    segment carries an array that grows with its events.
    """
    c = checked if checked is not None else continuity(events)
    t = F.col("event_type")
    s = c.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("event_count"), F.bool_or(is_entry(t)).alias("has_entry"),
        F.bool_or(is_exit(t)).alias("has_exit"), F.bool_or(is_action(t)).alias("has_action"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.avg("confidence").alias("mean_confidence"), F.sum("issues").alias("issues"),
        F.sum(F.col("large_gap").cast("int")).alias("warnings"))
    entry, exit_, action = F.col("has_entry"), F.col("has_exit"), F.col("has_action")
    kind = (F.when(entry & exit_ & action, "complete").when(entry & exit_, "partial")
            .when(entry & ~action, "entry_only").when(exit_ & ~action, "exit_only")
            .when(F.col("event_count") == 1, "minimal").otherwise("partial"))
    score = ((0.4 * F.col("mean_confidence") + 0.3 * F.col("_c")
              + 0.2 * F.least(F.col("event_count") / full_events, F.lit(1.0))
              + 0.1 * F.least((F.col("end_ms") - F.col("start_ms")) / full_ms, F.lit(1.0)))
             * (1.0 - F.least(F.col("issues") * 0.1, F.lit(0.4))))
    return (s.withColumn("completeness", kind)
            .withColumn("_c", fixed.lookup(F.col("completeness"), fixed.COMPLETENESS_SCORE, 0.0))
            .withColumn("narrative_score", clip01(score)).withColumn("is_coherent", F.col("issues") == 0)
            .withColumn("segment_id", F.concat_ws("-", F.lit("seg"), "video_id", "track_id")).drop("_c"))


def segment_events(events: DataFrame) -> DataFrame:
    """Bridge from segments to their events."""
    return ordered_events(events).withColumn("segment_id", F.concat_ws("-", F.lit("seg"), "video_id", "track_id"))


def segment_interactions(segments: DataFrame, window_ms: float = 2000.0, width: float = 60_000.0) -> DataFrame:
    """Pairs of segments of a video that overlap within the window (a before b by track id)."""
    a = segments.select("video_id", F.col("track_id").alias("track_a"), (F.col("start_ms") - window_ms).alias("a_start"),
                        (F.col("end_ms") + window_ms).alias("a_end"))
    b = segments.select("video_id", F.col("track_id").alias("track_b"), F.col("start_ms").alias("b_start"),
                        F.col("end_ms").alias("b_end"))
    return overlap_pairs(a, b, ["video_id"], ("a_start", "a_end"), ("b_start", "b_end"), width,
                         condition=F.col("track_a") < F.col("track_b")).select("video_id", "track_a", "track_b")


def interaction_counts(segments: DataFrame, window_ms: float = 2000.0, slot_ms: float = 60_000.0,
                       block: int = BLOCK_ROWS) -> DataFrame:
    """Number of segments each segment interacts with, without listing the pairs.

    Others overlapping [s, e] = starts at or before e minus ends before s minus
    itself; both are running counts over the sorted starts and ends.
    """
    base = segments.select("video_id", "track_id", "start_ms", "end_ms")

    def marks(at: Column, order: int, start: int, end: int) -> DataFrame:
        return base.select("video_id", "track_id", at.alias("at"), F.lit(order).alias("kind"),
                           F.lit(start).alias("starts"), F.lit(end).alias("ends"))

    # Order at equal times: start marks, then queries for "start <= x", and
    # queries for "end < x" before end marks.
    m = (marks(F.col("start_ms"), 2, 1, 0).unionByName(marks(F.col("end_ms"), 4, 0, 1))
         .unionByName(marks(F.col("start_ms") - window_ms, 1, 0, 0))
         .unionByName(marks(F.col("end_ms") + window_ms, 3, 0, 0)))
    m = index_rows(m, ["video_id"], ["at", "kind", "track_id"], F.floor(F.col("at") / slot_ms).cast("long"))
    m = running_sum(m, ["video_id"], F.col("starts"), "n_starts", block=block)
    m = running_sum(m, ["video_id"], F.col("ends"), "n_ends", block=block)
    return (m.where(F.col("kind").isin(1, 3)).groupBy("video_id", "track_id").agg(
        (F.max(F.when(F.col("kind") == 3, F.col("n_starts"))) - F.max(F.when(F.col("kind") == 1, F.col("n_ends"))) - 1)
        .alias("interacting_segments")))


def story_metrics(segments: DataFrame) -> DataFrame:
    kinds = ["complete", "partial", "entry_only", "exit_only", "minimal"]
    return segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("event_count").alias("covered_events"),
        *[F.count(F.when(F.col("completeness") == k, 1)).alias(k + "_segments") for k in kinds],
        F.avg("narrative_score").alias("avg_score"), F.max("narrative_score").alias("max_score"))


def story_arcs(events: DataFrame, slot_ms: float = 600_000.0) -> DataFrame:
    """One arc per actor (person label, else track, else scene) with a readable summary.

    Arcs are numbered by their first event.

    Only the distinct event types of an arc are collected, a bounded vocabulary.
    """
    key = (F.when(F.col("person_label").isNotNull(), F.concat(F.lit("person:"), F.col("person_label")))
           .when(F.col("track_id").isNotNull(), F.concat(F.lit("track:"), F.col("track_id").cast("string")))
           .otherwise("scene:global"))
    e = events.withColumn("arc_key", key).withColumn("_o", F.struct("start_ms", "end_ms", "event_type", "event_id"))
    conf = F.when(F.col("confidence") > 0, F.col("confidence"))
    arcs = e.groupBy("video_id", "arc_key").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("start_ms").alias("start_ms"), F.min("_o").alias("_begin"),
        F.max_by("end_ms", "_o").alias("end_ms"), F.avg(conf).alias("avg_confidence"),
        F.min_by("direction", "_o").alias("entry_direction"), F.max_by("direction", "_o").alias("exit_direction"))
    types = (e.groupBy("video_id", "arc_key", "event_type").agg(F.min("_o").alias("_first"))
             .groupBy("video_id", "arc_key").agg(F.array_sort(F.collect_list(F.struct("_first", "event_type"))).alias("_t"))
             .withColumn("_t", F.transform("_t", lambda s: title_case(s["event_type"]))))
    n = F.size("_t")
    summary = F.when(n <= 3, F.array_join("_t", " → ")).otherwise(
        F.concat(F.element_at("_t", 1), F.lit(" → … → "), F.element_at("_t", -1)))
    arcs = (arcs.join(types, ["video_id", "arc_key"]).withColumn("summary", summary)
            .withColumn("distinct_types", n.cast("long"))
            .withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0.0)))
            .withColumn("start_text", mm_ss(F.col("start_ms"))).withColumn("end_text", mm_ss(F.col("end_ms")))
            .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0))).drop("_t"))
    numbered = index_rows(arcs, ["video_id"], ["_begin", "arc_key"], F.floor(F.col("start_ms") / slot_ms).cast("long"))
    return numbered.withColumn("story_id", F.format_string("STORY-%03d", F.col("seq") + 1)).drop("seq", "_begin")
