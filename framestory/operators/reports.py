"""Read-side views: funnel, traces, job statistics, timeline, briefs and clips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.functions.text import mm_ss_millis, mm_ss_tenths, title_case
from framestory.operators.events import EVENT_ORDER, event_category
from framestory.plans.nearest import nearest
from framestory.plans.sequence import first_n, index_rows

TRACK = ["video_id", "track_id"]


def stage_funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Row counts per video after every step, in long form."""
    out = None
    for i, (name, d) in enumerate(stages.items()):
        c = d.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(name)).withColumn("step_no", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return out


def real_time_factor(stage_runs: DataFrame, videos: DataFrame) -> DataFrame:
    """Processing seconds of every video over its length: below 1 it is worked off faster than it plays; null without runs or length."""
    spent = stage_runs.groupBy("video_id").agg((F.sum("duration_ms") / 1000.0).alias("processing_seconds"))
    d = videos.select("video_id", "duration_seconds").join(spent, "video_id", "left")
    return d.withColumn("real_time_factor", F.when(F.col("duration_seconds") > 0, F.col("processing_seconds") / F.col("duration_seconds")))


def trace_tracks(tracks: DataFrame, events: DataFrame, fused: DataFrame, segments: DataFrame, ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lineage of every track through the pipeline with the first break named.

    Filter the result on one track to trace it.
    """
    def count(d, name):
        return d.groupBy(*TRACK).agg(F.count(F.lit(1)).alias(name))

    d = tracks.select(*TRACK, "class_name", "n_obs", "is_confirmed", "first_ms", "last_ms")
    d = d.join(count(events, "events"), TRACK, "left").join(count(fused, "fused_events"), TRACK, "left")
    d = d.join(segments.select(*TRACK, "completeness"), TRACK, "left").join(ranked.select(*TRACK, "rank", "combined_rank"), TRACK, "left")
    d = d.join(decisions.select(*TRACK, "keep", "reason"), TRACK, "left").fillna(0, ["events", "fused_events"])
    gap = (F.when(~F.col("is_confirmed"), "not_confirmed").when(F.col("events") == 0, "no_events").when(F.col("fused_events") == 0, "fusion_discarded")
           .when(F.col("completeness").isNull(), "no_segment").when(F.col("rank").isNull(), "not_ranked").when(~F.col("keep"), F.concat(F.lit("discarded:"), "reason"))
           .otherwise("exported"))
    return d.withColumn("first_break", gap)


def stage_averages(stage_runs: DataFrame) -> DataFrame:
    """Mean duration per stage over completed jobs."""
    return stage_runs.where(F.col("status") == "completed").groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("avg_ms"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """Totals over jobs: counts by status, mean duration and events, bytes."""
    st = F.col("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), F.count(F.when(st == "completed", 1)).alias("completed"), F.count(F.when(st == "failed", 1)).alias("failed"),
        F.count(F.when(~st.isin("completed", "failed"), 1)).alias("active"), F.count_distinct("video_id").alias("videos"),
        F.avg(F.when(st == "completed", F.col("duration_ms"))).alias("avg_duration_ms"), F.sum("events").alias("events"), F.sum("size_bytes").alias("bytes"))


def job_diagnostics(stage_runs: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per job: status and duration of every stage; stages that did not run stay null."""
    d = stage_runs.groupBy("job_id").pivot("stage", list(stages)).agg(F.max("status").alias("status"), F.sum("duration_ms").alias("ms"))
    total = stage_runs.groupBy("job_id").agg(F.sum("duration_ms").alias("total_ms"))
    return d.join(total, "job_id")


def latest_job(jobs: DataFrame) -> DataFrame:
    """Per video the job shown to readers: completed before others, then by creation time and id."""
    order = F.struct((F.col("status") != "completed").alias("_p"), "created_at", "job_id", "status")
    return jobs.groupBy("video_id").agg(F.min_by(F.struct("job_id", "status", "created_at"), order).alias("_j")).select("video_id", "_j.*")


def timeline(events: DataFrame, persons: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per video: event counts by category, meaningful events, persons and object classes."""
    cats = ["activity", "lighting", "interaction", "vehicle", "other"]
    e = events.withColumn("_c", event_category(F.col("event_type"))).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("event_count"), *[F.count(F.when(F.col("_c") == c, 1)).alias(c + "_events") for c in cats])
    p = persons.groupBy("video_id").agg(F.count_distinct("person_label").alias("unique_persons"))
    o = inventory.groupBy("video_id").agg(F.count(F.lit(1)).alias("object_classes"))
    return (e.join(p, "video_id", "left").join(o, "video_id", "left").fillna(0, ["unique_persons", "object_classes"])
            .withColumn("meaningful_events", F.col("event_count") - F.col("other_events")))


def timeline_events(events: DataFrame) -> DataFrame:
    """Event rows as the timeline shows them: description before type, person before entry direction."""
    return (events.withColumn("display_name", F.coalesce("description", "event_type")).withColumn("category", event_category(F.col("event_type")))
            .withColumn("shown_direction", F.coalesce("direction", "entry_direction")))


def video_summary(videos: DataFrame, manifests: DataFrame, stage_runs: DataFrame, segments: DataFrame) -> DataFrame:
    """Compression ratio by the fallback chain manifest, stage metric, kept over original time; story and clip counts.

    ``manifests`` has manifest_ratio and clip_count, ``stage_runs`` stage_ratio and retained_ms per job.
    """
    s = stage_runs.groupBy("video_id").agg(
        F.min(F.when(F.col("stage_ratio").isNotNull(), F.struct("stage_no", "job_id", "stage_ratio"))).alias("_r"), F.sum("retained_ms").alias("retained_ms")).withColumn(
        "stage_ratio", F.col("_r.stage_ratio"))
    g = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("story_count"))
    d = videos.select("video_id", "duration_seconds").join(manifests, "video_id", "left").join(s, "video_id", "left").join(g, "video_id", "left")
    by_time = F.when(F.col("duration_seconds") > 0, F.col("retained_ms") / 1000.0 / F.col("duration_seconds"))
    return (d.withColumn("compression_ratio", F.coalesce("manifest_ratio", "stage_ratio", by_time)).withColumn("story_count", F.coalesce("story_count", F.lit(0)))
            .select("video_id", "compression_ratio", "clip_count", "story_count"))


def evidence(events: DataFrame) -> DataFrame:
    """What, when, where, who, how sure and why of each event, as nested structs."""
    return events.select(
        "video_id", "event_id", F.col("event_type").alias("what"),
        F.struct("start_ms", "end_ms", mm_ss_millis(F.col("start_ms")).alias("start_text"), mm_ss_millis(F.col("end_ms")).alias("end_text")).alias("when"),
        F.struct("direction").alias("where"), F.struct("track_id", "person_label").alias("track"), F.struct(F.col("confidence").alias("overall")).alias("confidence"),
        F.struct("rule_name", "description").alias("why"))


def list_events(events: DataFrame, video_id, limit: int, offset: int = 0) -> DataFrame:
    """One page of a video's events in time order."""
    return events.where(F.col("video_id") == video_id).orderBy(*EVENT_ORDER).offset(offset).limit(limit)


def event_facets(events: DataFrame) -> DataFrame:
    """Distinct persons and types of every video, the values the filters offer."""
    p = events.where(F.col("person_label").isNotNull()).select("video_id", F.lit("person").alias("facet"), F.col("person_label").alias("value"))
    t = events.select("video_id", F.lit("type").alias("facet"), F.col("event_type").alias("value"))
    return p.unionByName(t).groupBy("video_id", "facet", "value").agg(F.count(F.lit(1)).alias("events"))


def search_inventory(inventory: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    d = inventory
    if text:
        d = d.where(F.lower("display_name").contains(text.lower()))
    if category:
        d = d.where(F.col("category") == category)
    return d


def milestones(events: DataFrame, n: int = 15) -> DataFrame:
    """The first n events of each video with time, name and actor."""
    d = first_n(events, ["video_id"], EVENT_ORDER, n, "position")
    return d.select("video_id", "position", mm_ss_tenths(F.col("start_ms")).alias("time"),
                    title_case(F.col("event_type")).alias("event"), F.coalesce("person_label", F.lit("Scene Entity")).alias("actor"))


def executive_brief(events: DataFrame, persons: DataFrame, inventory: DataFrame, videos: DataFrame) -> DataFrame:
    """A sentence per video from its first and last event and the counts."""
    o = F.struct(*EVENT_ORDER)
    at = F.struct("start_ms", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("name"), F.coalesce("person_label", F.lit("Entity")).alias("actor"))
    e = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by(at, o).alias("_a"), F.max_by(at, o).alias("_z"))
    p = persons.groupBy("video_id").agg(F.count_distinct("person_label").alias("_p"))
    i = inventory.groupBy("video_id").agg(F.count(F.lit(1)).alias("_o"))
    d = videos.select("video_id", "duration_seconds").join(e, "video_id", "left").join(p, "video_id", "left").join(i, "video_id", "left").fillna(0, ["_n", "_p", "_o"])
    sec = lambda c: F.format_string("%.1f", F.col(c) / 1000.0)
    first = F.concat(F.col("_n").cast("string"), F.lit(" events, "), F.col("_p").cast("string"), F.lit(" persons, "), F.col("_o").cast("string"),
                     F.lit(" kinds of objects. First: "), F.col("_a.actor"), F.lit(", "), F.col("_a.name"), F.lit(", at "), sec("_a.start_ms"), F.lit(" s. "))
    last = F.when(F.col("_n") > 1, F.concat(F.lit("Last: "), F.col("_z.actor"), F.lit(", "), F.col("_z.name"), F.lit(", at "), sec("_z.start_ms"), F.lit(" s. "))).otherwise("")
    end = F.concat(F.lit("Length of the footage: "), F.format_string("%.1f", "duration_seconds"), F.lit(" s."))
    none = F.lit("No event was kept for this footage.")
    return d.select("video_id", F.col("_n").alias("events"), F.when(F.col("_n") > 0, F.concat(first, last, end)).otherwise(none).alias("narrative"))


def clip_specs(events: DataFrame, pre_ms: float = 500.0, post_ms: float = 500.0, slot_ms: float = 600_000.0) -> DataFrame:
    """Numbered clips in time order with padded, clamped bounds in seconds."""
    d = index_rows(events, ["video_id"], EVENT_ORDER, F.floor(F.col("start_ms") / slot_ms).cast("long"), "_i").withColumn("clip_index", F.col("_i") + 1)
    return d.select("video_id", "clip_index", "event_id", "event_type", "track_id", "start_ms", "end_ms", "confidence",
                    (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.greatest(F.lit(0.0), (F.col("start_ms") - pre_ms) / 1000.0).alias("clip_start_s"),
                    ((F.col("end_ms") + post_ms) / 1000.0).alias("clip_end_s"),
                    F.format_string("clip_%03d_%s.mp4", "clip_index", "event_type").alias("clip_name"))


def nearest_frames(events: DataFrame, frames: DataFrame, k: int = 5, slot_frames: float = 4096.0) -> DataFrame:
    """Frame nearest to each event and the frames ``k`` places before and after it, kept inside the video.

    ``events`` has frame_number; ``frames`` has frame_number and ``seq``.
    """
    n = frames.groupBy("video_id").agg(F.max("seq").alias("_max"))
    d = nearest(events.select("video_id", "event_id", "frame_number"), frames.select("video_id", "frame_number", "seq"), ["video_id"], "frame_number", ["seq"], slot_frames, "event_id")
    d = d.join(n, "video_id").withColumn("_b", F.greatest(F.col("seq") - k, F.lit(0))).withColumn("_a", F.least(F.col("seq") + k, F.col("_max")))
    f = frames.select("video_id", F.col("seq").alias("_s"), F.col("frame_number").alias("_f"))
    d = d.join(f.withColumnsRenamed({"_s": "_b", "_f": "before_frame"}), ["video_id", "_b"]).join(f.withColumnsRenamed({"_s": "_a", "_f": "after_frame"}), ["video_id", "_a"])
    return d.select("video_id", "event_id", F.col("frame_number_found").alias("event_frame"), "before_frame", "after_frame")
