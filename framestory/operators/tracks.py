"""Track summaries and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.functions.text import title_case
from framestory.operators.detections import category_of

TRACK = ["video_id", "track_id"]


def track_summary(obs: DataFrame, confirm: int = 2) -> DataFrame:
    """One row per track; ``confirmed_at_frame`` is the frame of the n-th hit."""
    return (obs.groupBy(*TRACK).agg(
        F.min_by("class_name", "seq").alias("class_name"), F.count(F.lit(1)).alias("n_obs"),
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"),
        F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"),
        F.max(F.when(F.col("seq") == confirm - 1, F.col("frame_number"))).alias("confirmed_at_frame"))
        .withColumn("age_frames", F.col("last_frame") - F.col("first_frame") + 1)
        .withColumn("length_ms", F.col("last_ms") - F.col("first_ms"))
        .withColumn("is_confirmed", F.col("confirmed_at_frame").isNotNull()))


def with_state(tracks: DataFrame, max_lost_frames: int = 75) -> DataFrame:
    """State at the end of the video: unconfirmed, lost, or still active tracks."""
    ends = tracks.groupBy("video_id").agg(F.max("last_frame").alias("_end"))
    gone = F.col("_end") - F.col("last_frame")
    return (tracks.join(ends, "video_id")
            .withColumn("state", F.when(gone > max_lost_frames, "ended").when(~F.col("is_confirmed"), "tentative")
                        .when(gone > 0, "lost").otherwise("active")).drop("_end"))


def finalize_tracks(tracks: DataFrame) -> DataFrame:
    """Lost and tentative tracks are closed when the video ends."""
    return tracks.withColumn("state", F.when(F.col("state").isin("lost", "tentative"), "ended").otherwise(F.col("state")))


def tracking_metrics(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("video_id", "class_name").agg(
        F.count(F.lit(1)).alias("created"), F.count(F.when(F.col("is_confirmed"), 1)).alias("confirmed"),
        F.count(F.when(F.col("state") == "active", 1)).alias("active"),
        F.count(F.when(F.col("state") == "ended", 1)).alias("ended"),
        F.avg("n_obs").alias("avg_length"), F.avg("avg_confidence").alias("avg_confidence"))


def best_observation(obs: DataFrame) -> DataFrame:
    """Highest-confidence observation per track, the first one on ties."""
    pick = F.max_by(F.struct("obs_id", "frame_number", "confidence", "x1", "y1", "x2", "y2"),
                    F.struct(F.col("confidence"), -F.col("seq")))
    return obs.groupBy(*TRACK).agg(pick.alias("_b")).select(*TRACK, "_b.*")


def crop_size_ok(obs: DataFrame, frame_w: int, frame_h: int, min_w: int = 20, min_h: int = 40) -> DataFrame:
    """Keep observations whose clamped pixel box is large enough for a crop."""
    def px(c, size):
        return F.least(F.greatest(F.floor(F.col(c) * size), F.lit(0)), F.lit(size))

    w, h = px("x2", frame_w) - px("x1", frame_w), px("y2", frame_h) - px("y1", frame_h)
    return obs.withColumn("crop_w", w).withColumn("crop_h", h).where((F.col("crop_w") >= min_w) & (F.col("crop_h") >= min_h))


def edge_directions(obs: DataFrame) -> DataFrame:
    """Nearest frame edge at the first and the last observation (null exit for single rows)."""
    d = obs.withColumn("_e", g.nearest_edge(g.cx(), g.cy()))
    return (d.groupBy(*TRACK).agg(F.min_by("_e", "seq").alias("entry_direction"), F.max_by("_e", "seq").alias("_x"),
                                  F.count(F.lit(1)).alias("_n"))
            .withColumn("exit_direction", F.when(F.col("_n") > 1, F.col("_x"))).drop("_x", "_n"))


def object_inventory(tracks: DataFrame) -> DataFrame:
    """Distinct object classes worth listing per video, in display order (``position``)."""
    cls = F.lower(F.col("class_name"))
    person = cls.isin("person", "pedestrian", "man", "woman")
    keep = (F.col("is_confirmed") & (F.col("n_obs") >= 3)
            & ~F.replace(cls, F.lit(" "), F.lit("_")).isin(*fixed.HALLUCINATED_CLASSES)
            & F.when(person, F.col("max_confidence") >= 0.25)
            .otherwise((F.col("avg_confidence") >= 0.35) & (F.col("max_confidence") >= 0.45)))
    per = (tracks.where(keep).groupBy("video_id", "class_name").agg(
        F.count(F.lit(1)).alias("instance_count"), F.max("max_confidence").alias("max_confidence"),
        F.min("first_ms").alias("first_seen_ms"))
        .withColumn("display_name", title_case(F.col("class_name"))).withColumn("category", category_of(F.col("class_name"))))
    order = F.row_number().over(_per_video(
        (F.col("class_name") != "person").cast("int"),
        fixed.lookup(F.col("category"), fixed.CATEGORY_ORDER, 99), -F.col("max_confidence"), "first_seen_ms", "class_name"))
    return per.withColumn("position", order.cast("long"))


def _per_video(*order):
    """Window over the classes of a video: bounded by the detector's vocabulary."""
    from pyspark.sql import Window
    return Window.partitionBy("video_id").orderBy(*order)
