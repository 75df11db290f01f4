"""Velocity, speed and direction classes, motion profiles, camera motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.plans.sequence import BLOCK_ROWS, grouped_median, over_blocks

TRACK = ["video_id", "track_id"]


def velocity(obs: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Displacement, speed, angle and approach signal per consecutive pair with dt > 0."""
    d = obs.select(*TRACK, "seq", "frame_number", "timestamp_ms", "class_name", "confidence",
                   g.cx().alias("cx"), g.cy().alias("cy"), g.area().alias("bbox_area"))
    d = over_blocks(d, TRACK, lambda w: {
        "_t": F.lag("timestamp_ms").over(w), "_cx": F.lag("cx").over(w), "_cy": F.lag("cy").over(w),
        "_area": F.lag("bbox_area").over(w)}, back=1, block=block)
    d = (d.where(F.col("timestamp_ms") - F.col("_t") > 0)
         .withColumn("dt", F.col("timestamp_ms") - F.col("_t"))
         .withColumn("dx", F.col("cx") - F.col("_cx")).withColumn("dy", F.col("cy") - F.col("_cy"))
         .withColumn("speed_per_second", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.col("dt") * 1000.0)
         .withColumn("angle_degrees", F.when((F.col("dy") == 0) & (F.col("dx") < 0), -180.0)
                     .otherwise(F.degrees(F.atan2(-F.col("dy"), F.col("dx"))))))
    change = (F.col("bbox_area") - F.col("_area")) / F.col("_area")
    signal = (F.when(F.col("_area") <= 0, "stable").when(change > fixed.AREA_CHANGE, "approaching")
              .when(change < -fixed.AREA_CHANGE, "receding").otherwise("stable"))
    return d.withColumn("approach_signal", signal).drop("_t", "_cx", "_cy", "_area")


def speed_class(v: Column) -> Column:
    return (F.when(v < fixed.STATIONARY_MAX, "stationary").when(v < fixed.SLOW_MAX, "slow")
            .when(v < fixed.WALKING_MAX, "walking").otherwise("fast"))


def direction8(angle: Column) -> Column:
    sector = F.floor((F.pmod(angle, F.lit(360.0)) + 22.5) / 45.0).cast("int") % 8
    return F.element_at(F.array(*[F.lit(x) for x in fixed.COMPASS]), sector + 1)


def motion_profile(vel: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per track that has at least one velocity."""
    moving = F.col("speed_per_second") > fixed.STATIONARY_MAX * 1.5
    rad = F.radians("angle_degrees")
    agg = vel.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("n_velocities"), F.avg("speed_per_second").alias("avg_speed"),
        F.max("speed_per_second").alias("max_speed"), F.stddev_pop("speed_per_second").alias("_std"),
        F.avg(F.when(moving, F.sin(rad))).alias("_s"), F.avg(F.when(moving, F.cos(rad))).alias("_c"),
        F.sum("dx").alias("_dx"), F.sum("dy").alias("_dy"),
        F.bool_or(F.col("approach_signal") == "approaching").alias("has_approach"),
        F.bool_or(F.col("approach_signal") == "receding").alias("has_recede"))
    med = grouped_median(vel.select(*TRACK, "speed_per_second"), TRACK, "speed_per_second", 0.01, "median_speed")
    det = obs.groupBy(*TRACK).agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.8)).alias("_det"))
    steady = F.when(F.col("n_velocities") >= 2, 1.0 / (1.0 + F.col("_std") / (F.col("avg_speed") + 1e-8))).otherwise(0.5)
    conf = (0.4 * F.least(F.col("n_velocities") / 10.0, F.lit(1.0)) + 0.4 * F.col("_det") + 0.2 * steady)
    return (agg.join(med, TRACK).join(det, TRACK)
            .withColumn("speed_class", speed_class(F.col("median_speed")))
            .withColumn("is_stationary", F.col("speed_class") == "stationary")
            .withColumn("direction", F.when(F.col("_s").isNull(), "stationary")
                        .otherwise(direction8(F.degrees(F.atan2(F.col("_s"), F.col("_c"))))))
            .withColumn("displacement", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
            .withColumn("motion_confidence", F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)))
            .drop("_std", "_s", "_c", "_dx", "_dy", "_det"))


def camera_motion_frames(vel: DataFrame) -> DataFrame:
    """Frames where at least three tracks move and their unit vectors agree."""
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    frames = (vel.groupBy("video_id", "frame_number").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.count(F.when(norm > 1e-8, 1)).alias("n_moving"),
        F.avg(F.when(norm > 1e-8, F.col("dx") / norm)).alias("_ux"), F.avg(F.when(norm > 1e-8, F.col("dy") / norm)).alias("_uy"))
        .withColumn("coherence", F.least(F.sqrt(F.col("_ux") * F.col("_ux") + F.col("_uy") * F.col("_uy")), F.lit(1.0)))
        .where((F.col("n_tracks") >= fixed.CAMERA_MIN_TRACKS) & (F.col("n_moving") >= 2)
               & (F.col("coherence") > fixed.CAMERA_COHERENCE)))
    enough = (vel.groupBy(*TRACK).agg(F.lit(1).alias("_t")).groupBy("video_id").agg(F.count(F.lit(1)).alias("_p"))
              .where(F.col("_p") >= fixed.CAMERA_MIN_TRACKS).select("video_id"))
    return frames.join(enough, "video_id", "left_semi").select("video_id", "frame_number", "n_tracks", "coherence")


def motion_summary(profiles: DataFrame) -> DataFrame:
    return (profiles.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("tracks"), F.count(F.when(F.col("is_stationary"), 1)).alias("stationary_tracks"),
        F.count(F.when(~F.col("is_stationary"), 1)).alias("moving_tracks"),
        *[F.count(F.when(F.col("speed_class") == c, 1)).alias(f"{c}_class") for c in ("stationary", "slow", "walking", "fast")]))


def camera_overlap(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """Share of each track's frames flagged as camera motion."""
    flagged = camera.select("video_id", "frame_number", F.lit(True).alias("_cam"))
    return (obs.select(*TRACK, "frame_number").join(flagged, ["video_id", "frame_number"], "left").groupBy(*TRACK)
            .agg(F.count(F.lit(1)).alias("n_frames"), F.count("_cam").alias("camera_frames"))
            .withColumn("camera_share", F.col("camera_frames") / F.col("n_frames"))
            .withColumn("entirely_camera", F.col("camera_frames") == F.col("n_frames")))


def scene_population_velocity(vel: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per track: mean vertical velocity, and the same centred on its scene's population.

    A track belongs to the scene that holds its first velocity row.
    """
    first = vel.groupBy(*TRACK).agg(F.min("frame_number").alias("first_frame"),
                                    F.avg(F.col("dy") / F.col("dt") * 1000.0).alias("track_vy"))
    s = scenes.select("video_id", "scene_index", F.explode(F.sequence(
        F.floor(F.col("start_frame") / 1024).cast("long"), F.floor(F.col("end_frame") / 1024).cast("long"))).alias("_b"),
        "start_frame", "end_frame")
    t = first.withColumn("_b", F.floor(F.col("first_frame") / 1024).cast("long"))
    placed = (t.join(s, ["video_id", "_b"]).where((F.col("start_frame") <= F.col("first_frame"))
                                                  & (F.col("first_frame") <= F.col("end_frame")))
              .select(*TRACK, "scene_index", "track_vy"))
    stats = placed.groupBy("video_id", "scene_index").agg(
        F.count(F.lit(1)).alias("scene_tracks"), F.avg("track_vy").alias("scene_mean_vy"),
        F.stddev_pop("track_vy").alias("scene_std_vy"))
    med = grouped_median(placed, ["video_id", "scene_index"], "track_vy", 0.01, "scene_median_vy")
    return (placed.join(stats, ["video_id", "scene_index"]).join(med, ["video_id", "scene_index"])
            .withColumn("centred_vy", F.col("track_vy") - F.col("scene_median_vy")))
