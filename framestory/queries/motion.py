"""Motion and track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestory.operators import motion, tracks
from framestory.queries.registry import query
from framestory.queries.shape import out, outs
from framestory.queries.sqlviews import COMPASS, MEDIAN, R, SPEED, sql
from framestory.sources.fixtures import Inputs


def tracks_of(s: Inputs):
    """Track summary with states, staged: one row per track, read by many steps."""
    return s.stage("tracks", lambda: tracks.with_state(s.stage("track_summary", lambda: tracks.track_summary(s.observations))))


def velocity_of(s: Inputs):
    """Staged velocities: the profile reads them twice and the camera check once."""
    return s.stage("velocity", lambda: motion.velocity(s.observations))


def profiles_of(s: Inputs):
    return s.stage("profiles", lambda: motion.motion_profile(velocity_of(s), s.observations))


def camera_of(s: Inputs):
    return s.stage("camera", lambda: motion.camera_motion_frames(velocity_of(s)))


@query("track_summary", sql("SELECT " + outs(
    "video_id track_id class_name n_obs first_frame last_frame first_ms last_ms confirmed_at_frame age_frames length_ms is_confirmed",
    "avg_confidence max_confidence") + " FROM tracks", "tracks"))
def _(s):
    return out(tracks.track_summary(s.observations),
               "video_id track_id class_name n_obs first_frame last_frame first_ms last_ms confirmed_at_frame age_frames length_ms is_confirmed",
               "avg_confidence max_confidence")


@query("tracking_metrics", sql("""
 SELECT video_id, class_name, count(*) AS created, count(*) FILTER (WHERE is_confirmed) AS confirmed,
  count(*) FILTER (WHERE state0 = 'active') AS active, count(*) FILTER (WHERE state0 = 'ended') AS ended, """
 + R("avg(n_obs)", 6) + " AS avg_length, " + R("avg(avg_confidence)", 6) + " AS avg_confidence FROM tracks GROUP BY ALL", "tracks"))
def _(s):
    return out(tracks.tracking_metrics(tracks_of(s)), "video_id class_name created confirmed active ended", "avg_length avg_confidence")


@query("finalize_tracks", sql("SELECT video_id, track_id, state FROM tracks", "tracks"))
def _(s):
    return tracks.finalize_tracks(tracks_of(s)).select("video_id", "track_id", "state")


@query("best_observation", sql("""SELECT video_id, track_id, obs_id, frame_number, confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY confidence DESC, seq) AS r FROM obs) WHERE r = 1""", "obs"))
def _(s):
    return tracks.best_observation(s.observations).select("video_id", "track_id", "obs_id", "frame_number", "confidence")


@query("crop_size_ok", sql("""SELECT obs_id, crop_w, crop_h FROM (SELECT obs_id,
  CAST(least(greatest(floor(x2 * 848), 0), 848) - least(greatest(floor(x1 * 848), 0), 848) AS BIGINT) AS crop_w,
  CAST(least(greatest(floor(y2 * 478), 0), 478) - least(greatest(floor(y1 * 478), 0), 478) AS BIGINT) AS crop_h FROM obs)
 WHERE crop_w >= 20 AND crop_h >= 40""", "obs"))
def _(s):
    return tracks.crop_size_ok(s.observations, 848, 478).select("obs_id", "crop_w", "crop_h")


@query("edge_direction", sql("""SELECT video_id, track_id, min_by(e, seq) AS entry_direction,
  CASE WHEN count(*) > 1 THEN max_by(e, seq) END AS exit_direction FROM (SELECT *, CASE least(x, 1 - x, y, 1 - y)
   WHEN x THEN 'left' WHEN 1 - x THEN 'right' WHEN y THEN 'top' ELSE 'bottom' END AS e
   FROM (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM obs)) GROUP BY ALL""", "obs"))
def _(s):
    return tracks.edge_directions(s.observations)


@query("object_inventory", sql("""SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY class_name <> 'person',
   CASE category WHEN 'people' THEN 0 WHEN 'electronics' THEN 1 WHEN 'bag' THEN 2 WHEN 'drinkware' THEN 3 WHEN 'documents' THEN 4
    WHEN 'clothing' THEN 5 ELSE 99 END, -max_confidence, first_seen_ms, class_name) AS position FROM (
  SELECT video_id, class_name, count(*) AS instance_count, max(max_confidence) AS max_confidence, min(first_ms) AS first_seen_ms,
   upper(class_name[1]) || class_name[2:] AS display_name,
   CASE class_name WHEN 'car' THEN 'vehicle' WHEN 'backpack' THEN 'bag' WHEN 'bottle' THEN 'drinkware' ELSE 'people' END AS category
  FROM tracks WHERE is_confirmed AND n_obs >= 3 AND CASE WHEN class_name = 'person' THEN max_confidence >= 0.25
   ELSE avg_confidence >= 0.35 AND max_confidence >= 0.45 END GROUP BY ALL)""", "tracks"))
def _(s):
    return tracks.object_inventory(tracks.track_summary(s.observations))


@query("velocity", sql("SELECT " + outs("video_id track_id seq frame_number signal", "dx dy speed angle") + " FROM vel", "vel"))
def _(s):
    v = motion.velocity(s.observations).withColumnsRenamed(
        {"approach_signal": "signal", "speed_per_second": "speed", "angle_degrees": "angle"})
    return out(v, "video_id track_id seq frame_number signal", "dx dy speed angle")


@query("speed_class", sql(f"""SELECT video_id, {SPEED('speed')} AS speed_class, count(*) AS n FROM vel GROUP BY ALL""", "vel"))
def _(s):
    return (motion.velocity(s.observations).groupBy("video_id", motion.speed_class(F.col("speed_per_second")).alias("speed_class"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("direction8", sql(f"SELECT video_id, {COMPASS('angle')} AS direction, count(*) AS n FROM vel GROUP BY ALL", "vel"))
def _(s):
    return (motion.velocity(s.observations).groupBy("video_id", motion.direction8(F.col("angle_degrees")).alias("direction"))
            .agg(F.count(F.lit(1)).alias("n")))


PROFILE = "video_id track_id n_velocities speed_class is_stationary direction has_approach has_recede"
PROFILE_F = "avg_speed max_speed median_speed displacement motion_confidence"


@query("motion_profile", sql("SELECT " + outs(PROFILE, PROFILE_F) + " FROM prof", "prof"))
def _(s):
    return out(profiles_of(s), PROFILE, PROFILE_F)


@query("camera_motion_frames", sql("SELECT " + outs("video_id frame_number n_tracks", "coherence") + " FROM camera", "camera"))
def _(s):
    return out(motion.camera_motion_frames(velocity_of(s)), "video_id frame_number n_tracks", "coherence")


@query("motion_summary", sql("""SELECT video_id, count(*) AS tracks, count(*) FILTER (WHERE is_stationary) AS stationary_tracks,
 count(*) FILTER (WHERE NOT is_stationary) AS moving_tracks, count(*) FILTER (WHERE speed_class = 'stationary') AS stationary_class,
 count(*) FILTER (WHERE speed_class = 'slow') AS slow_class, count(*) FILTER (WHERE speed_class = 'walking') AS walking_class,
 count(*) FILTER (WHERE speed_class = 'fast') AS fast_class FROM prof GROUP BY ALL""", "prof"))
def _(s):
    return motion.motion_summary(profiles_of(s))


@query("camera_overlap", sql("SELECT video_id, track_id, n_frames, camera_frames, " + R("camera_frames / n_frames", 6)
                             + " AS camera_share, camera_frames = n_frames AS entirely_camera FROM overlap", "overlap"))
def _(s):
    return out(motion.camera_overlap(s.observations, camera_of(s)),
               "video_id track_id n_frames camera_frames entirely_camera", "camera_share")


def scenes_500(s: Inputs):
    """Fixed 100-frame scenes over the observed frames."""
    span = s.observations.groupBy("video_id").agg(F.max("frame_number").alias("_m"))
    return (span.withColumn("scene_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_m") / 100).cast("long"))))
            .withColumn("start_frame", F.col("scene_index") * 100).withColumn("end_frame", F.col("scene_index") * 100 + 99))


@query("scene_population_velocity", sql(f"""
 SELECT video_id, track_id, scene_index, scene_tracks, {R('track_vy', 6)} AS track_vy, {R('scene_mean_vy', 6)} AS scene_mean_vy,
  {R('scene_std_vy', 6)} AS scene_std_vy, {R('scene_median_vy', 6)} AS scene_median_vy, {R('track_vy - scene_median_vy', 6)} AS centred_vy
 FROM t JOIN (SELECT video_id, scene_index, count(*) AS scene_tracks, avg(track_vy) AS scene_mean_vy, stddev_pop(track_vy) AS scene_std_vy,
   {MEDIAN('track_vy')} AS scene_median_vy FROM t GROUP BY ALL) USING (video_id, scene_index)""".replace(
    "FROM t ", "FROM (SELECT video_id, track_id, CAST(floor(min(frame_number) / 100) AS BIGINT) AS scene_index, "
               "avg(dy / dt * 1000.0E0) AS track_vy FROM vel GROUP BY ALL) t "), "vel"))
def _(s):
    return out(motion.scene_population_velocity(velocity_of(s), scenes_500(s)),
               "video_id track_id scene_index scene_tracks", "track_vy scene_mean_vy scene_std_vy scene_median_vy centred_vy")
