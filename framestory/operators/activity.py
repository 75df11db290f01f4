"""Activity labels from track geometry, stair evidence and its policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.operators.tracks import edge_directions
from framestory.plans.sequence import BLOCK_ROWS, over_blocks

TRACK = ["video_id", "track_id"]
# Speed thresholds in frame fractions per second, loitering in seconds.
STILL, WALK, RUN, STAIR_VERTICAL, CYCLE, LOITER_SECONDS = 0.003, 0.008, 0.022, 0.005, 0.018, 12.0


def track_features(obs: DataFrame, fps: float = 25.0, frame_skip: int = 5, block: int = BLOCK_ROWS) -> DataFrame:
    """Speed, height, width and displacement summary per track, with a fixed time step."""
    dt = frame_skip / max(fps, 1.0)
    d = obs.select(*TRACK, "seq", "frame_number", "timestamp_ms", "class_name", "confidence", g.cx().alias("cx"), g.cy().alias("cy"),
                   g.width().alias("w"), g.height().alias("h"))
    d = over_blocks(d, TRACK, lambda w: {"_dx": F.col("cx") - F.lag("cx").over(w), "_dy": F.col("cy") - F.lag("cy").over(w)}, back=1, block=block)
    vx, vy = F.col("_dx") / dt, F.col("_dy") / dt
    speed = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / dt
    a = d.groupBy(*TRACK).agg(
        F.min_by("class_name", "seq").alias("class_name"), F.count(F.lit(1)).alias("n_obs"), F.count("_dx").alias("n_steps"),
        F.avg(speed).alias("mean_speed"), F.max(speed).alias("max_speed"), F.stddev_pop(speed).alias("speed_std"),
        F.avg(vy).alias("mean_vy"), F.avg(F.abs(vy)).alias("mean_abs_vy"), F.stddev_pop(vy).alias("vy_std"), F.avg(F.abs(vx)).alias("mean_abs_vx"),
        F.count(F.when(vy < -STAIR_VERTICAL, 1)).alias("n_up"), F.count(F.when(vy > STAIR_VERTICAL, 1)).alias("n_down"),
        F.avg("h").alias("height_mean"), F.stddev_pop("h").alias("height_std"), F.min("h").alias("height_min"), F.max("h").alias("height_max"),
        F.avg("w").alias("width_mean"), F.stddev_pop("w").alias("width_std"), F.avg("cx").alias("mean_cx"), F.avg("cy").alias("mean_cy"),
        F.min_by(F.struct("cx", "cy"), "seq").alias("_a"), F.max_by(F.struct("cx", "cy"), "seq").alias("_z"),
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
    return (a.withColumn("horizontal_move", F.abs(F.col("_z.cx") - F.col("_a.cx"))).withColumn("vertical_move", F.abs(F.col("_z.cy") - F.col("_a.cy")))
            .withColumn("displacement", F.sqrt(F.col("horizontal_move") * F.col("horizontal_move") + F.col("vertical_move") * F.col("vertical_move")))
            .withColumn("move_ratio", F.col("horizontal_move") / F.greatest(F.col("vertical_move"), F.lit(1e-6)))
            .withColumn("speed_margin", F.col("mean_speed") - CYCLE).withColumn("height_margin", 0.03 - F.col("height_std"))
            .withColumn("duration_ms", F.col("last_ms") - F.col("first_ms")).drop("_a", "_z"))


def cycling_signal(features: DataFrame, confirmed: DataFrame, cycle_threshold: float = CYCLE, require_overlap: bool = False,
                   require_bicycle: bool = True, reach: float = 0.25) -> DataFrame:
    """Cycling confidence: a near bicycle track, else fast with a steady height.

    Bicycles are copied to the grid cells around their mean position, so a track
    meets only bicycles that can be within reach.
    """
    bikes = (features.join(confirmed.where(F.col("is_confirmed")).select(*TRACK), TRACK, "left_semi")
             .where(F.lower("class_name").isin(*fixed.BICYCLE_CLASSES)))
    cell_x, cell_y = F.floor(F.col("mean_cx") / reach).cast("int"), F.floor(F.col("mean_cy") / reach).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = (bikes.select("video_id", F.col("track_id").alias("_bt"), F.col("mean_cx").alias("_bx"), F.col("mean_cy").alias("_by"),
                      F.col("first_frame").alias("_bf"), F.col("last_frame").alias("_bl"), cell_x.alias("_x0"), cell_y.alias("_y0"))
         .withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
         .withColumn("_x", F.col("_x0") + F.col("_dx")).withColumn("_y", F.col("_y0") + F.col("_dy")).drop("_x0", "_y0", "_dx", "_dy"))
    t = features.withColumn("_x", cell_x).withColumn("_y", cell_y)
    dx, dy = F.col("mean_cx") - F.col("_bx"), F.col("mean_cy") - F.col("_by")
    dist = F.sqrt(dx * dx + dy * dy)
    hit = dist < reach
    if require_overlap:
        hit = hit & (F.col("_bf") <= F.col("last_frame")) & (F.col("_bl") >= F.col("first_frame"))
    near = (t.join(b, ["video_id", "_x", "_y"]).where(hit).groupBy(*TRACK)
            .agg(F.min_by(F.greatest(F.lit(0.70), 0.95 - dist * 2), "_bt").alias("_near")))
    any_bike = bikes.select("video_id").distinct().withColumn("_bike", F.lit(True))
    by_speed = (F.col("mean_speed") >= cycle_threshold) & (F.col("height_std") < 0.03)
    if require_bicycle:
        by_speed = by_speed & F.col("_bike").isNotNull()
    return (features.join(near, TRACK, "left").join(any_bike, "video_id", "left")
            .withColumn("cycling_conf", F.coalesce("_near", F.when(by_speed, 0.65), F.lit(0.0))).drop("_near", "_bike"))


def stair_signal(features: DataFrame) -> DataFrame:
    """Confidence and direction of walking on stairs from the signs of vertical velocity."""
    up = F.col("n_up") > F.col("n_down")
    share = F.greatest("n_up", "n_down") / F.col("n_steps")
    conf = share * 0.6 + F.least(F.col("mean_abs_vy") / (STAIR_VERTICAL * 3), F.lit(1.0)) * 0.4
    conf = F.least(F.when(F.col("mean_speed") < WALK * 0.5, conf * 0.5).otherwise(conf), F.lit(0.93))
    return (features.withColumn("stair_conf", F.when((F.col("n_steps") < 4) | (share < 0.5), 0.0).otherwise(conf))
            .withColumn("stair_direction", F.when(F.col("n_steps") < 4, "up").when(up, "up").otherwise("down")))


def classify_activity(signals: DataFrame, min_observations: int = 3) -> DataFrame:
    """Label and confidence; ``signals`` has the cycling and stair columns."""
    v, cyc, st = F.col("mean_speed"), F.col("cycling_conf"), F.col("stair_conf")
    cases = [
        (F.col("n_obs") < max(min_observations, 2), F.lit("entering_scene"), F.lit(0.75)),
        (cyc >= 0.60, F.lit("cycling"), cyc),
        ((st >= 0.55) & (v >= WALK), F.concat(F.lit("walking_"), F.col("stair_direction"), F.lit("stairs")), st),
        (v >= RUN, F.lit("running"), F.least(F.lit(0.95), 0.70 + (v - RUN) * 10)),
        (v >= WALK, F.lit("walking"), F.least(F.lit(0.92), 0.65 + v * 8)),
        ((v < STILL) & (F.col("duration_ms") > LOITER_SECONDS * 1000), F.lit("loitering"), F.lit(0.75)),
        (v < STILL, F.lit("standing"), F.lit(0.80)),
    ]
    label, conf = None, None
    for cond, name, c in cases:
        label = F.when(cond, name) if label is None else label.when(cond, name)
        conf = F.when(cond, c) if conf is None else conf.when(cond, c)
    return signals.withColumn("activity", label.otherwise("walking")).withColumn("activity_conf", conf.otherwise(0.55))


# Stair evidence -----------------------------------------------------------------------
# Reference confidence, persistence and overlap; base weight and threshold.
TAU, P_REF, IOP_REF, MIN_PERSISTENCE, MIN_IOP, BASE, STAIR_THRESHOLD = 0.05, 5.0, 0.20, 2, 0.15, 0.30, 0.55


def stair_context(tracks: DataFrame, obs: DataFrame, stairs: DataFrame) -> DataFrame:
    """Stair boxes seen around about ten sampled observations of each track.

    ``tracks`` carries n_obs, stair_conf and mean_speed; ``stairs`` has video_id,
    frame_number, confidence and a box.
    """
    step = F.greatest(F.floor(F.col("n_obs") / 10).cast("long"), F.lit(1))
    p = g.prefixed(obs.select(*TRACK, "seq", "frame_number", "x1", "y1", "x2", "y2"), "p_", [*TRACK, "seq", "frame_number"])
    sampled = p.join(tracks.select(*TRACK, step.alias("_step")), TRACK).where(F.pmod("seq", "_step") == 0)
    s = g.prefixed(stairs.select("video_id", "frame_number", "confidence", "x1", "y1", "x2", "y2"), "s_", ["video_id", "frame_number"])
    seen = sampled.join(s, ["video_id", "frame_number"]).withColumn("_iop", g.inside_share("p_", "s_"))
    ev = seen.groupBy(*TRACK).agg(
        F.count_distinct(F.when((F.col("s_confidence") >= 0.02) & (F.col("_iop") >= MIN_IOP), F.col("frame_number"))).alias("persistence"),
        F.max("s_confidence").alias("scene_conf"), F.max("_iop").alias("max_iop"))
    d = tracks.join(ev, TRACK, "left").fillna({"persistence": 0, "scene_conf": 0.0, "max_iop": 0.0})
    quality = F.when((F.col("persistence") >= MIN_PERSISTENCE) & (F.col("max_iop") >= MIN_IOP), F.least(
        F.lit(1.0), F.col("scene_conf") / TAU * (F.col("persistence") / P_REF) * F.least(F.lit(1.0), F.col("max_iop") / IOP_REF))).otherwise(0.0)
    return (d.withColumn("quality", quality).withColumn("final_conf", F.col("stair_conf") * (BASE + (1.0 - BASE) * F.col("quality")))
            .withColumn("is_verified", F.col("final_conf") >= STAIR_THRESHOLD)
            .withColumn("fallback", F.when(~F.col("is_verified"), F.when(F.col("mean_speed") >= RUN, "running").otherwise("walking"))))


def _effective(c: str, p: str) -> Column:
    return F.when(F.col(p) >= MIN_PERSISTENCE, F.col(c)).otherwise(0.0)


def stair_policy_b(vel: str = "stair_conf", scene: str = "scene_conf", pers: str = "persistence") -> Column:
    """Soft multiplier."""
    return F.col(vel) * (0.30 + 0.70 * F.least(F.lit(1.0), _effective(scene, pers) / TAU))


def stair_policy_c(vel: str = "stair_conf", scene: str = "scene_conf", pers: str = "persistence") -> Column:
    """Weighted sum of velocity, scene and persistence evidence."""
    p = F.when(F.col(pers) >= MIN_PERSISTENCE, F.col(pers)).otherwise(0)
    return 0.50 * F.col(vel) + 0.35 * F.least(F.lit(1.0), _effective(scene, pers) / TAU) + 0.15 * F.least(F.lit(1.0), p / P_REF)


def stair_policy_d(vel: str = "stair_conf", scene: str = "scene_conf", pers: str = "persistence") -> Column:
    """Square-root gate."""
    return F.col(vel) * (0.35 + 0.65 * F.sqrt(F.least(F.lit(1.0), _effective(scene, pers) / TAU)))


def cycling_sanity(labelled: DataFrame, tracks: DataFrame) -> DataFrame:
    """Cycling in a video without any confirmed bicycle becomes walking or running."""
    ok = tracks.where(F.col("is_confirmed") & F.lower("class_name").isin(*fixed.SANITY_BICYCLE_CLASSES)).select("video_id").distinct().withColumn("_ok", F.lit(True))
    wrong = (F.col("activity") == "cycling") & F.col("_ok").isNull()
    return (labelled.join(ok, "video_id", "left").withColumn("_w", wrong)
            .withColumn("activity", F.when(F.col("_w"), F.when(F.col("mean_speed") < 0.04, "walking").otherwise("running")).otherwise(F.col("activity")))
            .withColumn("activity_conf", F.when(F.col("_w"), 0.80).otherwise(F.col("activity_conf"))).drop("_ok", "_w"))


def narrative_events(labelled: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """One described event per person track with a noteworthy activity."""
    d = labelled.where(F.lower("class_name").isin(*fixed.PERSON_CLASSES) & F.col("activity").isin(*fixed.NARRATIVE_LABELS))
    if persons is not None:
        d = d.join(persons.select(*TRACK, "person_label"), TRACK, "left")
    else:
        d = d.withColumn("person_label", F.lit(None).cast("string"))
    label = F.coalesce(F.col("person_label"), F.concat(F.lit("Track-"), F.col("track_id").cast("string")))
    return d.select(*TRACK, F.lit("person").alias("class_name"), F.col("activity").alias("event_type"), F.lit("narrative_builder").alias("rule_name"),
                    F.col("activity_conf").alias("confidence"), F.col("first_frame").alias("start_frame"), F.col("last_frame").alias("end_frame"),
                    F.col("first_ms").alias("start_ms"), F.col("last_ms").alias("end_ms"), label.alias("person_label"),
                    F.concat(label, fixed.lookup(F.col("activity"), fixed.ACTIVITY_TAILS, "")).alias("description"),
                    F.concat_ws("-", "video_id", "track_id", F.lit("narrative")).alias("event_id"))


def loitering(tracks: DataFrame, profiles: DataFrame, min_ms: float = 5000.0) -> DataFrame:
    """Stationary person tracks at least ``min_ms`` long."""
    still = profiles.where(F.col("is_stationary")).select(*TRACK)
    return tracks.where(F.col("class_name").isin(*fixed.PERSON_CLASSES) & (F.col("length_ms") >= min_ms)).join(still, TRACK, "left_semi")
