"""Person-object interactions and scene-level security events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory import fixed
from framestory.functions import geometry as g
from framestory.operators.scenes import spaced_step
from framestory.plans.fold import ordered_fold
from framestory.plans.sequence import index_rows

TRACK = ["video_id", "track_id"]
PAIR = ["video_id", "person_id", "object_id", "object_class"]


def _persons(obs: DataFrame) -> Column:
    return F.lower("class_name").isin(*fixed.PERSON_CLASSES)


def close_frames(obs: DataFrame, object_classes: Sequence[str], max_dist: float = 0.30, min_iou: float = 0.0) -> DataFrame:
    """Shared frames of persons and objects whose centres are near or whose boxes overlap.

    The join is on (video, frame), so it spreads over the time line of a video;
    classes are filtered before it.
    """
    cols = ["video_id", "frame_number", "track_id", "class_name", "x1", "y1", "x2", "y2"]
    p = g.prefixed(obs.where(_persons(obs)).select(*cols), "p_", ["video_id", "frame_number"])
    o = g.prefixed(obs.where(F.lower("class_name").isin(*object_classes)).select(*cols), "o_", ["video_id", "frame_number"])
    d = p.join(o, ["video_id", "frame_number"]).where(F.col("p_track_id") != F.col("o_track_id")).withColumn("distance", g.centre_distance("p_", "o_"))
    return (d.where((F.col("distance") < max_dist) | (g.iou("p_", "o_") > min_iou))
            .select("video_id", "frame_number", F.col("p_track_id").alias("person_id"), F.col("o_track_id").alias("object_id"),
                    F.lower("o_class_name").alias("object_class"), "distance", F.col("p_x1").alias("px1"), F.col("p_y1").alias("py1")))


def interactions(obs: DataFrame, tracks: DataFrame, fps: float = 25.0, frame_skip: int = 5) -> DataFrame:
    """Phone, laptop, drinking, reading, screen, pick-up, placing and pocketing events before de-duplication."""
    wanted = sorted(set(fixed.PHONE_CLASSES + fixed.LAPTOP_CLASSES + fixed.DRINK_CLASSES + fixed.BOOK_CLASSES + fixed.SCREEN_CLASSES
                        + fixed.PICK_UP_CLASSES + fixed.POCKET_CLASSES) - set(fixed.BACKGROUND_CLASSES))
    pairs = close_frames(obs, wanted).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_close"), F.min("frame_number").alias("first_close"), F.max("frame_number").alias("last_close"))
    t = tracks.select("video_id", "track_id", "n_obs", "first_frame", "last_frame")
    p = t.where(F.col("n_obs") >= 2).select("video_id", F.col("track_id").alias("person_id"), F.col("first_frame").alias("_pf"), F.col("last_frame").alias("_pl"))
    o = t.select("video_id", F.col("track_id").alias("object_id"), F.col("first_frame").alias("_of"), F.col("last_frame").alias("_ol"))
    end_y = obs.groupBy("video_id", F.col("track_id").alias("object_id")).agg(F.max_by(g.cy(), "frame_number").alias("_ey"))
    d = pairs.join(p, ["video_id", "person_id"]).join(o, ["video_id", "object_id"]).join(end_y, ["video_id", "object_id"])
    c, n = F.col("object_class"), F.col("n_close")
    s = n * frame_skip / fps
    d = d.withColumn("close_seconds", s)
    s = F.col("close_seconds")
    cases = []
    for classes, least, kind, conf in (
            (fixed.PHONE_CLASSES, 1.0, "person_using_phone", F.least(F.lit(0.85), 0.6 + s * 0.05)),
            (fixed.LAPTOP_CLASSES, 2.0, "person_using_laptop", F.least(F.lit(0.88), 0.65 + s * 0.03)),
            (fixed.DRINK_CLASSES, 1.5, "person_drinking", F.least(F.lit(0.80), 0.55 + s * 0.07)),
            (fixed.BOOK_CLASSES, 1.5, "person_reading", F.least(F.lit(0.82), 0.60 + s * 0.04)),
            (fixed.SCREEN_CLASSES, 8.0, "person_watching_screen", F.least(F.lit(0.78), 0.55 + s * 0.02))):
        cases.append((c.isin(*classes) & (s >= least), F.lit(kind), conf))
    can_pick = c.isin(*fixed.PICK_UP_CLASSES)
    picked = can_pick & (F.col("_ol") < F.col("_pl") - 5) & (n >= 2) & (F.col("last_close") >= F.col("_ol") - 5)
    placed = can_pick & (F.col("_of") > F.col("_pf") + 10) & (n >= 2) & (F.col("first_close") >= F.col("_of") - 5)
    cases.append((picked, F.concat(F.lit("person_picked_up_"), c), F.when(n >= 4, 0.72).otherwise(0.60)))
    cases.append((placed, F.concat(F.lit("person_placed_"), c), F.lit(0.65)))
    cases.append((~can_pick & c.isin(*fixed.POCKET_CLASSES) & (F.col("_ey") > 0.45) & (n >= 2), F.lit("person_pocketed_object"), F.lit(0.68)))
    kind, conf = None, None
    for cond, k, v in cases:
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
        conf = F.when(cond, v) if conf is None else conf.when(cond, v)
    ms = lambda f: F.col(f) / F.lit(fps) * 1000.0
    return (d.withColumn("event_type", kind).withColumn("confidence", conf).where(F.col("event_type").isNotNull())
            .select("video_id", F.col("person_id").alias("track_id"), "event_type", "object_id", "object_class", "n_close", "close_seconds", "confidence",
                    F.col("first_close").alias("start_frame"), F.col("last_close").alias("end_frame"), ms("first_close").alias("start_ms"), ms("last_close").alias("end_ms")))


def unattended_bag(obs: DataFrame, tracks: DataFrame, fps: float = 25.0, frame_skip: int = 5, min_seconds: float = 10.0) -> DataFrame:
    """Bags in view for long enough that no person was close to in two frames."""
    owned = (close_frames(obs, fixed.BAG_CLASSES).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
             .select("video_id", F.col("object_id").alias("track_id")).distinct())
    seconds = (F.col("last_frame") - F.col("first_frame")) * frame_skip / F.lit(fps)
    bags = tracks.where(F.lower("class_name").isin(*fixed.BAG_CLASSES) & (F.col("n_obs") >= 3)).withColumn("duration_s", seconds)
    return (bags.where(F.col("duration_s") >= min_seconds).join(owned, TRACK, "left_anti")
            .select("video_id", F.lit(-1).cast("long").alias("track_id"), F.lit("unattended_bag").alias("event_type"), F.col("track_id").alias("object_id"),
                    F.lower("class_name").alias("object_class"), "duration_s", F.least(F.lit(0.88), 0.65 + F.col("duration_s") * 0.01).alias("confidence"),
                    F.col("first_frame").alias("start_frame"), F.col("last_frame").alias("end_frame")))


def group_gathering(obs: DataFrame, stride: int = 10, tolerance: int = 10, distance: float = 0.25, min_persons: int = 3, min_pairs: int = 3,
                    min_frames: int = 3) -> DataFrame:
    """Videos where several persons stand close together in enough sampled frames.

    Each sampled frame takes the nearest observation of every track within the
    tolerance; close pairs are found through grid cells.
    """
    p = obs.where(_persons(obs)).select(*TRACK, "frame_number", g.cx().alias("cx"), g.cy().alias("cy"))
    frames = index_rows(p.select("video_id", "frame_number").distinct(), ["video_id"], ["frame_number"], F.floor(F.col("frame_number") / 65_536).cast("long"), "_i")
    width = tolerance + 1
    b = F.floor(F.col("at") / width).cast("long")
    sampled = (frames.where(F.pmod("_i", F.lit(stride)) == 0).select("video_id", F.col("frame_number").alias("at"))
               .withColumn("_b", F.explode(F.array(b - 1, b, b + 1))))
    near = (p.withColumn("_b", F.floor(F.col("frame_number") / width).cast("long")).join(sampled, ["video_id", "_b"])
            .withColumn("_gap", F.abs(F.col("frame_number") - F.col("at"))).where(F.col("_gap") <= tolerance)
            .groupBy("video_id", "at", "track_id").agg(F.min_by(F.struct("cx", "cy"), F.struct("_gap", "frame_number")).alias("_p"))
            .select("video_id", "at", "track_id", F.col("_p.cx").alias("cx"), F.col("_p.cy").alias("cy")))
    people = near.groupBy("video_id", "at").agg(F.count(F.lit(1)).alias("persons"))
    cell = lambda c: F.floor(F.col(c) / distance).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = near.select("video_id", "at", F.col("track_id").alias("ta"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), cell("cx").alias("_gx"), cell("cy").alias("_gy"))
    c = (near.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
         .select("video_id", "at", F.col("track_id").alias("tb"), F.col("cx").alias("bx"), F.col("cy").alias("by"),
                 (cell("cx") + F.col("_dx")).alias("_gx"), (cell("cy") + F.col("_dy")).alias("_gy")))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    pairs = (a.join(c, ["video_id", "at", "_gx", "_gy"]).where((F.col("ta") < F.col("tb")) & (F.sqrt(dx * dx + dy * dy) < distance))
             .groupBy("video_id", "at").agg(F.count(F.lit(1)).alias("close_pairs")))
    hit = pairs.join(people, ["video_id", "at"]).where((F.col("close_pairs") >= min_pairs) & (F.col("persons") >= min_persons))
    return (hit.groupBy("video_id").agg(F.count(F.lit(1)).alias("gathering_frames"), F.min("at").alias("start_frame"), F.max("at").alias("end_frame"))
            .where(F.col("gathering_frames") >= min_frames).withColumn("event_type", F.lit("group_gathering")).withColumn("confidence", F.lit(0.80)))


def person_fallen(obs: DataFrame, min_rows: int = 5, aspect: float = 1.2, max_motion: float = 0.15) -> DataFrame:
    """Persons lying (wide boxes) in enough rows while hardly moving."""
    lying = F.when((g.height() >= 1e-6) & (g.width() / g.height() > aspect), True)
    x, y = F.when(lying, g.cx()), F.when(lying, g.cy())
    d = obs.where(_persons(obs)).groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("_n"), F.count(lying).alias("fallen_frames"), F.min(F.when(lying, F.col("frame_number"))).alias("start_frame"),
        F.max(F.when(lying, F.col("frame_number"))).alias("end_frame"), (F.max(x) - F.min(x) + (F.max(y) - F.min(y))).alias("motion"))
    return (d.where((F.col("_n") >= 5) & (F.col("fallen_frames") >= min_rows) & (F.col("motion") < max_motion))
            .withColumn("event_type", F.lit("person_fallen")).withColumn("confidence", F.least(F.lit(0.82), 0.55 + F.col("fallen_frames") * 0.03)).drop("_n"))


def person_carrying(obs: DataFrame, tracks: DataFrame, fps: float = 25.0, frame_skip: int = 5) -> DataFrame:
    """Person and object close for five frames while the person moves."""
    at = F.struct(F.col("px1").alias("x"), F.col("py1").alias("y"))
    d = close_frames(obs, fixed.CARRY_CLASSES, 0.20).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_close"), F.min("frame_number").alias("start_frame"), F.max("frame_number").alias("end_frame"),
        F.min_by(at, "frame_number").alias("_a"), F.max_by(at, "frame_number").alias("_z"))
    big = tracks.where(F.col("n_obs") >= 3).select("video_id", F.col("track_id").alias("object_id"))
    moved = F.abs(F.col("_z.x") - F.col("_a.x")) + F.abs(F.col("_z.y") - F.col("_a.y"))
    s = F.col("n_close") * frame_skip / F.lit(fps)
    return (d.where(F.col("n_close") >= 5).join(big, ["video_id", "object_id"], "left_semi").withColumn("motion", moved).where(F.col("motion") >= 0.05)
            .withColumn("event_type", F.lit("person_carrying")).withColumn("confidence", F.least(F.lit(0.78), 0.60 + s * 0.02)).drop("_a", "_z"))


DEDUP_OUT = T.StructType([T.StructField("_row", T.LongType()), T.StructField("kept", T.BooleanType())])


def dedup_within(events: DataFrame, gap_ms: float = 3000.0, keys: Sequence[str] = ("video_id", "track_id", "event_type"),
                 order: Sequence[str] = ("start_ms", "object_id"), slot_ms: float = 600_000.0) -> DataFrame:
    """Keep an event only if it starts later than ``gap_ms`` after the last kept one of its key."""
    keys = list(keys)
    d = index_rows(events, keys, list(order), F.floor(F.col("start_ms") / slot_ms).cast("long"), "_row")
    kept = ordered_fold(d.select(*keys, "start_ms", "_row"), keys, spaced_step("start_ms", gap_ms, "_row", strict=True), DEDUP_OUT, seq="_row")
    return d.join(kept.where("kept").select(*keys, "_row"), [*keys, "_row"], "left_semi").drop("_row")
