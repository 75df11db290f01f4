"""Event importance and segment ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions.numbers import clip01, rounded
from framestory.plans.sequence import score_slot, walk_rows

TRACK = ["video_id", "track_id"]


def event_importance(events: DataFrame, profiles: DataFrame, motion_ceiling: float = 0.05) -> DataFrame:
    """Detection, rarity, motion, salience and their weighted sum, rounded to 4 places.

    ``salience`` uses the event's detection dimension when it has one.
    """
    p = profiles.select(*TRACK, F.col("avg_speed").alias("_v"), F.col("is_stationary").alias("_still"))
    det = clip01(F.col("confidence"))
    rarity = fixed.lookup(F.col("event_type"), fixed.RARITY, fixed.DEFAULT_RARITY)
    motion = (F.when(F.col("_v") > 0, clip01(F.col("_v") / motion_ceiling)).when(F.col("_still"), 0.0).otherwise(0.3))
    salience = F.coalesce(F.col("detection"), det) if "detection" in events.columns else det
    d = (events.join(p, TRACK, "left").withColumn("i_detection", det).withColumn("i_rarity", rarity)
         .withColumn("i_motion", motion).withColumn("i_salience", salience))
    total = 0.35 * F.col("i_detection") + 0.35 * F.col("i_rarity") + 0.20 * F.col("i_motion") + 0.10 * F.col("i_salience")
    d = d.withColumn("importance", rounded(clip01(total), 4))
    for c in ("i_detection", "i_rarity", "i_motion", "i_salience"):
        d = d.withColumn(c, rounded(F.col(c), 4))
    return d.drop("_v", "_still")


def rank_segments(segments: DataFrame, importance: DataFrame, w_importance: float = 0.40, w_narrative: float = 0.60) -> DataFrame:
    """Rank per video by the combined score; ties go to the smaller track id."""
    imp = importance.groupBy(*TRACK).agg(F.avg("importance").alias("_imp"))
    d = (segments.join(imp, TRACK, "left").withColumn("_imp", F.coalesce("_imp", F.lit(0.0)))
         .withColumn("combined_rank", rounded(clip01(w_importance * F.col("_imp") + w_narrative * F.col("narrative_score")), 4))
         .withColumn("importance_score", rounded(F.col("_imp"), 4))
         .withColumn("narrative_score", rounded(F.col("narrative_score"), 4)).drop("_imp"))
    d = walk_rows(d, ["video_id"], [F.desc("combined_rank"), "track_id"], score_slot(F.col("combined_rank"), F.floor(F.col("track_id") / 4096)), "rank",
                  counted=segments)
    return d.withColumn("rank", F.col("rank") + 1)
