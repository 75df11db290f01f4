"""Zone membership and crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.functions import geometry as g
from framestory.functions.numbers import rounded
from framestory.functions.text import mm_ss
from framestory.plans.sequence import BLOCK_ROWS, over_blocks

TRACK = ["video_id", "track_id"]


def inside_zones(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """Every observation against the zones of its video.  ``zones`` carries ``video_id``.

    A first test against the zone's bounding box spares most of the ray casting.
    ``obs`` may be a stream; it keeps its event time, if it has one.
    """
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    z = zones.select("video_id", "zone_id", "zone_name", "zone_type", g.polygon_edges(F.col("polygon")).alias("_edges"),
                     F.array_min(xs).alias("_x1"), F.array_max(xs).alias("_x2"), F.array_min(ys).alias("_y1"), F.array_max(ys).alias("_y2"))
    more = [c for c in ("event_time",) if c in obs.columns]
    d = obs.select(*TRACK, "seq", "frame_number", "timestamp_ms", "confidence", *more, g.cx().alias("cx"), g.cy().alias("cy"))
    box = F.col("cx").between(F.col("_x1"), F.col("_x2")) & F.col("cy").between(F.col("_y1"), F.col("_y2"))
    inside = F.when(box, g.inside_edges(F.col("cx"), F.col("cy"), F.col("_edges"))).otherwise(False)
    return d.join(z, "video_id").withColumn("inside", inside).drop("_edges", "_x1", "_x2", "_y1", "_y2")


def zone_crossings(obs: DataFrame, zones: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Changes of membership; a first observation inside counts as an entry (cold start)."""
    d = over_blocks(inside_zones(obs, zones), [*TRACK, "zone_id"], lambda w: {"_was": F.lag("inside").over(w)}, back=1, block=block)
    d = d.where(F.when(F.col("_was").isNull(), F.col("inside")).otherwise(F.col("inside") != F.col("_was")))
    kind, cold, inside = F.col("zone_type"), F.col("_was").isNull(), F.col("inside")
    name = (F.when(kind == "restricted", F.when(inside, "restricted_zone_entry").otherwise("restricted_zone_exit"))
            .when(kind == "entry", F.when(inside, "zone_entry").otherwise("zone_exit"))
            .when(kind == "exit", F.when(cold, "zone_entry").when(inside, "zone_exit").otherwise("zone_entry"))
            .otherwise("zone_crossing"))
    return (d.withColumn("event_type", name).withColumn("direction", F.when(inside, "entering").otherwise("exiting"))
            .withColumn("cold_start", cold).drop("_was", "inside"))


def zone_membership(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """Latest membership per track and zone."""
    return inside_zones(obs, zones).groupBy(*TRACK, "zone_id").agg(F.max_by("inside", "seq").alias("inside"))


def zone_events(crossings: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """Crossings as event rows with a description."""
    d = crossings
    if persons is not None:
        d = d.join(persons.select(*TRACK, "person_label"), TRACK, "left")
    else:
        d = d.withColumn("person_label", F.lit(None).cast("string"))
    label = F.coalesce(F.col("person_label"), F.concat(F.lit("Track-"), F.col("track_id").cast("string")))
    return d.select(*TRACK, "event_type", F.concat(F.lit("roi_"), F.col("zone_id")).alias("rule_name"),
                    rounded(F.least(F.col("confidence") + 0.05, F.lit(1.0)), 3).alias("confidence"), F.col("frame_number").alias("start_frame"),
                    F.col("frame_number").alias("end_frame"), F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"),
                    F.concat_ws(" ", label, "direction", "zone_name", F.lit("at"), mm_ss(F.col("timestamp_ms"))).alias("description"))
