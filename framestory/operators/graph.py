"""Event graph: edges, degrees, roots and the actor view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.functions.text import title_case
from framestory.operators.events import EVENT_ORDER, TRACK, ordered_events
from framestory.plans.intervals import bucket
from framestory.plans.sequence import BLOCK_ROWS, first_n, index_rows, over_blocks, running_sum

EDGE = ["video_id", "source", "target", "relationship", "weight"]


def same_track_edges(events: DataFrame, weight: float = 1.0, block: int = BLOCK_ROWS) -> DataFrame:
    d = over_blocks(ordered_events(events), TRACK, lambda w: {"target": F.lead("event_id").over(w)}, fwd=1, block=block)
    return d.where(F.col("target").isNotNull()).select(
        "video_id", F.col("event_id").alias("source"), "target", F.lit("same_track_temporal").alias("relationship"),
        F.lit(weight).alias("weight"))


def co_occurrence_edges(events: DataFrame, gap_ms: float = 2000.0, weight: float = 0.5, width: float = 60_000.0) -> DataFrame:
    """a before b in event order, different tracks, b starting within a's span plus the gap.

    b is a point and a an interval, so a is copied to the buckets it covers and
    b sits in one; (video, bucket) spreads a hot video over its time line.
    """
    e = events.select("video_id", "track_id", *EVENT_ORDER)
    a = e.select("video_id", *[F.col(c).alias("a_" + c) for c in e.columns[1:]]).withColumn(
        "_b", F.explode(F.sequence(bucket(F.col("a_start_ms"), width), bucket(F.col("a_end_ms") + gap_ms, width))))
    b = e.select("video_id", *[F.col(c).alias("b_" + c) for c in e.columns[1:]]).withColumn("_b", bucket(F.col("b_start_ms"), width))
    before = F.struct(*["a_" + c for c in EVENT_ORDER]) < F.struct(*["b_" + c for c in EVENT_ORDER])
    hit = ((F.col("b_start_ms") >= F.col("a_start_ms")) & (F.col("b_start_ms") <= F.col("a_end_ms") + gap_ms)
           & (F.col("a_start_ms") <= F.col("b_end_ms")) & (F.col("a_track_id") != F.col("b_track_id")) & before)
    return a.join(b, ["video_id", "_b"]).where(hit).select(
        "video_id", F.col("a_event_id").alias("source"), F.col("b_event_id").alias("target"),
        F.lit("co_occurrence").alias("relationship"), F.lit(weight).alias("weight"))


def event_graph(events: DataFrame, gap_ms: float = 2000.0) -> DataFrame:
    return same_track_edges(events).unionByName(co_occurrence_edges(events, gap_ms))


def degrees(events: DataFrame, gap_ms: float = 2000.0, slot_ms: float = 60_000.0, block: int = BLOCK_ROWS) -> DataFrame:
    """In, out and total degree of every event in ``event_graph``, zeros included, without building an edge.

    An event points at those after it that start by its end plus the gap: all
    starts up to there less the events up to itself.  Those before it whose end
    plus gap has not passed at its start point at it.  Both are running counts
    over starts and ends; counted once per video and once per track, their
    difference is the co-occurrence with other tracks.
    """
    e = events.select(*TRACK, "event_type", "event_id", "start_ms", "end_ms")
    e = e.withColumn("_of", F.explode(F.array(F.lit("video"), F.concat(F.lit("track:"), F.coalesce(F.col("track_id").cast("string"), F.lit(""))))))
    mark = F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("end_ms") + gap_ms).alias("at"), F.lit(1).alias("kind"))))
    m = e.withColumn("_m", mark).select("*", "_m.at", "_m.kind").drop("_m")
    key = ["video_id", "_of"]
    m = index_rows(m, key, ["at", "kind", "end_ms", "event_type", "event_id"], F.floor(F.col("at") / slot_ms).cast("long"))
    m = running_sum(m, key, 1 - F.col("kind"), "_starts", block=block)
    start = F.col("kind") == 0
    n = m.groupBy(*key, *TRACK[1:], "event_id", "event_type").agg(
        F.max(F.when(start, F.col("_starts") - 1)).alias("_before"), F.max(F.when(start, F.col("seq") + 1 - F.col("_starts"))).alias("_over"),
        F.max(F.when(~start, F.col("_starts"))).alias("_reached"))
    after = F.greatest(F.col("_reached") - F.col("_before") - 1, F.lit(0))
    whole = F.col("_of") == "video"
    sign = F.when(whole, 1).otherwise(-1)
    last = n.where(~whole).groupBy(*TRACK).agg(F.max("_before").alias("_last"))
    d = n.groupBy(*TRACK, "event_id", "event_type").agg(
        F.sum(sign * after).alias("_co_out"), F.sum(sign * (F.col("_before") - F.col("_over"))).alias("_co_in"),
        F.max(F.when(~whole, F.col("_before"))).alias("_place"))
    d = d.join(last, TRACK).withColumn("same_track_edges", (F.col("_place") < F.col("_last")).cast("long"))
    return d.select("video_id", "event_id", "event_type", "track_id", (F.col("_co_in") + (F.col("_place") > 0).cast("long")).alias("in_degree"),
                    (F.col("_co_out") + F.col("same_track_edges")).alias("out_degree"), "same_track_edges", F.col("_co_out").alias("co_occurrence_edges")).withColumn(
        "degree", F.col("in_degree") + F.col("out_degree"))


def graph_metrics(events: DataFrame, gap_ms: float = 2000.0) -> DataFrame:
    """Nodes, edges by kind, isolated nodes and mean degree per video."""
    return degrees(events, gap_ms).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated_nodes"),
        F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"), F.sum("out_degree").alias("edges"),
        F.sum("same_track_edges").alias("same_track_edges"), F.sum("co_occurrence_edges").alias("co_occurrence_edges"))


def hub_events(events: DataFrame, top_n: int = 5, gap_ms: float = 2000.0) -> DataFrame:
    """The best connected events of each video."""
    return first_n(degrees(events, gap_ms), ["video_id"], [F.desc("degree"), "event_id"], top_n, "hub_rank")


def isolated_events(events: DataFrame, gap_ms: float = 2000.0) -> DataFrame:
    return degrees(events, gap_ms).where(F.col("degree") == 0)


def root_events(events: DataFrame, gap_ms: float = 2000.0) -> DataFrame:
    """Events no edge points at."""
    return degrees(events, gap_ms).where(F.col("in_degree") == 0)


def centrality(events: DataFrame, gap_ms: float = 2000.0) -> DataFrame:
    """Degree centrality: degree over the number of other events of the video."""
    d = degrees(events, gap_ms)
    n = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, "video_id").withColumn("centrality", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def track_nodes(events: DataFrame) -> DataFrame:
    """Nodes of every track's subgraph in event order; filter on one track to read its own."""
    return ordered_events(events).select(*TRACK, "event_id", "event_type", F.col("seq").alias("position"))


def track_subgraphs(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between events of the same track, for every track; filter on one to read its subgraph."""
    t = events.select("video_id", "event_id", "track_id")
    return (edges.join(t.withColumnRenamed("event_id", "source"), ["video_id", "source"])
            .join(t.withColumnsRenamed({"event_id": "target", "track_id": "_other"}), ["video_id", "target"])
            .where(F.col("track_id") == F.col("_other")).drop("_other"))


def _actor(events: DataFrame) -> DataFrame:
    label, track = F.col("person_label"), F.col("track_id")
    return (events.withColumn("actor", F.when(label.isNotNull(), F.concat(F.lit("person:"), label))
                              .when(track.isNotNull(), F.concat(F.lit("track:"), track.cast("string")))
                              .otherwise(F.concat(F.lit("event:"), F.col("event_type"))))
            .withColumn("actor_kind", F.when(label.isNotNull(), "person").when(track.isNotNull(), "track").otherwise("scene")))


def actor_nodes(events: DataFrame) -> DataFrame:
    e = _actor(events)
    return e.groupBy("video_id", "actor", "actor_kind").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("start_ms").alias("first_seen_ms"), F.max("start_ms").alias("last_seen_ms"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types")).withColumn(
        "duration_s", (F.col("last_seen_ms") - F.col("first_seen_ms")) / 1000.0)


def actor_arcs(events: DataFrame) -> DataFrame:
    """First to last event type for actors with at least two events."""
    e = _actor(events).withColumn("_o", F.struct(*EVENT_ORDER))
    a = e.groupBy("video_id", "actor").agg(F.count(F.lit(1)).alias("weight"), F.min_by("event_type", "_o").alias("_a"),
                                           F.max_by("event_type", "_o").alias("_b")).where(F.col("weight") >= 2)
    plain = [F.replace(F.col(c), F.lit("_"), F.lit(" ")) for c in ("_a", "_b")]
    return a.withColumn("label", F.concat_ws(" → ", *plain)).drop("_a", "_b")


def actor_co_activity(events: DataFrame, window_ms: float = 10_000.0) -> DataFrame:
    """Event pairs of two actors that start within the window, counted per actor pair.

    Events are first counted per actor and instant; the join then meets counts,
    not events, and only in neighbouring time buckets.
    """
    c = _actor(events).groupBy("video_id", "actor", "start_ms").agg(F.count(F.lit(1)).alias("n"))
    b = bucket(F.col("start_ms"), window_ms)
    left = c.select("video_id", F.col("actor").alias("source"), F.col("start_ms").alias("sa"), F.col("n").alias("na"),
                    F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    right = c.select("video_id", F.col("actor").alias("target"), F.col("start_ms").alias("sb"), F.col("n").alias("nb"), b.alias("_b"))
    return (left.join(right, ["video_id", "_b"])
            .where((F.col("source") < F.col("target")) & (F.abs(F.col("sa") - F.col("sb")) <= window_ms))
            .groupBy("video_id", "source", "target").agg(F.sum(F.col("na") * F.col("nb")).alias("weight"))
            .withColumn("label", F.concat(F.lit("Co-active "), F.col("weight").cast("string"), F.lit("×"))))


def edge_labels(edges: DataFrame) -> DataFrame:
    return edges.withColumn("label", title_case(F.col("relationship")))
