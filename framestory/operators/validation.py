"""Checks that a selection still tells whole stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.operators.events import EVENT_ORDER, event_slot
from framestory.operators.story import is_action, is_entry, is_exit
from framestory.plans.sequence import BLOCK_ROWS, walk_rows
from framestory.session import cut_lineage

TRACK = ["video_id", "track_id"]


def validate_narrative(segments: DataFrame, events: DataFrame, kept_segments: DataFrame, kept_events: DataFrame, compat: bool = False,
                       block: int = BLOCK_ROWS) -> DataFrame:
    """All issues of the five checks.

    ``kept_segments`` holds (video_id, track_id), ``kept_events`` (video_id,
    event_id).  An event's predecessor is the one before it on its track, so no
    edge table is needed: events carry a kept flag, their own and their
    predecessor's, and are written once for the checks by event and by chain.
    """
    flag = kept_events.select("video_id", "event_id").distinct().withColumn("_k", F.lit(True))
    chains = kept_segments.select(*TRACK).distinct().withColumn("_s", F.lit(True))
    d = events.select(*TRACK, "event_id", "event_type", "start_ms", "end_ms").join(flag, ["video_id", "event_id"], "left")
    d = walk_rows(d, TRACK, EVENT_ORDER, event_slot(), before={"_pe": "event_id", "_pk": "_k"}, short=block, counted=events)
    d = d.where("_k").join(chains, TRACK, "left").join(segments.select(*TRACK, "completeness", F.lit(True).alias("_g")), TRACK, "left")
    d = cut_lineage(d.select(*TRACK, "event_id", "event_type", "start_ms", "end_ms", "_pe", "_pk", "_s", "_g", "completeness"))

    def issue(when, severity, check, event_id, detail):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), event_id.cast("long").alias("event_id"), detail.alias("detail")))

    def listed(df, *issues):
        return df.select("video_id", "track_id", F.explode(F.array_compact(F.array(*issues))).alias("i")).select(
            "video_id", "i.severity", "i.check", "track_id", "i.event_id", "i.detail")

    by_event = listed(d, issue(F.col("_s").isNull(), "error", "no_orphaned_events", F.col("event_id"), F.col("event_type")),
                      issue(F.col("_pe").isNotNull() & F.col("_pk").isNull(), "warning", "graph_connectivity", F.col("event_id"), F.col("_pe").cast("string")))
    t, o = F.col("event_type"), F.struct("start_ms", "end_ms", "event_type", "event_id")
    per = d.where("_s AND _g").groupBy(*TRACK, "completeness").agg(
        F.bool_or(is_entry(t)).alias("e"), F.bool_or(is_exit(t)).alias("x"), F.bool_or(is_action(t, compat)).alias("a"),
        F.min(o).alias("first"), F.max(o).alias("last"))
    missing = F.array_join(F.array_compact(F.array(F.when(~F.col("e"), "entry"), F.when(~F.col("a"), "action"), F.when(~F.col("x"), "exit"))), ", ")
    by_chain = listed(
        per, issue((F.col("completeness") == "complete") & ~(F.col("e") & F.col("x") & F.col("a")), "error", "complete_chain_integrity", F.lit(None), missing),
        issue(is_exit(F.col("first.event_type")), "warning", "no_chain_starts_with_exit", F.col("first.event_id"), F.col("first.event_type")),
        issue(is_entry(F.col("last.event_type")), "warning", "no_chain_ends_with_entry", F.col("last.event_id"), F.col("last.event_type")))
    return by_event.unionByName(by_chain)


def validation_report(issues: DataFrame, kept_segments: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per video with kept segments: counts and validity (no errors)."""
    n = (segments.join(kept_segments.select(*TRACK), TRACK, "left_semi").groupBy("video_id").agg(
        F.count(F.lit(1)).alias("chains_checked"), F.count(F.when(F.col("completeness") == "complete", 1)).alias("_c")))
    i = issues.groupBy("video_id").agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"),
        F.count(F.when(F.col("check") == "complete_chain_integrity", 1)).alias("_b"),
        F.count(F.when(F.col("check") == "no_orphaned_events", 1)).alias("orphaned_events"))
    return (n.join(i, "video_id", "left").fillna(0)
            .withColumn("complete_chains_intact", F.col("_c") - F.col("_b")).withColumn("is_valid", F.col("errors") == 0)
            .drop("_c", "_b"))
