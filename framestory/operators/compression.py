"""Keep or discard whole chains under a retention budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.functions.numbers import rounded
from framestory.plans.sequence import BLOCK_ROWS, running_sum
from framestory.session import cut_lineage

TRACK = ["video_id", "track_id"]


def compression_policy(ranked: DataFrame, target_ratio: float = 0.40, keep_complete: bool = True,
                       min_narrative: float = 0.20, atomic: bool = True, keep_all_threshold: int = 20,
                       block: int = BLOCK_ROWS) -> DataFrame:
    """One decision per ranked segment.

    Candidates are taken in rank order when they fit the remaining budget; one
    that does not fit is passed over and later smaller ones may still fit.
    That sequential rule is computed in rounds over all videos at once: every
    round drops candidates larger than the remaining budget, keeps the longest
    prefix that fits, and the next round starts behind the first that did not.
    The largest remaining size shrinks every round, so rounds are few and no
    video passes through one task.  Running totals grow with the rank, so what
    fits is what stands before the first that does not.
    """
    r = cut_lineage(ranked.select(*TRACK, "segment_id", "event_count", "completeness", "narrative_score", "combined_rank", "rank"))
    group = (F.when(F.col("narrative_score") < min_narrative, "low")
             .when(F.lit(keep_complete) & (F.col("completeness") == "complete"), "complete").otherwise("candidate"))
    r = r.withColumn("_g", group)
    totals = r.groupBy("video_id").agg(
        F.sum("event_count").alias("_total"), F.count(F.when(F.col("_g") == "complete", 1)).alias("_nc"),
        F.coalesce(F.sum(F.when(F.col("_g") == "complete", F.col("event_count"))), F.lit(0)).alias("_done"))
    totals = totals.withColumn("_budget", F.greatest(
        F.floor(F.col("_total") * target_ratio).cast("long") - F.col("_done"), F.lit(0)))
    cand = r.where(F.col("_g") == "candidate").join(totals, "video_id")
    all_kept = cand.where(F.col("_total") <= keep_all_threshold).select(*TRACK)
    open_ = cand.where(F.col("_total") > keep_all_threshold).select(
        *TRACK, "event_count", "rank", "_budget", "_nc")
    # With nothing kept and no budget at all, the first candidate is kept anyway.
    last_chance = (open_.where((F.col("_budget") == 0) & (F.col("_nc") == 0)).groupBy("video_id")
                   .agg(F.min_by("track_id", "rank").alias("track_id")).select(*TRACK))
    if atomic:
        fitting = _fit_in_order(open_.where(F.col("_budget") > 0).select(*TRACK, "event_count", "rank", "_budget"), block)
    else:
        d = running_sum(open_, ["video_id"], F.col("event_count"), "_cum", seq="rank", block=block)
        fitting = d.where(F.col("_cum") - F.col("event_count") < F.col("_budget")).select(*TRACK)
    # Without atomic chains there is no last chance.
    kept = all_kept.unionByName(fitting)
    if atomic:
        kept = kept.unionByName(last_chance)
    kept = kept.withColumn("_keep", F.lit(True))
    d = r.join(kept, TRACK, "left")
    keep = F.when(F.col("_g") == "complete", True).when(F.col("_g") == "low", False).otherwise(F.coalesce("_keep", F.lit(False)))
    reason = (F.when(F.col("_g") == "complete", "complete_chain_preserved").when(F.col("_g") == "low", "low_narrative_quality")
              .when(F.col("keep"), "high_combined_rank").otherwise("below_ratio_threshold"))
    return d.withColumn("keep", keep).withColumn("reason", reason).drop("_g", "_keep")


def _fit_in_order(cand: DataFrame, block: int) -> DataFrame:
    todo = cand.withColumnRenamed("_budget", "_left")
    kept = None
    while True:
        todo = todo.where(F.col("event_count") <= F.col("_left"))
        d = cut_lineage(running_sum(todo, ["video_id"], F.col("event_count"), "_cum", seq="rank", block=block))
        if d.isEmpty():
            break
        stop = d.groupBy("video_id").agg(F.min(F.when(F.col("_cum") > F.col("_left"), F.col("rank"))).alias("_stop"),
                                         F.max(F.when(F.col("_cum") <= F.col("_left"), F.col("_cum"))).alias("_used"))
        d = d.join(stop, "video_id")
        now = d.where(F.col("_cum") <= F.col("_left")).select(*TRACK)
        kept = now if kept is None else kept.unionByName(now)
        todo = d.where(F.col("rank") > F.col("_stop")).select(
            *TRACK, "event_count", "rank", (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left"))
    return kept if kept is not None else cand.select(*TRACK)


def event_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """The segment decision carried to every event."""
    d = decisions.select(*TRACK, "segment_id", "keep", "reason", "narrative_score", F.col("combined_rank").alias("combined_score"))
    return events.join(d, TRACK)


def summary_events(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Kept events; sort by start when reading a single video."""
    return events.join(decisions.where("keep").select(*TRACK), TRACK, "left_semi")


def compression_metrics(decisions: DataFrame) -> DataFrame:
    n, keep = F.col("event_count"), F.col("keep")
    complete = F.col("completeness") == "complete"
    d = decisions.groupBy("video_id").agg(
        F.sum(n).alias("total_events"), F.coalesce(F.sum(F.when(keep, n)), F.lit(0)).alias("kept_events"),
        F.count(F.when(keep, 1)).alias("kept_segments"), F.count(F.when(~keep, 1)).alias("discarded_segments"),
        F.count(F.when(complete, 1)).alias("_c"), F.count(F.when(complete & keep, 1)).alias("_ck"),
        F.avg(F.when(keep, n)).alias("_len"))
    return (d.withColumn("discarded_events", F.col("total_events") - F.col("kept_events"))
            .withColumn("ratio_achieved", rounded(F.col("kept_events") / F.col("total_events"), 4))
            .withColumn("completeness_retained", rounded(F.when(F.col("_c") > 0, F.col("_ck") / F.col("_c")).otherwise(1.0), 4))
            .withColumn("avg_chain_length", rounded(F.coalesce("_len", F.lit(0.0)), 4)).drop("_c", "_ck", "_len"))


def decision_manifest(ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per segment with its scores, decision and reason."""
    d = decisions.select(*TRACK, "keep", "reason")
    return ranked.select(*TRACK, "segment_id", "rank", "completeness", "event_count", "importance_score", "narrative_score",
                         "combined_rank", "start_ms", "end_ms").join(d, TRACK)
