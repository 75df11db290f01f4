"""Baselines, summary quality, sweeps and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.functions.numbers import rounded
from framestory.operators.activity import BASE, MIN_IOP, MIN_PERSISTENCE, STAIR_THRESHOLD, TAU
from framestory.operators.events import event_slot
from framestory.operators.story import is_action, is_entry, is_exit
from framestory.plans.intervals import overlap_counts
from framestory.plans.sequence import grouped_median, index_rows, score_slot, walk_rows
from framestory.session import cut_lineage

TRACK = ["video_id", "track_id"]
ORDER = ["start_ms", "end_ms", "event_type", "event_id"]


def _keep_counts(events: DataFrame, ratio: float) -> DataFrame:
    n = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_keep", F.greatest(F.floor(F.col("_n") * ratio).cast("long"), F.lit(1)))


def baseline_uniform(events: DataFrame, ratio: float = 0.40, slot_ms: float = 600_000.0) -> DataFrame:
    """Every step-th event in time order, the first n of them."""
    d = walk_rows(events, ["video_id"], ORDER, event_slot(slot_ms), "_i").join(_keep_counts(events, ratio), "video_id")
    step = F.greatest(F.floor(F.col("_n") / F.col("_keep")).cast("long"), F.lit(1))
    return d.where((F.pmod(F.col("_i"), step) == 0) & (F.floor(F.col("_i") / step) < F.col("_keep"))).select("video_id", "event_id")


def _top(events: DataFrame, score: str, ratio: float, counts: DataFrame) -> DataFrame:
    d = index_rows(events, ["video_id"], [F.desc(score), *ORDER], score_slot(F.col(score), F.floor(F.col("start_ms") / 600_000.0)), "_i").join(counts, "video_id")
    return d.where(F.col("_i") < F.col("_keep")).select("video_id", "event_id")


def baseline_motion(events: DataFrame, ratio: float = 0.40, score: str = "motion") -> DataFrame:
    """The events with the highest motion dimension."""
    return _top(events, score, ratio, _keep_counts(events, ratio))


def baseline_scene(events: DataFrame, ratio: float = 0.40, window_ms: float = 5000.0) -> DataFrame:
    """The most confident event of every tumbling window, capped at the ratio by confidence."""
    w = F.floor(F.col("start_ms") / window_ms).cast("long")
    # min over (-confidence, order) is the first of the most confident
    first = F.min(F.struct((-F.col("confidence")).alias("n"), *ORDER))
    best = events.groupBy("video_id", w.alias("_w")).agg(first.alias("_b")).select("video_id", (-F.col("_b.n")).alias("confidence"),
                                                                                    *[F.col(f"_b.{c}").alias(c) for c in ORDER])
    return _top(best, "confidence", ratio, _keep_counts(events, ratio))


def summary_quality(name: str, kept: DataFrame, events: DataFrame, segments: DataFrame) -> DataFrame:
    """Ratio, completeness kept, broken chains and mean kept chain length per video."""
    k = kept.select("video_id", "event_id").withColumn("_k", F.lit(1))
    per = events.select(*TRACK, "event_id").join(k, ["video_id", "event_id"], "left").groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_kept")).join(segments.select(*TRACK, "completeness"), TRACK)
    done = F.col("completeness") == "complete"
    d = per.groupBy("video_id").agg(
        F.sum("_n").alias("total_events"), F.sum("_kept").alias("kept_events"), F.count(F.when(done, 1)).alias("_c"),
        F.count(F.when(done & (F.col("_kept") == F.col("_n")), 1)).alias("_ck"),
        F.count(F.when((F.col("_kept") > 0) & (F.col("_kept") < F.col("_n")), 1)).alias("broken_narratives"),
        F.coalesce(F.avg(F.when(F.col("_kept") > 0, F.col("_kept"))), F.lit(0.0)).alias("avg_chain_length"))
    return (d.withColumn("approach", F.lit(name)).withColumn("compression_ratio", F.col("kept_events") / F.col("total_events"))
            .withColumn("completeness_retained", F.when(F.col("_c") > 0, F.col("_ck") / F.col("_c")).otherwise(1.0)).drop("_c", "_ck"))


def compare_summarizers(rows: Sequence[DataFrame]) -> DataFrame:
    """All approaches with flags for the best of each video; the earlier approach wins ties."""
    d = reduce(DataFrame.unionByName, [r.withColumn("_o", F.lit(i)) for i, r in enumerate(rows)])
    best = d.groupBy("video_id").agg(
        F.min(F.struct((-F.col("completeness_retained")).alias("v"), "_o")).alias("_b1"), F.min(F.struct("broken_narratives", "_o")).alias("_b2"),
        F.min(F.struct((-F.col("avg_chain_length")).alias("v"), "_o")).alias("_b3"))
    d = d.join(best, "video_id")
    for i, n in ((1, "best_completeness"), (2, "least_broken"), (3, "longest_chains")):
        d = d.withColumn(n, F.col(f"_b{i}._o") == F.col("_o"))
    return d.drop("_o", "_b1", "_b2", "_b3")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _with_scores(d: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = d.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn))


def _confusion(truth: Column, fired: Column) -> list[Column]:
    n = lambda c: F.count(F.when(c, 1))
    return [n(truth & fired).alias("tp"), n(~truth & fired).alias("fp"), n(~truth & ~fired).alias("tn"), n(truth & ~fired).alias("fn")]


def binary_metrics(pred: DataFrame, label: str = "label") -> DataFrame:
    """Confusion counts and scores, overall (``*``) and per label, in one pass."""
    d = pred.rollup(label).agg(*_confusion(F.col("truth"), F.col("fired")), F.grouping(label).alias("_all"))
    return _with_scores(d.withColumn(label, F.when(F.col("_all") == 1, "*").otherwise(F.col(label))).drop("_all"))


def _stacked(df: DataFrame, keys: Sequence[str], cases: Sequence[tuple[str, dict[str, Column]]], name: str) -> DataFrame:
    """One aggregation pass with the measures of every case, one row per case."""
    measures = list(cases[0][1])
    aggs = [expr.alias(f"_{i}_{m}") for i, (_c, e) in enumerate(cases) for m, expr in e.items()]
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"_{i}_{m}").alias(m) for m in measures]) for i, (c, _e) in enumerate(cases)])
    return wide.withColumn("_r", F.explode(rows)).select(*keys, "_r.*")


def threshold_sweep(features: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Cycling labels per speed threshold, with and without the proximity signal.

    ``features`` has mean_speed, height_std and near_conf (0 without a bicycle).
    """
    v, steady, near = F.col("mean_speed"), F.col("height_std") < 0.03, F.col("near_conf")
    n = lambda c: F.count(F.when(c, 1))
    cases = []
    for t in thresholds:
        fast = v >= t
        for fix in (False, True):
            label = (fast & steady) if fix else ((near > 0) & (near >= 0.60)) | ((near <= 0) & fast & steady)
            cases.append((f"{t:g}/{'temporal' if fix else 'base'}", {
                "cycling_tracks": n(label), "speed_triggers": n(fast), "height_triggers": n(steady), "both_triggers": n(fast & steady),
                "below_threshold": n(v < t), "tracks": F.count(F.lit(1))}))
    d = _stacked(features, ["video_id"], cases, "variant")
    pct = lambda c: rounded(100 * F.col(c) / F.greatest(F.col("tracks"), F.lit(1)), 1)
    return (d.withColumn("cycling_pct", pct("cycling_tracks")).withColumn("speed_pct", pct("speed_triggers"))
            .withColumn("speed_percentile", pct("below_threshold")))


def min_observation_sweep(labelled: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Label counts per setting, tracks that lost a velocity label and the median length of those that kept one.

    ``labelled`` lists (setting, labelled tracks); the first is the baseline.
    """
    vel = F.col("activity").isin("running", "walking_upstairs", "walking_downstairs")
    base = labelled[0][1].where(vel).select(*TRACK).withColumn("_b", F.lit(True))
    out = []
    for name, d in labelled:
        d = d.join(base, TRACK, "left")
        a = d.groupBy("video_id").agg(
            *[F.count(F.when(F.col("activity") == k, 1)).alias(k) for k in ("running", "walking_upstairs", "walking_downstairs", "cycling", "walking", "entering_scene")],
            F.count(F.when(vel, 1)).alias("velocity_tracks"), F.count(F.when(F.col("_b") & ~vel, 1)).alias("removed_tracks"),
            F.min(F.when(vel, F.col("n_obs"))).alias("shortest_kept"), F.max(F.when(F.col("_b") & ~vel, F.col("n_obs"))).alias("longest_removed"))
        m = grouped_median(d.where(vel), ["video_id"], "n_obs", 10.0, "median_length")
        out.append(a.join(m, "video_id", "left").withColumn("setting", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def persistence_sweep(items: DataFrame, levels: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Confusion per persistence requirement and with or without the overlap gate.

    ``items`` has truth, c_vel, c_scene, p_scene and iop.
    """
    def fires(eff: Column) -> Column:
        return F.col("c_vel") * (BASE + (1 - BASE) * F.least(F.lit(1.0), eff / TAU)) >= STAIR_THRESHOLD

    cases = []
    for p in levels:
        eff = F.when(F.col("p_scene") >= p, F.col("c_scene")).otherwise(0.0)
        cases.append((f"p>={p}", eff))
    two = F.when(F.col("p_scene") >= MIN_PERSISTENCE, F.col("c_scene")).otherwise(0.0)
    cases.append(("frame_level_only", two))
    cases.append(("spatial_overlap_gated", F.when(F.col("iop") < MIN_IOP, 0.0).otherwise(two)))
    named = [(c, {k: e for k, e in zip(("tp", "fp", "tn", "fn"), _confusion(F.col("truth"), fires(eff)))}) for c, eff in cases]
    return _with_scores(_stacked(items, [], named, "setting"))


def distribution_by_category(items: DataFrame, category: str, value: str) -> DataFrame:
    v = F.col(value)
    return items.groupBy(category).agg(
        F.count(F.lit(1)).alias("total_items"), F.count(F.when(v > 0, 1)).alias("nonzero_items"), F.avg(v).alias("mean"), F.max(v).alias("max"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("mean_nonzero")).withColumn(
        "pct_nonzero", rounded(100.0 * F.col("nonzero_items") / F.col("total_items"), 1))


def temporal_quality(pred: DataFrame, truth: DataFrame, chains: DataFrame, width: float = 60_000.0) -> DataFrame:
    """Precision, recall, F1, coverage, false-positive share and whole chains per video.

    A predicted and a true event match when they have the same type and overlap
    in time.  ``truth`` has truth_id, event_type, truth_start, truth_end;
    ``chains`` has video_id, chain_id, truth_id.
    """
    at = ["video_id", "event_type"]
    m = overlap_counts(pred.select(*at, F.col("event_id").alias("id"), "start_ms", "end_ms"),
                       truth.select(*at, F.col("truth_id").alias("id"), F.col("truth_start").alias("start_ms"), F.col("truth_end").alias("end_ms")),
                       at, "id", "start_ms", "end_ms", width)
    m = cut_lineage(m.where(F.col("others") > 0).select("video_id", "side", "id"))
    hit_p = m.where(F.col("side") == 0).groupBy("video_id").agg(F.count_distinct("id").alias("matched_pred"))
    hit_ids = m.where(F.col("side") == 1).select("video_id", F.col("id").alias("truth_id"), F.lit(1).alias("_h"))
    hit_t = hit_ids.groupBy("video_id").agg(F.count_distinct("truth_id").alias("matched_truth"))
    whole = (chains.join(hit_ids, ["video_id", "truth_id"], "left").groupBy("video_id", "chain_id").agg((F.count(F.lit(1)) == F.count("_h")).alias("_w"))
             .groupBy("video_id").agg(F.count(F.lit(1)).alias("chains"), F.count(F.when(F.col("_w"), 1)).alias("whole_chains")))
    n_p = pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("predicted"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("_out"), F.max("end_ms").alias("_len"))
    n_t = truth.groupBy("video_id").agg(F.count(F.lit(1)).alias("relevant"))
    d = n_p.join(n_t, "video_id", "full").join(hit_p, "video_id", "left").join(hit_t, "video_id", "left").join(whole, "video_id", "left").fillna(
        0, ["predicted", "relevant", "matched_pred", "matched_truth", "chains", "whole_chains"])
    d = (d.withColumn("precision", _ratio(F.col("matched_pred"), F.col("predicted"))).withColumn("recall", _ratio(F.col("matched_truth"), F.col("relevant"))))
    p, r = F.col("precision"), F.col("recall")
    return (d.withColumn("f1", _ratio(2 * p * r, p + r)).withColumn("event_coverage", r).withColumn("false_positive_rate", 1.0 - p)
            .withColumn("narrative_score", _ratio(F.col("whole_chains"), F.col("chains"))).withColumn("compression_ratio", _ratio(F.col("_len"), F.col("_out"))).drop("_out", "_len"))


def variant_delta(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """b minus a for every metric, in long form."""
    def long(d: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return d.withColumn("_m", F.explode(pairs)).select(*keys, "_m.*")

    return long(a, "base").join(long(b, "variant"), [*keys, "metric"]).withColumn("delta", F.col("variant") - F.col("base"))


def failure_summary(failures: DataFrame) -> DataFrame:
    """Failures by category, severity and stage with share and videos, in one pass.

    The most common value of each grain is flagged (first by name on ties).
    """
    d = (failures.groupingSets([["category"], ["severity"], ["stage"]], "category", "severity", "stage")
         .agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("video_id").alias("videos"), F.grouping("category").alias("_c"), F.grouping("severity").alias("_s")))
    d = (d.withColumn("grain", F.when(F.col("_c") == 0, "category").when(F.col("_s") == 0, "severity").otherwise("stage"))
         .withColumn("value", F.coalesce("category", "severity", "stage")).select("grain", "value", "failures", "videos"))
    top = d.groupBy("grain").agg(F.sum("failures").alias("_t"), F.min(F.struct((-F.col("failures")).alias("n"), "value")).alias("_b"))
    return (d.join(top, "grain").withColumn("share", F.col("failures") / F.col("_t")).withColumn("most_common", F.col("_b.value") == F.col("value")).drop("_t", "_b"))


def role_coverage(events: DataFrame) -> DataFrame:
    """Roles of each event type; types without a role are flagged."""
    t = F.col("event_type")
    return (events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).withColumn("is_entry", is_entry(t)).withColumn("is_action", is_action(t))
            .withColumn("is_exit", is_exit(t)).withColumn("unroled", ~(is_entry(t) | is_action(t) | is_exit(t))))


def event_loss(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events per video that no segment covers."""
    n = events.groupBy("video_id").agg(F.count(F.lit(1)).alias("events"))
    c = segments.groupBy("video_id").agg(F.sum("event_count").alias("covered"))
    return n.join(c, "video_id", "left").fillna(0, ["covered"]).withColumn("lost", F.col("events") - F.col("covered"))


def confidence_histogram(events: DataFrame) -> DataFrame:
    c = F.col("confidence")
    n = lambda cond: F.count(F.when(cond, 1))
    return events.groupBy("event_type").agg(
        F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.avg(c).alias("mean_confidence"), n(c < 0.5).alias("bin_below_050"),
        n((c >= 0.5) & (c < 0.65)).alias("bin_050_065"), n((c >= 0.65) & (c < 0.75)).alias("bin_065_075"), n(c >= 0.75).alias("bin_075_up"))


def evaluation_matrix(stage_runs: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One wide row per job: stage durations, frames, total time, real-time factor and throughput."""
    s = F.col("stage")
    d = stage_runs.groupBy("job_id").agg(
        *[F.sum(F.when(s == k, F.col("duration_ms"))).alias(f"{k}_ms") for k in stages], *[F.max(F.when(s == k, F.col("frames"))).alias(f"{k}_frames") for k in stages],
        F.sum("duration_ms").alias("_ms"), F.max("video_seconds").alias("video_seconds"))
    d = d.withColumn("processing_seconds", F.when(F.col("_ms") > 0, F.col("_ms") / 1000.0)).drop("_ms")
    return (d.withColumn("real_time_factor", F.when(F.col("video_seconds") > 0, F.col("processing_seconds") / F.col("video_seconds")))
            .withColumn("processing_fps", rounded(F.col(f"{stages[1]}_frames") / F.col("processing_seconds"), 2)))
