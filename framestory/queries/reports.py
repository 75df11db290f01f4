"""Evaluation, report, file and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions.numbers import rounded
from framestory.operators import activity, compression, evaluation, identity, interactions, posture, quality, reports, sampling, scenes, story, tracking, validation, zones
from framestory.plans.fold import fold_states, ordered_fold
from framestory.queries.events import _CATEGORY, _VARIED, decision_chain, named_events, ranked_semantic, rule_events_of, varied_events
from framestory.queries.frames import LIGHT, bright_of
from framestory.queries.motion import tracks_of
from framestory.queries.people import bike_tracks, features_of, seats_of, squashed, tracker_detections, zones_of
from framestory.queries.registry import ORACLES, query
from framestory.queries.shape import out, outs
from framestory.queries.sqlviews import IN, MEDIAN, ORD as _ORD, R, VIEWS, sql, view
from framestory.session import cut_lineage, work_folder
from framestory.sources import files
from framestory.sources.fixtures import Inputs
from framestory.streaming import run, steps
from framestory.streaming.fold import stream_fold

# Evaluation -----------------------------------------------------------------------------
def motion_events(s: Inputs):
    return s.semantic_events.withColumn("motion", (F.col("event_id") * 17 % 1000) / F.lit(1000.0))


@query("baseline_uniform", sql("SELECT * FROM b_uni", "b_uni"))
def _(s):
    return evaluation.baseline_uniform(s.semantic_events)


@query("baseline_motion", sql("SELECT * FROM b_mot", "b_mot"))
def _(s):
    return evaluation.baseline_motion(motion_events(s))


@query("baseline_scene", sql("SELECT * FROM b_scn", "b_scn"))
def _(s):
    return evaluation.baseline_scene(s.semantic_events, window_ms=120_000.0)


def _quality_sql(name: str, v: str) -> str:
    return f"""SELECT '{name}' AS approach, video_id, CAST(sum(n) AS BIGINT) AS total_events, CAST(sum(kept) AS BIGINT) AS kept_events, count(*) FILTER (WHERE kept > 0 AND kept < n) AS broken_narratives, coalesce(avg(kept) FILTER (WHERE kept > 0), 0.0E0) AS avg_chain_length,
     sum(kept) / sum(n) AS compression_ratio, CASE WHEN count(*) FILTER (WHERE completeness = 'complete') > 0 THEN count(*) FILTER (WHERE completeness = 'complete' AND kept = n) / count(*) FILTER (WHERE completeness = 'complete') ELSE 1.0E0 END AS completeness_retained
     FROM (SELECT video_id, track_id, completeness, count(*) AS n, count(k.event_id) AS kept FROM sem s LEFT JOIN {v} k USING (video_id, event_id) JOIN sem_seg1 g USING (video_id, track_id) GROUP BY ALL) GROUP BY video_id"""


QUALITY = "approach video_id total_events kept_events broken_narratives"
QUALITY_F = "avg_chain_length compression_ratio completeness_retained"


@query("summary_quality", sql(f"SELECT {outs(QUALITY, QUALITY_F)} FROM ({_quality_sql('uniform', 'b_uni')})", "b_uni", "sem", "sem_seg1"))
def _(s):
    seg = s.stage("segments", lambda: story.story_segments(s.semantic_events))
    return out(evaluation.summary_quality("uniform", evaluation.baseline_uniform(s.semantic_events), s.semantic_events, seg), QUALITY, QUALITY_F)


_ALL4 = " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({_quality_sql(n, v)})" for i, (n, v) in enumerate((("uniform", "b_uni"), ("motion", "b_mot"), ("scene", "b_scn"), ("budgeted_chains", "b_pol"))))


@query("compare_summarizers", sql(f"""SELECT {outs(QUALITY, QUALITY_F)}, row_number() OVER (PARTITION BY video_id ORDER BY completeness_retained DESC, o) = 1 AS best_completeness, row_number() OVER (PARTITION BY video_id ORDER BY broken_narratives, o) = 1 AS least_broken,
  row_number() OVER (PARTITION BY video_id ORDER BY avg_chain_length DESC, o) = 1 AS longest_chains FROM ({_ALL4})""", "b_uni", "b_mot", "b_scn", "b_pol", "sem", "sem_seg1"))
def _(s):
    ev = s.semantic_events
    r = ranked_semantic(s)
    seg = s.stage("segments", lambda: story.story_segments(ev))
    kept = compression.summary_events(ev, compression.compression_policy(r))
    rows = [s.stage("q_" + n, lambda n=n, k=k: evaluation.summary_quality(n, k, ev, seg)) for n, k in (
        ("uniform", evaluation.baseline_uniform(ev)), ("motion", evaluation.baseline_motion(motion_events(s))),
        ("scene", evaluation.baseline_scene(ev, window_ms=120_000.0)), ("budgeted_chains", kept))]
    return out(evaluation.compare_summarizers(rows), QUALITY + " best_completeness least_broken longest_chains", QUALITY_F)


_SCORES = ", ".join(f"{R(e, 6)} AS {n}" for n, e in (
    ("precision", "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0E0 END"), ("recall", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0E0 END"),
    ("f1", "CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2.0E0 * tp / (2 * tp + fp + fn) ELSE 0.0E0 END"), ("accuracy", "CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0E0 END")))
_CONF = "count(*) FILTER (WHERE truth AND fired) AS tp, count(*) FILTER (WHERE NOT truth AND fired) AS fp, count(*) FILTER (WHERE NOT truth AND NOT fired) AS tn, count(*) FILTER (WHERE truth AND NOT fired) AS fn"
_STAIR_COLS = """CASE event_id % 4 WHEN 0 THEN 'ASCENDING_STAIRS' WHEN 1 THEN 'DESCENDING_STAIRS' WHEN 2 THEN 'ESCALATOR' ELSE 'FLAT_WALK' END AS label; event_id % 4 < 2 AS truth; (500 + event_id * 37 % 450) / 1000.0E0 AS c_vel;
 (event_id * 53 % 80) / 1000.0E0 AS c_scene; event_id * 29 % 12 AS p_scene; (event_id * 71 % 400) / 1000.0E0 AS iop""".split(";")
view("items", "SELECT " + ", ".join(_STAIR_COLS) + " FROM events")


def stair_items(s: Inputs):
    return s.table("events").selectExpr(*_STAIR_COLS)


@query("binary_metrics", sql(f"SELECT label, tp, fp, tn, fn, {_SCORES} FROM (SELECT label, {_CONF} FROM (SELECT *, c_vel >= 0.7E0 AS fired FROM items) GROUP BY ALL UNION ALL SELECT '*', {_CONF} FROM (SELECT *, c_vel >= 0.7E0 AS fired FROM items))", "items"))
def _(s):
    return out(evaluation.binary_metrics(stair_items(s).withColumn("fired", F.col("c_vel") >= 0.7)), "label tp fp tn fn", "precision recall f1 accuracy")


def _fires(eff: str) -> str:
    return f"c_vel * (0.3E0 + 0.7E0 * least(1.0E0, ({eff}) / 0.05E0)) >= 0.55E0"


_TWO = "CASE WHEN p_scene >= 2 THEN c_scene ELSE 0.0E0 END"
_SWEEP = [(f"p>={p}", _fires(f"CASE WHEN p_scene >= {p} THEN c_scene ELSE 0.0E0 END")) for p in (1, 2, 3, 5, 10)] + [
    ("frame_level_only", _fires(_TWO)), ("spatial_overlap_gated", _fires(f"CASE WHEN iop < 0.15E0 THEN 0.0E0 ELSE {_TWO} END"))]


@query("persistence_sweep", sql(f"SELECT setting, tp, fp, tn, fn, {_SCORES} FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS setting, {_CONF} FROM (SELECT *, {f} AS fired FROM items)" for n, f in _SWEEP) + ")", "items"))
def _(s):
    return out(evaluation.persistence_sweep(stair_items(s)), "setting tp fp tn fn", "precision recall f1 accuracy")


@query("distribution_by_category", sql(f"""SELECT label, count(*) AS total_items, count(*) FILTER (WHERE c_scene > 0) AS nonzero_items, {R('100.0E0 * count(*) FILTER (WHERE c_scene > 0) / count(*)', 1)} AS pct_nonzero, {R('avg(c_scene)', 6)} AS mean, {R('max(c_scene)', 6)} AS max,
 {R('coalesce(avg(c_scene) FILTER (WHERE c_scene > 0), 0)', 6)} AS mean_nonzero FROM items GROUP BY ALL""", "items"))
def _(s):
    return out(evaluation.distribution_by_category(stair_items(s), "label", "c_scene"), "label total_items nonzero_items pct_nonzero", "mean max mean_nonzero")


_TH = (0.02, 0.1, 0.15, 0.25)
view("nearf", "SELECT f.*, CASE WHEN f.track_id % 5 = 0 THEN 0.8E0 WHEN f.track_id % 5 = 1 THEN 0.5E0 ELSE 0.0E0 END AS near_conf FROM feat f", "feat")


def _sweep_row(t: float, fix: bool) -> str:
    label = f"mean_speed >= {t}E0 AND height_std < 0.03E0" if fix else f"CASE WHEN near_conf > 0 THEN near_conf >= 0.6E0 ELSE mean_speed >= {t}E0 AND height_std < 0.03E0 END"
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    return (f"SELECT '{t:g}/{'temporal' if fix else 'base'}' AS variant, video_id, {n(label)} AS cycling_tracks, {n(f'mean_speed >= {t}E0')} AS speed_triggers, {n('height_std < 0.03E0')} AS height_triggers, {n(f'mean_speed >= {t}E0 AND height_std < 0.03E0')} AS both_triggers, "
            f"{R(f'100 * {n(label)} / count(*)', 1)} AS cycling_pct, {R(f'100 * ' + n(f'mean_speed >= {t}E0') + ' / count(*)', 1)} AS speed_pct, {R(f'100 * ' + n(f'mean_speed < {t}E0') + ' / count(*)', 1)} AS speed_percentile FROM nearf GROUP BY video_id")


@query("threshold_sweep", sql(" UNION ALL ".join(_sweep_row(t, f) for t in _TH for f in (False, True)), "nearf"))
def _(s):
    f = features_of(s).withColumn("near_conf", F.expr("CASE WHEN track_id % 5 = 0 THEN 0.8D WHEN track_id % 5 = 1 THEN 0.5D ELSE 0.0D END"))
    return evaluation.threshold_sweep(f, _TH).select("variant", "video_id", "cycling_tracks", "speed_triggers", "height_triggers", "both_triggers", "cycling_pct", "speed_pct", "speed_percentile")


for _m in (60, 68, 75):
    VIEWS[f"act{_m}"] = (["stair"], VIEWS["act"][1].replace("n_obs < 3", f"n_obs < {_m}"))
_VEL = "activity IN ('running', 'walking_upstairs', 'walking_downstairs')"


def _obs_sweep(name: str, v: str) -> str:
    return f"""SELECT '{name}' AS setting, video_id, {', '.join(f"count(*) FILTER (WHERE activity = '{k}') AS {k}" for k in ('running', 'walking_upstairs', 'walking_downstairs', 'cycling', 'walking', 'entering_scene'))}, count(*) FILTER (WHERE {_VEL}) AS velocity_tracks,
     count(*) FILTER (WHERE base AND NOT {_VEL}) AS removed_tracks, min(n_obs) FILTER (WHERE {_VEL}) AS shortest_kept, max(n_obs) FILTER (WHERE base AND NOT {_VEL}) AS longest_removed, {MEDIAN(f"CASE WHEN {_VEL} THEN n_obs END").replace('list(', 'list(').replace(f"list(CASE WHEN {_VEL} THEN n_obs END)", f"list(n_obs) FILTER (WHERE {_VEL})")} AS median_length
     FROM (SELECT a.*, b.{_VEL} AS base FROM {v} a JOIN act b USING (video_id, track_id)) GROUP BY video_id""".replace("list_sort(list(n_obs) FILTER", "list_sort(list(n_obs) FILTER")


@query("min_observation_sweep", sql(" UNION ALL ".join(_obs_sweep(n, v) for n, v in (("default", "act"), ("60", "act60"), ("68", "act68"), ("75", "act75"))), "act", "act60", "act68", "act75"))
def _(s):
    sig = s.stage("signals", lambda: activity.stair_signal(activity.cycling_signal(features_of(s), bike_tracks(s))))
    return evaluation.min_observation_sweep([("default", activity.classify_activity(sig))] + [(str(m), activity.classify_activity(sig, m)) for m in (60, 68, 75)])


view("tmatch", """SELECT p.video_id, p.event_id, t.truth_id FROM sem p JOIN truth t ON p.video_id = t.video_id AND p.event_type = t.event_type AND p.start_ms <= t.truth_end AND t.truth_start <= p.end_ms JOIN b_uni u ON u.event_id = p.event_id""", "sem", "truth", "b_uni")
view("tchain", "SELECT video_id, track_id AS chain_id, event_id AS truth_id FROM sem", "sem")


@query("temporal_quality", sql(f"""SELECT video_id, predicted, relevant, matched_pred, matched_truth, chains, whole_chains, {R('matched_pred / predicted', 6)} AS precision, {R('matched_truth / relevant', 6)} AS recall, {R('2.0E0 * (matched_pred / predicted) * (matched_truth / relevant) / (matched_pred / predicted + matched_truth / relevant)', 6)} AS f1,
  {R('matched_truth / relevant', 6)} AS event_coverage, {R('1 - matched_pred / predicted', 6)} AS false_positive_rate, {R('whole_chains / chains', 6)} AS narrative_score, {R('len / outp', 6)} AS compression_ratio
 FROM (SELECT video_id, count(*) AS predicted, sum(end_ms - start_ms) AS outp, max(end_ms) AS len FROM sem JOIN b_uni USING (video_id, event_id) GROUP BY ALL) JOIN (SELECT video_id, count(*) AS relevant FROM truth GROUP BY ALL) USING (video_id)
 JOIN (SELECT video_id, count(DISTINCT event_id) AS matched_pred, count(DISTINCT truth_id) AS matched_truth FROM tmatch GROUP BY ALL) USING (video_id)
 JOIN (SELECT video_id, count(*) AS chains, count(*) FILTER (WHERE w) AS whole_chains FROM (SELECT video_id, chain_id, bool_and(truth_id IN (SELECT truth_id FROM tmatch)) AS w FROM tchain GROUP BY ALL) GROUP BY ALL) USING (video_id)""", "tmatch", "tchain", "sem", "truth", "b_uni"))
def _(s):
    chains = s.semantic_events.select("video_id", F.col("track_id").alias("chain_id"), F.col("event_id").alias("truth_id"))
    pred = s.stage("uniform_events", lambda: s.semantic_events.join(evaluation.baseline_uniform(s.semantic_events), ["video_id", "event_id"], "left_semi"))
    return out(evaluation.temporal_quality(pred, s.truth_events, chains), "video_id predicted relevant matched_pred matched_truth chains whole_chains",
               "precision recall f1 event_coverage false_positive_rate narrative_score compression_ratio")


_DM = ("kept_events", "broken_narratives", "avg_chain_length")


@query("variant_delta", sql(" UNION ALL ".join(f"SELECT video_id, '{m}' AS metric, {R(f'a.{m}', 6)} AS base, {R(f'b.{m}', 6)} AS variant, {R(f'b.{m} - a.{m}', 6)} AS delta FROM ({_quality_sql('u', 'b_uni')}) a JOIN ({_quality_sql('m', 'b_mot')}) b USING (video_id)" for m in _DM), "b_uni", "b_mot", "sem", "sem_seg1"))
def _(s):
    ev = s.semantic_events
    seg = s.stage("segments", lambda: story.story_segments(ev))
    a, b = (evaluation.summary_quality(n, k, ev, seg) for n, k in (("u", evaluation.baseline_uniform(ev)), ("m", evaluation.baseline_motion(motion_events(s)))))
    return out(evaluation.variant_delta(a, b, ["video_id"], _DM), "video_id metric", "base variant delta")


_FAIL = """CASE {p}l_partkey % 6 WHEN 0 THEN 'missed_event' WHEN 1 THEN 'false_event' WHEN 2 THEN 'tracking_failure' WHEN 3 THEN 'story_break' WHEN 4 THEN 'compression_error' ELSE 'validator_warning' END"""
_FAIL_COLS = [(_FAIL.format(p=""), "category"), ("CASE WHEN l_discount > 0.08 THEN 'critical' WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END", "severity"), ("'s' || l_linenumber", "stage"), ("l_suppkey", "video_id")]
view("fails", "SELECT " + ", ".join(f"{e} AS {n}" for e, n in _FAIL_COLS) + " FROM lineitem")


@query("failure_summary", sql("SELECT grain, value, failures, videos, " + R("failures / sum(failures) OVER (PARTITION BY grain)", 6) + " AS share, row_number() OVER (PARTITION BY grain ORDER BY failures DESC, value) = 1 AS most_common FROM ("
                              + " UNION ALL ".join(f"SELECT '{c}' AS grain, {c} AS value, count(*) AS failures, count(DISTINCT video_id) AS videos FROM fails GROUP BY ALL" for c in ("category", "severity", "stage")) + ")", "fails"))
def _(s):
    f = s.table("lineitem").selectExpr(*[f"{e} AS {n}" for e, n in _FAIL_COLS])
    return out(evaluation.failure_summary(f), "grain value failures videos most_common", "share")


_E, _A, _X = (f"event_type IN {IN(v)}" for v in (fixed.ENTRY_TYPES, fixed.ACTION_TYPES, fixed.EXIT_TYPES))


@query("role_coverage", sql(f"SELECT event_type, count(*) AS events, {_E} AS is_entry, {_A} AS is_action, {_X} AS is_exit, NOT ({_E} OR {_A} OR {_X}) AS unroled FROM (SELECT * REPLACE ({_VARIED} AS event_type) FROM sem) GROUP BY event_type", "sem"))
def _(s):
    return evaluation.role_coverage(varied_events(s))


@query("event_loss", sql("SELECT video_id, n AS events, c AS covered, n - c AS lost FROM (SELECT video_id, count(*) AS n, count(u.event_id) AS c FROM sem LEFT JOIN b_uni u USING (video_id, event_id) GROUP BY ALL)", "sem", "b_uni"))
def _(s):
    """Segments built from a uniform sample leave the other events uncovered."""
    sample = s.semantic_events.join(evaluation.baseline_uniform(s.semantic_events), ["video_id", "event_id"], "left_semi")
    return evaluation.event_loss(s.semantic_events, story.story_segments(sample))


@query("confidence_histogram", sql(f"""SELECT event_type, {R('min(confidence)', 6)} AS min_confidence, {R('max(confidence)', 6)} AS max_confidence, {R('avg(confidence)', 6)} AS mean_confidence, count(*) FILTER (WHERE confidence < 0.5) AS bin_below_050,
 count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.65) AS bin_050_065, count(*) FILTER (WHERE confidence >= 0.65 AND confidence < 0.75) AS bin_065_075, count(*) FILTER (WHERE confidence >= 0.75) AS bin_075_up FROM sem GROUP BY ALL""", "sem"))
def _(s):
    return out(evaluation.confidence_histogram(s.semantic_events), "event_type bin_below_050 bin_050_065 bin_065_075 bin_075_up", "min_confidence max_confidence mean_confidence")


STAGES = [f"s{i:02d}" for i in range(1, 8)]


def timed_runs(s: Inputs):
    return s.stage_runs.withColumn("video_seconds", (F.col("job_id") % 600 * 1.0).cast("double"))


@query("evaluation_matrix", sql("SELECT job_id, " + ", ".join(f"CAST(sum(duration_ms) FILTER (WHERE stage = '{k}') AS BIGINT) AS {k}_ms, max(frames) FILTER (WHERE stage = '{k}') AS {k}_frames" for k in STAGES)
                                + f", {R('sum(duration_ms) / 1000.0E0', 6)} AS processing_seconds, {R('CASE WHEN job_id % 600 > 0 THEN sum(duration_ms) / 1000.0E0 / (job_id % 600) END', 6)} AS real_time_factor, "
                                + R("max(frames) FILTER (WHERE stage = 's02') / (sum(duration_ms) / 1000.0E0)", 2) + " AS processing_fps FROM stage_runs GROUP BY job_id", "stage_runs"))
def _(s):
    return out(evaluation.evaluation_matrix(timed_runs(s), STAGES), "job_id processing_fps " + " ".join(f"{k}_ms {k}_frames" for k in STAGES), "processing_seconds real_time_factor")


# Reports -----------------------------------------------------------------------------------------
_FUNNEL = [("frames", "frames"), ("selected_frames", "frames_taken"), ("detections", "trk_det"), ("observations", "obs"), ("tracks", "tracks"), ("rule_events", "rule_events"),
           ("fused_events", "fev"), ("segments", "fev_seg0"), ("kept_segments", "fev_kept"), ("exported_events", "fev_out")]
view("fev_kept", "SELECT * FROM fev_pol WHERE keep", "fev_pol")
view("fev_out", "SELECT e.video_id FROM fev e SEMI JOIN fev_kept k USING (video_id, track_id)", "fev", "fev_kept")
view("frames_taken", "SELECT * FROM plain_adapt WHERE selected", "plain_adapt")


@query("stage_funnel", sql(" UNION ALL ".join(f"SELECT {i} AS step_no, '{n}' AS step, video_id, count(*) AS rows FROM {v} GROUP BY ALL" for i, (n, v) in enumerate(_FUNNEL)), *[v for _n, v in _FUNNEL]))
def _(s):
    kept, ranked, dec = decision_chain(s)
    chosen = dec.where("keep")
    return reports.stage_funnel({
        "frames": s.frames, "selected_frames": sampling.adaptive_skip(s.frame_sequence).where("selected"), "detections": tracker_detections(s), "observations": s.observations,
        "tracks": tracks_of(s), "rule_events": rule_events_of(s), "fused_events": kept, "segments": ranked, "kept_segments": chosen,
        "exported_events": kept.join(chosen.select("video_id", "track_id"), ["video_id", "track_id"], "left_semi")})


@query("real_time_factor", sql(f"""SELECT video_id, {R('ms / 1000.0E0', 4)} AS processing_seconds, {R('CASE WHEN duration_seconds > 0 THEN ms / 1000.0E0 / duration_seconds END', 6)} AS real_time_factor
 FROM videos LEFT JOIN (SELECT video_id, CAST(sum(duration_ms) AS DOUBLE) AS ms FROM stage_runs GROUP BY ALL) USING (video_id)""", "videos", "stage_runs"))
def _(s):
    d = reports.real_time_factor(s.stage_runs, s.videos)
    return d.select("video_id", rounded(F.col("processing_seconds"), 4).alias("processing_seconds"), rounded(F.col("real_time_factor"), 6).alias("real_time_factor"))


@query("trace_tracks", sql("""SELECT t.video_id, t.track_id, t.class_name, t.n_obs, coalesce(e.n, 0) AS events, coalesce(f.n, 0) AS fused_events, p.completeness, p.rank, p.keep, CASE WHEN NOT is_confirmed THEN 'not_confirmed' WHEN e.n IS NULL THEN 'no_events' WHEN f.n IS NULL THEN 'fusion_discarded'
  WHEN p.rank IS NULL THEN 'no_segment' WHEN NOT p.keep THEN 'discarded:' || reason ELSE 'exported' END AS first_break FROM tracks t LEFT JOIN (SELECT video_id, track_id, count(*) AS n FROM rule_events GROUP BY ALL) e USING (video_id, track_id)
 LEFT JOIN (SELECT video_id, track_id, count(*) AS n FROM fev GROUP BY ALL) f USING (video_id, track_id) LEFT JOIN fev_pol p USING (video_id, track_id)""", "tracks", "rule_events", "fev", "fev_pol"))
def _(s):
    kept, ranked, dec = decision_chain(s)
    d = reports.trace_tracks(tracks_of(s), rule_events_of(s), kept, s.stage("kept_segments", lambda: story.story_segments(kept)), ranked, dec)
    return d.select("video_id", "track_id", "class_name", "n_obs", "events", "fused_events", "completeness", "rank", "keep", "first_break")


@query("stage_averages", sql(f"SELECT stage, count(*) AS runs, {R('avg(duration_ms)', 4)} AS avg_ms FROM stage_runs WHERE status = 'completed' GROUP BY ALL", "stage_runs"))
def _(s):
    return out(reports.stage_averages(s.stage_runs), "stage runs", "avg_ms", 4)


_JOBS = "job_id, video_id, status, duration_ms, stage_no % 5 AS events, frames * 1000 AS size_bytes, created_at"
view("jobs", f"SELECT {_JOBS} FROM stage_runs", "stage_runs")


def jobs_of(s: Inputs):
    return s.stage_runs.selectExpr(*[c.strip() for c in _JOBS.split(",")])


@query("job_stats", sql(f"""SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS active, count(DISTINCT video_id) AS videos,
 {R("avg(duration_ms) FILTER (WHERE status = 'completed')", 4)} AS avg_duration_ms, CAST(sum(events) AS BIGINT) AS events, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM jobs""", "jobs"))
def _(s):
    return out(reports.job_stats(jobs_of(s)), "jobs completed failed active videos events bytes", "avg_duration_ms", 4)


@query("job_diagnostics", sql("SELECT job_id, " + ", ".join(f"max(status) FILTER (WHERE stage = '{k}') AS {k}_status, CAST(sum(duration_ms) FILTER (WHERE stage = '{k}') AS BIGINT) AS {k}_ms" for k in STAGES) + ", CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM stage_runs GROUP BY ALL", "stage_runs"))
def _(s):
    return reports.job_diagnostics(s.stage_runs, STAGES)


@query("latest_job", sql("SELECT video_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY status <> 'completed', created_at, job_id, status) AS r FROM jobs) WHERE r = 1", "jobs"))
def _(s):
    return reports.latest_job(jobs_of(s)).select("video_id", "job_id", "status")


def _inventory(s: Inputs):
    from framestory.operators import tracks
    return tracks.object_inventory(tracks_of(s))


@query("timeline", sql(f"""SELECT video_id, event_count, {', '.join(c + '_events' for c in ('activity', 'lighting', 'interaction', 'vehicle', 'other'))}, event_count - other_events AS meaningful_events, coalesce(unique_persons, 0) AS unique_persons, coalesce(object_classes, 0) AS object_classes FROM (
 SELECT video_id, count(*) AS event_count, {', '.join(f"count(*) FILTER (WHERE c = '{c}') AS {c}_events" for c in ('activity', 'lighting', 'interaction', 'vehicle', 'other'))} FROM (SELECT *, {_CATEGORY} AS c FROM (SELECT * REPLACE ({_VARIED} AS event_type) FROM sem)) GROUP BY ALL)
 LEFT JOIN (SELECT video_id, count(DISTINCT person_label) AS unique_persons FROM actors GROUP BY ALL) USING (video_id) LEFT JOIN (SELECT video_id, count(DISTINCT class_name) AS object_classes FROM tracks WHERE is_confirmed AND n_obs >= 3 AND (class_name = 'person' OR (avg_confidence >= 0.35 AND max_confidence >= 0.45)) GROUP BY ALL) USING (video_id)""", "sem", "actors", "tracks"))
def _(s):
    return reports.timeline(varied_events(s), named_events(s), _inventory(s))


@query("timeline_events", sql(f"SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'note ' || event_id ELSE event_type END AS display_name, {_CATEGORY} AS category, coalesce(direction, 'top') AS shown_direction FROM actors", "actors"))
def _(s):
    d = named_events(s).selectExpr("*", "CASE WHEN event_id % 6 = 0 THEN concat('note ', event_id) END AS description", "'top' AS entry_direction")
    return reports.timeline_events(d).select("event_id", "display_name", "category", "shown_direction")


_MAN = "video_id % 3 = 0"


@query("video_summary", sql(f"""SELECT v.video_id, {R('coalesce(CASE WHEN v.video_id % 3 = 0 THEN (v.video_id % 100) / 100.0E0 END, stage_ratio, CASE WHEN duration_seconds > 0 THEN retained_ms / 1000.0E0 / duration_seconds END)', 6)} AS compression_ratio, CASE WHEN v.video_id % 3 = 0 THEN v.video_id % 17 END AS clip_count, coalesce(n, 0) AS story_count
 FROM videos v LEFT JOIN (SELECT video_id, min_by(CASE WHEN frames > 25 THEN ratio END, (stage_no, job_id)) FILTER (WHERE frames > 25) AS stage_ratio, sum(duration_ms) AS retained_ms FROM stage_runs GROUP BY ALL) s USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM sem_seg0 GROUP BY ALL) g USING (video_id)""", "videos", "stage_runs", "sem_seg0"))
def _(s):
    man = s.videos.selectExpr("video_id", f"CASE WHEN {_MAN} THEN (video_id % 100) / 100.0D END AS manifest_ratio", f"CASE WHEN {_MAN} THEN video_id % 17 END AS clip_count")
    runs_ = s.stage_runs.selectExpr("video_id", "job_id", "stage_no", "CASE WHEN frames > 25 THEN ratio END AS stage_ratio", "duration_ms AS retained_ms")
    return out(reports.video_summary(s.videos, man, runs_, s.stage("segments", lambda: story.story_segments(s.semantic_events))), "video_id clip_count story_count", "compression_ratio")


@query("evidence", sql("""SELECT event_id, event_type AS what, format('{:02d}:{:02d}.{:03d}', CAST(floor(start_ms) AS BIGINT) // 60000, CAST(floor(start_ms) AS BIGINT) // 1000 % 60, CAST(floor(start_ms) AS BIGINT) % 1000) AS start_text, person_label, confidence AS overall, 'rule' AS rule_name FROM actors""", "actors"))
def _(s):
    d = reports.evidence(named_events(s).selectExpr("*", "'rule' AS rule_name", "event_type AS description"))
    return d.select("event_id", "what", "when.start_text", "track.person_label", "confidence.overall", "why.rule_name")


@query("list_events", sql(f"SELECT event_id, start_ms, event_type FROM sem WHERE video_id = 0 ORDER BY {_ORD} LIMIT 50 OFFSET 20", "sem"))
def _(s):
    return reports.list_events(s.semantic_events, 0, 50, 20).select("event_id", "start_ms", "event_type")


@query("event_facets", sql("SELECT video_id, 'person' AS facet, person_label AS value, count(*) AS events FROM actors WHERE person_label IS NOT NULL GROUP BY ALL UNION ALL SELECT video_id, 'type', event_type, count(*) FROM actors GROUP BY ALL", "actors"))
def _(s):
    return reports.event_facets(named_events(s))


@query("search_inventory", sql("SELECT video_id, class_name, count(*) AS instance_count FROM tracks WHERE class_name = 'backpack' AND is_confirmed AND n_obs >= 3 AND avg_confidence >= 0.35 AND max_confidence >= 0.45 GROUP BY ALL", "tracks"))
def _(s):
    return reports.search_inventory(_inventory(s), "PACK", "bag").select("video_id", "class_name", "instance_count")


_TITLE = "list_reduce(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b)"


@query("milestones", sql(f"""SELECT video_id, i AS position, format('{{:02d}}:{{:04.1f}}', CAST(start_ms AS BIGINT) // 60000, (CAST(start_ms AS BIGINT) % 60000) / 1000.0E0) AS time, {_TITLE} AS event, coalesce(person_label, 'Scene Entity') AS actor FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_ORD}) AS i FROM actors) WHERE i <= 15""", "actors"))
def _(s):
    return reports.milestones(named_events(s))


@query("executive_brief", sql(f"""SELECT v.video_id, coalesce(n, 0) AS events, CASE WHEN n > 0 THEN n || ' events, ' || coalesce(p, 0) || ' persons, ' || coalesce(o, 0) || ' kinds of objects. First: ' || fa || ', ' || fn || ', at ' || format('{{:.1f}}', fs / 1000.0E0) || ' s. '
  || CASE WHEN n > 1 THEN 'Last: ' || la || ', ' || ln || ', at ' || format('{{:.1f}}', ls / 1000.0E0) || ' s. ' ELSE '' END || 'Length of the footage: ' || format('{{:.1f}}', (v.video_id * 7919 % 9000000) / 10.0E0) || ' s.'
  ELSE 'No event was kept for this footage.' END AS narrative FROM videos v LEFT JOIN (
 SELECT video_id, count(*) AS n, min_by(start_ms, i) AS fs, max_by(start_ms, i) AS ls, min_by(replace(event_type, '_', ' '), i) AS fn, max_by(replace(event_type, '_', ' '), i) AS ln, min_by(coalesce(person_label, 'Entity'), i) AS fa, max_by(coalesce(person_label, 'Entity'), i) AS la
 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_ORD}) AS i FROM actors) GROUP BY ALL) e USING (video_id) LEFT JOIN (SELECT video_id, count(DISTINCT person_label) AS p FROM actors GROUP BY ALL) q USING (video_id) LEFT JOIN (
 SELECT video_id, count(DISTINCT class_name) AS o FROM tracks WHERE is_confirmed AND n_obs >= 3 AND (class_name = 'person' OR (avg_confidence >= 0.35 AND max_confidence >= 0.45)) GROUP BY ALL) w USING (video_id)""", "videos", "actors", "tracks"))
def _(s):
    v = s.videos.selectExpr("video_id", "(video_id * 7919 % 9000000) / 10.0D AS duration_seconds")
    return reports.executive_brief(named_events(s), named_events(s), _inventory(s), v)


@query("clip_specs", sql(f"""SELECT video_id, i AS clip_index, event_id, {R('greatest(0.0E0, (start_ms - 500) / 1000.0E0)', 4)} AS clip_start_s, {R('(end_ms + 500) / 1000.0E0', 4)} AS clip_end_s, {R('end_ms - start_ms', 4)} AS duration_ms,
 'clip_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '_' || event_type || '.mp4' AS clip_name FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_ORD}) AS i FROM sem)""", "sem"))
def _(s):
    return out(reports.clip_specs(s.semantic_events), "video_id clip_index event_id clip_name", "clip_start_s clip_end_s duration_ms", 4)


view("evf", "SELECT video_id, event_id, CAST(floor(start_ms / 6000) AS BIGINT) AS ef FROM sem", "sem")


@query("nearest_frames", sql("""SELECT e.video_id, e.event_id, e.frame_number AS event_frame, b.frame_number AS before_frame, a.frame_number AS after_frame FROM (SELECT v.video_id, v.event_id, f.frame_number, f.seq, m, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(f.frame_number - v.ef), f.frame_number) AS r
  FROM evf v JOIN fseq f ON f.video_id = v.video_id AND abs(f.frame_number - v.ef) <= 200000 JOIN (SELECT video_id, max(seq) AS m FROM fseq GROUP BY ALL) x ON x.video_id = v.video_id) e JOIN fseq b ON b.video_id = e.video_id AND b.seq = greatest(e.seq - 5, 0) JOIN fseq a ON a.video_id = e.video_id AND a.seq = least(e.seq + 5, m) WHERE r = 1""", "evf", "fseq"))
def _(s):
    e = s.semantic_events.select("video_id", "event_id", F.floor(F.col("start_ms") / 6000).cast("long").alias("frame_number"))
    return reports.nearest_frames(e, s.frame_sequence.select("video_id", "frame_number", "seq"))


# Files ------------------------------------------------------------------------------------------------
@query("read_detections", sql("SELECT video_id, frame_number, class_name, round(confidence, 6) AS confidence, x1, y1, x2, y2 FROM obs", "obs"))
def _(s):
    d = s.observations.groupBy("video_id", "frame_number", "timestamp_ms").agg(F.collect_list(F.struct(
        F.lit(0).alias("class_id"), "class_name", "confidence", F.col("x1").alias("bbox_x1"), F.col("y1").alias("bbox_y1"), F.col("x2").alias("bbox_x2"), F.col("y2").alias("bbox_y2"))).alias("detections"))
    path = work_folder(s.spark, "detections")
    d.write.json(path)
    return files.read_detections(s.spark, path).select("video_id", "frame_number", "class_name", "confidence", "x1", "y1", "x2", "y2")


_NAMES = "CASE WHEN video_id % 2 = 0 THEN 'out/frame_' || lpad(CAST({n} AS {t}), 8, '0') || '.jpg' ELSE 'out/frame_' || lpad(CAST({q} + 1 AS {t}), 8, '0') || '.jpg' END"


@query("frame_number_from_path", sql("""SELECT video_id, frame_path, CASE WHEN video_id % 2 = 0 THEN frame_number ELSE seq * 5 END AS frame_number, least(CASE WHEN video_id % 2 = 0 THEN frame_number ELSE seq * 5 END * 40.0E0, 300000.0E0) AS timestamp_ms FROM (
 SELECT video_id, frame_number, seq, """ + _NAMES.format(n="frame_number", q="seq", t="VARCHAR") + " AS frame_path FROM fseq)", "fseq"))
def _(s):
    d = s.frame_sequence.select("video_id", F.expr(_NAMES.format(n="frame_number", q="seq", t="STRING")).alias("frame_path"))
    return files.frame_number_from_path(d, duration_ms=F.lit(300000.0)).select("video_id", "frame_path", "frame_number", "timestamp_ms")


@query("stage_metrics_files", sql("SELECT job_id, stage, status, duration_ms, CAST(frames AS VARCHAR) AS frames FROM stage_runs", "stage_runs"))
def _(s):
    d = s.stage_runs.select("job_id", "stage", "status", "duration_ms", F.create_map(F.lit("frames"), F.col("frames").cast("string")).alias("metrics"),
                            F.array().cast("array<string>").alias("warnings"), F.array().cast("array<string>").alias("errors"))
    path = work_folder(s.spark, "metrics")
    files.write_stage_metrics(d, path)
    return files.read_stage_metrics(s.spark, path).select("job_id", "stage", "status", "duration_ms", F.col("metrics")["frames"].alias("frames"))


@query("write_events", sql("SELECT video_id, event_id, event_type FROM sem WHERE video_id <> 4 AND (video_id <> 3 OR event_id % 2 = 0)", "sem"))
def _(s):
    path = work_folder(s.spark, "events")
    files.write_events(s.semantic_events, path)
    files.reprocess_video(s.semantic_events.where("event_id % 2 = 0"), path, 3)
    files.reprocess_video(s.semantic_events.where("false"), path, 4)
    return files.read_events(s.spark, path).select("video_id", "event_id", "event_type")


@query("events_from_manifest", sql("""SELECT video_id, CAST(event_id AS VARCHAR) AS event_id, event_type, confidence, 'Verified event: ' || replace(event_type, '_', ' ') AS description, CASE WHEN track_id % 2 = 0 THEN 'left' ELSE 'right' END AS direction, CASE WHEN track_id > 0 THEN 'Person ' || track_id END AS person_label
 FROM sem JOIN sem_pol USING (video_id, track_id) WHERE keep""", "sem", "sem_pol"))
def _(s):
    r = ranked_semantic(s)
    dec = s.stage("decisions", lambda: compression.compression_policy(r))
    clips = reports.clip_specs(compression.summary_events(s.semantic_events, dec))
    path = work_folder(s.spark, "manifest")
    files.export_manifest(path, compression.compression_metrics(dec), dec.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments")), dec, clips)
    return files.events_from_manifest(s.spark, path).select("video_id", "event_id", "event_type", "confidence", "description", "direction", "person_label")


@query("export_manifest", sql("""SELECT 'summary' AS section, video_id, count(DISTINCT video_id) AS entries FROM sem_pol GROUP BY ALL UNION ALL SELECT 'validation', video_id, 1 FROM sem_pol WHERE keep GROUP BY ALL
 UNION ALL SELECT 'decisions', video_id, count(*) FROM sem_pol GROUP BY ALL UNION ALL SELECT 'clips', video_id, count(*) FROM sem JOIN sem_pol USING (video_id, track_id) WHERE keep GROUP BY ALL""", "sem", "sem_pol"))
def _(s):
    """Entries per section and video of a manifest that is written twice and read back."""
    r, ev = ranked_semantic(s), s.semantic_events
    dec = s.stage("decisions", lambda: compression.compression_policy(r))
    kept = compression.summary_events(ev, dec)
    chains, seg = dec.where("keep").select("video_id", "track_id"), s.stage("segments", lambda: story.story_segments(ev))
    report = validation.validation_report(validation.validate_narrative(seg, ev, chains, kept.select("video_id", "event_id")), chains, seg)
    sections = [cut_lineage(d) for d in (compression.compression_metrics(dec), report, compression.decision_manifest(r, dec), reports.clip_specs(kept))]
    path = work_folder(s.spark, "manifest")
    for _ in range(2):
        files.export_manifest(path, *sections)
    return s.spark.read.schema("section string, video_id long").json(path).groupBy("section", "video_id").agg(F.count(F.lit(1)).alias("entries"))


@query("export_evaluation_json", sql("SELECT label, count(*) AS total_items, count(*) FILTER (WHERE c_scene > 0) AS nonzero_items FROM items GROUP BY ALL", "items"))
def _(s):
    path = work_folder(s.spark, "json")
    files.export_evaluation_json(evaluation.distribution_by_category(stair_items(s), "label", "c_scene").select("label", "total_items", "nonzero_items"), path)
    return s.spark.read.schema("label string, total_items long, nonzero_items long").json(path)


@query("read_ground_truth", sql("SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(truth_id AS VARCHAR) AS event_id, event_type, round_even(truth_start, 4) AS start_s, round_even(truth_end, 4) AS end_s, truth_id % 7 = 0 AS is_irrelevant FROM truth", "truth"))
def _(s):
    """Truth documents of an hour each are written as nested JSON and read back, one row per event."""
    name = F.col("truth_id").cast("string")
    docs = s.truth_events.withColumn("_hour", F.floor(F.col("truth_start") / 3_600_000.0)).groupBy(F.col("video_id").cast("string").alias("video_id"), "_hour").agg(
        F.collect_list(F.struct(name.alias("event_id"), F.col("event_type").alias("type"), F.col("truth_start").alias("start"), F.col("truth_end").alias("end"),
                                F.array().cast("array<string>").alias("entities"))).alias("events"),
        F.array(F.collect_list(name)).alias("narrative_chains"), F.collect_list(F.when(F.col("truth_id") % 7 == 0, name)).alias("irrelevant_events"))
    path = work_folder(s.spark, "truth")
    docs.drop("_hour").write.json(path)
    ev, _chains = files.read_ground_truth(s.spark, path, multi_line=False)
    return ev.select("video_id", "event_id", "event_type", rounded(F.col("start_s"), 4).alias("start_s"), rounded(F.col("end_s"), 4).alias("end_s"), "is_irrelevant")


@query("export_evaluation_csv", sql("SELECT CAST(label AS VARCHAR) AS label, CAST(total_items AS VARCHAR) AS \"counts.total\", CAST(nonzero_items AS VARCHAR) AS \"counts.nonzero\", label || ';x' AS tags FROM (SELECT label, count(*) AS total_items, count(*) FILTER (WHERE c_scene > 0) AS nonzero_items FROM items GROUP BY ALL)", "items"))
def _(s):
    d = evaluation.distribution_by_category(stair_items(s), "label", "c_scene").select(
        "label", F.struct(F.col("total_items").alias("total"), F.col("nonzero_items").alias("nonzero")).alias("counts"), F.array("label", F.lit("x")).alias("tags"))
    path = work_folder(s.spark, "csv")
    files.export_evaluation_csv(d, path)
    return s.spark.read.option("header", True).csv(path)


# Streams ------------------------------------------------------------------------------------------------
@query("stream_event_windows", """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round_even(round_even(sum(value) * 1e10, 0) / 1e10 * 1e4, 0) / 1e4 AS total FROM events
 WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '5 seconds' GROUP BY ALL""")
def _(s):
    """Hourly counts of the event stream; windows the watermark has not passed stay open."""
    st = run.table_stream(s.spark, s.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "5 seconds")
    d = st.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return run.run_to_table(d.select(F.col("window.start").alias("window_start"), "event_type", "n", rounded(F.col("total"), 4).alias("total")))


@query("stream_adaptive_skip", sql("SELECT video_id, frame_number, smoothed_skip, protected, selected FROM plain_adapt", "plain_adapt"))
def _(s):
    f = s.frame_sequence.select("video_id", "seq", "frame_number", "motion_fraction")
    st = run.replay(f, "frame_number", ["video_id"])
    return run.run_to_table(stream_fold(st, ["video_id"], "seq", steps.skip_stream_step(), steps.SKIP_STREAM_OUT))


@query("stream_zone_crossings", sql("SELECT video_id, track_id, zone_id, frame_number, event_type, direction, cold_start FROM zx", "zx"))
def _(s):
    key = ["video_id", "track_id", "zone_id"]
    flags = zones.inside_zones(run.replay(s.observations, "frame_number", ["video_id", "track_id"]), zones_of(s))
    return run.run_to_table(stream_fold(flags.select(*key, "seq", "frame_number", "zone_type", "inside"), key, "seq", steps.zone_stream_step, steps.ZONE_STREAM_OUT))


STREAMED_ACTIVITY = sql("""SELECT video_id, track_id, event_type, frame_number, frame_number * 40.0E0 AS timestamp_ms, confidence FROM mwalk2 WHERE event_type IS NOT NULL
 UNION ALL SELECT video_id, track_id, 'person_left_scene', frame_number, timestamp_ms, CASE WHEN edge THEN 0.9E0 ELSE 0.75E0 END FROM mach WHERE seq = last_seq AND last_seq >= 1""", "mwalk2", "mach")


@query("stream_activity_machine", STREAMED_ACTIVITY)
def _(s):
    """Activities of a stream of raw positions; tracks close, and their persons leave, when the watermark has passed their idle time."""
    key = ["video_id", "track_id"]
    m = posture.machine_inputs(s.observations, seats_of(s)).select(*key, "seq", "frame_number", "timestamp_ms", "cx", "cy", "near_seat")
    st = run.replay(run.timed(m), "frame_number", key, ends=True)
    return run.run_to_table(stream_fold(st, key, "seq", steps.machine_stream_step(), posture.MACHINE_OUT, "event_time", run.IDLE_MS))


@query("stream_activity_resumed", STREAMED_ACTIVITY)
def _(s):
    """A batch fold over the first half of the rows hands its states to a stream of the others."""
    key = ["video_id", "track_id"]
    m = run.timed(posture.machine_inputs(s.observations, seats_of(s)).select(*key, "seq", *posture.MACHINE_COLUMNS))
    m = cut_lineage(m)
    cut = m.agg(F.percentile_approx("frame_number", 0.5)).first()[0] or 0
    before, after = m.where(F.col("frame_number") < cut), m.where(F.col("frame_number") >= cut)
    done = ordered_fold(before, key, posture.activity_machine, posture.MACHINE_OUT, close=False)
    states = fold_states(before, key, posture.activity_machine, event_time="event_time")
    st = run.replay(after, "frame_number", key, ends=True)
    rest = run.run_to_table(stream_fold(st, key, "seq", posture.activity_machine, posture.MACHINE_OUT, "event_time", run.IDLE_MS, initial=cut_lineage(states)))
    return done.unionByName(rest)


@query("stream_temporal_pose", ORACLES["temporal_pose_fsm"])
def _(s):
    """Sustained poses of a stream of raw boxes, open ones included when their track closes."""
    key = ["video_id", "track_id"]
    d = run.timed(squashed(s).withColumn("pose_confidence", F.lit(0.5))).select(
        *key, "seq", "frame_number", "timestamp_ms", "x1", "y1", "x2", "y2", "pose_confidence", "event_time")
    st = run.replay(d, "frame_number", key, ends=True)
    got = run.run_to_table(stream_fold(st, key, "seq", steps.pose_stream_step(), posture.POSE_OUT, "event_time", run.IDLE_MS))
    return out(got, "video_id track_id event_type start_frame end_frame supporting start_ms end_ms", "confidence", 3)


@query("stream_tracker")
def _(s):
    """The tracker's log of a stream of frames; what is open when a video closes is closed."""
    d = tracker_detections(s)
    r = run.timed(d.join(tracking.frame_ranks(d), ["video_id", "frame_number"]).withColumn("ms", F.col("frame_number") * 40.0), "ms").drop("ms")
    st = run.replay(r, "frame_number", ["video_id"], ends=True)
    return run.run_to_table(stream_fold(st, ["video_id"], "frame_rank", tracking.lifecycle_step(), tracking.LIFECYCLE_OUT, "event_time", run.IDLE_MS))


@query("stream_dedup", sql("SELECT event_id FROM dd_walk WHERE kept", "dd_walk"))
def _(s):
    e = s.semantic_events.select("video_id", "event_type", "event_id", "start_ms", (F.col("start_ms") * 1e6 + F.col("event_id")).alias("place"))
    st = run.replay(e, "place", ["video_id", "event_type"])
    kept = run.run_to_table(stream_fold(st, ["video_id", "event_type"], "place", scenes.spaced_step("start_ms", 120_000.0, "event_id", strict=True),
                                        "event_id long, kept boolean"))
    return kept.where("kept").select("event_id")


@query("read_frame_features", sql("SELECT video_id, frame_number, brightness, motion_fraction, blur_score, pixel_diff FROM frames", "frames"))
def _(s):
    path = work_folder(s.spark, "frames")
    s.frames.withColumn("frame_path", F.lit(None).cast("string")).write.parquet(path)
    return files.read_frame_features(s.spark, path).select("video_id", "frame_number", "brightness", "motion_fraction", "blur_score", "pixel_diff")


@query("read_zones", sql("SELECT v.video_id, z.zone_id, z.zone_name, z.zone_type, len(z.polygon) AS corners FROM (SELECT DISTINCT video_id FROM obs) v, zones z", "obs", "zones"))
def _(s):
    path = work_folder(s.spark, "zones")
    z = zones_of(s).select("video_id", "zone_id", F.col("zone_name").alias("name"), F.upper("zone_type").alias("zone_type"), F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("polygon"))
    z.write.json(path)
    return files.read_zones(s.spark, path, multi_line=False).select("video_id", "zone_id", "zone_name", "zone_type", F.size("polygon").alias("corners"))


@query("stream_lighting", sql(f"SELECT {outs(LIGHT)} FROM light10_raw", "light10_raw"))
def _(s):
    """Light switches of a stream of raw brightness; smoothing and baselines are part of the state."""
    b = run.timed(s.frame_sequence.select("video_id", "seq", "frame_number", "timestamp_ms", "brightness"))
    st = run.replay(b, "frame_number", ["video_id"], ends=True)
    got = run.run_to_table(stream_fold(st, ["video_id"], "seq", steps.lighting_stream_step(), quality.LIGHT_OUT, "event_time", run.IDLE_MS))
    return got.withColumn("confidence", rounded(F.col("confidence"), 4)).select(*LIGHT.split())


@query("stream_late_rows", sql("SELECT video_id, CAST(seq AS DOUBLE) AS late_position FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS seq FROM frames) WHERE seq % 50 = 7", "frames"))
def _(s):
    """Frames that arrive behind later ones of their video come out as late rows."""
    f = s.frame_sequence.select("video_id", "seq", "frame_number", "motion_fraction")
    end = f.groupBy("video_id").agg(F.max_by(F.struct("seq", "frame_number", "motion_fraction"), "seq").alias("r")).select("video_id", "r.*")
    on_time = f.where("seq % 50 <> 7").unionByName(end.withColumn("seq", F.col("seq") + 1))
    st = run.replay(on_time, "frame_number", ["video_id"], behind=f.where("seq % 50 = 7"))
    got = run.run_to_table(stream_fold(st, ["video_id"], "seq", steps.skip_stream_step(), steps.SKIP_STREAM_OUT, late=True))
    return got.where("late_position IS NOT NULL").select("video_id", "late_position")


@query("stream_posture", sql("SELECT video_id, track_id, event_type, ev_start AS start_frame, end_frame, ev_start * 40.0E0 AS start_ms, end_frame * 40.0E0 AS end_ms, confidence, sitting_ms FROM post WHERE event_type IS NOT NULL", "post"))
def _(s):
    """Transitions of a stream whose rows meet the tracks' known baselines."""
    d = posture.with_baseline(s.observations)
    st = stream_fold(run.replay(d, "frame_number", ["video_id", "track_id"]), ["video_id", "track_id"], "seq", posture.posture_machine(0.99), posture.POSTURE_OUT)
    return run.run_to_table(st.withColumn("confidence", rounded(F.col("confidence"), 4)))


@query("stream_reid")
def _(s):
    """Person labels for tracks arriving in order of their start."""
    t = s.track_embeddings.select("video_id", "track_id", "start_ms", "embedding")
    return run.run_to_table(stream_fold(run.replay(t, "start_ms", ["video_id"]), ["video_id"], "start_ms", identity.assign_step(0.45), identity.ASSIGN_OUT))
