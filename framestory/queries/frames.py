"""Sampling, quality, brightness and scene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestory import fixed
from framestory.operators import quality, sampling, scenes
from framestory.queries.registry import query
from framestory.queries.shape import out, outs
from framestory.queries.sqlviews import IN, R, sql, view
from framestory.sources.fixtures import Inputs

# Ingest ---------------------------------------------------------------------------------
_EXT = "lower(regexp_extract(filename, '(\\.[^.]*)$', 1))"


@query("validate_video_rows", sql(f"""SELECT video_id, errors, warnings, errors = '' AS is_valid FROM (
 SELECT video_id, CASE WHEN early <> '' THEN early ELSE late END AS errors, CASE WHEN early <> '' THEN '' ELSE warn END AS warnings FROM (
  SELECT video_id, CASE WHEN size_bytes = 0 THEN 'file is empty' ELSE concat_ws(';', CASE WHEN {_EXT} NOT IN {IN(fixed.VIDEO_EXTENSIONS)} THEN 'unsupported extension ' || {_EXT} END,
    CASE WHEN size_bytes > {fixed.MAX_FILE_BYTES} THEN 'file too large' END) END AS early,
   concat_ws(';', CASE WHEN duration_seconds <= 0 THEN 'zero or unknown duration' END, CASE WHEN width < 64 OR height < 64 THEN 'resolution below 64x64' END, CASE WHEN fps <= 0 THEN 'invalid fps' END) AS late,
   concat_ws(';', CASE WHEN lower(codec) NOT IN {IN(fixed.VIDEO_CODECS)} THEN 'unknown codec ' || lower(codec) END, CASE WHEN fps > 240 THEN 'very high fps' END) AS warn FROM videos))""", "videos"))
def _(s):
    return sampling.validate_video_rows(s.videos).select(
        "video_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "is_valid")


@query("processing_profile", sql("""SELECT video_id, processing_profile, coalesce(frame_skip_setting, CASE processing_profile WHEN 'QUICK_TEST' THEN 2 WHEN 'SHORT' THEN 3 WHEN 'STANDARD' THEN 5 WHEN 'LONG' THEN 10 ELSE 15 END) AS frame_skip,
 CASE WHEN frame_skip_setting IS NOT NULL THEN 'settings' ELSE 'profile:' || processing_profile END AS skip_source FROM (SELECT *, CASE WHEN duration_seconds <= 30 THEN 'QUICK_TEST' WHEN duration_seconds <= 300 THEN 'SHORT'
  WHEN duration_seconds <= 600 THEN 'STANDARD' WHEN duration_seconds <= 3600 THEN 'LONG' ELSE 'EXTENDED' END AS processing_profile FROM videos)""", "videos"))
def _(s):
    return sampling.processing_profile(s.videos).select("video_id", "processing_profile", "frame_skip", "skip_source")


_BANDS = [(n, lo, hi, e, (fixed.DURATION_BANDS[i + 1][3] or e * 2)) for i, (n, lo, hi, e) in enumerate(fixed.DURATION_BANDS[:-1])]


@query("duration_profile", sql(f"""SELECT video_id, coalesce(name, 'Custom') AS profile, CAST(floor(est + (duration_seconds - lo) / greatest(1.0E0, hi - lo) * (nxt - est)) AS BIGINT) AS estimated_processing_s,
  frames AS estimated_frames, greatest(CAST(floor(frames / 5) AS BIGINT), 1) AS estimated_keyframes,
  format('{{:02d}}:{{:02d}}:{{:02d}}', d // 3600, d % 3600 // 60, d % 60) AS duration_hms FROM (SELECT *, CAST(floor(duration_seconds) AS BIGINT) AS d, greatest(CAST(floor(floor(duration_seconds * fps) / 5) AS BIGINT), 1) AS frames FROM videos) v
 LEFT JOIN (VALUES {", ".join(f"('{n}', {lo}E0, {hi}E0, {e}E0, {x}E0)" for n, lo, hi, e, x in _BANDS)}) b(name, lo, hi, est, nxt) ON duration_seconds >= lo AND duration_seconds < hi""", "videos"))
def _(s):
    return sampling.duration_profile(s.videos).select("video_id", "profile", "estimated_processing_s", "estimated_frames", "estimated_keyframes", "duration_hms")


@query("fixed_stride_sample", sql("SELECT video_id, frame_number FROM fseq WHERE seq % 5 = 0", "fseq"))
def _(s):
    return sampling.fixed_stride_sample(s.frame_sequence, 5).select("video_id", "frame_number")


_TIER = """CASE WHEN seq < 25 THEN 'MEDIUM_MOTION' WHEN motion_fraction < 0.005 THEN 'STATIC' WHEN motion_fraction < 0.020 THEN 'LOW_MOTION' WHEN motion_fraction < 0.08 THEN 'MEDIUM_MOTION' ELSE 'HIGH_MOTION' END"""
_SKIP = """CASE WHEN seq < 25 THEN 3 WHEN motion_fraction < 0.005 THEN 10 WHEN motion_fraction < 0.020 THEN 6 WHEN motion_fraction < 0.08 THEN 3 ELSE 1 END"""


@query("motion_tier", sql(f"SELECT video_id, frame_number, {_TIER} AS motion_tier, {_SKIP} AS raw_skip FROM fseq", "fseq"))
def _(s):
    t, k = sampling.motion_tier()
    return s.frame_sequence.select("video_id", "frame_number", t.alias("motion_tier"), k.alias("raw_skip"))


def _adaptive_views(prefix: str, trigger: str) -> None:
    """Sequential SQL twin of adaptive selection; the walk keeps the protection countdown itself."""
    view(f"{prefix}_trig", f"SELECT *, {trigger} AS ext FROM fseq", "fseq")
    # With an external signal the countdown is set before the frame is scored; warm-up frames do not consume it.
    a = "(CASE WHEN f.ext THEN 15 ELSE w.remaining END)"
    b = f"(CASE WHEN f.seq >= 25 AND f.motion_fraction >= 0.08 THEN 15 ELSE {a} END)"
    prot = f"(f.seq >= 25 AND {b} > 0)"
    ema = f"(CASE WHEN f.seq < 25 OR {prot} THEN w.ema ELSE 0.25E0 * ({_SKIP.replace('seq', 'f.seq').replace('motion_fraction', 'f.motion_fraction')}) + 0.75E0 * w.ema END)"
    skip = f"(CASE WHEN f.seq < 25 THEN 3 WHEN {prot} THEN 1 ELSE greatest(1, least(15, CAST(round_even({ema}, 0) AS BIGINT))) END)"
    view(f"{prefix}_walk", f"""SELECT DISTINCT video_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS frame_number, 3.0E0 AS ema, CAST(0 AS BIGINT) AS counter, CAST(0 AS BIGINT) AS remaining,
       false AS protected, false AS new_window, CAST(NULL AS BIGINT) AS smoothed_skip, false AS selected FROM {prefix}_trig
      UNION ALL SELECT f.video_id, f.seq, f.frame_number, {ema}, greatest(0, (CASE WHEN w.counter = 0 THEN {skip} ELSE w.counter END) - 1),
       CASE WHEN {prot} THEN {b} - 1 ELSE {b} END, {prot}, w.remaining = 0 AND {b} > 0, {skip}, w.counter = 0
      FROM {prefix}_walk w JOIN {prefix}_trig f ON f.video_id = w.video_id AND f.seq = w.seq + 1""", f"{prefix}_trig")
    view(f"{prefix}_adapt", f"""SELECT w.video_id, w.frame_number, w.seq, f.motion_fraction, CASE WHEN w.protected THEN 'PROTECTED' ELSE {_TIER.replace('seq', 'f.seq')} END AS motion_tier,
       CASE WHEN w.protected THEN 1 ELSE {_SKIP.replace('seq', 'f.seq')} END AS raw_skip, smoothed_skip, w.protected, w.new_window,
       CASE WHEN w.protected THEN CASE WHEN f.motion_fraction >= 0.08 THEN 'motion_spike' ELSE 'window' END END AS protection_reason, w.selected
      FROM {prefix}_walk w JOIN {prefix}_trig f ON f.video_id = w.video_id AND f.seq = w.seq""", f"{prefix}_walk", f"{prefix}_trig")


_adaptive_views("plain", "false")
_adaptive_views("ext", "seq % 61 = 17")
ADAPT = "video_id frame_number motion_tier raw_skip smoothed_skip protected protection_reason selected"


def adaptive_of(s: Inputs):
    return s.stage("adaptive", lambda: sampling.adaptive_skip(s.frame_sequence))


@query("adaptive_skip", sql("SELECT " + outs(ADAPT + " new_window") + " FROM plain_adapt", "plain_adapt"))
def _(s):
    return adaptive_of(s).select(*ADAPT.split(), "new_window")


def signals_of(s: Inputs):
    """External signals derived from the frames: every 61st frame of a video."""
    return s.frame_sequence.where("seq % 61 = 17").selectExpr(
        "video_id", "frame_number", "seq % 2 = 0 AS roi_proximity", "seq % 3 = 0 AS track_count_changed", "true AS brightness_change")


@query("adaptive_skip_with_triggers", sql("SELECT " + outs(ADAPT) + " FROM ext_adapt", "ext_adapt"))
def _(s):
    return sampling.adaptive_skip(s.frame_sequence, signals=signals_of(s)).select(*ADAPT.split())


@query("protection_triggers", sql("""SELECT video_id, reason, count(*) AS triggers FROM (SELECT video_id, 'roi_proximity' AS reason FROM fseq WHERE seq % 61 = 17 AND seq % 2 = 0
 UNION ALL SELECT video_id, 'new_track_appeared' FROM fseq WHERE seq % 61 = 17 AND seq % 3 = 0 UNION ALL SELECT video_id, 'brightness_spike' FROM fseq WHERE seq % 61 = 17) GROUP BY ALL""", "fseq"))
def _(s):
    return sampling.trigger_counts(sampling.protection_triggers(signals_of(s)))


_TIERS = sampling.TIERS


@query("skip_stats", sql("SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE selected) AS selected_frames, count(*) FILTER (WHERE NOT selected) AS skipped_frames, min(smoothed_skip) AS min_skip, max(smoothed_skip) AS max_skip, "
                         "count(*) FILTER (WHERE new_window) AS protected_windows, count(*) FILTER (WHERE protected) AS protected_frames, "
                         + ", ".join(f"count(*) FILTER (WHERE motion_tier = '{t}') AS tier_{t.lower()}" for t in _TIERS)
                         + f", {R('count(*) FILTER (WHERE selected) / count(*)', 6)} AS sampling_ratio, {R('avg(motion_fraction)', 6)} AS avg_motion, {R('max(motion_fraction)', 6)} AS max_motion, {R('avg(smoothed_skip)', 6)} AS avg_skip FROM plain_adapt GROUP BY ALL", "plain_adapt"))
def _(s):
    return out(sampling.skip_stats(adaptive_of(s)), "video_id frames selected_frames skipped_frames min_skip max_skip protected_windows protected_frames "
               + " ".join("tier_" + t.lower() for t in _TIERS), "sampling_ratio avg_motion max_motion avg_skip")


@query("sampling_strategy_compare", sql(" UNION ALL ".join(f"""SELECT video_id, '{n}' AS strategy, count(*) AS frames, count(*) FILTER (WHERE {c}) AS selected_frames, count(*) FILTER (WHERE seq BETWEEN 50 AND 75) AS burst_frames,
  count(*) FILTER (WHERE {c} AND seq BETWEEN 50 AND 75) AS burst_selected, {R(f"count(*) FILTER (WHERE {c}) / count(*)", 6)} AS ratio,
  {R(f"CASE WHEN count(*) FILTER (WHERE seq BETWEEN 50 AND 75) > 0 THEN count(*) FILTER (WHERE {c} AND seq BETWEEN 50 AND 75) / count(*) FILTER (WHERE seq BETWEEN 50 AND 75) ELSE 0.0E0 END", 6)} AS burst_retention FROM plain_adapt GROUP BY video_id"""
                                                          for n, c in (("fixed_skip_5", "seq % 5 = 0"), ("adaptive", "selected"))), "plain_adapt"))
def _(s):
    return out(sampling.sampling_strategy_compare(adaptive_of(s), (50, 75)), "video_id strategy frames selected_frames burst_frames burst_selected", "ratio burst_retention")


def _sweep_sql() -> str:
    parts = []
    for v in sampling.SWEEP_VARIANTS:
        warm = f"f.seq < {v.warmup}"
        ema = f"(CASE WHEN {warm} THEN f.motion_fraction ELSE {v.ema_alpha}E0 * f.motion_fraction + (1 - {v.ema_alpha}E0) * w.ema END)"
        tier = f"(CASE WHEN w.remaining > 0 THEN 'PROTECTED' WHEN {warm} THEN 'WARMUP' WHEN {ema} < 0.01 THEN 'STATIC' WHEN {ema} < 0.04 THEN 'LOW' WHEN {ema} < 0.08 THEN 'MEDIUM' ELSE 'HIGH' END)"
        skip = f"(CASE {tier} WHEN 'STATIC' THEN {v.static_skip} WHEN 'LOW' THEN 6 WHEN 'MEDIUM' THEN 3 ELSE 1 END)"
        always = f"({tier} IN ('HIGH', 'PROTECTED'))"
        left = f"greatest(w.remaining - 1, 0)"
        view(f"sweep_{v.name}", f"""SELECT DISTINCT video_id, CAST(-1 AS BIGINT) AS seq, 0.0E0 AS ema, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS due, false AS selected FROM fseq
          UNION ALL SELECT f.video_id, f.seq, {ema}, CASE WHEN f.motion_fraction > {v.protection_threshold}E0 AND NOT ({warm}) THEN greatest({left}, {v.protection_window}) ELSE {left} END,
           CASE WHEN {always} OR f.seq < w.due OR (f.seq = w.due AND {warm}) THEN w.due ELSE f.seq + {skip} END, {always} OR f.seq >= w.due
          FROM sweep_{v.name} w JOIN fseq f ON f.video_id = w.video_id AND f.seq = w.seq + 1""", "fseq")
        parts.append(f"""SELECT '{v.name}' AS variant, video_id, count(*) AS frames, count(*) FILTER (WHERE selected) AS selected_frames, count(*) FILTER (WHERE selected AND seq BETWEEN 50 AND 75) AS burst_selected,
          {R("count(*) FILTER (WHERE selected) / count(*) * 100", 6)} AS selection_pct, {R("count(*) FILTER (WHERE selected AND seq BETWEEN 50 AND 75) / 26.0E0 * 100", 6)} AS burst_pct FROM sweep_{v.name} WHERE seq >= 0 GROUP BY ALL""")
    return sql(" UNION ALL ".join(parts), *[f"sweep_{v.name}" for v in sampling.SWEEP_VARIANTS])


@query("skip_variant_sweep", _sweep_sql())
def _(s):
    return out(sampling.skip_variant_sweep(s.frame_sequence, (50, 75)), "variant video_id frames selected_frames burst_selected", "selection_pct burst_pct")


# Quality ------------------------------------------------------------------------------------
view("luma", f"""SELECT video_id, frame_number, seq, blur_score, mean AS mean_luminance, sqrt(greatest(q / n - mean * mean, 0)) AS luminance_std, dark / n AS dark_pixel_ratio, p95 - p5 AS histogram_spread FROM (
 SELECT *, list_sum(h) AS n, list_sum(list_transform(range(256), lambda i: h[i + 1] * i)) / list_sum(h) AS mean, CAST(list_sum(list_transform(range(256), lambda i: h[i + 1] * i * i)) AS DOUBLE) AS q, list_sum(h[1:30]) AS dark,
  list_aggregate(flatten(list_transform(range(256), lambda i: list_resize(CAST([] AS BIGINT[]), h[i + 1], i))), 'quantile_cont', 0.05) AS p5,
  list_aggregate(flatten(list_transform(range(256), lambda i: list_resize(CAST([] AS BIGINT[]), h[i + 1], i))), 'quantile_cont', 0.95) AS p95
 FROM (SELECT *, list_transform(range(256), lambda i: greatest(0, 40 - abs(i - peak_bin)) + (i + frame_number) % 3) AS h FROM fseq))""", "fseq")
view("classed", """SELECT *, CASE quality_class WHEN 'very_low_light' THEN 'clahe_gamma' WHEN 'low_light' THEN 'clahe' ELSE 'off' END AS preprocessing FROM (
 SELECT *, CASE WHEN blur_score < 15 OR mean_luminance < 5 THEN 'unusable' WHEN mean_luminance < 30 AND dark_pixel_ratio >= 0.6 THEN 'very_low_light' WHEN mean_luminance < 60 AND dark_pixel_ratio >= 0.3 THEN 'low_light' ELSE 'normal' END AS quality_class FROM light)""", "light")
view("light", """SELECT *, CAST(peak_bin AS DOUBLE) / 3 AS mean_luminance, 1.0E0 - peak_bin / 256.0E0 AS dark_pixel_ratio FROM fseq""", "fseq")


def light_frames(s: Inputs):
    """Frames with luminance and dark share taken from the histogram peak."""
    return s.frame_sequence.selectExpr("*", "CAST(peak_bin AS DOUBLE) / 3 AS mean_luminance", "1.0E0 - peak_bin / 256.0E0 AS dark_pixel_ratio")


@query("luma_stats", sql("SELECT " + outs("video_id frame_number", "mean_luminance luminance_std dark_pixel_ratio histogram_spread", 4) + " FROM luma", "luma"))
def _(s):
    return out(quality.luma_stats(s.frame_histograms), "video_id frame_number", "mean_luminance luminance_std dark_pixel_ratio histogram_spread", 4)


@query("quality_class", sql("SELECT video_id, frame_number, quality_class, preprocessing FROM classed", "classed"))
def _(s):
    return quality.quality_class(light_frames(s)).select("video_id", "frame_number", "quality_class", "preprocessing")


@query("video_quality_report", sql(f"""SELECT video_id, total_frames, {R('mean_luminance', 2)} AS mean_luminance, {R('mean_blur_score', 2)} AS mean_blur_score, {R('(l + v) / n', 3)} AS low_light_ratio, {R('v / n', 3)} AS very_low_light_ratio, {R('u / n', 3)} AS unusable_ratio,
  CASE greatest(o, l, v, u) WHEN o THEN 'normal' WHEN l THEN 'low_light' WHEN v THEN 'very_low_light' ELSE 'unusable' END AS dominant_class, CASE WHEN v / n > 0.3 THEN 'clahe_gamma' WHEN (l + v) / n > 0.3 THEN 'clahe' ELSE 'off' END AS recommended
 FROM (SELECT video_id, count(*) AS n, avg(mean_luminance) AS mean_luminance, avg(blur_score) AS mean_blur_score, count(*) FILTER (WHERE quality_class = 'normal') AS o, count(*) FILTER (WHERE quality_class = 'low_light') AS l,
   count(*) FILTER (WHERE quality_class = 'very_low_light') AS v, count(*) FILTER (WHERE quality_class = 'unusable') AS u FROM classed WHERE seq % 3 = 0 GROUP BY ALL) JOIN (SELECT video_id, count(*) AS total_frames FROM classed GROUP BY ALL) USING (video_id)""", "classed"))
def _(s):
    return quality.video_quality_report(quality.quality_class(light_frames(s)), 3)


@query("drop_unusable", sql("""SELECT video_id, frame_number FROM classed WHERE quality_class <> 'unusable' OR video_id NOT IN (SELECT video_id FROM classed WHERE quality_class <> 'unusable')""", "classed"))
def _(s):
    return quality.drop_unusable(quality.quality_class(light_frames(s))).select("video_id", "frame_number")


@query("tag_detection_quality", sql("""SELECT obs_id, coalesce(quality_class, 'unknown') AS lighting_condition, coalesce(preprocessing, 'off') AS preprocessing_mode
 FROM obs LEFT JOIN classed USING (video_id, frame_number)""", "obs", "classed"))
def _(s):
    return quality.tag_detection_quality(s.observations, quality.quality_class(light_frames(s))).select("obs_id", "lighting_condition", "preprocessing_mode")


# Brightness -----------------------------------------------------------------------------------
def _mid(lst: str) -> str:
    return f"((list_sort({lst})[(len({lst}) + 1) // 2] + list_sort({lst})[len({lst}) // 2 + 1]) / 2)"


view("filled", """SELECT *, coalesce(last_value(brightness IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 128.0E0) AS raw_brightness FROM fseq""", "fseq")
view("smooth", f"""SELECT *, {_mid('near')} AS smoothed FROM (SELECT *, list(raw_brightness) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM filled)""", "filled")
view("based", f"""SELECT *, CASE WHEN len(past) > 0 THEN {_mid('past')} ELSE f END AS baseline FROM (SELECT *, coalesce(list(smoothed) OVER (PARTITION BY video_id ORDER BY timestamp_ms RANGE BETWEEN 2000.0E0 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), []) AS past FROM smooth)
 JOIN (SELECT video_id, median(smoothed) AS f FROM smooth WHERE seq < 10 GROUP BY ALL) USING (video_id)""", "smooth")
view("bright", f"""SELECT video_id, frame_number, seq, timestamp_ms, {R('raw_brightness', 2)} AS raw_brightness, {R('smoothed', 2)} AS smoothed, {R('baseline', 2)} AS baseline, {R('smoothed - baseline', 2)} AS delta FROM based""", "based")


def bright_of(s: Inputs):
    return s.stage("brightness", lambda: quality.brightness_profile(s.frame_sequence))


@query("forward_fill_brightness", sql("SELECT video_id, frame_number, raw_brightness FROM filled", "filled"))
def _(s):
    return quality.forward_fill_brightness(s.frame_sequence).select("video_id", "frame_number", "raw_brightness")


@query("median_smooth", sql("SELECT video_id, frame_number, smoothed FROM smooth", "smooth"))
def _(s):
    return quality.median_smooth(quality.forward_fill_brightness(s.frame_sequence)).select("video_id", "frame_number", "smoothed")


@query("rolling_baseline", sql("SELECT video_id, frame_number, raw_brightness, smoothed, baseline, delta FROM bright", "bright"))
def _(s):
    return bright_of(s).select("video_id", "frame_number", "raw_brightness", "smoothed", "baseline", "delta")


def _lighting_views(t: float) -> None:
    n = f"light{int(t)}"
    side = f"(CASE WHEN b.delta >= {t} THEN 1 WHEN b.delta <= -{t} THEN -1 ELSE 0 END)"
    up1, dn1 = f"(CASE WHEN {side} = 1 THEN w.up + 1 ELSE 0 END)", f"(CASE WHEN {side} = -1 THEN w.dn + 1 ELSE 0 END)"
    fire = f"(CASE WHEN {up1} >= 2 THEN 1 WHEN {dn1} >= 2 THEN -1 ELSE 0 END)"
    ps = f"(CASE {side} WHEN 1 THEN coalesce(w.pu, b.seq) WHEN -1 THEN w.pu END)"
    pd_ = f"(CASE {side} WHEN -1 THEN coalesce(w.pd, b.seq) WHEN 1 THEN w.pd END)"
    view(f"{n}_walk", f"""SELECT DISTINCT video_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS dn, CAST(NULL AS BIGINT) AS pu, CAST(NULL AS BIGINT) AS pd, 0 AS fire, CAST(NULL AS BIGINT) AS start_seq FROM bright WHERE seq = 3
      UNION ALL SELECT b.video_id, b.seq, CASE WHEN {fire} = 1 THEN 0 ELSE {up1} END, CASE WHEN {fire} = -1 THEN 0 ELSE {dn1} END, CASE WHEN {fire} = 1 THEN NULL ELSE {ps} END, CASE WHEN {fire} = -1 THEN NULL ELSE {pd_} END, {fire},
       CASE {fire} WHEN 1 THEN {ps} WHEN -1 THEN {pd_} END FROM {n}_walk w JOIN bright b ON b.video_id = w.video_id AND b.seq = w.seq + 1""", "bright")
    conf = R(f"least(0.97E0, 0.55E0 + abs(e.delta) / {t * 4} * 0.42E0)", 4)
    view(f"{n}_raw", f"""SELECT w.video_id, CASE w.fire WHEN 1 THEN 'light_turned_on' ELSE 'light_turned_off' END AS event_type, s.frame_number, s.timestamp_ms, s.baseline AS brightness_before, e.smoothed AS brightness_after, e.delta, {conf} AS confidence, w.seq AS fired_seq,
      row_number() OVER (PARTITION BY w.video_id ORDER BY w.seq) AS i FROM {n}_walk w JOIN bright e ON e.video_id = w.video_id AND e.seq = w.seq JOIN bright s ON s.video_id = w.video_id AND s.seq = w.start_seq WHERE w.fire <> 0""", f"{n}_walk", "bright")
    close = "(e.event_type = m.event_type AND e.timestamp_ms - m.timestamp_ms <= 800)"
    swap = f"(NOT {close} OR e.confidence > m.confidence)"
    view(f"{n}_mwalk", f"""SELECT video_id, i, i AS kept, event_type, timestamp_ms, confidence, CAST(1 AS BIGINT) AS grp FROM {n}_raw WHERE i = 1
      UNION ALL SELECT e.video_id, e.i, CASE WHEN {swap} THEN e.i ELSE m.kept END, e.event_type, CASE WHEN {swap} THEN e.timestamp_ms ELSE m.timestamp_ms END, CASE WHEN {swap} THEN e.confidence ELSE m.confidence END, CASE WHEN {close} THEN m.grp ELSE m.grp + 1 END
      FROM {n}_mwalk m JOIN {n}_raw e ON e.video_id = m.video_id AND e.i = m.i + 1""", f"{n}_raw")
    view(f"{n}_merged", f"""SELECT r.* FROM {n}_raw r JOIN (SELECT video_id, grp, max_by(kept, i) AS i FROM {n}_mwalk GROUP BY ALL) USING (video_id, i)""", f"{n}_raw", f"{n}_mwalk")


for _t in (10.0, 15.0, 20.0):
    _lighting_views(_t)
LIGHT = "video_id event_type frame_number timestamp_ms brightness_before brightness_after delta confidence fired_seq"


@query("lighting_events", sql(f"SELECT {outs(LIGHT)} FROM light10_raw", "light10_raw"))
def _(s):
    return quality.lighting_events(bright_of(s)).select(*LIGHT.split())


@query("merge_lighting", sql(f"SELECT {outs(LIGHT)} FROM light10_merged", "light10_merged"))
def _(s):
    return quality.merge_lighting(quality.lighting_events(bright_of(s))).select(*LIGHT.split())


@query("brightness_timeline", sql(f"""SELECT video_id, frame_number, {R('timestamp_ms / 1000', 2)} AS timestamp_s, {', '.join(f"{R(c, 1)} AS {c}" for c in ('raw_brightness', 'smoothed', 'baseline', 'delta'))}
 FROM bright JOIN (SELECT video_id, greatest(count(*) // 100, 1) AS step FROM bright GROUP BY ALL) USING (video_id) WHERE seq % step = 0""", "bright"))
def _(s):
    return quality.brightness_timeline(bright_of(s))


@query("brightness_range", sql("SELECT video_id, count(*) AS frames, " + ", ".join(f"{R(f'{f}(raw_brightness)', 1)} AS {n}_brightness" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + " FROM bright GROUP BY ALL", "bright"))
def _(s):
    return quality.brightness_range(bright_of(s))


@query("lighting_threshold_comparison", sql(" UNION ALL ".join(f"SELECT {t}E0 AS threshold, video_id, event_type, count(*) AS events, max(confidence) AS max_confidence FROM light{int(t)}_merged GROUP BY ALL" for t in (10.0, 15.0, 20.0)), "light10_merged", "light15_merged", "light20_merged"))
def _(s):
    return quality.threshold_comparison(bright_of(s))


# Scenes -----------------------------------------------------------------------------------------
view("hist", "SELECT *, list_transform(range(48), lambda i: 1.0E0 * (greatest(0, 10 - abs(i - peak_bin % 48)) + (i * (frame_number % 7 + 1)) % 3)) AS h FROM fseq", "fseq")
view("hdiff", """SELECT *, CASE WHEN ph IS NULL THEN NULL ELSE least(greatest(1.0E0 - CASE WHEN sqrt(va * vb) < 1e-10 THEN 1.0E0 ELSE ab / sqrt(va * vb) END, 0.0E0), 1.0E0) END AS histogram_diff FROM (
 SELECT *, list_sum(list_transform(range(48), lambda i: (ph[i + 1] - list_avg(ph)) * (h[i + 1] - list_avg(h)))) AS ab, list_sum(list_transform(ph, lambda x: (x - list_avg(ph)) ** 2)) AS va, list_sum(list_transform(h, lambda x: (x - list_avg(h)) ** 2)) AS vb
 FROM (SELECT *, lag(h) OVER (PARTITION BY video_id ORDER BY seq) AS ph FROM hist))""", "hist")
view("comp", "SELECT video_id, frame_number, timestamp_ms, seq, pixel_diff, histogram_diff, 0.4E0 * pixel_diff + 0.6E0 * histogram_diff AS composite FROM hdiff", "hdiff")
view("thr", """SELECT *, list_avg(win) + 1.5E0 * list_stddev_pop(win) AS adaptive_threshold FROM (SELECT *, list_concat(list_resize(CAST([] AS DOUBLE[]), CAST(50 - len(past) AS BIGINT), 0.05E0), past) AS win FROM (
 SELECT *, list_filter(coalesce(list(composite) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), []), lambda x: x IS NOT NULL) AS past FROM comp))""", "comp")
view("flags", """SELECT *, CASE WHEN seq = 0 THEN 'first_frame' WHEN is_duplicate THEN 'duplicate' WHEN is_hard_cut THEN 'hard_cut' WHEN is_boundary THEN 'adaptive_boundary' ELSE 'normal' END AS decision, seq = 0 OR (is_boundary AND NOT is_duplicate) AS is_keyframe FROM (
 SELECT video_id, frame_number, timestamp_ms, seq, composite, adaptive_threshold, seq > 0 AND composite > 0.7 AS is_hard_cut, seq > 0 AND (composite > 0.7 OR composite > adaptive_threshold) AS is_boundary, seq > 0 AND composite < 0.02 AS is_duplicate FROM thr)""", "thr")
view("bcand", "SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS i FROM flags WHERE is_boundary AND NOT is_duplicate", "flags")
view("bwalk", """SELECT video_id, i, frame_number, frame_number AS last, true AS kept FROM bcand WHERE i = 1 UNION ALL SELECT c.video_id, c.i, c.frame_number, CASE WHEN c.frame_number - w.last >= 25 THEN c.frame_number ELSE w.last END, c.frame_number - w.last >= 25
 FROM bwalk w JOIN bcand c ON c.video_id = w.video_id AND c.i = w.i + 1""", "bcand")
view("bounded", """SELECT f.*, coalesce(w.kept, false) AS scene_boundary, NOT is_duplicate AND coalesce(w.kept, true) AS final_keyframe FROM flags f LEFT JOIN bwalk w USING (video_id, frame_number)""", "flags", "bwalk")


def scored_of(s: Inputs):
    return s.stage("scene_scores", lambda: scenes.classify_scene_frame(scenes.adaptive_threshold(scenes.composite_score(scenes.histogram_diff(s.frame_histograms)))).drop("luma_hist", "color_hist"))


def bounded_of(s: Inputs):
    """Minimum scene length of 25 source frames, so that the rule binds on this data."""
    return s.stage("bounded", lambda: scenes.enforce_min_scene(scored_of(s), 25))


@query("histogram_diff", sql("SELECT " + outs("video_id frame_number", "histogram_diff") + " FROM hdiff", "hdiff"))
def _(s):
    return out(scenes.histogram_diff(s.frame_histograms), "video_id frame_number", "histogram_diff")


@query("composite_score", sql("SELECT " + outs("video_id frame_number", "composite") + " FROM comp", "comp"))
def _(s):
    return out(scored_of(s), "video_id frame_number", "composite")


@query("adaptive_threshold", sql("SELECT " + outs("video_id frame_number", "adaptive_threshold") + " FROM thr", "thr"))
def _(s):
    return out(scored_of(s), "video_id frame_number", "adaptive_threshold")


@query("classify_scene_frame", sql("SELECT video_id, frame_number, is_hard_cut, is_boundary, is_duplicate, is_keyframe, decision FROM flags", "flags"))
def _(s):
    return scored_of(s).select("video_id", "frame_number", "is_hard_cut", "is_boundary", "is_duplicate", "is_keyframe", "decision")


@query("enforce_min_scene", sql("SELECT video_id, frame_number, scene_boundary, final_keyframe FROM bounded", "bounded"))
def _(s):
    return bounded_of(s).select("video_id", "frame_number", "scene_boundary", "final_keyframe")


@query("scene_segments", sql("""SELECT video_id, g AS scene_index, start_frame, coalesce(nxt - 1, lf) AS end_frame, start_ms, CASE WHEN coalesce(nxt - 1, lf) = lf THEN lms ELSE start_ms END AS end_ms,
  CASE WHEN coalesce(nxt - 1, lf) = lf THEN lms ELSE start_ms END - start_ms AS duration_ms, keyframes, frames FROM (SELECT *, lead(start_frame) OVER (PARTITION BY video_id ORDER BY g) AS nxt FROM (
   SELECT video_id, CAST(g AS BIGINT) AS g, min(frame_number) AS start_frame, max(frame_number) AS lf, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS lms, count(*) FILTER (WHERE is_keyframe) AS keyframes, count(*) AS frames
   FROM (SELECT *, sum(CAST(scene_boundary AS INT)) OVER (PARTITION BY video_id ORDER BY seq) AS g FROM bounded) GROUP BY ALL))""", "bounded"))
def _(s):
    return scenes.scene_segments(bounded_of(s)).drop("boundary_reason")


@query("scene_metrics", sql(f"""SELECT video_id, count(*) AS total_frames, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) FILTER (WHERE final_keyframe) AS keyframes, count(*) FILTER (WHERE scene_boundary) AS boundaries,
  count(*) FILTER (WHERE scene_boundary AND is_hard_cut) AS hard_cuts, {R('coalesce(avg(composite) FILTER (WHERE composite > 0), 0)', 6)} AS avg_composite, {R('coalesce(max(composite) FILTER (WHERE composite > 0), 0)', 6)} AS max_composite,
  {R('count(*) FILTER (WHERE is_duplicate) / count(*)', 6)} AS duplicate_rate, {R('count(*) / count(*) FILTER (WHERE final_keyframe)', 6)} AS reduction_ratio FROM bounded GROUP BY ALL""", "bounded"))
def _(s):
    return out(scenes.scene_metrics(bounded_of(s)), "video_id total_frames duplicates keyframes boundaries hard_cuts", "avg_composite max_composite duplicate_rate reduction_ratio")


@query("choose_detection_frames", sql("""SELECT video_id, frame_number, CASE WHEN k >= 700 THEN 'keyframes' ELSE 'all_frames' END AS frame_source FROM bounded JOIN (SELECT video_id, count(*) FILTER (WHERE final_keyframe) AS k FROM bounded GROUP BY ALL) USING (video_id)
 WHERE k < 700 OR final_keyframe""", "bounded"))
def _(s):
    return scenes.choose_detection_frames(bounded_of(s), 700).select("video_id", "frame_number", "frame_source")
