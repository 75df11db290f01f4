"""SQL texts shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from framestory import fixed


def R(expr: str, places: int) -> str:
    """The library's rounding rule."""
    s = f"1e{places}"
    return f"(round_even(round_even(({expr}) * 1e10, 0) / 1e10 * {s}, 0) / {s} + 0.0E0)"


def IN(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def CASE(col: str, table: dict, default) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default!r} END"


def MEDIAN(v: str) -> str:
    """Mean of the two middle values."""
    s = f"list_sort(list({v}))"
    return f"(({s}[(count({v}) + 1) // 2] + {s}[count({v}) // 2 + 1]) / 2)"


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, *deps: str) -> None:
    VIEWS[name] = (list(deps), sql)


def sql(body: str, *names: str) -> str:
    """``body`` with the named views and everything they need as CTEs."""
    done: list[str] = []

    def need(n: str) -> None:
        if n in done:
            return
        for d in VIEWS[n][0]:
            need(d)
        done.append(n)

    for n in names:
        need(n)
    if not done:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{_head(n)} AS ({VIEWS[n][1]})" for n in done) + "\n" + body


def _head(n: str) -> str:
    return n


view("obs", """
 SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS video_id, user_id AS track_id, event_id AS obs_id, n AS seq,
  5 * (n + user_id % 7) AS frame_number, 5 * (n + user_id % 7) * 40.0E0 AS timestamp_ms,
  CASE user_id % 6 WHEN 0 THEN 'car' WHEN 1 THEN 'backpack' WHEN 2 THEN 'bottle' ELSE 'person' END AS class_name,
  (500 + (event_id * 7919) % 500) / 1000.0E0 AS confidence,
  (100 + ((user_id * 137) % 800 + n * (user_id % 4) * 6 + event_id % 3) % 800 - 30 - user_id % 20) / 1000.0E0 AS x1,
  (200 + ((user_id * 71) % 500 + n * (user_id % 3) * 4) % 500 - 75 - k % 10) / 1000.0E0 AS y1,
  (100 + ((user_id * 137) % 800 + n * (user_id % 4) * 6 + event_id % 3) % 800 + 30 + user_id % 20) / 1000.0E0 AS x2,
  (200 + ((user_id * 71) % 500 + n * (user_id % 3) * 4) % 500 + 75 + k % 10) / 1000.0E0 AS y2
 FROM (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)""")
view("sem", """
 SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS video_id, user_id * 100 + EXTRACT(DAY FROM ts) AS track_id, event_id,
  CASE event_type WHEN 'signup' THEN 'person_entered_scene' WHEN 'error' THEN 'person_left_scene'
   WHEN 'click' THEN 'person_walking' WHEN 'purchase' THEN 'person_running' ELSE 'person_standing' END AS event_type,
  (EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60) * 1000.0E0 AS start_ms,
  (EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60) * 1000.0E0 + value * 1000.0E0 AS end_ms,
  (400 + (event_id * 31) % 600) / 1000.0E0 AS confidence
 FROM events""")
view("frames", """
 SELECT o_custkey % 10 AS video_id, o_orderkey AS frame_number, o_orderkey * 40.0E0 AS timestamp_ms,
  CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE 60.0E0 + 120.0E0 * (CAST(FLOOR(o_orderkey / 400.0) AS BIGINT) % 2)
   + o_orderkey % 7 END AS brightness,
  (o_orderkey * 37 % 997) / 10000.0E0 AS motion_fraction, (o_custkey % 300) * 1.0E0 AS blur_score,
  (o_orderkey * 13 % 256) AS peak_bin,
  CASE WHEN o_orderkey % 97 = 5 THEN 0.95E0 WHEN o_orderkey % 5 = 0 THEN 0.01E0
   ELSE (o_orderkey * 53 % 300) / 1000.0E0 END AS pixel_diff
 FROM orders""")
view("fseq", "SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS seq FROM frames", "frames")
view("temb", """
 SELECT CAST(label AS BIGINT) AS true_person, vec_id % 4 AS video_id, vec_id AS track_id, embedding,
  vec_id * 200.0E0 AS start_ms, vec_id * 200.0E0 + (vec_id % 17) * 100.0E0 AS end_ms, vec_id % 9 + 1 AS observation_count
 FROM embeddings""")
view("stage_runs", """
 SELECT l_orderkey AS job_id, l_linenumber AS stage_no, l_partkey AS video_id,
  's' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS stage,
  CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'running' END AS status,
  CAST(trunc(l_extendedprice) AS BIGINT) AS duration_ms, CAST(l_quantity AS BIGINT) AS frames, l_shipdate AS created_at,
  l_discount AS ratio
 FROM lineitem""")
view("videos", """
 SELECT p_partkey AS video_id, 'cam' || CAST(p_partkey AS VARCHAR) ||
   CASE p_size % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.AVI' WHEN 2 THEN '.mkv' ELSE '.mp4' END AS filename,
  CASE WHEN p_partkey % 101 = 7 THEN 0 WHEN p_partkey % 103 = 9 THEN 60000000000 ELSE p_partkey * 1000 + 1 END AS size_bytes,
  CASE p_size % 5 WHEN 0 THEN 'H264' WHEN 1 THEN 'theora' ELSE 'vp9' END AS codec,
  CASE WHEN p_partkey % 89 = 3 THEN 0.0E0 ELSE (p_partkey * 7919 % 9000000) / 100.0E0 END AS duration_seconds,
  CASE WHEN p_size % 23 = 0 THEN 32 ELSE 640 END AS width, CASE WHEN p_size % 29 = 0 THEN 48 ELSE 480 END AS height,
  CASE WHEN p_size % 19 = 0 THEN 0.0E0 WHEN p_size % 17 = 0 THEN 480.0E0 ELSE 25.0E0 END AS fps,
  CASE WHEN p_size % 13 = 0 THEN CAST(7 AS BIGINT) END AS frame_skip_setting
 FROM part""")
view("truth", """SELECT video_id, event_id AS truth_id, event_type, start_ms + apart AS truth_start, end_ms + apart AS truth_end
 FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 90000000.0E0 ELSE 1000.0E0 END AS apart FROM sem)""", "sem")

# Motion ----------------------------------------------------------------------
view("pairs", """
 SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS bbox_area,
  lag(timestamp_ms) OVER w AS pt, lag((x1 + x2) / 2) OVER w AS pcx, lag((y1 + y2) / 2) OVER w AS pcy,
  lag((x2 - x1) * (y2 - y1)) OVER w AS parea
 FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq)""", "obs")
view("vel", """
 SELECT video_id, track_id, seq, frame_number, timestamp_ms, class_name, dx, dy, dt, cx, cy,
  sqrt(dx * dx + dy * dy) / dt * 1000.0E0 AS speed, degrees(atan2(-dy, dx)) AS angle,
  CASE WHEN parea <= 0 THEN 'stable' WHEN (bbox_area - parea) / parea > 0.05E0 THEN 'approaching'
   WHEN (bbox_area - parea) / parea < -0.05E0 THEN 'receding' ELSE 'stable' END AS signal
 FROM (SELECT *, cx - pcx AS dx, cy - pcy AS dy, timestamp_ms - pt AS dt FROM pairs WHERE timestamp_ms - pt > 0)""", "pairs")


def SPEED(v: str) -> str:
    return f"CASE WHEN {v} < 0.01E0 THEN 'stationary' WHEN {v} < 0.05E0 THEN 'slow' WHEN {v} < 0.15E0 THEN 'walking' ELSE 'fast' END"


def COMPASS(a: str) -> str:
    m = f"(({a}) - 360.0E0 * floor(({a}) / 360.0E0))"
    return (f"CASE WHEN {m} < 22.5 THEN 'E' WHEN {m} < 67.5 THEN 'NE' WHEN {m} < 112.5 THEN 'N' WHEN {m} < 157.5 THEN 'NW' "
            f"WHEN {m} < 202.5 THEN 'W' WHEN {m} < 247.5 THEN 'SW' WHEN {m} < 292.5 THEN 'S' WHEN {m} < 337.5 THEN 'SE' ELSE 'E' END")


view("prof", f"""
 SELECT a.*, {SPEED('median_speed')} AS speed_class, median_speed < 0.01E0 AS is_stationary,
  CASE WHEN s IS NULL THEN 'stationary' ELSE {COMPASS('degrees(atan2(s, c))')} END AS direction,
  least(greatest(0.4E0 * least(n_velocities / 10.0E0, 1.0E0) + 0.4E0 * det + 0.2E0 *
   CASE WHEN n_velocities >= 2 THEN 1.0E0 / (1.0E0 + sd / (avg_speed + 1e-8)) ELSE 0.5E0 END, 0.0E0), 1.0E0) AS motion_confidence
 FROM (SELECT video_id, track_id, count(*) AS n_velocities, avg(speed) AS avg_speed, max(speed) AS max_speed,
   stddev_pop(speed) AS sd, {MEDIAN('speed')} AS median_speed,
   avg(sin(radians(angle))) FILTER (WHERE speed > 0.01E0 * 1.5E0) AS s, avg(cos(radians(angle))) FILTER (WHERE speed > 0.01E0 * 1.5E0) AS c,
   sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) AS displacement,
   bool_or(signal = 'approaching') AS has_approach, bool_or(signal = 'receding') AS has_recede
  FROM vel GROUP BY ALL) a
 JOIN (SELECT video_id, track_id, coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0.8E0) AS det FROM obs GROUP BY ALL) d
 USING (video_id, track_id)""", "vel", "obs")
view("camera", """
 SELECT video_id, frame_number, n_tracks, coherence FROM (
  SELECT video_id, frame_number, count(*) AS n_tracks, count(*) FILTER (WHERE m > 1e-8) AS n_moving,
   least(sqrt(avg(dx / m) FILTER (WHERE m > 1e-8) ** 2 + avg(dy / m) FILTER (WHERE m > 1e-8) ** 2), 1.0E0) AS coherence
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS m FROM vel) GROUP BY ALL)
 WHERE n_tracks >= 3 AND n_moving >= 2 AND coherence > 0.85E0
  AND video_id IN (SELECT video_id FROM vel GROUP BY video_id HAVING count(DISTINCT track_id) >= 3)""", "vel")
view("tracks0", """
 SELECT video_id, track_id, min_by(class_name, seq) AS class_name, count(*) AS n_obs, min(frame_number) AS first_frame,
  max(frame_number) AS last_frame, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms,
  avg(confidence) AS avg_confidence, max(confidence) AS max_confidence,
  max(CASE WHEN seq = 1 THEN frame_number END) AS confirmed_at_frame
 FROM obs GROUP BY ALL""", "obs")
view("tracks", """
 SELECT t.*, last_frame - first_frame + 1 AS age_frames, last_ms - first_ms AS length_ms,
  confirmed_at_frame IS NOT NULL AS is_confirmed,
  CASE WHEN e - last_frame > 75 THEN 'ended' WHEN confirmed_at_frame IS NULL THEN 'tentative'
   WHEN e - last_frame > 0 THEN 'lost' ELSE 'active' END AS state0,
  CASE WHEN e - last_frame > 0 OR confirmed_at_frame IS NULL THEN 'ended' ELSE 'active' END AS state
 FROM tracks0 t JOIN (SELECT video_id, max(last_frame) AS e FROM tracks0 GROUP BY ALL) USING (video_id)""", "tracks0")
view("overlap", """
 SELECT video_id, track_id, count(*) AS n_frames, count(c.frame_number) AS camera_frames
 FROM obs o LEFT JOIN camera c USING (video_id, frame_number) GROUP BY ALL""", "obs", "camera")

# Rules and fusion ---------------------------------------------------------------


def _rules_sql() -> str:
    parts = []
    for (name, etype, classes, speeds, still, approach, recede, min_ms, min_frames, new, ended, min_mc, prior) in fixed.RULES:
        c = [f"class_name IN {IN(classes)}", f"n_obs >= {min_frames}", f"length_ms >= {min_ms}"]
        needs = bool(speeds) or still is not None or approach or recede
        c.append(f"motion_confidence >= {min_mc}" if needs else f"(motion_confidence IS NULL OR motion_confidence >= {min_mc})")
        if speeds:
            c.append(f"speed_class IN {IN(speeds)}")
        if still is not None:
            c.append("is_stationary" if still else "NOT is_stationary")
        if approach:
            c.append("has_approach")
        if recede:
            c.append("has_recede")
        if new:
            c.append("n_obs >= 2")
        if ended:
            c.append("state = 'ended'")
        parts.append(f"SELECT *, '{name}' AS rule_name, '{etype}' AS event_type, {prior}E0 AS rule_confidence FROM tp WHERE "
                     + " AND ".join(c))
    return "\n UNION ALL ".join(parts)


view("tp", f"""
 SELECT t.*, p.speed_class, p.is_stationary, p.has_approach, p.has_recede, p.motion_confidence,
  {R('least(greatest(0.5E0 * avg_confidence + 0.3E0 * coalesce(motion_confidence, 0.5E0) + 0.2E0 * least(n_obs / 8.0E0, 1.0E0), 0.0E0), 1.0E0)', 4)} AS confidence
 FROM tracks t LEFT JOIN prof p USING (video_id, track_id) WHERE is_confirmed""", "tracks", "prof")
view("fired", _rules_sql(), "tp")
view("rule_events", """
 SELECT video_id, track_id, class_name, rule_name, event_type, rule_confidence, confidence, first_frame AS start_frame,
  last_frame AS end_frame, first_ms AS start_ms, last_ms AS end_ms,
  video_id || '-' || track_id || '-' || rule_name AS event_id
 FROM fired WHERE confidence >= 0.4E0""", "fired")
view("dims", """
 SELECT e.*, coalesce(t.avg_confidence, e.confidence) AS detection, coalesce(p.motion_confidence, 0.5E0) AS motion,
  e.rule_confidence AS rule, coalesce(least(t.n_obs / 10.0E0, 1.0E0), 0.5E0) AS track_stability,
  1.0E0 - 0.6E0 * least((SELECT count(*) FROM camera c WHERE c.video_id = e.video_id AND c.frame_number BETWEEN e.start_frame AND e.end_frame)
    / CAST(e.end_frame - e.start_frame + 1 AS DOUBLE) / 0.7E0, 1.0E0) AS scene_reliability
 FROM rule_events e LEFT JOIN tracks t USING (video_id, track_id) LEFT JOIN prof p USING (video_id, track_id)""",
     "rule_events", "tracks", "prof", "camera")


def FUSED(strategy: str, w=fixed.FUSION_WEIGHTS["default"]) -> str:
    d = ["detection", "motion", "rule", "track_stability", "scene_reliability"]
    if strategy == "weighted_linear":
        e = " + ".join(f"{c} * {x}E0" for c, x in zip(d, w))
    elif strategy == "geometric":
        e = " * ".join(f"pow(greatest({c}, 1e-6), {x}E0)" for c, x in zip(d, w))
    elif strategy == "harmonic":
        e = "1.0E0 / (" + " + ".join(f"{x}E0 / greatest({c}, 1e-6)" for c, x in zip(d, w)) + ")"
    else:
        e = "least(" + ", ".join(d) + ")"
    return f"least(greatest({e}, 0.0E0), 1.0E0)"


view("fused", f"""
 SELECT video_id, track_id, class_name, rule_name, event_type, event_id, start_frame, end_frame, start_ms, end_ms,
  {R('detection', 4)} AS detection, {R('motion', 4)} AS motion, {R('rule', 4)} AS rule, {R('track_stability', 4)} AS track_stability,
  {R('scene_reliability', 4)} AS scene_reliability, {R(FUSED('weighted_linear'), 4)} AS fused FROM dims""", "dims")
view("fev", "SELECT *, fused AS confidence FROM fused WHERE fused >= 0.35E0", "fused")

# Story, ranking and policy over any event view ------------------------------------


def story_views(ev: str, importance: str, *deps: str) -> None:
    """Views {ev}_seq, _cont, _seg, _imp, _rank, _pol over an event view."""
    entry, exit_, act = IN(fixed.ENTRY_TYPES), IN(fixed.EXIT_TYPES), IN(fixed.ACTION_TYPES)
    invalid = " OR ".join(f"(pt = '{a}' AND event_type = '{b}')" for a, b in fixed.INVALID_SUCCESSIONS)
    view(f"{ev}_seq", f"""SELECT *, row_number() OVER w - 1 AS seq, lag(event_type) OVER w AS pt, lag(start_ms) OVER w AS ps,
      lag(end_ms) OVER w AS pe, lead(event_id) OVER w AS next_id FROM {ev}
      WINDOW w AS (PARTITION BY video_id, track_id ORDER BY start_ms, end_ms, event_type, event_id)""", ev)
    view(f"{ev}_cont", f"""SELECT s.*, coalesce(start_ms < ps, false) AS backward, coalesce(seq >= ft + 2, false) AS after_terminal,
      coalesce({invalid}, false) AS invalid_succession, coalesce(start_ms - pe > 10000, false) AS large_gap,
      CAST(coalesce(start_ms < ps, false) AS INT) + CAST(coalesce(seq >= ft + 2, false) AS INT) + CAST(coalesce({invalid}, false) AS INT) AS issues
      FROM {ev}_seq s LEFT JOIN (SELECT video_id, track_id, min(seq) AS ft FROM {ev}_seq WHERE event_type IN {exit_} GROUP BY ALL) USING (video_id, track_id)""",
         f"{ev}_seq")
    view(f"{ev}_seg0", f"""SELECT video_id, track_id, count(*) AS event_count, bool_or(event_type IN {entry}) AS has_entry,
      bool_or(event_type IN {exit_}) AS has_exit, bool_or(event_type IN {act}) AS has_action, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
      avg(confidence) AS mean_confidence, CAST(sum(issues) AS BIGINT) AS issues, CAST(sum(CAST(large_gap AS INT)) AS BIGINT) AS warnings
      FROM {ev}_cont GROUP BY ALL""", f"{ev}_cont")
    view(f"{ev}_seg1", f"""SELECT *, CASE WHEN has_entry AND has_exit AND has_action THEN 'complete' WHEN has_entry AND has_exit THEN 'partial'
      WHEN has_entry AND NOT has_action THEN 'entry_only' WHEN has_exit AND NOT has_action THEN 'exit_only'
      WHEN event_count = 1 THEN 'minimal' ELSE 'partial' END AS completeness,
      'seg-' || video_id || '-' || track_id AS segment_id FROM {ev}_seg0""", f"{ev}_seg0")
    score = f"""(0.4E0 * mean_confidence + 0.3E0 * {CASE('completeness', fixed.COMPLETENESS_SCORE, 0.0)}
      + 0.2E0 * least(event_count / 5.0E0, 1.0E0) + 0.1E0 * least((end_ms - start_ms) / 5000.0E0, 1.0E0)) * (1.0E0 - least(issues * 0.1E0, 0.4E0))"""
    view(f"{ev}_seg", f"SELECT *, least(greatest({score}, 0.0E0), 1.0E0) AS narrative_score FROM {ev}_seg1", f"{ev}_seg1")
    view(f"{ev}_imp", f"""SELECT *, {R('least(greatest(0.35E0 * i_detection + 0.35E0 * i_rarity + 0.20E0 * i_motion + 0.10E0 * i_salience, 0.0E0), 1.0E0)', 4)} AS importance
      FROM ({importance})""", ev, *deps)
    view(f"{ev}_rank0", f"""SELECT s.*, {R('0.4E0 * imp + 0.6E0 * narrative_score', 4)} AS combined_rank,
      {R('imp', 4)} AS importance_score FROM {ev}_seg s JOIN (SELECT video_id, track_id, avg(importance) AS imp FROM {ev}_imp GROUP BY ALL) USING (video_id, track_id)""",
         f"{ev}_seg", f"{ev}_imp")
    view(f"{ev}_rank", f"""SELECT * REPLACE ({R('narrative_score', 4)} AS narrative_score),
      row_number() OVER (PARTITION BY video_id ORDER BY combined_rank DESC, track_id) AS rank FROM {ev}_rank0""", f"{ev}_rank0")
    view(f"{ev}_g", f"""SELECT *, CASE WHEN narrative_score < 0.2E0 THEN 'low' WHEN completeness = 'complete' THEN 'complete' ELSE 'candidate' END AS g
      FROM {ev}_rank""", f"{ev}_rank")
    view(f"{ev}_bud", f"""SELECT video_id, total, nc, greatest(CAST(floor(total * 0.4E0) AS BIGINT) - done, 0) AS budget FROM (
      SELECT video_id, CAST(sum(event_count) AS BIGINT) AS total, count(*) FILTER (WHERE g = 'complete') AS nc,
       CAST(coalesce(sum(event_count) FILTER (WHERE g = 'complete'), 0) AS BIGINT) AS done FROM {ev}_g GROUP BY ALL)""", f"{ev}_g")
    view(f"{ev}_cand", f"""SELECT video_id, track_id, event_count, total, nc, budget, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS i
      FROM {ev}_g JOIN {ev}_bud USING (video_id) WHERE g = 'candidate'""", f"{ev}_g", f"{ev}_bud")
    keep = "(c.total <= 20 OR c.event_count <= w.remaining OR (w.remaining = 0 AND w.kept = 0 AND c.nc = 0))"
    view(f"{ev}_walk", f"""SELECT video_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS track_id, budget AS remaining, CAST(0 AS BIGINT) AS kept, false AS keep FROM {ev}_bud
      UNION ALL SELECT c.video_id, c.i, c.track_id, CASE WHEN {keep} AND c.total > 20 THEN w.remaining - c.event_count ELSE w.remaining END,
       w.kept + CAST({keep} AS BIGINT), {keep} FROM {ev}_walk w JOIN {ev}_cand c ON c.video_id = w.video_id AND c.i = w.i + 1""", f"{ev}_cand")
    view(f"{ev}_pol", f"""SELECT g.*, CASE g WHEN 'complete' THEN true WHEN 'low' THEN false ELSE w.keep END AS keep,
      CASE g WHEN 'complete' THEN 'complete_chain_preserved' WHEN 'low' THEN 'low_narrative_quality'
       ELSE CASE WHEN w.keep THEN 'high_combined_rank' ELSE 'below_ratio_threshold' END END AS reason
      FROM {ev}_g g LEFT JOIN {ev}_walk w ON g.video_id = w.video_id AND g.track_id = w.track_id""", f"{ev}_g", f"{ev}_walk")


_rarity = CASE("event_type", fixed.RARITY, fixed.DEFAULT_RARITY)
story_views("sem", f"SELECT *, confidence AS i_detection, {_rarity} AS i_rarity, 0.3E0 AS i_motion, confidence AS i_salience FROM sem")
story_views("fev", f"""SELECT e.*, e.confidence AS i_detection, {_rarity.replace('event_type', 'e.event_type')} AS i_rarity,
   CASE WHEN p.avg_speed > 0 THEN least(greatest(p.avg_speed / 0.05E0, 0.0E0), 1.0E0) WHEN p.is_stationary THEN 0.0E0 ELSE 0.3E0 END AS i_motion,
   e.detection AS i_salience FROM fev e LEFT JOIN prof p USING (video_id, track_id)""", "prof")
view("st_edges", """SELECT video_id, event_id AS source, next_id AS target, 'same_track_temporal' AS relationship, 1.0E0 AS weight
 FROM sem_seq WHERE next_id IS NOT NULL""", "sem_seq")
view("co_edges", """SELECT a.video_id, a.event_id AS source, b.event_id AS target, 'co_occurrence' AS relationship, 0.5E0 AS weight
 FROM sem a JOIN sem b ON a.video_id = b.video_id AND a.track_id <> b.track_id AND a.start_ms <= b.end_ms
  AND b.start_ms >= a.start_ms AND b.start_ms <= a.end_ms + 2000
  AND (a.start_ms, a.end_ms, a.event_type, a.event_id) < (b.start_ms, b.end_ms, b.event_type, b.event_id)""", "sem")
view("edges", "SELECT * FROM st_edges UNION ALL SELECT * FROM co_edges", "st_edges", "co_edges")
view("deg", """SELECT s.video_id, s.event_id, s.event_type, s.track_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
  coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM sem s
 LEFT JOIN (SELECT video_id, target AS event_id, count(*) AS n FROM edges GROUP BY ALL) i USING (video_id, event_id)
 LEFT JOIN (SELECT video_id, source AS event_id, count(*) AS n FROM edges GROUP BY ALL) o USING (video_id, event_id)""", "sem", "edges")
view("actors", """SELECT *, CASE WHEN track_id % 3 = 0 THEN 'Person ' || (track_id % 50) END AS person_label,
  CASE WHEN event_id % 4 = 0 THEN 'left' WHEN event_id % 4 = 1 THEN 'right' END AS direction FROM sem""", "sem")

# Baseline selections ----------------------------------------------------------------
ORD = "start_ms, end_ms, event_type, event_id"
view("motev", "SELECT *, (event_id * 17 % 1000) / 1000.0E0 AS motion FROM sem", "sem")
view("nkeep", "SELECT video_id, count(*) AS n, greatest(CAST(floor(count(*) * 0.4E0) AS BIGINT), 1) AS k FROM sem GROUP BY ALL", "sem")
view("b_uni", f"""SELECT video_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {ORD}) - 1 AS i FROM sem) JOIN nkeep USING (video_id) WHERE i % greatest(n // k, 1) = 0 AND i // greatest(n // k, 1) < k""", "sem", "nkeep")
view("b_mot", f"""SELECT video_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY motion DESC, {ORD}) AS i FROM motev) JOIN nkeep USING (video_id) WHERE i <= k""", "motev", "nkeep")
view("b_scn", f"""SELECT video_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, {ORD}) AS i FROM (SELECT *, row_number() OVER (PARTITION BY video_id, floor(start_ms / 120000) ORDER BY confidence DESC, {ORD}) AS r FROM sem) WHERE r = 1) JOIN nkeep USING (video_id) WHERE i <= k""", "sem", "nkeep")
view("b_pol", "SELECT video_id, event_id FROM sem JOIN sem_pol USING (video_id, track_id) WHERE keep", "sem", "sem_pol")
