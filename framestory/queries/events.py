"""Rules, fusion, story, graph, ranking and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestory import fixed
from framestory.operators import compression, evaluation, events, fusion, graph, motion, ranking, story, tracks, validation
from framestory.queries.motion import camera_of, profiles_of, tracks_of
from framestory.queries.registry import query
from framestory.queries.shape import out, outs
from framestory.queries.sqlviews import FUSED, IN, R, sql
from framestory.sources.fixtures import Inputs


def rule_events_of(s: Inputs):
    return s.stage("rule_events", lambda: events.apply_rules(tracks.finalize_tracks(tracks_of(s)), profiles_of(s)))


def dims_of(s: Inputs):
    return fusion.confidence_dims(rule_events_of(s), tracks_of(s), profiles_of(s), camera_of(s))


def fused_of(s: Inputs):
    return s.stage("fused", lambda: fusion.with_fused(dims_of(s)))


def named_events(s: Inputs):
    """Semantic events with a person label on a third of the tracks and a direction on half the events."""
    return s.semantic_events.selectExpr(
        "*", "CASE WHEN track_id % 3 = 0 THEN concat('Person ', track_id % 50) END AS person_label",
        "CASE WHEN event_id % 4 = 0 THEN 'left' WHEN event_id % 4 = 1 THEN 'right' END AS direction")


RULE_COLS = "video_id track_id class_name rule_name event_type event_id start_frame end_frame start_ms end_ms confidence"


@query("rules_table", sql("SELECT t.*, (SELECT count(*) FROM rule_events e WHERE e.rule_name = t.rule_name) AS fired FROM (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', {len(r[2])}, {r[12]}E0, {r[8]}, {r[7]}E0)" for r in fixed.RULES)
    + ") t(rule_name, event_type, n_classes, rule_confidence, min_frames, min_length_ms)", "rule_events"))
def _(s):
    """The rules with how often each fires on the data."""
    n = rule_events_of(s).groupBy("rule_name").agg(F.count(F.lit(1)).alias("fired"))
    return fixed.rules_table(s.spark).select("rule_name", "event_type", F.size("class_names").alias("n_classes"),
                                             "rule_confidence", "min_frames", "min_length_ms").join(n, "rule_name", "left").fillna(0, ["fired"])


@query("apply_rules", sql("SELECT " + outs(RULE_COLS) + " FROM rule_events", "rule_events"))
def _(s):
    return rule_events_of(s).select(*RULE_COLS.split())


@query("suppress_camera_tracks", sql("""SELECT video_id, track_id, class_name FROM tracks t WHERE NOT EXISTS (
 SELECT 1 FROM overlap o WHERE o.video_id = t.video_id AND o.track_id = t.track_id AND camera_frames = n_frames)""", "tracks", "overlap"))
def _(s):
    return events.suppress_camera_tracks(tracks_of(s), motion.camera_overlap(s.observations, camera_of(s))).select("video_id", "track_id", "class_name")


@query("union_passes", sql("""SELECT source, event_type, count(*) AS n FROM (SELECT 'rules' AS source, event_type FROM rule_events
 UNION ALL SELECT 'semantic', event_type FROM sem) GROUP BY ALL""", "rule_events", "sem"))
def _(s):
    a = rule_events_of(s).withColumn("source", F.lit("rules"))
    b = s.semantic_events.withColumn("event_id", F.col("event_id").cast("string")).withColumn("source", F.lit("semantic"))
    return events.union_passes(a, b).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("suppress_types", sql("SELECT event_id, event_type FROM rule_events WHERE event_type NOT IN ('object_appeared', 'object_disappeared')", "rule_events"))
def _(s):
    return events.suppress_types(rule_events_of(s)).select("event_id", "event_type")


def _merge_sql(keys: str) -> str:
    return f"""SELECT {keys}, min_by(event_id, n) AS event_id, min_by(start_ms, n) AS start_ms, max_by(end_ms, n) AS end_ms,
  max(confidence) AS confidence, count(*) AS merged_count FROM (
  SELECT *, sum(CASE WHEN start_ms - p <= 2500 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY n) AS run FROM (
   SELECT *, lag(end_ms) OVER w AS p, row_number() OVER w AS n FROM sem WINDOW w AS (PARTITION BY {keys} ORDER BY start_ms, end_ms, event_id)))
 GROUP BY {keys}, run"""


@query("merge_adjacent", sql(_merge_sql("video_id, track_id, event_type"), "sem"))
def _(s):
    return events.merge_adjacent(s.semantic_events).select(
        "video_id", "track_id", "event_type", "event_id", "start_ms", "end_ms", "confidence", "merged_count")


@query("merge_adjacent_by_type", sql(_merge_sql("video_id, event_type"), "sem"))
def _(s):
    return events.merge_adjacent(s.semantic_events, keys=("video_id", "event_type")).select(
        "video_id", "event_type", "event_id", "start_ms", "end_ms", "confidence", "merged_count")


@query("attach_identity", sql("""SELECT event_id, person_label, CASE WHEN track_id % 3 = 0 THEN 'left' END AS entry_direction,
 coalesce(person_label, 'Track-' || track_id) || ' ' || replace(event_type, '_', ' ') AS description FROM actors""", "actors"))
def _(s):
    persons = s.semantic_events.where("track_id % 3 = 0").select("video_id", "track_id").distinct().selectExpr(
        "*", "concat('Person ', track_id % 50) AS person_label", "'left' AS entry_direction")
    return events.attach_identity(s.semantic_events, persons).select("event_id", "person_label", "entry_direction", "description")


@query("clamp_to_duration", sql("""SELECT event_id, CASE WHEN d > 0 THEN least(start_ms, d) ELSE start_ms END AS start_ms,
 CASE WHEN d > 0 THEN least(end_ms, d) ELSE end_ms END AS end_ms FROM sem LEFT JOIN (
  SELECT DISTINCT video_id, (video_id % 3) * 40000000.0E0 AS d FROM sem) USING (video_id)""", "sem"))
def _(s):
    d = s.semantic_events.select("video_id").distinct().withColumn("duration_ms", (F.col("video_id") % 3) * F.lit(40000000.0))
    return events.clamp_to_duration(s.semantic_events, d).select("event_id", "start_ms", "end_ms")


@query("event_counts", sql("""SELECT video_id, 'type' AS grain, event_type AS key, count(*) AS events FROM sem GROUP BY ALL
 UNION ALL SELECT video_id, 'track', CAST(track_id AS VARCHAR), count(*) FROM sem GROUP BY ALL
 UNION ALL SELECT video_id, 'video', '*', count(*) FROM sem GROUP BY ALL""", "sem"))
def _(s):
    return events.event_counts(s.semantic_events)


_CATEGORY = f"""CASE WHEN event_type IN {IN(fixed.TIMELINE_ACTIVITY)} THEN 'activity' WHEN event_type IN {IN(fixed.TIMELINE_LIGHTING)} THEN 'lighting'
 WHEN event_type IN {IN(fixed.TIMELINE_INTERACTION)} THEN 'interaction' WHEN starts_with(event_type, 'person_picked_up_') OR starts_with(event_type, 'person_placed_')
  OR starts_with(event_type, 'person_pocketed_') OR starts_with(event_type, 'person_near_') THEN 'interaction'
 WHEN starts_with(event_type, 'vehicle_') THEN 'vehicle' ELSE 'other' END"""
_VARIED = """CASE event_id % 9 WHEN 0 THEN 'light_turned_on' WHEN 1 THEN 'person_picked_up_cup' WHEN 2 THEN 'vehicle_receding'
 WHEN 3 THEN 'person_pocketed_object' WHEN 4 THEN 'unattended_bag' WHEN 5 THEN 'person_near_chair' ELSE event_type END"""


def varied_events(s: Inputs):
    """Semantic events with six further event types mixed in."""
    return s.semantic_events.withColumn("event_type", F.expr(_VARIED))


@query("event_category", sql(f"SELECT video_id, {_CATEGORY} AS category, count(*) AS n FROM (SELECT * REPLACE ({_VARIED} AS event_type) FROM sem) GROUP BY ALL", "sem"))
def _(s):
    return varied_events(s).groupBy("video_id", events.event_category(F.col("event_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("display_fields", sql(f"""SELECT event_id, list_reduce(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS display_name,
  format('{{:02d}}:{{:02d}}.{{:03d}}', m // 60000, m % 60000 // 1000, m % 1000) AS start_text, {_CATEGORY} AS category FROM (
  SELECT * REPLACE ({_VARIED} AS event_type), CAST(floor(start_ms) AS BIGINT) AS m FROM sem)""", "sem"))
def _(s):
    return events.display_fields(varied_events(s)).select("event_id", "display_name", "start_text", "category")


@query("anomaly_filter", sql(f"""SELECT event_id, event_type FROM (SELECT * REPLACE ({_VARIED} AS event_type) FROM sem)
 WHERE regexp_matches(event_type, '{'|'.join(fixed.ANOMALY_WORDS)}')""", "sem"))
def _(s):
    return events.anomaly_filter(varied_events(s)).select("event_id", "event_type")


# Fusion -----------------------------------------------------------------------------
DIMS = "detection motion rule track_stability scene_reliability"


@query("confidence_dims", sql("SELECT " + outs("event_id", DIMS) + " FROM dims", "dims"))
def _(s):
    return out(dims_of(s), "event_id", DIMS)


for _strategy in ("weighted_linear", "geometric", "harmonic", "min"):
    def _run(s, strategy=_strategy):
        return out(dims_of(s).withColumn("fused", fusion.fuse(strategy)), "event_id", "fused", 4)

    query(f"fuse_{_strategy}", sql(f"SELECT event_id, {R(FUSED(_strategy), 4)} AS fused FROM dims", "dims"))(_run)


@query("fuse_frozen_v1", sql(f"SELECT event_id, {R(FUSED('weighted_linear', fixed.FUSION_WEIGHTS['frozen_v1']), 4)} AS fused FROM dims", "dims"))
def _(s):
    return out(dims_of(s).withColumn("fused", fusion.fuse(weights=fixed.FUSION_WEIGHTS["frozen_v1"])), "event_id", "fused", 4)


@query("fusion_filter", sql("SELECT event_id, fused, fused >= 0.75E0 AS kept FROM fused", "fused"))
def _(s):
    kept, dropped = fusion.fusion_filter(fused_of(s), 0.75)
    return kept.select("event_id", "fused", F.lit(True).alias("kept")).unionByName(dropped.select("event_id", "fused", F.lit(False).alias("kept")))


@query("fusion_metrics", sql("SELECT video_id, count(*) FILTER (WHERE fused >= 0.35) AS total_fused, count(*) FILTER (WHERE fused < 0.35) AS total_discarded, "
                             + ", ".join(f"{R(f'{f}(fused) FILTER (WHERE fused > 0)', 6)} AS {f}_fused" for f in ("avg", "min", "max")) + ", "
                             + ", ".join(f"{R(f'avg({d})', 6)} AS mean_{d}" for d in DIMS.split()) + " FROM fused GROUP BY ALL", "fused"))
def _(s):
    return out(fusion.fusion_metrics(fused_of(s)), "video_id total_fused total_discarded",
               "avg_fused min_fused max_fused " + " ".join("mean_" + d for d in DIMS.split()))


def _first_at(level: str) -> str:
    return f"CASE {level}({', '.join(DIMS.split())}) " + " ".join(f"WHEN {d} THEN '{d}'" for d in DIMS.split()) + " END"


@query("weakest_dimension", sql(f"SELECT event_id, {_first_at('least')} AS weakest, {_first_at('greatest')} AS strongest FROM fused", "fused"))
def _(s):
    return fusion.weakest_and_strongest(fused_of(s)).select("event_id", "weakest", "strongest")


# Story ----------------------------------------------------------------------------------
FLAGS = "event_id seq backward after_terminal invalid_succession large_gap issues"


@query("continuity", sql("SELECT " + outs(FLAGS) + " FROM sem_cont", "sem_cont"))
def _(s):
    return story.continuity(s.semantic_events).select(*FLAGS.split())


SEG = "video_id track_id segment_id event_count completeness start_ms end_ms issues warnings"


@query("story_segments", sql("SELECT " + outs(SEG, "mean_confidence narrative_score") + " FROM sem_seg", "sem_seg"))
def _(s):
    return out(story.story_segments(s.semantic_events), SEG, "mean_confidence narrative_score")


@query("segment_events", sql("SELECT 'seg-' || video_id || '-' || track_id AS segment_id, seq, event_id FROM sem_seq", "sem_seq"))
def _(s):
    return story.segment_events(s.semantic_events).select("segment_id", "seq", "event_id")


@query("segment_interaction_counts", sql("""SELECT a.video_id, a.track_id, count(*) - 1 AS interacting_segments FROM sem_seg0 a JOIN sem_seg0 b
 ON a.video_id = b.video_id AND b.start_ms <= a.end_ms + 2000 AND b.end_ms >= a.start_ms - 2000 GROUP BY ALL""", "sem_seg0"))
def _(s):
    return story.interaction_counts(s.stage("segments", lambda: story.story_segments(s.semantic_events)))


KINDS = "complete partial entry_only exit_only minimal".split()


@query("story_metrics", sql("SELECT video_id, count(*) AS segments, CAST(sum(event_count) AS BIGINT) AS covered_events, "
                            + ", ".join(f"count(*) FILTER (WHERE completeness = '{k}') AS {k}_segments" for k in KINDS)
                            + f", {R('avg(narrative_score)', 6)} AS avg_score, {R('max(narrative_score)', 6)} AS max_score FROM sem_seg GROUP BY ALL", "sem_seg"))
def _(s):
    return out(story.story_metrics(story.story_segments(s.semantic_events)),
               "video_id segments covered_events " + " ".join(k + "_segments" for k in KINDS), "avg_score max_score")


@query("story_arcs", sql(f"""SELECT video_id, arc_key, event_count, distinct_types, start_ms, end_ms, greatest(end_ms - start_ms, 0) AS duration_ms,
  {R('avg_confidence', 3)} AS avg_confidence, entry_direction, exit_direction,
  format('{{:02d}}:{{:02d}}', CAST(start_ms AS BIGINT) // 60000, CAST(start_ms AS BIGINT) // 1000 % 60) AS start_text,
  CASE WHEN distinct_types <= 3 THEN array_to_string(types, ' → ') ELSE types[1] || ' → … → ' || types[-1] END AS summary,
  'STORY-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS story_id
 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bo, arc_key) AS rn FROM (
  SELECT video_id, arc_key, count(*) AS event_count, count(DISTINCT event_type) AS distinct_types, min(start_ms) AS start_ms, min({{'a': start_ms, 'b': end_ms, 'c': event_type, 'd': event_id}}) AS bo, max_by(end_ms, n) AS end_ms,
   avg(confidence) FILTER (WHERE confidence > 0) AS avg_confidence, list(direction ORDER BY n)[1] AS entry_direction, list(direction ORDER BY n)[-1] AS exit_direction
  FROM keyed GROUP BY ALL) a JOIN (SELECT video_id, arc_key, list(label ORDER BY f) AS types FROM (
   SELECT video_id, arc_key, min(n) AS f, list_reduce(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS label
   FROM keyed GROUP BY video_id, arc_key, event_type) GROUP BY ALL) t USING (video_id, arc_key))""".replace("FROM keyed", """FROM (SELECT *,
    row_number() OVER (PARTITION BY video_id, arc_key ORDER BY start_ms, end_ms, event_type, event_id) AS n FROM (
     SELECT *, CASE WHEN person_label IS NOT NULL THEN 'person:' || person_label ELSE 'track:' || track_id END AS arc_key FROM actors)) keyed"""), "actors"))
def _(s):
    return out(story.story_arcs(named_events(s)), "video_id arc_key event_count distinct_types start_ms end_ms duration_ms entry_direction exit_direction start_text summary story_id",
               "avg_confidence", 3)


# Graph ------------------------------------------------------------------------------------
@query("same_track_edges", sql("SELECT * FROM st_edges", "st_edges"))
def _(s):
    return graph.same_track_edges(s.semantic_events)


@query("co_occurrence_edges", sql("SELECT * FROM co_edges", "co_edges"))
def _(s):
    return graph.co_occurrence_edges(s.semantic_events)


@query("graph_metrics", sql(f"""SELECT video_id, nodes, isolated_nodes, max_degree, {R('mean_degree', 6)} AS mean_degree, coalesce(edges, 0) AS edges,
 coalesce(same_track_edges, 0) AS same_track_edges, coalesce(co_occurrence_edges, 0) AS co_occurrence_edges FROM (
  SELECT video_id, count(*) AS nodes, count(*) FILTER (WHERE degree = 0) AS isolated_nodes, max(degree) AS max_degree, avg(degree) AS mean_degree FROM deg GROUP BY ALL)
 LEFT JOIN (SELECT video_id, count(*) AS edges, count(*) FILTER (WHERE relationship = 'same_track_temporal') AS same_track_edges,
  count(*) FILTER (WHERE relationship = 'co_occurrence') AS co_occurrence_edges FROM edges GROUP BY ALL) USING (video_id)""", "deg", "edges"))
def _(s):
    return out(graph.graph_metrics(s.semantic_events),
               "video_id nodes isolated_nodes max_degree edges same_track_edges co_occurrence_edges", "mean_degree")


@query("hub_events", sql("""SELECT video_id, event_id, degree, r AS hub_rank FROM (SELECT *, row_number() OVER (
 PARTITION BY video_id ORDER BY degree DESC, event_id) AS r FROM deg) WHERE r <= 5""", "deg"))
def _(s):
    return graph.hub_events(s.semantic_events).select("video_id", "event_id", "degree", "hub_rank")


@query("isolated_events", sql("SELECT video_id, event_id FROM deg WHERE degree = 0", "deg"))
def _(s):
    return graph.isolated_events(s.semantic_events).select("video_id", "event_id")


@query("root_events", sql("SELECT video_id, event_id, event_type FROM deg WHERE in_degree = 0", "deg"))
def _(s):
    return graph.root_events(s.semantic_events).select("video_id", "event_id", "event_type")


@query("centrality", sql(f"SELECT video_id, event_id, {R('degree / (count(*) OVER (PARTITION BY video_id) - 1)', 6)} AS centrality FROM deg", "deg"))
def _(s):
    return out(graph.centrality(s.semantic_events), "video_id event_id", "centrality")


@query("track_subgraphs", sql("SELECT video_id, track_id, source, target, relationship FROM (SELECT e.*, a.track_id, b.track_id AS other FROM edges e JOIN sem a ON a.event_id = e.source JOIN sem b ON b.event_id = e.target) WHERE track_id = other", "edges", "sem"))
def _(s):
    """Edges of co-occurrence join different tracks, so only those along a track can count."""
    return graph.track_subgraphs(s.semantic_events, graph.same_track_edges(s.semantic_events)).select("video_id", "track_id", "source", "target", "relationship")


@query("track_subgraph", sql("SELECT video_id, track_id, event_id, event_type, row_number() OVER (PARTITION BY video_id, track_id ORDER BY start_ms, end_ms, event_type, event_id) - 1 AS position FROM sem", "sem"))
def _(s):
    return graph.track_nodes(s.semantic_events)


_KEY = "CASE WHEN person_label IS NOT NULL THEN 'person:' || person_label ELSE 'track:' || track_id END"


@query("actor_nodes", sql(f"""SELECT video_id, {_KEY} AS actor, CASE WHEN person_label IS NOT NULL THEN 'person' ELSE 'track' END AS actor_kind, count(*) AS event_count,
 min(start_ms) AS first_seen_ms, max(start_ms) AS last_seen_ms, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types,
 (max(start_ms) - min(start_ms)) / 1000.0E0 AS duration_s FROM actors GROUP BY video_id, actor, actor_kind""", "actors"))
def _(s):
    return graph.actor_nodes(named_events(s))


@query("actor_arcs", sql(f"""SELECT video_id, actor, count(*) AS weight, replace(min_by(event_type, n), '_', ' ') || ' → ' || replace(max_by(event_type, n), '_', ' ') AS label
 FROM (SELECT *, {_KEY} AS actor, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, event_type, event_id) AS n FROM actors) GROUP BY video_id, actor HAVING count(*) >= 2""", "actors"))
def _(s):
    return graph.actor_arcs(named_events(s))


@query("actor_co_activity", sql(f"""SELECT a.video_id, a.actor AS source, b.actor AS target, count(*) AS weight, 'Co-active ' || count(*) || '×' AS label
 FROM (SELECT *, {_KEY} AS actor FROM actors) a JOIN (SELECT *, {_KEY} AS actor FROM actors) b ON a.video_id = b.video_id AND a.actor < b.actor
  AND abs(a.start_ms - b.start_ms) <= 10000 GROUP BY ALL""", "actors"))
def _(s):
    return graph.actor_co_activity(named_events(s))


# Ranking, policy, validation --------------------------------------------------------------
@query("event_importance", sql("SELECT event_id, " + ", ".join(f"{R(c, 4)} AS {c}" for c in ("i_detection", "i_rarity", "i_motion", "i_salience")) + ", importance FROM fev_imp", "fev_imp"))
def _(s):
    kept, _d = fusion.fusion_filter(fused_of(s))
    return ranking.event_importance(kept, profiles_of(s)).select("event_id", "i_detection", "i_rarity", "i_motion", "i_salience", "importance")


def ranked_semantic(s: Inputs):
    """Semantic tracks have no motion profile, so importance takes its default for motion."""
    ev = s.semantic_events
    none = s.spark.createDataFrame([], "video_id long, track_id long, avg_speed double, is_stationary boolean").where(F.lit(False))  # the optimizer drops a join with it
    return ranking.rank_segments(s.stage("segments", lambda: story.story_segments(ev)), ranking.event_importance(ev, none))


@query("rank_segments", sql("SELECT " + outs("video_id track_id rank", "importance_score narrative_score combined_rank", 4) + " FROM sem_rank", "sem_rank"))
def _(s):
    return ranked_semantic(s).select("video_id", "track_id", "rank", "importance_score", "narrative_score", "combined_rank")


@query("compression_policy", sql("SELECT video_id, track_id, rank, keep, reason FROM sem_pol", "sem_pol"))
def _(s):
    return compression.compression_policy(ranked_semantic(s)).select("video_id", "track_id", "rank", "keep", "reason")


@query("compression_policy_per_event", sql("""SELECT video_id, track_id, rank, CASE g WHEN 'complete' THEN true WHEN 'low' THEN false ELSE cum - event_count < budget END AS keep
 FROM (SELECT *, sum(CASE WHEN g = 'candidate' THEN event_count ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rank) AS cum FROM sem_g JOIN sem_bud USING (video_id))""", "sem_g", "sem_bud"))
def _(s):
    return compression.compression_policy(ranked_semantic(s), atomic=False).select("video_id", "track_id", "rank", "keep")


@query("compression_metrics", sql(f"""SELECT video_id, CAST(sum(event_count) AS BIGINT) AS total_events, CAST(coalesce(sum(event_count) FILTER (WHERE keep), 0) AS BIGINT) AS kept_events,
  CAST(coalesce(sum(event_count) FILTER (WHERE NOT keep), 0) AS BIGINT) AS discarded_events, count(*) FILTER (WHERE keep) AS kept_segments, count(*) FILTER (WHERE NOT keep) AS discarded_segments,
  {R('coalesce(sum(event_count) FILTER (WHERE keep), 0) / sum(event_count)', 4)} AS ratio_achieved,
  {R("CASE WHEN count(*) FILTER (WHERE completeness = 'complete') > 0 THEN count(*) FILTER (WHERE completeness = 'complete' AND keep) / count(*) FILTER (WHERE completeness = 'complete') ELSE 1.0E0 END", 4)} AS completeness_retained,
  {R('coalesce(avg(event_count) FILTER (WHERE keep), 0)', 4)} AS avg_chain_length FROM sem_pol GROUP BY ALL""", "sem_pol"))
def _(s):
    return compression.compression_metrics(compression.compression_policy(ranked_semantic(s)))


@query("summary_events", sql("SELECT event_id FROM sem JOIN sem_pol USING (video_id, track_id) WHERE keep", "sem", "sem_pol"))
def _(s):
    return compression.summary_events(s.semantic_events, compression.compression_policy(ranked_semantic(s))).select("event_id")


@query("decision_manifest", sql("SELECT segment_id, rank, completeness, event_count, combined_rank, keep, reason FROM sem_pol", "sem_pol"))
def _(s):
    r = ranked_semantic(s)
    return compression.decision_manifest(r, compression.compression_policy(r)).select(
        "segment_id", "rank", "completeness", "event_count", "combined_rank", "keep", "reason")


_ISSUES = f"""(WITH kept_ev AS (SELECT s.* FROM sem s JOIN b_uni USING (video_id, event_id)), kept_seg AS (SELECT video_id, track_id, completeness FROM sem_pol WHERE keep),
 per AS (SELECT video_id, track_id, completeness, bool_or(event_type IN {IN(fixed.ENTRY_TYPES)}) AS e, bool_or(event_type IN {IN(fixed.EXIT_TYPES)}) AS x, bool_or(event_type IN {IN(fixed.ACTION_TYPES)}) AS a,
  min((start_ms, end_ms, event_type, event_id)) AS f, max((start_ms, end_ms, event_type, event_id)) AS l FROM kept_ev JOIN kept_seg USING (video_id, track_id) GROUP BY ALL)
 SELECT video_id, 'error' AS severity, 'complete_chain_integrity' AS "check", track_id, CAST(NULL AS BIGINT) AS event_id,
  concat_ws(', ', CASE WHEN NOT e THEN 'entry' END, CASE WHEN NOT a THEN 'action' END, CASE WHEN NOT x THEN 'exit' END) AS detail FROM per WHERE completeness = 'complete' AND NOT (e AND a AND x)
 UNION ALL SELECT video_id, 'warning', 'no_chain_starts_with_exit', track_id, f[4], f[3] FROM per WHERE f[3] IN {IN(fixed.EXIT_TYPES)}
 UNION ALL SELECT video_id, 'warning', 'no_chain_ends_with_entry', track_id, l[4], l[3] FROM per WHERE l[3] IN {IN(fixed.ENTRY_TYPES)}
 UNION ALL SELECT video_id, 'error', 'no_orphaned_events', track_id, event_id, event_type FROM kept_ev ANTI JOIN kept_seg USING (video_id, track_id)
 UNION ALL SELECT k.video_id, 'warning', 'graph_connectivity', k.track_id, k.event_id, CAST(d.source AS VARCHAR) FROM st_edges d JOIN kept_ev k ON d.target = k.event_id
  WHERE d.source NOT IN (SELECT event_id FROM kept_ev))"""


def _kept(s: Inputs):
    """Events a uniform sample would keep against the chains the policy keeps: breaks every check."""
    dec = s.stage("decisions", lambda: compression.compression_policy(ranked_semantic(s)))
    return s.stage("uniform", lambda: evaluation.baseline_uniform(s.semantic_events)), dec.where("keep").select("video_id", "track_id")


@query("validate_narrative", sql("SELECT * FROM " + _ISSUES, "sem", "sem_pol", "b_uni", "st_edges"))
def _(s):
    ke, ks = _kept(s)
    ev = s.semantic_events
    return validation.validate_narrative(s.stage("segments", lambda: story.story_segments(ev)), ev, ks, ke)


@query("validation_report", sql(f"""SELECT video_id, chains_checked, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(orphaned_events, 0) AS orphaned_events,
 c - coalesce(b, 0) AS complete_chains_intact, coalesce(errors, 0) = 0 AS is_valid FROM (SELECT video_id, count(*) AS chains_checked, count(*) FILTER (WHERE completeness = 'complete') AS c
  FROM sem_pol WHERE keep GROUP BY ALL) LEFT JOIN (SELECT video_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
  count(*) FILTER (WHERE "check" = 'no_orphaned_events') AS orphaned_events, count(*) FILTER (WHERE "check" = 'complete_chain_integrity') AS b FROM {_ISSUES} GROUP BY ALL) USING (video_id)""", "sem", "sem_pol", "b_uni", "st_edges"))
def _(s):
    ke, ks = _kept(s)
    ev = s.semantic_events
    seg = s.stage("segments", lambda: story.story_segments(ev))
    return validation.validation_report(validation.validate_narrative(seg, ev, ks, ke), ks, seg)


def decision_chain(s: Inputs):
    """Observations to decisions: rules, fusion, stories, ranking, policy."""
    kept, _d = fusion.fusion_filter(fused_of(s))
    segments = s.stage("kept_segments", lambda: story.story_segments(kept))
    ranked = ranking.rank_segments(segments, ranking.event_importance(kept, profiles_of(s)))
    return kept, ranked, compression.compression_policy(ranked)


@query("budget_decisions", sql("""SELECT video_id, track_id, segment_id, rank, completeness, event_count, combined_rank, keep, reason FROM fev_pol""", "fev_pol"))
def _(s):
    _e, _r, d = decision_chain(s)
    return d.select("video_id", "track_id", "segment_id", "rank", "completeness", "event_count", "combined_rank", "keep", "reason")
