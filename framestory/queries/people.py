"""Detection, tracking, identity, activity, interaction and zone queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.functions.numbers import rounded
from framestory.operators import activity, detections, identity, interactions, posture, tracking, tracks, zones
from framestory.queries.motion import profiles_of, tracks_of
from framestory.queries.registry import query
from framestory.queries.shape import out, outs
from framestory.queries.sqlviews import CASE, IN, VIEWS, R, sql, view
from framestory.sources.fixtures import Inputs

IOU_SQL = """CASE WHEN least({a}x2, {b}x2) > greatest({a}x1, {b}x1) AND least({a}y2, {b}y2) > greatest({a}y1, {b}y1) THEN
 (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1)
 - (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))) ELSE 0.0E0 END"""


def IOU(a: str, b: str) -> str:
    return IOU_SQL.format(a=a, b=b)


# Detections ---------------------------------------------------------------------------
_CLASS = """CASE obs_id % 11 WHEN 0 THEN 'cell_phone' WHEN 1 THEN 'Teddy Bear' WHEN 2 THEN 'child' WHEN 3 THEN 'truck' WHEN 4 THEN 'coffee mug' WHEN 5 THEN 'newspaper'
 WHEN 6 THEN 'sofa bed' WHEN 7 THEN 'drone' ELSE class_name END"""
view("det", f"SELECT obs_id AS det_id, video_id, frame_number, timestamp_ms, {_CLASS} AS class_name, confidence * 0.5E0 - 0.05E0 AS confidence, x1, y1, x2, y2 FROM obs", "obs")
view("det3", """SELECT obs_id * 3 + k AS det_id, video_id, frame_number, class_name, confidence - 0.05E0 * k AS confidence, x1 + 0.03E0 * k AS x1, y1, x2 + 0.03E0 * k AS x2, y2
 FROM obs, (VALUES (0), (1), (2)) t(k)""", "obs")


def det_of(s: Inputs):
    return s.observations.selectExpr("obs_id AS det_id", "video_id", "frame_number", "timestamp_ms", f"{_CLASS} AS class_name",
                                     "confidence * 0.5E0 - 0.05E0 AS confidence", "x1", "y1", "x2", "y2")


def crowded_of(s: Inputs):
    """Every box three times, shifted and less certain."""
    return s.observations.selectExpr("explode(array(0, 1, 2)) AS k", "*").selectExpr(
        "obs_id * 3 + k AS det_id", "video_id", "frame_number", "class_name", "confidence - 0.05E0 * k AS confidence",
        "x1 + 0.03E0 * k AS x1", "y1", "x2 + 0.03E0 * k AS x2", "y2")


@query("bbox_geometry", sql("SELECT det_id, " + ", ".join(f"{R(e, 6)} AS {n}" for n, e in (
    ("cx", "(x1 + x2) / 2"), ("cy", "(y1 + y2) / 2"), ("w", "x2 - x1"), ("h", "y2 - y1"), ("area", "(x2 - x1) * (y2 - y1)"), ("aspect", "(x2 - x1) / (y2 - y1)"))) + " FROM det", "det"))
def _(s):
    return out(detections.bbox_geometry(det_of(s)), "det_id", "cx cy w h area aspect")


_PAIR_SQL = "FROM obs a JOIN obs b ON a.video_id = b.video_id AND a.frame_number = b.frame_number AND a.track_id < b.track_id"


def pairs_of(s: Inputs):
    cols = ["video_id", "frame_number", "track_id", "x1", "y1", "x2", "y2"]
    a = g.prefixed(s.observations.select(*cols), "a_", ["video_id", "frame_number"])
    b = g.prefixed(s.observations.select(*cols), "b_", ["video_id", "frame_number"])
    return a.join(b, ["video_id", "frame_number"]).where("a_track_id < b_track_id")


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


@query("box_overlap", sql(f"""SELECT a.video_id, a.frame_number, a.track_id AS a_track_id, b.track_id AS b_track_id, {R(IOU('a.', 'b.'), 6)} AS iou, {R(_INTER + ' / greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1e-6)', 6)} AS iop,
 {R('sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2)', 6)} AS distance {_PAIR_SQL} WHERE {_INTER} > 0""", "obs"))
def _(s):
    d = pairs_of(s).withColumn("iou", g.iou("a_", "b_")).where(F.col("iou") > 0).withColumn("iop", g.inside_share("a_", "b_")).withColumn("distance", g.centre_distance("a_", "b_"))
    return out(d, "video_id frame_number a_track_id b_track_id", "iou iop distance")


@query("normalise_boxes", sql("SELECT det_id, " + ", ".join(f"{R(c, 6)} AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM det", "det"))
def _(s):
    px = det_of(s).withColumns({c: F.when(F.col("det_id") % 2 == 0, F.col(c) * k).otherwise(F.col(c)) for c, k in (("x1", 848), ("y1", 478), ("x2", 848), ("y2", 478))})
    return out(detections.normalise_boxes(px, 848, 478), "det_id", "x1 y1 x2 y2")


@query("expand_roi", sql("""SELECT det_id, greatest(CAST(trunc(x1 * 848 - pw * 0.5E0 / 2.0E0) AS BIGINT), 0) AS rx1, greatest(CAST(trunc(y1 * 478 - ph * 0.5E0 / 2.0E0) AS BIGINT), 0) AS ry1,
 least(CAST(trunc(x2 * 848 + pw * 0.5E0 / 2.0E0) AS BIGINT), 848) AS rx2, least(CAST(trunc(y2 * 478 + ph * 0.5E0 / 2.0E0) AS BIGINT), 478) AS ry2
 FROM (SELECT *, greatest(x2 * 848 - x1 * 848, 1.0E0) AS pw, greatest(y2 * 478 - y1 * 478, 1.0E0) AS ph FROM det)""", "det"))
def _(s):
    return detections.expand_roi(det_of(s), 848, 478).select("det_id", "rx1", "ry1", "rx2", "ry2")


_TILES = """SELECT video_id, width, height, x AS tx, y AS ty, least(x + 200, width) AS tx2, least(y + 200, height) AS ty2 FROM videos, range(0, 640, 160) t(x), range(0, 480, 160) u(y)
 WHERE (x = 0 OR x - 160 + 200 < width) AND (y = 0 OR y - 160 + 200 < height)"""


@query("tile_grid", sql(_TILES, "videos"))
def _(s):
    return detections.tile_grid(s.videos, 200, 0.2)


@query("tile_to_frame", sql(f"SELECT video_id, tx, ty, {R('(0.25E0 * (tx2 - tx) + tx) / width', 6)} AS fx1, {R('(0.1E0 * (ty2 - ty) + ty) / height', 6)} AS fy1, {R('(0.75E0 * (tx2 - tx) + tx) / width', 6)} AS fx2, {R('(0.9E0 * (ty2 - ty) + ty) / height', 6)} AS fy2 FROM ({_TILES})", "videos"))
def _(s):
    d = detections.tile_grid(s.videos, 200, 0.2).withColumns({"x1": F.lit(0.25), "y1": F.lit(0.1), "x2": F.lit(0.75), "y2": F.lit(0.9)})
    return out(detections.tile_to_frame(d), "video_id tx ty", "fx1 fy1 fx2 fy2")


view("nms_in", "SELECT *, row_number() OVER (PARTITION BY video_id, frame_number, class_name ORDER BY confidence DESC, det_id) AS i FROM det3", "det3")
_KI = IOU("k.", "d.")
view("nms_walk", f"""SELECT video_id, frame_number, class_name, i, det_id, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS keep FROM nms_in WHERE i = 1
 UNION ALL SELECT d.video_id, d.frame_number, d.class_name, d.i, d.det_id, CASE WHEN len(list_filter(w.kept, lambda k: {_KI} > 0.5E0)) = 0 THEN list_append(w.kept, {{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) ELSE w.kept END,
  len(list_filter(w.kept, lambda k: {_KI} > 0.5E0)) = 0 FROM nms_walk w JOIN nms_in d ON d.video_id = w.video_id AND d.frame_number = w.frame_number AND d.class_name = w.class_name AND d.i = w.i + 1""", "nms_in")


@query("nms_by_class", sql("SELECT det_id FROM nms_walk WHERE keep", "nms_walk"))
def _(s):
    return detections.nms_by_class(crowded_of(s), 0.5).select("det_id")


_THR = "coalesce(" + CASE("replace(lower(class_name), '_', ' ')", fixed.CLASS_CONFIDENCE, None).replace("ELSE None", "ELSE NULL") + ", " + CASE("lower(class_name)", fixed.CLASS_CONFIDENCE, fixed.CLASS_CONFIDENCE_DEFAULT) + ")"


@query("per_class_confidence", sql(f"SELECT det_id, class_name FROM det WHERE confidence >= {_THR}", "det"))
def _(s):
    return detections.per_class_confidence(det_of(s)).select("det_id", "class_name")


@query("detection_summary", sql(f"""SELECT video_id, class_name, detections, frames_with, video_frames, {R('mean_confidence', 6)} AS mean_confidence, {R('frames_with / video_frames', 6)} AS rate FROM (
 SELECT video_id, class_name, count(*) AS detections, count(DISTINCT frame_number) AS frames_with, avg(confidence) AS mean_confidence FROM det GROUP BY ALL
 UNION ALL SELECT video_id, '*', count(*), count(DISTINCT frame_number), avg(confidence) FROM det GROUP BY ALL) JOIN (SELECT video_id, count(DISTINCT frame_number) AS video_frames FROM det GROUP BY ALL) USING (video_id)""", "det"))
def _(s):
    return out(detections.detection_summary(det_of(s)), "video_id class_name detections frames_with video_frames", "mean_confidence rate")


_CAT = ("CASE " + " ".join(f"WHEN k IN {IN(v)} THEN '{c}'" for c, v in fixed.CATEGORY_MEMBERS.items()) + " "
        + " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in fixed.CATEGORY_KEYWORDS) + " ELSE 'object' END")


@query("display_category", sql(f"SELECT class_name, {_CAT} AS category, count(*) AS n FROM (SELECT class_name, trim(lower(class_name)) AS k FROM det) GROUP BY ALL", "det"))
def _(s):
    return det_of(s).groupBy("class_name", detections.category_of(F.col("class_name")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_ID_CAT = "CASE " + " ".join(f"WHEN class_id IN ({', '.join(map(str, ids))}) THEN '{c}'" for c, ids in fixed.CLASS_ID_CATEGORY.items()) + " END"


@query("display_category_by_number", sql(f"SELECT class_id, coalesce({_ID_CAT}, {_CAT}) AS category, count(*) AS n FROM (SELECT det_id % 85 AS class_id, trim(lower(class_name)) AS k FROM det) GROUP BY ALL", "det"))
def _(s):
    d = det_of(s).withColumn("class_id", F.col("det_id") % 85)
    return d.groupBy("class_id", detections.category_of(F.col("class_name"), F.col("class_id")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# Tracking -------------------------------------------------------------------------------
view("trk_det", """SELECT obs_id AS det_id, video_id, frame_number, class_name, confidence, x1, y1, x2, y2, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS frame_rank FROM obs""", "obs")
_CAND = f"SELECT a.video_id, a.det_id AS a, b.det_id AS b, {IOU('a.', 'b.')} AS iou FROM trk_det a JOIN trk_det b ON a.video_id = b.video_id AND a.class_name = b.class_name AND b.frame_rank = a.frame_rank + 1"
view("cands", f"SELECT * FROM ({_CAND}) WHERE iou >= 0.05E0", "trk_det")


def tracker_detections(s: Inputs):
    return s.observations.withColumnRenamed("obs_id", "det_id").drop("track_id", "seq")


def ranked_detections(s: Inputs):
    def build():
        d = tracker_detections(s)
        return d.join(tracking.frame_ranks(d), ["video_id", "frame_number"])

    return s.stage("ranked_detections", build)


@query("iou_candidates", sql(f"SELECT video_id, a, b, {R('iou', 6)} AS iou FROM cands", "cands"))
def _(s):
    return out(tracking.iou_candidates(ranked_detections(s), 1, 0.05), "video_id a b", "iou")


view("greedy_in", "SELECT *, row_number() OVER (PARTITION BY video_id, rank ORDER BY iou DESC, a, b) AS i FROM (SELECT c.*, t.frame_rank AS rank FROM cands c JOIN trk_det t ON t.video_id = c.video_id AND t.det_id = c.a)", "cands", "trk_det")
view("greedy_walk", """SELECT video_id, rank, i, a, b, [a] AS ua, [b] AS ub, true AS take FROM greedy_in WHERE i = 1
 UNION ALL SELECT c.video_id, c.rank, c.i, c.a, c.b, CASE WHEN NOT list_contains(w.ua, c.a) AND NOT list_contains(w.ub, c.b) THEN list_append(w.ua, c.a) ELSE w.ua END,
  CASE WHEN NOT list_contains(w.ua, c.a) AND NOT list_contains(w.ub, c.b) THEN list_append(w.ub, c.b) ELSE w.ub END, NOT list_contains(w.ua, c.a) AND NOT list_contains(w.ub, c.b)
 FROM greedy_walk w JOIN greedy_in c ON c.video_id = w.video_id AND c.rank = w.rank AND c.i = w.i + 1""", "greedy_in")


@query("link_one_to_one", sql("SELECT video_id, a, b FROM greedy_walk WHERE take", "greedy_walk"))
def _(s):
    return tracking.link_one_to_one(tracking.iou_candidates(ranked_detections(s), 1, 0.05)).select("video_id", "a", "b")


view("pairs0", VIEWS["cands"][1].replace("WHERE iou >= 0.05E0", "WHERE iou > 0"), "trk_det")
view("edges0", "SELECT e.*, t.frame_rank AS rank, count(*) OVER (PARTITION BY e.video_id, t.frame_rank, a) AS da, count(*) OVER (PARTITION BY e.video_id, t.frame_rank, b) AS db FROM pairs0 e JOIN trk_det t ON t.video_id = e.video_id AND t.det_id = e.a", "pairs0", "trk_det")
view("fought", "SELECT *, row_number() OVER (PARTITION BY video_id, rank ORDER BY a, b) AS i FROM edges0 WHERE da > 1 OR db > 1", "edges0")
view("matchings", """SELECT DISTINCT video_id, rank, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub, CAST(0 AS DOUBLE) AS total FROM fought
 UNION ALL SELECT w.video_id, w.rank, e.i, CASE WHEN t.take THEN list_append(w.ua, e.a) ELSE w.ua END, CASE WHEN t.take THEN list_append(w.ub, e.b) ELSE w.ub END, w.total + CASE WHEN t.take THEN e.iou ELSE 0 END
 FROM matchings w JOIN fought e ON e.video_id = w.video_id AND e.rank = w.rank AND e.i = w.i + 1, (VALUES (true), (false)) t(take) WHERE NOT t.take OR NOT (list_contains(w.ua, e.a) OR list_contains(w.ub, e.b))""", "fought")


@query("link_optimal", sql(f"""SELECT video_id, rank AS frame_rank, {R('sum(total)', 6)} AS total_iou FROM (SELECT video_id, rank, iou AS total FROM edges0 WHERE da = 1 AND db = 1
 UNION ALL SELECT video_id, rank, max(total) FROM matchings GROUP BY ALL) GROUP BY ALL""", "edges0", "matchings"))
def _(s):
    """Total overlap of the best assignment of every frame pair."""
    links = tracking.optimal_links(tracking.iou_candidates(ranked_detections(s), 1, 1e-12), 0.0)
    return links.groupBy("video_id", "frame_rank").agg(rounded(F.sum("iou"), 6).alias("total_iou"))


@query("track_batch")
def _(s):
    return tracking.track_batch(tracker_detections(s)).select("video_id", "track_id", "det_id", "frame_number")


def lifecycle_of(s: Inputs):
    return s.stage("lifecycle", lambda: tracking.track_lifecycle(tracker_detections(s)))


@query("track_lifecycle")
def _(s):
    return lifecycle_of(s)


@query("lifecycle_tracks")
def _(s):
    return tracking.lifecycle_tracks(lifecycle_of(s))


# Identity -----------------------------------------------------------------------------------
_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), b.embedding)"
view("gal", """SELECT video_id, 'Person ' || true_person AS person_label, track_count, list_transform(m, lambda v: v / (sqrt(list_sum(list_transform(m, lambda x: x * x))) + 1e-8)) AS embedding FROM (
 SELECT video_id, true_person, count(*) AS track_count, [""" + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(64)) + """] AS m FROM temb GROUP BY video_id, true_person)""", "temb")


def gallery_of(s: Inputs):
    d = s.track_embeddings.withColumn("person_label", F.concat(F.lit("Person "), F.col("true_person").cast("string")))
    return identity.mean_gallery(d, "person_label", 64)


@query("gallery_matches", sql(f"""SELECT video_id, track_id, person_label, {R('sim', 6)} AS similarity FROM (SELECT a.video_id, a.track_id, b.person_label, {_DOT} AS sim, row_number() OVER (PARTITION BY a.video_id, a.track_id ORDER BY {_DOT} DESC, b.person_label) AS r
 FROM temb a JOIN gal b USING (video_id)) WHERE r = 1 AND sim >= 0.3E0""", "temb", "gal"))
def _(s):
    return out(identity.gallery_matches(s.track_embeddings, gallery_of(s), 0.3), "video_id track_id person_label", "similarity")


def assigned_of(s: Inputs):
    """Assignment with a threshold that gives both joins and new persons on this data; every 13th track has no crop."""
    d = s.track_embeddings.withColumn("embedding", F.when(F.col("track_id") % 13 != 0, F.col("embedding")))
    return s.stage("assigned", lambda: identity.reid_assign(d, 0.45))


@query("reid_assign")
def _(s):
    return out(assigned_of(s), "video_id track_id person_label is_new", "similarity")


@query("consolidate_gallery")
def _(s):
    d = s.track_embeddings.join(assigned_of(s).select("video_id", "track_id", "person_label"), ["video_id", "track_id"])
    gal = identity.mean_gallery(d, "person_label", 64).withColumn("person_no", F.regexp_extract("person_label", "([0-9]+)", 1).cast("long"))
    return identity.consolidate_gallery(gal, 0.30)


@query("person_gallery", sql("""SELECT video_id, 'Person ' || true_person AS person_label, min(start_ms) AS first_seen_ms, max(end_ms) AS last_seen_ms, CAST(sum(greatest(observation_count, 1)) AS BIGINT) AS observation_count, count(*) AS track_count,
 arg_min(CASE track_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'bottom' END || (track_id % 3), track_id) AS entry_direction FROM temb GROUP BY ALL""", "temb"))
def _(s):
    d = s.track_embeddings.selectExpr("*", "concat('Person ', true_person) AS person_label",
                                      "concat(CASE track_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'bottom' END, track_id % 3) AS entry_direction")
    return identity.person_gallery(d)


# Activity ---------------------------------------------------------------------------------------
view("bobs", "SELECT * REPLACE (CASE WHEN class_name = 'car' AND track_id % 12 = 0 THEN 'bicycle' ELSE class_name END AS class_name) FROM obs", "obs")
view("btracks", "SELECT * REPLACE (CASE WHEN class_name = 'car' AND track_id % 12 = 0 THEN 'bicycle' ELSE class_name END AS class_name) FROM tracks", "tracks")
view("feat", f"""SELECT video_id, track_id, min_by(class_name, seq) AS class_name, count(*) AS n_obs, count(dx) AS n_steps, avg(v) AS mean_speed, max(v) AS max_speed, stddev_pop(v) AS speed_std, avg(vy) AS mean_vy, avg(abs(vy)) AS mean_abs_vy,
  stddev_pop(vy) AS vy_std, avg(abs(dx / 0.2E0)) AS mean_abs_vx, count(*) FILTER (WHERE vy < -0.005E0) AS n_up, count(*) FILTER (WHERE vy > 0.005E0) AS n_down, avg(y2 - y1) AS height_mean, stddev_pop(y2 - y1) AS height_std, min(y2 - y1) AS height_min, max(y2 - y1) AS height_max,
  avg(x2 - x1) AS width_mean, stddev_pop(x2 - x1) AS width_std, avg(cx) AS mean_cx, avg(cy) AS mean_cy, abs(max_by(cx, seq) - min_by(cx, seq)) AS horizontal_move, abs(max_by(cy, seq) - min_by(cy, seq)) AS vertical_move,
  min(frame_number) AS first_frame, max(frame_number) AS last_frame, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, max(timestamp_ms) - min(timestamp_ms) AS duration_ms
 FROM (SELECT *, sqrt(dx * dx + dy * dy) / 0.2E0 AS v, dy / 0.2E0 AS vy FROM (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM bobs) WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq)))
 GROUP BY video_id, track_id""", "bobs")
FEAT = "mean_speed max_speed speed_std mean_vy mean_abs_vy vy_std mean_abs_vx height_mean height_std height_min height_max width_mean width_std horizontal_move vertical_move"


def bike_obs(s: Inputs):
    return s.observations.withColumn("class_name", F.expr("CASE WHEN class_name = 'car' AND track_id % 12 = 0 THEN 'bicycle' ELSE class_name END"))


def bike_tracks(s: Inputs):
    return tracks_of(s).withColumn("class_name", F.expr("CASE WHEN class_name = 'car' AND track_id % 12 = 0 THEN 'bicycle' ELSE class_name END"))


def features_of(s: Inputs):
    return s.stage("features", lambda: activity.track_features(bike_obs(s)))


@query("track_features", sql("SELECT video_id, track_id, class_name, n_obs, n_up, n_down, " + ", ".join(f"{R(c, 6)} AS {c}" for c in FEAT.split())
                             + f", {R('mean_speed - 0.018E0', 6)} AS speed_margin, {R('0.03E0 - height_std', 6)} AS height_margin FROM feat", "feat"))
def _(s):
    return out(features_of(s), "video_id track_id class_name n_obs n_up n_down", FEAT + " speed_margin height_margin")


def _cycling_view(name: str, overlap: bool, require: bool) -> None:
    cond = "AND b.first_frame <= f.last_frame AND b.last_frame >= f.first_frame" if overlap else ""
    need = "AND f.video_id IN (SELECT video_id FROM bikes)" if require else ""
    view(name, f"""SELECT f.*, coalesce((SELECT min_by(greatest(0.7E0, 0.95E0 - d * 2), track_id) FROM (SELECT b.track_id, sqrt((f.mean_cx - b.mean_cx) ** 2 + (f.mean_cy - b.mean_cy) ** 2) AS d FROM bikes b WHERE b.video_id = f.video_id {cond}) WHERE d < 0.25E0),
      CASE WHEN mean_speed >= 0.018E0 AND height_std < 0.03E0 {need} THEN 0.65E0 ELSE 0.0E0 END) AS cycling_conf FROM feat f""", "feat", "bikes")


view("bikes", "SELECT f.* FROM feat f JOIN btracks t USING (video_id, track_id) WHERE t.is_confirmed AND f.class_name IN ('bicycle', 'bike', 'cycle', 'motorbike', 'motorcycle', 'scooter')", "feat", "btracks")
_cycling_view("cyc", False, True)
_cycling_view("cyc_overlap", True, False)


@query("cycling_signal", sql(f"SELECT video_id, track_id, {R('cycling_conf', 6)} AS cycling_conf FROM cyc", "cyc"))
def _(s):
    return out(activity.cycling_signal(features_of(s), bike_tracks(s)), "video_id track_id", "cycling_conf")


@query("cycling_signal_overlap", sql(f"SELECT video_id, track_id, {R('cycling_conf', 6)} AS cycling_conf FROM cyc_overlap", "cyc_overlap"))
def _(s):
    return out(activity.cycling_signal(features_of(s), bike_tracks(s), require_overlap=True, require_bicycle=False), "video_id track_id", "cycling_conf")


view("stair", """SELECT *, CASE WHEN n_steps < 4 OR share < 0.5E0 THEN 0.0E0 ELSE least((share * 0.6E0 + least(mean_abs_vy / 0.015E0, 1.0E0) * 0.4E0) * CASE WHEN mean_speed < 0.004E0 THEN 0.5E0 ELSE 1.0E0 END, 0.93E0) END AS stair_conf,
 CASE WHEN n_steps < 4 OR n_up > n_down THEN 'up' ELSE 'down' END AS stair_direction FROM (SELECT *, greatest(n_up, n_down) / n_steps AS share FROM cyc)""", "cyc")


@query("stair_signal", sql(f"SELECT video_id, track_id, stair_direction, {R('stair_conf', 6)} AS stair_conf FROM stair", "stair"))
def _(s):
    return out(activity.stair_signal(features_of(s)), "video_id track_id stair_direction", "stair_conf")


def _activity_sql(n: str, min_obs: int) -> None:
    view(n, f"""SELECT *, CASE WHEN n_obs < {max(min_obs, 2)} THEN 'entering_scene' WHEN cycling_conf >= 0.6E0 THEN 'cycling' WHEN stair_conf >= 0.55E0 AND mean_speed >= 0.008E0 THEN 'walking_' || stair_direction || 'stairs'
      WHEN mean_speed >= 0.022E0 THEN 'running' WHEN mean_speed >= 0.008E0 THEN 'walking' WHEN mean_speed < 0.003E0 AND duration_ms > 12000 THEN 'loitering' WHEN mean_speed < 0.003E0 THEN 'standing' ELSE 'walking' END AS activity,
     CASE WHEN n_obs < {max(min_obs, 2)} THEN 0.75E0 WHEN cycling_conf >= 0.6E0 THEN cycling_conf WHEN stair_conf >= 0.55E0 AND mean_speed >= 0.008E0 THEN stair_conf WHEN mean_speed >= 0.022E0 THEN least(0.95E0, 0.7E0 + (mean_speed - 0.022E0) * 10)
      WHEN mean_speed >= 0.008E0 THEN least(0.92E0, 0.65E0 + mean_speed * 8) WHEN mean_speed < 0.003E0 AND duration_ms > 12000 THEN 0.75E0 WHEN mean_speed < 0.003E0 THEN 0.8E0 ELSE 0.55E0 END AS activity_conf FROM stair""", "stair")


_activity_sql("act", 3)


def labelled_of(s: Inputs):
    return s.stage("labelled", lambda: activity.classify_activity(activity.stair_signal(activity.cycling_signal(features_of(s), bike_tracks(s)))))


@query("classify_activity", sql(f"SELECT video_id, track_id, activity, {R('activity_conf', 6)} AS activity_conf FROM act", "act"))
def _(s):
    return out(labelled_of(s), "video_id track_id activity", "activity_conf")


view("stairs", "SELECT video_id, frame_number, confidence / 10 AS confidence, x1 - 0.1E0 AS x1, y1 - 0.1E0 AS y1, x2 + 0.1E0 AS x2, y2 + 0.1E0 AS y2 FROM obs WHERE class_name = 'backpack'", "obs")
view("guard0", f"""SELECT o.video_id, o.track_id, o.frame_number, s.confidence, {_INTER.replace('a.', 'o.').replace('b.', 's.')} / greatest((o.x2 - o.x1) * (o.y2 - o.y1), 1e-6) AS iop
 FROM obs o JOIN stair t ON t.video_id = o.video_id AND t.track_id = o.track_id JOIN stairs s ON s.video_id = o.video_id AND s.frame_number = o.frame_number WHERE o.seq % greatest(t.n_obs // 10, 1) = 0""", "obs", "stair", "stairs")
view("guard", """SELECT *, stair_conf * (0.3E0 + 0.7E0 * quality) AS final_conf FROM (SELECT *, CASE WHEN persistence >= 2 AND max_iop >= 0.15E0 THEN least(1.0E0, scene_conf / 0.05E0 * (persistence / 5.0E0) * least(1.0E0, max_iop / 0.2E0)) ELSE 0.0E0 END AS quality FROM (
 SELECT t.video_id, t.track_id, t.stair_conf, t.mean_speed, coalesce(persistence, 0) AS persistence, coalesce(scene_conf, 0.0E0) AS scene_conf, coalesce(max_iop, 0.0E0) AS max_iop FROM stair t LEFT JOIN (
  SELECT video_id, track_id, count(DISTINCT frame_number) FILTER (WHERE confidence >= 0.02E0 AND iop >= 0.15E0) AS persistence, max(confidence) AS scene_conf, max(iop) AS max_iop FROM guard0 GROUP BY ALL) USING (video_id, track_id)))""", "stair", "guard0")


def stairs_of(s: Inputs):
    return s.observations.where("class_name = 'backpack'").selectExpr(
        "video_id", "frame_number", "confidence / 10 AS confidence", "x1 - 0.1E0 AS x1", "y1 - 0.1E0 AS y1", "x2 + 0.1E0 AS x2", "y2 + 0.1E0 AS y2")


def guarded_of(s: Inputs):
    return activity.stair_context(activity.stair_signal(features_of(s)), s.observations, stairs_of(s))


@query("stair_context", sql(f"""SELECT video_id, track_id, persistence, final_conf >= 0.55E0 AS is_verified, CASE WHEN final_conf < 0.55E0 THEN CASE WHEN mean_speed >= 0.022E0 THEN 'running' ELSE 'walking' END END AS fallback,
 {R('scene_conf', 6)} AS scene_conf, {R('max_iop', 6)} AS max_iop, {R('quality', 6)} AS quality, {R('final_conf', 6)} AS final_conf FROM guard""", "guard"))
def _(s):
    return out(guarded_of(s), "video_id track_id persistence is_verified fallback", "scene_conf max_iop quality final_conf")


_EFF = "(CASE WHEN persistence >= 2 THEN scene_conf ELSE 0.0E0 END)"


@query("stair_policies", sql(f"""SELECT video_id, track_id, {R(f'stair_conf * (0.3E0 + 0.7E0 * least(1.0E0, {_EFF} / 0.05E0))', 6)} AS policy_b,
 {R(f'0.5E0 * stair_conf + 0.35E0 * least(1.0E0, {_EFF} / 0.05E0) + 0.15E0 * least(1.0E0, CASE WHEN persistence >= 2 THEN persistence ELSE 0 END / 5.0E0)', 6)} AS policy_c, {R(f'stair_conf * (0.35E0 + 0.65E0 * sqrt(least(1.0E0, {_EFF} / 0.05E0)))', 6)} AS policy_d FROM guard""", "guard"))
def _(s):
    d = guarded_of(s).withColumns({"policy_b": activity.stair_policy_b(), "policy_c": activity.stair_policy_c(), "policy_d": activity.stair_policy_d()})
    return out(d, "video_id track_id", "policy_b policy_c policy_d")


_NO_BIKE = "activity = 'cycling' AND video_id NOT IN (SELECT video_id FROM btracks WHERE is_confirmed AND class_name IN ('bicycle', 'bike', 'motorcycle') AND track_id % 24 = 0)"


@query("cycling_sanity", sql(f"""SELECT video_id, track_id, CASE WHEN {_NO_BIKE} THEN CASE WHEN mean_speed < 0.04E0 THEN 'walking' ELSE 'running' END ELSE activity END AS activity,
 {R(f'CASE WHEN {_NO_BIKE} THEN 0.8E0 ELSE activity_conf END', 6)} AS activity_conf FROM act""", "act", "btracks"))
def _(s):
    named = bike_tracks(s).withColumn("class_name", F.expr("CASE WHEN class_name = 'bicycle' AND track_id % 24 <> 0 THEN 'unicycle' ELSE class_name END"))
    return out(activity.cycling_sanity(labelled_of(s), named), "video_id track_id activity", "activity_conf")


_TAIL = CASE("activity", fixed.ACTIVITY_TAILS, "")


@query("narrative_events", sql(f"""SELECT video_id, track_id, activity AS event_type, {R('activity_conf', 6)} AS confidence, first_frame AS start_frame, last_frame AS end_frame, 'Track-' || track_id || {_TAIL} AS description FROM act
 WHERE class_name = 'person' AND activity IN {IN(fixed.NARRATIVE_LABELS)}""", "act"))
def _(s):
    return out(activity.narrative_events(labelled_of(s)), "video_id track_id event_type start_frame end_frame description", "confidence")


@query("loitering", sql("SELECT video_id, track_id, length_ms FROM tracks JOIN prof USING (video_id, track_id) WHERE is_stationary AND length_ms >= 5000", "tracks", "prof"))
def _(s):
    return activity.loitering(tracks_of(s).withColumn("class_name", F.lit("person")), profiles_of(s)).select("video_id", "track_id", "length_ms")


# Posture -----------------------------------------------------------------------------------------------
view("post0", """SELECT o.*, (y2 - y1) / (x2 - x1) AS aspect, b.baseline FROM obs o JOIN (SELECT video_id, track_id, coalesce(avg(a) FILTER (WHERE a >= 1.4), avg(a)) AS baseline FROM (SELECT *, (y2 - y1) / (x2 - x1) AS a, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM obs)
 WHERE n >= 3 AND seq < greatest(2, n // 4) GROUP BY ALL HAVING baseline >= 1.4) b USING (video_id, track_id)""", "obs")
_HIT = "(CASE WHEN w.sitting THEN p.aspect >= p.baseline * 0.8E0 ELSE p.aspect < p.baseline * 0.99E0 END)"
view("post", f"""SELECT DISTINCT video_id, track_id, CAST(-1 AS BIGINT) AS seq, false AS sitting, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS start_frame, CAST(NULL AS BIGINT) AS sat_frame, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS BIGINT) AS ev_start, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BIGINT) AS end_frame, CAST(NULL AS DOUBLE) AS sitting_ms FROM post0
 UNION ALL SELECT p.video_id, p.track_id, p.seq, CASE WHEN {_HIT} AND w.n = 1 THEN NOT w.sitting ELSE w.sitting END, CASE WHEN {_HIT} AND w.n = 0 THEN 1 ELSE 0 END, CASE WHEN {_HIT} AND w.n = 0 THEN p.frame_number END, CASE WHEN {_HIT} AND w.n = 1 AND NOT w.sitting THEN w.start_frame ELSE w.sat_frame END,
  CASE WHEN {_HIT} AND w.n = 1 THEN CASE WHEN w.sitting THEN 'person_standing_up' ELSE 'person_sitting' END END, CASE WHEN {_HIT} AND w.n = 1 THEN w.start_frame END,
  CASE WHEN {_HIT} AND w.n = 1 THEN CASE WHEN w.sitting THEN 0.8E0 ELSE {R('least(0.9E0, 0.55E0 + (p.baseline - p.aspect) / p.baseline * 0.35E0)', 4)} END END, p.frame_number, CASE WHEN {_HIT} AND w.n = 1 AND w.sitting THEN (w.start_frame - w.sat_frame) * 40.0E0 END
 FROM post w JOIN post0 p ON p.video_id = w.video_id AND p.track_id = w.track_id AND p.seq = w.seq + 1""", "post0")


@query("posture_transitions", sql("SELECT video_id, track_id, event_type, ev_start AS start_frame, end_frame, ev_start * 40.0E0 AS start_ms, end_frame * 40.0E0 AS end_ms, confidence, sitting_ms FROM post WHERE event_type IS NOT NULL", "post"))
def _(s):
    return posture.posture_transitions(s.observations, drop=0.99)


view("nearo", "SELECT video_id, track_id AS object_id, class_name AS object_class, frame_number AS of, (x1 + x2) / 2 AS ox, (y1 + y2) / 2 AS oy FROM obs WHERE class_name IN ('backpack', 'bottle')", "obs")
view("nearp", """SELECT video_id, track_id, frame_number, timestamp_ms, object_id, object_class, d FROM (SELECT p.*, o.object_id, o.object_class, sqrt((p.cx - o.ox) ** 2 + (p.cy - o.oy) ** 2) AS d, row_number() OVER (PARTITION BY p.obs_id, o.object_id ORDER BY abs(p.frame_number - o.of), o.of) AS r
 FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM obs WHERE class_name = 'person') p JOIN nearo o USING (video_id)) WHERE r = 1 AND d <= 0.25E0""", "obs", "nearo")


@query("near_object", sql(f"""SELECT video_id, track_id, object_id, object_class, 'person_near_' || object_class AS event_type, count(*) AS frames_near, min(frame_number) AS start_frame, max(frame_number) AS end_frame, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms,
  {R('avg(d)', 6)} AS avg_distance, {R('least(0.85E0, 0.5E0 + (1.0E0 - avg(d) / 0.25E0) * 0.35E0)', 6)} AS confidence FROM (SELECT *, sum(CASE WHEN frame_number - pf <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id, object_id ORDER BY frame_number) AS run FROM (
   SELECT *, lag(frame_number) OVER (PARTITION BY video_id, track_id, object_id ORDER BY frame_number) AS pf FROM nearp)) GROUP BY video_id, track_id, object_id, object_class, run HAVING count(*) >= 2""", "nearp"))
def _(s):
    return out(posture.near_object(s.observations, ["backpack", "bottle"]), "video_id track_id object_id object_class event_type frames_near start_frame end_frame start_ms end_ms", "avg_distance confidence")


# Keypoints from the embedding values: x and y around the middle, scores from the absolute value.
_KP = "transform(sequence(0, 16), i -> array(0.5D + CAST(embedding[3 * i] AS DOUBLE), 0.5D + CAST(embedding[3 * i + 1] AS DOUBLE), least(1.0D, abs(CAST(embedding[3 * i + 2] AS DOUBLE)) * 6)))"
view("kps", """SELECT vec_id % 4 AS video_id, CAST(label AS BIGINT) AS track_id, vec_id AS frame_number, vec_id * 40.0E0 AS timestamp_ms,
 list_transform(range(17), lambda i: [0.5E0 + CAST(embedding[3 * i + 1] AS DOUBLE), 0.5E0 + CAST(embedding[3 * i + 2] AS DOUBLE), least(1.0E0, abs(CAST(embedding[3 * i + 3] AS DOUBLE)) * 6)]) AS k FROM embeddings""")


def _kp_mean(c: int, *idx: int) -> str:
    n = " + ".join(f"CAST(k[{i + 1}][3] >= 0.3E0 AS INT)" for i in idx)
    t = " + ".join(f"CASE WHEN k[{i + 1}][3] >= 0.3E0 THEN k[{i + 1}][{c}] ELSE 0.0E0 END" for i in idx)
    return f"CASE WHEN {n} > 0 THEN ({t}) / ({n}) ELSE 0.0E0 END"


view("kpm", "SELECT video_id, track_id, frame_number, timestamp_ms, " + ", ".join(f"{_kp_mean(c, *i)} AS {n}{'xyc'[c - 1]}" for n, i in (
    ("sh", (5, 6)), ("hip", (11, 12)), ("knee", (13, 14)), ("lw", (9,)), ("rw", (10,)), ("la", (15,)), ("ra", (16,))) for c in (1, 2, 3)) + " FROM kps", "kps")
view("poses", """SELECT video_id, track_id, frame_number, timestamp_ms, coalesce(r < 0.4, false) AS is_sitting, coalesce(r > 0.5, false) AS is_standing, coalesce(sp > 0.12, false) AS is_walking, u IS NOT NULL AS is_reaching_up,
 CASE WHEN r < 0.4 THEN least(1.0E0, (0.4E0 - r) / 0.4E0 * hipc * kneec) ELSE 0.0E0 END AS sit_conf, CASE WHEN r > 0.5 THEN least(1.0E0, (r - 0.5E0) / 0.5E0 * hipc * kneec) ELSE 0.0E0 END AS stand_conf,
 CASE WHEN sp > 0.12 THEN least(1.0E0, sp * 3.0E0 * (lac + rac) / 2) ELSE 0.0E0 END AS walk_conf, coalesce(least(1.0E0, greatest(u, 0.0E0)), 0.0E0) AS reach_conf FROM (SELECT *,
  CASE WHEN hipc > 0.3 AND kneec > 0.3 AND shc > 0.3 AND abs(hipy - shy) > 0.01 THEN abs(kneey - hipy) / abs(hipy - shy) END AS r, CASE WHEN lac > 0.3 AND rac > 0.3 THEN abs(lax - rax) END AS sp,
  CASE WHEN shc > 0.3 THEN greatest(CASE WHEN lwc > 0.3 AND lwy < shy - 0.03 THEN (shy - lwy) * lwc * 5.0E0 END, CASE WHEN rwc > 0.3 AND rwy < shy - 0.03 THEN (shy - rwy) * rwc * 5.0E0 END) END AS u FROM kpm)""", "kpm")
POSE = "video_id track_id frame_number is_sitting is_standing is_walking is_reaching_up"
POSE_F = "sit_conf stand_conf walk_conf reach_conf"


def poses_of(s: Inputs):
    k = s.table("embeddings").select((F.col("vec_id") % 4).alias("video_id"), F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("frame_number"),
                                     (F.col("vec_id") * F.lit(40.0)).alias("timestamp_ms"), F.expr(_KP).alias("keypoints"))
    return s.stage("poses", lambda: posture.classify_pose(k).drop("keypoints"))


@query("classify_pose", sql("SELECT " + outs(POSE, POSE_F) + " FROM poses", "poses"))
def _(s):
    return out(poses_of(s), POSE, POSE_F)


view("pact", """SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_number) AS seq, CASE WHEN b IS NULL THEN CASE WHEN wc IS NOT NULL THEN 'walking' ELSE 'none' END WHEN wc > b THEN 'walking' ELSE ba END AS activity FROM (
 SELECT *, CASE WHEN is_sitting AND sit_conf > 0.3 THEN sit_conf WHEN is_standing AND stand_conf > 0.3 THEN stand_conf END AS b, CASE WHEN is_sitting AND sit_conf > 0.3 THEN 'sitting' ELSE 'standing' END AS ba, CASE WHEN is_walking AND walk_conf > 0.3 THEN walk_conf END AS wc FROM poses)""", "poses")
view("prun", """SELECT video_id, track_id, run, activity, count(*) AS frames, min(frame_number) AS sf, max(frame_number) AS lf FROM (SELECT *, sum(new) OVER (PARTITION BY video_id, track_id ORDER BY seq) AS run FROM (
 SELECT *, CASE WHEN lag(activity) OVER (PARTITION BY video_id, track_id ORDER BY seq) = activity THEN 0 ELSE 1 END AS new FROM pact)) GROUP BY ALL""", "pact")
view("prun2", "SELECT *, coalesce(lead(sf) OVER (PARTITION BY video_id, track_id ORDER BY run), lf) AS ef FROM prun", "prun")
view("reach_in", "SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_number) AS i FROM poses WHERE is_reaching_up AND reach_conf > 0.4", "poses")
view("reach_walk", """SELECT video_id, track_id, i, frame_number, frame_number AS last, true AS kept, reach_conf FROM reach_in WHERE i = 1 UNION ALL SELECT r.video_id, r.track_id, r.i, r.frame_number, CASE WHEN r.frame_number - w.last > 20 THEN r.frame_number ELSE w.last END, r.frame_number - w.last > 20, r.reach_conf
 FROM reach_walk w JOIN reach_in r ON r.video_id = w.video_id AND r.track_id = w.track_id AND r.i = w.i + 1""", "reach_in")


@query("pose_events", sql(f"""SELECT video_id, track_id, CASE WHEN activity = 'sitting' THEN 'person_sitting' WHEN activity = 'walking' THEN 'person_walking' WHEN EXISTS (SELECT 1 FROM prun q WHERE q.video_id = r.video_id AND q.track_id = r.track_id AND q.run < r.run AND q.activity = 'sitting' AND q.frames >= 2)
  THEN 'person_standing_up' ELSE 'person_standing' END AS event_type, sf AS start_frame, ef AS end_frame, sf * 40.0E0 AS start_ms, ef * 40.0E0 AS end_ms, frames,
  {R("(SELECT coalesce(avg(c), 0.5E0) FROM (SELECT CASE r.activity WHEN 'sitting' THEN sit_conf WHEN 'standing' THEN stand_conf ELSE walk_conf END AS c FROM poses p WHERE p.video_id = r.video_id AND p.track_id = r.track_id AND p.frame_number BETWEEN r.sf AND r.ef) WHERE c > 0)", 6)} AS confidence
 FROM prun2 r WHERE activity <> 'none' AND frames >= 2
 UNION ALL SELECT video_id, track_id, 'person_reaching_up', frame_number, frame_number, frame_number * 40.0E0, frame_number * 40.0E0, 1, {R('reach_conf', 6)} FROM reach_walk WHERE kept""", "prun", "prun2", "poses", "reach_walk"))
def _(s):
    return out(posture.pose_events(poses_of(s)), "video_id track_id event_type start_frame end_frame start_ms end_ms frames", "confidence")


_POSE_ROWS = "video_id, track_id, frame_number + obs_id % 4 AS frame_number, obs_id % 5 < 2 AS is_sitting, obs_id % 7 < 3 AS is_walking, obs_id % 5 = 3 AS is_standing"
view("posr", f"SELECT {_POSE_ROWS} FROM obs WHERE class_name = 'person'", "obs")
view("plabel", """SELECT obs_id, CASE WHEN a > 0.5 THEN 'sitting' WHEN b > 0.4 THEN 'walking' WHEN c > 0.4 THEN 'standing' END AS pose_label FROM (SELECT obs_id, avg(CAST(is_sitting AS INT)) AS a, avg(CAST(is_walking AS INT)) AS b, avg(CAST(is_standing AS INT)) AS c
 FROM obs o JOIN posr p ON p.video_id = o.video_id AND p.track_id = o.track_id AND abs(p.frame_number - o.frame_number) <= 3 WHERE o.class_name = 'person' GROUP BY ALL)""", "obs", "posr")


def pose_rows(s: Inputs):
    return s.observations.where("class_name = 'person'").selectExpr(*[x.strip() for x in _POSE_ROWS.split(",")])


@query("pose_label_near", sql("SELECT obs_id, pose_label FROM plabel", "plabel"))
def _(s):
    return posture.pose_label_near(s.observations.where("class_name = 'person'"), pose_rows(s))


_UP = lambda c: f"list_sort(list({c}))[count(*) // 2 + 1]"
view("seats", f"SELECT video_id, track_id, {_UP('(x1 + x2) / 2')} AS seat_cx, {_UP('(y1 + y2) / 2')} AS seat_cy FROM obs WHERE class_name = 'bottle' GROUP BY ALL", "obs")


def seats_of(s: Inputs):
    return s.stage("seats", lambda: posture.seat_centroids(s.observations, ["bottle"]))


@query("seat_centroids", sql(f"SELECT video_id, track_id, {R('seat_cx', 6)} AS seat_cx, {R('seat_cy', 6)} AS seat_cy FROM seats", "seats"))
def _(s):
    return out(seats_of(s), "video_id track_id", "seat_cx seat_cy")


view("smv", """SELECT *, coalesce(avg(v) OVER (PARTITION BY video_id, track_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0E0) AS sv FROM (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) / (greatest(frame_number - lag(frame_number) OVER w, 1) / 25.0E0) AS v
 FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM obs) WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq))""", "obs")


@query("smoothed_velocity", sql(f"SELECT obs_id, {R('sv', 6)} AS smoothed_velocity FROM smv", "smv"))
def _(s):
    return out(posture.smoothed_velocity(s.observations), "obs_id", "smoothed_velocity")


view("mach", """SELECT m.*, EXISTS (SELECT 1 FROM seats s WHERE s.video_id = m.video_id AND sqrt((m.cx - s.seat_cx) ** 2 + (m.cy - s.seat_cy) ** 2) < 0.28E0) AS near, pose_label AS pose, cx < 0.12 OR cx > 1 - 0.12E0 OR cy < 0.12 OR cy > 1 - 0.12E0 AS edge,
 max(seq) OVER (PARTITION BY m.video_id, m.track_id) AS last_seq FROM smv m LEFT JOIN plabel USING (obs_id) WHERE class_name = 'person'""", "smv", "seats", "plabel")
_SEAT, _STILL, _GO = "(m.near OR coalesce(m.pose = 'sitting', false))", "m.sv < 0.03E0", "m.sv >= 0.08E0"
_ROSE = "m.cy < w.ref - 0.04E0"
_UPOUT = f"({_GO} OR {_ROSE} OR (NOT m.near AND coalesce(m.pose IN ('standing', 'walking'), false)))"
_NEXT = f"""CASE w.st WHEN 'start' THEN 'entering' WHEN 'entering' THEN CASE WHEN {_GO} THEN 'walking' WHEN {_STILL} THEN CASE WHEN {_SEAT} THEN 'sitting' ELSE 'standing' END ELSE 'entering' END
 WHEN 'walking' THEN CASE WHEN {_STILL} THEN CASE WHEN {_SEAT} THEN 'sitting' ELSE 'standing' END ELSE 'walking' END WHEN 'standing' THEN CASE WHEN {_GO} THEN CASE WHEN m.edge THEN 'exiting' ELSE 'walking' END WHEN {_SEAT} THEN 'sitting' ELSE 'standing' END
 WHEN 'sitting' THEN CASE WHEN {_UPOUT} THEN CASE WHEN {_GO} THEN 'walking' ELSE 'standing' END ELSE 'sitting' END ELSE CASE WHEN NOT m.edge AND m.sv > 0.03E0 THEN 'walking' ELSE 'exiting' END END"""
view("mwalk", f"""SELECT DISTINCT video_id, track_id, CAST(-1 AS BIGINT) AS seq, 'start' AS st, CAST(NULL AS DOUBLE) AS ref, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BIGINT) AS frame_number FROM mach
 UNION ALL SELECT video_id, track_id, seq, nx, CASE WHEN nx = 'sitting' AND st <> 'sitting' THEN cy - 0.04E0 WHEN nx = 'sitting' THEN ref END, CASE WHEN st = 'start' THEN 'person_entered_scene' WHEN nx = 'sitting' AND st <> 'sitting' THEN 'person_sitting' WHEN st = 'walking' AND nx = 'standing' THEN 'person_standing'
   WHEN st = 'standing' AND nx = 'walking' THEN 'person_walking' WHEN st = 'sitting' AND nx <> 'sitting' THEN 'person_standing_up' END,
  CASE WHEN st = 'start' THEN 0.9E0 WHEN nx = 'sitting' AND st = 'entering' THEN 0.8E0 WHEN nx = 'sitting' AND st = 'walking' THEN 0.85E0 WHEN nx = 'sitting' AND st = 'standing' THEN 0.88E0 WHEN st = 'sitting' AND nx <> 'sitting' THEN CASE WHEN rose THEN 0.85E0 ELSE 0.82E0 END ELSE 0.75E0 END, frame_number
 FROM (SELECT m.video_id, m.track_id, m.seq, m.cy, m.frame_number, w.st, w.ref, {_NEXT} AS nx, {_ROSE} AS rose FROM mwalk w JOIN mach m ON m.video_id = w.video_id AND m.track_id = w.track_id AND m.seq = w.seq + 1)""", "mach")


@query("activity_state_machine", sql("""SELECT video_id, track_id, event_type, frame_number, frame_number * 40.0E0 AS timestamp_ms, confidence FROM mwalk WHERE event_type IS NOT NULL
 UNION ALL SELECT video_id, track_id, 'person_left_scene', frame_number, timestamp_ms, CASE WHEN edge THEN 0.9E0 ELSE 0.75E0 END FROM mach WHERE seq = last_seq AND last_seq >= 1""", "mwalk", "mach"))
def _(s):
    return posture.activity_state_machine(posture.machine_inputs(s.observations, seats_of(s), pose_rows(s)))


def machine_of(s: Inputs):
    return s.stage("machine", lambda: posture.activity_state_machine(posture.machine_inputs(s.observations, seats_of(s))))


view("mach2", "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS pose) FROM mach", "mach")
VIEWS["mwalk2"] = (["mach2"], VIEWS["mwalk"][1].replace("FROM mach\n", "FROM mach2\n").replace("JOIN mach m", "JOIN mach2 m").replace("FROM mwalk w", "FROM mwalk2 w"))


@query("replace_with_state_machine", sql("""SELECT rule_name, event_type, count(*) AS n FROM (SELECT rule_name, event_type FROM rule_events WHERE class_name <> 'person' UNION ALL
  SELECT 'activity_state_machine', event_type FROM mwalk2 WHERE event_type IS NOT NULL UNION ALL SELECT 'activity_state_machine', 'person_left_scene' FROM mach WHERE seq = last_seq AND last_seq >= 1) GROUP BY ALL""", "rule_events", "mwalk2", "mach"))
def _(s):
    from framestory.operators import events
    from framestory.queries.events import rule_events_of
    m = machine_of(s).select("video_id", "track_id", "event_type", F.lit("activity_state_machine").alias("rule_name"), "confidence",
                             F.col("frame_number").alias("start_frame"), F.col("frame_number").alias("end_frame"), F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"))
    return events.replace_with_state_machine(rule_events_of(s), m).groupBy("rule_name", "event_type").agg(F.count(F.lit(1)).alias("n"))


# Lower boxes on every fifth frame make crouching, crawling and lowering states appear.
_SQUASH = "CASE WHEN (seq % 40) < 12 THEN y1 + (y2 - y1) * 0.7E0 WHEN (seq % 40) < 20 THEN y1 + (y2 - y1) * 0.5E0 ELSE y2 END"
view("sq", f"SELECT * REPLACE ({_SQUASH} + 0.1E0 * CAST(seq % 40 >= 20 AS INT) AS y2) FROM obs WHERE class_name = 'person'", "obs")


def squashed(s: Inputs):
    return s.observations.where("class_name = 'person'").withColumn("y2", F.expr(f"{_SQUASH} + 0.1E0 * CAST(seq % 40 >= 20 AS INT)"))


view("pcand", """SELECT *, CASE WHEN asp >= 1.8 AND h < 0.12E0 THEN 'FALLEN' WHEN h < 0.15E0 AND lat >= 0.003E0 THEN 'CRAWLING' WHEN h < 0.18E0 THEN 'CROUCHING' WHEN h1 < h3 - 0.03E0 THEN 'LOWERING' WHEN lat >= 0.02E0 THEN 'RUNNING' WHEN lat >= 0.005E0 THEN 'WALKING' WHEN h >= 0.2E0 THEN 'STANDING' ELSE 'UNKNOWN' END AS c,
  max(seq) OVER (PARTITION BY video_id, track_id) AS last_seq FROM (
 SELECT *, coalesce(abs(cx - lag(cx) OVER w), 0.0E0) AS lat, lag(h, 1) OVER w AS h1, lag(h, 3) OVER w AS h3 FROM (SELECT *, x1 + (x2 - x1) / 2 AS cx, y2 - y1 AS h, (x2 - x1) / greatest(y2 - y1, 0.001E0) AS asp FROM sq) WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq))""", "sq")
_NN = "(CASE WHEN c.c = w.cand THEN w.n + 1 ELSE 1 END)"
_TURN = f"({_NN} >= 2 AND c.c <> w.cur)"
_OPEN = "w.cur NOT IN ('UNKNOWN', 'STANDING', 'WALKING') AND w.start > 0"
view("pfsm", f"""SELECT DISTINCT video_id, track_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS frame_number, 'UNKNOWN' AS cur, 'UNKNOWN' AS cand, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS ev, CAST(NULL AS BIGINT) AS ev_start, false AS running FROM pcand
 UNION ALL SELECT c.video_id, c.track_id, c.seq, c.frame_number, CASE WHEN {_TURN} THEN c.c ELSE w.cur END, c.c, CASE WHEN {_TURN} THEN 0 ELSE {_NN} END, CASE WHEN {_TURN} THEN c.frame_number ELSE w.start END, CASE WHEN {_TURN} AND {_OPEN} THEN w.cur END, CASE WHEN {_TURN} AND {_OPEN} THEN w.start END,
  (CASE WHEN {_TURN} THEN c.c ELSE w.cur END) = 'RUNNING' AND c.c = 'RUNNING' FROM pfsm w JOIN pcand c ON c.video_id = w.video_id AND c.track_id = w.track_id AND c.seq = w.seq + 1""", "pcand")
view("pspan", """SELECT w.video_id, w.track_id, w.ev AS state, w.ev_start AS sf, w.frame_number AS ef FROM pfsm w WHERE ev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prunw r WHERE r.video_id = w.video_id AND r.track_id = w.track_id AND r.ef = w.frame_number)
 UNION ALL SELECT video_id, track_id, 'RUNNING', sf, ef FROM prunw
 UNION ALL SELECT w.video_id, w.track_id, w.cur, w.start, w.frame_number FROM pfsm w JOIN (SELECT DISTINCT video_id, track_id, last_seq FROM pcand) l ON l.video_id = w.video_id AND l.track_id = w.track_id AND l.last_seq = w.seq WHERE w.cur NOT IN ('UNKNOWN', 'STANDING', 'WALKING') AND w.start > 0""", "pfsm", "prunw", "pcand")
view("prunw", """SELECT video_id, track_id, min(rf) AS sf, max(rf) AS ef FROM (SELECT w.video_id, w.track_id, w.seq, c.frame_number AS rf FROM pfsm w JOIN pcand c ON c.video_id = w.video_id AND c.track_id = w.track_id AND c.seq BETWEEN w.seq - 19 AND w.seq AND c.c = 'RUNNING' WHERE w.running)
 GROUP BY video_id, track_id, seq HAVING count(*) = 3""", "pfsm", "pcand")
_MIN = CASE("state", posture.POSE_MINIMUM, 1)


@query("temporal_pose_fsm", sql(f"""SELECT video_id, track_id, {CASE('state', posture.POSE_EVENT, '')} AS event_type, sf AS start_frame, ef AS end_frame, n AS supporting, sf * 40.0E0 AS start_ms, ef * 40.0E0 AS end_ms,
  least({R(f'least(n / ({_MIN} * 2.0E0), 1.0E0) * greatest(n / CAST(ef - sf + 1 AS DOUBLE), 0.3E0) * 0.5E0 + 0.1E0', 3)}, 0.95E0) AS confidence FROM (
 SELECT s.*, (SELECT count(*) FROM pcand c WHERE c.video_id = s.video_id AND c.track_id = s.track_id AND c.c = s.state AND c.frame_number BETWEEN s.sf AND s.ef) AS n FROM pspan s) WHERE n >= {_MIN} AND state IN {IN(posture.POSE_EVENT)}""", "pspan", "pcand"))
def _(s):
    return out(posture.temporal_pose_fsm(squashed(s)), "video_id track_id event_type start_frame end_frame supporting start_ms end_ms", "confidence", 3)


# Interactions ----------------------------------------------------------------------------------------------
_OBJ = """CASE track_id % 18 WHEN 1 THEN 'backpack' WHEN 7 THEN 'cell_phone' WHEN 13 THEN 'laptop' WHEN 2 THEN 'bottle' WHEN 8 THEN 'book' WHEN 14 THEN 'tv' WHEN 0 THEN 'keys' WHEN 6 THEN 'box' WHEN 12 THEN 'suitcase' ELSE class_name END"""
view("iobs", f"SELECT * REPLACE ({_OBJ} AS class_name) FROM obs", "obs")
view("itracks", f"SELECT * REPLACE ({_OBJ} AS class_name) FROM tracks", "tracks")


def item_obs(s: Inputs):
    """Observations whose objects have many different classes."""
    return s.observations.withColumn("class_name", F.expr(_OBJ))


def item_tracks(s: Inputs):
    return tracks_of(s).withColumn("class_name", F.expr(_OBJ))


def _close(name: str, classes, dist: float) -> None:
    view(name, f"""SELECT p.video_id, p.frame_number, p.track_id AS person_id, o.track_id AS object_id, o.class_name AS object_class, p.x1 AS px1, p.y1 AS py1 FROM iobs p JOIN iobs o ON p.video_id = o.video_id AND p.frame_number = o.frame_number AND p.track_id <> o.track_id
     WHERE p.class_name IN {IN(fixed.PERSON_CLASSES)} AND o.class_name IN {IN(classes)} AND (sqrt(((p.x1 + p.x2) / 2 - (o.x1 + o.x2) / 2) ** 2 + ((p.y1 + p.y2) / 2 - (o.y1 + o.y2) / 2) ** 2) < {dist}E0 OR {IOU('p.', 'o.')} > 0)""", "iobs")


_WANT = sorted(set(fixed.PHONE_CLASSES + fixed.LAPTOP_CLASSES + fixed.DRINK_CLASSES + fixed.BOOK_CLASSES + fixed.SCREEN_CLASSES + fixed.PICK_UP_CLASSES + fixed.POCKET_CLASSES))
_close("iclose", _WANT, 0.30)
_close("bclose", fixed.BAG_CLASSES, 0.30)
_close("cclose", fixed.CARRY_CLASSES, 0.20)


@query("close_frames", sql("SELECT video_id, frame_number, person_id, object_id, object_class FROM iclose", "iclose"))
def _(s):
    return interactions.close_frames(item_obs(s), _WANT).select("video_id", "frame_number", "person_id", "object_id", "object_class")


view("ipair", """SELECT video_id, person_id, object_id, object_class, count(*) AS n, min(frame_number) AS fc, max(frame_number) AS lc, count(*) * 5 / 25.0E0 AS s FROM iclose GROUP BY ALL""", "iclose")
view("iall", f"""SELECT i.*, p.first_frame AS pf, p.last_frame AS pl, o.first_frame AS of, o.last_frame AS ol, (SELECT max_by((y1 + y2) / 2, frame_number) FROM iobs e WHERE e.video_id = i.video_id AND e.track_id = i.object_id) AS ey FROM ipair i
 JOIN itracks p ON p.video_id = i.video_id AND p.track_id = i.person_id AND p.n_obs >= 2 JOIN itracks o ON o.video_id = i.video_id AND o.track_id = i.object_id""", "ipair", "itracks", "iobs")
_USE = [(fixed.PHONE_CLASSES, 1.0, "person_using_phone", "least(0.85E0, 0.6E0 + s * 0.05E0)"), (fixed.LAPTOP_CLASSES, 2.0, "person_using_laptop", "least(0.88E0, 0.65E0 + s * 0.03E0)"),
        (fixed.DRINK_CLASSES, 1.5, "person_drinking", "least(0.8E0, 0.55E0 + s * 0.07E0)"), (fixed.BOOK_CLASSES, 1.5, "person_reading", "least(0.82E0, 0.6E0 + s * 0.04E0)"), (fixed.SCREEN_CLASSES, 8.0, "person_watching_screen", "least(0.78E0, 0.55E0 + s * 0.02E0)")]
_PICK = f"object_class IN {IN(fixed.PICK_UP_CLASSES)}"
_CASES = [(f"object_class IN {IN(c)} AND s >= {t}E0", f"'{k}'", v) for c, t, k, v in _USE] + [
    (f"{_PICK} AND ol < pl - 5 AND n >= 2 AND lc >= ol - 5", "'person_picked_up_' || object_class", "CASE WHEN n >= 4 THEN 0.72E0 ELSE 0.6E0 END"), (f"{_PICK} AND of > pf + 10 AND n >= 2 AND fc >= of - 5", "'person_placed_' || object_class", "0.65E0"),
    (f"NOT {_PICK} AND object_class IN {IN(fixed.POCKET_CLASSES)} AND ey > 0.45E0 AND n >= 2", "'person_pocketed_object'", "0.68E0")]
view("iev", "SELECT *, CASE " + " ".join(f"WHEN {c} THEN {k}" for c, k, _v in _CASES) + " END AS event_type, CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _k, v in _CASES) + " END AS confidence FROM iall", "iall")


def interactions_of(s: Inputs):
    return s.stage("interactions", lambda: interactions.interactions(item_obs(s), item_tracks(s)))


@query("interactions", sql(f"SELECT video_id, person_id AS track_id, event_type, object_id, object_class, n AS n_close, fc AS start_frame, lc AS end_frame, {R('s', 6)} AS close_seconds, {R('confidence', 6)} AS confidence FROM iev WHERE event_type IS NOT NULL", "iev"))
def _(s):
    return out(interactions_of(s), "video_id track_id event_type object_id object_class n_close start_frame end_frame", "close_seconds confidence")


@query("interaction_counts_by_type", sql("SELECT event_type, count(*) AS n, count(DISTINCT person_id) AS persons FROM iev WHERE event_type IS NOT NULL GROUP BY ALL", "iev"))
def _(s):
    return interactions_of(s).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("persons"))


@query("unattended_bag", sql(f"""SELECT video_id, track_id AS object_id, class_name AS object_class, first_frame AS start_frame, last_frame AS end_frame, {R('(last_frame - first_frame) * 5 / 25.0E0', 6)} AS duration_s, {R('least(0.88E0, 0.65E0 + (last_frame - first_frame) * 5 / 25.0E0 * 0.01E0)', 6)} AS confidence
 FROM itracks t WHERE class_name IN {IN(fixed.BAG_CLASSES)} AND n_obs >= 3 AND (last_frame - first_frame) * 5 / 25.0E0 >= 10 AND NOT EXISTS (SELECT 1 FROM bclose c WHERE c.video_id = t.video_id AND c.object_id = t.track_id AND c.person_id % 15 = 3 GROUP BY person_id HAVING count(*) >= 2)""", "itracks", "bclose"))
def _(s):
    named = item_obs(s).withColumn("class_name", F.expr("CASE WHEN class_name = 'person' AND track_id % 15 <> 3 THEN 'figure' ELSE class_name END"))
    return out(interactions.unattended_bag(named, item_tracks(s)), "video_id object_id object_class start_frame end_frame", "duration_s confidence")


view("gsamp", """SELECT video_id, frame_number AS fr FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS i FROM (SELECT DISTINCT video_id, frame_number FROM obs WHERE class_name = 'person')) WHERE i % 10 = 0""", "obs")
view("gnear", """SELECT video_id, fr, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM (SELECT g.fr, o.*, row_number() OVER (PARTITION BY g.video_id, g.fr, o.track_id ORDER BY abs(o.frame_number - g.fr), o.frame_number) AS r FROM gsamp g JOIN obs o ON o.video_id = g.video_id AND abs(o.frame_number - g.fr) <= 10 AND o.class_name = 'person') WHERE r = 1""", "gsamp", "obs")


@query("group_gathering", sql("""SELECT video_id, count(*) AS gathering_frames, min(fr) AS start_frame, max(fr) AS end_frame FROM (SELECT a.video_id, a.fr FROM gnear a JOIN gnear b ON a.video_id = b.video_id AND a.fr = b.fr AND a.track_id < b.track_id
  WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < 0.25E0 GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL HAVING count(*) >= 3""", "gnear"))
def _(s):
    return interactions.group_gathering(s.observations).select("video_id", "gathering_frames", "start_frame", "end_frame")


_FLAT = "CASE WHEN track_id % 4 = 3 OR track_id % 6 = 4 THEN y1 + (y2 - y1) * 0.3E0 ELSE y2 END"


@query("person_fallen", sql(f"""SELECT video_id, track_id, count(*) AS fallen_frames, min(frame_number) AS start_frame, max(frame_number) AS end_frame, {R('max(cx) - min(cx) + max(cy) - min(cy)', 6)} AS motion, {R('least(0.82E0, 0.55E0 + count(*) * 0.03E0)', 6)} AS confidence FROM (
 SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM (SELECT * REPLACE ({_FLAT} AS y2) FROM obs WHERE class_name = 'person')) WHERE (x2 - x1) / (y2 - y1) > 1.2 GROUP BY video_id, track_id HAVING count(*) >= 5 AND max(cx) - min(cx) + max(cy) - min(cy) < 0.5E0""", "obs"))
def _(s):
    return out(interactions.person_fallen(s.observations.withColumn("y2", F.expr(_FLAT)), max_motion=0.5), "video_id track_id fallen_frames start_frame end_frame", "motion confidence")


@query("person_carrying", sql(f"""SELECT video_id, person_id, object_id, object_class, n_close, start_frame, end_frame, {R('motion', 6)} AS motion, {R('least(0.78E0, 0.6E0 + n_close * 5 / 25.0E0 * 0.02E0)', 6)} AS confidence FROM (SELECT video_id, person_id, object_id, object_class, count(*) AS n_close, min(frame_number) AS start_frame, max(frame_number) AS end_frame,
  abs(max_by(px1, frame_number) - min_by(px1, frame_number)) + abs(max_by(py1, frame_number) - min_by(py1, frame_number)) AS motion FROM cclose GROUP BY ALL) JOIN itracks t ON t.video_id = video_id AND t.track_id = object_id WHERE n_close >= 5 AND motion >= 0.05E0 AND n_obs >= 3""".replace("t.video_id = video_id", "t.video_id = q.video_id").replace("GROUP BY ALL) JOIN", "GROUP BY ALL) q JOIN").replace("SELECT video_id, person_id, object_id, object_class, n_close, start", "SELECT q.video_id, person_id, object_id, object_class, n_close, start", 1), "cclose", "itracks"))
def _(s):
    return out(interactions.person_carrying(item_obs(s), item_tracks(s)), "video_id person_id object_id object_class n_close start_frame end_frame", "motion confidence")


view("dd_in", "SELECT *, row_number() OVER (PARTITION BY video_id, event_type ORDER BY start_ms, event_id) AS i FROM sem", "sem")
view("dd_walk", """SELECT video_id, event_type, i, event_id, start_ms, start_ms AS last, true AS kept FROM dd_in WHERE i = 1 UNION ALL SELECT d.video_id, d.event_type, d.i, d.event_id, d.start_ms, CASE WHEN d.start_ms - w.last > 120000 THEN d.start_ms ELSE w.last END, d.start_ms - w.last > 120000
 FROM dd_walk w JOIN dd_in d ON d.video_id = w.video_id AND d.event_type = w.event_type AND d.i = w.i + 1""", "dd_in")


@query("dedup_within", sql("SELECT event_id FROM dd_walk WHERE kept", "dd_walk"))
def _(s):
    return interactions.dedup_within(s.semantic_events, 120_000.0, ("video_id", "event_type"), ("start_ms", "event_id")).select("event_id")


# Zones -------------------------------------------------------------------------------------------------------
view("zones", """SELECT * FROM (VALUES ('z_rect', 'Lobby', 'restricted', [[0.1, 0.2], [0.5, 0.2], [0.5, 0.6], [0.1, 0.6]]), ('z_tri', 'Gate', 'entry', [[0.5, 0.3], [0.95, 0.3], [0.7, 0.8]]),
 ('z_conc', 'Dock', 'exit', [[0.2, 0.2], [0.8, 0.2], [0.8, 0.7], [0.5, 0.4], [0.2, 0.7]]), ('z_safe', 'Hall', 'safe', [[0.0, 0.5], [1.0, 0.5], [1.0, 0.9], [0.0, 0.9]])) z(zone_id, zone_name, zone_type, polygon)""")
view("zedge", """SELECT zone_id, CAST(polygon[i][1] AS DOUBLE) AS px, CAST(polygon[i][2] AS DOUBLE) AS py, CAST(polygon[CASE WHEN i = 1 THEN len(polygon) ELSE i - 1 END][1] AS DOUBLE) AS qx, CAST(polygon[CASE WHEN i = 1 THEN len(polygon) ELSE i - 1 END][2] AS DOUBLE) AS qy
 FROM zones, LATERAL (SELECT unnest(range(1, len(polygon) + 1)) AS i)""", "zones")
view("zin", """SELECT o.*, z.zone_id, z.zone_name, z.zone_type, (SELECT count(*) FROM zedge e WHERE e.zone_id = z.zone_id AND ((e.py > o.cy) <> (e.qy > o.cy)) AND o.cx < (e.qx - e.px) * (o.cy - e.py) / (e.qy - e.py + 1e-12) + e.px) % 2 = 1 AS inside
 FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM obs) o, zones z""", "obs", "zones", "zedge")
view("zx", """SELECT *, CASE zone_type WHEN 'restricted' THEN CASE WHEN inside THEN 'restricted_zone_entry' ELSE 'restricted_zone_exit' END WHEN 'entry' THEN CASE WHEN inside THEN 'zone_entry' ELSE 'zone_exit' END
  WHEN 'exit' THEN CASE WHEN was IS NULL THEN 'zone_entry' WHEN inside THEN 'zone_exit' ELSE 'zone_entry' END ELSE 'zone_crossing' END AS event_type, CASE WHEN inside THEN 'entering' ELSE 'exiting' END AS direction, was IS NULL AS cold_start
 FROM (SELECT *, lag(inside) OVER (PARTITION BY video_id, track_id, zone_id ORDER BY seq) AS was FROM zin) WHERE CASE WHEN was IS NULL THEN inside ELSE inside <> was END""", "zin")


def zones_of(s: Inputs):
    """The fixed polygons for every video of the data."""
    all_zones = s.zones.agg(F.collect_list(F.struct("zone_id", "zone_name", "zone_type", "polygon")).alias("_all"))
    d = s.observations.select("video_id").distinct().select("video_id", all_zones.scalar().alias("_all"))
    return d.select("video_id", F.explode("_all").alias("_z")).select("video_id", "_z.*")


@query("point_in_polygon", sql("SELECT zone_id, count(*) FILTER (WHERE inside) AS inside_rows, count(*) AS rows FROM zin GROUP BY ALL", "zin"))
def _(s):
    return zones.inside_zones(s.observations, zones_of(s)).groupBy("zone_id").agg(F.count(F.when(F.col("inside"), 1)).alias("inside_rows"), F.count(F.lit(1)).alias("rows"))


@query("zone_crossings", sql("SELECT video_id, track_id, zone_id, frame_number, event_type, direction, cold_start FROM zx", "zx"))
def _(s):
    return zones.zone_crossings(s.observations, zones_of(s)).select("video_id", "track_id", "zone_id", "frame_number", "event_type", "direction", "cold_start")


@query("zone_membership", sql("SELECT video_id, track_id, zone_id, max_by(inside, seq) AS inside FROM zin GROUP BY ALL", "zin"))
def _(s):
    return zones.zone_membership(s.observations, zones_of(s))


@query("zone_events", sql(f"""SELECT video_id, track_id, event_type, 'roi_' || zone_id AS rule_name, {R('least(confidence + 0.05E0, 1.0E0)', 3)} AS confidence, frame_number AS start_frame, timestamp_ms AS start_ms,
 'Track-' || track_id || ' ' || direction || ' ' || zone_name || ' at ' || format('{{:02d}}:{{:02d}}', CAST(timestamp_ms AS BIGINT) // 60000, CAST(timestamp_ms AS BIGINT) // 1000 % 60) AS description FROM zx""", "zx"))
def _(s):
    return zones.zone_events(zones.zone_crossings(s.observations, zones_of(s))).select("video_id", "track_id", "event_type", "rule_name", "confidence", "start_frame", "start_ms", "description")
