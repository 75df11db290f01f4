"""Posture transitions, keypoint poses and the two activity state machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory import fixed
from framestory.functions import geometry as g
from framestory.functions.numbers import rounded
from framestory.operators.scenes import spaced_step
from framestory.plans.fold import FOLD_BLOCK_ROWS, Machine, ordered_fold, passed_tokens
from framestory.plans.nearest import nearest
from framestory.plans.sequence import BLOCK_ROWS, grouped_median, index_rows, over_blocks, running_sum
from framestory.session import cut_lineage

TRACK = ["video_id", "track_id"]

# Posture from box shape -----------------------------------------------------------------
POSTURE_OUT = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()),
    T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("sitting_ms", T.DoubleType())])


HELD = "held"  # stands for a value of the entry state in a block map


def posture_machine(drop: float, run: int = 2, recover: float = 0.80) -> Machine:
    """Two-row hysteresis between standing and sitting; state is [sitting, sat down at, run start, run length].

    Only the first and last part decide what happens next, so a block map has an
    exit for each of their values; the times are passed on or replaced.
    """
    columns = ("frame_number", "timestamp_ms", "aspect", "baseline")

    def move(state, row, out):
        sitting, since, start, n = state
        f, ms, ar, base = row
        if not (ar >= base * recover if sitting else ar < base * drop):
            return sitting, since, None, 0
        if n == 0:
            start = (int(f), float(ms))
        if n + 1 < run:
            return sitting, since, start, n + 1
        if out is not None:
            ends = {"start_frame": start[0], "end_frame": int(f), "start_ms": start[1], "end_ms": float(ms)}
            if sitting:
                out.append({"event_type": "person_standing_up", **ends, "confidence": 0.80, "sitting_ms": round(start[1] - since, 1)})
            else:
                out.append({"event_type": "person_sitting", **ends, "confidence": min(0.90, 0.55 + (base - ar) / base * 0.35), "sitting_ms": None})
        return not sitting, None if sitting else start[1], None, 0

    def step(state, rows, last):
        state, out = tuple(state or (False, None, None, 0)), []
        for row in zip(*(rows[c] for c in columns)):
            state = move(state, row, out)
        return list(state), out

    def survey(rows):
        tokens = {(s, "since" if s else None, (HELD, HELD) if n else None, n): [[s, n]] for s in (False, True) for n in range(run)}
        return passed_tokens(list(zip(*(rows[c] for c in columns))), tokens, lambda state, row: [(move(state, row, None), None)])

    def advance(state, exits):
        sitting, since, start, n = state or [False, None, None, 0]
        s, at, begun, k = next(e for label, e in exits if label == [sitting, n])
        return [s, since if at == "since" else start[1] if at == HELD else at, start if begun and begun[0] == HELD else begun, k]

    return Machine(step, survey, advance, columns)


def with_baseline(obs: DataFrame, min_standing: float = 1.40, min_observations: int = 3, block: int = BLOCK_ROWS) -> DataFrame:
    """Box rows with their height to width ratio and the standing baseline of their track; tracks without one are left out.

    The baseline is the mean over the first quarter of the rows that look like standing.
    They are added in row order, as boxes may equal a share of it but for float noise:
    the order of a shuffle would decide on them anew in every run.
    """
    boxes = obs.where((g.width() > 0) & (g.height() > 0)).withColumn("aspect", g.height() / g.width())
    boxes = index_rows(boxes, TRACK, ["seq"], F.floor(F.col("seq") / BLOCK_ROWS).cast("long"), "_place")
    n = boxes.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"))
    head = (boxes.join(n, TRACK).where((F.col("_n") >= min_observations) & (F.col("_place") < F.greatest(F.floor(F.col("_n") / 4), F.lit(2))))
            .select(*TRACK, "_place", F.floor(F.col("_place") / block).cast("long").alias("_blk"), F.col("aspect").alias("_any"),
                    F.when(F.col("aspect") >= min_standing, F.col("aspect")).alias("_up")))
    sums = ["_any", "_up"]
    here = Window.partitionBy(*TRACK, "_blk").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("_ups", F.col("_up").isNotNull().cast("long")).withColumns({c: F.sum(c).over(here) for c in sums})
    blocks = head.groupBy(*TRACK, "_blk").agg(F.max_by(F.struct(*sums), "_place").alias("_s"), F.count(F.lit(1)).alias("_anys"), F.sum("_ups").alias("_ups"))
    along = Window.partitionBy(*TRACK).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({c: F.sum(f"_s.{c}").over(along) for c in sums})
    base = (blocks.groupBy(*TRACK).agg(F.max_by(F.struct(*sums), "_blk").alias("_s"), F.sum("_anys").alias("_anys"), F.sum("_ups").alias("_ups"))
            .select(*TRACK, F.when(F.col("_ups") > 0, F.col("_s._up") / F.col("_ups")).otherwise(F.col("_s._any") / F.col("_anys")).alias("baseline"))
            .where(F.col("baseline") >= min_standing))
    return boxes.select(*TRACK, "seq", "frame_number", "timestamp_ms", "aspect").join(base, TRACK)


def posture_transitions(obs: DataFrame, drop: float = 0.55, min_standing: float = 1.40, min_observations: int = 3,
                        block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Sitting and standing-up events from the height to width ratio against the track's standing baseline."""
    d = with_baseline(obs, min_standing, min_observations)
    return ordered_fold(d, TRACK, posture_machine(drop), POSTURE_OUT, block=block).withColumn("confidence", rounded(F.col("confidence"), 4))


def near_object(obs: DataFrame, object_classes: Sequence[str], distance: float = 0.25, max_gap: int = 10, slot_frames: float = 4096.0,
                block: int = BLOCK_ROWS) -> DataFrame:
    """Runs of person observations near an object, taking each object's box nearest in time.

    Only objects whose whole range of positions comes within the distance of the
    person's position are looked at; grid cells bring the two together.
    """
    o = obs.where(F.col("class_name").isin(*object_classes)).select("video_id", F.col("track_id").alias("object_id"),
                                                                    F.col("class_name").alias("object_class"), "frame_number", g.cx().alias("ox"), g.cy().alias("oy"))
    p = obs.where(F.col("class_name") == "person").select(*TRACK, "obs_id", "frame_number", "timestamp_ms", g.cx().alias("px"), g.cy().alias("py"))
    reach = o.groupBy("video_id", "object_id", "object_class").agg(
        (F.min("ox") - distance).alias("_x1"), (F.max("ox") + distance).alias("_x2"), (F.min("oy") - distance).alias("_y1"), (F.max("oy") + distance).alias("_y2"))

    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / distance).cast("int"), F.floor(F.col(hi) / distance).cast("int")))

    reach = reach.withColumn("_gx", cells("_x1", "_x2")).withColumn("_gy", cells("_y1", "_y2"))
    cand = (p.withColumn("_gx", F.floor(F.col("px") / distance).cast("int")).withColumn("_gy", F.floor(F.col("py") / distance).cast("int"))
            .join(reach, ["video_id", "_gx", "_gy"]).where(F.col("px").between(F.col("_x1"), F.col("_x2")) & F.col("py").between(F.col("_y1"), F.col("_y2")))
            .select(*TRACK, "object_id", "object_class", "obs_id", "frame_number", "timestamp_ms", "px", "py")
            .withColumn("_q", F.concat_ws(":", "obs_id", "object_id")))
    cand = cut_lineage(cand)
    hit = nearest(cand, o.select("video_id", "object_id", "frame_number", "ox", "oy"), ["video_id", "object_id"], "frame_number", ["ox", "oy"], slot_frames, "_q")
    dx, dy = F.col("px") - F.col("ox"), F.col("py") - F.col("oy")
    hit = hit.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(F.col("_d") <= distance)
    hit = cut_lineage(hit)
    pair = [*TRACK, "object_id", "object_class"]
    hit = index_rows(hit, pair, ["frame_number"], F.floor(F.col("frame_number") / slot_frames).cast("long"), "_i")
    hit = over_blocks(hit, pair, lambda w: {"_pf": F.lag("frame_number").over(w)}, back=1, seq="_i", block=block)
    hit = running_sum(hit, pair, F.when(F.col("frame_number") - F.col("_pf") <= max_gap, 0).otherwise(1), "_run", seq="_i", block=block)
    runs = hit.groupBy(*pair, "_run").agg(
        F.count(F.lit(1)).alias("frames_near"), F.min("frame_number").alias("start_frame"), F.max("frame_number").alias("end_frame"),
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.avg("_d").alias("avg_distance"))
    return (runs.where(F.col("frames_near") >= 2)
            .withColumn("confidence", F.least(F.lit(0.85), 0.50 + (1.0 - F.col("avg_distance") / distance) * 0.35))
            .withColumn("event_type", F.concat(F.lit("person_near_"), F.replace("object_class", F.lit(" "), F.lit("_")))).drop("_run"))


# Keypoint poses -----------------------------------------------------------------------------
SHOULDERS, WRISTS, HIPS, KNEES, ANKLES = (5, 6), (9, 10), (11, 12), (13, 14), (15, 16)
MIN_KEYPOINT = 0.30


def _mean_point(kps: str, idx: tuple[int, ...]) -> tuple[Column, Column, Column]:
    """Mean x, y and score of the keypoints that are certain enough; zeros if none is."""
    pts = [F.get(F.col(kps), F.lit(i)) for i in idx]
    seen = [F.coalesce(F.get(p, F.lit(2)) >= MIN_KEYPOINT, F.lit(False)) for p in pts]
    n = sum((s.cast("int") for s in seen[1:]), seen[0].cast("int"))

    def mean(k):
        total = None
        for p, s in zip(pts, seen):
            v = F.when(s, F.get(p, F.lit(k)).cast("double")).otherwise(0.0)
            total = v if total is None else total + v
        return F.when(n > 0, total / n).otherwise(0.0)

    return mean(0), mean(1), mean(2)


def classify_pose(poses: DataFrame, kps: str = "keypoints") -> DataFrame:
    """Sitting, standing, walking and reaching flags with confidences from 17 keypoints."""
    d = poses
    for name, idx in (("sh", SHOULDERS), ("hip", HIPS), ("knee", KNEES), ("lw", WRISTS[:1]), ("rw", WRISTS[1:]), ("la", ANKLES[:1]), ("ra", ANKLES[1:])):
        x, y, c = _mean_point(kps, idx)
        d = d.withColumns({f"_{name}x": x, f"_{name}y": y, f"_{name}c": c})
    sure = (F.col("_hipc") > MIN_KEYPOINT) & (F.col("_kneec") > MIN_KEYPOINT) & (F.col("_shc") > MIN_KEYPOINT)
    torso = F.abs(F.col("_hipy") - F.col("_shy"))
    ratio = F.when(sure & (torso > 0.01), F.abs(F.col("_kneey") - F.col("_hipy")) / torso)
    d = d.withColumn("_r", ratio)
    score = F.col("_hipc") * F.col("_kneec")
    spread = F.when((F.col("_lac") > MIN_KEYPOINT) & (F.col("_rac") > MIN_KEYPOINT), F.abs(F.col("_lax") - F.col("_rax")))
    d = d.withColumn("_w", spread)

    def reach(side: str) -> Column:
        up = (F.col(f"_{side}c") > MIN_KEYPOINT) & (F.col(f"_{side}y") < F.col("_shy") - 0.03)
        return F.when(up, (F.col("_shy") - F.col(f"_{side}y")) * F.col(f"_{side}c") * 5.0)

    d = d.withColumn("_u", F.when(F.col("_shc") > MIN_KEYPOINT, F.greatest(reach("lw"), reach("rw"))))
    no = F.lit(False)
    d = d.withColumns({
        "is_sitting": F.coalesce(F.col("_r") < 0.40, no), "is_standing": F.coalesce(F.col("_r") > 0.50, no),
        "is_walking": F.coalesce(F.col("_w") > 0.12, no), "is_reaching_up": F.col("_u").isNotNull(),
        "sit_conf": F.when(F.col("_r") < 0.40, F.least(F.lit(1.0), (0.40 - F.col("_r")) / 0.40 * score)).otherwise(0.0),
        "stand_conf": F.when(F.col("_r") > 0.50, F.least(F.lit(1.0), (F.col("_r") - 0.50) / 0.50 * score)).otherwise(0.0),
        "walk_conf": F.when(F.col("_w") > 0.12, F.least(F.lit(1.0), F.col("_w") * 3.0 * (F.col("_lac") + F.col("_rac")) / 2)).otherwise(0.0),
        "reach_conf": F.coalesce(F.least(F.lit(1.0), F.greatest(F.col("_u"), F.lit(0.0))), F.lit(0.0))})
    return d.drop(*[c for c in d.columns if c.startswith("_")])


REACH_OUT = T.StructType([T.StructField("frame_number", T.LongType()), T.StructField("kept", T.BooleanType())])


def pose_events(poses: DataFrame, min_frames: int = 2, debounce: int = 20, keys: Sequence[str] = ("video_id", "track_id"),
                block: int = BLOCK_ROWS) -> DataFrame:
    """Activity runs and reaching gestures of classified poses.

    A run ends at the next frame with another activity, which also counts into
    its mean confidence.  Standing after any emitted sitting run is standing up.
    """
    keys = list(keys)
    base = F.when(F.col("is_sitting") & (F.col("sit_conf") > 0.3), F.struct(F.col("sit_conf").alias("c"), F.lit("sitting").alias("a"))).when(
        F.col("is_standing") & (F.col("stand_conf") > 0.3) & ~(F.col("is_sitting") & (F.col("sit_conf") > 0.3)),
        F.struct(F.col("stand_conf").alias("c"), F.lit("standing").alias("a")))
    walk = F.when(F.col("is_walking") & (F.col("walk_conf") > 0.3), F.col("walk_conf"))
    d = poses.withColumn("_b", base).withColumn("_wc", walk)
    dominant = F.when(F.col("_b").isNull(), F.when(F.col("_wc").isNotNull(), "walking")).otherwise(
        F.when(F.col("_wc") > F.col("_b.c"), "walking").otherwise(F.col("_b.a")))
    d = d.withColumn("activity", F.coalesce(dominant, F.lit("none"))).drop("_b", "_wc")
    d = index_rows(d, keys, ["frame_number"], F.floor(F.col("frame_number") / 4096).cast("long"))
    d = over_blocks(d, keys, lambda w: {"_new": F.when(F.lag("activity").over(w) == F.col("activity"), 0).otherwise(1)}, back=1, block=block)
    d = running_sum(d, keys, F.col("_new"), "_run", block=block)
    first = F.min_by(F.struct("frame_number", "timestamp_ms", "sit_conf", "stand_conf", "walk_conf"), "seq")
    sums = {a: (F.sum(F.when(F.col(c) > 0, F.col(c))), F.count(F.when(F.col(c) > 0, 1))) for a, c in (("sitting", "sit_conf"), ("standing", "stand_conf"), ("walking", "walk_conf"))}
    r = d.groupBy(*keys, "_run", "activity").agg(
        first.alias("_f"), F.max("frame_number").alias("_lf"), F.max("timestamp_ms").alias("_lt"), F.count(F.lit(1)).alias("frames"),
        *[e.alias(f"_{k}_{a}") for a, (s_, n_) in sums.items() for k, e in (("s", s_), ("n", n_))])
    r = index_rows(r, keys, ["_run"], F.floor(F.col("_run") / 65_536).cast("long"), "_i")
    r = over_blocks(r, keys, lambda w: {"_nx": F.lead("_f").over(w)}, fwd=1, seq="_i", block=block)
    end = F.coalesce(F.col("_nx.frame_number"), F.col("_lf"))
    conf = None
    for a, c in (("sitting", "sit_conf"), ("standing", "stand_conf"), ("walking", "walk_conf")):
        extra = F.coalesce(F.when(F.col(f"_nx.{c}") > 0, F.col(f"_nx.{c}")), F.lit(0.0))
        n = F.col(f"_n_{a}") + F.coalesce((F.col(f"_nx.{c}") > 0).cast("int"), F.lit(0))
        v = F.when(n > 0, (F.coalesce(F.col(f"_s_{a}"), F.lit(0.0)) + extra) / n).otherwise(0.5)
        conf = F.when(F.col("activity") == a, v) if conf is None else conf.when(F.col("activity") == a, v)
    runs = r.where((F.col("activity") != "none") & (F.col("frames") >= min_frames))
    sat = runs.where(F.col("activity") == "sitting").groupBy(*keys).agg(F.min("_i").alias("_sat"))
    kind = (F.when(F.col("activity") == "sitting", "person_sitting").when(F.col("activity") == "walking", "person_walking")
            .when(F.col("_sat") < F.col("_i"), "person_standing_up").otherwise("person_standing"))
    runs = runs.join(sat, keys, "left").select(
        *keys, kind.alias("event_type"), F.col("_f.frame_number").alias("start_frame"), end.alias("end_frame"), F.col("_f.timestamp_ms").alias("start_ms"),
        F.coalesce(F.col("_nx.timestamp_ms"), F.col("_lt")).alias("end_ms"), conf.alias("confidence"), "frames")
    up = poses.where(F.col("is_reaching_up") & (F.col("reach_conf") > 0.4))
    up_i = index_rows(up.select(*keys, "frame_number"), keys, ["frame_number"], F.floor(F.col("frame_number") / 65_536).cast("long"))
    kept = ordered_fold(up_i, keys, spaced_step("frame_number", debounce, "frame_number", strict=True), REACH_OUT).where("kept")
    gestures = up.join(kept, [*keys, "frame_number"], "left_semi").select(
        *keys, F.lit("person_reaching_up").alias("event_type"), F.col("frame_number").alias("start_frame"), F.col("frame_number").alias("end_frame"),
        F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"), F.col("reach_conf").alias("confidence"), F.lit(1).cast("long").alias("frames"))
    return runs.unionByName(gestures)


def pose_label_near(obs: DataFrame, poses: DataFrame, window: int = 3, keys: Sequence[str] = ("video_id", "track_id")) -> DataFrame:
    """Majority pose within ``window`` frames of each observation, null without one."""
    keys = list(keys)
    width = window + 1
    p = poses.select(*keys, F.col("frame_number").alias("_pf"), "is_sitting", "is_walking", "is_standing").withColumn("_b", F.floor(F.col("_pf") / width).cast("long"))
    b = F.floor(F.col("frame_number") / width).cast("long")
    o = obs.select(*keys, "obs_id", "frame_number").withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    s = (o.join(p, [*keys, "_b"]).where(F.abs(F.col("_pf") - F.col("frame_number")) <= window).groupBy("obs_id")
         .agg(*[F.avg(F.col("is_" + k).cast("double")).alias("_" + k) for k in ("sitting", "walking", "standing")]))
    label = F.when(F.col("_sitting") > 0.5, "sitting").when(F.col("_walking") > 0.4, "walking").when(F.col("_standing") > 0.4, "standing")
    return s.select("obs_id", label.alias("pose_label"))


# Activity state machine ------------------------------------------------------------------------
WALK_V, STILL_V, EDGE, CHAIR, CY_DROP = 0.08, 0.03, 0.12, 0.28, 0.04


def seat_centroids(obs: DataFrame, classes: Sequence[str] = tuple(fixed.SEAT_CLASSES)) -> DataFrame:
    """Upper-median centre of every seat track."""
    o = obs.where(F.lower("class_name").isin(*classes)).select(*TRACK, g.cx().alias("cx"), g.cy().alias("cy"))
    x, y = (grouped_median(o, TRACK, c, 0.01, "seat_" + c, upper=True) for c in ("cx", "cy"))
    return x.join(y, TRACK)


def smoothed_velocity(obs: DataFrame, window: int = 5, fps: float = 25.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean speed of the last up to ``window`` steps, in frame widths per second."""
    d = obs.withColumn("cx", g.cx()).withColumn("cy", g.cy())

    def cols(w):
        dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
        frames = F.greatest(F.col("frame_number") - F.lag("frame_number").over(w), F.lit(1))
        return {"_v": F.sqrt(dx * dx + dy * dy) / (frames / F.lit(fps)),
                "smoothed_velocity": F.coalesce(F.avg("_v").over(w.rowsBetween(-(window - 1), 0)), F.lit(0.0))}

    return over_blocks(d, TRACK, cols, back=window + 1, block=block).drop("_v")


MACHINE_OUT = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("frame_number", T.LongType()), T.StructField("timestamp_ms", T.DoubleType()),
    T.StructField("confidence", T.DoubleType())])


MACHINE_COLUMNS = ("frame_number", "timestamp_ms", "cy", "smoothed_velocity", "near_seat", "pose_label", "at_edge")


def _machine_move(name, ref, row, out):
    """The activity after a row, and the height reference while sitting; appends events to ``out``, if given."""
    f, ms, cy, v, near, pose, edge = row
    seat = bool(near) or pose == "sitting"

    def emit(kind, conf):
        if out is not None:
            out.append({"event_type": kind, "frame_number": int(f), "timestamp_ms": float(ms), "confidence": conf})

    if name == "start":
        emit("person_entered_scene", 0.90)
        return "entering", None
    if name in ("entering", "walking"):
        if name == "entering" and v >= WALK_V:
            return "walking", None
        if v < STILL_V:
            if seat:
                emit("person_sitting", 0.80 if name == "entering" else 0.85)
                return "sitting", float(cy - CY_DROP)
            if name == "walking":
                emit("person_standing", 0.75)
            return "standing", None
    elif name == "standing":
        if v >= WALK_V:
            if edge:
                return "exiting", None
            emit("person_walking", 0.75)
            return "walking", None
        if seat:
            emit("person_sitting", 0.88)
            return "sitting", float(cy - CY_DROP)
    elif name == "sitting":
        rose = cy < ref - CY_DROP
        if rose or _leaves_seat(row):
            emit("person_standing_up", 0.85 if rose else 0.82)
            return ("walking" if v >= WALK_V else "standing"), None
    elif name == "exiting" and not edge and v > STILL_V:
        return "walking", None
    return name, ref


def _leaves_seat(row) -> bool:
    """Whether a sitting person gets up whatever the height they sat down at."""
    return row[3] >= WALK_V or (not row[4] and row[5] in ("standing", "walking"))


def _machine_step(state, rows, last):
    name, ref, n, prev = state or ["start", None, 0, None]
    out = []
    for row in zip(*(rows[c] for c in MACHINE_COLUMNS)):
        name, ref = _machine_move(name, ref, row, out)
        n, prev = min(n + 1, 2), [int(row[0]), float(row[1]), bool(row[6])]
    if last and n >= 2:
        out.append({"event_type": "person_left_scene", "frame_number": prev[0], "timestamp_ms": prev[1], "confidence": 0.90 if prev[2] else 0.75})
    return [name, ref, n, prev], out


def _machine_survey(rows):
    """Exits from every activity.  Sitting down earlier leaves the reference open: every new least height of the
    block is a branch, taken by references above it; ``sitting`` alone is who stays below all of them."""
    def move(state, row):
        name, ref = state
        if name != "sitting" or not isinstance(ref, tuple):
            return [(_machine_move(name, ref, row, None), None)]
        if _leaves_seat(row):
            return [(("walking" if row[3] >= WALK_V else "standing", None), None)]
        if row[2] < ref[1]:
            return [(("standing", None), ["sitting", float(row[2])]), (("sitting", (HELD, float(row[2]))), None)]
        return [(state, None)]

    listed = list(zip(*(rows[c] for c in MACHINE_COLUMNS)))
    tokens = {(name, None): [[name, None]] for name in ("start", "entering", "walking", "standing", "exiting")}
    tokens["sitting", (HELD, float("inf"))] = [["sitting", None]]
    end = listed[-1]
    return {"exits": passed_tokens(listed, tokens, move), "n": min(len(listed), 2), "prev": [int(end[0]), float(end[1]), bool(end[6])]}


def _machine_advance(state, block):
    name, ref, n, _ = state or ["start", None, 0, None]
    exits = block["exits"]
    if name == "sitting":
        risen = sorted((e for e in exits if e[0][0] == "sitting" and e[0][1] is not None and e[0][1] < ref - CY_DROP), key=lambda e: -e[0][1])
        name, at = risen[0][1] if risen else next(e for label, e in exits if label == ["sitting", None])
        ref = ref if isinstance(at, list) else at
    else:
        name, ref = next(e for label, e in exits if label == [name, None])
    return [name, ref, min(n + block["n"], 2), block["prev"]]


#: Activity state machine; state is [name, height reference, rows so far up to two, last row].
activity_machine = Machine(_machine_step, _machine_survey, _machine_advance, MACHINE_COLUMNS)


def machine_inputs(obs: DataFrame, seats: DataFrame, poses: DataFrame | None = None, fps: float = 25.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Person observations with smoothed velocity, edge, seat and pose columns."""
    p = smoothed_velocity(obs.where(F.lower("class_name").isin(*fixed.PERSON_CLASSES)), fps=fps, block=block)
    cell = lambda c: F.floor(c / CHAIR).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = (seats.select("video_id", "seat_cx", "seat_cy").withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
         .withColumn("_gx", cell(F.col("seat_cx")) + F.col("_dx")).withColumn("_gy", cell(F.col("seat_cy")) + F.col("_dy")).drop("_dx", "_dy"))
    dx, dy = F.col("cx") - F.col("seat_cx"), F.col("cy") - F.col("seat_cy")
    near = (p.select("video_id", "obs_id", "cx", "cy").withColumn("_gx", cell(F.col("cx"))).withColumn("_gy", cell(F.col("cy")))
            .join(s, ["video_id", "_gx", "_gy"]).where(F.sqrt(dx * dx + dy * dy) < CHAIR).select("obs_id").distinct().withColumn("near_seat", F.lit(True)))
    d = p.join(near, "obs_id", "left").withColumn("near_seat", F.coalesce("near_seat", F.lit(False)))
    if poses is not None:
        d = d.join(pose_label_near(p, poses), "obs_id", "left")
    else:
        d = d.withColumn("pose_label", F.lit(None).cast("string"))
    cx, cy = F.col("cx"), F.col("cy")
    return d.withColumn("at_edge", (cx < EDGE) | (cx > 1.0 - EDGE) | (cy < EDGE) | (cy > 1.0 - EDGE))


def activity_state_machine(inputs: DataFrame, block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    d = inputs.select(*TRACK, "seq", "frame_number", "timestamp_ms", "cy", "smoothed_velocity", "near_seat", "pose_label", "at_edge")
    return ordered_fold(d, TRACK, activity_machine, MACHINE_OUT, block=block)


# Temporal pose machine ----------------------------------------------------------------------------
POSE_MINIMUM, POSE_EVENT = fixed.POSE_MINIMUM, fixed.POSE_EVENT
POSE_WINDOW, POSE_HYSTERESIS = 20, 2
POSE_OUT = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()),
    T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("supporting", T.LongType())])


def pose_state(aspect: float, height: float, lateral: float, lower: bool) -> str:
    """Candidate state of one row; ``lower`` says that the row before was clearly lower than the one two rows before it."""
    if aspect >= 1.8 and height < 0.12:
        return "FALLEN"
    if height < 0.15 and lateral >= 0.003:
        return "CRAWLING"
    if height < 0.18:
        return "CROUCHING"
    if lower:
        return "LOWERING"
    if lateral >= 0.020:
        return "RUNNING"
    if lateral >= 0.005:
        return "WALKING"
    return "STANDING" if height >= 0.20 else "UNKNOWN"


def pose_candidates(obs: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Candidate state of each row from its box and up to three rows before it."""
    d = obs.withColumn("_cx", F.col("x1") + g.width() / 2).withColumn("body_height", g.height()).withColumn(
        "_aspect", g.width() / F.greatest(g.height(), F.lit(0.001)))
    d = over_blocks(d, TRACK, lambda w: {
        "lateral": F.coalesce(F.abs(F.col("_cx") - F.lag("_cx").over(w)), F.lit(0.0)),
        "_h1": F.lag("body_height", 1).over(w), "_h3": F.lag("body_height", 3).over(w)}, back=3, block=block)
    h, m = F.col("body_height"), F.col("lateral")
    state = (F.when((F.col("_aspect") >= 1.8) & (h < 0.12), "FALLEN").when((h < 0.15) & (m >= 0.003), "CRAWLING").when(h < 0.18, "CROUCHING")
             .when(F.col("_h1") < F.col("_h3") - 0.03, "LOWERING").when(m >= 0.020, "RUNNING").when(m >= 0.005, "WALKING")
             .when(h >= 0.20, "STANDING").otherwise("UNKNOWN"))
    return d.withColumn("candidate", state).drop("_cx", "_aspect", "_h1", "_h3")


def _pose_event(kind, start, end, n, pose):
    if n < POSE_MINIMUM.get(kind, 1) or kind not in POSE_EVENT:
        return None
    steady = n / max(end[0] - start[0] + 1, 1)
    conf = min(round(min(n / max(POSE_MINIMUM[kind] * 2, 1), 1.0) * max(steady, 0.3) * max(pose / n, 0.2) + 0.1, 3), 0.95)
    return {"event_type": POSE_EVENT[kind], "start_frame": start[0], "end_frame": end[0], "start_ms": start[1], "end_ms": end[1],
            "confidence": conf, "supporting": n}


#: Confidences add up as whole multiples of this, so that a sum doesn't depend on where blocks part.
POSE_UNIT = 2.0 ** -40
POSE_COLUMNS = ("frame_number", "timestamp_ms", "candidate", "pose_confidence")
POSE_STATES = ("UNKNOWN", "STANDING", "WALKING", "RUNNING", "LOWERING", "CROUCHING", "CRAWLING", "FALLEN")


def _pose_move(state, row):
    """Next state and, if the row closes an open one, the state it closed.

    A state is (current, candidate, times in a row up to the hysteresis, start,
    whether start and sums go on from the entry of the block, support, confidence sum).
    """
    cur, cand, n, start, held, sup, pose = state
    f, ms, c, conf = row
    n = min(n + 1, POSE_HYSTERESIS) if c == cand else 1
    closed = None
    if n >= POSE_HYSTERESIS and c != cur:
        closed = (cur, start, sup, pose)
        cur, start, held, sup, pose, n = c, (int(f), float(ms)) if c in POSE_EVENT else (0, 0.0), False, 0, 0, 0
    if c == cur and c in POSE_EVENT:
        sup, pose = sup + 1, pose + round(float(conf) / POSE_UNIT)
    return (cur, c, n, start, held, sup, pose), closed


def _closing(cur, start, sup, pose, end):
    """The event of an open state, if it is one that ends with an event."""
    if cur in ("UNKNOWN", "STANDING", "WALKING") or start[0] <= 0 or sup <= 0:
        return None
    return _pose_event(cur, start, end, sup, pose * POSE_UNIT)


def _pose_step(state, rows, last):
    open_, win, end = state or [("UNKNOWN", "UNKNOWN", 0, (0, 0.0), False, 0, 0), [], None]
    open_, out = tuple(open_), []
    for row in zip(*(rows[c] for c in POSE_COLUMNS)):
        end = [int(row[0]), float(row[1])]
        win = (win + [[*end, row[2], float(row[3])]])[-POSE_WINDOW:]
        open_, closed = _pose_move(open_, row)
        event = _closing(*closed, end) if closed else None
        if open_[0] == "RUNNING" and row[2] == "RUNNING":
            run = [r for r in win if r[2] == "RUNNING"]
            if len(run) == POSE_MINIMUM["RUNNING"]:
                event = _pose_event("RUNNING", run[0], run[-1], len(run), sum(r[3] for r in run))
        if event:
            out.append(event)
    if last and end is not None:
        event = _closing(open_[0], open_[3], open_[5], open_[6], end)
        if event:
            out.append(event)
    return [list(open_), win, end], out


def _pose_survey(rows):
    """Exits by current state and, where the candidate goes on, by its count; starts and sums go on from the entry until a switch."""
    listed = list(zip(*(rows[c] for c in POSE_COLUMNS)))
    first = listed[0][2]
    tokens = {}
    for cur in POSE_STATES:
        for n in range(POSE_HYSTERESIS + 1):
            tokens[cur, first, n, None, True, 0, 0] = [[cur, n]]
        tokens[cur, None, 0, None, True, 0, 0] = [[cur, None]]
    exits = passed_tokens(listed, tokens, lambda state, row: [(_pose_move(state, row)[0], None)])
    return {"first": first, "exits": exits, "win": [[int(f), float(ms), c, float(p)] for f, ms, c, p in listed[-POSE_WINDOW:]]}


def _pose_advance(state, block):
    open_, win, _ = state or [["UNKNOWN", "UNKNOWN", 0, [0, 0.0], False, 0, 0], [], None]
    cur, cand, n, start, held, sup, pose = open_
    after = next(e for label, e in block["exits"] if label == [cur, n if cand == block["first"] else None])
    if after[4]:
        after = [*after[:3], start, held, sup + after[5], pose + after[6]]
    win = (win + block["win"])[-POSE_WINDOW:]
    return [after, win, win[-1][:2]]


#: Hysteresis over candidates; state is the open state, the rows of the window, and the last row.
pose_machine = Machine(_pose_step, _pose_survey, _pose_advance, POSE_COLUMNS)


def temporal_pose_fsm(obs: DataFrame, pose_confidence: Column | float = 0.5, min_observations: int = 3, block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """Sustained crawling, crouching, falling and running from boxes alone.

    ``pose_confidence`` may be a column, such as the detection confidence.
    """
    long_enough = obs.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_observations).select(*TRACK)
    pc = pose_confidence if isinstance(pose_confidence, Column) else F.lit(float(pose_confidence))
    d = pose_candidates(obs).withColumn("pose_confidence", pc).join(long_enough, TRACK, "left_semi")
    return ordered_fold(d.select(*TRACK, "seq", "frame_number", "timestamp_ms", "candidate", "pose_confidence"), TRACK, pose_machine, POSE_OUT, block=block)
