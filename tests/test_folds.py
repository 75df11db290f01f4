"""Every fold gives the same rows in many small blocks as in one."""

import pytest

from framestory.operators import identity, posture, quality, sampling, scenes, tracking
from framestory.queries.frames import signals_of
from framestory.queries.people import seats_of, squashed, tracker_detections
from framestory.sources.fixtures import Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def same(a, b):
    x, y = sorted(map(repr, a.collect())), sorted(map(repr, b.collect()))
    assert x == y
    assert x


def test_adaptive_skip(inputs):
    same(sampling.adaptive_skip(inputs.frame_sequence, signals=signals_of(inputs)), sampling.adaptive_skip(inputs.frame_sequence, signals=signals_of(inputs), block=40))


def test_lighting_and_merge(inputs):
    p = quality.brightness_profile(inputs.frame_sequence)
    ev = quality.lighting_events(p)
    same(ev, quality.lighting_events(p, block=17))
    same(quality.merge_lighting(ev, 8000.0), quality.merge_lighting(ev, 8000.0, block=3))


def test_min_scene(inputs):
    f = scenes.classify_scene_frame(scenes.adaptive_threshold(scenes.composite_score(scenes.histogram_diff(inputs.frame_histograms)))).select(
        "video_id", "frame_number", "seq", "is_boundary", "is_duplicate")
    same(scenes.enforce_min_scene(f, 25), scenes.enforce_min_scene(f, 25, block=6))


def test_machines(inputs):
    m = posture.machine_inputs(inputs.observations, seats_of(inputs))
    same(posture.activity_state_machine(m), posture.activity_state_machine(m, block=9))
    same(posture.temporal_pose_fsm(squashed(inputs)), posture.temporal_pose_fsm(squashed(inputs), block=7))
    same(posture.posture_transitions(inputs.observations, drop=0.99), posture.posture_transitions(inputs.observations, drop=0.99, block=8))


def test_lifecycle(inputs):
    d = tracker_detections(inputs)
    same(tracking.track_lifecycle(d), tracking.track_lifecycle(d, block=20))


def test_reid(inputs):
    t = inputs.track_embeddings
    same(identity.reid_assign(t, 0.45), identity.reid_assign(t, 0.45, block=45))


def rounds_of(monkeypatch, build):
    """Rows of a fold and how many rounds it took: one exchange in the first round, two in each further one."""
    from framestory.plans import fold

    calls = []
    spread = fold._spread
    monkeypatch.setattr(fold, "_spread", lambda *a: calls.append(1) or spread(*a))
    got = build().collect()
    return got, 1 + (len(calls) - 1) // 2


def test_standing_box_settles_in_three_rounds(spark, monkeypatch):
    from framestory.operators import tracking

    d = spark.createDataFrame([(1, 5 * i, i, "person", 0.9, 0.1, 0.1, 0.2, 0.4) for i in range(320)],
                              "video_id long, frame_number long, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got, rounds = rounds_of(monkeypatch, lambda: tracking.track_lifecycle(d, block=20))
    assert rounds <= 3 and {r["track_key"] for r in got} == {0} and len(got) == 321


def test_walking_person_settles_in_three_rounds(spark, monkeypatch):
    from framestory.operators import posture

    d = spark.createDataFrame([(1, 1, i, 5 * i, 200.0 * i, 0.5, 0.2, False, None, False) for i in range(320)],
                              "video_id long, track_id long, seq long, frame_number long, timestamp_ms double, cy double, smoothed_velocity double, near_seat boolean, "
                              "pose_label string, at_edge boolean")
    got, rounds = rounds_of(monkeypatch, lambda: posture.activity_state_machine(d, block=20))
    assert rounds <= 3 and sorted(r["event_type"] for r in got) == ["person_entered_scene", "person_left_scene"]


def lasting(n, kind):
    """Rows of someone who sits, falls or crouches for nearly the whole time: (posture, activity, pose) inputs share the frame and time."""
    out = []
    for i in range(n):
        down = 5 <= i < n - 5
        out.append((1, 1, i, 5 * i, 200.0 * i, 0.5 if not down else 0.6, 0.0 if i > 3 else 0.2, down, None, False,
                    0.5 if down else 2.0, 2.0, kind if down else "STANDING", 0.5 + (i % 7) / 1000))
    return out


LASTING = ("video_id long, track_id long, seq long, frame_number long, timestamp_ms double, cy double, smoothed_velocity double, near_seat boolean, pose_label string, "
           "at_edge boolean, aspect double, baseline double, candidate string, pose_confidence double")


@pytest.mark.parametrize("kind", ["CROUCHING", "FALLEN"])
def test_lasting_states_take_two_rounds(spark, monkeypatch, kind):
    from framestory.operators import posture
    from framestory.plans.fold import ordered_fold

    d = spark.createDataFrame(lasting(320, kind), LASTING)
    cases = ((posture.posture_machine(0.55), posture.POSTURE_OUT, 2), (posture.activity_machine, posture.MACHINE_OUT, 5), (posture.pose_machine, posture.POSE_OUT, 1))
    for machine, out, events in cases:
        got, rounds = rounds_of(monkeypatch, lambda: ordered_fold(d, ["video_id", "track_id"], machine, out, block=20))
        whole = ordered_fold(d, ["video_id", "track_id"], machine, out).collect()
        assert rounds <= 3 and sorted(map(repr, got)) == sorted(map(repr, whole)) and len(got) == events


def test_block_maps_equal_steps():
    """A block's map gives the exit of its rows for whatever state they are entered in."""
    import json
    import random

    import pandas as pd

    from framestory.operators import posture

    rng = random.Random(3)
    for turn in range(120):
        n, cy = rng.randrange(2, 120), 0.5
        rows = []
        for i in range(n):
            cy += rng.choice([0, 0, 0.01, -0.01, 0.05, -0.05])
            rows.append((5 * i + 5, 200.0 * i, cy, rng.choice([0.0, 0.0, 0.05, 0.1 if turn % 2 else 0.0]), rng.random() < 0.5, rng.choice([None, None, "sitting", "standing" if turn % 3 else None]),
                         rng.random() < 0.2, rng.choice([0.5, 2.0]), 2.0, rng.choice(posture.POSE_STATES if turn % 2 else ("RUNNING", "FALLEN")), rng.random()))
        d = pd.DataFrame(rows, columns=["frame_number", "timestamp_ms", "cy", "smoothed_velocity", "near_seat", "pose_label", "at_edge", "aspect", "baseline", "candidate", "pose_confidence"])
        for m in (posture.posture_machine(0.55), posture.activity_machine, posture.pose_machine):
            block = rng.choice([1, 2, 7, 30])
            state = mapped = None
            for i in range(0, n, block):
                part = d.iloc[i:i + block]
                mapped = json.loads(json.dumps(m.advance(mapped, json.loads(json.dumps(m.survey(part))))))
                state = json.loads(json.dumps(m.step(state, part, False)[0]))
                assert mapped == state


def test_short_keys_share_calls_of_python(spark, monkeypatch):
    """Blocks come out of batches whole, wherever the batches end, and no call is made for each key."""
    import pyspark.sql.types as T

    from framestory.plans.fold import ordered_fold

    rows = [(f"k{k}", k // 2, i, k * 100 + i) for k in range(40) for i in range(1 + k % 9)]
    d = spark.createDataFrame(rows, "name string, part long, seq long, v long").repartition(3)

    def step(state, rows, last):
        state, out = list(state or [0, 0]), []
        for v in rows["v"]:
            state = [state[0] + int(v), state[1] + 1]
        if last:
            out.append({"total": state[0], "n": state[1]})
        return state, out

    kind = T.StructType([T.StructField("total", T.LongType()), T.StructField("n", T.LongType())])
    want = sorted((f"k{k}", sum(k * 100 + i for i in range(1 + k % 9)), 1 + k % 9) for k in range(40))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, block in ((3, 4), (7, 50_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = ordered_fold(d, ["name", "part"], step, kind, block=block)
            assert sorted((r["name"], r["total"], r["n"]) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    calls, kept = [], type(d.groupBy("name"))
    monkeypatch.setattr(kept, "applyInPandas", lambda *a: calls.append(a))
    assert ordered_fold(d, ["name", "part"], step, kind).count() == 40 and not calls
