"""Streaming against batch, readers on files in the foreign formats, and the entry points."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framestory.operators import tracking, zones
from framestory.queries.people import tracker_detections, zones_of
from framestory.sources import files
from framestory.sources.fixtures import Inputs
from framestory.streaming import run, steps
from framestory.streaming.fold import stream_fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stream_tracker_equals_batch(inputs):
    d = tracker_detections(inputs)
    r = d.join(tracking.frame_ranks(d), ["video_id", "frame_number"])
    s = run.run_to_table(stream_fold(run.replay(r, "frame_number", ["video_id"]), ["video_id"], "frame_rank", tracking.lifecycle_step(), tracking.LIFECYCLE_OUT))
    b = tracking.track_lifecycle(d).where(~F.col("action").isin("closed", "open"))
    assert rows(s) == rows(b.select(s.columns))


def test_stream_zones_equal_batch_and_late_rows_are_dropped(inputs):
    o, key = inputs.observations, ["video_id", "track_id", "zone_id"]
    # The last piece repeats the first 20 rows of every track: they are late.
    again = o.withColumn("part", F.lit(0)).unionByName(o.where("seq < 20").withColumn("part", F.lit(1)))
    st = zones.inside_zones(run.replay(again, "part", ["video_id", "track_id"], parts=20).drop("part"), zones_of(inputs))
    s = run.run_to_table(stream_fold(st.select(*key, "seq", "frame_number", "zone_type", "inside"), key, "seq", steps.zone_stream_step, steps.ZONE_STREAM_OUT))
    b = zones.zone_crossings(inputs.observations, zones_of(inputs)).select(s.columns)
    assert rows(s) == rows(b)


def test_foreign_files(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps([
        {"video_id": 1, "zone_id": "a", "polygon": [[0, 0], [1, 0], [1, 1]], "zone_type": "RESTRICTED"}, {"video_id": 1, "zone_id": "b", "name": "B", "polygon": [[0, 0], [1, 1]]},
        {"video_id": 1, "zone_id": "c", "name": "C", "polygon": [[0, 0], [1, 0], [1, 1]], "zone_type": "odd"}]))
    z = {x.zone_id: (x.zone_name, x.zone_type, len(x.polygon)) for x in files.read_zones(spark, str(tmp_path / "z.json")).collect()}
    assert z == {"a": ("a", "restricted", 3), "c": ("C", "monitor", 3)}
    (tmp_path / "t.json").write_text(json.dumps({"video_id": "v", "events": [{"event_id": "e1", "type": "t", "start": 1.0, "end": 2.0, "entities": ["p"]},
                                                                              {"event_id": "e2", "type": "t", "start": 3.0, "end": 4.0, "entities": []}],
                                                 "narrative_chains": [["e1", "e2"], ["e2"]], "irrelevant_events": ["e2"]}))
    ev, ch = files.read_ground_truth(spark, str(tmp_path / "t.json"))
    assert {(x.event_id, x.is_irrelevant) for x in ev.collect()} == {("e1", False), ("e2", True)}
    assert sorted((x.chain_id, x.position, x.event_id) for x in ch.collect()) == [(0, 0, "e1"), (0, 1, "e2"), (1, 0, "e2")]
    (tmp_path / "m.json").write_text(json.dumps({"video_id": 4, "clips": [{"clip_index": 1, "event_id": "x", "event_type": "person_walking", "track_id": 3, "start_ms": 1.0, "end_ms": 2.0}]}))
    m = files.events_from_manifest(spark, str(tmp_path / "m.json"), nested=True).first()
    assert (m.confidence, m.person_label, m.direction, m.description) == (0.82, "Person 3", "right", "Verified event: person walking")


FAST = ["velocity", "motion_profile", "apply_rules", "confidence_dims", "story_segments", "co_occurrence_edges", "compression_policy", "adaptive_skip", "scene_segments", "interactions",
        "zone_crossings", "classify_activity", "merge_adjacent", "nearest_frames", "temporal_quality",
        "stream_activity_machine", "stream_activity_resumed", "stream_temporal_pose", "stream_lighting", "stream_late_rows"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "events orders lineitem part embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in df.select(cols).collect())
    cur = duck.execute(entry.oracle_sql()[name])
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    assert [cur.description[i][0] for i in order] == cols
    want = sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in cur.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 150


def test_kept_and_discarded_partition_the_events(spark):
    d = entry.queries()["compression_policy"](spark, SF)
    assert d.groupBy("video_id", "track_id").count().where("count > 1").isEmpty()
    assert d.where("keep is null or reason is null").isEmpty()


def test_idle_tracks_are_closed_by_event_time(spark):
    """The machine's last event appears once the watermark passes the idle time."""
    from framestory.operators import posture
    from framestory.streaming.steps import machine_stream_step

    a = [(1, 1, i, i * 5, i * 200.0, 0.5, 0.5, False, i * 0.2) for i in range(4)]
    b = [(1, 2, i, i * 5, i * 200.0, 0.5, 0.5, False, 600 + i * 0.2) for i in range(2)]
    c = [(1, 3, 0, 0, 0.0, 0.5, 0.5, False, 1200.0)]
    d = spark.createDataFrame(a + b + c, "video_id long, track_id long, seq long, frame_number long, timestamp_ms double, cx double, cy double, near_seat boolean, s double")
    d = d.withColumn("event_time", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    st = run.replay(d, "s", ["video_id", "track_id"]).drop("s").withWatermark("event_time", "5 seconds")
    got = run.run_to_table(stream_fold(st, ["video_id", "track_id"], "seq", machine_stream_step(), posture.MACHINE_OUT, event_time="event_time", idle_ms=60_000)).toPandas()
    left = got[got["event_type"] == "person_left_scene"]
    assert set(left["track_id"]) >= {1} and (left[left["track_id"] == 1]["frame_number"] == 15).all()


def test_frame_names_in_folders_and_foreign_names(spark):
    names = [f"c1/frame_{n:08d}.jpg" for n in (100, 200)] + [f"c2/frame_{n:08d}.jpg" for n in (1, 2)] + ["c2/thumb.jpg"]
    d = spark.createDataFrame([(1, n) for n in names] + [(2, f"x/frame_{n:04d}.jpg") for n in (1, 2, 900)] + [(3, "cover.png"), (3, "frame_0002.jpg")], "video_id long, frame_path string")
    got = {(r["video_id"], r["frame_path"]): r["frame_number"] for r in files.frame_number_from_path(d).collect()}
    assert [got[1, n] for n in names] == [495, 995, 0, 5, 5]  # names count frames; a foreign name takes its place, here the third
    assert [got[2, f"x/frame_{n:04d}.jpg"] for n in (1, 2, 900)] == [1, 2, 900]
    assert got[3, "frame_0002.jpg"] == 5 and got[3, "cover.png"] == 0


def test_reprocessing_and_exporting_again(spark, tmp_path):
    path, manifest = str(tmp_path / "ev"), str(tmp_path / "man")
    d = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "video_id long, event_id long")
    files.write_events(d, path)
    files.reprocess_video(d.where("false"), path, 1)
    assert sorted(map(tuple, files.read_events(spark, path).select("video_id", "event_id").collect())) == [(2, 20)]
    files.reprocess_video(d.where("event_id = 11"), path, 1)
    assert sorted(map(tuple, files.read_events(spark, path).select("video_id", "event_id").collect())) == [(1, 11), (2, 20)]
    for _ in range(2):
        files.export_manifest(manifest, d, d, d, d)
    assert spark.read.json(manifest).count() == 12


def test_manifest_files_do_not_grow_with_videos(spark, tmp_path):
    """A later export replaces its own videos' lines only, those of the same folders stay."""
    import glob

    path = str(tmp_path / "man")
    d = spark.range(600).select((F.col("id") % 300).alias("video_id"), F.col("id").cast("string").alias("event_id"), F.lit("person_running").alias("event_type")).repartition(6)
    files.export_manifest(path, d, d, d, d)
    assert len(glob.glob(path + "/section=clips/**/part-*", recursive=True)) <= files.MANIFEST_PARTS
    odd = spark.createDataFrame([(7, "new", None), (None, "lost", None)], "video_id long, event_id string, event_type string")
    for _ in range(2):
        files.export_manifest(path, odd, odd, odd, odd)
    got = sorted(((r["video_id"], r["event_id"]) for r in files.events_from_manifest(spark, path).collect()), key=str)
    assert got == sorted([(i % 300, str(i)) for i in range(600) if i % 300 != 7] + [(7, "new"), (None, "lost")], key=str)


def test_pieces_of_a_stream_do_not_grow_with_its_hot_key(spark, monkeypatch):
    """A key with most rows comes in many micro-batches, and keys that share a group keep their states apart."""
    def counting_step(state, rows, last):
        return (state or 0) + len(rows), [{"n": len(rows), "total": (state or 0) + len(rows)}]

    monkeypatch.setattr(run, "KEY_ROWS", 200)
    d = spark.range(3000).select(F.lit("hot").alias("cam"), "id").unionByName(spark.range(3000).select(F.col("id").cast("string").alias("cam"), "id"))
    d = d.withColumn("cam", F.when(F.col("cam") == "7", None).otherwise(F.col("cam")))
    got = run.run_to_table(stream_fold(run.replay(d, "id", ["cam"]), ["cam"], "id", counting_step, "n long, total long")).collect()
    hot = [r for r in got if r["cam"] == "hot"]
    assert sum(r["n"] for r in hot) == 3000 == max(r["total"] for r in hot) and max(r["n"] for r in hot) <= 600
    assert sorted((r["cam"] or "", r["total"]) for r in got if r["cam"] != "hot") == sorted(("" if i == 7 else str(i), 1) for i in range(3000))


def test_odd_histograms_and_keypoints(spark):
    from framestory.operators import posture, quality

    d = spark.createDataFrame([(1, [1] * 256), (2, None), (3, [0] * 256), (4, [1, 2])], "frame_number long, luma_hist array<long>")
    got = {r["frame_number"]: r["mean_luminance"] for r in quality.luma_stats(d).collect()}
    assert got == {1: 127.5, 2: None, 3: None, 4: None}
    poses = spark.createDataFrame([(1, [[0.5, 0.5, 0.9]] * 5), (2, None), (3, [])], "pose_id long, keypoints array<array<double>>")
    assert posture.classify_pose(poses).count() == 3


def test_stream_tracker_equals_the_batch_log(spark):
    """Closing rows included."""
    cols = ["video_id", "frame_number", "track_key", "det_id", "action", "state"]
    batch, stream = (entry.queries()[q](spark, SF).select(cols) for q in ("track_lifecycle", "stream_tracker"))
    rows = lambda d: sorted(repr(tuple(r)) for r in d.collect())
    got = rows(stream)
    assert got == rows(batch) and any("closed" in r for r in got)


def test_lighting_stream_step_in_any_pieces():
    """Raw brightness in pieces gives what one piece gives, and what the definition says."""
    import random

    from framestory.operators.quality import lighting_step
    from framestory.streaming.steps import lighting_stream_step

    rng = random.Random(2)

    def middle(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    for n in (1, 2, 3, 4, 9, 11, 60, 200):
        b = [None if rng.random() < 0.2 else 60.0 + 90 * (i // 25 % 2) + rng.random() * 8 for i in range(n)]
        d = pd.DataFrame({"seq": range(n), "frame_number": [5 * i for i in range(n)], "timestamp_ms": [200.0 * i * (1 if i < n - 3 else 1.5) for i in range(n)], "brightness": b})
        raw, fill = [], 128.0
        for x in b:
            fill = fill if x is None else x
            raw.append(fill)
        smooth = [middle(raw[max(0, i - 2):i + 3]) for i in range(n)]
        base = [[smooth[j] for j in range(n) if -2000 <= d["timestamp_ms"][j] - d["timestamp_ms"][i] < 0] for i in range(n)]
        base = [middle(x or smooth[:10]) for x in base]
        r2 = lambda x: round(round(x * 1e10) / 1e10 * 100) / 100
        table = d.assign(baseline=[r2(x) for x in base], smoothed=[r2(x) for x in smooth], delta=[r2(x - y) for x, y in zip(smooth, base)])
        want = lighting_step(10.0, 2)(None, table, True)[1] if n >= 4 else []
        for size in (1, 3, 50, n):
            step, state, got = lighting_stream_step(), None, []
            for i in range(0, n, size):
                state, out = step(state, d.iloc[i:i + size], False)
                got += out
            got += step(state, d.iloc[:0], True)[1]
            assert got == want
