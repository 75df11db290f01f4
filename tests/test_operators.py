"""Operators on small literal tables, against brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.operators import compression, detections, events, evaluation, fusion, identity, interactions, sampling, scenes, story, tracking, zones

BOX = "x1 double, y1 double, x2 double, y2 double"


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)


def boxes(r, n):
    out = []
    for _ in range(n):
        x, y, s = r.random() * 0.7, r.random() * 0.7, 0.1 + r.random() * 0.2
        out.append((x, y, x + s, y + s))
    return out


def test_iou_is_symmetric_and_bounded(spark):
    r = random.Random(1)
    rows = [(*a, *b) for a, b in zip(boxes(r, 50), boxes(r, 50))] + [(0.1, 0.1, 0.3, 0.3, 0.3, 0.1, 0.5, 0.3)]
    d = spark.createDataFrame(rows, ", ".join(f"{p}{c} double" for p in "ab" for c in ("x1", "y1", "x2", "y2")))
    for row in d.select(g.iou("a", "b").alias("p"), g.iou("b", "a").alias("q")).collect():
        assert row.p == pytest.approx(row.q) and 0 <= row.p <= 1
    assert d.select(g.iou("a", "b")).collect()[-1][0] == 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_nms_matches_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(1, f, c, i, round(r.random(), 2), *b) for i, (f, c, b) in enumerate((r.randrange(2), r.choice("ab"), b) for b in boxes(r, 80))]
    keep = set()
    for key in {(x[1], x[2]) for x in rows}:
        kept = []
        for x in sorted((x for x in rows if (x[1], x[2]) == key), key=lambda x: (-x[4], x[3])):
            if all(iou(x[5:], y[5:]) <= 0.3 for y in kept):
                kept.append(x)
        keep |= {x[3] for x in kept}
    d = spark.createDataFrame(rows, f"video_id long, frame_number long, class_name string, det_id long, confidence double, {BOX}")
    got = {x.det_id for x in detections.nms_by_class(d, 0.3).collect()}
    assert got == keep and len(keep) < len(rows)


def test_links_match_greedy(spark):
    r = random.Random(4)
    edges = {(r.randrange(30), 100 + r.randrange(30)): round(r.random(), 2) for _ in range(200)}
    used_a, used_b, want = set(), set(), set()
    for (a, b), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    d = spark.createDataFrame([(1, a, b, w) for (a, b), w in edges.items()], "video_id long, a long, b long, iou double")
    assert {(x.a, x.b) for x in tracking.link_one_to_one(d).collect()} == want


def test_best_assignment_equals_all_matchings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = rng.integers(1, 7, 2)
        w = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.6), 2)
        pairs = tracking.best_assignment(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        big = np.zeros((max(n, m),) * 2)
        big[:n, :m] = w
        best = max(sum(big[i, p[i]] for i in range(len(big))) for p in itertools.permutations(range(len(big))))
        assert abs(sum(w[i, j] for i, j in pairs) - best) < 1e-9


def test_optimal_links_by_parts(spark):
    """Two boxes that greedy matching pairs badly, a lone pair, and a link that only makes room."""
    edges = [(1, 0, 1, 11, 0.9), (1, 0, 1, 12, 0.8), (1, 0, 2, 11, 0.8), (1, 0, 3, 13, 0.5), (1, 1, 5, 15, 0.3), (1, 1, 5, 16, 0.28), (1, 1, 6, 15, 0.2), (2, 0, 1, 11, 0.1)]
    d = spark.createDataFrame(edges, "video_id long, frame_rank long, a long, b long, iou double")
    got = {(r["video_id"], r["a"], r["b"]) for r in tracking.optimal_links(d, 0.25).collect()}
    assert got == {(1, 1, 12), (1, 2, 11), (1, 3, 13), (1, 5, 16)}
    assert tracking.optimal_links(d.where("false")).collect() == []


def test_tracks_keep_their_ids_when_boxes_compete(spark):
    """Two walkers of whom one steps between: greedy matching swaps them, the best total doesn't."""
    frames = [(0, 1, 0.0), (0, 2, 0.5), (5, 3, 0.3), (5, 4, 0.8)]
    rows = [(1, f, i, "person", 0.9, x, 0.0, x + 1.0, 1.0) for f, i, x in frames]
    d = spark.createDataFrame(rows, f"video_id long, frame_number long, det_id long, class_name string, confidence double, {BOX}")
    owner = lambda cfg: {r["det_id"]: r["track_key"] for r in tracking.track_lifecycle(d, cfg=cfg).where("det_id is not null").collect()}
    assert owner(tracking.TrackerConfig(optimal=True)) == {1: 1, 2: 2, 3: 1, 4: 2}
    assert owner(tracking.TrackerConfig())[3] == 2


def brute_tracker(frames, cfg):
    """Greedy frame-by-frame tracker on plain tuples: {det_id: key}."""
    live, owner = [], {}
    for f in sorted(frames):
        dets = frames[f]
        pairs = sorted((-iou(t["box"], d[2]), t["key"], d[0]) for t in live for d in dets if iou(t["box"], d[2]) >= cfg.iou_threshold)
        match = {}
        for _, k, i in pairs:
            if k not in match and i not in match.values():
                match[k] = i
        by_id = {d[0]: d for d in dets}
        free = [d[0] for d in dets if d[0] not in match.values()]
        nxt = []
        for t in live:
            d = by_id.get(match.get(t["key"]))
            if d is not None and d[1] == t["cls"]:
                owner[d[0]] = t["key"]
                nxt.append({**t, "box": d[2], "lost": 0, "n": t["n"] + 1})
                continue
            if d is not None:
                free.append(d[0])
            lost = t["lost"] + 1
            if lost <= (cfg.max_lost if t["n"] >= cfg.confirm else max(cfg.confirm, 2)):
                nxt.append({**t, "lost": lost})
        for i in free:
            if by_id[i][3] >= cfg.min_confidence:
                owner[i] = i
                nxt.append({"key": i, "cls": by_id[i][1], "box": by_id[i][2], "lost": 0, "n": 1})
        live = nxt
    return owner


def moving_scene(seed, frames=40, people=5):
    r = random.Random(seed)
    out, ident = {}, 0
    pos = [[r.random() * 0.6, r.random() * 0.6, (r.random() - 0.5) * 0.03, (r.random() - 0.5) * 0.03] for _ in range(people)]
    for f in range(frames):
        out[f] = []
        for i, p in enumerate(pos):
            p[0], p[1] = p[0] + p[2], p[1] + p[3]
            if r.random() < 0.85:
                out[f].append((ident, "car" if i == 0 else "person", (p[0], p[1], p[0] + 0.15, p[1] + 0.2), 0.2 + r.random() * 0.8))
                ident += 1
    return out


@pytest.mark.parametrize("seed", [3, 9])
def test_lifecycle_matches_brute_force(spark, seed):
    frames = moving_scene(seed)
    cfg = tracking.TrackerConfig(max_lost=3)
    rows = [(1, f, *([i, c, s, *b] if i is not None else [None] * 7)) for f, ds in frames.items() for i, c, b, s in (ds or [(None, None, None, None)])]
    d = spark.createDataFrame(rows, f"video_id long, frame_number long, det_id long, class_name string, confidence double, {BOX}")
    got = {x.det_id: x.track_key for x in tracking.track_lifecycle(d.where("det_id is not null"), d, cfg).where("det_id is not null").collect()}
    assert got == brute_tracker(frames, cfg)


def test_track_batch_chains_are_consistent(spark):
    frames = moving_scene(5)
    rows = [(1, f, i, c, s, *b) for f, ds in frames.items() for i, c, b, s in ds]
    d = spark.createDataFrame(rows, f"video_id long, frame_number long, det_id long, class_name string, confidence double, {BOX}")
    got = tracking.track_batch(d, 0.25, 3, 0.0).toPandas()
    assert sorted(got["det_id"]) == sorted(x[2] for x in rows)
    for _, t in got.groupby("track_id"):
        assert t["frame_number"].is_unique and t["class_name"].nunique() == 1
        t = t.sort_values("frame_rank")
        assert (t["frame_rank"].diff().dropna() <= 4).all()
        b = t[["x1", "y1", "x2", "y2"]].values.tolist()
        assert all(iou(p, q) >= 0.25 for p, q in zip(b, b[1:]))
    first = got.groupby("track_id")["frame_number"].min().sort_index()
    assert list(first.index) == list(range(1, len(first) + 1)) and first.is_monotonic_increasing


def test_reid_matches_brute_force(spark):
    import numpy as np
    r = np.random.default_rng(2)
    base = r.normal(size=(4, 8))
    rows = []
    for i in range(40):
        v = base[i % 4] + r.normal(size=8) * 0.5
        rows.append((1, i, i * 100.0, [float(x) for x in v / np.linalg.norm(v)] if i % 9 else None))
    gallery, nxt, plain, want = [], 1, set(), {}
    for _, t, _, v in rows:
        if v is None:
            k = next(k for k in range(1, 100) if k not in plain and k not in {e[0] for e in gallery})
            plain.add(k)
            want[t] = f"Person {k}"
            continue
        sims = [float(np.dot(v, e[1])) for e in gallery]
        best = int(np.argmax(sims)) if sims else None
        if best is not None and sims[best] >= 0.52:
            e = gallery[best]
            m = (e[1] * e[2] + np.asarray(v)) / (e[2] + 1)
            e[1], e[2] = m / (np.linalg.norm(m) + 1e-8), e[2] + 1
            want[t] = f"Person {e[0]}"
        else:
            gallery.append([nxt, np.asarray(v), 1])
            want[t] = f"Person {nxt}"
            nxt += 1
    d = spark.createDataFrame(rows, "video_id long, track_id long, start_ms double, embedding array<double>")
    assert {x.track_id: x.person_label for x in identity.reid_assign(d, block=7).collect()} == want


def test_consolidation_matches_leader_loop(spark):
    import numpy as np
    r = np.random.default_rng(6)
    base = r.normal(size=(3, 6))
    vs = [base[i % 3] + r.normal(size=6) * 0.4 for i in range(15)]
    vs = [v / np.linalg.norm(v) for v in vs]
    w = [int(x) for x in r.integers(1, 5, 15)]
    emb, cnt, gone, want = [v.copy() for v in vs], w[:], set(), {}
    for i in range(15):
        if i in gone:
            continue
        want[f"p{i}"] = f"p{i}"
        for j in range(i + 1, 15):
            if j not in gone and float(emb[i] @ emb[j]) >= 0.72:
                m = (emb[i] * cnt[i] + emb[j] * cnt[j]) / (cnt[i] + cnt[j])
                emb[i], cnt[i] = m / (np.linalg.norm(m) + 1e-8), cnt[i] + cnt[j]
                gone.add(j)
                want[f"p{j}"] = f"p{i}"
    d = spark.createDataFrame([(1, i, f"p{i}", [float(x) for x in v], c) for i, (v, c) in enumerate(zip(vs, w))],
                              "video_id long, person_no long, person_label string, embedding array<double>, track_count long")
    assert {x.person_label: x.merged_label for x in identity.consolidate_gallery(d, block=4).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_policy_matches_sequential_budget(spark, seed):
    r = random.Random(seed)
    rows = []
    for v in (1, 2, 3):
        n = {1: 60, 2: 8, 3: 2}[v]
        for i in range(n):
            rows.append((v, i, f"s{v}-{i}", r.choice([1, 2, 3, 5, 8, 30]) if v != 3 else 12, r.choice(["complete", "partial", "partial", "partial"]) if v == 1 else "partial",
                         round(r.random(), 2) if v == 1 else 0.5, 1.0 - i / 100, i + 1))
    want = {}
    for v in (1, 2, 3):
        segs = sorted((x for x in rows if x[0] == v), key=lambda x: x[7])
        total = sum(x[3] for x in segs)
        done = [x for x in segs if x[5] >= 0.2 and x[4] == "complete"]
        left = max(0, int(total * 0.4) - sum(x[3] for x in done))
        any_kept = False
        for x in segs:
            if x[5] < 0.2:
                want[x[2]] = (False, "low_narrative_quality")
            elif x[4] == "complete":
                want[x[2]] = (True, "complete_chain_preserved")
            elif total <= 20:
                want[x[2]] = (True, "high_combined_rank")
            elif x[3] <= left or (left == 0 and not any_kept and not done):
                want[x[2]], any_kept, left = (True, "high_combined_rank"), True, left - x[3]
            else:
                want[x[2]] = (False, "below_ratio_threshold")
    d = spark.createDataFrame(rows, "video_id long, track_id long, segment_id string, event_count long, completeness string, narrative_score double, combined_rank double, rank long")
    got = {x.segment_id: (x.keep, x.reason) for x in compression.compression_policy(d, block=7).collect()}
    assert got == want


def test_last_chance_keeps_one_chain(spark):
    d = spark.createDataFrame([(1, 1, "a", 50, "partial", 0.5, 0.9, 1), (1, 2, "b", 1, "partial", 0.5, 0.8, 2)],
                              "video_id long, track_id long, segment_id string, event_count long, completeness string, narrative_score double, combined_rank double, rank long")
    got = {x.segment_id: x.keep for x in compression.compression_policy(d, target_ratio=0.0).collect()}
    assert got == {"a": True, "b": False}


SEM = "video_id long, track_id long, event_id long, event_type string, start_ms double, end_ms double, confidence double"


def chain(*types, track=1, start=0.0, step=1000.0):
    return [(1, track, track * 100 + i, t, start + i * step, start + i * step + 500, 0.8) for i, t in enumerate(types)]


@pytest.mark.parametrize("types,kind", [
    (["person_entered_scene", "person_walking", "person_left_scene"], "complete"), (["person_entered_scene", "person_left_scene"], "partial"),
    (["person_entered_scene"], "entry_only"), (["person_left_scene"], "exit_only"), (["person_walking"], "minimal"), (["person_walking", "person_running"], "partial"),
    (["person_entered_scene", "cycling", "person_left_scene"], "complete")])
def test_completeness(spark, types, kind):
    assert story.story_segments(spark.createDataFrame(chain(*types), SEM)).first().completeness == kind


def test_continuity_counts_terminal_from_the_second_after_it(spark):
    rows = chain("person_left_scene", "person_walking", "person_running")
    got = [x for x in story.continuity(spark.createDataFrame(rows, SEM)).orderBy("seq").collect()]
    assert [x.after_terminal for x in got] == [False, False, True]
    assert [x.invalid_succession for x in got] == [False, True, False]


def test_segment_interaction_counts_equal_pairs(spark):
    r = random.Random(8)
    rows = [x for t in range(1, 25) for x in chain("person_walking", "person_running", track=t, start=r.random() * 60_000, step=r.random() * 5000)]
    seg = story.story_segments(spark.createDataFrame(rows, SEM))
    pairs = story.segment_interactions(seg, width=3000.0)
    ends = pairs.select(F.col("track_a").alias("t")).unionByName(pairs.select(F.col("track_b").alias("t"))).groupBy("t").count()
    want = {x.t: x["count"] for x in ends.collect()}
    got = {x.track_id: x.interacting_segments for x in story.interaction_counts(seg, block=5).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == 24


def test_merge_takes_first_row_last_end_and_best_confidence(spark):
    rows = [(1, 1, 1, "a", 0.0, 100.0, 0.5), (1, 1, 2, "a", 2000.0, 2100.0, 0.9), (1, 1, 3, "a", 9000.0, 9100.0, 0.4), (1, 2, 4, "a", 2100.0, 2200.0, 0.7)]
    got = {(x.track_id, x.event_id): (x.end_ms, x.confidence, x.merged_count) for x in events.merge_adjacent(spark.createDataFrame(rows, SEM), block=2).collect()}
    assert got == {(1, 1): (2100.0, 0.9, 2), (1, 3): (9100.0, 0.4, 1), (2, 4): (2200.0, 0.7, 1)}


def test_fusion_strategies_and_weights(spark):
    d = spark.createDataFrame([(0.8, 0.6, 0.9, 1.0, 1.0)], ", ".join(c + " double" for c in fusion.DIMS))
    v = {s: d.select(fusion.fuse(s)).first()[0] for s in ("weighted_linear", "geometric", "harmonic", "min")}
    assert v["weighted_linear"] == pytest.approx(0.8 * .3 + .6 * .25 + .9 * .2 + .15 + .1)
    assert v["min"] == 0.6 and v["harmonic"] <= v["geometric"] <= v["weighted_linear"]
    with pytest.raises(ValueError):
        fusion.fuse(weights=(0.5, 0.5, 0.5, 0.0, 0.0))


def test_every_rule_has_a_prior_and_types_have_roles():
    assert len(fixed.RULES) == 11 and all(0 < r[-1] <= 1 for r in fixed.RULES)
    assert not set(fixed.ENTRY_TYPES) & set(fixed.EXIT_TYPES)


def test_zone_first_sight_and_exit_zone_naming(spark):
    poly = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    z = spark.createDataFrame([(1, "z", "Z", "exit", poly)], "video_id long, zone_id string, zone_name string, zone_type string, polygon array<struct<x:double,y:double>>")
    path = [0.25, 0.75, 0.25]
    o = spark.createDataFrame([(1, 1, i, i * 5, i * 200.0, 0.9, x - .01, .24, x + .01, .26) for i, x in enumerate(path)],
                              f"video_id long, track_id long, seq long, frame_number long, timestamp_ms double, confidence double, {BOX}")
    got = [(x.event_type, x.cold_start) for x in zones.zone_crossings(o, z, block=2).orderBy("seq").collect()]
    assert got == [("zone_entry", True), ("zone_entry", False), ("zone_exit", False)]


def test_categories(spark):
    names = {"person": "people", "sofa bed": "furniture", "cell phone": "electronics", "Coffee Mug": "drinkware", "woman": "people", "drone": "object", "umbrella": "bag"}
    d = spark.createDataFrame([(n,) for n in names], "c string")
    assert {x.c: x.k for x in d.select("c", detections.category_of(F.col("c")).alias("k")).collect()} == names


def test_video_checks(spark):
    rows = [(1, "a.mp4", 10, "h264", 5.0, 640, 480, 25.0), (2, "a.txt", 10, "h264", 0.0, 640, 480, 25.0), (3, "a.mkv", 0, "h264", 5.0, 640, 480, 25.0),
            (4, "a.mp4", 10, "theora", 0.0, 32, 480, 500.0)]
    d = spark.createDataFrame(rows, "video_id long, filename string, size_bytes long, codec string, duration_seconds double, width int, height int, fps double")
    got = {x.video_id: (x.is_valid, len(x.errors), len(x.warnings)) for x in sampling.validate_video_rows(d).collect()}
    assert got == {1: (True, 0, 0), 2: (False, 1, 0), 3: (False, 1, 0), 4: (False, 2, 2)}


def test_scene_threshold_starts_from_its_prefill(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate([None, 0.05, 0.25, 0.05])], "video_id long, seq long, composite double")
    got = [x.adaptive_threshold for x in scenes.adaptive_threshold(d).orderBy("seq").collect()]
    import numpy as np
    win = [0.05] * 49 + [0.25]
    assert got[1] == pytest.approx(0.05) and got[3] == pytest.approx(np.mean(win) + 1.5 * np.std(win))


def test_missing_frame_counts_as_duplicate(spark):
    d = spark.createDataFrame([(1, 0, None, 0.05), (1, 1, None, 0.05), (1, 2, 0.9, 0.05)], "video_id long, seq long, composite double, adaptive_threshold double")
    got = [(x.is_duplicate, x.is_keyframe, x.decision) for x in scenes.classify_scene_frame(d).orderBy("seq").collect()]
    assert got == [(False, True, "first_frame"), (True, False, "duplicate"), (False, True, "hard_cut")]


def test_dedup_measures_from_the_last_kept(spark):
    rows = [(1, 1, i, "a", t, t, 0.5) for i, t in enumerate([0.0, 2000.0, 3500.0, 6000.0, 6600.0])]
    got = interactions.dedup_within(spark.createDataFrame(rows, SEM), 3000.0, order=("start_ms", "event_id"))
    assert sorted(x.event_id for x in got.collect()) == [0, 2, 4]


def test_binary_metrics_totals(spark):
    rows = [("a", True, True), ("a", False, True), ("b", True, False), ("b", False, False)]
    got = {x.label: (x.tp, x.fp, x.tn, x.fn) for x in evaluation.binary_metrics(spark.createDataFrame(rows, "label string, truth boolean, fired boolean")).collect()}
    assert got["*"] == (1, 1, 1, 1) and got["a"] == (1, 1, 0, 0)


def test_consolidated_gallery_names_every_person(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    named = {(r["video_id"], r["person_label"]) for r in entry.queries()["reid_assign"](spark, sf).collect()}
    assert {(r["video_id"], r["person_label"]) for r in entry.queries()["consolidate_gallery"](spark, sf).collect()} == named


def test_gallery_matches_visit_little_of_a_hot_video(spark, monkeypatch):
    """All best matches of a video with many persons, from a small part of the products."""
    import numpy as np

    from framestory.operators import identity

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    looks = unit(rng.standard_normal((60, 48)))
    people = unit(looks[rng.integers(0, 60, 3000)] + 0.05 * rng.standard_normal((3000, 48)))
    tracks = unit(people[rng.integers(0, 3000, 2000)] + 0.02 * rng.standard_normal((2000, 48))) * rng.uniform(0.5, 2, (2000, 1))
    people[17] = people[16]  # a tie
    t = [(1, i, v.tolist()) for i, v in enumerate(tracks)] + [(2, 0, [1.0, 0.0]), (2, 1, None), (2, 2, []), (2, 3, [0.0, 0.0]), (3, 0, [1.0, 0.0])]
    g = [(1, f"P{i:04d}", v.tolist()) for i, v in enumerate(people)] + [(2, "A", [0.0, 1.0]), (2, "B", [0.8, 0.6]), (2, "C", [1.0]), (2, "D", None)]
    td = spark.createDataFrame(t, "video_id long, track_id long, embedding array<double>").repartition(4)
    gd = spark.createDataFrame(g, "video_id long, person_label string, embedding array<double>").repartition(4)
    monkeypatch.setattr(identity, "BLOCK_PERSONS", 64)
    monkeypatch.setattr(identity, "BATCH_TRACKS", 64)
    got = {(r["video_id"], r["track_id"]): (r["person_label"], r["similarity"]) for r in identity.gallery_matches(td, gd, 0.5).collect()}
    s = tracks @ people.T
    want = {(1, i): int(s[i].argmax()) for i in range(2000) if s[i].max() >= 0.5}
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {k: f"P{j:04d}" for k, j in want.items()}
    assert got[2, 0] == ("B", 0.8) and {k for k in got if k[0] != 1} == {(2, 0)}
    batches, blocks, pairs = identity.gallery_visits(td, gd, 0.5)
    n = (pairs.join(batches.selectExpr("group AS batch", "size(ids) AS b"), "batch").join(blocks.selectExpr("group AS block", "size(ids) AS p"), "block")
         .selectExpr("sum(b * p)").first()[0])
    assert n < 0.15 * 2000 * 3000


def test_optimal_links_solves_many_frame_pairs_at_once(spark):
    """Parts of all sizes against every possible assignment; no Python call per frame pair."""
    rng, rows = random.Random(3), []
    for rank in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        edges = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.6]
        rows += [(rank % 2, rank, 100 * rank + i, 100 * rank + j, rng.randrange(1, 100) / 100) for i, j in edges]

    def best(edges):
        if not edges:
            return 0.0
        (a, b, w), rest = edges[0], edges[1:]
        return max(best(rest), w + best([e for e in rest if e[0] != a and e[1] != b]))

    links = tracking.optimal_links(spark.createDataFrame(rows, "video_id long, frame_rank long, a long, b long, iou double").repartition(5), 0.0)
    assert "FlatMapGroups" not in links._jdf.queryExecution().toString()
    got = links.collect()
    for rank in range(60):
        mine = [(r["a"], r["b"], r["iou"]) for r in got if r["frame_rank"] == rank]
        assert len({a for a, _, _ in mine}) == len({b for _, b, _ in mine}) == len(mine)
        assert abs(sum(w for _, _, w in mine) - best([r[2:] for r in rows if r[1] == rank])) < 1e-9


def counted_folds(monkeypatch, module):
    calls = []
    fold = module.ordered_fold
    monkeypatch.setattr(module, "ordered_fold", lambda *a, **k: calls.append(1) or fold(*a, **k))
    return calls


def test_skip_sweep_takes_one_pass(spark, monkeypatch):
    from framestory.operators import sampling
    rng = random.Random(8)
    rows = [(v, i, rng.choice([0.0, 0.02, 0.05, 0.1, 0.2])) for v in range(2) for i in range(300)]
    d = spark.createDataFrame(rows, "video_id long, seq long, motion_fraction double")
    calls = counted_folds(monkeypatch, sampling)
    whole = sorted(map(tuple, sampling.skip_variant_sweep(d, (50, 75)).collect()))
    assert len(calls) == 1 and len(whole) == 6 and {r[2] for r in whole} == {300}
    assert sorted(map(tuple, sampling.skip_variant_sweep(d, (50, 75), block=17).collect())) == whole


def test_thresholds_are_compared_in_one_pass(spark, monkeypatch):
    from framestory.operators import quality
    rng = random.Random(9)
    rows = [(v, i, 10 * i, i * 40.0, 50.0, 50.0 + x, x) for v in range(2) for i in range(200) for x in [rng.choice([0.0, 12.0, 18.0, 25.0, -12.0, -30.0])]]
    d = spark.createDataFrame(rows, "video_id long, seq long, frame_number long, timestamp_ms double, baseline double, smoothed double, delta double")
    want = []
    for t in (10.0, 15.0, 20.0):
        one = quality.merge_lighting(quality.lighting_events(d, t)).groupBy("video_id", "event_type").count().collect()
        want += [(t, r["video_id"], r["event_type"], r["count"]) for r in one]
    calls = counted_folds(monkeypatch, quality)
    got = quality.threshold_comparison(d)
    assert len(calls) == 2
    assert sorted((r["threshold"], r["video_id"], r["event_type"], r["events"]) for r in got.collect()) == sorted(want)


def test_later_gaps_look_only_at_what_is_open(spark, monkeypatch):
    rows = [(1, f, 10 * f + k, "person", 0.9, 0.1 + 0.4 * k, 0.1, 0.3 + 0.4 * k, 0.4) for f in range(6) for k in range(2) if (f, k) != (3, 1)]
    d = spark.createDataFrame(rows, "video_id long, frame_number long, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    d = d.union(d.where("frame_number = 0").selectExpr("video_id", "3 AS frame_number", "99 AS det_id", "'car' AS class_name", "confidence", "x1", "y1", "x2", "y2").limit(1))
    seen, pairs = [], tracking._pairs
    monkeypatch.setattr(tracking, "_pairs", lambda a, b, *rest: seen.append((a.count(), "confidence" in a.columns)) or pairs(a, b, *rest))
    got = {r["det_id"]: r["track_id"] for r in tracking.track_batch(d).collect()}
    assert len({got[10 * f] for f in range(6)}) == 1 and got[21] == got[41] and len(set(got.values())) == 3
    assert [n for n, _ in seen] == [12, 4, 3, 3] and not any(wide for _, wide in seen)


def test_posture_baseline_adds_in_row_order(spark):
    """A box that equals a share of the baseline but for float noise is decided alike however the rows arrive."""
    from framestory.operators import posture

    rnd = random.Random(7)
    tracks = {t: [rnd.uniform(1.0, 2.9) for _ in range(40)] for t in range(60)}
    rows = [(0, t, i, i, i * 40.0, 0.0, 0.0, 1.0, a) for t, heights in tracks.items() for i, a in enumerate(heights)]
    rnd.shuffle(rows)
    obs = spark.createDataFrame(rows, "video_id long, track_id long, seq long, frame_number long, timestamp_ms double, x1 double, y1 double, x2 double, y2 double")

    def baseline(heights, block):
        up, total = [[a for a in heights[i:min(i + block, 10)] if a >= 1.4] for i in range(0, 10, block)], 0.0
        for part in up:
            here = 0.0
            for a in part:
                here += a
            total += here
        return total / sum(map(len, up))

    for block in (100, 4):
        got = {r.track_id: r.baseline for r in posture.with_baseline(obs, block=block).select("track_id", "baseline").distinct().collect()}
        assert got == {t: baseline(h, block) for t, h in tracks.items()}
