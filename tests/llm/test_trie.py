"""Prefix trie of stories against a plain one, and whitening against a direct decomposition."""

import hashlib
import random
import zlib

import numpy as np

from framestory.llm import queries, trie, whitening


def plain_trie(stories):
    nodes = {}
    for k, seq in stories.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(k)
    out = []
    for s, members in nodes.items():
        below = [x for x in nodes if x[:len(s)] == s]
        kids = lambda x: [y for y in nodes if len(y) == len(x) + 1 and y[:len(x)] == x]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(k) for k in sorted(k for k in members if tuple(stories[k]) == s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(kids(s)), sum(not kids(x) for x in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLS = ["segment_id", "depth", "parent", "n_segments", "n_children", "n_leaves", "saved_chars", "ends_sha256"]


def story_rows(rng):
    kinds = ["person_walking", "person_running", "loitering"]
    base = [(rng.choice(kinds), f"at zone {rng.randrange(3)} é") for _ in range(9)]
    rows, stories = [], {}
    for k in range(90):
        seq = base[:rng.randrange(8)] + [(rng.choice(kinds), "x" * rng.randrange(3)) for _ in range(rng.randrange(4))]
        if k % 10 == 0:
            seq = base
        stories[k] = seq
        rows += [(k, i, a, b, i) for i, (a, b) in enumerate(seq)]
    rows += [(200, None, "b", None, 7), (200, None, None, "c", 7), (200, 3, None, None, 7), (201, 1, "a", "z", 0), (201, 1, "a", "z", 0), (None, 1, "lost", "lost", 0)]
    stories[200], stories[201] = [("", "c"), ("b", ""), ("", "")], [("a", "z"), ("a", "z")]
    rng.shuffle(rows)
    return rows, stories


def test_story_trie_equals_plain(spark, monkeypatch):
    rows, stories = story_rows(random.Random(5))
    stories |= {300: [], 301: []}
    ev = spark.createDataFrame(rows, "segment_id long, seq long, event_type string, description string, depth long").repartition(3)
    segments = spark.createDataFrame([(k,) for k in stories] + [(None,), (300,)], "segment_id long")
    want = plain_trie(stories)
    for limit, size, run in ((2_000, 100_000, 10_000), (1, 40, 2), (5, 60, 3)):
        monkeypatch.setattr(trie, "RUN_EVENTS", run)
        monkeypatch.setattr(trie, "BLOB_IDS", 2)
        got = trie.story_trie(ev, segments, prefix_paths=limit, shard_events=size)
        assert got.columns == COLS
        assert sorted(tuple(r) for r in got.collect()) == want


def test_story_trie_edges(spark):
    ev = spark.createDataFrame([("s1", 1, "a", "b"), ("s2", 1, "a", "b")], "segment_id string, seq long, event_type string, description string")
    assert trie.story_trie(ev.where("false")).collect() == []
    bare = ev.select("segment_id").distinct()
    root = trie.story_trie(ev.where("false"), bare).collect()
    assert [tuple(r) for r in root] == plain_trie({"s1": [], "s2": []})
    assert sorted(tuple(r) for r in trie.story_trie(ev).collect()) == plain_trie({"s1": [("a", "b")], "s2": [("a", "b")]})


def test_long_story_is_a_tail(spark):
    n = 30_000
    ev = spark.range(n).selectExpr("1L AS segment_id", "id AS seq", "'walk' AS event_type", "cast(id AS string) AS description")
    ev = ev.unionByName(ev.where("seq < 5").withColumn("segment_id", ev["segment_id"] + 1))
    got = {(r["segment_id"], r["depth"]): r for r in trie.story_trie(ev).collect()}
    assert len(got) == n + 1
    assert got[1, 5]["n_segments"] == 2 and got[1, 5]["n_children"] == 1 and got[1, 0]["saved_chars"] == 5 and got[1, n]["n_children"] == 0
    assert got[1, 5]["ends_sha256"] == hashlib.sha256(b"2").hexdigest() and got[1, n]["ends_sha256"] == hashlib.sha256(b"1").hexdigest()


def test_double_array_holds_every_sequence():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 50, rng.integers(1, 7)) for _ in range(800)]
    packed, levels = trie.packed_trie(seqs)
    for s in seqs:
        state = np.array([0])
        for c in s:
            state = packed.follow(state, np.array([c]))
    assert sum(len(np.unique(lv[:, 1])) for lv in levels) == len({tuple(s[:i]) for s in seqs for i in range(1, len(s) + 1)})


def test_rebuilt_turns(spark):
    rng = random.Random(8)
    own = {c: [(rng.choice("ab"), str(rng.random())) for _ in range(rng.randrange(1, 9))] for c in [0, 3, 7, 100, 101, 205, 207, -3, 150]}
    rows = [(c, t, r, x) for c, ts in own.items() for t, (r, x) in enumerate(ts)] + [(None, 1, "a", "b")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for r in sorted(queries.rebuilt_turns(d).collect(), key=lambda r: (r["conv_id"], r["place"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        assert got.get(c, []) == own.get(base, [])[:h] + ts[h:]


def direct(x, k):
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return e[::-1][:k], c @ (u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])), e.sum(), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_direct_decomposition(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for width, blocks in ((40, 16), (5, 4096), (70, 300)):
        monkeypatch.setattr(whitening, "BLOCK_VECTORS", blocks)
        v = (rng.standard_normal((300, width)) * np.linspace(2, 0.5, width) + 3).astype(np.float32)
        rows = [(i, r.tolist(), i) for i, r in enumerate(v)]
        odd = [(900, None, 1), (901, [], 1), (902, [float("nan")] * width, 1), (903, [None] + [1.0] * (width - 1), 1), (904, [1.0], 1), (905, [float("inf")] * width, 1),
               (906, [1e300] * width, 1), (None, rows[0][1], 1), (0, rows[0][1], 1)]
        d = spark.createDataFrame(rows + odd, "track_id long, embedding array<float>, n long").repartition(4)
        x = np.floor(1024 * np.vstack([v, v[:1], v[:1]]).astype(np.float64)).astype(np.int64) + 100_000
        e, w, trace, deviation = direct(x, min(8, width))
        got = whitening.whiten_tracks(d).orderBy("track_id", "component").toPandas()
        k = min(8, width)
        assert len(got) == 302 * k and got["n"].eq(302).all()
        assert got["identity_error"].max() < 1e-10
        once = got[got["track_id"].notna() & (got["track_id"] > 0)]
        g = once["whitened"].to_numpy().reshape(-1, k)
        sign = np.sign((g * w[1:300]).sum(axis=0))
        assert np.abs(g * sign - w[1:300]).max() < 1e-8
        assert np.allclose(once["explained"].to_numpy()[:k], e / trace, rtol=1e-10)
        assert once["deviation"].to_numpy()[::k].tolist() == deviation[1:300].tolist()


def test_whitening_edges(spark):
    schema = "track_id long, embedding array<float>"
    assert whitening.whiten_tracks(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten_tracks(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], schema)  # one direction only
    got = whitening.whiten_tracks(flat).collect()
    assert [r["component"] for r in got] == [1] * 5 and abs(got[0]["explained"] - 1) < 1e-12
    big = spark.createDataFrame([(i, [float(i) * 1e14, 1.0]) for i in range(4)], schema)
    assert all(r["deviation"] is None for r in whitening.whiten_tracks(big).collect())


def test_leading_components_with_close_values():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    values = np.r_[np.linspace(3, 2.99, 9), np.linspace(2.9, 0, 191)]
    m = (q * values) @ q.T
    e, u = whitening.leading_components(lambda x: m @ x, 200, 8)
    assert np.allclose(e, values[:8], rtol=1e-12)
    assert np.abs(m @ u - u * e).max() < 1e-11
