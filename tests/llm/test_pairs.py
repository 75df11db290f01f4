"""Top-k search, SimHash classes and line classes against plain versions."""

import random

import pytest

import numpy as np
import xxhash

from framestory.llm import gallery, lines, simhash
from framestory.llm.graph import components


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)]
    want = roots(300, edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: want[n] for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_topk_matches_plain_product(spark, monkeypatch):
    for name, value in (("BLOCK_VECTORS", 7), ("QUERY_BATCH", 3), ("CHUNK_BLOCKS", 4)):
        monkeypatch.setattr(gallery, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    vectors = [(i, (centres[i % 5] + rng.normal(size=8) * 0.2).astype(np.float32).tolist(), 1, "x", 2) for i in range(150)]
    vectors += [(200 + i, vectors[3][1], 1, "x", 2) for i in range(9)]  # ties
    bad = [(300, None, 1, "x", 2), (301, [1.0, None], 1, "x", 2), (302, [float("nan")] * 8, 1, "x", 2), (350, [float("inf")] * 8, 1, "x", 2), (None, vectors[0][1], 1, "x", 2)]
    d = spark.createDataFrame(vectors + bad, "track_id long, embedding array<float>, batch_id long, ids string, score long")
    got = gallery.gallery_topk(d, d.where("track_id % 50 = 0"), 5, scale=256)
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v, *_ in vectors}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = d.where("false")
    assert gallery.gallery_topk(none, none, 5).collect() == [] and gallery.gallery_topk(d, none, 5).collect() == []
    two = d.where("track_id IN (0, 1)")
    assert [(r["query_id"], r["track_id"]) for r in gallery.gallery_topk(two, two.where("track_id = 0"), 5).collect()] == [(0, 1)]


def test_large_components_stay_exact(spark):
    d = spark.createDataFrame([(0, [1e12, 1.0]), (1, [3e3, 7.0]), (2, [3e3, 8.0])], "track_id long, embedding array<double>")
    got = [(r["track_id"], r["score"]) for r in gallery.gallery_topk(d, d.where("track_id = 0"), 2, scale=1).orderBy("rank").collect()]
    assert got == [(2, int(1e12) * 3000 + 8), (1, int(1e12) * 3000 + 7)]


def plain_fingerprint(text, words=3):
    w = (text or "").encode().translate(simhash.UPPER).split()
    shingles = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_plain_version(spark):
    rng = random.Random(1)
    vocabulary = ["Door", "open", "ERROR", "été", "frame", "lost", "x1", "track", "😀", "zone"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 200]))) for _ in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, " \t\n", "x", 1), (103, texts[4], "x", 1), (103, texts[4], "x", 1), (None, texts[4], "x", 1),
             (104, texts[4] + "  ", "x", 1), (105, "lorem ipsum dolor " * 9000, "x", 1), (106, "lorem ipsum dolor " * 9001, "x", 1)]
    d = spark.createDataFrame(rows, "failure_id long, description string, fingerprint string, component long")
    got = simhash.near_failures(d).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    r = roots(len(rows), links)
    least = {x: min((rows[i][0] for i in range(len(rows)) if r[i] == x and rows[i][0] is not None), default=None) for x in set(r)}
    want = [(rows[i][0], f"{prints[i]:016x}", least[r[i]]) for i in range(len(rows))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_failures(d.where("false")).collect() == []


def test_no_near_pair_is_missed(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):  # chains of up to two bits
            for _ in range(rng.choice([1, 2, 3])):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, 1, 3, 1 << 63, (1 << 64) - 1}
    values = sorted(values)
    d = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fingerprint binary")
    got = dict(components(simhash.near_links(d, 64, 2)).collect())
    links = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 2]
    r = roots(len(values), links)
    want = {v.to_bytes(8, "big"): values[r[i]].to_bytes(8, "big") for i, v in enumerate(values) if sum(x == r[i] for x in r) > 1}
    assert {bytes(k): bytes(v) for k, v in got.items()} == want


def test_wide_fingerprints(spark):
    """128 bits link at two differing bits or fewer, all pairs of them; wider limits are refused."""
    rng = random.Random(2)
    values = {rng.getrandbits(128) for _ in range(30)}
    values |= {v ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for v in values}
    values = sorted(values)
    d = spark.createDataFrame([(bytearray(v.to_bytes(16, "big")),) for v in values], "fingerprint binary")
    got = {bytes(k): bytes(v) for k, v in components(simhash.near_links(d, 128, 2)).collect()}
    r = roots(len(values), [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 2])
    assert got == {v.to_bytes(16, "big"): values[r[i]].to_bytes(16, "big") for i, v in enumerate(values) if sum(x == r[i] for x in r) > 1}
    with pytest.raises(ValueError):
        simhash.near_failures(spark.createDataFrame([(1, "a")], "failure_id long, description string"), bits=128, max_bits=19)


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def line_case():
    rng = random.Random(4)
    base = ["camera seven lost its signal at the north gate", "a person walks along the platform slowly", "x" * 30, "short", "", "é😀" * 15]
    rows = [(0, None), (1, ""), (2, "\n".join(base)), (2, "\n".join(base)), (3, "\n".join(base[:2])), (None, base[0] + "\nno key stands here, a line of its own")]
    for i in range(4, 40):
        out = []
        for _ in range(rng.randrange(1, 5)):
            s = list(rng.choice(base[:3] + base[5:]))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, kind = rng.randrange(len(s)), rng.randrange(3)
                s[at:at + (kind != 0)] = [] if kind == 2 else [rng.choice("abcxyz ")]
            out.append("".join(s))
        rows.append((i, "\n".join(out)))
    rows += [(50 + i, f"frame number {i % 10}{i // 10} of the long recording was dropped") for i in range(30)]
    return rows + [(90, "long " * 20000), (91, "long " * 20000 + "!")]


def plain_classes(rows, least):
    places = [(k, n, x) for k, t in rows for n, x in enumerate((t or "").split("\n"))]
    lines_ = sorted({x for _, _, x in places if len(x) >= least})
    r = roots(len(lines_), [(a, b) for a in range(len(lines_)) for b in range(a) if distance_at_most_one(lines_[a], lines_[b])])
    of = {x: r[i] for i, x in enumerate(lines_)}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    heads = {}
    for k, n, x in places:
        if x in of:
            heads[of[x]] = min(heads.get(of[x], (k, n)), (k, n), key=order)
    out = []
    for k, n, x in places:
        head = heads[of[x]] if x in of else (k, n)
        out.append((k, n, len(x), *head, head == (k, n)))
    return out


def test_line_classes_match_plain_version(spark, monkeypatch):
    rows = line_case()
    d = spark.createDataFrame([(*r, "c", 1, "f") for r in rows], "job_id long, log string, line_no string, list long, first string")
    want = sorted(plain_classes(rows, lines.MIN_CHARS), key=str)
    for short in (64, 2):  # with 2, nearly every list is cut level by level
        monkeypatch.setattr(lines, "SHORT_LIST", short)
        assert sorted(map(tuple, lines.line_classes(d).collect()), key=str) == want
    assert lines.line_classes(d.where("false")).collect() == []


def test_dedup_lines_keeps_first_places(spark):
    rows = line_case()
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "job_id long, log string, line_no string, _id long")
    kept = {}
    for k, n, _, _, _, keep in plain_classes(rows, lines.MIN_CHARS):
        kept.setdefault(k, set()).update({n} if keep else set())
    want = []
    for k, t in rows:
        ls = (t or "").split("\n")
        left = [x for n, x in enumerate(ls) if n in kept[k]]
        if left:
            want.append((k, t if len(left) == len(ls) else "\n".join(left), "c", 1))
    got = lines.dedup_lines(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert lines.dedup_lines(d.where("false")).collect() == []
