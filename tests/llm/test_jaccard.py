"""N-gram Jaccard join of briefs against a comparison of all pairs."""

import random

import numpy as np
import pytest

from framestory.llm import pigeonhole, setjoin


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def plain(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted([(k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)], key=str)


def brief_rows(rng):
    """Briefs with word edits, a group around one text, common passages of all sizes, short and empty briefs, odd keys."""
    word = lambda: f"w{rng.randrange(2000)}"

    def edited(ws, n):
        at = set(rng.sample(range(len(ws)), min(n, len(ws))))
        return [word() if i in at else w for i, w in enumerate(ws)]

    texts = []
    for _ in range(50):
        ws = [word() for _ in range(rng.choice([12, 30, 60, 120, 250]))]
        texts += [ws, edited(ws, rng.choice([1, 2, 3])), edited(ws, max(1, round(len(ws) * 0.02))), ws[:-rng.randrange(1, len(ws) // 8 + 2)]]
    base = [word() for _ in range(150)]
    texts += [edited(base, rng.choice([1, 2])) for _ in range(50)]
    texts += [base[:100] + [word() for _ in range(n)] for n in range(4, 44)]
    for n in range(1, 40):
        ws = [word() for _ in range(n)]
        texts += [ws, ws + [word()], ws[1:]]
    texts += [["a", "b"], ["A", "b"], ["a"], [], [], ["Ärger", "b"], ["ärger", "b"]]
    rows = [(i, " \t".join(ws)) for i, ws in enumerate(texts)] + [(900, None), (None, " ".join(texts[0])), (7, " ".join(texts[9])), (3, " ".join(texts[3])), (None, "lone text here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,short,stars", [(3, 90, 16, 2), (3, 90, 1, 0), (2, 80, 2, 1), (1, 70, 1, 0)])
def test_similar_briefs_equals_all_pairs(spark, monkeypatch, words, percent, short, stars):
    rows = brief_rows(random.Random(words + percent))
    monkeypatch.setattr(setjoin, "SHORT_LIST", short)
    monkeypatch.setattr(setjoin, "CENTRES", stars)
    monkeypatch.setattr(setjoin, "PAIR_RUN", 8)
    d = spark.createDataFrame([(*r, 1) for r in rows], "video_id long, brief string, component long").repartition(5)
    got = pigeonhole.similar_briefs(d, words=words, percent=percent)
    assert got.columns == ["video_id", "n_shingles", "component"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, words, percent)


def test_similar_briefs_empty(spark):
    d = spark.createDataFrame([], "video_id long, brief string")
    assert pigeonhole.similar_briefs(d).collect() == []
    d = spark.createDataFrame([(2, None), (1, " ")], "video_id long, brief string")
    assert sorted(map(tuple, pigeonhole.similar_briefs(d).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_near_sets_share_a_segment_even_after_reallocation(percent):
    """Sets at the limit meet whole on a segment, and on a widened one where all common segments are crowded."""
    rng = np.random.default_rng(percent)
    bands = pigeonhole.Bands(percent)
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        y = x
        while True:
            z = np.unique(np.append(y[rng.random(len(y)) > 0.02], rng.integers(0, 2 ** 63, int(rng.integers(0, 3))).astype(np.uint64)))
            both = len(np.intersect1d(x, z))
            if 100 * both < percent * (len(x) + len(z) - both):
                break
            y = z
        if not len(y):
            continue
        small, large = sorted([x, y], key=len)
        band = bands.of(len(small))
        assert band in bands.probed(len(small)) and band in bands.probed(len(large))
        m = bands.segments(band)
        (sx, ex), (sy, ey) = pigeonhole.cut(small, m), pigeonhole.cut(large, m)
        equal = sx == sy
        assert equal.any()
        costs = np.where(equal, 10_000, 0)
        skipped, kept, widened = pigeonhole.allocation(np.diff(ex), costs)
        assert len(skipped) == len(widened) and set(skipped) | set(kept) == set(np.flatnonzero(equal))
        if not len(kept):
            parts = lambda g, e, i: set(g[e[i]:e[i + 1]].tolist())
            assert any(len(parts(small, ex, i) ^ parts(large, ey, i)) == 1 for i in widened)
            met += 1
    assert met
