"""Near-duplicate texts by their shingles against a comparison of all pairs."""

import random

import numpy as np

import corpus_pipeline
from framestory.llm import overlap, setjoin


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_case(rng):
    """Texts with scattered word edits, a large group around one text, a common passage, short and empty texts, odd ids."""
    word = lambda: f"w{rng.randrange(3000)}"
    edited = lambda ws, n: [word() if i in at else w for at in [set(rng.sample(range(len(ws)), n))] for i, w in enumerate(ws)]
    texts = []
    for _ in range(60):
        ws = [word() for _ in range(rng.choice([60, 120, 250]))]
        texts += [ws, edited(ws, rng.choice([1, 2, 3, 5])), edited(ws, max(1, round(len(ws) * rng.choice([0.02, 0.025, 0.03, 0.05])))), ws[:-rng.randrange(1, len(ws) // 4)]]
    base = [word() for _ in range(150)]
    texts += [edited(base, rng.choice([1, 2, 3])) for _ in range(50)]
    texts += [base[:100] + [word() for _ in range(n)] for n in range(5, 45)]
    texts += [["a", "b"], ["A", "b"], ["a"], [], [], [word() for _ in range(9)]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)] + [(900, None), (None, rows_text(texts[0])), (7, "another text under a known id " + " ".join(texts[9][:30])), (3, rows_text(texts[3]))]
    rng.shuffle(rows)
    return rows


def rows_text(ws):
    return " ".join(ws)


def plain_kept(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if share(sets[i], sets[j]) >= 0.8:
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, t) for i, (k, t) in enumerate(rows) if k is None or k == least[find(i)]), key=str)


def test_near_stage_equals_all_pairs(spark, monkeypatch):
    rows = near_case(random.Random(11))
    sets = [shingles(t) for _, t in rows]
    shares = [share(sets[i], sets[j]) for i in range(len(rows)) for j in range(i)]
    assert sum(0.8 <= x < 0.85 for x in shares) > 20 and sum(0.65 <= x < 0.75 for x in shares) > 20
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, v long").repartition(5)
    want = plain_kept(rows)
    for short, rounds, sample in ((32, 3, 2), (1, 1, 32), (1, 0, 1)):
        monkeypatch.setattr(setjoin, "SHORT_LIST", short)
        monkeypatch.setattr(setjoin, "CENTRES", rounds)
        monkeypatch.setattr(overlap, "ORDER_SAMPLE", sample)
        got = corpus_pipeline.near_stage(spark, d, "")
        assert got.columns == d.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    assert corpus_pipeline.near_stage(spark, d.where("false"), "").collect() == []


def test_near_stage_takes_simhash_candidates(spark, monkeypatch):
    """Long texts with one word changed come from fingerprints alone; a stage whose lists give nothing still joins them."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        ws = [f"w{rng.randrange(9000)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join([*ws[:1500], "other", *ws[1501:]]))]
    rows += [(100, "a b c d e f"), (101, "a b c d e g"), (102, ""), (103, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts = setjoin.texts_of(d, "doc_id", "text")
    prints, _ = setjoin.set_prints(texts, 5, lambda g: g[:0], fingerprint=True)
    vertices = setjoin.set_vertices(prints)
    of = {r["v"]: r["_least"] for r in vertices.collect()}
    found = {frozenset((of[r["a"]], of[r["b"]])) for r in overlap.fingerprint_pairs(vertices).collect()}
    edits = sum(frozenset((2 * k, 2 * k + 1)) in found for k in range(12))
    assert edits >= 6 and all(len(p) == 2 for p in found)
    monkeypatch.setattr(overlap, "common_lists", lambda p: setjoin.common_lists(p).where("false"))
    got = {r["_id"]: r["component"] for r in overlap.near_texts(d, "doc_id", "text", 5, 80).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(12)) == edits
    assert got[101] == 101 and got[103] == 102


def test_long_texts_that_meet_by_chance_are_told_apart_by_counts(spark, monkeypatch):
    """A shared passage brings long unrelated texts together; their whole sets stay where they are, the near ones are found."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(50_000)}"
    passage = [word() for _ in range(30)]
    texts = [passage + [word() for _ in range(rng.choice([900, 1000, 1100]))] for _ in range(30)]
    edited = [[word() if j % gap == 0 else w for j, w in enumerate(t)] for t, gap in zip(texts, [48, 45, 40, 500])]
    rows = [(i, rows_text(t)) for i, t in enumerate(texts + edited)]
    shares = [share(shingles(rows[i][1]), shingles(rows[30 + i][1])) for i in range(4)]
    assert min(shares) < 0.8 <= sorted(shares)[1] < 0.83
    asked, whole = [], setjoin.TextSets.shipped

    def shipped(self, wanted, *form):
        asked.append((bool(form) and form[0] is setjoin.bucket_counts, wanted.count()))
        return whole(self, wanted, *form)

    monkeypatch.setattr(setjoin.TextSets, "shipped", shipped)
    monkeypatch.setattr(overlap, "ORDER_TEXTS", 10**6)  # nothing counts as frequent, so the passage's shingles are as good as others
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, d, "").collect()), key=str)
    assert got == plain_kept(rows)
    assert sum(n for counts, n in asked if counts) > 20 and sum(n for counts, n in asked if not counts) < 20


def test_counts_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 300, 5000, 400_000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))
        x, y = (np.frombuffer(setjoin.bucket_counts(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))
