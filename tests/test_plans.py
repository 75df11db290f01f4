"""Two-level ordered helpers against plain pandas, with blocks and slots far smaller than the keys."""

import random

import pandas as pd
from pyspark.sql import functions as F

from framestory.plans.fold import ordered_fold
from framestory.plans.intervals import overlap_pairs
from framestory.plans.nearest import nearest
from framestory.plans.sequence import fill_along, grouped_median, index_rows, over_blocks, running_sum, walk_rows


def hot(n=400, seed=3):
    """Rows where one key holds most of everything."""
    r = random.Random(seed)
    return pd.DataFrame({"k": ["hot" if r.random() < 0.7 else f"k{r.randrange(4)}" for _ in range(n)], "t": [r.randrange(5000) for _ in range(n)],
                         "id": range(n), "v": [r.choice([None, r.random()]) for _ in range(n)]})


def indexed(spark):
    p = hot()
    d = spark.createDataFrame(p, "k string, t long, id long, v double")
    return p, index_rows(d, ["k"], ["t", "id"], F.floor(F.col("t") / 97).cast("long"))


def test_index_rows(spark):
    p, d = indexed(spark)
    want = p.sort_values(["k", "t", "id"]).assign(seq=lambda x: x.groupby("k").cumcount()).set_index("id")["seq"]
    got = d.toPandas().set_index("id")["seq"]
    assert (got.sort_index() == want.sort_index()).all()


def test_walk_rows(spark):
    """Looks back and places are the same whether keys stay whole or are cut into slots."""
    p = hot()
    d = spark.createDataFrame(p, "k string, t long, id long, v double")
    p = p.sort_values(["k", "t", "id"])
    p["seq"] = p.groupby("k").cumcount()
    p["pt"] = p.groupby("k")["t"].shift().fillna(-1)
    p["hit"] = p["seq"].where(p["id"] % 40 == 7)
    p["ft"] = p.groupby("k")["hit"].cummin().groupby(p["k"]).ffill().fillna(-1)
    for short in (0, 60, 1000):
        got = walk_rows(d, ["k"], ["t", "id"], F.floor(F.col("t") / 97).cast("long"), before={"pt": "t", "pv": "v"}, first={"ft": F.col("id") % 40 == 7}, short=short,
                        counted=d.select("k")).toPandas().set_index("id").loc[p["id"]]
        assert got["seq"].tolist() == p["seq"].tolist()
        assert got["pt"].fillna(-1).tolist() == p["pt"].tolist()
        assert got["pv"].fillna(-1).tolist() == p.groupby("k")["v"].shift().fillna(-1).tolist()
        assert got["ft"].fillna(-1).tolist() == p["ft"].tolist()


def test_short_keys_take_one_exchange(spark):
    """A key's events are numbered and looked back on in one pass, however many slots they lie in."""
    from framestory.operators import story

    rows = [(1, t, 10 * t + i, "person_walking", i * 700_000.0, i * 700_000.0 + 1, 0.5) for t in range(50) for i in range(5)]
    ev = spark.createDataFrame(rows, "video_id long, track_id long, event_id long, event_type string, start_ms double, end_ms double, confidence double")
    d = story.continuity(ev)
    assert sorted(r.seq for r in d.collect()) == sorted(50 * list(range(5)))
    final = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and final.count("Exchange hashpartitioning") == 1


def test_over_blocks_looks_across_edges(spark):
    p, d = indexed(spark)
    got = over_blocks(d, ["k"], lambda w: {"prev": F.lag("t").over(w), "next2": F.lead("t", 2).over(w), "m": F.max("t").over(w.rowsBetween(-3, 2))},
                      back=3, fwd=2, block=5).toPandas().sort_values(["k", "seq"])
    assert len(got) == len(p)
    for _, g in got.groupby("k"):
        t = g["t"].tolist()
        assert g["prev"].fillna(-1).tolist() == [-1, *t[:-1]]
        assert g["next2"].fillna(-1).tolist() == [*t[2:], *[-1] * min(2, len(t))]
        assert g["m"].tolist() == [max(t[max(0, i - 3):i + 3]) for i in range(len(t))]


def test_running_sum_and_fill(spark):
    _, d = indexed(spark)
    s = running_sum(d, ["k"], F.col("t"), "total", block=7).toPandas().sort_values(["k", "seq"])
    assert (s["total"] == s.groupby("k")["t"].cumsum()).all()
    f = fill_along(d, ["k"], ["seq"], F.floor(F.col("seq") / 6).cast("long"), F.col("v"), "filled").toPandas().sort_values(["k", "seq"])
    want = f.groupby("k")["v"].ffill()
    assert f["filled"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_grouped_median_is_exact(spark):
    p = hot(301)
    d = spark.createDataFrame(p, "k string, t long, id long, v double")
    got = grouped_median(d, ["k"], "v", 0.05, "m").toPandas().set_index("k")["m"]
    want = p.dropna().groupby("k")["v"].median()
    assert abs(got - want).max() < 1e-12


def test_nearest_prefers_the_earlier_on_ties(spark):
    r = random.Random(5)
    facts = [(k, t, t * 10) for k in ("a", "b") for t in sorted(r.sample(range(1000), 40))] + [("c", 5, 50)]
    queries = [(k, t, f"{k}{t}") for k in ("a", "b", "c") for t in r.sample(range(1000), 60)]
    got = nearest(spark.createDataFrame(queries, "k string, at long, q string"), spark.createDataFrame(facts, "k string, at long, pay long"),
                  ["k"], "at", ["pay"], 50.0, "q").toPandas()
    assert len(got) == len(queries)
    for row in got.itertuples():
        best = min((f for f in facts if f[0] == row.k), key=lambda f: (abs(f[1] - row.at), f[1]))
        assert row.pay == best[2]


def test_overlap_pairs_once_each(spark):
    r = random.Random(7)
    a = [(1, i, s, s + r.randrange(300)) for i, s in enumerate(r.sample(range(2000), 60))]
    b = [(1, i, s, s + r.randrange(300)) for i, s in enumerate(r.sample(range(2000), 60))]
    got = overlap_pairs(spark.createDataFrame(a, "v long, a long, s1 long, e1 long"), spark.createDataFrame(b, "v long, b long, s2 long, e2 long"),
                        ["v"], ("s1", "e1"), ("s2", "e2"), 100.0).select("a", "b").collect()
    want = sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, got)) == want


def test_blockwise_fold_equals_sequential(spark):
    """A counter that forgets only at resets: blocks have to be rerun until their entry state is right."""
    r = random.Random(11)
    rows = [(k, i, r.random() < 0.03) for k, n in (("hot", 300), ("b", 17), ("c", 1)) for i in range(n)]

    def step(state, pdf, last):
        n = state or 0
        out = []
        for s, reset in zip(pdf["seq"], pdf["reset"]):
            n = 0 if reset else n + 1
            if n % 5 == 0:
                out.append({"at": int(s), "n": n})
        if last:
            out.append({"at": -1, "n": n})
        return n, out

    d = spark.createDataFrame(rows, "k string, seq long, reset boolean")
    schema = __import__("pyspark.sql.types", fromlist=["T"]).StructType.fromDDL("at long, n long")
    whole = sorted(map(tuple, ordered_fold(d, ["k"], step, schema, block=1000).collect()))
    cut = sorted(map(tuple, ordered_fold(d, ["k"], step, schema, block=13).collect()))
    assert cut == whole and len(whole) > 20
