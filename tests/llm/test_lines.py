"""Line classes of short lines and of rows that share a key."""

import pytest
from pyspark.sql import functions as F
from test_pairs import roots, distance_at_most_one

from framestory.llm import lines

SHORT = [(1, "All rights reserved.\nok\n-\n\nfirst"), (2, "All rights reserved.\n\n-\nfirst\nab"), (3, "All rights reserved!\nax\nb\nend of it\nabcd"),
         (4, "-\nabd\nfar away\nok"), (5, "first\n\n"), (None, "x\nfar  away")]


def classes(rows):
    """As (key, text, line) places: one class for equal lines, and for lines of two characters or more one edit apart."""
    order = lambda p: (p[0] is not None, p[0] or 0, p[1], p[2])
    places = sorted({(k, t or "", n) for k, t in rows for n in range(len((t or "").split("\n")))}, key=order)
    line = [t.split("\n")[n] for _, t, n in places]
    near = lambda a, b: bool(a) and (a == b or min(len(a), len(b)) >= 2 and distance_at_most_one(a, b))
    r = roots(len(line), [(i, j) for i in range(len(line)) for j in range(i) if near(line[i], line[j])])
    return places, line, r


@pytest.mark.parametrize("short", [64, 2])
def test_short_lines_are_compared(spark, monkeypatch, short):
    monkeypatch.setattr(lines, "SHORT_LIST", short)
    places, line, r = classes(SHORT)
    got = lines.line_classes(spark.createDataFrame(SHORT, "job_id long, log string"), min_chars=2).collect()
    want = [(k, n, len(line[i]), places[r[i]][0], places[r[i]][2], r[i] == i) for i, (k, _, n) in enumerate(places)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(not w[-1] for w in want) >= 9 and all(w[-1] for w in want if w[2] == 0)


SHARED = [(None, "a line of the first text alone\nsame line in every text\nit ends here, says the first"),
          (None, "the second text begins with this\nsame line in every text\nand has another last line"),
          (4, "quite another beginning, the third\nsame line in every texT\nand its own end, number three"),
          (4, "four comes under the id of three\nsame line in every text\nit ends here, says the firsT"), (4, "four comes under the id of three\nsame line in every text\nit ends here, says the firsT")]


def test_rows_that_share_a_key_keep_their_own_lines(spark, monkeypatch):
    d = spark.createDataFrame([(*r, 1) for r in SHARED], "job_id long, log string, _t long")
    order = lambda r: (r[0] is not None, r[0] or 0, spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])
    left, seen = {}, []
    for k, t in sorted(set(SHARED), key=order):
        own = t.split("\n")
        left[k, t] = "\n".join(x for x in own if not any(distance_at_most_one(x, y) for y in seen))
        seen += own
    for short in (64, 1):
        monkeypatch.setattr(lines, "SHORT_LIST", short)
        got = sorted(((r["job_id"], r["log"]) for r in lines.dedup_lines(d).collect()), key=str)
        assert got == sorted(((k, left[k, t]) for k, t in SHARED), key=str)
    kept = lines.line_classes(d.where("job_id IS NULL"))
    assert kept.columns == ["job_id", "line_no", "n_chars", "class_key", "class_line", "kept"] and kept.where("kept").count() == 5


def test_counts_and_short_words_stay(spark):
    """Lines of fewer than ten characters are other lines unless they are equal; longer ones link at one edit."""
    text = "Total: 10\nTotal: 12\nTotal: 95\nin\non\nno\nok\n- a\n- b\nok\nTotal items: 10\nTotal items: 12"
    d = spark.createDataFrame([(1, text)], "job_id long, log string")
    assert lines.dedup_lines(d).first()["log"] == "Total: 10\nTotal: 12\nTotal: 95\nin\non\nno\nok\n- a\n- b\nTotal items: 10"
