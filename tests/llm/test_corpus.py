"""Mixing, toxicity, language, packing and the pipeline against plain versions and held-out rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framestory.llm import language, mixing, packing, queries, tokens, toxicity
from framestory.sources.fixtures import Inputs

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "é", "b", None, "tiny"][min(int(rng.integers(0, 9)), 3)], int(rng.integers(0, 900)), "x", 1) for i in range(400)]
    rows += [(900, "tiny", 3, "x", 1), (901, "none", 0, "x", 1), (901, "none", None, "x", 1), (None, "a", 50, "x", 1), (5, *rows[5][1:]), (902, "big", 90000, "x", 1)]
    d = spark.createDataFrame(rows, "video_id long, source_domain string, frame_count long, size string, target long")
    got = mixing.mix_domains(d).collect()
    sizes = {}
    for _, s, n, *_ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = plain_targets(sizes)
    assert sorted(((r["video_id"], r["source_domain"], r["size"]) for r in got), key=str) == sorted(((k, s, n or 0) for k, s, n, *_ in rows), key=str)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source_domain"]]) and r["domain_size"] == sizes[r["source_domain"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(r["passes"])
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source_domain"] == s) - want[s]) < 1 + 1e-6
    assert sorted(map(str, mixing.mix_domains(d.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix_domains(d.where("false")).collect() == []


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 60000, 90000.0), ("b", 30000, 30000.0), (None, 40000, 80000.0)], "domain string, size long, target double")
    s = mixing.domain_schedule(t, 64).orderBy("slot").collect()
    assert sum(r["frames"] for r in s) == 200000 and len({(r["domain"], r["pass"], r["block"]) for r in s}) == len(s)
    for part in (0.1, 0.37, 0.8):  # every stretch of the mix has about the shares of the whole
        head = s[:int(part * len(s))]
        for d, share in (("a", 0.45), ("b", 0.15), (None, 0.4)):
            assert abs(sum(r["domain"] == d for r in head) / len(head) - share) < 0.01


def test_toxicity_on_held_out_rows(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    docs, labels = t.table("documents"), queries.toxicity_labels(t.table("labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4))
    got = toxicity.toxic_notes(docs, labels.where(part != 0), queries.CATEGORIES, "toxic", "doc_id", "text").join(labels.where(part == 0), "doc_id").collect()
    tp = sum(r["rejected"] and r["toxic"] for r in got)
    assert len(got) > 50 and tp >= 0.5 * sum(r["toxic"] for r in got) and tp >= 0.8 * sum(r["rejected"] for r in got)


def test_toxicity_edges(spark):
    rows = [(i, "you idiot scum go away" if i % 4 == 0 else "a calm and quiet note about frames", "x", "y") for i in range(80)]
    rows += [(200, None, "x", "y"), (201, "", "x", "y"), (None, "idiot scum", "x", "y"), (202, "calm note " * 20000, "x", "y"), (3, rows[3][1], "x", "y")]
    d = spark.createDataFrame(rows, "failure_id long, notes string, p_toxic string, _w string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(80)] + [(1, None, 1), (200, 0, 0)], "failure_id long, mild int, toxic int")
    got = toxicity.toxic_notes(d, labels, ["mild", "toxic"], "toxic").collect()
    assert len(got) == len(rows) and all(0 <= r["p_mild"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)
    assert {r["failure_id"] for r in got if r["rejected"]} == {None, *range(0, 80, 4)}
    assert toxicity.toxic_notes(d.where("false"), labels, ["mild", "toxic"], "toxic").collect() == []
    assert not any(r["rejected"] for r in toxicity.toxic_notes(d, labels.where("false"), ["mild", "toxic"], "toxic").collect())


def test_chain_feeds_earlier_probabilities(spark):
    d = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(60)], "failure_id long, notes string")
    chain = toxicity.fit_chain(d, d.selectExpr("failure_id", "failure_id % 2 AS a", "failure_id % 2 AS b", "failure_id % 2 AS c"), ["a", "b", "c"])
    assert [len(e) for e in chain.earlier] == [0, 1, 2] and chain.earlier[1][0] > 0 and all(len(w) == len(chain.words) for w in chain.weights)


def test_language_on_held_out_rows(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    got = queries.op9_language(t).join(t.table("documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(i, "the gate of the station and the north" if i % 2 else "der Bahnhof und die Tür im Norden", ["de", "en"][i % 2], 1) for i in range(40)]
    odd = [(50, None, "en", 1), (51, "", "en", 1), (52, "123 !!! 456", "de", 1), (53, "the gate " * 30000, None, 1), (None, "die Tür", None, 1), (3, rows[3][1], "en", 1)]
    d = spark.createDataFrame(rows + odd, "failure_id long, notes string, lang string, score int")
    model = language.fit_language(d)
    got = language.note_languages(d, model).collect()
    named = {r["failure_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert [named[i] for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert (named[53][0], named[None][0], named[0][0], named[1][0]) == ("en", "de", "de", "en")
    assert language.note_languages(d.where("false"), model).collect() == []
    assert {r["lang_pred"] for r in language.note_languages(d, language.fit_language(d.where("false"))).collect()} == {"und"}


def test_token_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(9000, None), (9001, ""), (9002, "a  b\t\tc d e\x85f it's 3.14 <|endoftext|> é x ́y\r\nz"), (9001, ""), (None, "x y")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "failure_id long, notes string, piece int, length int")
    got = sorted(map(tuple, tokens.token_pieces(d, TOKENIZER, 100).collect()), key=str)
    t, want = Tokenizer.from_file(TOKENIZER), []
    for k, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(k, i // 100, i, len(ids[i:i + 100]), zlib.crc32(ids[i:i + 100].tobytes())) for i in range(0, len(ids), 100)]
    assert got == sorted(want, key=str)
    assert tokens.token_pieces(d.where("false"), TOKENIZER, 100).collect() == []


@pytest.mark.parametrize("task_rows", [60_000, 40])
def test_packing_is_gapless_and_tight(spark, monkeypatch, task_rows):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 1300, 700)] + [2048] * 30 + [1] * 200 + [0, None, -3, 5000]
    d = spark.createDataFrame([(i, s, 7, 8) for i, s in enumerate(sizes)] + [(3, sizes[3], 7, 8)], "clip_id long, frames int, reel_id int, bin int")
    got = packing.pack_clips(d, task_rows=task_rows).collect()
    assert len(got) == len(sizes) + 1
    reels = {}
    for r in got:
        reels.setdefault(r["reel_id"], []).append((r["offset"], max(r["frames"] or 0, 0)))
    total = 0
    for parts in reels.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 or len(parts) == 1
        total += min(at, 2048)
    assert len(reels) <= 1.02 * total / 2048 + 3
    assert packing.pack_clips(d.where("false")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    given, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        given = out.checkpoint()
        kept[name] = given.collect()
    toxic = {r["doc_id"] for r in kept["toxicity"]}
    named = [k for k, v in labels.items() if v == 0]
    assert sum(k in toxic for k in named) >= 0.97 * len(named)
    lines_after = [x for r in kept["line_dedup"] for x in (r["text"] or "").split("\n") if len(x) >= 24]
    assert len(lines_after) == len(set(lines_after)) and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    near, before = [r["doc_id"] for r in kept["simhash_near_dedup"]], {r["doc_id"] for r in kept["line_dedup"]}
    assert len(near) == len(set(near)) and set(near) <= before
    mixed = {}
    for r in kept["mix_sources"]:
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + 1
    assert set(mixed) <= set(near) and max(mixed.values()) <= 2
    packed = kept["best_fit_packing"]
    starts = {}
    for r in packed:
        if r["piece"] == 0:
            starts[r["doc_id"]] = starts.get(r["doc_id"], 0) + 1
    assert starts == mixed


def test_pipeline_run_and_odd_tables(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "some text here, long enough to count as a line", None, "a", 40), (4, "some text here, long enough to count as a line", "en", "a", 40),
            (None, "a row without any id, and its text is long", "en", "b", 3), (5, "word " * 30000, "en", "a", 9), (3, "some text here, long enough to count as a line", None, "a", 40)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        spark.createDataFrame([(*r, 1, "y") for r in data], kind + ", _id long, fingerprint string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()}
    assert {5, 3} <= got and 4 not in got


def test_mix_stage_counts_rows_without_ids_one_by_one(spark):
    """A source of a thousand documents without ids meets its target as one with ids does; equal rows share what they get."""
    import corpus_pipeline

    rows = [(None, " ".join(f"w{i}_{j}" for j in range(10 + i % 21)), "a", 1) for i in range(1000)] + [(i, f"x{i} " * 20, "b", 1) for i in range(300)] + [(None, "twice the same text", "b", 2)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.mix_stage(spark, d, "")
    assert out.columns == d.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    targets = {r["source"]: r["target"] for r in mixing.mix_domains(
        d.withColumns({"size": F.size(F.split(F.trim("text"), " ")).cast("long"), "k": F.monotonically_increasing_id()}), "k", "source", "size").select(
        F.col("source_domain").alias("source"), "target").distinct().collect()}
    for s, target in targets.items():
        assert abs(words[s] - target) < 0.1 * target, (words, targets)


def test_word_ids_of_odd_texts():
    """Every text has the ids that the tokenizer gives it as a whole."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole, rng = tokens.WordEncoder(path), Tokenizer.from_file(path), random.Random(1)
    odd = "abzÀÉéñß'sT'RE0 ½²\n\t\xa0\x85.,;!?-<>|İıŉǅdžΣς ſ㎏ﬁ́̈‍中ａ１𝔸😀\x1c\x00ÿĀ'"
    for i in range(1500):
        t = "".join(rng.choice(odd) if rng.random() < 0.8 else chr(rng.randrange(1, 0x2FFF)) for _ in range(rng.randrange(1, 30)))
        t += "<|endoftext|>" if i % 50 == 0 else "<|EndOfText|> it's" if i % 50 == 1 else ""
        assert encoder.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_tokenizers_prepared_otherwise_encode_whole_texts(tmp_path):
    import json

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    made = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    made["normalizer"] = {"type": "NFC"}
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(made), encoding="utf-8")
    t = "Some Words, with Capitals\nand A line"
    encoder = tokens.WordEncoder(str(other))
    assert not encoder.by_word and encoder.ids(t) == np.array(Tokenizer.from_file(str(other)).encode(t, add_special_tokens=False).ids, "<u4").tobytes()
