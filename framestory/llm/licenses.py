"""License scan: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import strings, text_rows

#: Phrases whose words must stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Statements matched as word sets.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "public-domain": "this work has been dedicated to the public domain",
}
CONTAINMENT = 0.8
STRIDE = 32
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, cut at every other ASCII character that is no digit."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, NON_WORD, -1), "")


def token_order(videos: DataFrame, vocabulary: list[str], text: str = "license") -> list[str]:
    """The template vocabulary from rare to frequent, by the number of texts that hold a word.

    All texts are counted; the driver gets one count per word of the templates.
    """
    d = text_rows(videos, text, text)
    counts = dict(d.select(F.explode(F.array_intersect(license_words(F.col("_text")), strings(vocabulary))).alias("w"))
                  .groupBy("w").count().collect())
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_matches(videos: DataFrame, key: str = "video_id", text: str = "license", phrases=PHRASES, templates=TEMPLATES,
                    containment: float = CONTAINMENT) -> DataFrame:
    """License statements in the license field of video records, one row per record.

    The join: a text is cut into overlapping blocks of 64 words, one every 32, so
    any statement of up to 32 words lies in a block.  Block and template are word
    sets in one global order, rare words first.  A pair becomes a candidate if a
    word of the template's prefix lies in the block's prefix; the length filter
    and the positional filter follow; survivors are verified exactly: templates
    by the share of their words in the block, phrases by their words in a row.

    Returns ``key``, ``n_words``, ``n_phrases`` (places), ``first_word``,
    ``last_word`` (start of the first and last place), ``phrase_labels``,
    ``labels`` (sorted arrays) and ``score``, the largest containment among the
    labels, else 0.  Null or empty text gives no words and no labels; null keys
    and repeated rows are kept, a row each; other columns don't pass.
    """
    if max(len(p.split()) for p in [*phrases.values(), *templates.values()]) > STRIDE:
        raise ValueError(f"a template may have {STRIDE} words at most")
    spark = videos.sparkSession
    stated = [(k, p.split(), True) for k, p in phrases.items()] + [(k, t.split(), False) for k, t in templates.items()]
    order = token_order(videos, sorted({w for _, ws, _ in stated for w in ws}), text)
    rank = {w: i for i, w in enumerate(order)}
    prefixes, rare = [], set()
    for label, ws, phrase in stated:
        tokens = sorted(set(ws), key=rank.get)
        least = len(tokens) if phrase else math.ceil(containment * len(tokens) - 1e-9)
        for at, w in enumerate(tokens[:len(tokens) - least + 1]):
            prefixes.append((w, label, phrase, ws, tokens, len(tokens), least, at + 1))
            rare.add(w)
    t = spark.createDataFrame(prefixes, "w string, label string, phrase boolean, stated array<string>, tokens array<string>, n int, least int, t_at int")

    d = text_rows(videos, key, text).select(F.monotonically_increasing_id().alias("_row"), "_id", license_words(F.col("_text")).alias("_words"))
    rare_words = strings(sorted(rare))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)), F.lit(STRIDE)),
                      lambda p: F.struct(p.alias("from"), F.slice("_words", p + 1, F.lit(2 * STRIDE)).alias("words")))
    held = F.when(F.arrays_overlap("_words", rare_words), F.filter(cut, lambda b: F.arrays_overlap(b["words"], rare_words)))
    blocks = d.select("_row", "_id", F.size("_words").alias("_n"), F.explode_outer(held).alias("b"))
    s = blocks.select("_row", "_id", "_n", F.col("b.from").alias("_from"), F.col("b.words").alias("_w"),
                      F.array_intersect(strings(order), F.col("b.words")).alias("_set"))
    s = s.select("*", F.explode_outer(F.array_intersect("_set", rare_words)).alias("w")).withColumn("_at", F.array_position("_set", F.col("w")))
    near = ((F.size("_set") >= F.col("least")) & (F.col("_at") <= F.size("_set") - F.col("least") + 1)
            & (1 + F.least(F.size("_set") - F.col("_at"), F.col("n") - F.col("t_at")) >= F.col("least")))
    c = s.join(t, "w", "left").withColumn("_both", F.when(near, F.size(F.array_intersect("tokens", "_w"))))
    places = F.filter(F.sequence(F.lit(1), F.least(F.lit(STRIDE), F.size("_w"))),
                      lambda i: F.slice(F.col("_w"), i, F.size("stated")) == F.col("stated"))
    c = c.withColumn("_in", F.col("_both") >= F.col("least")).withColumn("_places", F.when(F.col("_in") & F.col("phrase"), places))
    c = c.withColumn("_hit", F.col("_in") & (~F.col("phrase") | (F.size("_places") > 0)))
    hit = lambda e: F.when(F.col("_hit"), e)
    labels = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("label"))))
    return c.groupBy("_row", "_id").agg(
        F.max("_n").cast("long").alias("n_words"),
        F.coalesce(F.sum(hit(F.when(F.col("phrase"), F.size("_places")))), F.lit(0)).cast("long").alias("n_phrases"),
        F.min(hit(F.col("_from") + F.array_min("_places") - 1)).cast("long").alias("first_word"),
        F.max(hit(F.col("_from") + F.array_max("_places") - 1)).cast("long").alias("last_word"),
        labels(F.col("_hit") & F.col("phrase")).alias("phrase_labels"), labels(F.col("_hit")).alias("labels"),
        F.coalesce(F.max(hit(F.col("_both") / F.col("n"))), F.lit(0.0)).alias("score")).drop("_row").withColumnRenamed("_id", key)
