"""Near-duplicate texts by the share of their shingles: SimHash candidates and an exact prefix join for what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import removed
from framestory.llm.setjoin import Shingler, TextSets, classes, common_lists, set_links, set_prints, set_vertices, texts_of
from framestory.llm.simhash import near_links
from framestory.session import cut_lineage

#: Sets whose SimHash fingerprints of so many bits differ in so few are compared first.
PRINT_BITS, PRINT_APART = 64, 2
#: Every so many-th text is asked for frequent shingles, of which so many are put last; both touch the order only, not the result.
ORDER_SAMPLE, ORDER_SHINGLES, ORDER_TEXTS = 32, 65_536, 3


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several sampled texts, sorted, and how often."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for pdf in frames:
            for t in pdf["_text"]:
                yield pd.DataFrame({"g": shingler.grams(t).view(np.int64)})

    few = texts.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(ORDER_SAMPLE)) == 0).select("_text")
    n = few.mapInPandas(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_TEXTS)
    rows = n.orderBy(F.col("n").desc(), "g").limit(ORDER_SHINGLES).toArrow()  # plain arrays; as Row objects they took the driver ten times the memory
    often, counts = (rows[c].to_numpy().astype(np.int64) for c in ("g", "n"))
    order = np.argsort(often)
    return often[order], counts[order]


def _ordered(grams: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles in the global order: frequent ones last."""
    if not len(often) or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
    return grams[np.lexsort((grams, np.where(often[at] == grams, counts[at], 0)))]


def place_filter(percent: int):
    """Whether two members of a list can reach the share if the list's shingle is the first they have in common."""
    def possible(a: str, b: str) -> Column:
        return F.expr(f"least({a}n - {a}at, {b}n - {b}at) * {100 + percent} >= {percent} * ({a}n + {b}n)")

    return possible


def fingerprint_pairs(vertices: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets with equal or nearly equal SimHash fingerprints: enough to connect all such fingerprints, and each set with one of its own."""
    held = cut_lineage(vertices.groupBy("fingerprint").agg(F.min("v").alias("_v")))
    links = near_links(held, PRINT_BITS, PRINT_APART)
    for side in ("a", "b"):
        links = links.join(held.select(F.col("fingerprint").alias("_f"), F.col("_v").alias(f"_{side}")), F.col(side) == F.col("_f")).drop("_f")
    equal = vertices.select("v", "fingerprint").join(held, "fingerprint").where("v <> _v").select(F.col("_v").alias("a"), F.col("v").alias("b"))
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(equal)


def near_texts(records: DataFrame, key: str = "failure_id", text: str = "description", words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of whole texts (failure descriptions, briefs): ``_id``, ``_t1``, ``_t2`` (hashes of the text) and ``component``, a row per record.

    Texts are lower-cased (A-Z), cut into words at white space and into sets of
    shingles of ``words`` words; fewer words are one shingle.  Records link where
    the sets share ``percent`` of their union or more (equal sets, empty ones
    too, always do); a class is what links connect and ``component`` its
    smallest key.  Null keys are nobody's smallest key, null texts are empty,
    repeated rows are kept; other columns, whatever their names, don't pass; an
    empty table gives an empty result.

    Sets whose SimHash fingerprints nearly agree are the first candidates
    (``fingerprint_pairs``).  Fingerprints can't see all pairs of the share, so
    an index that does gives the others: two sets that share so much have one of their first ``n - n * percent / 100``
    shingles (and one more) in common under any order of all shingles, so only
    those are indexed and no pair is missed.  Frequent shingles come last.  All
    candidates that sizes, sketches, bucket counts or the places of the common
    shingle don't rule out are verified by their whole sets.
    """
    texts = texts_of(records, key, text)
    often, counts = _frequent(texts, words)

    def prefix(grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        return _ordered(grams.view(np.int64), often, counts)[:n - (-(-n * percent // 100)) + 1]

    prints, folder = set_prints(texts, words, prefix, fingerprint=True)
    lists = common_lists(prints)
    prints = cut_lineage(prints.drop("keys"))
    removed(prints, folder)
    vertices = set_vertices(prints)
    links = set_links(lists, TextSets(texts, vertices, words), percent, place_filter(percent), first=fingerprint_pairs(vertices), by_chance=True)
    return classes(prints, vertices, links).select("_id", "_t1", "_t2", "component")
