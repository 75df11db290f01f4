"""N-gram Jaccard join of briefs: universe partitions by size band and the pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import maybe_in, removed
from framestory.llm.setjoin import SKETCH, TextSets, classes, common_lists, may_be_near, mixed, set_links, set_prints, set_vertices, texts_of
from framestory.session import cut_lineage

WHOLE, SHORTENED = 1, 2
LEAST_ELEMENTS = 3


class Bands:
    """Size bands and segments for a threshold in percent.

    A band reaches from a size to the largest partner of that size, so partners
    are in the same band or the next.  Two sets of which the smaller is in a band
    differ in at most ``apart`` elements; the universe is cut into one segment
    more, so that one segment at least holds the same elements of both.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1, 100 // percent + 1]

    def _reach(self, n: int) -> None:
        while self.starts[-1] <= n:
            self.starts.append(100 * self.starts[-1] // self.percent + 1)

    def of(self, n: int) -> int:
        self._reach(n)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def segments(self, band: int) -> int:
        last = self.starts[band + 1] - 1
        apart = (last + 100 * last // self.percent) * (100 - self.percent) // (100 + self.percent)
        return apart + 1

    def probed(self, n: int) -> list[int]:
        """The set's own band, and the one below if it has possible partners."""
        b = self.of(n)
        return [b, b - 1] if b and -(-self.percent * n // 100) < self.starts[b] else [b]


def cut(grams: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the mixed elements of each segment, and where the segments start and end in the sorted set.

    The segment of an element is given by its upper bits, so segments are runs.
    A sum stands for a segment's elements whatever their order, and leaving one
    out is a subtraction.
    """
    at = (grams >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(segments + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams), dtype=np.uint64)])
    return sums[edges[1:]] - sums[edges[:-1]], edges


def signature(sums: np.ndarray, segment: np.ndarray, band: int, kind: int) -> np.ndarray:
    salt = mixed(segment.astype(np.uint64) + np.uint64(band << 34) + np.uint64(kind << 60))
    return mixed(sums ^ salt).view(np.int64)


def segment_keys(grams: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of all segments in the set's own band, then of those in the band below if that has partners."""
    if not len(grams):
        return np.zeros(0, np.int64)
    return np.concatenate([signature(cut(grams, m)[0], np.arange(m), b, WHOLE) for b in bands.probed(len(grams)) for m in [bands.segments(b)]])


def allocation(sizes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments to skip, to keep whole, and to widen to one deletion.

    ``costs`` are the lengths of crowded lists, 0 for others.  A skipped segment
    gives up one permitted difference, so another one takes it over: a segment
    without a crowded list, whose one-deletion neighbourhood costs an entry per
    element; the smallest come first, but those of one or two elements last, as
    what is left of these is common.  Crowded lists go by falling length as long as
    that is cheaper; the rest is kept.
    """
    crowded = np.flatnonzero(costs)
    crowded = crowded[np.argsort(-costs[crowded], kind="stable")]
    free = np.flatnonzero(costs == 0)
    free = free[np.lexsort((sizes[free], sizes[free] < LEAST_ELEMENTS))]
    k = min(len(crowded), len(free))
    worth = costs[crowded[:k]] > 1 + sizes[free[:k]]
    k = k if worth.all() else int(np.argmin(worth))
    return crowded[:k], crowded[k:], free[:k]


def reallocated_pairs(lists: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of sets that meet on crowded lists, found without listing all pairs of those.

    If all segments that two near sets have in common are crowded, both are in
    these lists.  So only their members index whole segments and one-deletion
    neighbourhoods, and each probes with its own allocation.  Of two sets that
    aren't connected one is outside the largest connected part of every list they
    share, so who is in that part of all its lists needs not probe.
    """
    parts = lists.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c")).groupBy(F.col("key").alias("_k")).agg(F.max_by("root", F.struct("_c", "root")).alias("_big"))
    d = lists.join(parts, F.col("key") == F.col("_k"))
    crowded = d.groupBy("v").agg(F.collect_list(F.struct("at", "m")).alias("crowd"), F.max(F.col("root") != F.col("_big")).alias("asks"))
    d = crowded.join(sets.select(F.col("v").alias("_v"), "s"), F.col("v") == F.col("_v")).select("v", "asks", "crowd.at", "crowd.m", "s")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for v, asks, at, m, s in zip(pdf["v"].tolist(), pdf["asks"].tolist(), pdf["at"], pdf["m"], pdf["s"]):
                grams, at, m = np.frombuffer(s, np.uint64), np.asarray(at), np.asarray(m)
                before = 0
                for b in bands.probed(len(grams)):
                    count = bands.segments(b)
                    mine = (at >= before) & (at < before + count)
                    costs = np.zeros(count, np.int64)
                    costs[at[mine] - before] = m[mine]
                    before += count
                    if not mine.any():
                        continue
                    sums, edges = cut(grams, count)
                    _, kept, widened = allocation(np.diff(edges), costs)
                    every = np.arange(count)
                    segment = np.repeat(every, np.diff(edges))
                    less = sums[segment] - mixed(grams)
                    wide = np.isin(segment, widened)
                    own = np.concatenate([signature(sums, every, b, WHOLE), signature(less, segment, b, SHORTENED)])
                    asked = np.concatenate([signature(sums[widened], widened, b, SHORTENED), signature(less[wide], segment[wide], b, WHOLE), signature(sums[kept], kept, b, WHOLE)])
                    asked = asked if asks else asked[:0]
                    yield pd.DataFrame({"sig": np.concatenate([own, asked]), "v": v, "probe": np.repeat([False, True], [len(own), len(asked)])})

    rows = cut_lineage(d.mapInPandas(run, "sig long, v long, probe boolean"))
    probes = rows.where("probe").select("sig", "v")
    index = maybe_in(rows.where("NOT probe").select("sig", "v"), F.col("sig"), probes, F.col("sig"))
    known = ["n", *SKETCH, "root"]
    members = cut_lineage(lists.groupBy("v").agg(*[F.first(c).alias(c) for c in known]))

    def side(d: DataFrame, p: str) -> DataFrame:
        m = members.select(F.col("v").alias("_v"), *known)
        return d.join(m, F.col("v") == F.col("_v")).select(F.col("sig").alias(f"{p}sig"), F.col("v").alias(f"{p}v"), *[F.col(c).alias(p + c) for c in known])

    met = side(probes, "a_").join(side(index, "b_"), F.expr("a_sig = b_sig AND a_root <> b_root") & may_be_near(bands.percent, "a_", "b_"))
    return met.select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b")).distinct()


def similar_briefs(briefs: DataFrame, key: str = "video_id", text: str = "brief", words: int = 3, percent: int = 90) -> DataFrame:
    """Classes of briefs whose word n-gram sets share ``percent`` of their union or more; one row per brief.

    Whole briefs are lower-cased (A-Z), cut into words at white space and into
    distinct shingles of ``words`` words; fewer words are one shingle, none give
    the empty set.  Returns ``key``, ``n_shingles`` and ``component``, the smallest
    key that links reach, its own included.

    Sets are hashed into the segments of their size band and of the one below;
    near sets have a segment in common whole.  Lists of such segments give the
    pairs, which are verified by the whole sets.  On crowded lists (a boilerplate
    passage, an empty segment) pairs are found by a new allocation: these
    segments are skipped and others widened to one-deletion neighbourhoods.  No
    pair is missed.  Equal sets are one vertex, so copies never become pairs.

    Null and empty briefs have no shingles and link with nothing, so their
    component is their own key.  Null keys are kept and are nobody's smallest
    key (a class of null keys alone has a null component).  Repeated rows are
    kept; other columns don't pass; an empty table gives an empty result.
    """
    bands = Bands(percent)
    texts = texts_of(briefs, key, text)
    prints, folder = set_prints(texts, words, lambda g: segment_keys(g, bands))
    lists = common_lists(prints.where("n > 0"))
    prints = cut_lineage(prints.drop("keys"))
    removed(prints, folder)
    vertices = set_vertices(prints.where("n > 0"))
    sets = TextSets(texts, vertices, words)
    links = set_links(lists, sets, percent, crowded=lambda rest: reallocated_pairs(rest, sets.held(rest), bands))
    found = classes(prints.where("n > 0"), vertices, links).select("_id", "n", "component")
    bare = prints.where("n = 0").select("_id", "n", F.col("_id").alias("component"))
    return found.unionByName(bare).select(F.col("_id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component")
