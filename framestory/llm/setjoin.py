"""Joins of texts on the share of their shingle sets: sets, lists of sets with a common key, exact verification, classes.

A join says which keys a set has, so that two sets near enough have one in
common.  Here the keys become lists, the lists pairs, and the pairs links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestory.llm.common import maybe_in, text_rows, written
from framestory.llm.graph import components
from framestory.llm.simhash import SEED, UPPER, set_fingerprint
from framestory.session import cut_lineage

#: Lists up to this length give all their pairs; the members of longer ones first meet so many further ones of them.
SHORT_LIST, CENTRES = 16, 3
#: Pairs of one set that a task compares in a row.
PAIR_RUN = 1024
#: Words and set numbers that a task remembers.
KNOWN_WORDS, SEEN_SETS = 300_000, 100_000
#: Sets go out in batches of about this size.
SHIPPED_BYTES = 1 << 25
#: Columns of a set's sketch, 64 bits each.
SKETCH = ("k0", "k1", "k2", "k3")
#: Sketches of unrelated sets differ in about 128 bits; pairs that may differ in so many or more are told apart by counts in so many buckets.
SKETCH_TELLS, BUCKETS = 96, 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a whole text's shingles, A-Z in lower case; fewer words are one shingle, none give none."""

    def __init__(self, words: int):
        self.words, self.known = words, _Words()

    def grams(self, text: str) -> np.ndarray:
        ws = text.encode("utf-8", "replace").translate(UPPER).split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.words, len(ws))
        n = len(ws) - k + 1
        acc = h[:n] + np.uint64(k)
        for j in range(1, k):
            acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
        return np.unique(mixed(acc))


def set_number(grams: np.ndarray) -> int:
    """Equal sets have equal numbers; the empty set is one of them."""
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63)


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements by their last byte; two sets' sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)


def bucket_counts(grams: np.ndarray) -> bytes:
    """Numbers of elements by their last bits, 255 at most; those of two sets differ by no more in sum than the sets in elements."""
    return np.minimum(np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def may_be_near(percent: int, a: str, b: str) -> Column:
    """Whether sizes and sketches of two sets (columns with these prefixes) allow the share."""
    apart = " + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in SKETCH)
    return F.expr(f"({apart}) * {100 + percent} <= ({a}n + {b}n) * {100 - percent} AND 100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)")


def texts_of(records: DataFrame, key: str, text: str) -> DataFrame:
    """``_id``, ``_text`` and the text's hashes, which tell rows of one id apart."""
    return text_rows(records, key, text).withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64("_text", F.lit(1))})


def set_prints(texts: DataFrame, words: int, keys_of: Callable[[np.ndarray], np.ndarray], fingerprint: bool = False) -> tuple[DataFrame, str]:
    """``_id``, ``_t1``, ``_t2``, ``v`` (set number), ``n`` (size), sketch and ``keys`` (the set's keys, packed) of each text, in one pass; and their folder.

    A task that has given the keys of a set leaves them out of its copies.  The
    set's SimHash ``fingerprint`` comes with it where asked for.
    """
    kind = texts.schema["_id"].dataType.simpleString()
    names = ["v", "n", *SKETCH, "keys", *(["fingerprint"] if fingerprint else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(words), set()
        for pdf in frames:
            rows = []
            for t in pdf["_text"]:
                g = shingler.grams(t)
                v = set_number(g)
                print_ = (set_fingerprint(g),) if fingerprint else ()
                rows.append((v, len(g), *sketch_of(g).tolist(), b"" if v in seen else keys_of(g).astype(np.int64).tobytes(), *print_))
                if len(seen) < SEEN_SETS:
                    seen.add(v)
            out = pd.DataFrame(rows, columns=names)
            yield pd.concat([pdf[["_id", "_t1", "_t2"]].reset_index(drop=True), out], axis=1)

    sketch = ", ".join(f"{k} long" for k in SKETCH)
    more = ", fingerprint binary" if fingerprint else ""
    return written(texts.mapInPandas(run, f"_id {kind}, _t1 long, _t2 long, v long, n int, {sketch}, keys binary{more}"), "sets")


def set_vertices(prints: DataFrame) -> DataFrame:
    """One row per distinct set: its smallest id, the place of one of its texts, size, sketch and fingerprint if there is one."""
    own = [c for c in ("n", *SKETCH, "fingerprint") if c in prints.columns]
    return cut_lineage(prints.groupBy("v").agg(F.min("_id").alias("_least"), F.min(F.struct("_id", "_t1", "_t2")).alias("_place"), *[F.min(c).alias(c) for c in own]))


def common_lists(prints: DataFrame) -> DataFrame:
    """``(key, v, n, at, m, met)`` of every key that ``m`` > 1 sets have; ``at`` is the key's place among the set's keys.

    ``met`` holds members that all others shall meet: one, and ``CENTRES`` more on long lists.
    """
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            held = [np.frombuffer(k, np.int64) for k in pdf["keys"]]
            sizes = [len(k) for k in held]
            key = np.concatenate(held) if held else np.zeros(0, np.int64)
            v, n = np.repeat(pdf["v"].to_numpy(), sizes), np.repeat(pdf["n"].to_numpy(np.int64), sizes)
            place = (n << 32) | (np.concatenate([np.arange(k) for k in sizes]) if held else key)
            for i in range(0, len(key), 1 << 17):
                part = slice(i, i + (1 << 17))
                yield pd.DataFrame({"key": key[part], "v": v[part], "place": place[part]})

    w = Window.partitionBy("key")
    d = prints.select("v", "n", "keys").mapInPandas(unpack, "key long, v long, place long")
    # copies of a set come from several tasks; they share the exchange by key and go within it
    d = d.withColumns({"_lo": F.min("v").over(w), "_hi": F.max("v").over(w)}).where("_lo < _hi").dropDuplicates(["key", "v"]).select("key", "v", "place")
    d = d.withColumn("m", F.count(F.lit(1)).over(w))
    some = [F.min(F.struct(F.col("v").alias("h"), "v", "place")).over(w), *[F.min(F.struct(F.xxhash64("v", F.lit(i)).alias("h"), "v", "place")).over(w) for i in range(CENTRES)]]
    d = d.withColumn("met", F.array(*some))
    size, at = (lambda p: F.shiftright(p, 32).cast("int")), (lambda p: F.col(p).bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    met = F.when(F.col("m") > SHORT_LIST, F.col("met")).otherwise(F.slice("met", 1, 1))
    return cut_lineage(d.select("key", "v", size("place").alias("n"), at("place").alias("at"), "m", met.alias("met")))


class TextSets:
    """The sets of vertices, made again from their texts where they are asked for."""

    def __init__(self, texts: DataFrame, vertices: DataFrame, words: int):
        self.texts, self.vertices, self.words = texts, vertices, words

    def shipped(self, asked: DataFrame, form: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
        """``asked`` (column ``v`` and whole-numbered others) with ``s``, the whole set of ``v`` or what ``form`` makes of it; rows may repeat."""
        asked = asked.select("v", *[c for c in asked.columns if c != "v"])
        words, own = self.words, asked.columns
        places = cut_lineage(asked.join(self.vertices.select(F.col("v").alias("_v"), "_place"), F.col("v") == F.col("_v")).select(
            *own, F.col("_place._id").alias("_pi"), F.col("_place._t1").alias("_p1"), F.col("_place._t2").alias("_p2")))

        def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingler, last, held, done = Shingler(words), None, b"", set()
            for pdf in frames:
                rows, size = [], 0
                for row, t in zip(pdf[own].itertuples(index=False, name=None), pdf["_text"]):
                    if row[0] != last:
                        last, held, done = row[0], form(shingler.grams(t)), set()
                    if row not in done:  # equal texts of one id stand together and are one
                        done.add(row)
                        rows.append((*row, held))
                        size += len(held)
                    if size > SHIPPED_BYTES:
                        yield pd.DataFrame(rows, columns=[*own, "s"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=[*own, "s"])

        d = maybe_in(self.texts, F.col("_t1"), places, F.col("_p1"))
        d = d.join(places, (F.col("_t1") == F.col("_p1")) & (F.col("_t2") == F.col("_p2")) & F.col("_id").eqNullSafe(F.col("_pi")))
        fields = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in own)
        return d.select(*own, "_text").mapInPandas(sets, f"{fields}, s binary")

    def held(self, wanted: DataFrame, form: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
        """``(v, s)`` once for every wanted vertex (column ``v``)."""
        return cut_lineage(self.shipped(wanted.select("v").distinct(), form).dropDuplicates(["v"]))


def counted_near(pairs: DataFrame, sets: TextSets, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` without those whose bucket counts rule the share out; none that has it is lost.

    Sketches say nothing of long sets, and an index of single shingles brings
    many of these together by chance.  A set's counts are a small part of it, so
    few pairs are left whose whole sets have to meet.
    """
    for side in ("a", "b"):
        pairs = pairs.join(sets.vertices.select(F.col("v").alias("_v"), F.col("n").cast("long").alias(f"{side}n")), F.col(side) == F.col("_v")).drop("_v")
    pairs = cut_lineage(pairs.distinct())
    open_ = F.expr(f"(an + bn) * {100 - percent} >= {SKETCH_TELLS * (100 + percent)}")
    long = pairs.where(open_)
    counts = sets.held(long.select(F.explode(F.array("a", "b")).alias("v")), bucket_counts)
    for side in ("a", "b"):
        long = long.join(counts.select(F.col("v").alias("_v"), F.col("s").alias(f"{side}s")), F.col(side) == F.col("_v")).drop("_v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in ("as", "bs"))
            apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
            yield pdf.loc[apart * (100 + percent) <= (pdf["an"] + pdf["bn"]).to_numpy() * (100 - percent), ["a", "b"]]

    return pairs.where(~open_).select("a", "b").unionByName(long.select("a", "b", "an", "bn", "as", "bs").mapInPandas(run, "a long, b long"))


def near_enough(pairs: DataFrame, sets: TextSets, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose sets share ``percent`` of their union, by the sets themselves.

    The sets of all ``b`` of an ``a`` pass by that of ``a``, which a task holds
    alone; an ``a`` with very many partners is dealt to several tasks.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = cut_lineage(pairs.distinct())
    turns = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / PAIR_RUN).alias("_turns"))
    heads = turns.select(F.col("_a").alias("v"), F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_turns") - 1)).alias("turn"), F.lit(0).alias("member"))
    others = pairs.join(turns, F.col("a") == F.col("_a")).select(F.col("b").alias("v"), "a", F.pmod(F.xxhash64("b"), "_turns").alias("turn"), F.lit(1).alias("member"))

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.uint64)
        for pdf in frames:
            good = []
            for a, b, member, s in zip(pdf["a"].tolist(), pdf["v"].tolist(), pdf["member"].tolist(), pdf["s"]):
                s = np.frombuffer(s, np.uint64)
                if not member:
                    held = s
                    continue
                both = np.concatenate([held, s])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"])

    met = sets.shipped(heads.unionByName(others)).repartition(n, "a", "turn").sortWithinPartitions("a", "turn", "member")
    return cut_lineage(met.select("a", "member", "v", "s").mapInPandas(verified, "a long, b long").distinct())


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


MEMBER = ("v", "n", *SKETCH, "at", "root")


def all_pairs(rows: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of members of each list that can be near and aren't connected yet; the rest is left out within the join."""
    a = rows.select("key", *[F.col(c).alias(f"a_{c}") for c in MEMBER])
    b = rows.select(F.col("key").alias("_k"), *[F.col(c).alias(f"b_{c}") for c in MEMBER])
    met = a.join(b, (F.col("key") == F.col("_k")) & (F.col("a_v") < F.col("b_v")) & (F.col("a_root") != F.col("b_root")) & possible("a_", "b_"))
    return met.select(F.col("a_v").alias("a"), F.col("b_v").alias("b"))


def parted(lists: DataFrame, roots: DataFrame, vertices: DataFrame) -> DataFrame:
    """Lists whose members aren't all connected, with each member's ``root`` and sketch."""
    cols = ["key", "v", "n", "at", "m"]
    d = lists.select(*cols).join(roots, F.col("v") == F.col("node"), "left").select(*cols, F.coalesce("root", "v").alias("root"))
    torn = d.groupBy(F.col("key").alias("_k")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("_k")
    sketches = vertices.select(F.col("v").alias("_v"), *SKETCH)
    return cut_lineage(d.join(torn, F.col("key") == F.col("_k")).join(sketches, F.col("v") == F.col("_v")).drop("_k", "_v"))


def set_links(lists: DataFrame, sets: TextSets, percent: int, possible: Callable[[str, str], Column] | None = None,
              crowded: Callable[[DataFrame], DataFrame] | None = None, first: DataFrame | None = None, by_chance: bool = False) -> DataFrame:
    """Links that connect all near sets which meet on a list.

    Every member of a list meets a few of them first, and the pairs ``(a, b)`` of
    ``first`` are verified with these; members already connected
    need not meet any more.  Short lists then give all the pairs that are left;
    what is still apart on long ones is left to ``crowded`` (lists: pairs), or
    gives all pairs.  Pairs that sizes, sketches or ``possible`` rule out are
    never made; where sets meet ``by_chance``, long ones show their bucket counts
    before the whole sets are compared.
    """
    def verified(pairs: DataFrame) -> DataFrame:
        return near_enough(counted_near(pairs, sets, percent) if by_chance else pairs, sets, percent)

    def allowed(a: str, b: str) -> Column:
        return may_be_near(percent, a, b) & possible(a, b) if possible else may_be_near(percent, a, b)

    o = F.col("o.place")
    met = lists.withColumn("o", F.explode("met")).where("v <> o.v").select(
        "v", F.col("o.v").alias("w"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.shiftright(o, 32).cast("int").alias("b_n"),
        o.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_at"))
    met = met.where(F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"))
    met = (met.where(possible("a_", "b_")) if possible else met).select(*_pair("v", "w"))
    met = (met.unionByName(first.select(*_pair("a", "b"))) if first is not None else met).distinct()
    for side in ("a", "b"):
        met = met.join(sets.vertices.select(F.col("v").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *SKETCH)]), F.col(side) == F.col(f"_{side}"))
    links = verified(met.where(may_be_near(percent, "a_", "b_")).select("a", "b"))
    rest = parted(lists.where("m > 2"), components(links), sets.vertices)
    short, long = rest.where(F.col("m") <= SHORT_LIST), rest.where(F.col("m") > SHORT_LIST)
    pairs = all_pairs(short, allowed).unionByName(crowded(long) if crowded else all_pairs(long, allowed))
    return links.unionByName(verified(pairs))


def classes(prints: DataFrame, vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` with ``component``, the smallest id that links and equal sets reach."""
    roots = components(links)
    joined = cut_lineage(vertices.join(roots, F.col("v") == F.col("node"), "left").select("v", "_least", F.coalesce("root", "v").alias("root")))
    least = joined.groupBy("root").agg(F.min("_least").alias("component"))
    named = joined.join(least, "root").select(F.col("v").alias("_v"), "component")
    return prints.join(named, F.col("v") == F.col("_v")).drop("_v")
