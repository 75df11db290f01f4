"""Prefix tries of stories (segments as sequences of events) in double arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framestory.llm.common import ranked
from framestory.session import cut_lineage

#: A prefix with more distinct continuations than this is shared by shards; a shard's task holds about so many events.
PREFIX_PATHS, SHARD_EVENTS = 2_000, 20_000
RUN_EVENTS = 10_000
FIT_TRIES = 64
BLOB_IDS = 4_096
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = ("depth int, p long, parent_p long, n long, children long, leaves long, saved long, end_p long, up boolean, "
        "h1 long, h2 long, q1 long, q2 long, chars long, above array<struct<depth:int,h1:long,h2:long>>")


class DoubleArray:
    """States in one array: the child of ``s`` by a code is ``base[s] + code`` if ``check`` there is ``s``.  State 0 is the root."""

    def __init__(self):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.used = np.zeros(1024, bool)
        self.used[0] = True
        self.free = 1

    def _grow(self, size: int) -> None:
        more = max(size + 1, 2 * len(self.used)) - len(self.used)
        if size >= len(self.used):
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def add(self, state: int, codes: np.ndarray) -> None:
        """Children of ``state``: the first base at which all codes (rising) fall on free places, or one behind all used ones."""
        while self.free < len(self.used) and self.used[self.free]:
            self.free += 1
        place, low = self.free, int(codes[0])
        for _ in range(FIT_TRIES):
            at = place - low + codes
            self._grow(int(at[-1]))
            if not self.used[at].any():
                break
            rest = np.flatnonzero(~self.used[place + 1:place + 1025])
            place = place + 1 + int(rest[0]) if len(rest) else place + 1025
        else:
            place = int(np.flatnonzero(self.used)[-1]) + 1
            at = place - low + codes
            self._grow(int(at[-1]))
        self.base[state] = place - low
        self.check[at] = state
        self.used[at] = True

    def follow(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = self.base[states] + codes
        ok = (at >= 0) & (at < len(self.check))
        if not (ok.all() and (self.check[at] == states).all()):
            raise KeyError("no such child")
        return at


def packed_trie(codes: list[np.ndarray]) -> tuple[DoubleArray, list[np.ndarray]]:
    """The double array of all sequences, level by level, and the sequences' states: per level those of the ones long enough."""
    trie = DoubleArray()
    size = np.array([len(c) for c in codes])
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    here, states, level = np.flatnonzero(size > 0), np.zeros(len(codes), np.int64), 0
    levels = []
    while len(here):
        c, s = flat[first[here] + level], states[here]
        order = np.lexsort((c, s))
        so, co = s[order], c[order]
        new = np.r_[True, (so[1:] != so[:-1]) | (co[1:] != co[:-1])]
        so, co = so[new], co[new]
        for lo, hi in _runs(so):
            trie.add(int(so[lo]), co[lo:hi])
        states[here] = trie.follow(s, c)
        levels.append(np.c_[here, states[here]])
        level += 1
        here = here[size[here] > level]
    return trie, levels


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(sorted_values)].tolist()))


def shard_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard: those below the shared prefixes are final, the shared ones (``up``) are this shard's part."""
    def listed(name: str, kind=np.int64) -> list[np.ndarray]:
        return [np.asarray(v, dtype=kind) for v in pdf[name]]

    t1, t2, h1, h2, chars = (listed(c) for c in ("t1", "t2", "h1", "h2", "chars"))
    size = np.array([len(v) for v in t1])
    flat = np.empty(int(size.sum()), dtype=[("a", np.int64), ("b", np.int64)])
    flat["a"], flat["b"] = np.concatenate(t1), np.concatenate(t2)
    dense = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    trie, levels = packed_trie(np.split(dense, np.cumsum(size)[:-1]))
    w, p, whole, up_to, tail = (pdf[c].to_numpy(np.int64) for c in ("w", "p", "whole", "up_to", "tail_chars"))
    m = len(trie.check)
    n, least, children, leaves, saved = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    depth, end, one, upper = np.full(m, -1), np.full(m, -1), np.full(m, -1), np.zeros(m, bool)
    depth[0], one[0], upper[0], n[0], least[0] = 0, 0, True, w.sum(), p.min()
    for j, lv in enumerate(levels):
        path, s = lv[:, 0], lv[:, 1]
        np.add.at(n, s, w[path])
        np.minimum.at(least, s, p[path])
        depth[s], one[s] = j + 1, path
        upper[s] = up_to[path] > j
    for j, lv in enumerate(levels):
        s = np.unique(lv[:, 1])
        last = np.array([chars[i][j] for i in one[s]], np.int64)
        saved[s] = np.where(upper[s], 0, (n[s] - 1) * last)
        np.add.at(children, trie.check[s], 1)
        out = lv[size[lv[:, 0]] == j + 1]
        path, s = out[:, 0], out[:, 1]
        done = whole[path] == j + 1
        end[s[done]] = p[path[done]]
        more = s[~done]  # what follows is a tail of its own: one child, one leaf
        children[more] += 1
        leaves[more] = 1
        saved[more] += (w[path[~done]] - 1) * tail[path[~done]]
    at = np.flatnonzero(depth >= 0)
    leaves[at[(children[at] == 0) & ~upper[at]]] = 1
    for lv in reversed(levels):
        s = np.unique(lv[:, 1])
        np.add.at(leaves, trie.check[s], leaves[s])
        np.add.at(saved, trie.check[s], saved[s])
    prints = [(h1[one[s]], h2[one[s]]) for s in at]
    d = depth[at]
    parent = trie.check[at]
    below = (d > 0) & ~upper[np.maximum(parent, 0)]
    return pd.DataFrame({
        "depth": d.astype(np.int32), "p": least[at], "parent_p": _or_null(least[parent], below),
        "n": n[at], "children": children[at], "leaves": leaves[at], "saved": saved[at], "end_p": _or_null(end[at], end[at] >= 0), "up": upper[at],
        "h1": [int(a[k - 1]) if k else 0 for (a, _), k in zip(prints, d)], "h2": [int(b[k - 1]) if k else 0 for (_, b), k in zip(prints, d)],
        "q1": [int(a[k - 2]) if k > 1 else 0 for (a, _), k in zip(prints, d)], "q2": [int(b[k - 2]) if k > 1 else 0 for (_, b), k in zip(prints, d)],
        "chars": [int(chars[one[s]][k - 1]) if k else 0 for s, k in zip(at, d)],
        "above": [[{"depth": i, "h1": int(a[i - 1]) if i else 0, "h2": int(b[i - 1]) if i else 0} for i in range(k + 1)] if u else []
                  for (a, b), k, u in zip(prints, d.tolist(), upper[at])]})


def _or_null(values: np.ndarray, there: np.ndarray) -> pd.Series:
    out = pd.Series(values).astype("Int64")
    out[~there] = pd.NA
    return out


def _prefixes(rows: DataFrame) -> DataFrame:
    """Adds ``h1``, ``h2`` (hashes of the sequence up to the row) and ``cum`` (its characters), in runs of ``RUN_EVENTS`` rows."""
    d = rows.withColumns({"_x1": F.xxhash64("t1", "t2", "d"), "_x2": F.xxhash64("t2", "d", "t1", F.lit(1)),
                          "_run": F.floor((F.col("d") - 1) / RUN_EVENTS)})
    runs = d.groupBy("k", "_run").agg(F.bit_xor("_x1").alias("_r1"), F.bit_xor("_x2").alias("_r2"), F.sum("chars").alias("_rc"))
    before = Window.partitionBy("k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carry = runs.select(F.col("k").alias("_k"), F.col("_run").alias("_at"), *[
        F.coalesce(c.over(before), zero).alias(a) for a, c in (("_c1", F.bit_xor("_r1")), ("_c2", F.bit_xor("_r2")), ("_cc", F.sum("_rc")))])
    here = Window.partitionBy("k", "_run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_h1": F.bit_xor("_x1").over(here), "_h2": F.bit_xor("_x2").over(here), "_hc": F.sum("chars").over(here)})
    d = d.join(carry, (F.col("k") == F.col("_k")) & (F.col("_run") == F.col("_at")))
    return d.select("k", "d", "t1", "t2", "chars", F.col("_h1").bitwiseXOR(F.col("_c1")).alias("h1"),
                    F.col("_h2").bitwiseXOR(F.col("_c2")).alias("h2"), (F.col("_hc") + F.col("_cc")).alias("cum"), "_x1", "_x2")


def _digests(members: DataFrame) -> DataFrame:
    """``(p, digest)``: SHA-256 of each path's member keys in order, comma-joined.

    A digest must be taken in sequence; keys are sorted and written out in many
    tasks, and only finished pieces of text meet in the task that takes a path's digest.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for pdf in frames:
            out = []
            p = pdf["p"].to_numpy()
            for lo, hi in _runs(p) if len(p) else []:
                for i in range(lo, hi, BLOB_IDS):
                    part = pdf.iloc[i:min(hi, i + BLOB_IDS)]
                    out.append((p[i], int(part["_part"].iloc[0]), number, ",".join(part["name"]).encode()))
                    number += 1
            yield pd.DataFrame(out, columns=["p", "part", "number", "text"])

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sha = None, None
        for pdf in frames:
            out = []
            for p, text in zip(pdf["p"], pdf["text"]):
                if p == held:
                    sha.update(b"," + text)
                else:
                    if held is not None:
                        out.append((held, sha.hexdigest()))
                    held, sha = p, hashlib.sha256(text)
            if out:
                yield pd.DataFrame(out, columns=["p", "digest"])
        if held is not None:
            yield pd.DataFrame({"p": [held], "digest": [sha.hexdigest()]})

    ordered = members.repartitionByRange(n, "p", "key").withColumn("_part", F.spark_partition_id()).sortWithinPartitions("p", "key")
    ordered = ordered.select("p", "_part", F.col("key").cast("string").alias("name"))
    text = cut_lineage(ordered.mapInPandas(pieces, "p long, part int, number long, text binary"))
    return text.repartition(n, "p").sortWithinPartitions("p", "part", "number").select("p", "text").mapInPandas(digests, "p long, digest string")


def story_trie(events: DataFrame, segments: DataFrame | None = None, key: str = "segment_id", place: str = "seq", kind: str = "event_type",
               detail: str = "description", prefix_paths: int = PREFIX_PATHS, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """Prefix trie of story segments, each the sequence of its events ``(kind, detail)`` by ``place``; one row per node.

    ``segments`` may list further keys, so that segments without events count.
    Returns ``key`` (the smallest segment that starts with the node's sequence),
    ``depth`` (0: the root), ``parent`` (the parent node's ``key``; root: null),
    ``n_segments``, ``n_children``, ``n_leaves`` (childless nodes of its subtree,
    itself included), ``saved_chars`` (over its subtree: (``n_segments`` - 1) times
    the characters of a node's last detail) and ``ends_sha256`` (SHA-256 of the
    keys, in order and comma-joined, whose whole sequence the node is).

    Segments of the same sequence are one path.  A prefix's shard is one task's
    double array over dense event numbers: it holds each path as far as another
    path shares it and one event more; what follows is a tail of rows that need
    no trie.  Prefixes with more than ``prefix_paths`` paths are split over the
    shards of their continuations, and what the shards say of them is added up.
    A long segment is hashed in runs; a path's shared part is one array.

    Null places come first, ties go by kind, then detail; null kinds and details
    are empty.  Rows with a null key belong to no segment and are left out.
    Repeated rows are events of their own.  Other columns don't pass.  Without
    segments there is no node, not even a root.
    """
    name = {c: F.col(v) for c, v in (("k", key), ("o", place), ("a", kind), ("b", detail))}
    e = events.select(*[c.alias(n) for n, c in name.items()]).where("k IS NOT NULL")
    e = e.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in "ab"})
    seq = ranked(e, [F.col("k"), F.col("o").asc_nulls_first(), F.col("a"), F.col("b")])
    seq = seq.select("k", "seq", F.xxhash64("a", "b").alias("t1"), F.xxhash64("b", F.lit(1), "a").alias("t2"), F.length("b").cast("long").alias("chars"))
    first = seq.groupBy(F.col("k").alias("_k")).agg(F.min("seq").alias("_from"))
    rows = seq.join(first, F.col("k") == F.col("_k")).select("k", (F.col("seq") - F.col("_from") + 1).alias("d"), "t1", "t2", "chars")
    rows = cut_lineage(_prefixes(rows))

    zero = F.lit(0).cast("long")
    whole = rows.groupBy("k").agg(F.max("d").alias("whole"), F.bit_xor("_x1").alias("f1"), F.bit_xor("_x2").alias("f2"), F.sum("chars").alias("total"))
    if segments is not None:
        listed = segments.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
        bare = listed.join(whole.select("k"), "k", "left_anti").select("k", *[zero.alias(c) for c in ("whole", "f1", "f2", "total")])
        whole = whole.unionByName(bare)
    whole = cut_lineage(whole)
    paths = whole.groupBy("whole", "f1", "f2").agg(F.min("k").alias("key"), F.count(F.lit(1)).alias("w"), F.min("total").alias("total"))
    paths = cut_lineage(ranked(paths, [F.col("key")], "p"))

    own = paths.select("p", "whole", "w", "total", F.col("key").alias("_key"))
    r = rows.join(own, F.col("k") == F.col("_key")).select("p", "d", "t1", "t2", "h1", "h2", "chars", "cum", "whole", "w", "total")
    shared = r.groupBy(F.col("d").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.count(F.lit(1)).alias("np"))
    r = cut_lineage(r.join(shared, (F.col("d") == F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).drop("_d", "_h1", "_h2"))
    cuts = r.groupBy(F.col("p").alias("_p")).agg(
        F.least(F.coalesce(F.max(F.when(F.col("np") > 1, F.col("d"))), zero) + 1, F.first("whole")).alias("inside"),
        F.min(F.when(F.col("np") <= prefix_paths, F.col("d"))).alias("own_from"))
    r = r.join(cuts, F.col("p") == F.col("_p")).drop("_p")

    tails = r.where("d > inside").select(
        F.col("d").cast("int").alias("depth"), "p", F.col("p").alias("parent_p"), F.col("w").alias("n"), (F.col("d") < F.col("whole")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * (F.col("total") - F.col("cum") + F.col("chars"))).alias("saved"),
        F.when(F.col("d") == F.col("whole"), F.col("p")).alias("end_p"))
    body = r.where("d <= inside")
    # the place of the cut: the prefix that has a shard to itself, or the whole path where it ends before
    cut = F.col("d") == F.coalesce("own_from", "whole")
    body = body.groupBy("p", "whole", "w").agg(
        F.array_sort(F.collect_list(F.struct("d", "t1", "t2", "h1", "h2", "chars"))).alias("v"),
        F.max(F.when(cut, F.xxhash64("d", "h1", "h2"))).alias("shard"),
        F.max(F.coalesce(F.col("own_from") - 1, F.col("whole"))).alias("up_to"), (F.max("total") - F.max("cum")).alias("tail_chars"))
    body = cut_lineage(body.select("p", "whole", "w", "shard", "up_to", "tail_chars", *[F.col(f"v.{c}").alias(c) for c in ("t1", "t2", "h1", "h2", "chars")]))
    n_events = body.agg(F.sum(F.size("t1"))).first()[0] or 0
    shards = max(1, -(-int(n_events) // shard_events))
    nodes = cut_lineage(body.withColumn("_b", F.pmod("shard", F.lit(shards))).groupBy("_b").applyInPandas(shard_nodes, NODE))

    bare = paths.where("whole = 0").select(
        F.lit(0).alias("depth"), "p", F.lit(None).cast("long").alias("parent_p"), F.col("w").alias("n"), *[zero.alias(c) for c in ("children", "leaves", "saved")],
        F.col("p").alias("end_p"), F.lit(True).alias("up"), *[zero.alias(c) for c in ("h1", "h2", "q1", "q2", "chars")],
        F.array(F.struct(F.lit(0).alias("depth"), zero.alias("h1"), zero.alias("h2"))).alias("above"))
    at = ["depth", "h1", "h2"]
    upper = nodes.where("up").unionByName(bare).groupBy(*at).agg(
        F.min("p").alias("p"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("deep"), F.max("end_p").alias("end_p"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("chars").alias("chars"), F.first("above").alias("above"))
    upper = cut_lineage(upper)
    named = [F.col(c).alias(f"_{c}") for c in at]
    same = (F.col("depth") == F.col("_depth")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    below = nodes.where("NOT up")
    children = (upper.where("depth > 0").select("depth", "q1", "q2").unionByName(below.where("parent_p IS NULL").select("depth", "q1", "q2"))
                .groupBy((F.col("depth") - 1).alias("_depth"), F.col("q1").alias("_h1"), F.col("q2").alias("_h2")).agg(F.count(F.lit(1)).alias("children")))
    own_saved = upper.select(F.explode("above").alias("_n"), ((F.col("n") - 1) * F.col("chars")).alias("_s")).groupBy("_n").agg(F.sum("_s").alias("_s"))
    own_saved = own_saved.select(*[F.col(f"_n.{c}").alias(f"_{c}") for c in at], "_s")
    held = upper.join(children, same, "left").drop(*[f"_{c}" for c in at]).join(own_saved, same).drop(*[f"_{c}" for c in at])
    parents = upper.select(*named, F.col("p").alias("_pp"))
    up_of = ((F.col("depth") - 1) == F.col("_depth")) & (F.col("q1") == F.col("_h1")) & (F.col("q2") == F.col("_h2"))
    cols = ["depth", "p", "parent_p", "n", "children", "leaves", "saved", "end_p"]
    held = held.join(parents, up_of, "left").select(
        "depth", "p", F.col("_pp").alias("parent_p"), "n", F.coalesce("children", zero).alias("children"),
        F.when(F.col("children").isNull(), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves"), (F.col("deep") + F.col("_s")).alias("saved"), "end_p")
    top = below.where("parent_p IS NULL").drop("parent_p").join(parents, up_of).withColumn("parent_p", F.col("_pp"))
    found = held.select(*cols).unionByName(top.select(*cols)).unionByName(below.where("parent_p IS NOT NULL").select(*cols)).unionByName(tails.select(*cols))

    path_keys = paths.select(F.col("p").alias("_p"), F.col("key"), "w")
    alone = path_keys.where("w = 1").select("_p", F.sha2(F.col("key").cast("string"), 256).alias("digest"))
    many = paths.where("w > 1").select("p", *[F.col(c).alias(f"_{c}") for c in ("whole", "f1", "f2")])
    members = whole.join(many, (F.col("whole") == F.col("_whole")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))).select("p", F.col("k").alias("key"))
    ends = alone.unionByName(_digests(members).withColumnRenamed("p", "_p"))
    out = found.join(ends, F.col("end_p") == F.col("_p"), "left").drop("_p")
    out = out.join(path_keys.select("_p", F.col("key").alias("_key")), F.col("p") == F.col("_p")).drop("_p")
    out = out.join(path_keys.select("_p", F.col("key").alias("parent")), F.col("parent_p") == F.col("_p"), "left")
    return out.select(F.col("_key").alias(key), "depth", "parent", F.col("n").alias("n_segments"), F.col("children").alias("n_children"),
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_chars"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"))
