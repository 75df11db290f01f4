"""SimHash near-duplicates of failure descriptions through a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import same, text_rows
from framestory.llm.graph import components
from framestory.session import cut_lineage

SEED = 42
UPPER = bytes(range(256)).lower()
HASH_RUN = 1 << 16


def text_fingerprint(text: str, words: int, bits: int) -> bytes:
    """SimHash of a whole text: a bit is set if over half of the shingles' hashes set it; no words: zero."""
    ws = text.encode("utf-8", "replace").translate(UPPER).split()
    if not ws:
        return bytes(bits // 8)
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    k = min(words, len(ws))
    stops = ends[k - 1:].tolist()
    starts = [0, *(ends[:len(ws) - k] + 1).tolist()]
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    counts = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(stops), HASH_RUN):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + HASH_RUN], stops[i:i + HASH_RUN])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(stops)).tobytes()


def set_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of a set of 64-bit hashes, each counted once; the empty set: zero."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASH_RUN):
        counts += np.unpackbits(np.ascontiguousarray(hashes[i:i + HASH_RUN]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(failures: DataFrame, key: str = "failure_id", text: str = "description", words: int = 3, bits: int = 64) -> DataFrame:
    """``key`` and ``fingerprint`` (binary) of each row's whole text."""
    if bits not in (64, 128):
        raise ValueError("fingerprints have 64 or 128 bits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"_id": pdf["_id"], "fingerprint": [text_fingerprint(t, words, bits) for t in pdf["_text"]]})

    d = text_rows(failures, key, text)
    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInPandas(run, f"_id {kind}, fingerprint binary").withColumnRenamed("_id", key)


def position_sets(bits: int, max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions to index.

    ``max_bits`` differing bits touch at most as many bytes, so a pair shares at
    least ``bits / 8 - max_bits`` positional bytes, some set of that size in full.
    All sets of that size are taken, so no pair is missed.  That is for fingerprints
    that are nearly equal: beyond three bits a set would hold too little to tell
    fingerprints apart, and texts are compared by their shingles instead (``overlap``).
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("fingerprints link at up to three differing bits")
    n = bits // 8
    return list(combinations(range(n), n - max_bits))


def posting_lists(distinct: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """The inverted index ``(posting, fingerprint)``: a posting is a position set and the bytes there."""
    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            raw = np.frombuffer(b"".join(pdf["fingerprint"]), np.uint8).reshape(len(pdf), -1).astype(np.int64)
            for i, s in enumerate(sets):
                value = np.full(len(raw), i, np.int64)
                for p in s:
                    value = (value << 8) | raw[:, p] if len(s) < 8 else value * 1_000_003 ^ raw[:, p]
                yield pd.DataFrame({"posting": value, "fingerprint": pdf["fingerprint"]})

    return distinct.select("fingerprint").mapInPandas(run, "posting long, fingerprint binary")


def _forest(raw: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (later, earlier) that join a list's members into the components of their near pairs.

    Every pair is compared, a row of differences at a time; of a member's near
    pairs only those are returned that join parts not yet joined.
    """
    words = raw.view(np.uint64)
    label = np.arange(len(raw))
    out = []
    for i in range(1, len(raw)):
        apart = np.bitwise_count(words[:i] ^ words[i]).sum(axis=1)
        near = np.flatnonzero(apart <= max_bits)
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            out += [(i, int(near[j])) for j in at]
            label[i] = labels[0]
            if len(labels) > 1:
                label[:i][np.isin(label[:i], labels[1:])] = labels[0]
    return out


def near_links(distinct: DataFrame, bits: int, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to connect all near pairs of each posting list.

    A posting list holds the fingerprints that share the guaranteed number of
    positional bytes, so the count filter is met by being on one; members are
    verified by their differing bits.  A list has at most 256^max_bits members,
    whatever the input.
    """
    sets = position_sets(bits, max_bits)

    def run(frames):
        held_k, held_f = np.zeros(0, np.int64), np.zeros((0, bits // 8), np.uint8)

        def drain(keys, raw, final):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(keys)]
            whole = len(starts) if final else len(starts) - 1
            rows = []
            for lo, hi in zip(starts[:whole], stops[:whole]):
                if hi - lo > 1:
                    part = np.ascontiguousarray(raw[lo:hi])
                    rows += [(part[i].tobytes(), part[j].tobytes()) for i, j in _forest(part, max_bits)]
            keep = len(keys) if final else starts[-1]
            return rows, keys[keep:], raw[keep:]

        for pdf in frames:
            if not len(pdf):
                continue
            raw = np.frombuffer(b"".join(pdf["fingerprint"]), np.uint8).reshape(len(pdf), -1)
            rows, held_k, held_f = drain(np.r_[held_k, pdf["posting"].to_numpy(np.int64)], np.vstack([held_f, raw]), False)
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"])
        if len(held_k):
            rows, *_ = drain(held_k, held_f, True)
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = posting_lists(distinct, sets).repartition(n, "posting").sortWithinPartitions("posting", "fingerprint")
    return lists.mapInPandas(run, "a binary, b binary").distinct()


def near_failures(failures: DataFrame, key: str = "failure_id", text: str = "description", words: int = 3, bits: int = 64, max_bits: int = 2) -> DataFrame:
    """Near-duplicate classes of failure descriptions; one row per record.

    Texts are lower-cased (A-Z), cut into words at white space and into shingles
    of ``words`` words, repeats included; fewer words are one shingle.  Records
    link where their SimHash fingerprints differ in ``max_bits`` bits or less.
    Returns ``key``, ``fingerprint`` (lower-case hex) and ``component``, the
    smallest key that can be reached over links, its own included.

    Equal fingerprints are one vertex, so groups of copies never become pairs.
    Null and empty texts have the zero fingerprint and link like any other.  Null
    keys are kept but are nobody's smallest key; repeated rows are kept; other
    columns don't pass; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(failures.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t", words, bits))
    vertices = cut_lineage(prints.groupBy("fingerprint").agg(F.min("_k").alias("_least")))
    roots = components(near_links(vertices, bits, max_bits))
    joined = vertices.join(roots, vertices["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "_least", F.coalesce("root", "fingerprint").alias("root"))
    joined = cut_lineage(joined)
    linked = joined.groupBy("root").agg(F.min("_least").alias("component"))
    named = joined.join(linked, "root").select(F.col("fingerprint").alias("_f"), "component")
    out = prints.join(named, prints["fingerprint"] == named["_f"])
    return out.select(F.col("_k").alias(key), F.lower(F.hex("fingerprint")).alias("fingerprint"), "component")
