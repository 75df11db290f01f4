"""Exact top-k search in an appearance gallery with block-maximum pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.plans.sequence import first_n
from framestory.session import cut_lineage

BLOCK_VECTORS, QUERY_BATCH, CHUNK_BLOCKS, FIRST_BLOCKS = 512, 256, 256, 2


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` per component as longs; null if the vector or a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors) -> np.ndarray:
    """Rows of possibly different length as one matrix, short ones filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _pack(m: np.ndarray) -> bytes:
    return np.int64(m.shape[1] if m.ndim == 2 else len(m)).tobytes() + np.ascontiguousarray(m, dtype=np.int64).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    width = int(np.frombuffer(b, np.int64, 1)[0])
    flat = np.frombuffer(b, np.int64, offset=8)
    return flat.reshape(-1, width) if width else np.zeros((0, 0), np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices over the same number of columns (the components both have)."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer ``a @ b.T``: floating point where every sum stays below 2^53, else integers."""
    a, b = _pair(a, b)
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if size < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def gallery_blocks(gallery: DataFrame, size: int = BLOCK_VECTORS) -> DataFrame:
    """The index: blocks of consecutive vectors with their largest and smallest component per dimension.

    Vectors are ordered by the signs of their leading components, then by id, so
    that a block's maxima are tight; a range partition is cut into blocks as it
    streams by, so no group grows.  One row per block: ``block_id``, ``ids``,
    ``vectors`` (its forward index), ``high``, ``low``.
    """
    sign = F.array_join(F.transform(F.slice("_v", 1, 12), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    n = int(gallery.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = gallery.withColumn("_sign", sign).repartitionByRange(n, "_sign", "_id").sortWithinPartitions("_sign", "_id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def block(rows):
            m = _matrix([v for _, v in rows])
            ids = np.array([i for i, _ in rows], dtype=np.int64)
            return {"ids": ids.tobytes(), "vectors": _pack(m), "high": _pack(m.max(0)[None, :]), "low": _pack(m.min(0)[None, :])}

        for pdf in batches:
            held += list(zip(pdf["_id"], pdf["_v"]))
            full, held = [held[i:i + size] for i in range(0, len(held) - size + 1, size)], held[len(held) // size * size:]
            if full:
                yield pd.DataFrame([block(r) for r in full])
        if held:
            yield pd.DataFrame([block(held)])

    built = ordered.select("_id", "_v").mapInPandas(build, "ids binary, vectors binary, high binary, low binary")
    return cut_lineage(built.withColumn("block_id", F.monotonically_increasing_id()))


def query_batches(queries: DataFrame, size: int = QUERY_BATCH) -> DataFrame:
    """Query vectors in batches of at most ``size``: ``batch_id``, ``ids``, ``vectors``."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches):
        held: list = []
        for pdf in batches:
            held += list(zip(pdf["_id"], pdf["_v"]))
            while len(held) >= size:
                part, held = held[:size], held[size:]
                yield pd.DataFrame([{"ids": np.array([i for i, _ in part], np.int64).tobytes(), "vectors": _pack(_matrix([v for _, v in part]))}])
        if held:
            yield pd.DataFrame([{"ids": np.array([i for i, _ in held], np.int64).tobytes(), "vectors": _pack(_matrix([v for _, v in held]))}])

    few = queries.select("_id", "_v").repartitionByRange(max(1, n // 4), "_id").sortWithinPartitions("_id")
    return cut_lineage(few.mapInPandas(build, "ids binary, vectors binary").withColumn("batch_id", F.monotonically_increasing_id()))


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bound of each query's score in each block: summed maxima of its terms."""
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    return _product(pos, high) + _product(neg, low)


def gallery_topk(tracks: DataFrame, queries: DataFrame, k: int = 5, key: str = "track_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """Per query track the ``k`` gallery tracks of largest integer inner product, ties to the smaller id.

    Block-at-a-time pruning: for a query the blocks are ordered by the sum of
    their term maxima; the best few are scored through their forward indexes and
    give a lower bound of the k-th score; then only blocks whose bound reaches it
    are scored.  A block whose bound equals the k-th score is still scored, for
    the ties.  Batches of queries meet chunks of block summaries on a chunk
    number; nothing is collected.

    Returns ``query_id``, ``rank`` (from 1), ``key``, ``score``.  A track is not
    its own candidate.  Tracks whose id or embedding is null, or whose embedding
    holds a null or a number that isn't finite, take no part; vectors of different length
    are compared over the components both have; an id that occurs several times
    counts with each of its rows; other columns don't pass; no tracks or no
    queries give an empty result.  Scores must fit a long.
    """
    part = lambda d: d.select(F.col(key).cast("long").alias("_id"), whole_numbers(F.col(embedding), scale).alias("_v")).where("_id IS NOT NULL AND _v IS NOT NULL AND size(_v) > 0")
    blocks, batches = gallery_blocks(part(tracks)), query_batches(part(queries))
    n_chunks = max(1, -(-blocks.count() // CHUNK_BLOCKS))
    numbered = blocks.select("block_id", "high", "low").withColumn("_chunk", F.pmod(F.xxhash64("block_id"), F.lit(n_chunks)))
    chunks = numbered.groupBy("_chunk").agg(F.collect_list(F.struct("block_id", "high", "low")).alias("blocks"))
    spread = batches.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))
    met = spread.join(chunks, "_chunk")

    def summaries(rows):
        widths = [np.frombuffer(r["high"], np.int64, 1)[0] for r in rows]
        w = int(max(widths))
        high, low = np.zeros((len(rows), w), np.int64), np.zeros((len(rows), w), np.int64)
        for i, r in enumerate(rows):
            high[i, :widths[i]], low[i, :widths[i]] = _unpack(r["high"])[0], _unpack(r["low"])[0]
        return np.array([r["block_id"] for r in rows], np.int64), high, low

    def best(frames):
        for pdf in frames:
            for ids, vectors, rows in zip(pdf["ids"], pdf["vectors"], pdf["blocks"]):
                b, high, low = summaries(rows)
                bound, q = _bounds(_unpack(vectors), high, low), np.frombuffer(ids, np.int64)
                top = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
                yield pd.DataFrame({"query_id": np.repeat(q, top.shape[1]), "block_id": b[top].ravel(),
                                    "bound": np.take_along_axis(bound, top, 1).ravel(), "at": np.repeat(np.arange(len(q)), top.shape[1])})

    cols = "query_id long, block_id long, bound long, at int, batch_id long"
    keep = lambda f: (lambda frames: (x.assign(batch_id=i) for pdf in frames for j, i in enumerate(pdf["batch_id"]) for x in f([pdf.iloc[j:j + 1]])))
    opening = first_n(met.select("batch_id", "ids", "vectors", "blocks").mapInPandas(keep(best), cols), ["query_id", "batch_id", "at"],
                      [F.col("bound").desc(), "block_id"], FIRST_BLOCKS, "_place")
    asked = cut_lineage(opening.groupBy("batch_id", "block_id").agg(F.collect_list("at").alias("wanted")))
    top = cut_lineage(_score(asked, batches, blocks, k))
    kth = (first_n(top, ["query_id", "batch_id", "at"], [F.col("score").desc(), "found"], k, "_place").groupBy("batch_id", "at")
           .agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("_n")).withColumn("kth", F.when(F.col("_n") >= k, F.col("kth")))
           .groupBy("batch_id").agg(F.collect_list(F.struct("at", "kth")).alias("levels")))

    def rest(frames):
        for pdf in frames:
            for batch, vectors, rows, levels in zip(pdf["batch_id"], pdf["vectors"], pdf["blocks"], pdf["levels"]):
                b, high, low = summaries(rows)
                bound = _bounds(_unpack(vectors), high, low)
                level = np.full(bound.shape[0], np.iinfo(np.int64).min)
                for x in ([] if levels is None else levels):
                    if x["kth"] is not None:
                        level[x["at"]] = x["kth"]
                need = bound >= level[:, None]
                for j in np.flatnonzero(need.any(0)):
                    yield pd.DataFrame({"batch_id": [batch], "block_id": [b[j]], "wanted": [np.flatnonzero(need[:, j]).astype(np.int32)]})

    later = met.join(kth, "batch_id", "left").select("batch_id", "vectors", "blocks", "levels").mapInPandas(rest, "batch_id long, block_id long, wanted array<int>")
    done = asked.select("batch_id", "block_id", F.col("wanted").alias("_done"))
    later = later.join(done, ["batch_id", "block_id"], "left").select(
        "batch_id", "block_id", F.when(F.col("_done").isNull(), F.col("wanted")).otherwise(F.array_except("wanted", "_done")).alias("wanted")).where("size(wanted) > 0")
    every = top.unionByName(_score(later, batches, blocks, k))
    ranked = first_n(every, ["query_id", "batch_id", "at"], [F.col("score").desc(), "found"], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")


def _score(wanted: DataFrame, batches: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Each wanted query's ``k`` best of a block, for rows ``(batch_id, block_id, wanted)``."""
    asked = wanted.join(batches, "batch_id").select("block_id", "batch_id", "wanted", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    rows = asked.join(blocks.select("block_id", "ids", "vectors"), "block_id").drop("block_id")

    def score(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                at = np.sort(np.asarray(r.wanted, dtype=np.int64))
                q, ids = np.frombuffer(r.q_ids, np.int64)[at], np.frombuffer(r.ids, np.int64)
                s = _product(_unpack(r.q_vectors)[at], _unpack(r.vectors))
                own = q[:, None] == ids[None, :]
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(own, order, 1), axis=1, kind="stable"), 1)[:, :k]
                ok = ~np.take_along_axis(own, order, 1)
                n = order.shape[1]
                out = pd.DataFrame({"query_id": np.repeat(q, n), "batch_id": r.batch_id, "at": np.repeat(at, n), "found": ids[order].ravel(),
                                    "score": np.take_along_axis(s, order, 1).ravel()})
                yield out[ok.ravel()]

    return rows.mapInPandas(score, "query_id long, batch_id long, at int, found long, score long")
