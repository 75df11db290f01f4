"""Linking detections into tracks: relational batch tracker and the frame-by-frame lifecycle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.functions import geometry as g
from framestory.plans.fold import ordered_fold
from framestory.plans.sequence import index_rows
from framestory.session import cut_lineage


def frame_ranks(frames: DataFrame) -> DataFrame:
    """0-based rank of every frame of a video, detections or not."""
    return index_rows(frames.select("video_id", "frame_number").distinct(), ["video_id"], ["frame_number"],
                      F.floor(F.col("frame_number") / 65_536).cast("long"), "frame_rank")


def iou_candidates(det: DataFrame, gap: int = 1, threshold: float = 0.25) -> DataFrame:
    """Same-class pairs ``gap`` frames apart with enough overlap.  ``det`` carries ``frame_rank``."""
    cols = ["video_id", "class_name", "frame_rank", "det_id", "x1", "y1", "x2", "y2"]
    d = det.select(*cols).withColumn("class_name", F.lower("class_name"))
    a = g.prefixed(d.withColumn("_to", F.col("frame_rank") + gap), "a_", ["video_id", "class_name", "_to"])
    b = g.prefixed(d.withColumn("_to", F.col("frame_rank")), "b_", ["video_id", "class_name", "_to"])
    j = a.join(b, ["video_id", "class_name", "_to"]).withColumn("iou", g.iou("a_", "b_")).where(F.col("iou") >= threshold)
    return j.select("video_id", (F.col("_to") - gap).alias("frame_rank"), F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), "iou")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, each row and column in at most one; pairs without gain are left out.

    Rows come in one after the other; each time the cheapest chain of swaps that
    makes room is found with reduced costs (prices keep those at zero or above).
    """
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    holder = np.full(m + 1, -1)  # column m stands for the row that comes in
    for row in range(n):
        holder[m], at = row, m
        slack, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while holder[at] >= 0:
            done[at] = True
            i = holder[at]
            reduced = cost[i] - row_price[i] - col_price[:m]
            better = ~done[:m] & (reduced < slack)
            slack[better], back[better] = reduced[better], at
            nxt = int(np.argmin(np.where(done[:m], np.inf, slack)))
            step = slack[nxt]
            row_price[holder[done]] += step
            col_price[done] -= step
            slack[~done[:m]] -= step
            at = nxt
        while at != m:
            holder[at], at = holder[back[at]], back[at]
    pairs = [(int(holder[j]), j) for j in range(m) if holder[j] >= 0]
    pairs = [(j, i) for i, j in pairs] if flip else pairs
    return sorted((i, j) for i, j in pairs if gain[i, j] > 0)


def _parts_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number per edge, equal for the edges of a connected part."""
    part = np.arange(len(a))
    while True:
        least = part.copy()
        for ends in (a, b):
            low = np.full(ends.max() + 1, len(a))
            np.minimum.at(low, ends, least)
            least = np.minimum(least, low[ends])
        if (least == part).all():
            return part
        part = least


#: Parts of up to so many edges try all choices of edges, side by side with the other parts.
TRIED_EDGES = 6


def _tried(a: np.ndarray, b: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which edges of each part (a row; all have as many edges) give the greatest total, by trying every choice."""
    n = a.shape[1]
    best, chosen = np.zeros(len(a)), np.zeros(a.shape, bool)
    for choice in range(1, 1 << n):
        at = [k for k in range(n) if choice >> k & 1]
        fits = np.ones(len(a), bool)
        for x, i in enumerate(at):
            for j in at[:x]:
                fits &= (a[:, i] != a[:, j]) & (b[:, i] != b[:, j])
        total = iou[:, at].sum(axis=1)
        better = fits & (total > best)
        best[better] = total[better]
        chosen[better] = np.isin(np.arange(n), at)
    return chosen


def _best_links(rows: pd.DataFrame) -> np.ndarray:
    """Which rows (whole frame pairs, in order of a and b) belong to the assignment of the greatest total overlap."""
    place = np.unique(np.stack([pd.factorize(rows[c], use_na_sentinel=False)[0] for c in ("video_id", "frame_rank")]), axis=1, return_inverse=True)[1].reshape(-1)
    a, b = (np.unique(place * (len(rows) + 1) + pd.factorize(rows[c])[0], return_inverse=True)[1] for c in ("a", "b"))
    iou, part = rows["iou"].to_numpy(), _parts_of(a, b)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    sizes = np.diff(np.r_[starts, len(order)])
    take = np.zeros(len(rows), bool)
    for n in range(1, TRIED_EDGES + 1):
        at = order[starts[sizes == n][:, None] + np.arange(n)]
        take[at] = _tried(a[at], b[at], iou[at]) if len(at) else False
    for lo, n in zip(starts[sizes > TRIED_EDGES], sizes[sizes > TRIED_EDGES]):
        at = order[lo:lo + n]
        i, j = (np.unique(x[at], return_inverse=True)[1] for x in (a, b))
        gain = np.zeros((i.max() + 1, j.max() + 1))
        gain[i, j] = iou[at]
        edge = {(x, y): k for x, y, k in zip(i.tolist(), j.tolist(), at)}
        take[[edge[x] for x in best_assignment(gain)]] = True
    return take


def optimal_links(cands: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One-to-one links of the greatest total overlap between two neighbouring frames.

    ``cands`` holds all overlapping pairs (``iou_candidates`` with a threshold next
    to 0): links below ``threshold`` are dropped only afterwards, since they may
    make room for others.  Each connected part of a frame pair is solved exactly:
    the small ones of many frame pairs at once, a larger one by itself.  A task
    holds a batch of rows and the pairs of one frame pair, so it is bounded by
    the boxes of a frame, not by the length of the video.
    """
    pair = ["video_id", "frame_rank"]
    d = cands.select(*pair, "a", "b", "iou").where("iou > 0")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ends = rows[pair].ne(rows[pair].iloc[-1:].to_numpy()[0]).any(axis=1).to_numpy() if len(rows) else np.zeros(0, bool)
            whole = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0  # the last frame pair may go on
            held = rows.iloc[whole:]
            if whole:
                rows = rows.iloc[:whole]
                yield rows[_best_links(rows)]
        if held is not None and len(held):
            yield held[_best_links(held)]

    links = d.repartition(n, *pair).sortWithinPartitions(*pair, "a", "b").mapInPandas(solved, d.schema)
    return links.where(F.col("iou") >= threshold)


def link_one_to_one(cands: DataFrame) -> DataFrame:
    """Greedy one-to-one links by IoU, then ids.

    An edge that is the best one of both its ends is what the greedy order
    takes next for them; such edges are accepted, their ends removed, and the
    rest repeated until nothing is left.
    """
    order = F.struct((-F.col("iou")).alias("n"), "a", "b")
    left = cut_lineage(cands.select("video_id", "a", "b", "iou"))
    links = None
    while not left.isEmpty():
        e = left.withColumn("_o", order)
        best_a = e.groupBy("video_id", "a").agg(F.min("_o").alias("_o")).select("video_id", "_o")
        best_b = e.groupBy("video_id", "b").agg(F.min("_o").alias("_o")).select("video_id", "_o")
        won = cut_lineage(best_a.join(best_b, ["video_id", "_o"]).select(
            "video_id", F.col("_o.a").alias("a"), F.col("_o.b").alias("b"), (-F.col("_o.n")).alias("iou")))
        links = won if links is None else links.unionByName(won)
        left = cut_lineage(left.join(won.select("video_id", "a"), ["video_id", "a"], "left_anti")
                           .join(won.select("video_id", "b"), ["video_id", "b"], "left_anti"))
    return links if links is not None else left


def chain_roots(ids: DataFrame, links: DataFrame) -> DataFrame:
    """First element of the chain of every id, by pointer doubling (log2 of the longest chain)."""
    p = cut_lineage(ids.select("video_id", "id").join(
        links.select("video_id", F.col("b").alias("id"), F.col("a").alias("up")), ["video_id", "id"], "left")
        .withColumn("root", F.coalesce("up", "id")).select("video_id", "id", "root"))
    while True:
        up = p.select("video_id", F.col("id").alias("root"), F.col("root").alias("_next"))
        nxt = cut_lineage(p.join(up, ["video_id", "root"]).select("video_id", "id", F.col("_next").alias("root"),
                                                                  (F.col("_next") != F.col("root")).alias("_moved")))
        p = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            return p


def track_batch(det: DataFrame, threshold: float = 0.25, max_lost: int = 3, min_confidence: float = 0.25) -> DataFrame:
    """Detections with ``track_id``: links over gaps 1 … max_lost + 1, then chains.

    Ids count up per video by the first frame of the track.  Chains that start
    with a detection below the minimum confidence are dropped from the front
    until one reaches it, as only confident detections may open a track.
    """
    ranks = frame_ranks(det)
    d = cut_lineage(det.join(ranks, ["video_id", "frame_number"]))
    links = None
    open_left = open_right = d.select("video_id", "class_name", "frame_rank", "det_id", "x1", "y1", "x2", "y2")
    for gap in range(1, max_lost + 2):
        new = link_one_to_one(_pairs(open_left, open_right, gap, threshold))
        links = new if links is None else links.unionByName(new)
        if gap <= max_lost:  # a later gap looks only at what the gaps before left open
            open_left = cut_lineage(open_left.join(new.select("video_id", F.col("a").alias("det_id")), ["video_id", "det_id"], "left_anti"))
            open_right = cut_lineage(open_right.join(new.select("video_id", F.col("b").alias("det_id")), ["video_id", "det_id"], "left_anti"))
    roots = chain_roots(d.select("video_id", F.col("det_id").alias("id")), links)
    m = d.join(roots.withColumnRenamed("id", "det_id"), ["video_id", "det_id"])
    opened = m.where(F.col("confidence") >= min_confidence).groupBy("video_id", "root").agg(F.min("frame_rank").alias("_open"))
    m = m.join(opened, ["video_id", "root"]).where(F.col("frame_rank") >= F.col("_open"))
    first = m.groupBy("video_id", "root").agg(F.min("frame_number").alias("_ff"), F.min_by("det_id", "frame_rank").alias("_fd"))
    ids = index_rows(first, ["video_id"], ["_ff", "_fd"], F.floor(F.col("_ff") / 4096).cast("long"), "track_id")
    return m.join(ids.select("video_id", "root", (F.col("track_id") + 1).alias("track_id")), ["video_id", "root"]).drop("root", "_open")


def _pairs(left: DataFrame, right: DataFrame, gap: int, threshold: float) -> DataFrame:
    cols = ["video_id", "class_name", "frame_rank", "det_id", "x1", "y1", "x2", "y2"]
    a = g.prefixed(left.select(*cols).withColumn("class_name", F.lower("class_name")).withColumn("_to", F.col("frame_rank") + gap),
                   "a_", ["video_id", "class_name", "_to"])
    b = g.prefixed(right.select(*cols).withColumn("class_name", F.lower("class_name")).withColumn("_to", F.col("frame_rank")),
                   "b_", ["video_id", "class_name", "_to"])
    return (a.join(b, ["video_id", "class_name", "_to"]).withColumn("iou", g.iou("a_", "b_")).where(F.col("iou") >= threshold)
            .select("video_id", F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), "iou"))


@dataclass(frozen=True)
class TrackerConfig:
    iou_threshold: float = 0.25
    max_lost: int = 15
    confirm: int = 2
    min_confidence: float = 0.25
    optimal: bool = False


LIFECYCLE_OUT = T.StructType([
    T.StructField("frame_number", T.LongType()), T.StructField("track_key", T.LongType()), T.StructField("det_id", T.LongType()),
    T.StructField("action", T.StringType()), T.StructField("state", T.StringType())])


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    side = np.clip(hi - lo, 0.0, None)
    inter = side[..., 0] * side[..., 1]
    size_a = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
    size_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(inter > 0, inter / (size_a[:, None] + size_b[None, :] - inter), 0.0)


def _greedy_pairs(boxes: list, dets: np.ndarray, track_keys: list, det_ids: np.ndarray, threshold: float) -> dict[int, int]:
    """Track index to detection index, by overlap, then ids."""
    if not boxes or not len(dets):
        return {}
    m = _iou_matrix(np.asarray(boxes), dets)
    i, j = np.nonzero(m >= threshold)
    order = np.lexsort((det_ids[j], np.asarray(track_keys)[i], -m[i, j]))
    by_track, taken = {}, set()
    for k in order:
        p, q = int(i[k]), int(j[k])
        if p not in by_track and q not in taken:
            by_track[p] = q
            taken.add(q)
    return by_track


def _optimal_pairs(boxes: list, dets: np.ndarray, track_keys: list, det_ids: np.ndarray, threshold: float) -> dict[int, int]:
    """Track index to detection index with the greatest total overlap; equal totals are settled by ids as far as the order of rows goes."""
    if not boxes or not len(dets):
        return {}
    rows, cols = np.argsort(np.asarray(track_keys), kind="stable"), np.argsort(det_ids, kind="stable")
    m = _iou_matrix(np.asarray(boxes)[rows], dets[cols])
    return {int(rows[i]): int(cols[j]) for i, j in best_assignment(m) if m[i, j] >= threshold}


def lifecycle_step(cfg: TrackerConfig = TrackerConfig()):
    """One frame after another; the state is the list of live tracks.

    A track is named by the detection that opened it, so the state holds no
    counter and forgets ended tracks; two runs that agree on the live tracks
    agree on everything after.
    """
    def note(out, frame, key, det, action, state):
        out.append({"frame_number": frame, "track_key": key, "det_id": det, "action": action, "state": state})

    def miss(t, frame, out):
        t["lost"] += 1
        limit = max(cfg.confirm, 2) if t["state"] == "tentative" else cfg.max_lost
        if t["lost"] > limit:
            t["state"] = "ended"
            note(out, frame, t["key"], None, "ended", "ended")
        elif t["state"] != "tentative":
            t["state"] = "lost"

    def one_frame(live, frame, ids, classes, confs, boxes, out):
        match = (_optimal_pairs if cfg.optimal else _greedy_pairs)([t["box"] for t in live], boxes, [t["key"] for t in live], ids, cfg.iou_threshold)
        taken = set(match.values())
        free = [j for j in range(len(ids)) if j not in taken]
        for i, t in enumerate(live):
            j = match.get(i)
            if j is not None and t["cls"] == classes[j]:
                t.update(box=boxes[j].tolist(), lost=0, matched=t["matched"] + 1)
                if t["state"] == "lost" or (t["state"] == "tentative" and t["matched"] >= cfg.confirm):
                    t["state"] = "active"
                note(out, frame, t["key"], int(ids[j]), "hit", t["state"])
                continue
            miss(t, frame, out)
            if j is not None:
                free.append(j)
        live = [t for t in live if t["state"] != "ended"]
        for j in free:
            if confs[j] >= cfg.min_confidence:
                s = "active" if cfg.confirm <= 1 else "tentative"
                live.append({"key": int(ids[j]), "cls": classes[j], "box": boxes[j].tolist(), "state": s, "lost": 0, "matched": 1})
                note(out, frame, int(ids[j]), int(ids[j]), "opened", s)
        return live

    def step(state, rows, last):
        live = state or []
        out: list[dict] = []
        if len(rows):
            frames = rows["frame_number"].to_numpy()
            ids = rows["det_id"].to_numpy(dtype="float64")
            order = np.lexsort((ids, frames))
            frames, ids = frames[order], ids[order]
            classes = [str(c).lower() for c in rows["class_name"].to_numpy()[order]]
            confs = rows["confidence"].to_numpy()[order]
            boxes = rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype="float64")[order]
            cuts = np.flatnonzero(np.diff(frames)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(frames)]):
                hi = hi if not np.isnan(ids[lo]) else lo  # a frame without detections is one row of nulls
                live = one_frame(live, int(frames[lo]), ids[lo:hi], classes[lo:hi], confs[lo:hi], boxes[lo:hi], out)
        if last:
            for t in live:
                closed = t["state"] in ("lost", "tentative")
                note(out, None, t["key"], None, "closed" if closed else "open", "ended" if closed else t["state"])
        return live, out

    return step


def track_lifecycle(det: DataFrame, frames: DataFrame | None = None, cfg: TrackerConfig = TrackerConfig(), block: int = 5_000) -> DataFrame:
    """Hits, openings and endings of tracks; ``frames`` lists all frames, also those without detections."""
    ranks = frame_ranks(frames if frames is not None else det)
    d = ranks.join(det.select("video_id", "frame_number", "det_id", "class_name", "confidence", "x1", "y1", "x2", "y2"),
                   ["video_id", "frame_number"], "left")
    return _named_across_blocks(ordered_fold(d, ["video_id"], _block_step(cfg, block), BLOCK_OUT, seq="frame_rank", block=block))


BLOCK_OUT = T.StructType([*LIFECYCLE_OUT.fields, T.StructField("blk", T.LongType()), T.StructField("place", T.LongType())])
HANDED = 1 << 40


def _block_step(cfg: TrackerConfig, block: int):
    """``lifecycle_step`` with names of the block's own for tracks it takes over, so that its state forgets who opened them.

    A track taken over is named by its place in the state, and the block notes
    which track stands at which place of the state it hands on.
    """
    inner = lifecycle_step(cfg)

    def step(state, rows, last):
        live, out = inner([{**t, "key": i - HANDED} for i, t in enumerate(state or [])], rows, last)
        blk = int(rows["frame_rank"].iloc[0]) // block
        handed = [] if last else [{"action": "handed_on", "track_key": t["key"], "place": i} for i, t in enumerate(live)]
        kept = [{k: min(v, cfg.confirm) if k == "matched" else v for k, v in t.items() if k != "key"} for t in live]
        return kept, [{**r, "blk": blk} for r in [*out, *handed]]

    return step


def _named_across_blocks(rows: DataFrame) -> DataFrame:
    """The log with every track named by the detection that opened it, whichever block that was in."""
    rows = cut_lineage(rows)
    key = F.col("track_key")
    before = F.when(key < 0, F.concat_ws(":", F.col("blk") - 1, key + HANDED))
    nodes = rows.where("action = 'handed_on'").select("video_id", F.concat_ws(":", "blk", "place").alias("id"), "track_key", before.alias("_up"))
    roots = chain_roots(nodes.select("video_id", "id"), nodes.where("_up IS NOT NULL").select("video_id", F.col("_up").alias("a"), F.col("id").alias("b")))
    opened = nodes.where("_up IS NULL").select("video_id", F.col("id").alias("root"), F.col("track_key").alias("_opened"))
    named = roots.join(opened, ["video_id", "root"]).select("video_id", F.col("id").alias("_up"), "_opened")
    log = rows.where("action <> 'handed_on'").withColumn("_up", before).join(named, ["video_id", "_up"], "left")
    return log.withColumn("track_key", F.coalesce("_opened", "track_key")).select("video_id", *LIFECYCLE_OUT.names)


def lifecycle_tracks(life: DataFrame) -> DataFrame:
    """One row per track of the lifecycle log, numbered by first frame."""
    hit = F.col("action").isin("opened", "hit")
    t = life.groupBy("video_id", "track_key").agg(
        F.min(F.when(hit, F.col("frame_number"))).alias("first_frame"), F.max(F.when(hit, F.col("frame_number"))).alias("last_frame"),
        F.count(F.when(hit, 1)).alias("n_obs"),
        F.min(F.when(hit & (F.col("state") == "active"), F.col("frame_number"))).alias("confirmed_at_frame"),
        F.max(F.when(F.col("action").isin("ended", "closed", "open"), F.col("state"))).alias("final_state"))
    t = index_rows(t, ["video_id"], ["first_frame", "track_key"], F.floor(F.col("first_frame") / 4096).cast("long"), "track_id")
    return t.withColumn("track_id", F.col("track_id") + 1)
