"""Re-identification: matching tracks to persons by embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.plans.fold import ordered_fold
from framestory.plans.sequence import first_n, index_rows
from framestory.session import cut_lineage


#: Persons of a block, tracks of a batch, pivots of a video and the persons they are chosen from, blocks of a summary row; they set the cost, not the result.
BLOCK_PERSONS, BATCH_TRACKS, PIVOTS, PIVOT_SAMPLE, PART_BLOCKS, CHUNK = 256, 256, 128, 2_048, 1_024, 4_096
SPACE = ["video_id", "dims"]
ROUNDING = 1e-9


def _rows(packed: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(packed, np.float64).reshape(-1, dims)


def _packed(vectors) -> bytes:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors]).tobytes()


def _spread_out(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the vectors, each the one at the widest angle to those before it."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _dealt(d: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``d`` with ``_sub``: rows of a key dealt by hash to as many groups as keep them at about ``size`` rows."""
    n = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_groups"))
    return d.join(n, keys).withColumn("_sub", F.pmod(F.xxhash64("id"), "_groups")).drop("_groups")


def _gathered(d: DataFrame, pivots: DataFrame, size: int) -> DataFrame:
    """Vectors ``(video_id, dims, id, v)`` in groups of neighbours: ids, matrix, and the group's middle vector, widest angle to it and largest length."""
    kind = d.schema["id"].dataType.simpleString()

    def chunked(key, rows):
        return pd.DataFrame({"video_id": [key[0]], "dims": [key[1]], "ids": [rows["id"].tolist()], "m": [_packed(rows["v"])]})

    def placed(frames):
        for pdf in frames:
            for video, dims, ids, m, p in zip(pdf["video_id"], pdf["dims"], pdf["ids"], pdf["m"], pdf["pivots"]):
                x = _rows(m, dims)
                near = (x @ _rows(p, dims).T).argmax(axis=1)
                yield pd.DataFrame({"video_id": video, "dims": dims, "near": near, "id": list(ids), "v": list(x)})

    def grouped(key, rows):
        x = np.array([np.asarray(v) for v in rows["v"]])
        length = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(length, 1e-300)[:, None]
        mid = int((unit @ unit.mean(axis=0)).argmax())
        wide = float(np.arccos(np.clip((unit @ unit[mid])[length > 0], -1, 1)).max(initial=0.0)) if length[mid] > 0 else np.pi
        return pd.DataFrame({"video_id": [key[0]], "dims": [key[1]], "ids": [rows["id"].tolist()], "m": [x.tobytes()], "mid": [x[mid].tobytes()], "wide": [wide], "length": [float(length.max())]})

    chunks = _dealt(d, SPACE, CHUNK).groupBy(*SPACE, "_sub").applyInPandas(chunked, f"video_id long, dims int, ids array<{kind}>, m binary")
    near = chunks.join(pivots, SPACE).mapInPandas(placed, f"video_id long, dims int, near long, id {kind}, v array<double>")
    near = _dealt(cut_lineage(near), [*SPACE, "near"], size)
    groups = near.groupBy(*SPACE, "near", "_sub").applyInPandas(grouped, f"video_id long, dims int, ids array<{kind}>, m binary, mid binary, wide double, length double")
    return cut_lineage(groups.withColumn("group", F.monotonically_increasing_id()))


def gallery_visits(tracks: DataFrame, gallery: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches of tracks, blocks of persons, and the pairs ``(batch, block)`` that may hold a best match.

    A block's persons lie within an angle of its middle one, so a track's
    similarity to them is bounded by its own angle to the middle person less that.
    The similarity to the middle persons is reached for certain; a block counts
    only where its bound reaches the best of those, and the threshold.
    """
    vectors = lambda d, key: d.where("embedding IS NOT NULL AND size(embedding) > 0").select(
        F.col("video_id").cast("long").alias("video_id"), F.size("embedding").alias("dims"), F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    people = vectors(gallery, "person_label")
    few = first_n(people, SPACE, [F.xxhash64("id"), "id"], PIVOT_SAMPLE, "_n")

    def chosen(key, rows):
        x = _spread_out(np.array([np.asarray(v) for v in rows.sort_values("_n")["v"]]), PIVOTS)
        return pd.DataFrame({"video_id": [key[0]], "dims": [key[1]], "pivots": [x.tobytes()]})

    pivots = few.groupBy(*SPACE).applyInPandas(chosen, "video_id long, dims int, pivots binary")
    pivots = cut_lineage(pivots)
    blocks, batches = _gathered(people, pivots, BLOCK_PERSONS), _gathered(vectors(tracks, "track_id"), pivots, BATCH_TRACKS)

    def summed(key, rows):
        return pd.DataFrame({"video_id": [key[0]], "dims": [key[1]], "groups": [rows["group"].tolist()], "mids": [b"".join(rows["mid"])],
                             "wides": [rows["wide"].tolist()], "lengths": [rows["length"].tolist()]})

    parts = _dealt(blocks.select(*SPACE, F.col("group").alias("id"), "group", "mid", "wide", "length"), SPACE, PART_BLOCKS).groupBy(*SPACE, "_sub").applyInPandas(
        summed, "video_id long, dims int, groups array<long>, mids binary, wides array<double>, lengths array<double>")

    def bounded(frames):
        for pdf in frames:
            for dims, batch, m, groups, mids, wides, lengths in zip(*(pdf[c] for c in ("dims", "group", "m", "groups", "mids", "wides", "lengths"))):
                x, y, wide, far = _rows(m, dims), _rows(mids, dims), np.asarray(wides), np.asarray(lengths)
                sure = x @ y.T
                own, mid = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(y, axis=1)[None, :]
                angle = np.arccos(np.clip(sure / np.maximum(own * mid, 1e-300), -1, 1))
                bound = own * far * np.cos(np.clip(angle - wide, 0, np.pi)) + ROUNDING * (1 + own * far)
                hit = (bound >= np.maximum(threshold, sure.max(axis=1))[:, None]).any(axis=0)
                yield pd.DataFrame({"batch": batch, "block": np.asarray(groups)[hit]})

    pairs = batches.select(*SPACE, "group", "m").join(parts, SPACE).mapInPandas(bounded, "batch long, block long")
    return batches, blocks, cut_lineage(pairs)


def gallery_matches(tracks: DataFrame, gallery: DataFrame, threshold: float = 0.52) -> DataFrame:
    """Best gallery person of each track with similarity at least the threshold; the first label wins ties.

    An exact search that leaves out what can't matter: tracks in batches and
    persons in blocks of neighbours meet only where bounds allow (``gallery_visits``).
    Tracks meet the persons of their own video and of their own number of dimensions.
    """
    batches, blocks, pairs = gallery_visits(tracks, gallery, threshold)

    def best(frames):
        for pdf in frames:
            for video, dims, ids, m, labels, g in zip(*(pdf[c] for c in ("video_id", "dims", "ids", "m", "labels", "g"))):
                x, y = _rows(m, dims), _rows(g, dims)
                s = x @ y.T
                top = np.maximum(s.max(axis=1), threshold)
                i, j = np.nonzero(s >= top[:, None] - ROUNDING * (1 + np.abs(top[:, None])))
                exact = [float(np.cumsum(x[a] * y[b])[-1]) for a, b in zip(i, j)]
                yield pd.DataFrame({"video_id": video, "track_id": np.asarray(ids)[i], "person_label": np.asarray(labels, dtype=object)[j], "similarity": exact})

    met = pairs.join(batches.select(*SPACE, F.col("group").alias("batch"), "ids", "m"), "batch").join(
        blocks.select(F.col("group").alias("block"), F.col("ids").alias("labels"), F.col("m").alias("g")), "block")
    kind = tracks.schema["track_id"].dataType.simpleString()
    found = met.mapInPandas(best, f"video_id long, track_id {kind}, person_label string, similarity double")
    best = found.where((F.col("similarity") > 0) & (F.col("similarity") >= threshold)).groupBy("video_id", "track_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("n"), "person_label")).alias("_b"))
    return best.select("video_id", "track_id", F.col("_b.person_label").alias("person_label"), (-F.col("_b.n")).alias("similarity"))


ASSIGN_OUT = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("person_label", T.StringType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("is_new", T.BooleanType())])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-8)


def assign_step(threshold: float):
    """State: gallery as [number, unit mean, tracks] and the next number.

    A track without embedding takes the smallest label not in use.
    """
    def step(state, rows, last):
        gallery, plain, nxt = state or [[], [], 1]
        means = np.array([e[1] for e in gallery], dtype="float64")
        used, free = {e[0] for e in gallery} | set(plain), 1
        out = []
        for track, emb in zip(rows["track_id"], rows["embedding"]):
            if emb is None:
                while free in used:  # labels are never given back, so the smallest free one only grows
                    free += 1
                plain.append(free)
                used.add(free)
                out.append({"track_id": int(track), "person_label": f"Person {free}", "similarity": None, "is_new": True})
                continue
            v = np.asarray(emb, dtype="float64")
            best, sim = None, 0.0
            if len(gallery):
                near = means[:len(gallery)] @ v
                i = int(near.argmax())
                if near[i] > 0.0:
                    best, sim = i, float(near[i])
            if best is not None and sim >= threshold:
                n = gallery[best][2]
                means[best] = _unit((means[best] * n + v) / (n + 1))
                gallery[best][2] = n + 1
                label, new = gallery[best][0], False
            else:
                label, new = nxt, True
                nxt += 1
                gallery.append([label, None, 1])
                used.add(label)
                if len(gallery) > len(means):
                    means = np.vstack([means.reshape(-1, len(v)), np.zeros((max(64, len(means)), len(v)))])
                means[len(gallery) - 1] = v
            out.append({"track_id": int(track), "person_label": f"Person {label}", "similarity": sim, "is_new": new})
        for e, m in zip(gallery, means):
            e[1] = [float(x) for x in m]
        return [gallery, plain, nxt], out

    return step


def reid_assign(tracks: DataFrame, threshold: float = 0.52, block: int = 20_000) -> DataFrame:
    """Person labels in order of first appearance, with running-mean galleries per video.

    The assignment of a track depends on every earlier one of its video, so
    blocks of a video settle one after the other; each task holds one block and
    the gallery.
    """
    d = index_rows(tracks.select("video_id", "track_id", "start_ms", "embedding"), ["video_id"], ["start_ms", "track_id"],
                   F.floor(F.col("start_ms") / 600_000.0).cast("long"))
    return ordered_fold(d, ["video_id"], assign_step(threshold), ASSIGN_OUT, block=block)


MERGE_OUT = T.StructType([T.StructField("person_label", T.StringType()), T.StructField("merged_label", T.StringType())])


def consolidate_step(threshold: float):
    """Each person joins the first earlier leader similar enough; leaders carry weighted means.

    Going through the persons once with an ordered list of leaders gives the
    same merges as comparing leader by leader, because a leader is changed only
    by persons before the one compared.
    """
    def step(state, rows, last):
        leaders = [[n, np.asarray(m), w] for n, m, w in (state or [])]
        out = []
        for label, emb, w in zip(rows["person_label"], rows["embedding"], rows["track_count"]):
            v, w = np.asarray(emb, dtype="float64"), int(w)
            into = None
            for lead in leaders:
                if float(lead[1] @ v) >= threshold:
                    lead[1] = _unit((lead[1] * lead[2] + v * w) / (lead[2] + w))
                    lead[2] += w
                    into = lead[0]
                    break
            if into is None:
                leaders.append([label, v, w])
                into = label
            out.append({"person_label": label, "merged_label": into})
        return [[n, [float(x) for x in m], w] for n, m, w in leaders], out

    return step


def consolidate_gallery(persons: DataFrame, threshold: float = 0.72, block: int = 20_000) -> DataFrame:
    """Mapping from person label to the label it is merged into.

    ``persons`` has embedding, track_count and ``person_no``, the order of creation.
    """
    d = index_rows(persons.select("video_id", "person_no", "person_label", "embedding", "track_count"), ["video_id"], ["person_no"],
                   F.floor(F.col("person_no") / 4096).cast("long"))
    return ordered_fold(d, ["video_id"], consolidate_step(threshold), MERGE_OUT, block=block)


def person_gallery(tracks: DataFrame) -> DataFrame:
    """Per person: first and last seen, observations, tracks and where it came in.

    The track ids stay in the track table (label column), so no list grows with
    the person.
    """
    return tracks.groupBy("video_id", "person_label").agg(
        F.min("start_ms").alias("first_seen_ms"), F.max("end_ms").alias("last_seen_ms"),
        F.sum(F.greatest(F.col("observation_count"), F.lit(1))).alias("observation_count"), F.count(F.lit(1)).alias("track_count"),
        F.min_by("entry_direction", F.struct("start_ms", "track_id")).alias("entry_direction"))


def mean_gallery(tracks: DataFrame, label: str, dims: int) -> DataFrame:
    """Unit mean embedding per label, averaged element-wise by partial aggregation."""
    sums = tracks.groupBy("video_id", label).agg(
        F.count(F.lit(1)).alias("track_count"), F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(dims)]).alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, v: a + v * v)) + 1e-8
    return (sums.withColumn("_n", norm).withColumn("embedding", F.transform("_m", lambda v: v / F.col("_n")))
            .drop("_m", "_n"))
