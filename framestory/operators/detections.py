"""Per-detection operators: geometry, tiles, suppression, thresholds, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory import fixed
from framestory.functions import geometry as g
from framestory.session import cut_lineage


def bbox_geometry(df: DataFrame) -> DataFrame:
    return (df.withColumn("cx", g.cx()).withColumn("cy", g.cy()).withColumn("w", g.width()).withColumn("h", g.height())
            .withColumn("area", g.area()).withColumn("aspect", F.when(g.height() > 0, g.width() / g.height())))


def normalise_boxes(df: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Pixel boxes (any value above 1.5) become fractions of the frame."""
    pixel = F.greatest("x1", "y1", "x2", "y2") > 1.5
    for c, size in (("x1", frame_w), ("y1", frame_h), ("x2", frame_w), ("y2", frame_h)):
        df = df.withColumn("_" + c, F.when(pixel, F.col(c) / max(size, 1)).otherwise(F.col(c)))
    for c in ("x1", "y1", "x2", "y2"):
        df = df.withColumn(c, F.col("_" + c)).drop("_" + c)
    return df


def expand_roi(df: DataFrame, frame_w: int, frame_h: int, scale: float = 1.5) -> DataFrame:
    """Normalised box grown on all sides, clamped to the frame, in whole pixels."""
    px1, py1, px2, py2 = (F.col(c) * size for c, size in (("x1", frame_w), ("y1", frame_h), ("x2", frame_w), ("y2", frame_h)))
    pad_x = F.greatest(px2 - px1, F.lit(1.0)) * (scale - 1.0) / 2.0
    pad_y = F.greatest(py2 - py1, F.lit(1.0)) * (scale - 1.0) / 2.0
    return (df.withColumn("rx1", F.greatest((px1 - pad_x).cast("int"), F.lit(0))).withColumn("ry1", F.greatest((py1 - pad_y).cast("int"), F.lit(0)))
            .withColumn("rx2", F.least((px2 + pad_x).cast("int"), F.lit(frame_w))).withColumn("ry2", F.least((py2 + pad_y).cast("int"), F.lit(frame_h))))


def tile_grid(videos: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """Overlapping tiles per frame size, row by row until one reaches the edge; edge tiles are cut to the frame."""
    stride = max(1, int(tile * (1 - overlap)))

    def starts(size: Column) -> Column:
        return F.sequence(F.lit(0), F.ceil(F.greatest(size - tile, F.lit(0)) / stride).cast("int") * stride, F.lit(stride))

    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    return (videos.select("video_id", w.alias("width"), h.alias("height"))
            .withColumn("ty", F.explode(starts(F.col("height")))).withColumn("tx", F.explode(starts(F.col("width"))))
            .withColumn("tx2", F.least(F.col("tx") + tile, F.col("width")))
            .withColumn("ty2", F.least(F.col("ty") + tile, F.col("height"))))


def tile_to_frame(det: DataFrame) -> DataFrame:
    """Boxes relative to a tile (tx, ty, tx2, ty2 in pixels) become frame-relative."""
    tw, th = F.col("tx2") - F.col("tx"), F.col("ty2") - F.col("ty")
    return (det.withColumn("fx1", (F.col("x1") * tw + F.col("tx")) / F.col("width"))
            .withColumn("fy1", (F.col("y1") * th + F.col("ty")) / F.col("height"))
            .withColumn("fx2", (F.col("x2") * tw + F.col("tx")) / F.col("width"))
            .withColumn("fy2", (F.col("y2") * th + F.col("ty")) / F.col("height")))


def nms_by_class(det: DataFrame, threshold: float = 0.5, key: list[str] | None = None, cell: float = 0.25) -> DataFrame:
    """Greedy suppression per frame and class, as rounds of joins.

    Boxes meet only in the grid cells they touch, and only pairs above the
    threshold are kept, so the work follows the number of real conflicts.  In
    each round a box with no better undecided rival is kept and its rivals are
    dropped; the result is the sequential greedy one.
    """
    key = key or ["video_id", "frame_number", "class_name"]
    cols = det.columns
    ids = det.select(*key, "det_id", "confidence", "x1", "y1", "x2", "y2")

    def cells(p: str) -> DataFrame:
        def span(lo, hi):
            return F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.greatest(F.col(lo), F.col(hi)) / cell).cast("int"))
        d = ids.withColumn("_gx", F.explode(span("x1", "x2"))).withColumn("_gy", F.explode(span("y1", "y2")))
        return g.prefixed(d, p, key)

    a, b = cells("a_"), cells("b_")
    home = ((F.col("a__gx") == F.greatest(F.floor(F.col("a_x1") / cell), F.floor(F.col("b_x1") / cell)))
            & (F.col("a__gy") == F.greatest(F.floor(F.col("a_y1") / cell), F.floor(F.col("b_y1") / cell))))
    better = ((F.col("a_confidence") > F.col("b_confidence"))
              | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_det_id") < F.col("b_det_id"))))
    rivals = (a.join(b, key).where((F.col("a__gx") == F.col("b__gx")) & (F.col("a__gy") == F.col("b__gy")) & home & better
                                   & (g.iou("a_", "b_") > threshold))
              .select(*key, F.col("a_det_id").alias("winner"), F.col("b_det_id").alias("loser")))
    rivals = cut_lineage(rivals)
    dropped = None
    while True:
        beaten = rivals.select(*key, F.col("loser").alias("det_id")).distinct()
        free = rivals.select(*key, F.col("winner").alias("det_id")).distinct().join(beaten, [*key, "det_id"], "left_anti")
        lose = (rivals.join(free.withColumnRenamed("det_id", "winner"), [*key, "winner"], "left_semi")
                .select(*key, F.col("loser").alias("det_id")).distinct())
        lose = cut_lineage(lose)
        if lose.isEmpty():
            break
        dropped = lose if dropped is None else dropped.unionByName(lose)
        rivals = cut_lineage(
            rivals.join(lose.withColumnRenamed("det_id", "winner"), [*key, "winner"], "left_anti")
            .join(lose.withColumnRenamed("det_id", "loser"), [*key, "loser"], "left_anti"))
    if dropped is None:
        return det
    return det.join(dropped, [*key, "det_id"], "left_anti").select(*cols)


def class_threshold(cls: Column) -> Column:
    """Threshold by name with blanks for underscores, then by raw name, then the default."""
    spaced = fixed.lookup(F.replace(F.lower(cls), F.lit("_"), F.lit(" ")), fixed.CLASS_CONFIDENCE, None)
    return F.coalesce(spaced, fixed.lookup(F.lower(cls), fixed.CLASS_CONFIDENCE, fixed.CLASS_CONFIDENCE_DEFAULT))


def per_class_confidence(det: DataFrame) -> DataFrame:
    return det.where(F.col("confidence") >= class_threshold(F.col("class_name")))


def detection_summary(det: DataFrame) -> DataFrame:
    """Counts and rates per video and class, with a total row per video (class ``*``)."""
    frames = det.groupBy("video_id").agg(F.count_distinct("frame_number").alias("video_frames"))
    per = det.groupBy("video_id", "class_name").agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("frame_number").alias("frames_with"),
        F.avg("confidence").alias("mean_confidence"))
    total = det.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("frame_number").alias("frames_with"),
        F.avg("confidence").alias("mean_confidence")).withColumn("class_name", F.lit("*"))
    return (per.unionByName(total).join(frames, "video_id")
            .withColumn("rate", F.col("frames_with") / F.col("video_frames")))


def category_of(cls: Column, class_id: Column | None = None) -> Column:
    """Display category: the class number's, if given and known, else by exact name, by the first keyword list with a hit, or ``object``."""
    if class_id is not None:
        known = F.lit(None).cast("string")
        for cat, ids in fixed.CLASS_ID_CATEGORY.items():
            known = F.when(class_id.isin(*ids), cat).otherwise(known)
        return F.coalesce(known, category_of(cls))
    key = F.trim(F.lower(cls))
    exact = None
    for cat, names in fixed.CATEGORY_MEMBERS.items():
        exact = F.when(key.isin(*names), cat) if exact is None else exact.when(key.isin(*names), cat)
    for cat, words in fixed.CATEGORY_KEYWORDS:
        hit = None
        for w in words:
            hit = key.contains(w) if hit is None else hit | key.contains(w)
        exact = exact.when(hit, cat)
    return exact.otherwise("object")
