"""Readers and writers for detections, frames, zones, ground truth, metrics, events and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestory.plans.sequence import index_rows
from framestory.session import cut_lineage

DETECTION_SCHEMA = (
    "video_id long, frame_number long, timestamp_ms double, model_name string, model_version string, inference_ms double, "
    "detections array<struct<class_id:int,class_name:string,confidence:double,bbox_x1:double,bbox_y1:double,bbox_x2:double,bbox_y2:double>>")
FRAME_SCHEMA = ("video_id long, frame_number long, timestamp_ms double, frame_path string, brightness double, motion_fraction double, blur_score double, "
                "luma_hist array<long>, color_hist array<double>, pixel_diff double")
ZONE_SCHEMA = "video_id long, zone_id string, name string, zone_type string, polygon array<array<double>>"
TRUTH_SCHEMA = ("video_id string, events array<struct<event_id:string,type:string,start:double,end:double,entities:array<string>>>, "
                "narrative_chains array<array<string>>, irrelevant_events array<string>")
METRIC_SCHEMA = "job_id long, stage string, status string, duration_ms long, metrics map<string,string>, warnings array<string>, errors array<string>"
ZONE_TYPES = ["restricted", "entry", "exit", "safe", "monitor"]


def read_detections(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested per-frame detections, one row per detection; frames without any give none."""
    d = spark.read.schema(DETECTION_SCHEMA).format(fmt).load(path)
    d = d.select("video_id", "frame_number", "timestamp_ms", "model_name", "model_version", "inference_ms", F.posexplode("detections").alias("det_no", "_d"))
    return d.select("video_id", "frame_number", "timestamp_ms", "det_no", "_d.class_id", "_d.class_name", "_d.confidence", F.col("_d.bbox_x1").alias("x1"),
                    F.col("_d.bbox_y1").alias("y1"), F.col("_d.bbox_x2").alias("x2"), F.col("_d.bbox_y2").alias("y2"), "model_name", "model_version", "inference_ms")


def read_frame_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).format(fmt).load(path)


def frame_number_from_path(df: DataFrame, col: str = "frame_path", frame_skip: int = 5, fps: float = 25.0, duration_ms: Column | None = None) -> DataFrame:
    """Source frame number and time from names like ``frame_00000042.jpg``.

    When the last number of a video exceeds its number of files the names are
    source indices; otherwise they count extracted frames from 1.  A name without
    such a number counts by its place.  Files are ordered by folder, number and path.
    """
    n = F.expr(f"try_cast(regexp_extract({col}, '(?:^|/)frame_([0-9]+)[^/]*$', 1) AS BIGINT)")
    d = df.withColumns({"_n": n, "_folder": F.regexp_extract(col, r"^(.*/)?[^/]*$", 1)})
    place = F.coalesce("_n", F.lit(-1))
    d = index_rows(d, ["video_id"], ["_folder", place, col], F.struct("_folder", F.floor(place / 4096).alias("_part")), "_i")
    d = d.withColumn("_n", F.coalesce("_n", "_i")).drop("_folder")
    last = d.groupBy("video_id").agg(F.max_by("_n", "_i").alias("_last"), F.count(F.lit(1)).alias("_files"))
    source = F.col("_last") > F.col("_files")
    number = F.when(source, F.col("_n")).otherwise(F.when(F.col("_n") >= 1, (F.col("_n") - 1) * frame_skip).otherwise(F.col("_i") * frame_skip))
    d = d.join(last, "video_id").withColumn("frame_number", number)
    t = F.col("frame_number") * 1000.0 / max(fps, 1.0)
    if duration_ms is not None:
        t = F.when(duration_ms > 0, F.least(t, duration_ms)).otherwise(t)
    return d.withColumn("timestamp_ms", t).drop("_n", "_i", "_last", "_files")


def read_zones(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Polygons with at least three corners; unknown types become ``monitor``, missing names the id."""
    z = spark.read.schema(ZONE_SCHEMA).option("multiLine", multi_line).json(path).where(F.size("polygon") >= 3)
    kind = F.lower("zone_type")
    return z.select("video_id", "zone_id", F.coalesce("name", "zone_id").alias("zone_name"), F.when(kind.isin(*ZONE_TYPES), kind).otherwise("monitor").alias("zone_type"),
                    F.transform("polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("polygon"))


def read_ground_truth(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, chain members) of nested ground-truth files, one document a file or one a line."""
    t = spark.read.schema(TRUTH_SCHEMA).option("multiLine", multi_line).json(path)
    events = t.select("video_id", "irrelevant_events", F.explode("events").alias("_e")).select(
        "video_id", "_e.event_id", F.col("_e.type").alias("event_type"), F.col("_e.start").alias("start_s"), F.col("_e.end").alias("end_s"), "_e.entities",
        F.coalesce(F.array_contains("irrelevant_events", F.col("_e.event_id")), F.lit(False)).alias("is_irrelevant"))
    chains = (t.select("video_id", F.posexplode("narrative_chains").alias("chain_id", "_c"))
              .select("video_id", "chain_id", F.posexplode("_c").alias("position", "event_id")))
    return events, chains


def write_stage_metrics(df: DataFrame, path: str) -> None:
    """One folder per stage with JSON rows of all jobs."""
    df.write.mode("overwrite").partitionBy("stage").json(path)


def read_stage_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def write_events(df: DataFrame, path: str) -> None:
    """Replace the events of the videos present in ``df``, leaving other videos alone.

    Each video's rows go to as many files as its size asks for.
    """
    df.hint("rebalance", F.col("video_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def reprocess_video(df: DataFrame, path: str, video_id) -> None:
    """Delete one video's events and write those of ``df``, if any."""
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, f"video_id={video_id}")
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    write_events(df.where(F.col("video_id") == video_id), path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("video_id", F.col("video_id").cast("long"))


#: Folders of a manifest's section; videos are dealt to them by hash.
MANIFEST_PARTS = 32


def export_manifest(path: str, summary: DataFrame, validation: DataFrame, decisions: DataFrame, clips: DataFrame) -> None:
    """Manifest as JSON lines, each section in a fixed number of folders that its videos are dealt to.

    The lists of a manifest grow with the video, so each entry is a line of its
    own instead of an element of one document; a folder or file for each video
    would make the number of files grow with the videos.  A second export
    replaces the sections of the videos it holds: the lines of other videos in
    the same folders are written again with it.
    """
    spark, part = summary.sparkSession, F.pmod(F.xxhash64(F.col("video_id").cast("string")), F.lit(MANIFEST_PARTS)).cast("int")
    for name, d in (("summary", summary), ("validation", validation), ("decisions", decisions), ("clips", clips)):
        lines = d.select(F.lit(name).alias("section"), part.alias("part"), F.col("video_id").cast("string").alias("_video"), F.to_json(F.struct(*d.columns)).alias("value"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"section={name}")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            lines = cut_lineage(lines)
            held = lines.select(F.col("part").alias("_p"), F.col("_video").alias("_v")).distinct()
            touched = [r[0] for r in held.select("_p").distinct().collect()]  # MANIFEST_PARTS numbers at most
            there = spark.read.schema("value string, section string, part int").text(path).where((F.col("section") == name) & F.col("part").isin(touched))
            there = there.withColumn("_video", F.get_json_object("value", "$.video_id"))
            lines = lines.unionByName(there.join(held, F.col("_video").eqNullSafe(F.col("_v")), "left_anti"))
        (lines.drop("_video").hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "none").partitionBy("section", "part").text(path))


CLIP_SCHEMA = ("video_id long, clip_index long, event_id string, event_type string, track_id long, start_ms double, end_ms double, confidence double")


def events_from_manifest(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Event rows rebuilt from the clips of a manifest, ours or one nested document per video."""
    if nested:
        doc = spark.read.schema(f"video_id long, clips array<struct<{CLIP_SCHEMA.split(', ', 1)[1].replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
        c = doc.select("video_id", F.explode("clips").alias("_c")).select("video_id", "_c.*")
    else:
        c = spark.read.schema(CLIP_SCHEMA + ", section string").json(path).where(F.col("section") == "clips").drop("section")
    return c.select("video_id", "event_id", "event_type", "track_id", "start_ms", "end_ms", F.coalesce("confidence", F.lit(0.82)).alias("confidence"),
                    F.col("event_type").alias("rule_name"), F.concat(F.lit("Verified event: "), F.replace("event_type", F.lit("_"), F.lit(" "))).alias("description"),
                    F.when(F.pmod(F.coalesce("track_id", F.lit(0)), F.lit(2)) == 0, "left").otherwise("right").alias("direction"),
                    F.when(F.col("track_id") > 0, F.concat(F.lit("Person "), F.col("track_id").cast("string"))).alias("person_label"))


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Structs become ``a.b`` columns and arrays ``;``-joined strings."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        elif kind == "array":
            cols.append(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ";").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def export_evaluation_csv(df: DataFrame, path: str) -> None:
    flatten_for_csv(df).write.mode("overwrite").option("header", True).csv(path)


def export_evaluation_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
