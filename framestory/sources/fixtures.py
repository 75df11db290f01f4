"""Views that give the supplied tables the shapes the operators expect."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestory.plans.sequence import index_rows
from framestory.session import cut_lineage

SEMANTIC_TYPE = ("CASE event_type WHEN 'signup' THEN 'person_entered_scene' WHEN 'error' THEN 'person_left_scene' "
                 "WHEN 'click' THEN 'person_walking' WHEN 'purchase' THEN 'person_running' ELSE 'person_standing' END")
HOUR_MICROS = 3_600_000_000


class Inputs:
    """Lazy access to the tables of one scale-factor folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several later steps read: computed once and written to the checkpoint folder."""
        if name not in self._stages:
            self._stages[name] = cut_lineage(build())
        return self._stages[name]

    @cached_property
    def observations(self) -> DataFrame:
        """One row per track hit; ``seq`` is the row's position in its track."""
        ev = self.table("events").select("event_id", "user_id", "ts", "props")
        o = index_rows(ev, ["user_id"], ["ts", "event_id"],
                       F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR_MICROS).cast("long"))
        o = o.withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)")).withColumnRenamed("seq", "n")
        return o.selectExpr(
            "CAST(FLOOR(user_id / 15.0) AS BIGINT) AS video_id", "user_id AS track_id", "event_id AS obs_id", "n AS seq",
            "5 * (n + user_id % 7) AS frame_number", "5 * (n + user_id % 7) * 40.0E0 AS timestamp_ms",
            "CASE user_id % 6 WHEN 0 THEN 'car' WHEN 1 THEN 'backpack' WHEN 2 THEN 'bottle' ELSE 'person' END AS class_name",
            "(500 + (event_id * 7919) % 500) / 1000.0E0 AS confidence",
            "(100 + ((user_id * 137) % 800 + n * (user_id % 4) * 6 + event_id % 3) % 800 - 30 - user_id % 20) / 1000.0E0 AS x1",
            "(200 + ((user_id * 71) % 500 + n * (user_id % 3) * 4) % 500 - 75 - k % 10) / 1000.0E0 AS y1",
            "(100 + ((user_id * 137) % 800 + n * (user_id % 4) * 6 + event_id % 3) % 800 + 30 + user_id % 20) / 1000.0E0 AS x2",
            "(200 + ((user_id * 71) % 500 + n * (user_id % 3) * 4) % 500 + 75 + k % 10) / 1000.0E0 AS y2")

    @cached_property
    def semantic_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "CAST(FLOOR(user_id / 15.0) AS BIGINT) AS video_id", "user_id * 100 + EXTRACT(DAY FROM ts) AS track_id",
            "event_id", f"{SEMANTIC_TYPE} AS event_type",
            "(EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60) * 1000.0E0 AS start_ms",
            "(EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60) * 1000.0E0 + value * 1000.0E0 AS end_ms",
            "(400 + (event_id * 31) % 600) / 1000.0E0 AS confidence")

    @cached_property
    def frames(self) -> DataFrame:
        """Per-frame features; every 11th brightness is unreadable."""
        return self.table("orders").selectExpr(
            "o_custkey % 10 AS video_id", "o_orderkey AS frame_number", "o_orderkey * 40.0E0 AS timestamp_ms",
            "CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE 60.0E0 + 120.0E0 * (CAST(FLOOR(o_orderkey / 400.0) AS BIGINT) % 2) "
            "+ o_orderkey % 7 END AS brightness",
            "(o_orderkey * 37 % 997) / 10000.0E0 AS motion_fraction", "(o_custkey % 300) * 1.0E0 AS blur_score",
            "(o_orderkey * 13 % 256) AS peak_bin",
            "CASE WHEN o_orderkey % 97 = 5 THEN 0.95E0 WHEN o_orderkey % 5 = 0 THEN 0.01E0 "
            "ELSE (o_orderkey * 53 % 300) / 1000.0E0 END AS pixel_diff")

    @cached_property
    def frame_sequence(self) -> DataFrame:
        """``frames`` with ``seq``, the position of the frame in its video."""
        return index_rows(self.frames, ["video_id"], ["frame_number"], F.floor(F.col("frame_number") / 4096).cast("long"))

    @cached_property
    def frame_histograms(self) -> DataFrame:
        """``frame_sequence`` with a 256-bin luma and a 48-bin colour histogram."""
        return self.frame_sequence.withColumns({
            "luma_hist": F.expr("transform(sequence(0, 255), i -> greatest(0, 40 - abs(i - peak_bin)) + (i + frame_number) % 3)"),
            "color_hist": F.expr("transform(sequence(0, 47), i -> 1.0E0 * (greatest(0, 10 - abs(i - peak_bin % 48)) + (i * (frame_number % 7 + 1)) % 3))")})

    @cached_property
    def track_embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "CAST(label AS BIGINT) AS true_person", "vec_id % 4 AS video_id", "vec_id AS track_id", "embedding",
            "vec_id * 200.0E0 AS start_ms", "vec_id * 200.0E0 + (vec_id % 17) * 100.0E0 AS end_ms",
            "vec_id % 9 + 1 AS observation_count")

    @cached_property
    def zones(self) -> DataFrame:
        """Four polygons, one of them concave; a fixed dimension."""
        rows = [
            ("z_rect", "Lobby", "restricted", [(0.1, 0.2), (0.5, 0.2), (0.5, 0.6), (0.1, 0.6)]),
            ("z_tri", "Gate", "entry", [(0.5, 0.3), (0.95, 0.3), (0.7, 0.8)]),
            ("z_conc", "Dock", "exit", [(0.2, 0.2), (0.8, 0.2), (0.8, 0.7), (0.5, 0.4), (0.2, 0.7)]),
            ("z_safe", "Hall", "safe", [(0.0, 0.5), (1.0, 0.5), (1.0, 0.9), (0.0, 0.9)])]
        return self.spark.createDataFrame(
            rows, "zone_id string, zone_name string, zone_type string, polygon array<struct<x:double,y:double>>")

    @cached_property
    def stage_runs(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS job_id", "l_linenumber AS stage_no", "l_partkey AS video_id",
            "concat('s', lpad(CAST(l_linenumber AS STRING), 2, '0')) AS stage",
            "CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'running' END AS status",
            "CAST(l_extendedprice AS BIGINT) AS duration_ms", "CAST(l_quantity AS BIGINT) AS frames",
            "l_shipdate AS created_at", "l_discount AS ratio")

    @cached_property
    def videos(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS video_id",
            "concat('cam', CAST(p_partkey AS STRING), CASE p_size % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.AVI' WHEN 2 THEN '.mkv' ELSE '.mp4' END) AS filename",
            "CASE WHEN p_partkey % 101 = 7 THEN 0 WHEN p_partkey % 103 = 9 THEN 60000000000 ELSE p_partkey * 1000 + 1 END AS size_bytes",
            "CASE p_size % 5 WHEN 0 THEN 'H264' WHEN 1 THEN 'theora' ELSE 'vp9' END AS codec",
            "CASE WHEN p_partkey % 89 = 3 THEN 0.0E0 ELSE (p_partkey * 7919 % 9000000) / 100.0E0 END AS duration_seconds",
            "CASE WHEN p_size % 23 = 0 THEN 32 ELSE 640 END AS width", "CASE WHEN p_size % 29 = 0 THEN 48 ELSE 480 END AS height",
            "CASE WHEN p_size % 19 = 0 THEN 0.0E0 WHEN p_size % 17 = 0 THEN 480.0E0 ELSE 25.0E0 END AS fps",
            "CASE WHEN p_size % 13 = 0 THEN CAST(7 AS BIGINT) END AS frame_skip_setting")

    @cached_property
    def truth_events(self) -> DataFrame:
        """A true event for every one; that of every fifth lies far behind it, so both sides have events without partner."""
        apart = "CASE WHEN event_id % 5 = 0 THEN 90000000.0E0 ELSE 1000.0E0 END"
        return self.semantic_events.selectExpr("video_id", "event_id AS truth_id", "event_type", f"start_ms + {apart} AS truth_start", f"end_ms + {apart} AS truth_end")
