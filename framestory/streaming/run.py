"""Bounded runs of streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.session import cut_lineage, work_folder


#: Idle time and watermark delay of replayed streams, longer than any video, so that no row is late; the end mark lies three times as far behind the last row.
IDLE_MS = 30 * 86_400_000


def timed(df: DataFrame, column: str = "timestamp_ms") -> DataFrame:
    """``df`` with ``event_time``, its milliseconds as a timestamp, a day on: a stream takes time 0 as passed before it begins."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(column).cast("long") + 86_400_000))


#: A piece holds about so many rows of the key that has most.
KEY_ROWS = 250_000


def replay(df: DataFrame, column: str, keys: Sequence[str], parts: int = 3, ends: bool = False, behind: DataFrame | None = None) -> DataFrame:
    """A stream of ``df`` in ``parts`` pieces or more along ``column``, each dealt to files by ``keys``.

    With ``ends`` one row of nulls follows for one of the keys, whose ``event_time`` lies so far behind that the watermark it moves closes every key; the stream has that watermark.
    ``behind`` holds rows that arrive after all others, in a later micro-batch.

    The pieces hold about equally many rows, and there are so many of them that
    no key has much more than ``KEY_ROWS`` rows in one, whatever the size of
    ``df``.  A key's rows of one piece are in one file and the pieces' files come
    one piece after the other, so every key sees its rows in order wherever a
    micro-batch ends; one takes as many files as a piece has on average, and they
    are read in parallel.
    """
    spark = df.sparkSession
    path = work_folder(spark, "replay")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = cut_lineage(df)
    pieces = _written_pieces(df, column, keys, parts, path, n)
    per_trigger = max(1, -(-len(spark.read.schema(df.schema).parquet(path).inputFiles()) // pieces)) if pieces else n

    def mark(end):
        row = df.agg(F.min(F.struct(*keys)).alias("_key"), end.alias("event_time")).where("_key IS NOT NULL").select("_key.*", "event_time")
        row.select(*[F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]).coalesce(1).write.mode("append").parquet(path)

    if behind is not None:
        for _ in range(per_trigger):  # no micro-batch reaches over so many files
            mark(F.lit(None).cast("timestamp"))
        _written_pieces(cut_lineage(behind.select(*df.columns)), column, keys, parts, path, n)
    if ends:
        mark(F.timestamp_millis(F.unix_millis(F.max("event_time")) + 3 * IDLE_MS))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withWatermark("event_time", f"{IDLE_MS} milliseconds") if ends else stream


def _written_pieces(df: DataFrame, column: str, keys: Sequence[str], parts: int, path: str, n: int) -> int:
    """Writes ``df`` to ``path`` piece after piece and returns their number; rows are put into pieces once, then each piece is read alone."""
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(parts, -(-most // KEY_ROWS))
    cuts = sorted(set(df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)])).first()[0] or []))
    piece = F.lit(0)
    for c in cuts:
        piece = piece + F.coalesce((F.col(column) >= c).cast("int"), F.lit(0))
    staged = work_folder(df.sparkSession, "pieces")
    df.withColumn("_piece", piece).repartition(n, *keys).write.partitionBy("_piece").parquet(staged)
    there = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_piece", T.IntegerType())])).parquet(staged)
    found = sorted(r[0] for r in there.select("_piece").distinct().collect())
    for i in found:
        there.where(F.col("_piece") == i).drop("_piece").repartition(n, *keys).write.mode("append").parquet(path)
    return len(found)


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream over one table of a folder of parquet files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into files and return them as a table."""
    spark = stream.sparkSession
    path, ckpt = work_folder(spark, "stream-out"), work_folder(spark, "stream-ckpt")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
