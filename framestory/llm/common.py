"""Helpers shared by the text operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.plans.sequence import index_rows
from framestory.session import cut_lineage, work_folder

#: Size of the bit table that says which hashes may be wanted: 2 MB, whatever the input.
TABLE_BITS = 24


def text_rows(records: DataFrame, key: str, text: str) -> DataFrame:
    """``_id`` and ``_text`` alone (null text: empty), so that no other column can clash with internal ones."""
    return records.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns of two frames, for joins."""
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def ranked(df: DataFrame, order: list, name: str = "seq", parts: int | None = None) -> DataFrame:
    """``df`` with its 0-based place in a total ``order``; no task holds more than one range of it.

    The range partitions are written to the checkpoint folder first, so that a
    lost executor can't move rows between ranges that were already counted.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    return index_rows(ranged, [], order, F.col("_range"), name).drop("_range")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in a folder of its own beside the checkpoints, and the folder."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(df: DataFrame, path: str) -> None:
    """Deletes a folder of ``written`` once everything made from it is written itself."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def maybe_in(df: DataFrame, value: Column, wanted: DataFrame, wanted_value: Column) -> DataFrame:
    """Rows whose value may be among the wanted ones: none is lost, few others stay.

    Meant to be put before a join, so that rows without partner don't pass through
    its shuffle.  The bit table has a fixed size; with very many wanted values it
    fills up and lets everything pass.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << TABLE_BITS)) + 1

    bits = wanted.select(place(wanted_value).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    at = F.bitmap_bit_position(place(value))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.join(F.broadcast(bits), F.bitmap_bucket_number(place(value)) == F.col("_bucket"))
    return held.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).drop("_bucket", "_bits")
