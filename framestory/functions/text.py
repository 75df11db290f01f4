"""Display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def mm_ss(ms: Column) -> Column:
    total = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("long"), F.pmod(total, F.lit(60)))


def mm_ss_tenths(ms: Column) -> Column:
    return F.format_string("%02d:%04.1f", F.floor(ms / 60000).cast("long"), F.pmod(ms, F.lit(60000.0)) / 1000)


def mm_ss_millis(ms: Column) -> Column:
    whole = F.floor(ms).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(whole / 60000).cast("long"),
                           F.floor(F.pmod(whole, F.lit(60000)) / 1000).cast("long"), F.pmod(whole, F.lit(1000)))


def hh_mm_ss(seconds: Column) -> Column:
    t = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("long"),
                           F.floor(F.pmod(t, F.lit(3600)) / 60).cast("long"), F.pmod(t, F.lit(60)))
