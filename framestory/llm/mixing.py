"""Mixing domains to target weights by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestory.llm.common import ranked, same
from framestory.plans.sequence import index_rows, running_sum
from framestory.session import cut_lineage

SHARE, REPEAT, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
BLOCK = 256
SLOT_BITS = 10
#: Fixed value: floor(2^32 / golden ratio), odd, so that multiples of it visit all points.
GOLDEN = 2654435769
POINTS = 1 << 32


def domain_targets(sizes: DataFrame, share: float = SHARE, repeat: float = REPEAT, weights=WEIGHTS) -> DataFrame:
    """Targets per domain, from ``(domain, size)`` with one row per domain.

    Domains in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; no target is above ``repeat`` times its domain's
    size, and what is cut off is shared again by weight until none is above.
    """
    s = ranked(sizes.withColumn("_null", F.col("domain").isNull()), ["_null", "domain"], "place")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int"))
    s = cut_lineage(s.select("domain", "size", "place", w.alias("weight"), (F.col("size") * repeat).alias("cap")))
    total, weight = s.agg(F.coalesce(F.sum("size"), F.lit(0)) * share, F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = (total / weight if weight else 0.0), -1
    while True:
        n, spent, gone = s.where(F.col("cap") < F.col("weight") * level).agg(
            F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == capped or weight - gone <= 0:
            break
        level, capped = (total - spent) / (weight - gone), n
    return s.withColumn("target", F.least("cap", F.col("weight") * level))


def golden_point(i: Column) -> Column:
    """``i * GOLDEN mod 2^32``, in two halves so that no product leaves the long range."""
    low, high = i.bitwiseAND(65535), F.shiftright(i, 16).bitwiseAND(65535)
    return F.pmod(low * F.lit(GOLDEN) + high * F.lit((GOLDEN << 16) % POINTS), F.lit(POINTS))


def domain_schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: ``(slot, domain, pass, block, frames)``, to be read in the order of ``slot``.

    Slot ``i`` maps the golden-ratio point ``i * GOLDEN mod 2^32`` through the
    domains' cumulative shares of slots (points and shares meet in cells of the
    unit interval, so this is an equi-join); its rank among the domain's slots
    says which pass and block of the shuffled domain it takes.  A domain needs a
    known number of slots: those that the points give beyond it are void, those
    they leave out come at the end, and the last one is cut, so each domain gives
    its target to less than a frame.
    """
    spark = targets.sparkSession
    goal, blocks = F.floor("target").cast("long"), F.ceil(F.col("size") / block).cast("long")
    t = targets.where("size > 0 AND target >= 1").select("domain", "size", goal.alias("goal"), blocks.alias("blocks"), F.col("domain").isNull().alias("_null"))
    t = t.withColumn("need", F.expr(f"goal DIV size * blocks + (goal % size + {block - 1}) DIV {block}"))
    t = cut_lineage(running_sum(ranked(t, ["_null", "domain"], "place"), [], F.col("need"), "to", "place"))
    n, slots = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("need"), F.lit(0))).first()
    cells = 1 << max(4, (4 * n).bit_length())
    scale, width = POINTS / max(slots, 1), POINTS // cells
    edges = t.withColumns({"_lo": (F.col("to") - F.col("need")) * scale, "_hi": F.col("to") * scale})
    edges = edges.withColumn("_cell", F.explode(F.sequence(
        F.least(F.lit(cells - 1), F.floor(F.col("_lo") / width)).cast("long"), F.least(F.lit(cells - 1), F.floor(F.col("_hi") / width)).cast("long"))))
    points = spark.range(slots).withColumn("_u", golden_point(F.col("id")))
    facts = ["place", "domain", "size", "goal", "blocks", "need"]
    drawn = points.withColumn("_cell", F.floor(F.col("_u") / width).cast("long")).join(edges, "_cell").where("_u >= _lo AND _u < _hi")
    drawn = cut_lineage(drawn.select(F.col("id").alias("slot"), *facts))
    rank = index_rows(drawn, ["place"], ["slot"], F.floor(F.col("slot") / 65536).cast("long"), "rank")
    lacking = t.join(drawn.groupBy("place").agg(F.count(F.lit(1)).alias("_drawn")), "place", "left")
    lacking = lacking.withColumn("_drawn", F.coalesce("_drawn", F.lit(0))).where("_drawn < need").withColumn(
        "rank", F.explode(F.sequence("_drawn", F.col("need") - 1))).withColumn("slot", F.lit(slots) + F.col("rank"))
    got = rank.select("slot", *facts, "rank").unionByName(lacking.select("slot", *facts, "rank")).where("rank < need")
    got = got.withColumns({"pass": F.expr("rank DIV blocks"), "block": F.expr("rank % blocks")})
    frames = F.least(F.lit(block), F.col("size") - F.col("block") * block, F.col("goal") - F.col("pass") * F.col("size") - F.col("block") * block)
    return got.select("slot", "domain", "pass", "block", frames.cast("long").alias("frames"))


def domain_streams(videos: DataFrame, key: str, domain: str, frames: str, seed: int = 0, **how) -> DataFrame:
    """Rows ``(_id, domain, size, domain_size, target, _from)``: each in its domain's shuffled stream.

    The order is by hash of the key.  Streams are summed over slots of the hash,
    so a domain with a third of all rows is no single group; the domain's own
    figures travel on the table of slots for the same reason.
    """
    size = F.greatest(F.coalesce(F.col(frames), F.lit(0)), F.lit(0)).cast("long")
    d = videos.select(F.col(key).alias("_id"), F.col(domain).alias("domain"), size.alias("size"))
    d = d.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit(seed)))
    d = cut_lineage(d.withColumn("_slot", F.shiftrightunsigned("_h", 64 - SLOT_BITS).cast("int")))
    slots = cut_lineage(d.groupBy("domain", "_slot").agg(F.sum("size").alias("_n")))
    t = domain_targets(slots.groupBy("domain").agg(F.sum("_n").alias("size")), **how).select(
        F.col("domain").alias("_td"), F.col("size").alias("domain_size"), "target")
    before = Window.partitionBy("domain").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    slots = slots.join(t, slots["domain"].eqNullSafe(t["_td"])).select(F.col("domain").alias("_d"), F.col("_slot").alias("_s"), "_off", "domain_size", "target")
    here = Window.partitionBy("domain", "_slot").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("_to", F.sum("size").over(here))
    placed = placed.join(slots, same(placed, slots, [("domain", "_d"), ("_slot", "_s")]))
    return placed.select("_id", "domain", "size", "domain_size", "target", (F.col("_off") + F.col("_to") - F.col("size")).alias("_from"))


def mix_domains(videos: DataFrame, key: str = "video_id", domain: str = "source_domain", frames: str = "frame_count", share: float = SHARE,
                repeat: float = REPEAT, weights=WEIGHTS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """A training mix of video records by source domain; one row per record.

    Each domain is a stream of its records in a seeded shuffled order, cut into
    blocks of ``block`` frames; ``domain_schedule`` says which blocks the mix
    takes and how often, and a record gets the frames that its part of the taken
    blocks holds.  Returns ``key``, ``source_domain``, ``size``, ``domain_size``,
    ``target`` (of the domain, real), ``taken`` (frames, repeats counted) and
    ``passes`` (array: the frames taken in each pass).  Reruns agree.

    Null domain is a domain of its own, the last; null or negative sizes count 0
    and take 0; null keys and repeated rows are kept, a row each; other columns
    don't pass; an empty table gives an empty result.
    """
    placed = cut_lineage(domain_streams(videos, key, domain, frames, seed, share=share, repeat=repeat, weights=weights))
    sized = placed.groupBy("domain").agg(F.first("domain_size").alias("size"), F.first("target").alias("target"))
    plan = domain_schedule(cut_lineage(sized), block)

    parts = placed.where("size > 0").withColumn("_b", F.explode(F.sequence(
        F.expr(f"_from DIV {block}"), F.expr(f"(_from + size - 1) DIV {block}"))))
    parts = parts.withColumns({"_lo": F.greatest(F.col("_from") - F.col("_b") * block, F.lit(0)),
                               "_hi": F.least(F.col("_from") + F.col("size") - F.col("_b") * block, F.lit(block))})
    uses = plan.groupBy(F.col("domain").alias("_d"), F.col("block").alias("_pb")).agg(
        F.map_from_entries(F.collect_list(F.struct("pass", "frames"))).alias("_uses"))
    got = parts.join(uses, same(parts, uses, [("domain", "_d"), ("_b", "_pb")]), "left")
    turns = max(1, -int(-repeat // 1))
    part = lambda p: F.greatest(F.least(F.col("_hi"), F.coalesce(F.try_element_at("_uses", F.lit(p).cast("long")), F.lit(0))) - F.col("_lo"), F.lit(0))
    own = ["_id", "domain", "size", "domain_size", "target"]
    taken = got.groupBy(*own, "_from").agg(F.array(*[F.sum(part(p)).cast("long") for p in range(turns)]).alias("passes"))
    none = placed.where("size = 0").withColumn("passes", F.array(*[F.lit(0).cast("long")] * turns))
    out = taken.select(*own, "passes").unionByName(none.select(*own, "passes"))
    return out.select(F.col("_id").alias(key), F.col("domain").alias("source_domain"), "size", "domain_size", "target",
                      F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "passes")
