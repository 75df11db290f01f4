"""Line dedup of logs: segment-partition edit join with length-aware substring indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import same, text_rows
from framestory.llm.graph import components
from framestory.session import cut_lineage

#: One edit, so a line has two segments.  In a line of fewer characters one edit is another word or number, not another
#: spelling, so shorter lines link where they are equal.
EDITS, MIN_CHARS = 1, 10
SHORT_LIST = 64
UID = ["_h1", "_h2"]


def log_lines(logs: DataFrame, key: str = "job_id", text: str = "log") -> DataFrame:
    """``(_id, _t, line_no, _line)`` for every line of every whole text, from 0.

    ``_t`` is a hash of the text: rows that share a key are told by it.
    """
    return text_rows(logs, key, text).select("_id", F.xxhash64("_text").alias("_t"), F.posexplode(F.split("_text", "\n", -1)).alias("line_no", "_line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """Adds the line's length, its 128-bit hash and its index and probe keys.

    A line of length n is indexed by its two halves under n.  A line that is one
    longer than another shares the shorter one's first half at the same place,
    or its second half one place later: these are the probes under n - 1.
    """
    d = lines.withColumn("_len", F.length("_line"))
    part = lambda side, n, start, size: F.expr(f"xxhash64({side}, {n}, substring(_line, {start}, {size}))")
    return d.withColumns({
        "_h1": F.xxhash64("_line"), "_h2": F.xxhash64("_line", F.lit(1)),
        "_i1": part(1, "_len", "1", "_len DIV 2"), "_i2": part(2, "_len", "_len DIV 2 + 1", "_len"),
        "_p1": part(1, "_len - 1", "1", "(_len - 1) DIV 2"), "_p2": part(2, "_len - 1", "(_len - 1) DIV 2 + 2", "_len")})


def _lists(rows: DataFrame) -> DataFrame:
    """Posting rows whose list can hold a pair, with its numbers of indexed lines and probes."""
    n = rows.groupBy("list").agg(F.sum(1 - F.col("probe")).alias("_ni"), F.sum("probe").alias("_np")).where("_ni >= 1 AND _ni + _np >= 2")
    return rows.join(n, "list")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of lines on short lists: indexed with indexed (same length) and with probes (one longer)."""
    member = F.struct("probe", *UID, "first")
    lists = rows.groupBy("list").agg(F.sort_array(F.collect_list(member)).alias("m"))
    pair = lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return lists.select(F.explode(F.flatten(F.transform(F.filter("m", lambda a: a["probe"] == 0), pair))).alias("p")).select("p.*")


def _texts(logs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``(first, _line)`` for the wanted places; only texts that hold one are cut into lines."""
    at = wanted.select("first").distinct().groupBy(F.col("first._id").alias("_w"), F.col("first._t").alias("_wt")).agg(F.collect_list("first.line_no").alias("_at"))
    d = text_rows(logs, key, text).withColumn("_t", F.xxhash64("_text"))
    held = d.join(at, same(d, at, [("_id", "_w")]) & (F.col("_t") == F.col("_wt"))).select("_id", "_t", "_at", F.split("_text", "\n", -1).alias("_lines"))
    picked = held.select("_id", "_t", "_lines", F.explode("_at").alias("line_no")).select(
        F.struct("_id", "_t", "line_no").alias("first"), F.get("_lines", F.col("line_no")).alias("_line"))
    return picked.where("_line IS NOT NULL").dropDuplicates(["first"])


def _next_level(t: DataFrame) -> DataFrame:
    """Long lists cut finer: half of what isn't matched yet must match too.

    ``lo`` to ``hi`` is the open part of an indexed line; a probe's is one longer.
    A last open character matches a probe's at either place.
    """
    one = F.col("hi") - F.col("lo") == 1
    mid = F.when(one, F.col("hi")).otherwise(F.expr("lo + (hi - lo) DIV 2"))
    t = t.withColumn("_mid", mid)
    left = F.expr("struct(1 AS side, substring(_line, lo + 1, _mid - lo) AS seg, _mid AS lo, hi AS hi)")
    right = F.when(one, F.expr("struct(2 AS side, substring(_line, lo + probe + 1, 1) AS seg, lo AS lo, lo AS hi)")).otherwise(
        F.expr("struct(2 AS side, substring(_line, _mid + probe + 1, hi - _mid) AS seg, lo AS lo, _mid AS hi)"))
    t = t.select("list", "probe", *UID, "first", "_line", F.explode(F.array(left, right)).alias("c"))
    return t.select(F.xxhash64("list", "c.side", "c.seg").alias("list"), "probe", *UID, "first", "_line", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"))


def _uid(prefix: str = ""):
    return F.concat(F.hex(F.col(f"{prefix}_h1")), F.lit("-"), F.hex(F.col(f"{prefix}_h2")))


def line_links(logs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """Links ``(a, b)`` between distinct lines one edit apart, enough to connect all that are.

    Lists of up to 64 lines give pairs, verified by a banded edit distance.  A
    longer list is cut by halves of what its lines don't share yet, level by
    level, until it is short or its lines differ in one character at one place:
    then each is linked to one, as all are one edit apart.  So a list of m lines
    gives at most 64 m pairs and no pair is lost.
    """
    half = F.col("_len").cast("int")
    row = lambda k, probe, lo, hi: F.struct(F.col(k).alias("list"), F.lit(probe).alias("probe"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    m = half - 1
    cut, cut1 = F.expr("_len DIV 2"), F.expr("(_len - 1) DIV 2")
    zero = F.lit(0)
    rows = distinct.select(*UID, "first", F.explode(F.array(
        row("_i1", 0, cut, half), row("_i2", 0, zero, cut), row("_p1", 1, cut1, m), row("_p2", 1, zero, cut1))).alias("r")).select("r.*", *UID, "first")
    lists = cut_lineage(_lists(rows))
    pairs = _pairs(lists.where(F.col("_ni") + F.col("_np") <= SHORT_LIST))
    long = lists.where(F.col("_ni") + F.col("_np") > SHORT_LIST).drop("_ni", "_np")
    known = None
    if not long.isEmpty():
        lines = _texts(logs, long, key, text)
        long = cut_lineage(long.join(lines, "first"))
        while not long.isEmpty():
            alike = long.where("probe = 0 AND hi - lo <= 1")
            star = alike.join(alike.groupBy("list").agg(F.min(F.struct(*UID)).alias("_m")), "list").select(_uid().alias("a"), _uid("_m.").alias("b"))
            nxt = cut_lineage(_lists(_next_level(long.where("hi > lo"))))
            done = nxt.where("hi = lo AND probe = 1").select("list", _uid().alias("a")).join(
                nxt.where("hi = lo AND probe = 0").groupBy("list").agg(F.min(F.struct(*UID)).alias("_m")), "list").select("a", _uid("_m.").alias("b"))
            links = cut_lineage(star.unionByName(done).where("a <> b").distinct())
            known = links if known is None else known.unionByName(links)
            short = nxt.where((F.col("_ni") + F.col("_np") <= SHORT_LIST) & (F.col("hi") > F.col("lo")))
            pairs = pairs.unionByName(_pairs(short))
            long = cut_lineage(nxt.where((F.col("_ni") + F.col("_np") > SHORT_LIST) & (F.col("hi") > F.col("lo"))).drop("_ni", "_np"))
    pairs = cut_lineage(pairs.distinct())
    ends = pairs.select(F.col("a.first").alias("first")).unionByName(pairs.select(F.col("b.first").alias("first")))
    lines = _texts(logs, ends, key, text) if not pairs.isEmpty() else None
    if lines is not None:
        x, y = lines.withColumnRenamed("_line", "_x"), lines.withColumnRenamed("_line", "_y")
        x, y = x.withColumnRenamed("first", "_fx"), y.withColumnRenamed("first", "_fy")
        p = pairs.withColumns({"_fa": F.col("a.first"), "_fb": F.col("b.first")})
        p = p.join(x, F.col("_fa") == F.col("_fx")).join(y, F.col("_fb") == F.col("_fy"))
        good = p.where(F.levenshtein("_x", "_y", EDITS) >= 0).select(_uid("a.").alias("a"), _uid("b.").alias("b"))
        known = good if known is None else known.unionByName(good)
    empty = logs.sparkSession.createDataFrame([], "a string, b string")
    return empty if known is None else known


def _line_places(logs: DataFrame, key: str = "job_id", text: str = "log", min_chars: int = MIN_CHARS) -> DataFrame:
    """``line_classes`` with ``_fs_text``, the hash of the row's text."""
    lines = _hashed(log_lines(logs, key, text))
    some = lines.where("_len > 0")
    once = ["_len", "_i1", "_i2", "_p1", "_p2"]
    distinct = cut_lineage(some.groupBy(*UID).agg(
        F.min(F.struct("_id", "_t", "line_no")).alias("first"), F.count(F.lit(1)).alias("_places"), *[F.first(c).alias(c) for c in once]))
    roots = components(line_links(logs, distinct.where(F.col("_len") >= min_chars), key, text))
    d = distinct.withColumn("_u", _uid())
    named = cut_lineage(d.join(roots, d["_u"] == roots["node"]).select(*UID, "first", "root"))
    heads = named.groupBy("root").agg(F.min("first").alias("_head"))
    linked = named.join(heads, "root").select(F.col("_h1").alias("_n1"), F.col("_h2").alias("_n2"), "_head")
    classes = distinct.where("_places > 1").select(*UID, "first").join(linked, (F.col("_h1") == F.col("_n1")) & (F.col("_h2") == F.col("_n2")), "left").select(
        F.col("_h1").alias("_c1"), F.col("_h2").alias("_c2"), F.coalesce("_head", "first").alias("_class"))
    single = linked.join(distinct.where("_places = 1").select(*UID), (F.col("_h1") == F.col("_n1")) & (F.col("_h2") == F.col("_n2"))).select(
        F.col("_n1").alias("_c1"), F.col("_n2").alias("_c2"), F.col("_head").alias("_class"))
    classes = classes.unionByName(single)
    o = lines.select("_id", "_t", "line_no", "_len", *UID)
    o = o.join(classes, (F.col("_h1") == F.col("_c1")) & (F.col("_h2") == F.col("_c2")) & (F.col("_len") > 0), "left")
    own = F.struct("_id", "_t", "line_no")
    return o.withColumn("_class", F.coalesce("_class", own)).select(
        F.col("_id").alias(key), F.col("_t").alias("_fs_text"), "line_no", F.col("_len").alias("n_chars"), F.col("_class._id").alias("class_key"),
        F.col("_class.line_no").alias("class_line"), F.col("_class").eqNullSafe(own).alias("kept"))


def line_classes(logs: DataFrame, key: str = "job_id", text: str = "log", min_chars: int = MIN_CHARS) -> DataFrame:
    """Classes of equal and nearly equal log lines; one row per line.

    Lines are linked where one edit (a character inserted, deleted or replaced)
    or none makes them equal; a class is what links connect.  Returns ``key``,
    ``line_no`` (from 0), ``n_chars``, ``class_key`` and ``class_line`` (the
    class's first place by key, text's hash and line) and ``kept``, true at that place.

    Null text is empty, and an empty text is one empty line.  Lines of fewer than
    ``min_chars`` characters are linked only where they are equal; empty lines
    are always kept and are classes of their own.  Null
    keys come first and are kept as keys; rows with one key and different
    texts have places of their own, equal rows stand at the same place and are kept
    or dropped together; other columns don't pass; an empty table gives an empty
    result.
    """
    return _line_places(logs, key, text, min_chars).drop("_fs_text")


def dedup_lines(logs: DataFrame, key: str = "job_id", text: str = "log", min_chars: int = MIN_CHARS) -> DataFrame:
    """``logs`` with every line removed that has an equal or nearly equal one at an earlier place.

    All columns stay; ``text`` is joined again from the lines kept.  A record
    whose every line stands elsewhere is a copy and goes; one whose text was null or
    empty stays as it is.
    """
    dropped = (_line_places(logs, key, text, min_chars).where("NOT kept").groupBy(F.col(key).alias("_fs_key"), "_fs_text")
               .agg(F.collect_set("line_no").alias("_fs_drop")))
    here = F.xxhash64(F.coalesce(logs[text].cast("string"), F.lit("")))
    d = logs.join(dropped, logs[key].eqNullSafe(dropped["_fs_key"]) & (here == dropped["_fs_text"]), "left")
    d = d.withColumn("_fs_lines", F.when(F.col("_fs_drop").isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_fs_lines") - 1), "_fs_drop")
    d = d.withColumn("_fs_keep", F.when(F.col("_fs_drop").isNotNull(), kept)).where("_fs_keep IS NULL OR size(_fs_keep) > 0")
    d = d.withColumn(text, F.when(F.col("_fs_keep").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform("_fs_keep", lambda i: F.get("_fs_lines", i)), "\n")))
    return d.select(*logs.columns)
