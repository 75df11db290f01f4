"""Fingerprints of briefs: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestory.llm.common import ranked, text_rows
from framestory.plans.sequence import over_blocks
from framestory.session import cut_lineage

#: A paragraph longer than this is several leaves, so an edit inside it is located too.
LEAF_CHARS = 64


def brief_tree(text: Column) -> Column:
    """The text's tree as an array (sections) of structs (hash, array of paragraphs (hash, leaves)).

    Sections are parted by an empty line, paragraphs by line ends; a further empty
    line is a section or paragraph without text, so texts of one tree are equal.
    A leaf is a paragraph or a piece of at most ``LEAF_CHARS`` code points of it.
    """
    leaf = lambda p: F.sha2(p, 256)
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit("(?s).{1,%d}" % LEAF_CHARS), F.lit(0)), leaf)
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), pieces))


def _hash(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}root`` (hex) and ``{prefix}parts``: leaf hashes by section and paragraph."""
    df = df.withColumn(f"{prefix}parts", brief_tree(F.col(text)))
    sections = F.transform(f"{prefix}parts", lambda s: _hash(F.transform(s, _hash)))
    return df.withColumn(f"{prefix}root", _hash(sections))


def leaf_marks(parts: Column) -> Column:
    """The distinct leaves of a tree as 64-bit numbers, an eighth of their hashes' length."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(parts)), lambda h: F.xxhash64(h)))


def likeness(a_root: Column, a_marks: Column, b_root: Column, b_marks: Column) -> Column:
    """1 if the roots agree, else twice the shared distinct leaves over both trees' distinct leaves."""
    both = F.size(a_marks) + F.size(b_marks)
    shared = 2 * F.size(F.array_intersect(a_marks, b_marks)) / F.greatest(both, F.lit(1))
    return F.when(a_root == b_root, F.lit(1.0)).otherwise(F.least(shared, F.lit(1.0)))


def first_difference(a_parts: Column, b_parts: Column) -> Column:
    """(section, paragraph), from 0, of the first paragraph whose branch differs; null if none does."""
    branch = lambda parts: F.transform(parts, lambda s: F.transform(s, _hash))
    position = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u != v, F.lit(True))), True)
    section = position(branch(a_parts), branch(b_parts)).cast("int")
    inside = position(F.coalesce(F.get(branch(a_parts), section - 1), F.array().cast("array<string>")),
                      F.coalesce(F.get(branch(b_parts), section - 1), F.array().cast("array<string>"))).cast("int")
    return F.when(section > 0, F.struct((section - 1).alias("section"), (inside - 1).alias("paragraph")))


def neighbours(briefs: DataFrame) -> DataFrame:
    """``(_id, _h, _prev_id, _prev_h, _prev_n)``: each brief's predecessor by id; the first one's is the last.

    Only ids, hashes and lengths are ordered, in ranges; no text moves here.
    """
    order = [F.col("_id").asc_nulls_first(), F.col("_h")]
    seq = ranked(briefs.select("_id", "_h", "_n").distinct(), order)
    near = over_blocks(seq, [], lambda w: {"_prev": F.lag(F.struct("_id", "_h", "_n")).over(w)}, back=1)
    near = cut_lineage(near)
    last = near.orderBy(F.col("seq").desc()).limit(1).select(F.struct("_id", "_h", "_n").alias("_end"))
    first = near.where("seq = 0").join(last.withColumn("_zero", F.lit(0)), F.col("seq") == F.col("_zero")).withColumn("_prev", F.col("_end"))
    cols = ["_id", "_h", "_prev"]
    return near.where("seq > 0").select(*cols).unionByName(first.select(*cols)).select(
        "_id", "_h", F.col("_prev._id").alias("_prev_id"), F.col("_prev._h").alias("_prev_h"), F.col("_prev._n").alias("_prev_n"))


def fingerprint_briefs(briefs: DataFrame, key: str = "video_id", text: str = "brief") -> DataFrame:
    """Merkle fingerprints of whole briefs, and how they tell an edit from another brief.

    The edited brief has its last quarter (code points, rounded down) replaced
    by as many of the first ones of the next brief by ``key``, or all it has; the
    last brief's next is the first.  Returns ``key``, ``n_chars``,
    ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (roots, hex),
    ``near_edited`` and ``near_next`` (likeness of the trees, 0 to 1) and
    ``edited_at`` (section and paragraph of the first branch that differs).

    Null text is empty.  A null key comes first.  Rows that repeat key and text
    are one brief and come back once; one key with several texts is several
    briefs, ordered by hash.  A single brief is its own next.  Other columns
    don't pass; an empty table gives an empty result.
    """
    d = text_rows(briefs, key, text).withColumn("_h", F.xxhash64("_text"))
    links = neighbours(d.withColumn("_n", F.length("_text")))
    name = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_i"), F.col(c).isNull().alias("_z")]
    own = ["_i", "_z", "_h"]  # never null, so one exchange of the texts serves the window and both joins
    d = d.select("*", *name("_id"))
    d = d.withColumn("_again", F.lag(F.lit(1)).over(Window.partitionBy(*own).orderBy("_id"))).where("_again IS NULL").drop("_again")
    m = links.select(*name("_id"), "_h", *[c.alias(a) for c, a in zip(name("_prev_id"), ("_pi", "_pz"))], "_prev_h", "_prev_n")
    nxt = d.join(m, own).select(F.col("_pi").alias("_i"), F.col("_pz").alias("_z"), F.col("_prev_h").alias("_h"), "_text",
                                F.expr("substring(_text, 1, _prev_n DIV 4)").alias("_head"))
    nxt = with_tree(nxt, "_text", "next_").select(*own, "_head", "next_root", leaf_marks(F.col("next_parts")).alias("next_marks"))
    both = d.join(nxt, own).withColumn("_n", F.length("_text"))
    both = both.withColumn("_edited", F.expr("concat(substring(_text, 1, _n - _n DIV 4), _head)"))
    both = with_tree(with_tree(both, "_text", "own_"), "_edited", "new_")
    both = both.withColumns({"own_marks": leaf_marks(F.col("own_parts")), "new_marks": leaf_marks(F.col("new_parts"))})
    own_tree, new_tree, next_tree = [(F.col(f"{p}_root"), F.col(f"{p}_marks")) for p in ("own", "new", "next")]
    return both.select(
        F.col("_id").alias(key), F.col("_n").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"), F.col("new_root").alias("edited_fingerprint"),
        likeness(*own_tree, *new_tree).alias("near_edited"), likeness(*own_tree, *next_tree).alias("near_next"),
        first_difference(F.col("own_parts"), F.col("new_parts")).alias("edited_at"))
