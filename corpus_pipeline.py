"""From raw documents to packed training sequences: five stages, each one operator of ``framestory.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framestory.llm import lines, mixing, overlap, packing, tokens, toxicity
from framestory.llm.common import removed, written
from framestory.llm.queries import CATEGORIES, WORD, toxicity_labels

#: Near duplicates share four fifths of their five-word shingles or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
SEQUENCE = 2048


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    labels = toxicity_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    chain = toxicity.fit_chain(docs, labels, CATEGORIES, "doc_id", "text")
    return toxicity.without_toxic(docs, chain, "toxic", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, equal or nearly so, at an earlier place; ``n_chars`` follows the text."""
    out = lines.dedup_lines(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates; documents without id stay."""
    near = overlap.near_texts(docs, "doc_id", "text", NEAR_WORDS, NEAR_PERCENT)
    gone = near.where("_id <> component").select(F.col("_id").alias("_fs_gone"), F.col("_t1").alias("_fs_g1"), F.col("_t2").alias("_fs_g2")).distinct()
    whole = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (docs["doc_id"] == gone["_fs_gone"]) & (F.xxhash64(whole) == gone["_fs_g1"]) & (F.xxhash64(whole, F.lit(1)) == gone["_fs_g2"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each pass that takes at least half of their words.

    Every row is a record of its own in the mix: rows are told apart by id, source
    and text, equal ones by their number, whatever ids are missing or repeated.
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = {"_fs_i": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_fs_z": F.col("doc_id").isNull(), "_fs_t1": F.xxhash64(whole), "_fs_t2": F.xxhash64(whole, F.lit(1)),
           "_fs_s": F.coalesce(F.col("source"), F.lit("")), "_fs_y": F.col("source").isNull()}
    equal = Window.partitionBy(*row).orderBy("_fs_t1")
    sizes = docs.select("source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[c.alias(k) for k, c in row.items()])
    sizes = sizes.withColumn("row", F.struct(*row, F.row_number().over(equal).alias("_fs_no")))
    mix = mixing.mix_domains(sizes, "row", "source", "size")
    turns = F.size(F.filter("passes", lambda n: (n > 0) & (2 * n >= F.col("size"))))
    taken = mix.select("row.*", turns.alias("_fs_turns")).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("_fs_no", "_fs_turns"))).alias("_fs_all"))
    d = docs.withColumns(row).join(taken, [*row])
    d = d.withColumn("_fs_no", F.row_number().over(equal))
    return d.withColumn("_fs_turn", F.explode(F.array_repeat(F.lit(1), F.get("_fs_all", F.col("_fs_no") - 1)["_fs_turns"]))).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into training sequences."""
    import public_tokenizers

    pieces = tokens.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, "doc_id", "text")
    return packing.pack_clips(pieces, "length", SEQUENCE).withColumnRenamed("reel_id", "sequence_id")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("mix_sources", mix_stage),
          ("best_fit_packing", pack_stage)]

#: The classifier, the hashes and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again by the next one, then deleted."""
    sf_dir = sf_dir.rstrip("/")
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made, at = written(stage(spark, docs, sf_dir), name)
        if folder:
            removed(docs, folder)
        docs, folder = made, at
    return docs
