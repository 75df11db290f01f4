"""Language of notes: n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import text_rows
from framestory.plans.sequence import first_n

MAX_PER_LANG, MAX_ROWS, LANDMARKS, RIDGE = 512, 4096, 128, 1e-2
#: Grams of one to three characters; each length has its own factors.
SPECTRUM = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2869860233))
HASH_BITS = 14
BATCH = 64
UNDETERMINED = "und"


def presence(text: str, out: np.ndarray) -> None:
    """Marks the hashed 1- to 3-grams that occur in the whole lower-cased text (white space runs are one blank)."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    for factors in SPECTRUM:
        if len(codes) >= len(factors):
            h = codes[:len(codes) - len(factors) + 1] * np.uint32(factors[0])
            for i, f in enumerate(factors[1:], 1):
                h = h ^ (codes[i:len(codes) - len(factors) + 1 + i] * np.uint32(f))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            out[h >> np.uint32(32 - HASH_BITS)] = 1


def _rows(texts) -> np.ndarray:
    x = np.zeros((len(texts), 1 << HASH_BITS), dtype=np.float32)
    for i, t in enumerate(texts):
        presence(t, x[i])
    norm = np.sqrt(x.sum(1, keepdims=True))
    return x / np.maximum(norm, 1)


@dataclass
class LanguageModel:
    """Landmark presence vectors (normalised), and the weights of kernel values per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def fit_language(notes: DataFrame, text: str = "notes", lang: str = "lang", key: str = "failure_id", max_per_lang: int = MAX_PER_LANG,
                 max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on a bounded sample: per language the first ``max_per_lang`` keys by hash, ``max_rows`` in all.

    The kernel of two texts is the number of n-grams present in both over the
    geometric mean of the numbers present.  Landmarks are taken in turn over
    the languages.  Rows without language or without any letter are left out; of
    several rows per key and language the one with the smallest text hash counts.
    """
    d = notes.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    d = d.where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).withColumns({"_h": F.xxhash64(F.col("_id").cast("string")), "_th": F.xxhash64("_text")})
    keys = d.groupBy("_lang", "_h", "_id").agg(F.min("_th").alias("_th"))
    few = first_n(keys, ["_lang"], ["_h", "_id"], max_per_lang, "_n").orderBy("_n", "_h").limit(max_rows)
    few = few.select(F.col("_lang").alias("_l"), F.col("_id").alias("_i"), F.col("_th").alias("_t"), "_n")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bits = []
            for t in pdf["_text"]:
                x = np.zeros(1 << HASH_BITS, np.uint8)
                presence(t, x)
                bits.append(np.packbits(x).tobytes())
            yield pd.DataFrame({"n": pdf["_n"], "lang": pdf["_lang"], "bits": bits})

    picked = d.join(F.broadcast(few), (d["_id"] == few["_i"]) & (d["_lang"] == few["_l"]) & (d["_th"] == few["_t"]))
    picked = picked.groupBy("_lang", "_id").agg(F.first("_n").alias("_n"), F.first("_text").alias("_text"))
    rows = sorted(picked.mapInPandas(packed, "n long, lang string, bits binary").collect())
    langs = sorted({r["lang"] for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((0, 1 << HASH_BITS), np.float32), np.zeros((0, 0), np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    marks = x[:landmarks]
    k = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(len(k)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = (x @ marks.T).astype(np.float64) @ root
    y = np.array([[1.0 if r["lang"] == c else -1.0 for c in langs] for r in rows])
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    return LanguageModel(langs, marks, (root @ w).astype(np.float32))


def note_languages(notes: DataFrame, model: LanguageModel, key: str = "failure_id", text: str = "notes") -> DataFrame:
    """Language of each note: ``key``, ``lang_pred``, ``score`` (0 to 1).

    Kernel values of a batch of texts with all landmarks are one matrix product,
    the languages' values another.  Only the text is used, and all of it.  A null
    text, one without any letter, or a model without languages gives ``und``,
    score 0.  Null keys and repeated rows are kept, a row each; other columns
    don't pass; an empty table gives an empty result.
    """
    d = text_rows(notes, key, text)
    kind = d.schema["_id"].dataType.simpleString()

    def run(frames):
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for pdf in frames:
            best, score = np.full(len(pdf), len(model.languages)), np.zeros(len(pdf))
            texts = pdf["_text"].to_numpy()
            told = [i for i, t in enumerate(texts) if model.languages and any(map(str.isalpha, t))]
            for a in range(0, len(told), BATCH):
                at = told[a:a + BATCH]
                value = (_rows(texts[at]) @ model.landmarks.T) @ model.weights
                best[at] = value.argmax(1)
                score[at] = np.clip((value.max(1) + 1) / 2, 0, 1)
            yield pd.DataFrame({"_id": pdf["_id"], "lang_pred": names[best], "score": score})

    return d.mapInPandas(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", key)
