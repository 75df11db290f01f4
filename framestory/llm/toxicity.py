"""Toxicity of notes: a chain of linear classifiers trained with out-of-fold probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.llm.common import strings
from framestory.session import cut_lineage

MAX_ROWS, MAX_WORDS, LEAST_TEXTS, FOLDS, PENALTY, THRESHOLD = 16_000, 256, 3, 5, 0.3, 0.35
NOT_WORD = r"[^\p{L}\p{N}]+"


def note_words(text: Column) -> Column:
    """Lower-case words (letters and digits) of a whole text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, -1), "")


def shape(words: Column, text: Column) -> list[Column]:
    """Features besides the words: log length, share of distinct words, share of other characters."""
    n = F.size(words)
    distinct = F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))
    chars = F.length(F.coalesce(text.cast("string"), F.lit("")))
    letters = F.length(F.array_join(words, ""))
    return [F.log1p(n.cast("double")) / 10, distinct, 1 - letters / F.greatest(chars, F.lit(1))]


@dataclass
class ToxicityChain:
    """A fitted chain: per category the intercept, the weights of shape features and earlier probabilities, and of words."""

    categories: list[str]
    words: list[str] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)
    shape: list[list[float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the intercept's."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * s) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(notes: DataFrame, labels: DataFrame, categories: list[str], key: str = "failure_id", text: str = "notes",
              max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> ToxicityChain:
    """Fits the chain on a bounded sample: the first ``max_rows`` labelled keys by hash.

    Labels are 0 or 1 per category; rows with a null among them are left out; of
    several rows per key the largest label counts, and of several texts the one
    with the smallest hash.  Words are chosen among those
    in three texts or more by how far their texts' labels are from the average.
    Later categories are trained with the earlier ones' out-of-fold
    probabilities over five folds by hash.  No usable labels: a chain that says 0.
    """
    clean = labels.select(F.col(key).alias("_id"), *[F.col(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)]).dropna()
    clean = clean.groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(categories))])
    sample = clean.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_rows)  # a bound of the fit, see above
    texts = notes.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = texts.join(F.broadcast(sample), F.col("_k") == F.col("_id"))
    rows = rows.groupBy("_id", *[f"_y{i}" for i in range(len(categories))]).agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))
    rows = cut_lineage(rows)  # max_rows rows at most
    rows = rows.select("_id", *[f"_y{i}" for i in range(len(categories))], note_words(F.col("_t")).alias("_w"), "_t")
    n_all = F.count(F.lit(1))
    totals = rows.agg(n_all.alias("n"), *[F.sum(f"_y{i}").alias(f"_y{i}") for i in range(len(categories))]).first()
    chain = ToxicityChain(list(categories))
    if not totals["n"]:
        return ToxicityChain(list(categories), [], [-30.0] * len(categories), [[0.0] * 3] * len(categories),
                             [[0.0] * i for i in range(len(categories))], [[]] * len(categories))
    seen = rows.select(F.explode(F.array_distinct("_w")).alias("w"), *[f"_y{i}" for i in range(len(categories))])
    counts = seen.groupBy("w").agg(n_all.alias("df"), *[F.sum(f"_y{i}").alias(f"_s{i}") for i in range(len(categories))]).where(F.col("df") >= LEAST_TEXTS)
    far = []
    for i in range(len(categories)):
        rate = (totals[f"_y{i}"] or 0) / totals["n"]
        spread = max(rate * (1 - rate), 1e-9)
        far.append(F.abs(F.col(f"_s{i}") - F.col("df") * rate) / F.sqrt(F.col("df") * spread + 1))
    chosen = counts.select("w", F.greatest(*far, F.lit(0.0)).alias("far")).orderBy(F.col("far").desc(), "w").limit(max_words)
    chain.words = [r["w"] for r in chosen.collect()]
    at = {w: i for i, w in enumerate(chain.words)}
    held = rows.select(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"),
                       *[f"_y{i}" for i in range(len(categories))], F.array(*shape(F.col("_w"), F.col("_t"))).alias("shape"),
                       F.array_intersect("_w", strings(chain.words)).alias("hit"), "_id").orderBy("_id")
    data = held.drop("_id").toArrow().combine_chunks()  # plain arrays; as Row objects they took the driver many times the memory
    x = np.zeros((len(data), len(at)))
    hits = data["hit"].combine_chunks()
    sizes = np.diff(hits.offsets.to_numpy())
    named = hits.flatten().dictionary_encode()
    places = np.array([at[w] for w in named.dictionary.to_pylist()], np.int64)
    x[np.repeat(np.arange(len(data)), sizes), places[named.indices.to_numpy()]] = 1.0
    formed, fold = np.array(data["shape"].to_pylist()), data["fold"].to_numpy()
    before = np.zeros((len(data), 0))
    for i in range(len(categories)):
        y = (data[f"_y{i}"].to_numpy() > 0).astype(float)
        full = np.hstack([x, formed, before, np.ones((len(data), 1))])
        w = _logistic(full, y)
        chain.weights.append(w[:len(at)].tolist())
        chain.shape.append(w[len(at):len(at) + 3].tolist())
        chain.earlier.append(w[len(at) + 3:-1].tolist())
        chain.intercepts.append(float(w[-1]))
        if i + 1 < len(categories):
            out = np.zeros(len(data))
            for f in range(FOLDS):
                away, here = fold != f, fold == f
                if here.any():
                    p = _logistic(full[away], y[away]) if away.any() else w
                    out[here] = 1 / (1 + np.exp(-np.clip(full[here] @ p, -30, 30)))
            before = np.hstack([before, out[:, None]])
    return chain


def _summed(vectors: str, i: int) -> Column:
    return F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)))


def score_notes(notes: DataFrame, chain: ToxicityChain, text: str = "notes", prefix: str = "p_") -> DataFrame:
    """``notes`` with one probability per category, each fed to the later ones.

    Every text is read whole; the model is a few literals, so scoring stays in
    generated code and needs no shuffle.  Null and empty texts are scored by the
    intercepts alone.
    """
    empty = F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))) == 0
    d = notes.withColumn("_fs_words", note_words(F.col(text)))
    table = F.map_from_arrays(strings(chain.words), F.array(*[F.array(*[F.lit(float(w[j])) for w in chain.weights]) for j in range(len(chain.words))])) if chain.words else None
    hits = F.array_intersect("_fs_words", strings(chain.words))
    d = d.withColumns({"_fs_shape": F.array(*shape(F.col("_fs_words"), F.col(text))), "_fs_hits": hits})
    d = d.withColumn("_fs_each", F.transform("_fs_hits", lambda w: F.element_at(table, w)) if table is not None else F.array().cast("array<array<double>>"))
    probabilities: list[Column] = []
    for i, c in enumerate(chain.categories):
        z = F.lit(chain.intercepts[i]) + _summed("_fs_each", i)
        for j, w in enumerate(chain.shape[i]):
            z = z + F.when(empty, F.lit(0.0)).otherwise(F.get("_fs_shape", F.lit(j))) * w
        for p, w in zip(probabilities, chain.earlier[i]):
            z = z + p * w
        d = d.withColumn(f"{prefix}{c}", 1 / (1 + F.exp(-z)))
        probabilities.append(F.col(f"{prefix}{c}"))
    return d.drop("_fs_words", "_fs_shape", "_fs_hits", "_fs_each")


def without_toxic(notes: DataFrame, chain: ToxicityChain, decide: str, text: str = "notes", threshold: float = THRESHOLD) -> DataFrame:
    """``notes`` (all columns) without those that the chain rejects.

    The row number beside the probability keeps the optimizer from pushing the
    condition below the scoring, where the words would be split anew for every term.
    """
    d = score_notes(notes, chain, text, "_fs_p_").select(*notes.columns, f"_fs_p_{decide}", F.monotonically_increasing_id().alias("_fs_row"))
    return d.where((F.col(f"_fs_p_{decide}") < threshold) & (F.col("_fs_row") >= 0)).select(*notes.columns)


def toxic_notes(notes: DataFrame, labels: DataFrame, categories: list[str], decide: str, key: str = "failure_id", text: str = "notes",
                threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity per note: ``key``, a probability per category and the decision ``rejected``.

    The project has no toxicity labels of its own: the operator is general and
    takes any keyed text (by default the notes of failure records) with a label
    table under the same key.  ``decide`` is the category whose probability
    rejects from ``threshold`` on.

    Null keys and repeated rows are kept, a row each; null and empty texts get
    the intercepts; other columns don't pass; an empty table gives an empty result.
    """
    chain = fit_chain(notes, labels, categories, key, text)
    d = score_notes(notes.select(F.col(key).alias("_k"), F.col(text).alias("_t")), chain, "_t")
    return d.select(F.col("_k").alias(key), *[F.col(f"p_{c}").alias(f"p_{c}") for c in categories], (F.col(f"p_{decide}") >= threshold).alias("rejected"))
