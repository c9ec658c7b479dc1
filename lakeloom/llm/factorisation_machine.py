"""Operator 6: quality scores by a factorisation machine.

Inputs of a text are its distinct words hashed into BUCKETS, and structure statistics and metadata
cut into bins, each an input of its own. The model has a weight and a vector of FACTORS numbers for
each input, and a pair of inputs interacts by the product of their vectors. The sum over all pairs
is computed in linear time as half of (square of the sum - sum of the squares).

Labels are learned from a bounded sample (TRAIN_ROWS labelled rows, picked by a hash of the id).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Word buckets, bins of a statistic, numbers of a vector, labelled rows that are learned from, at most.
BUCKETS, BINS, FACTORS, TRAIN_ROWS = 1 << 14, 16, 8, 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.05, 1e-5, 20
#: Of a score that counts as good.
GOOD = 0.7

SYMBOLS = re.compile(r"[^\w\s.,]")
STATISTICS = ("symbols", "repeated_lines", "distinct_words", "word_length", "line_words", "upper", "digits", "stops", "most_frequent", "length", "n_chars")


def statistics(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Shares (0 to 1) and logarithms (scaled to about 0 to 1), in the order of STATISTICS."""
    n, chars, lines = max(1, len(words)), max(1, len(text)), text.split("\n")
    counts = Counter(words)
    return [
        len(SYMBOLS.findall(text)) / chars,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        min(1.0, sum(map(len, words)) / n / 16),
        math.log1p(n / len(lines)) / 8,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        (text.count(". ") + text.count(".\n") + text.count(",")) / n,
        max(counts.values(), default=0) / n,
        math.log1p(len(words)) / 16,
        math.log1p(len(text) if n_chars is None else max(0, n_chars)) / 20,
    ]


def inputs(text: str | None, n_chars: int | None) -> np.ndarray:
    """Input numbers of a text: its words' buckets, then one bin of each statistic."""
    text = text or ""
    words = text.split()
    buckets = {zlib.crc32(w) % BUCKETS for w in set(text.lower().encode("utf-8", "surrogatepass").split())}
    bins = [BUCKETS + i * BINS + min(BINS - 1, int(math.sqrt(max(0.0, v)) * BINS)) for i, v in enumerate(statistics(text, words, n_chars))]
    return np.array([*sorted(buckets), *bins], np.int32)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, x: np.ndarray) -> float:
        """Chance of label 1. Words share a weight of one, each statistic has a weight of one."""
        scale = values(len(x))
        v = self.vectors[x] * scale[:, None]
        total = self.bias + self.weights[x] @ scale + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def values(n: int) -> np.ndarray:
    """Input values: 1 for each statistic, 1 / root of their number for words."""
    words = n - len(STATISTICS)
    return np.concatenate([np.full(words, 1 / math.sqrt(max(1, words))), np.ones(len(STATISTICS))])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Logistic loss by AdaGrad over mini-batches; rare labels weigh as much as frequent ones. No rows: a model that scores 0.5."""
    n, rng = BUCKETS + BINS * len(STATISTICS), np.random.default_rng(SEED)
    model = Model(0.0, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    if not len(rows):
        return model
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    seen_w, seen_v, seen_b = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            x, val = np.concatenate([rows[k] for k in batch]), np.concatenate([values(len(rows[k])) for k in batch])
            sizes = np.array([len(rows[k]) for k in batch])
            starts = np.cumsum(sizes) - sizes
            v = model.vectors[x] * val[:, None]
            sums = np.add.reduceat(v, starts)
            out = model.bias + np.add.reduceat(model.weights[x] * val, starts) + 0.5 * (sums**2 - np.add.reduceat(v**2, starts)).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            each = np.repeat(slope, sizes) * val
            used, where = np.unique(x, return_inverse=True)
            grad_w = np.bincount(where, each, len(used)) + DECAY * model.weights[used]
            grad_v = np.zeros((len(used), FACTORS))
            np.add.at(grad_v, where, each[:, None] * (np.repeat(sums, sizes, axis=0) - v))
            grad_v += DECAY * model.vectors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += slope.sum() ** 2
            model.weights[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            model.vectors[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            model.bias -= RATE * slope.sum() / math.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from about `rows` labelled rows at most (rows with a null id or label don't count).

    The sample is picked by a hash of the id among the labels: the rows whose hash is lowest, with those
    of equal ids in a fixed order, so that equal tables give equal models. Only its input numbers are
    collected.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    every = -(-max(1, known.count()) // rows)
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(chars_col).cast("long").alias("c")).join(picked, "id")

    def made(ids, texts, chars, marks):
        return [ids, marks, [inputs(t, c) for t, c in zip(texts, chars, strict=True)]]

    read = C.per_batch(some, ["id", "t", "c", "label"], "id long, label int, x array<int>", made)
    got = sorted(read.orderBy(F.xxhash64("id"), "id", "label", "x").limit(2 * rows).collect())
    return fit([np.array(r.x, np.int32) for r in got], np.array([r.label for r in got], float))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(id_col, score double) of every row.

    A null text is the empty one and has a score as any other, texts of any length are read whole, a null
    n_chars is the text's length, repeated rows repeat, ids may be null, further columns are left out, an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: inputs times (1 + factors) numbers

    def rows(keys, texts, chars):
        return [keys, [shared.value.score(inputs(t, c)) for t, c in zip(texts, chars, strict=True)]]

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col, chars_col], f"{id_col} {kind}, score double", rows)


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside fold 2 of 4."""
    docs, labels = C.dealt(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    scored = score(docs, train(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
