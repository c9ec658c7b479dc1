"""Operator 9: language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (n = 1, 2, 3 within words, which are
padded by a space), in order. A document's own list is compared to each by the out-of-place distance:
the sum of the differences in rank, with the greatest possible one for an n-gram the profile lacks.
The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: N-grams of a profile, and of a document that are compared.
PROFILE, COMPARED = 1_000, 400
#: N-grams gathered before a training task counts what it has.
GATHERED = 4_000_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Keys of all n-grams of a text, repeats included; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    a = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.int64)
    space = a == 32
    a = a[~(space & np.concatenate([[False], space[:-1]]))]
    space = a == 32
    two = a[:-1] << 21 | a[1:]
    three = two[:-1] << 21 | a[2:]
    return np.concatenate([a[~space], two, three[~space[1:-1]]])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they come."""
    if weights is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights, starts)


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams (ties: smaller key first), counted over all rows whose language isn't null.

    Tasks count before anything is shuffled; a language's list has `size` entries at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting, total = {}, 0

        def settle():
            for lang, parts in waiting.items():
                k, n = counted(np.concatenate(parts))
                if lang in held:
                    k, n = counted(np.concatenate([held[lang][0], k]), np.concatenate([held[lang][1], n]))
                held[lang] = (k, n)
            waiting.clear()

        for batch in C.pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(text)
                waiting.setdefault(lang, []).append(grams)
                total += len(grams)
                if total > GATHERED:
                    settle()
                    total = 0
                    if sum(len(k) for k, _ in held.values()) > GATHERED:
                        for lang, (k, n) in held.items():
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
                        held.clear()
        settle()
        for lang, (k, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    C.ship(df.sparkSession)
    parts = df.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(count, "lang string, gram long, n long")
    total = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(f"rank <= {size}")
    profiles: dict[str, list] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.rank)):  # `size` rows a language
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(p, np.int64) for lang, p in profiles.items()}


class Profiles:
    """Ranks of every profile's n-grams in one sorted table."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE, compared: int = COMPARED):
        self.langs, self.most, self.compared = sorted(profiles), size, compared
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), size, np.int64)  # the last row: n-grams that none has
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: first in order), and 1 less its distance as a share of the greatest possible one."""
        grams = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        keys, n = counted(grams)
        keys = keys[np.argsort(-n, kind="stable")[: self.compared]]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        ranks = self.ranks[at]
        apart = np.where(ranks == self.most, self.most, np.abs(ranks - np.arange(len(keys))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.most * len(keys)))


def predict_languages(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row; null texts and texts without a letter are `und` with score 0.

    Texts of any length are read whole, repeated rows repeat, ids may be null, further columns are left
    out, an empty table gives an empty one.
    """

    def rows(keys, texts):
        model = Profiles(profiles)
        found = [model.predict(t) for t in texts]
        return [keys, [f[0] for f in found], [f[1] for f in found]]

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col], f"{id_col} {kind}, lang_pred string, score double", rows)


def add_languages(df: DataFrame, profiles: dict[str, np.ndarray], lang_col: str, score_col: str, text_col: str = "text") -> DataFrame:
    """df and the columns of predict_languages(), under names that df doesn't have; nothing is shuffled."""

    def rows(texts):
        model = Profiles(profiles)
        found = [model.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    return C.with_columns(df, [text_col], f"{lang_col} string, {score_col} double", rows)


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from profiles of the rows outside fold 1 of 3."""
    docs = C.dealt(spark, sf_dir, "documents")
    profiles = train_profiles(docs.where(fold("doc_id", 3) != 1))
    return predict_languages(docs, profiles).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")
