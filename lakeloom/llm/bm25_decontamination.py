"""Operator 8: benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are the indexed side. An item's score for a passage is the BM25 weight of the
passage's words in it, divided by the item's own total, so that a threshold means the same for every
item: the share of its weight that the passage holds. Every passage of every document is a query:
windows of WINDOW words, one every STRIDE words, over the whole text. Items are indexed in parts of
PART words at most, so that some window holds each copy whole.

A document is scored in three steps that never lose a part at or above the threshold:

1. Essential lists: each part's lightest (most common) words up to half the threshold can't reach it
   alone, so its other, essential, words must bring the other half. Their weights are summed by window
   and part in one pass over the document; a window where no part comes to that is skipped.
2. Block-max WAND over the words of the remaining windows: lists in order of their next part; the
   pivot is where the lists' maxima first reach the threshold; if the maxima of the blocks there don't,
   all lists up to it jump past the nearest block's end; else the pivot is scored.
3. Of the items found, the question (all but the last sentence) and the answer (the last sentence)
   must both come in the text around the window: the longest sequence of their words that comes there in
   the same order. A changed word costs one word, however short the answer is; an answer that is
   missing fails. So do a text's words in another order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: BM25's two constants; share of an item's weight that makes it a candidate.
K1, B, THRESHOLD = 1.2, 0.75, 0.7
WINDOW, STRIDE, PART = 128, 64, 64
#: Shares of the words that must come in order: of an item's question and its answer, or of the whole item.
OVERLAP, WHOLE = 0.6, 0.75
#: Postings of a block; bytes of items in one index, which is fifty times as large in memory (more items: more indexes, one after the other).
BLOCK, INDEX_BYTES = 32, 3 << 20
#: Cells of an array of sums by window and part, for each posting that is summed; if there were more, sums are made by sorting.
DENSE = 64

WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and in the last sentence or line; an item of one sentence is cut at three quarters."""
    whole = words_of(text)
    last = words_of(re.split(r"(?<=[.?!])\s+|\n+", text.strip())[-1])
    n = len(last) if len(last) < len(whole) else len(whole) - 3 * len(whole) // 4
    return whole[: len(whole) - n], whole[len(whole) - n :]


@dataclass
class Index:
    """Postings of item parts, by word, in blocks."""

    terms: dict[str, int] = field(default_factory=dict)
    parts: list[list[int]] = field(default_factory=list)  # each term's part numbers, ascending
    weights: list[list[float]] = field(default_factory=list)
    maxima: list[float] = field(default_factory=list)
    block_maxima: list[list[float]] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))  # where each term's essential postings begin
    essential: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # (part, weight)
    item_of: list[int] = field(default_factory=list)
    part_item: list[int] = field(default_factory=list)
    items: list[tuple[list[str], list[str]]] = field(default_factory=list)  # words of the question, of the answer


def in_order(wanted: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, by one addition of long integers for each word that is wanted."""
    places: dict[str, int] = {}
    for i, w in enumerate(wanted):
        places[w] = places.get(w, 0) | 1 << i
    every = row = (1 << len(wanted)) - 1
    for w in words:
        if (m := places.get(w)) is not None:
            met = row & m
            row = (row + met | row - met) & every
    return len(wanted) - row.bit_count()


def overlaps(item: tuple[list[str], list[str]], words: list[str]) -> tuple[float, float, float]:
    """Shares of the question's, the answer's and all of the item's words that come in the same order."""
    q, a = item
    return in_order(q, words) / max(1, len(q)) if q else 1.0, in_order(a, words) / max(1, len(a)), in_order(q + a, words) / max(1, len(q) + len(a))


def build_index(items: list[tuple[int, str]], threshold: float = THRESHOLD) -> Index:
    ix, parts = Index(), []
    for key, text in items:
        words = words_of(text)
        if not words:
            continue
        n = -(-len(words) // PART)
        ix.items.append(question_and_answer(text))
        for i in range(n):
            parts.append((len(ix.items) - 1, Counter(words[len(words) * i // n : len(words) * (i + 1) // n])))
        ix.item_of.append(key)
    df = Counter(w for _, c in parts for w in c)
    mean = sum(sum(c.values()) for _, c in parts) / max(1, len(parts))
    essential: list[tuple[int, int, float]] = []
    for number, (_, c) in enumerate(parts):
        size = sum(c.values())
        weight = {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for w, n in c.items()}
        total, light = sum(weight.values()), 0.0
        for w in sorted(weight, key=lambda w: (-df[w], w)):
            share = weight[w] / total
            if w not in ix.terms:
                ix.terms[w] = len(ix.terms)
                ix.parts.append([])
                ix.weights.append([])
            t = ix.terms[w]
            ix.parts[t].append(number)
            ix.weights[t].append(share)
            if light + share <= threshold / 2:
                light += share
            else:
                essential.append((t, number, share))
    ix.maxima = [max(w) for w in ix.weights]
    ix.block_maxima = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in ix.weights]
    table = np.array(sorted(essential), float).reshape(-1, 3)
    ix.first = np.searchsorted(table[:, 0], np.arange(len(ix.terms) + 2))  # an unknown word is term -1: no postings
    ix.first[-1] = ix.first[-2]
    ix.essential = table[:, 1:]
    ix.part_item = [i for i, _ in parts]
    return ix


def block_max_wand(ix: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(part, score) of all parts that the terms give the threshold or more."""
    found, at = [], dict.fromkeys(terms, 0)
    least = threshold - 1e-9
    lists = sorted(terms, key=lambda t: ix.parts[t][0])
    while lists:
        bound, pivot = 0.0, None
        for k, t in enumerate(lists):
            bound += ix.maxima[t]
            if bound >= least:
                pivot = k
                break
        if pivot is None:
            return found
        part = ix.parts[lists[pivot]][at[lists[pivot]]]
        while pivot + 1 < len(lists) and ix.parts[lists[pivot + 1]][at[lists[pivot + 1]]] == part:
            pivot += 1
        bound, ends = 0.0, []
        for t in lists[: pivot + 1]:
            p = ix.parts[t]
            if (i := bisect_left(p, part, at[t])) < len(p):
                block = i // BLOCK
                bound += ix.block_maxima[t][block]
                ends.append(p[min(len(p), (block + 1) * BLOCK) - 1] + 1)
        if bound >= least:
            score, to = 0.0, part + 1
            for t in lists[: pivot + 1]:
                p = ix.parts[t]
                if (i := bisect_left(p, part, at[t])) < len(p) and p[i] == part:
                    score += ix.weights[t][i]
            if score >= least:
                found.append((part, score))
        else:
            to = min([*ends, *([ix.parts[lists[pivot + 1]][at[lists[pivot + 1]]]] if pivot + 1 < len(lists) else [])])
            to = max(to, part + 1)
        for t in lists[: pivot + 1]:
            at[t] = bisect_left(ix.parts[t], to, at[t])
        lists = sorted((t for t in lists if at[t] < len(ix.parts[t])), key=lambda t: ix.parts[t][at[t]])
    return found


def promising(ix: Index, terms: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the windows in which some part's essential words may bring half the threshold (repeats count again: a bound)."""
    first = ix.first[terms]
    n = np.where(terms < 0, 0, ix.first[terms + 1] - first)
    position = np.repeat(np.arange(len(terms)), n)
    at = np.arange(len(position)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    part, weight = ix.essential[at, 0].astype(np.int64), ix.essential[at, 1]
    last = max(0, -(-(len(terms) - WINDOW) // STRIDE))
    late = np.minimum(position // STRIDE, last)
    keys = [late * len(ix.part_item) + part]
    values = [weight]
    for back in range(1, -(-WINDOW // STRIDE)):  # a word is in the windows that begin up to WINDOW before it
        window = position // STRIDE - back
        inside = (window >= 0) & (window < late) & (window * STRIDE + WINDOW > position)
        keys.append((window * len(ix.part_item) + part)[inside])
        values.append(weight[inside])
    keys, values, least = np.concatenate(keys), np.concatenate(values), threshold / 2 - 1e-6
    if (last + 1) * len(ix.part_item) <= DENSE * (len(keys) + 1):
        good = np.flatnonzero(np.bincount(keys, values) >= least)
    else:
        keys, where = np.unique(keys, return_inverse=True)
        good = keys[np.bincount(where, values, len(keys)) >= least]
    return np.unique(good // max(1, len(ix.part_item)))


def matches(ix: Index, text: str | None, threshold: float = THRESHOLD) -> list[tuple]:
    """(item, score, question overlap, answer overlap, first word, last word + 1) of each item that the text holds."""
    words = words_of(text)
    terms = np.fromiter(map(ix.terms.get, words, repeat(-1)), np.int64, len(words))
    best: dict[int, tuple] = {}
    for window in promising(ix, terms, threshold).tolist() if len(terms) else []:
        s, e = window * STRIDE, min(window * STRIDE + WINDOW, len(words))
        own = [t for t in dict.fromkeys(terms[s:e].tolist()) if t >= 0]
        for part, score in block_max_wand(ix, own, threshold):
            item = ix.part_item[part]
            if item in best and best[item][1] >= score:
                continue
            room = sum(map(len, ix.items[item])) + WINDOW
            q, a, whole = overlaps(ix.items[item], words[max(0, s - room) : e + room])
            if (q >= OVERLAP <= a) or whole >= WHOLE:
                best[item] = (ix.item_of[item], score, q, a, s, e)
    return [best[i] for i in sorted(best)]


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap, first_word, end_word): one row per row and test item that it holds.

    Null and empty texts hold nothing and null or wordless items are held by nothing; repeated rows and
    equal items repeat; a word count of any length is searched; empty tables give no rows. The items of
    one index are measured before they are collected; more of them go into further indexes.
    """
    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    schema = f"{id_col} {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long, end_word long"
    out = None
    for index in indexes(items, item_col, item_text_col, threshold, index_bytes):

        def rows(keys, texts, index=index):
            ix, got = index.value, []
            for key, text in zip(keys, texts, strict=True):
                got.extend((key, *m) for m in matches(ix, text, threshold))
            return [list(c) for c in zip(*got, strict=True)] if got else [[] for _ in range(7)]

        found = C.per_batch(df, [id_col, text_col], schema, rows)
        out = found if out is None else out.unionByName(found)
    return out


def indexes(items: DataFrame, item_col: str, text_col: str, threshold: float, index_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of all items, each over about index_bytes of text; that is measured before they are collected."""
    spark = items.sparkSession
    items = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    n = 1 + int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // index_bytes)
    for shard in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == shard) if n > 1 else items
        rows = sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(build_index(rows, threshold))


def count_leaks(df: DataFrame, items: DataFrame, count_col: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """df and count_col, a name that it doesn't have: how many test items its row holds; nothing is shuffled.

    Null and empty texts hold none; repeated rows repeat. Of several indexes one is held at a time: what
    it has counted is written to the shared folder before the next one is built.
    """
    before = None
    for index in indexes(items, item_col, item_text_col, threshold, index_bytes):

        def held(texts, sofar=None, index=index):
            return [[n + len(matches(index.value, t, threshold)) for t, n in zip(texts, sofar or [0] * len(texts), strict=True)]]

        if before is None:
            df = C.with_columns(df, [text_col], f"{count_col} int", held)
        else:
            df, now = C.saved(df), C.fresh(df, f"{count_col}_now")
            before.unpersist()
            df = C.with_columns(df, [text_col, count_col], f"{now} int", held).withColumn(count_col, F.col(now)).drop(now)
        before = index
    return df


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test items that documents hold."""
    return contaminated(C.dealt(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
