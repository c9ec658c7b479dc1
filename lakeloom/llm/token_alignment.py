"""Operator 13: alignment of two tokenizers' tokens by their byte ranges.

Every text is encoded whole by both tokenizers. Where both have a token end at the same byte and both go on
with a token that begins with a space, the text is cut into windows of token ids. Most windows are words that
come again and again, so the alignment of a window is kept by its two tuples of ids.

Byte ends that both sides share cut tokens into groups; two tokens are linked where their bytes overlap. How
many documents hold a linked pair of ids is counted over all documents, and judges each document's links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.llm import bpe_automaton as A

#: A pair of ids (a, b) is the long a << PAIR_BITS | b.
PAIR_BITS = 32
#: Marks side B's ids in the packed ids of a window.
B_SIDE = 1 << 30
#: Windows of more tokens than this are aligned anew each time.
MEMO_TOKENS = 64
#: Texts are aligned together until they have so many tokens (a text with more is alone).
TOGETHER = 1 << 15
#: Texts with so many characters in a row without a space, or of white space alone, are encoded by operator 4's automaton, which takes time in proportion to a word's length.
LONG_RUN = 1000
#: Counts of so many id pairs at most, the most frequent ones, are broadcast (16 bytes each).
FREQUENT = 250_000
#: What stands after an id in the text of groups: one more of its group's side, side B, the next group, the next window.
AFTER = ",|;\n"


def has_long_run(text: str) -> bool:
    """True if a run has 2 * LONG_RUN characters or more: it then holds one of the stretches that are looked at."""
    return any(text.find(" ", i, i + LONG_RUN) < 0 or text[i : i + LONG_RUN].isspace() for i in range(0, len(text) - LONG_RUN + 1, LONG_RUN))


class Vocabulary:
    """Side A: a byte-level vocabulary, read from the file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        symbols, special = A.byte_symbols(), {t["content"] for t in content["added_tokens"]}
        ids = {bytes(symbols[c] for c in s): i for s, i in content["model"]["vocab"].items() if s not in special}
        merged = [content["model"]["vocab"][u + v] for u, v in content["model"]["merges"]]
        # the faster library merges by the lowest id, so ids must rise with the merges
        fast = merged == sorted(merged) and len(merged) + 256 == len(ids)
        self.path, self.fast = path, tiktoken.Encoding("side_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}) if fast else None
        self.bytes = [b""] * (max(content["model"]["vocab"].values()) + 1)
        for t, i in ids.items():
            self.bytes[i] = t

    def encode(self, text: str) -> list[int]:
        if self.fast and not has_long_run(text):
            return self.fast.encode_ordinary(text)
        return A.encode(text, self.path, specials=False)


class Aligner:
    """Side A by Vocabulary, side B by a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b, self.memo = Vocabulary(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), A.Memo()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = self.a.bytes
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t))) for t in (self.a_bytes, self.b_bytes))
        self.b_start, self.b_flat = np.cumsum(self.b_sizes) - self.b_sizes, np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.a_space = np.array([t.startswith(b" ") for t in self.a_bytes])
        self.b_space = np.array([t.startswith(b" ") for t in self.b_bytes])
        self.said = [f"{i}{c}" for i in range(max(len(self.a_bytes), len(pieces))) for c in AFTER]

    def spelled(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids of a whole text; two empty arrays unless both spell " " + text."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        whole = (" " + text).encode("utf-8", "surrogatepass")
        x, y = np.array(self.a.encode(" " + text), np.int32), np.array(self.b.encode(text, num_threads=1), np.int32)
        # side A's tokens are stretches of the text in order, so that their lengths tell whether any is left out; side B changes some texts
        if self.a_sizes[x].sum() != len(whole) or self.b_text(y) != whole:
            return none, none
        return x, y

    def b_text(self, y: np.ndarray) -> bytes:
        """The bytes of side B's tokens, copied out of those of all tokens."""
        sizes = self.b_sizes[y]
        ends = np.cumsum(sizes)
        at = np.repeat(self.b_start[y] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.b_flat[at].tobytes()

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """spelled() as lists."""
        x, y = self.spelled(text)
        return x.tolist(), y.tolist()

    def windows(self, a: np.ndarray | list[int], b: np.ndarray | list[int]) -> list[bytes]:
        """A text's windows: the ids of each, packed as 32-bit integers, side A's and then side B's (marked by B_SIDE).

        They begin where both sides have a token end at the same byte, and a token that begins with a space next.
        """
        return self.windows_of([(a, b)])[0]

    def windows_of(self, texts: list[tuple]) -> tuple[list[bytes], list[int]]:
        """windows() of several texts that have tokens, one after the other, and where in the list those of each text end."""
        x, y = (np.concatenate([t[side] for t in texts]).astype(np.int32, copy=False) for side in (0, 1))
        last_a, last_b = (np.cumsum([len(t[side]) for t in texts]) for side in (0, 1))
        cut_a, cut_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
        cut_a[:-1], cut_b[:-1] = self.a_space[x[1:]], self.b_space[y[1:]]
        cut_a[last_a - 1] = cut_b[last_b - 1] = True  # both sides of a text have the same bytes
        at_a, at_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        x_end, y_end = np.cumsum(self.a_sizes[x]), np.cumsum(self.b_sizes[y])
        of_a, of_b = np.zeros(x_end[-1] + 1, bool), np.zeros(x_end[-1] + 1, bool)  # by bytes: where a side may be cut
        of_a[x_end[at_a]] = of_b[y_end[at_b]] = True
        s, t = at_a[of_b[x_end[at_a]]] + 1, at_b[of_a[y_end[at_b]]] + 1  # ends of windows
        n, m = np.diff(s, prepend=0), np.diff(t, prepend=0)
        packed = np.empty(len(x) + len(y), np.int32)
        packed[np.arange(len(x)) + np.repeat(t - m, n)] = x
        packed[np.arange(len(y)) + np.repeat(s, m)] = y | B_SIDE
        raw, ends = packed.tobytes(), ((s + t) * 4).tolist()
        return list(map(raw.__getitem__, starmap(slice, zip([0, *ends], ends, strict=False)))), np.searchsorted(s, last_a, "right").tolist()

    def align(self, keys: list[bytes]) -> list[tuple[bytes, str, bytes, bytes]]:
        """Of each window: its links (64-bit id pairs in order), the text of its groups, and the groups' tokens on side A and B (32-bit numbers).

        Both sides of a window spell the same bytes, so that windows one after the other are a text again. Its
        tokens' ends cut it into stretches that lie in one token of each side: a link each.
        """
        packed = np.frombuffer(b"".join(keys), np.int32)
        window, side_b = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys]), packed & B_SIDE != 0
        x, y, of_x, of_y = packed[~side_b], packed[side_b] ^ B_SIDE, window[~side_b], window[side_b]
        x_end, y_end = np.cumsum(self.a_sizes[x]), np.cumsum(self.b_sizes[y])
        in_x, in_y = np.zeros(x_end[-1] + 1, np.int64), np.zeros(x_end[-1] + 1, np.int64)  # by bytes: 1 where a side's token ends
        in_x[x_end] = in_y[y_end] = 1
        ends, shared = np.flatnonzero(in_x | in_y), np.flatnonzero(in_x & in_y)
        before_x, before_y, before_both = (np.cumsum(v) - v for v in (in_x, in_y, in_x & in_y))  # by bytes: how many ended before
        i, j = before_x[ends], before_y[ends]
        links, of_link = x[i].astype(np.int64) << PAIR_BITS | y[j], of_x[i]
        x_group, y_group = before_both[x_end], before_both[y_end]
        of_group = of_x[before_x[shared]]
        # tokens by group and side, each followed by what the next one needs
        place = np.concatenate([x_group * 2, y_group * 2 + 1])
        order = np.argsort(place, kind="stable")
        ids, place, of = np.concatenate([x, y])[order], place[order], np.concatenate([of_x, of_y])[order]
        step = np.full(len(ids), 3)
        step[:-1] = np.select([place[1:] == place[:-1], place[1:] // 2 == place[:-1] // 2, of[1:] == of[:-1]], [0, 1, 2], 3)
        texts = "".join(map(self.said.__getitem__, (ids.astype(np.int64) * 4 + step).tolist())).split("\n")
        sizes = [np.bincount(g).astype(np.int32).tobytes() for g in (x_group, y_group)]
        n_links, n_groups = np.cumsum(np.bincount(of_link)).tolist(), np.cumsum(np.bincount(of_group)).tolist()
        raw, out, p, g = links.tobytes(), [], 0, 0
        for text, q, h in zip(texts, n_links, n_groups, strict=False):
            out.append((raw[p * 8 : q * 8], text, sizes[0][g * 4 : h * 4], sizes[1][g * 4 : h * 4]))
            p, g = q, h
        return out

    def aligned(self, a: np.ndarray | list[int], b: np.ndarray | list[int]) -> list[tuple[bytes, str, bytes, bytes]]:
        """align() of all windows of a text; those that were there before come from memory."""
        return self.aligned_of([(a, b)])[0]

    def aligned_of(self, texts: list[tuple]) -> list[list[tuple[bytes, str, bytes, bytes]]]:
        """aligned() of several texts; their new windows are aligned together."""
        full = [t for t in texts if len(t[0])]
        if not full:
            return [[] for _ in texts]
        (keys, ends), memo = self.windows_of(full), self.memo
        out = list(map(memo.young.get, keys))
        gaps = [i for i, w in enumerate(out) if w is None]
        if gaps:
            here = {k: memo.old.get(k) for k in map(keys.__getitem__, gaps)}
            new = [k for k, w in here.items() if w is None]
            here |= zip(new, self.align(new), strict=True) if new else {}
            for i in gaps:
                out[i] = here[keys[i]]
            for k, w in here.items():
                if len(k) <= 4 * MEMO_TOKENS:
                    memo.keep(k, w, 450 + 7 * len(k))  # objects' heads; key, links, sizes and text of its tokens
        each = (out[i:j] for i, j in zip([0, *ends], ends, strict=False))
        return [next(each) if len(t[0]) else [] for t in texts]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def pair_counts(windows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs that are linked in a text, and how often each is."""
    return np.unique(np.frombuffer(b"".join([w[0] for w in windows]), np.int64), return_counts=True)


def group_ends(windows: list[tuple], side: int) -> np.ndarray:
    """How many tokens of a side (0 or 1) end with each group."""
    return np.cumsum(np.frombuffer(b"".join([w[2 + side] for w in windows]), np.int32), dtype=np.int32)


def align_documents(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, a_ids, b_ids, a_ends, b_ends array<int>, pairs array<long>, times array<int>) of each row.

    Group k of a text is a_ids[a_ends[k-1]:a_ends[k]] and b_ids[b_ends[k-1]:b_ends[k]]; pairs are its linked
    ids (pair_ids() takes them apart), each once, times how often they are linked.

    Null and empty texts, and those that a side doesn't spell byte by byte, give empty arrays. Every row gives
    one row: repeated rows repeat, ids may be null or tie, texts of any length are taken whole, further columns
    of any name are left out, an empty table gives an empty one.
    """

    def rows(keys, values):
        at, out = aligner(a_path, b_path), [keys, [], [], [], [], [], []]
        for text in values:
            a, b = at.spelled(text)
            windows = at.aligned(a, b)
            for column, value in zip(out[1:], (a, b, group_ends(windows, 0), group_ends(windows, 1), *pair_counts(windows)), strict=True):
                column.append(value)
        return out

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col], f"{id_col} {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, pairs array<long>, times array<int>", rows)


def aligned_together(at: Aligner, keys: list, values: list[str | None]) -> Iterator[tuple]:
    """(key, ids of side A, ids of side B, aligned windows) of each text, in order; texts of TOGETHER tokens are worked on at once."""
    waiting, tokens = [], 0
    for i, (key, text) in enumerate(zip(keys, values, strict=True), 1):
        waiting.append((key, *at.spelled(text)))
        tokens += len(waiting[-1][1]) + len(waiting[-1][2])
        if tokens >= TOGETHER or i == len(keys):
            for row, windows in zip(waiting, at.aligned_of([w[1:] for w in waiting]), strict=True):
                yield *row, windows
            waiting, tokens = [], 0


def pair_ids(pair) -> tuple:
    """The ids of sides A and B in a pair (numbers or columns)."""
    if isinstance(pair, int):
        return pair >> PAIR_BITS, pair & (1 << PAIR_BITS) - 1
    return F.shiftright(pair, PAIR_BITS).cast("int"), pair.bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int")


def summaries(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """align_documents() with its ids and groups as counts and a digest, made where they are (they don't travel), and a number of the row."""

    def run(batches):
        out = C.arrow_schema(schema)
        at, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in C.pieces(batches):
            made = [[] for _ in out]
            for key, a, b, windows in aligned_together(at, batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, times = pair_counts(windows)
                groups = ";".join([w[1] for w in windows])
                digest = hashlib.sha256(groups.encode()).hexdigest() if windows else ""
                for column, value in zip(made, (row, key, len(a), len(b), groups.count(";") + len(windows[:1]), times.sum(), digest, pairs, times.astype(np.int32)), strict=True):
                    column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out)

    C.ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    schema = f"row_number long, {id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def document_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): how many rows of a table with the column pairs hold each; tasks count before the shuffle."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))


def split_counts(counts: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, DataFrame | None]:
    """Saved counts as (those of `most` frequent pairs at most, the others of two documents or more, None if there are none).

    What is in neither has a count of one. The cut is a power of two, found from the numbers of pairs by size.
    """
    sizes = counts.where("docs > 1").groupBy(F.floor(F.log2("docs")).alias("size")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    least, kept = None, 0
    for size, n in sorted(((r["size"], r["n"]) for r in sizes), reverse=True):
        if kept + n > most:
            break
        least, kept = size, kept + n
    if least is None:
        return counts.limit(0), counts.where("docs > 1") if sizes else None
    frequent = F.floor(F.log2("docs")) >= least
    return counts.where(frequent & (F.col("docs") > 1)), counts.where(~frequent & (F.col("docs") > 1)) if kept < sum(r["n"] for r in sizes) else None


def judge_links(aligned: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(row_number, n_best, count_sum) of each row of saved summaries that has links.

    A link's count is the number of documents that hold its id pair. Counts of the most frequent pairs, which
    would be hot keys, are broadcast (of bounded number); the rest of those with two documents or more are
    joined by shuffling; pairs of one document need no join. The best counts are broadcast: a row an A id.
    """
    counts = C.saved(document_counts(aligned))
    frequent, rest = split_counts(counts, most)
    links = aligned.select("row_number", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row_number", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    found = links.join(F.broadcast(frequent), "pair", "left")
    if rest is not None:
        found = found.where("docs is not null").unionByName(found.where("docs is null").drop("docs").join(rest, "pair", "left"))
    best = counts.groupBy(F.shiftright("pair", PAIR_BITS).alias("a_id")).agg(F.max("docs").alias("most"))
    judged = found.withColumn("docs", F.coalesce("docs", F.lit(1))).withColumn("a_id", F.shiftright("pair", PAIR_BITS)).join(F.broadcast(best), "a_id")
    return judged.groupBy("row_number").agg(F.sum(F.when(F.col("docs") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))


def alignment_report(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, with the corpus-wide counts of its links.

    A text without tokens (see align_documents) has zeros and the digest ''. Rows as in align_documents; a
    repeated row counts as a document of its own.
    """
    aligned = C.saved(summaries(df, a_path, b_path, id_col, text_col))
    made = aligned.drop("pairs", "times").join(judge_links(aligned), "row_number", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of byte_bpe_50k.json aligned with those of piece_bpe_32k.model."""
    return alignment_report(C.dealt(spark, sf_dir, "documents"), C.tokenizer_file("byte_bpe_50k.json"), C.tokenizer_file("piece_bpe_32k.model"))
