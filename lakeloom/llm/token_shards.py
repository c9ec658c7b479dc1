"""Operator 5: token ids in a binary block format, compressed per document with a shared dictionary.

A store is a Parquet table with one row per block of documents, in ascending document order:

* ``bucket, block``: place of the block; buckets are consecutive ranges of doc_id,
* ``first_start``: ids of all documents before it in its bucket,
* ``doc_ids, counts, offsets``: index of the block: document i is frame ``payload[offsets[i]:offsets[i+1]]``
  and holds ``counts[i]`` ids,
* ``payload``: one zstandard frame per document over its ids as little-endian unsigned 32-bit integers,
* ``dictionary_sha256``: which dictionary the frames need; "" if none could be trained.

A short document is read by its block (min and max of ``first_doc``/``last_doc`` are in the Parquet
footers) and its offset; only its frame is decompressed. Parquet's commit makes writing safe when
executors are lost. The dictionary is fitted on a bounded sample (SAMPLE_DOCS documents).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.llm.bpe_automaton import MEMO_WORD, Memo, byte_symbols

#: So many documents train the dictionary, by so many bytes of their ids at most; the dictionary's bytes; zstandard's level.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1_000, 65_536, 65_536, 3
#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 128 << 20
#: A block ends at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 1_024, 4 << 20
#: Texts with other characters, or with what may be a special token, go to the library whole: above U+024F
#: letter case and composition have more rules, and 1C-1F are white space only to Python.
OTHER, SPECIAL = re.compile("[\x1c-\x1fɐ-\U0010ffff]"), "<|"
#: Words as the vocabulary splits normalised text (fixed by the format), up to U+024F.
WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9\xb2\xb3\xb9\xbc-\xbea-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


class WordEncoder:
    """The tokenizers library behind a memory of words: the words of a text are encoded independently."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.symbols = self.library.model, {b: c for c, b in byte_symbols().items()}
        self.memo = Memo()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[str]) -> bytes:
        """The library's model encodes each new word, as the characters that stand for its bytes."""
        memo = self.memo
        try:
            return b"".join(map(memo.young.__getitem__, words))
        except KeyError:
            pass
        tokenize, symbols, here = self.model.tokenize, self.symbols, {}
        for w in words:
            if w in here:
                continue
            here[w] = memo.young.get(w) or memo.old.get(w) or array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(symbols))]).tobytes()
            if len(w) <= MEMO_WORD and w not in memo.young:
                memo.keep(w, here[w], 200 + 4 * len(w) + len(here[w]))  # objects' heads, characters, ids
        return b"".join(map(here.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if SPECIAL in text or OTHER.search(text):
            return self._ids(text).tobytes()
        lowered = (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()
        if OTHER.search(lowered):  # some capitals' lower case lies above U+024F, or is two characters
            return self._ids(text).tobytes()
        return self._words(WORD.findall(lowered))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def train_dictionary(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str, sample: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from about `sample` documents, those whose hash of id and text is lowest; b"" if there are too few.

    Only the dictionary depends on the sample, so every document is written whole, whatever is in it.
    For training a document counts by its first SAMPLE_BYTES at most: the driver gets `sample` times that.
    """
    end = np.array([end_id], "<u4").tobytes()
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    low = df.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = df.where(order <= low) if low is not None else df.limit(0)
    got = C.per_batch(some.select(order.alias("h"), text_col), ["h", text_col], "h long, ids binary", lambda hs, texts: [hs, [(encoder(path).encode(t or "") + end)[:SAMPLE_BYTES] for t in texts]])
    parts = sorted(bytes(r.ids) for r in got.orderBy("h", "ids").limit(sample).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_store(df: DataFrame, target: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, dictionary: bytes | None = None) -> bytes:
    """Encodes every whole text, adds end_id to each and writes the store; returns the dictionary.

    Null texts are empty (the end id alone), null ids come first, equal ids stand next to each other
    ordered by their ids' checksum, further columns are left out, an empty table writes an empty store.
    """
    spark = df.sparkSession
    C.ship(spark)
    if dictionary is None:
        dictionary = train_dictionary(df, path, end_id, id_col, text_col)
    sha = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    bounds = np.unique(np.array(df.approxQuantile(id_col, [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], float)).astype("int64")
    end = np.array([end_id], "<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press = encoder(path), _compressor(dictionary)
        for batch in C.pieces(batches):
            keys, out = batch.column(0), [words.encode(t or "") + end for t in batch.column(1).to_pylist()]
            bucket = np.searchsorted(bounds, keys.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), keys.cast(pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array([press.compress(x) for x in out], pa.binary())], ["bucket", "doc_id", "n", "crc", "frame"])

    made = df.select(id_col, text_col).mapInArrow(frames, "bucket int, doc_id long, n long, crc long, frame binary")
    dealt = made.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "crc")
    schema = "bucket int, block int, first_doc long, last_doc long, first_start long, doc_ids array<long>, counts array<long>, offsets array<long>, dictionary_sha256 string, payload binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(schema)
        bucket, block, start, docs, counts, held = None, 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).tolist()
            values = [bucket, block, min(known, default=None), max(known, default=None), start, docs, counts, offsets, sha, b"".join(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in batches:
            size = sum(map(len, held))
            for b, d, n_ids, frame in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if held and (b != bucket or len(held) >= BLOCK_DOCS or size + len(frame) > BLOCK_BYTES):
                    yield row()
                    block, start, docs, counts, held, size = block + 1, start + sum(counts), [], [], [], 0
                if b != bucket:
                    bucket, block, start = b, 0, 0
                docs.append(d)
                counts.append(n_ids)
                held.append(frame)
                size += len(frame)
        if held:
            yield row()

    dealt.mapInArrow(blocks, schema).write.option("compression", "none").parquet(target)
    return dictionary


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_store(spark: SparkSession, target: str, dictionary: bytes, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ids: ids array<int>) of every document, or of those in doc_ids.

    start counts the ids of all documents before. A store that needs another dictionary is an error.
    """
    store = spark.read.parquet(target)
    totals = {r.bucket: r.n for r in store.groupBy("bucket").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).collect()}  # one row a bucket
    before, base = 0, {}
    for bucket in sorted(totals):
        base[bucket], before = before, before + totals[bucket]
    if doc_ids is not None:
        store = store.where(" or ".join(f"{d} between first_doc and last_doc" for d in doc_ids) or "false")
    wanted = None if doc_ids is None else set(doc_ids)
    sha = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def rows(buckets, starts, docs, counts, offsets, shas, payloads):
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = [[], [], [], [], []]
        for b, at, dd, nn, oo, s, payload in zip(buckets, starts, docs, counts, offsets, shas, payloads, strict=True):
            if s != sha:
                raise ValueError(f"the store needs dictionary {s or 'none'}")
            at += base[b]
            for i, (d, n) in enumerate(zip(dd, nn, strict=True)):
                if wanted is None or d in wanted:
                    data = plain.decompress(payload[oo[i] : oo[i + 1]])
                    for column, v in zip(out, (d, at, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4").astype("i4") if ids else None), strict=True):
                        column.append(v)
                at += n
        return out if ids else out[:4]

    return C.per_batch(store, ["bucket", "first_start", "doc_ids", "counts", "offsets", "dictionary_sha256", "payload"], schema, rows, at_once=4)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids of word_bpe_49k.json with end id 1, written as a store and read back."""
    target = C.shared_folder(spark)
    dictionary = write_store(C.dealt(spark, sf_dir, "documents"), target, C.tokenizer_file("word_bpe_49k.json"))
    return read_store(spark, target, dictionary, ids=False)
