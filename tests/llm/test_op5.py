import zlib

import numpy as np
import pytest

from lakeloom.llm import _common as C
from lakeloom.llm import token_shards as A
from tests.llm import cases

PATH = C.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def wanted(library, rows):
    at, out = 0, []
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    for i, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u4").tobytes()))):
        out.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


def test_documents(spark, library):
    rows = [(r.doc_id, r.text) for r in cases.documents(spark).collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in A.op5_token_shards(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == wanted(library, rows)


def test_encoder_equals_the_library(library):
    import random

    rng, words = random.Random(6), A.encoder(PATH)
    letters = "abcdefgh aaaaaethinrsTRESVMLD  \n\t\x1c\x1d éüßÉÀİΣ'''stll123²#%&漢字🙂́\xa0\x85"
    for i in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        s = s[:10] + "<|endoftext|>" + s[10:] if i % 9 == 0 else s
        assert words.encode(s) == np.array(library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_code_point_equals_the_library(library):
    """Alone, between letters, and before and after a capital."""
    words = A.encoder(PATH)
    texts = [t for i in range(0x20000) if not 0xD800 <= i < 0xE000 for c in [chr(i)] for t in (c, f"a{c}b", f"{c}X {c}")]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        for t, want in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert words.encode(t) == np.array(want.ids, "<u4").tobytes(), ascii(t)


def test_the_dictionary_does_not_depend_on_the_order_of_rows(spark):
    docs = cases.documents(spark)
    same = [A.train_dictionary(d, PATH, 1, "doc_id", "text", sample=150) for d in (docs, docs.orderBy(docs.doc_id.desc()), docs.repartition(5))]
    assert same[0] and len(set(same)) == 1


def test_equal_ids_and_one_bucket_a_task(spark, library):
    rows = [(7, f"text {i}") for i in range(40)] + [(i, "x") for i in range(100, 140)]
    target = C.shared_folder(spark)
    dictionary = A.write_store(cases.frame(spark, rows), target, PATH, buckets=6)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in A.read_store(spark, target, dictionary).collect()), key=lambda r: r[1])
    assert got == wanted(library, rows)
    assert spark.read.parquet(target).select("bucket").distinct().count() >= 3


def test_hard_cases_and_access_by_id(spark, library):
    df, target = cases.frame(spark), C.shared_folder(spark)
    dictionary = A.write_store(df, target, PATH, buckets=3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in A.read_store(spark, target, dictionary).collect()), key=lambda r: r[1])
    assert got == wanted(library, cases.TEXTS)
    some = A.read_store(spark, target, dictionary, doc_ids=[4, 7]).collect()
    assert sorted(r.doc_id for r in some) == [4, 7] and all(r.ids[-1] == 1 for r in some)
    with pytest.raises(Exception, match="needs dictionary"):
        A.read_store(spark, target, dictionary + b"x").collect()


def test_trained_dictionary_and_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_DOCS", 7)
    docs, target = cases.documents(spark), C.shared_folder(spark)
    dictionary = A.write_store(docs, target, PATH, buckets=2)
    assert dictionary
    store = spark.read.parquet(target)
    assert store.count() >= 200 // 7 and {r.dictionary_sha256 for r in store.select("dictionary_sha256").distinct().collect()} != {""}
    assert A.read_store(spark, target, dictionary).count() == 200


def test_empty_table(spark):
    target = C.shared_folder(spark)
    dictionary = A.write_store(cases.frame(spark).limit(0), target, PATH)
    assert dictionary == b"" and A.read_store(spark, target, dictionary).count() == 0
