import hashlib
import random

import pytest

from lakeloom.llm import _common as C
from lakeloom.llm import bpe_automaton as A
from tests.llm import cases

PATH = C.tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_equals_the_library_on_random_texts(library):
    rng = random.Random(5)
    letters = "abcdefghijklmnop aaaaaethinrs  \n\t\x1c\x1d éüß'stll123#%&漢字🙂🏽́\xa0\x85"
    for i in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        s = s[:10] + "<|endoftext|>" * rng.randint(0, 2) + s[10:] if i % 5 == 0 else s
        s = rng.choice("aeht ") * rng.randint(1, 60) + s if i % 7 == 0 else s
        ids = library.encode(s, add_special_tokens=False).ids
        assert A.encode(s, PATH) == ids
        assert A.automaton(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_of_words_is_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(A, "MEMO_BYTES", 1000)
    for _, t in cases.TEXTS:
        assert A.encode(t or "", PATH) == library.encode(t or "", add_special_tokens=False).ids
    memo = A._memo(PATH)
    assert len(memo.young) + len(memo.old) < 10
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    assert A.encode(long, PATH) == library.encode(long, add_special_tokens=False).ids
    assert long not in memo.young and long not in memo.old


def test_special_tokens_as_text(library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    for s in ("<|endoftext|>", " a<|endoftext|>b", "x <|endoftext|><|endoftext|>"):
        assert A.encode(s, PATH, specials=False) == plain.encode(s, add_special_tokens=False).ids


def test_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in cases.documents(spark).collect()}
    for r in A.op4_bpe_automaton(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_hard_cases(spark, library):
    df = cases.frame(spark)
    got = cases.keyed((r.doc_id, list(r.ids), r.decoded) for r in A.encode_documents(df, PATH).collect())
    assert got == cases.keyed((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in cases.TEXTS)
    assert A.encode_documents(df.limit(0), PATH).count() == 0
