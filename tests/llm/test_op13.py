import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.llm import bpe_automaton as A
from lakeloom.llm import token_alignment as T
from tests.llm import cases

A_PATH, B_PATH = C.tokenizer_file("byte_bpe_50k.json"), C.tokenizer_file("piece_bpe_32k.model")
HARD = [
    (20, "a  double   spaced\ttext \n\n with runs"),
    (21, "tr▁icky ▁ marks"),
    (22, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (23, "漢字かな🙂🏽 mixed naïve Ünïcödé, é combining"),
    (24, "x" * 3000 + " " + "ab" * 2000),
    (25, "    "),
    (26, "\x00\x01 nul"),
    (27, "ends with space "),
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def spell(libraries, text):
    """Tokens of both sides as (id, bytes), by the libraries alone; empty where a side doesn't spell the text."""
    from lakeloom.llm.bpe_automaton import byte_symbols

    t, sp = libraries
    if not text:
        return [], []
    symbols = byte_symbols()
    a = [(i, bytes(symbols[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def brute(libraries, rows):
    """The report by ranges of every token: links are searched token by token, without windows."""
    made, docs = [], Counter()
    for key, text in rows:
        ranges = []
        for side in spell(libraries, text):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(out)
        a, b = ranges
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], [0, 0]
        for cut in cuts:
            said = []
            for side in (0, 1):
                low = at[side]
                while at[side] < len(ranges[side]) and ranges[side][at[side]][2] <= cut:
                    at[side] += 1
                said.append(",".join(str(i) for i, _, _ in ranges[side][low : at[side]]))
            groups.append("|".join(said))
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        docs.update(set(links))
        made.append((key, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (i, j), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return cases.keyed((key, na, nb, g, len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), sha) for key, na, nb, g, links, sha in made)


def collected(df):
    return cases.keyed(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_query_equals_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in cases.documents(spark).collect()]
    assert collected(T.op13_token_alignment(spark, "/root/testdata/sf0.001")) == brute(libraries, rows)


def test_hard_cases(spark, libraries):
    rows = [*cases.TEXTS, *HARD]
    df = cases.frame(spark, rows)
    got = collected(T.alignment_report(df, A_PATH, B_PATH))
    assert got == brute(libraries, rows)
    assert {r[0] for r in got if r[-1] == ""} >= {3, 4, 21}
    assert T.alignment_report(df.limit(0), A_PATH, B_PATH).count() == 0


def test_random_texts(libraries):
    rng, at = random.Random(3), T.aligner(A_PATH, B_PATH)
    letters = "abcdeinrst     \n\t.,'éüß漢🙂▁\xa0"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        a, b = spell(libraries, text)
        assert at.encode(text) == ([i for i, _ in a], [i for i, _ in b])
        # windows change nothing: the same as one window of the whole text
        if a:
            ids = at.encode(text)
            whole, cut = at.align([np.array([*ids[0], *(i | T.B_SIDE for i in ids[1])], np.int32).tobytes()]), at.aligned(*ids)
            assert ";".join(w[1] for w in cut) == whole[0][1] and b"".join(w[0] for w in cut) == whole[0][0]
            assert T.group_ends(cut, 0).tolist() == T.group_ends(whole, 0).tolist() and T.group_ends(cut, 1)[-1] == len(b)


def test_fast_and_linear_encoding_agree():
    at, rng = T.aligner(A_PATH, B_PATH).a, random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice((chr(rng.randrange(0xD800)), chr(rng.randrange(0x400)), " ", "\n", "a", "1", "'s")) for _ in range(rng.randint(0, 30)))
        assert at.fast.encode_ordinary(text) == A.encode(text, A_PATH, specials=False)


def test_memory_of_windows_may_be_small(libraries, monkeypatch):
    monkeypatch.setattr(A, "MEMO_BYTES", 2000)
    monkeypatch.setattr(T, "MEMO_TOKENS", 5)
    at = T.Aligner(A_PATH, B_PATH)
    text = "the same words and the same words again, unbelievablyunbrokenwordshere the same"
    ids = at.encode(text)
    for _ in range(3):
        assert at.aligned(*ids) == T.aligner(A_PATH, B_PATH).aligned(*ids)
    assert len(at.memo.young) + len(at.memo.old) < 6


def test_arrays_of_documents(spark):
    df = cases.frame(spark, [(1, "unbelievable tokens here"), (2, None)])
    one, none = sorted(T.align_documents(df, A_PATH, B_PATH).collect(), key=lambda r: r.doc_id)
    assert none.a_ids == none.b_ends == none.pairs == []
    assert one.a_ends[-1] == len(one.a_ids) and one.b_ends[-1] == len(one.b_ids) and len(one.a_ends) == len(one.b_ends)
    assert {T.pair_ids(p)[0] for p in one.pairs} == set(one.a_ids) and sum(one.times) >= len(one.a_ids)
    pair = T.align_documents(df, A_PATH, B_PATH).select(F.explode("pairs").alias("p")).select("p", *T.pair_ids(F.col("p"))).collect()
    assert all(T.pair_ids(p) == (a, b) for p, a, b in pair)


@pytest.mark.parametrize("most", [0, 1, 40, 10_000])
def test_counts_by_broadcast_and_by_shuffle_agree(spark, most):
    df = cases.documents(spark).limit(40)
    aligned = C.saved(T.summaries(df, A_PATH, B_PATH))
    frequent, rest = T.split_counts(C.saved(T.document_counts(aligned)), most)
    assert frequent.count() <= most and (rest is None) == (most == 10_000)
    got, want = (sorted(map(tuple, T.judge_links(aligned, m).collect())) for m in (most, 1_000_000))
    assert got == want


def test_new_windows_of_several_texts_are_aligned_at_once(monkeypatch):
    texts = [f"{w} naïve {w}s  of {i}\n\n{w}" for i, w in enumerate(["plain", "\tüber", "漢字", "x" * 2500, "", None, " ", "</s>"] * 6)]
    texts += ["", None]
    at, one = T.Aligner(A_PATH, B_PATH), T.Aligner(A_PATH, B_PATH)
    calls, align = [], at.align
    monkeypatch.setattr(at, "align", lambda keys: calls.append(len(keys)) or align(keys))
    got = [(k, a.tolist(), b.tolist(), w) for k, a, b, w in T.aligned_together(at, list(range(len(texts))), texts)]
    want = [(k, *one.encode(t), one.aligned(*one.encode(t))) for k, t in enumerate(texts)]
    assert got == want and len(calls) == 1
    monkeypatch.setattr(T, "TOGETHER", 1)
    assert [(k, a.tolist(), b.tolist(), w) for k, a, b, w in T.aligned_together(at, list(range(len(texts))), texts)] == want
