import zlib
from collections import Counter

import numpy as np

from lakeloom.llm import language_profiles as A
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def slow_ngrams(text):
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    joined = f" {' '.join(words)} "
    out.update(joined[i : i + 2] for i in range(len(joined) - 1))
    return out


def key(gram):
    k = 0
    for c in gram:
        k = k << 21 | ord(c)
    return k


def test_ngrams_equal_a_plain_count():
    for text in ("Hello, World! a", "Ünï 漢字 x1y", None, "123", " ab\nc "):
        keys, n = A.counted(A.ngrams(text)) if len(A.ngrams(text)) else ([], [])
        want = Counter({key(g): c for g, c in slow_ngrams(text).items()}) if any(ch.isalpha() for ch in text or "") else Counter()
        assert dict(zip(map(int, keys), map(int, n), strict=True)) == dict(want)


def test_profiles_equal_a_plain_count(spark):
    docs = cases.documents(spark)
    got = A.train_profiles(docs, size=50)
    want: dict = {}
    for r in docs.collect():
        want.setdefault(r.lang, Counter()).update({key(g): n for g, n in slow_ngrams(r.text).items()})
    for lang, c in want.items():
        assert got[lang].tolist() == [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50]]


def test_distance_equals_the_definition():
    p = {"aa": np.array([key("a"), key("b"), key("c")]), "bb": np.array([key("x"), key("b")])}
    model = A.Profiles(p, size=10, compared=5)
    text = "b b a"  # own list: "b", " b", "b ", " b ", then " a" ... by count and key
    keys, n = A.counted(A.ngrams(text))
    own = keys[np.argsort(-n, kind="stable")[:5]].tolist()
    far = {lang: sum(abs(i - prof.tolist().index(k)) if k in prof else 10 for i, k in enumerate(own)) for lang, prof in p.items()}
    best = min(sorted(far), key=far.get)
    assert model.predict(text) == (best, 1 - far[best] / (10 * len(own)))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in cases.documents(spark, SF).collect()}
    held = A.op9_language_profiles(spark, SF).where("held_out").collect()
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in truth)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97


def test_hard_cases(spark):
    df = cases.frame(spark)
    profiles = A.train_profiles(df)
    rows = A.predict_languages(df, profiles).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 3, 4, 5)} == {1: "en", 3: "und", 4: "und", 5: "und"}
    assert A.predict_languages(df.limit(0), profiles).count() == 0
    none = A.train_profiles(df.limit(0))
    assert none == {} and {r.lang_pred for r in A.predict_languages(df, none).collect()} == {"und"}
