"""The near-duplicate stage against all pairs' Jaccard similarity."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import near_copies as A
from lakeloom.llm import pipeline as P
from tests.llm import cases


def plain(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """The smallest id of each component of pairs with Jaccard 0.8 or more, by all pairs."""
    rows = sorted(rows)
    sets = [plain(t) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    return [rows[k][0] for k in range(len(rows)) if up[k] == k]


def edited():
    """Copies with one to five words of 25 to 300 changed, on both sides of the limit, and a sentence that many texts hold."""
    rng, rows = random.Random(3), []
    for _ in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((3, 5, 25, 60, 300)))]
        rows.append(" ".join(words) + rng.choice(("", " this line stands below many of the texts here")))
        for changed in (1, 2, 5):
            copy = rows[-1].split()
            for _ in range(changed):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [0, 5, 200_000])
def test_stage_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(A, "HOT", max(hot, 1))
    monkeypatch.setattr(A, "SAMPLED", 1)
    monkeypatch.setattr(A, "FREQUENT", 4 if hot else 10**9)
    rows = edited()
    want = kept(rows)
    assert 40 < len(want) < len(rows) - 20
    assert sorted(r.doc_id for r in P.dedup_stage(spark, cases.frame(spark, rows), "").collect()) == want


def test_documents_equal_all_pairs(spark):
    docs = cases.documents(spark)
    want = kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in P.dedup_stage(spark, docs, "").collect()) == want


def test_linked_sizes_are_in_neighbouring_bands(spark):
    df = spark.range(1, 3000).selectExpr("id as a", "ceil(id * 5 / 4) as b", "cast(floor(id * 5 / 4) as long) as c")
    far = df.where((F.abs(A.size_band("a") - A.size_band("c")) > 1)).count()
    assert far == 0
