import random

from lakeloom.llm import bm25_decontamination as A
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def slow_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_in_order_equals_a_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert A.in_order(a, b) == slow_in_order(a, b)


def test_copies_with_changed_words(spark):
    """One word in 12 changed, at random places or at every place in turn: nine of ten copies are found at least, and no text of other words."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ix, rng = A.build_index(items), random.Random(4)
    docs = [r.text for r in cases.documents(spark, SF).limit(400).collect()]
    filler = lambda: " ".join(A.words_of(rng.choice(docs))[:150])
    for every, least in ((30, 0.97), (12, 0.9)):
        found = n = 0
        for key, text in items:
            words = text.split()
            for i in range(rng.randrange(every), len(words), every):
                words[i] = f"new{i}"
            found += key in [m[0] for m in A.matches(ix, f"{filler()} {' '.join(words)} {filler()}")]
            n += 1
        assert found >= least * n, (every, found, n)
    found = n = 0
    for key, text in items[:20]:
        for i in range(len(text.split())):
            words = text.split()
            words[i] = "changed"
            found += key in [m[0] for m in A.matches(ix, " ".join(words))]
            n += 1
    assert found >= 0.97 * n, (found, n)
    for key, text in items:  # the same words in another order are another text
        words = text.split()
        rng.shuffle(words)
        if len(words) > 20:
            assert key not in [m[0] for m in A.matches(ix, " ".join(words))]


def test_every_copy_is_found_and_clean_documents_are_not(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    squeezed = {k: " ".join(A.words_of(t)) for k, t in items.items()}
    texts = {r.doc_id: r.text for r in cases.documents(spark, SF).collect()}
    want = {(r.doc_id, k) for r in cases.documents(spark, SF).collect() for w in [" ".join(A.words_of(r.text))] for k, t in squeezed.items() if t in w}
    got = {(r.doc_id, r.item_id) for r in A.op8_bm25_decontamination(spark, SF).collect()}
    assert want and want <= got
    for doc, item in got - want:  # near copies only
        words, whole = A.words_of(texts[doc]), A.words_of(items[item])
        assert slow_in_order(whole, words) >= A.OVERLAP * len(whole)


def test_block_max_wand_equals_scoring_everything(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 3)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [vocabulary[min(59, int(rng.expovariate(0.08)))] for _ in range(n)]
    ix = A.build_index([(i, " ".join(words(rng.randint(5, 90)))) for i in range(80)])
    found = 0
    for _ in range(300):
        own = [ix.terms[w] for w in dict.fromkeys(words(rng.randint(1, 60))) if w in ix.terms]
        scores: dict = {}
        for t in own:
            for p, w in zip(ix.parts[t], ix.weights[t], strict=True):
                scores[p] = scores.get(p, 0) + w
        for threshold in (0.2, 0.5, 0.7):
            want = sorted(p for p, v in scores.items() if v >= threshold - 1e-9)
            assert sorted(p for p, _ in A.block_max_wand(ix, own, threshold)) == want
            found += len(want)
    assert found > 100


def test_promising_windows_lose_nothing():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(4, 150)))) for i in range(60)]
    ix = A.build_index(items)
    for _ in range(100):
        i = rng.randrange(60)
        noise = lambda: [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 400))]
        text = " ".join([*noise(), items[i][1], *noise()])
        assert i in [m[0] for m in A.matches(ix, text)]


def test_sums_by_sorting_equal_sums_in_an_array(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    ix = A.build_index([(i, " ".join(f"w{k}" for k in rng.integers(0, 200, 40))) for i in range(50)])
    terms = np.array([ix.terms.get(f"w{k}", -1) for k in rng.integers(0, 220, 3000)])
    in_array = A.promising(ix, terms, 0.5).tolist()
    monkeypatch.setattr(A, "DENSE", 0)
    assert in_array and in_array == A.promising(ix, terms, 0.5).tolist()


def test_hard_cases(spark):
    items = spark.createDataFrame([(1, "What is the colour of the sky on a clear day? It is blue as everyone knows."), (2, None), (None, "one two"), (3, ""), (4, "What is the colour of the sky on a clear day? It is blue as everyone knows.")], "item_id long, text string")
    hit = "Before. WHAT is the colour of the sky, on a clear day? It is blue as everyone knows. After. "
    df = cases.frame(spark, [*cases.TEXTS, (10, hit), (10, hit), (11, "filler words all over here " * 3000 + hit), (12, "What is the colour of the sky on a clear day? Nobody can tell."), (14, "Of all that is known the colour of the sky is what people ask on a clear day."), (13, "say one two now")])
    got = cases.keyed((r.doc_id, r.item_id) for r in A.contaminated(df, items).collect())
    assert got == cases.keyed([(10, 1), (10, 1), (10, 4), (10, 4), (11, 1), (11, 4), (13, None)])
    several = A.contaminated(df, items, index_bytes=60)
    assert cases.keyed((r.doc_id, r.item_id) for r in several.where("item_id is not null").collect()) == [g for g in got if g[1]]
    assert A.contaminated(df.limit(0), items).count() == 0 == A.contaminated(df, items.limit(0)).count()
    for size in (A.INDEX_BYTES, 60):
        counted = A.count_leaks(df, items.where("item_id is not null"), "held", index_bytes=size).select("doc_id", "held").collect()
        assert sorted((r.doc_id, r.held) for r in counted if r.held) == [(10, 2), (10, 2), (11, 2)] and len(counted) == df.count()
