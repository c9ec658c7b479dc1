import numpy as np

from lakeloom.llm import factorisation_machine as A
from tests.llm import cases


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = A.op6_factorisation_machine(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in scored])
    assert len(scored) > 80 and right >= 0.93
    assert all(0 <= r.score <= 1 for r in scored)


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = A.Model(0.1, rng.normal(size=40), rng.normal(size=(40, 3)))
    x = np.arange(15)
    v = A.values(len(x))
    pairs = sum(model.vectors[x[i]] @ model.vectors[x[j]] * v[i] * v[j] for i in range(15) for j in range(i))
    assert abs(model.score(x) - 1 / (1 + np.exp(-(0.1 + model.weights[x] @ v + pairs)))) < 1e-12


def test_most_frequent_counts_words_that_first_come_late():
    words = [*"one two three four five six seven eight".split(), *["junk"] * 92]
    at = A.STATISTICS.index("most_frequent")
    assert A.statistics(" ".join(words), words, None)[at] == 0.92
    assert A.statistics("", [], None)[at] == 0
    assert A.BUCKETS + at * A.BINS + int(0.92**0.5 * A.BINS) in A.inputs(" ".join(words), None)


def test_hard_cases(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    model = A.train(docs, labels)
    rows = A.score(docs, model).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and by[3] == by[4]
    assert A.score(docs.limit(0), model).count() == 0
    none = A.train(docs.limit(0), labels.limit(0))
    assert {r.score > 0 for r in A.score(docs, none).collect()} == {True}


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    docs = cases.documents(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.unionByName(labels.limit(20))
    same = [A.train(d, m, rows=40) for d, m in ((docs, labels), (docs.repartition(7), labels.orderBy(labels.doc_id.desc())))]
    assert same[0].bias == same[1].bias and (same[0].vectors == same[1].vectors).all()
