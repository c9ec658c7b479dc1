"""The pipeline against brute force, and each stage on hard rows."""

import hashlib

import pytest

from lakeloom.llm import _common as C
from lakeloom.llm import bm25_decontamination, language_profiles
from lakeloom.llm import pipeline as P
from tests.llm import cases
from tests.llm.test_near_copies import kept

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(C.tokenizer_file("byte_bpe_50k.json"))
    docs = sorted(cases.documents(spark).collect(), key=lambda r: r.doc_id)
    model = language_profiles.Profiles(language_profiles.train_profiles(cases.documents(spark)))
    docs = [r for r in docs if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= P.LEAST_LANGUAGE_SCORE]
    stay = set(kept([(r.doc_id, r.text) for r in docs]))
    docs = [r for r in docs if r.doc_id in stay]
    ix = bm25_decontamination.build_index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    docs = [r for r in docs if not bm25_decontamination.matches(ix, r.text)]
    texts = {r.doc_id: r.text for r in docs}
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(got) == set(texts) and len(texts) < 200
    for i, text in texts.items():
        if "@" not in text and not any(c.isdigit() for c in text):
            ids = library.encode(text, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_bear_hard_rows(spark, k):
    stage, docs = P.STAGES[k][1], cases.frame(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=repr)
    whole = sorted((i for i, _ in cases.TEXTS), key=repr)
    assert ids == {0: [1, 2, 6, 6, 7, 8, None], 1: [1, 3, 6, 7, 8, None], 2: whole, 3: whole}[k]
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_of_equal_rows_one_stays(spark):
    rows = [(6, "repeated row"), (6, "repeated row"), (None, "null id"), (None, "null id"), (9, "null id")]
    assert sorted(r.doc_id for r in P.dedup_stage(spark, cases.frame(spark, rows), SF).collect()) == [6, 9]
