import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lakeloom.llm import license_scan as A
from tests.llm import cases


def slow_best(text, threshold, model=A.Templates(A.TEMPLATES)):
    """Best template of a text by dense vectors."""
    c = Counter(re.findall(A.WORD, text.lower()))
    v = {w: n * model.idf.get(w, model.unknown) for w, n in c.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1
    dots: dict = {}
    for number, name, word, share, _ in model.rows:
        dots[number, name] = dots.get((number, name), 0) + share * v.get(word, 0)
    score, name = max(((round(d / norm, 6), n) for (_, n), d in dots.items()), key=lambda x: (x[0], [-ord(ch) for ch in x[1]]))
    return (name, score) if score >= threshold else None


def test_notices_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in cases.documents(spark, sf).collect()}
    for r in A.op10_license_scan(spark, sf).collect():
        lines = [x for line in re.split("\r\n|[\n\r\v\f\x85\u2028\u2029]", texts[r.doc_id]) for x in [slow_best(line, A.NOTICE_SCORE)] if x]
        if r.license_from == "notice":
            best = max(lines, key=lambda x: (x[1], [-ord(ch) for ch in x[0]]))
            assert r.license == best[0] and abs(r.license_score - best[1]) < 2e-6
        elif r.license_from != "file":
            assert not lines


def test_query_equals_its_sql(spark):
    from tests.oracle import compare

    assert compare(spark, "op10", A.op10_license_scan, A.oracle(), "/root/testdata/sf0.01") == ""


ROWS = [
    ("a/LICENSE", A.bodies()["MIT"][0], 1),
    ("a/b/x.py", "code here", 2),
    ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0 (the \"License\");\nlong code " + "with many words that are no licence at all " * 9, 3),
    ("z/q", "none", 4),
    ("top", "x", 5),
    (None, "All rights reserved.", 6),
    (None, "no path and no notice", 7),
    ("a/b/n", None, 8),
    ("a/b/e", "", 9),
    ("a/b/e", "", 9),
    ("a/b/COPYING", A.bodies()["MPL-2.0"][0], 10),
    ("a/b/h.c", "SPDX-License-Identifier: ISC", 12),
    ("long/doc", "word " * 100_000 + "\nReleased under the MIT License.", 11),
]


def test_inheritance_and_hard_cases(spark):
    df = spark.createDataFrame(ROWS, "path string, text string, key int").withColumn("dir", F.lit("mine")).withColumn("license", F.lit("old"))
    out = A.scan(df)
    assert set(out.columns) == {*df.columns, "license_score", "license_from"}
    got = {r.key: (r.license, r.license_from) for r in out.collect()}
    assert got == {
        1: ("MIT", "file"), 2: ("MPL-2.0", "/a/b"), 3: ("Apache-2.0", "notice"), 4: (None, None), 5: (None, None), 6: ("Proprietary", "notice"),
        7: (None, None), 8: ("MPL-2.0", "/a/b"), 9: ("MPL-2.0", "/a/b"), 10: ("MPL-2.0", "file"), 11: ("MIT", "notice"), 12: ("ISC", "notice"),
    }
    assert out.count() == len(ROWS) and A.scan(df.limit(0)).count() == 0


def test_whole_licences_are_inherited(spark):
    whole = {name: " ".join(texts[0].split()) for name, texts in A.bodies().items()}  # wrapped otherwise than the templates
    names = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "ISC", "GPL-3.0", "AGPL-3.0", "LGPL-2.1"]
    rows = [r for n in names for r in ((f"{n}/LICENSE", f"Copyright (c) 2019 Jane Roe and others\n\n{whole[n]}"), (f"{n}/src/x.py", "code"))]
    prose = "The use of this and that is in the hands of all who work for it, and to ask for a license or permission of any of them is not to be done. " * 40
    rows += [("prose/a", prose), ("prose/b", "code")]
    got = {r.path: (r.license, r.license_from) for r in A.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"{n}/LICENSE": (n, "file") for n in names} | {f"{n}/src/x.py": (n, f"/{n}") for n in names} | {"prose/a": (None, None), "prose/b": (None, None)}


HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""


def test_headers_do_not_speak_for_directories(spark):
    rows = [("r/a.py", HEADER), ("r/b.py", "code"), (None, HEADER)]
    got = [(r.path, r.license, r.license_from) for r in A.scan(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert sorted(got, key=repr) == sorted([("r/a.py", "Apache-2.0", "notice"), ("r/b.py", None, None), (None, "Apache-2.0", "notice")], key=repr)


def test_lines_without_the_word_licence(spark):
    lines = {"Dedicated to CC0 1.0": "CC0-1.0", "CC0 1.0 Universal": "CC0-1.0", "Published by the Free Software Foundation, either version 3 or any later version": "GPL-3.0", "Mozilla Public, v. 2.0": "MPL-2.0"}
    got = {r.text: r.license for r in A.scan(spark.createDataFrame([(t, t) for t in lines], "path string, text string")).collect()}
    assert got == lines


def test_no_text_in_reach_is_left_out(spark):
    """Whole licences with words dropped, repeated and added: each that scores is in reach, and prose isn't."""
    import random

    rng, model = random.Random(1), A.Templates(A.bodies(), 0)
    texts = []
    for body in A.bodies().values():
        words = body[0].split()
        for kept in (0.3, 0.6, 0.9):
            for added in (0, len(words) // 4, len(words)):
                texts.append(" ".join([w for w in words if rng.random() < kept] + [f"other{rng.randrange(50)}" for _ in range(added)] + [rng.choice(words)] * rng.randrange(30)))
    prose = ["the work of this and that is in the hands of all who use it " * n for n in (1, 30, 3000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts + prose], "t string")
    reach = {r.t for r in df.where(A.in_reach(F.col("t"), model, A.FILE_SCORE)).collect()}
    scored = [t for t in texts if slow_best(t, A.FILE_SCORE, model)]
    assert 30 < len(scored) < len(texts) and set(scored) <= reach and not reach & {"", None}


def test_no_line_in_reach_is_left_out(spark):
    """Lines of template words and others: each that scores is in reach."""
    import random

    rng, model = random.Random(7), A.Templates(A.TEMPLATES)
    vocabulary = sorted(model.idf)
    lines = [" ".join(rng.choice(vocabulary) if rng.random() < share else f"other{rng.randrange(50)}" for _ in range(rng.randint(1, 14))) for share in (0.5, 0.8, 1.0) for _ in range(300)]
    lines += [" ".join(w for w in t.lower().split() if rng.random() < 0.8) + " x-license" * rng.randint(0, 1) for group in A.TEMPLATES.values() for t in group for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    reach = {r.t for r in df.where(A.in_reach(F.col("t"), model, A.NOTICE_SCORE)).collect()}
    scored = [t for t in lines if slow_best(t, A.NOTICE_SCORE)]
    assert len(scored) > 100 and set(scored) <= reach


def test_null_source_or_language_is_a_null_path(spark):
    df = spark.createDataFrame([("s", "en", 1), (None, "en", 1), ("s", None, 1), ("s", "en", None)], "source string, lang string, doc_id long")
    paths = [r[0] for r in df.select(A.document_path(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))).collect()]
    assert paths == ["s/en/1", None, None, None]


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Arrow|Pandas", A.op10_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString())


def test_version_numbers_are_no_notice_and_identifiers_are(spark):
    said = {
        "This is version 2.0": None,
        "version 2.0": None,
        "Version 3": None,
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
        "SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "Mozilla Public License Version 2.0": "MPL-2.0",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    }
    df = spark.createDataFrame([(i, f"first line\n{t}\nlast line", f"d{i}/f") for i, t in enumerate(said)], "doc_id int, text string, path string")
    got = {r.doc_id: r.license for r in A.scan(df).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
