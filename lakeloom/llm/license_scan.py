"""Operator 10 [native]: licence detection by sparse TF-IDF cosine, and inheritance down directories.

DataFrame functions only.

1. Notices: each line of a text is a header candidate. Distinct lines are scored once: words become rows
   (word, weight), are joined to the templates' words, and the products are summed by line and template;
   divided by both norms this is the cosine. A text's licence is that of its best line.
2. Licence files: a whole text is scored in the same way against whole licences (licences/*.txt); one at
   or over FILE_SCORE is a licence file and speaks for its directory. Headers are like none of those.
3. Inheritance: every directory takes the licence of the nearest directory at or above it that has a
   licence file, found by joining its ancestor paths; a text without a notice takes its directory's.

Word weights are inverse document frequencies over the templates; words that no template has weigh
as the rarest ones and only lengthen a line's norm. Among whole licences a word that all of them have
weighs nothing, so that prose isn't like them by its common words. Templates are a fixed, small list, so
their words may be broadcast.

Most lines and texts are told to be out of reach in their own row, before their words become rows: see
in_reach(). What is in reach is scored in full.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Sentences that licences ask to be put in headers or begin with, by SPDX identifier (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "you may not use this file except in compliance with the License"],
    "MIT": ["Released under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "BSD-3-Clause": ["Licensed under the 3-Clause BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Licensed under the 2-Clause BSD License", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "EPL-2.0": ["Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "Proprietary": ["All rights reserved", "Proprietary and confidential"],
    # what licences share with other texts: a line that is nearest to these is no notice
    "-": ["Version 2.0", "Version 2", "Version 2.1", "Version 3", "Version 3.0", "Version 1.0"],
}
#: The name of templates that are no licence.
NO_LICENCE = "-"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Cosine from which a line is a notice, and a whole text a licence file.
NOTICE_SCORE, FILE_SCORE = 0.6, 0.7
#: Slots of the table by which in_reach() looks words up (a power of two); template words that share a slot only widen its bound.
SLOTS = 16384


def bodies() -> dict[str, list[str]]:
    """Whole licences by SPDX identifier. AGPL-3.0 is GPL-3.0 under its own name, which tells the two apart."""
    found = {f.stem: [f.read_text("utf-8")] for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    affero = found["GPL-3.0"][0].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    return found | {"AGPL-3.0": [affero.replace("29 June 2007", "19 November 2007")]}


class Templates:
    """Weights of the template words, and each template's vector divided by its norm."""

    def __init__(self, templates: dict[str, list[str]], base: float = 1):
        texts = [(name, Counter(re.findall(WORD, t.lower()))) for name, group in sorted(templates.items()) for t in group]
        licences = [c for name, c in texts if name != NO_LICENCE]  # what is no licence weighs nothing in others
        df = Counter(w for c in licences for w in c)
        self.idf = {w: base + math.log((1 + len(licences)) / (1 + df[w])) for _, c in texts for w in c}
        self.unknown = base + math.log(1 + len(licences))
        self.rows = []
        for number, (name, c) in enumerate(texts):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.rows += [(number, name, w, n * self.idf[w] / norm, self.idf[w]) for w, n in sorted(c.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        """(template, license, word, share, idf) from one literal."""
        rows = [dict(zip(("template", "license", "word", "share", "idf"), r, strict=True)) for r in self.rows]
        kind = "array<struct<template: int, license: string, word: string, share: double, idf: double>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def cosines(words: DataFrame, model: Templates) -> DataFrame:
    """(key, license, score): the best template of each key of words (key, word, n); ties go to the smaller identifier. If all n of a key are multiplied nothing changes."""
    table = F.broadcast(model.table(words.sparkSession))  # fixed size
    weight = F.col("n") * F.coalesce("idf", F.lit(model.unknown))
    weighed = words.join(F.broadcast(model.table(words.sparkSession).select("word", "idf").distinct()), "word", "left").select("key", "word", weight.alias("w"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm")).where("norm > 0")
    dots = weighed.join(table, "word").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("license").alias("license")))
    return scored.groupBy("key").agg(best.alias("best")).select("key", "best.license", (-F.col("best.less")).alias("score"))


def literal(values: list, kind: str) -> Column:
    """An array as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_value(value: Column, test: Callable[[Column], Column]) -> Column:
    """test(value), for which value is computed once however often the test names it."""
    return F.exists(F.array(value), test)


def in_reach(text: Column, model: Templates, least: float) -> Column:
    """Whether a text's cosine to some template may be `least`; false of null.

    The dot product with a template is a sum over the text's words as they come, repeats included, and so
    is s, the sum of their weights; the norm is s / sqrt(distinct words) at least. So sums over the words
    bound the cosine without counting each word: first with every word's largest share in any template,
    then, where that isn't enough, with each template's own; only what is left has its words sorted for
    the norm itself. Words are looked up by hash. Template words in one slot take the largest of their
    products and the smallest of their weights, so that the bound holds.
    """
    width, slots = 1 + max((r[0] for r in model.rows), default=0), {}
    for number, _, word, share, idf in model.rows:
        slot = slots.setdefault(xxhash.xxh64_intdigest(word, 42) % SLOTS, {"words": [], "weight": idf, "products": [0.0] * width})
        slot["words"] += [word] * (word not in slot["words"])
        slot["weight"] = min(slot["weight"], idf)
        slot["products"][number] = max(slot["products"][number], share * idf)
    entry = dict(zip(slots, range(1, 1 + len(slots)), strict=True))  # 0: words that no template has
    entries = literal([entry.get(n, 0) for n in range(SLOTS)], "int")
    members = literal([[], *(x["words"] for x in slots.values())], "array<string>")
    weights = literal([model.unknown, *(x["weight"] for x in slots.values())], "double")
    largest = literal([0.0, *(max(x["products"]) for x in slots.values())], "double")
    products = literal([[0.0] * width, *(x["products"] for x in slots.values())], "array<double>")

    def summed(found: Column, values: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda a, e: a + F.get(values, e))

    def by_template(found: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), width)
        return F.array_max(F.aggregate(F.filter(found, lambda e: e > 0), zero, lambda a, e: F.zip_with(a, F.get(products, e), lambda x, y: x + y)))

    def look_up(word: Column) -> Column:
        slot = F.get(entries, F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))
        return F.when(F.array_contains(F.get(members, slot), word), slot).otherwise(F.lit(0))

    def norm(words: Column) -> Column:
        """n² is 1 + 3 + 5 + ...: in sorted words each adds its place among its like."""
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("place"), F.lit(0.0).alias("total"))

        def add(a: Column, word: Column) -> Column:
            place = F.when(word == a["word"], a["place"] + 1).otherwise(F.lit(1))
            square = F.pow(F.get(weights, look_up(word)), F.lit(2.0))
            return F.struct(word.alias("word"), place.alias("place"), (a["total"] + square * (2.0 * place - 1)).alias("total"))

        return F.aggregate(F.sort_array(words), start, add, lambda a: F.sqrt(a["total"]))

    def test(words: Column) -> Column:
        def enough(found: Column) -> Column:
            low = F.lit(least - 1e-5) * summed(found, weights) / F.sqrt(F.size(F.array_distinct(words)))
            exact = F.lit(least - 1e-5) * norm(words)
            reaches = lambda dot: with_value(by_template(found), lambda own: (own >= dot) & (own >= exact))
            return (F.size(found) > 0) & with_value(low, lambda dot: (summed(found, largest) >= dot) & reaches(dot))

        return with_value(F.transform(words, look_up), enough)

    return F.coalesce(with_value(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), test), F.lit(False))


def counted(texts: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, word, n): counted in the tasks first, so the texts aren't moved."""
    return texts.select(key.alias("key"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))


def scan(df: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, whole: dict[str, list[str]] | None = None) -> DataFrame:
    """df's columns and license, license_score, license_from: `notice`, `file`, the path of the directory it comes from, or null.

    Null and empty texts have no notice of their own, texts of any length are read whole; a null path has
    no directory and inherits nothing; directories with several licence files take the one with the best
    score, then the smaller identifier; repeated rows repeat; columns named like the results or like
    internal ones are no problem (the former are replaced); empty tables give empty ones.
    """
    kept = [c for c in df.columns if c not in ("license", "license_score", "license_from")]
    text, path = F.col(text_col), F.col(path_col)
    header, body = Templates(templates), Templates(bodies() if whole is None else whole, 0)
    at = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("license").alias("license"))).alias("best")

    # what is in reach of a score, lines and whole texts: found in the row itself, so that texts aren't moved
    lines = F.filter(F.array_distinct(F.split(text, r"\R")), lambda line: in_reach(line, header, NOTICE_SCORE))
    units = F.concat(
        F.transform(lines, lambda line: F.struct(F.lit("line").alias("kind"), line.alias("unit"))),
        F.when(in_reach(text, body, FILE_SCORE), F.array(F.struct(F.lit("file").alias("kind"), text.alias("unit")))).otherwise(F.array()),
    )
    some = C.saved(df.where(text.isNotNull()).select(F.md5(text).alias("key"), at.alias("dir"), F.explode_outer(units).alias("u")).where("u is not null").select("key", "dir", "u.kind", F.md5("u.unit").alias("unit_key"), "u.unit"))

    def scored(kind: str, model: Templates, least: float) -> DataFrame:
        once = some.where(F.col("kind") == kind).groupBy("unit_key").agg(F.first("unit").alias("unit"))
        return C.saved(cosines(counted(once, F.col("unit_key"), F.col("unit")), model).where((F.col("score") >= least) & (F.col("license") != NO_LICENCE)))

    files = scored("file", body, FILE_SCORE)
    lines = some.where("kind = 'line'").select("key", "unit_key").distinct().join(scored("line", header, NOTICE_SCORE).withColumnRenamed("key", "unit_key"), "unit_key")
    notices = lines.groupBy("key").agg(best.alias("notice"))
    notices = notices.join(files.select("key", F.struct((-F.col("score")).alias("less"), F.col("license").alias("license")).alias("file")), "key", "full")

    found = some.where("kind = 'file' and dir is not null").select("key", "dir").distinct().join(files, "key")
    declared = found.groupBy("dir").agg(best.alias("declared"))
    dirs = df.select(at.alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))).alias("a")).select("dir", "a.*").distinct()
    nearest = above.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "declared"), "depth").alias("near"))

    # rows keep their own columns, so that those nobody asks for (the text) aren't moved
    key, own_dir, notice, file, near = (C.fresh(df, f"license_{n}") for n in ("key", "dir", "notice", "file", "near"))
    notices = C.saved(notices.select(F.col("key").alias(key), F.col("notice").alias(notice), F.col("file").alias(file)))
    nearest = C.saved(nearest.select(F.col("dir").alias(own_dir), F.col("near").alias(near)))
    with_own = df.select(*kept, at.alias(own_dir), F.md5(text).alias(key)).join(C.small(notices), key, "left").drop(key)
    joined = with_own.join(nearest, own_dir, "left")
    best = F.coalesce(file, notice, f"{near}.declared")
    came = F.when(F.col(file).isNotNull(), F.lit("file")).when(F.col(notice).isNotNull(), F.lit("notice")).when(F.col(near).isNotNull(), F.concat(F.lit("/"), F.col(f"{near}.up")))
    return joined.select(*kept, best["license"].alias("license"), (-best["less"]).alias("license_score"), came.alias("license_from"))


def document_path(*parts: Column) -> Column:
    """source/lang/doc_id; null if one of them is."""
    return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit("/"), p)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; a document's directory is its source and language."""
    docs = C.dealt(spark, sf_dir, "documents").select("doc_id", "text", document_path(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("path"))
    return scan(docs).select("doc_id", "path", "license", "license_score", "license_from")


def oracle() -> str:
    """The query in DuckDB's SQL: every line and every text is scored, none is left out beforehand."""
    tables = []
    for kind, model in (("line", Templates(TEMPLATES)), ("file", Templates(bodies(), 0))):
        rows = ", ".join(f"({n}, '{name}', '{w}', {share!r}, {idf!r})" for n, name, w, share, idf in model.rows)
        tables.append(f"SELECT '{kind}' AS kind, {model.unknown!r}::DOUBLE AS unknown, a AS template, b AS license, c AS word, d::DOUBLE AS share, e::DOUBLE AS idf FROM (VALUES {rows}) v(a, b, c, d, e)")
    return f"""
    WITH docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, source || '/' || lang AS dir, md5(text) AS key, text FROM documents),
    texts AS (SELECT key, any_value(text) AS text FROM docs WHERE text IS NOT NULL GROUP BY key),
    lines AS (SELECT DISTINCT key, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM texts),
    units AS (SELECT DISTINCT 'line' AS kind, line AS key, line AS text FROM lines UNION ALL SELECT 'file', key, text FROM texts),
    words AS (SELECT kind, key, w, count(*) AS n FROM (SELECT kind, key, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM units) GROUP BY ALL),
    templates AS ({" UNION ALL ".join(tables)}),
    known AS (SELECT DISTINCT kind, word, idf FROM templates), rare AS (SELECT DISTINCT kind, unknown FROM templates),
    weighed AS (SELECT s.kind, key, w, n * coalesce(idf, unknown) AS x FROM words s JOIN rare r ON r.kind = s.kind LEFT JOIN known k ON k.kind = s.kind AND k.word = s.w),
    norms AS (SELECT kind, key, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
    dots AS (SELECT s.kind, key, template, license, sum(x * share) AS dot FROM weighed s JOIN templates t ON t.kind = s.kind AND t.word = s.w GROUP BY ALL),
    best AS (SELECT kind, key, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (kind, key) WHERE norm > 0
             QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY round(dot / norm, 6) DESC, license) = 1),
    files AS (SELECT key, license, score FROM best WHERE kind = 'file' AND score >= {FILE_SCORE}),
    notices AS (SELECT l.key, license, score FROM lines l JOIN best b ON b.kind = 'line' AND b.key = l.line AND score >= {NOTICE_SCORE} AND license <> '{NO_LICENCE}'
                QUALIFY row_number() OVER (PARTITION BY l.key ORDER BY score DESC, license) = 1),
    declared AS (SELECT dir, license, score FROM docs JOIN files USING (key) WHERE dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
    above AS (SELECT DISTINCT dir, n AS depth, array_to_string(string_split(dir, '/')[1:n], '/') AS up FROM docs, range(0, 3) r(n) WHERE n <= len(string_split(dir, '/'))),
    nearest AS (SELECT a.dir, a.up, d.license, d.score FROM above a JOIN declared d ON a.up = d.dir QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY depth DESC) = 1)
    SELECT doc_id, path, coalesce(f.license, n.license, i.license) AS license, coalesce(f.score, n.score, i.score) AS license_score,
           CASE WHEN f.key IS NOT NULL THEN 'file' WHEN n.key IS NOT NULL THEN 'notice' WHEN i.up IS NOT NULL THEN '/' || i.up END AS license_from
    FROM docs LEFT JOIN files f ON f.key = docs.key LEFT JOIN notices n ON n.key = docs.key LEFT JOIN nearest i ON i.dir = docs.dir"""
