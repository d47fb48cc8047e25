"""Licence scans: sparse TF-IDF cosine of passages to licence templates, then inheritance from the nearest ancestor
directory with a licence file (DataFrame functions only).

Terms are runs of letters and digits in lower case. The weight of a template's term is its count times its inverse
document frequency over all documents; other terms weigh their count. A passage is a line of a file, the whole
file, or a run of adjacent lines (those without terms aside) that ends where it has as many terms as some template:
a notice wrapped over lines. Lines and runs are scored only if they hold a cue, one of the rarest terms of some template: a passage that shares
only a template's other terms can't reach the threshold (their part of the template's norm is an upper bound of
the cosine), so no match is lost. Each distinct text is scored once.

A licence file is a file a quarter of whose words are in one matching passage. It sets that passage's licence for its
directory (the whole file's before a part's, then the most similar one's); where several do, the most similar one does. A file without a licence of its own takes that of its nearest ancestor.

Cases: null and empty texts have no licence of their own; very long texts and lines are scored whole, from counts of terms; null paths lie in the root directory; ties go to the
template first by name, then to the whole file and the first line; rows that repeat give repeated results; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, salted_lookup, weighed_lookup

THRESHOLD = 0.7
#: Share of a file's words that its best passage must have for a licence file.
FILE_SHARE = 0.25
LETTER, SEPARATORS = r"[a-z0-9\x{80}-\x{10FFFF}]", r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Notices and short texts of well-known licences.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("All-Rights-Reserved", "All rights reserved."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms_of(text: str) -> Counter:
    """The terms of a template with their counts."""
    return Counter(x for x in re.split(r"[^a-z0-9\u0080-\U0010FFFF]+", text.lower()) if x)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each term of the templates occurs; one row a term reaches the driver."""
    held = docs.select(F.explode_outer(F.array_intersect(F.array_append(terms(F.coalesce("text", F.lit(""))), F.lit("")), F.array(*map(F.lit, ["", *vocabulary])))).alias("t"))
    counts = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def weigh(templates: list[tuple[str, str]], n: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[int, str, str, float]]]:
    """Inverse document frequencies, and the unit vectors of the templates as (number, licence, term, weight)."""
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, text in templates for t in terms_of(text)}
    rows = []
    for k, (name, text) in enumerate(templates):
        w = {t: c * idf[t] for t, c in terms_of(text).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(k, name, t, x / norm) for t, x in w.items()]
    return idf, rows


def cues(vectors: list[tuple[int, str, str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Of each template its rarest terms, so many that the rest is less than ``threshold`` of its norm."""
    found = set()
    for k in {v[0] for v in vectors}:
        rest = 1.0
        for _, t, w in sorted((-idf[t], t, w) for n, _, t, w in vectors if n == k):
            if rest < threshold**2 - 1e-9:
                break
            found.add(t)
            rest -= w * w
    return sorted(found)


def _weighed(counted: DataFrame, idf: dict[str, float]) -> DataFrame:
    """Rows of (term, tf) with the weight ``w``. The table of idf has a row a term of the templates."""
    weights = F.broadcast(counted.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {x!r}D)" for t, x in idf.items()) + " AS t(term, idf)"))
    return counted.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0))).drop("idf")


def _units(spark: SparkSession, vectors: list[tuple[int, str, str, float]]) -> DataFrame:
    return F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, '{name}', '{t}', {u!r}D)" for k, name, t, u in vectors) + " AS t(n, licence, term, u)"))


#: Terms of a line, as a multiple of the longest template's, from which it is not carried beside its neighbours.
GIANT = 16


def _runs(lines: DataFrame, cue: str, lengths: list[int], idf: dict[str, float], vectors: list[tuple[int, str, str, float]], threshold: float) -> DataFrame:
    """Term counts (digest, k, more, term, tf) of passages of several of ``lines`` (digest, k, part) that hold a cue: from
    each line on, as many more lines as it takes to have each of ``lengths`` terms.

    Windows carry the terms of lines, clipped to a bounded length, not their texts; everything here is by digest, so
    nothing but term counts is shuffled again. A giant line ends every run that reaches it and is not carried at all: its
    counts are made once, and its runs are counted only if the norm of the lines before it and its own best product
    with a template, over its norm, can reach the threshold.
    """
    order, far = Window.partitionBy("digest").orderBy("k"), max(lengths) - 1
    most = GIANT * max(lengths)
    own = terms(F.col("part"))
    clipped = F.transform(own, lambda t: F.when(F.length(t) > 40, F.concat(F.lit("#"), F.md5(t))).otherwise(t))
    told = lines.withColumn("n", F.size(own)).where("n > 0").select("digest", "k", "n", F.col("part").rlike(cue).alias("cued"), F.when(F.col("n") <= most, clipped).alias("terms"))
    near = told.withColumn("near", F.max("cued").over(order.rowsBetween(-far, far))).where("near")
    ahead = near.withColumn("ahead", F.collect_list(F.struct("k", "n", "cued", "terms")).over(order.rowsBetween(0, far))).where(F.exists("ahead", lambda x: x["cued"]))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + x["n"]
        ends = F.exists(F.array(*map(F.lit, lengths)), lambda l: (state["n"] < l) & (n >= l))
        return F.struct((state["i"] + 1).alias("i"), n.alias("n"), F.when(ends & (state["i"] > 0), F.array_append(state["ends"], state["i"])).otherwise(state["ends"]).alias("ends"))

    runs = ahead.select("digest", "k", "ahead", F.explode(F.aggregate("ahead", start, step)["ends"]).alias("more"))
    run = runs.select("digest", "k", "more", F.slice("ahead", F.lit(1), F.col("more") + 1).alias("run")).where(F.exists("run", lambda x: x["cued"]))
    last = F.element_at("run", -1)
    told = run.select("digest", "k", "more", F.when(last["n"] > most, last["k"]).alias("giant"), F.flatten(F.filter(F.col("run")["terms"], lambda t: t.isNotNull())).alias("terms"))
    passage = ["digest", "k", "more", "giant"]
    counted = told.select(*passage, F.explode("terms").alias("term")).groupBy(*passage, "term").agg(F.count(F.lit(1)).alias("tf"))
    before = durable(counted, "runs")
    short = before.where("giant is null").drop("giant")
    ending = _weighed(before.where("giant is not null"), idf)
    if ending.isEmpty():
        return short
    giants = ending.select("digest", F.col("giant").alias("k")).distinct()
    words = lines.join(giants, ["digest", "k"]).select("digest", F.col("k").alias("giant"), F.explode(terms(F.col("part"))).alias("term"))
    line = durable(_weighed(words.groupBy("digest", "giant", "term").agg(F.count(F.lit(1)).alias("tf")), idf), "giants")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    best = line.join(_units(lines.sparkSession, vectors), "term").groupBy("digest", "giant", "n").agg(F.sum(F.col("w") * F.col("u")).alias("dot")).groupBy("digest", "giant").agg(F.max("dot").alias("dot"))
    able = line.groupBy("digest", "giant").agg(norm).join(best, ["digest", "giant"], "left").withColumnRenamed("norm", "own_norm")
    sums = ending.groupBy(*passage).agg(norm).join(able, ["digest", "giant"])
    kept = sums.where((F.col("norm") + F.coalesce("dot", F.lit(0.0))) / F.col("own_norm") >= threshold - 1e-5).select(*passage)
    parts = ending.drop("w").join(kept, passage).select("digest", "k", "more", "term", "tf").unionByName(kept.join(line.drop("w"), ["digest", "giant"]).select("digest", "k", "more", "term", "tf"))
    return short.unionByName(parts.groupBy("digest", "k", "more", "term").agg(F.sum("tf").alias("tf")))


def _candidates(files: DataFrame, found: list[str]) -> DataFrame:
    """doc_id and path of all files; digest and text of those with a cue, the only ones that can match. Durable, so that
    texts are tokenised once here and never read again."""
    text = F.coalesce("text", F.lit(""))
    maybe = F.arrays_overlap(F.split(F.lower(text), SEPARATORS), F.array(*map(F.lit, found)))
    return durable(files.select("doc_id", "path", F.when(maybe, F.md5(F.col("text").cast("binary"))).alias("digest"), F.when(maybe, F.col("text")).alias("text")), "candidates")


def _matches(files: DataFrame, templates: list[tuple[str, str]], threshold: float, file_share: float) -> tuple[DataFrame, DataFrame]:
    """(digest, licence, similarity, file_licence, file_similarity) for each distinct text that matches, and doc_id,
    path and digest of all files."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    idf, vectors = weigh(templates, *document_frequencies(files, vocabulary))
    rarest = cues(vectors, idf, threshold)
    cue = rf"(?i)(?<!{LETTER})(?:" + "|".join(rarest) + rf")(?!{LETTER})"
    rows = _candidates(files, rarest)
    lengths = sorted({sum(terms_of(text).values()) for _, text in templates})
    texts = rows.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
    whole = F.array(F.struct(F.lit(-1).alias("k"), F.col("text").alias("part")))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("k"), x.alias("part")))
    parts = texts.select("digest", F.explode(F.concat(whole, F.filter(lines, lambda x: x["part"].rlike(cue)))).alias("p")).select("digest", "p.k", F.lit(0).alias("more"), "p.part")
    passage = ["digest", "k", "more"]
    counted = parts.select(*passage, F.explode(terms(F.col("part"))).alias("term")).groupBy(*passage, "term").agg(F.count(F.lit(1)).alias("tf"))
    runs = _runs(texts.select("digest", F.explode(lines).alias("p")).select("digest", "p.k", "p.part"), cue, lengths, idf, vectors, threshold)
    counted = durable(_weighed(counted.unionByName(runs), idf), "terms")
    norms = counted.groupBy(*passage).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = counted.join(_units(spark, vectors), "term").groupBy(*passage, "n", "licence").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(norms, passage).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= threshold)
    all_words = norms.where("k = -1").select("digest", F.col("words").alias("all_words"))
    order = [(-F.col("similarity")).alias("s"), "licence", "k", "more"]
    large = F.when(F.col("words") / F.col("all_words") >= file_share, F.struct((F.col("k") >= 0).alias("part"), *order))
    best = scored.join(all_words, "digest").groupBy("digest").agg(F.min(F.struct(*order)).alias("b"), F.min(large).alias("f"))
    return best.select("digest", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"), F.col("f.licence").alias("file_licence"), (-F.col("f.s")).alias("file_similarity")), rows.drop("text")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def nearest_licences(files: DataFrame) -> DataFrame:
    """dir, from_dir, dir_licence for each directory of ``files`` (path, file_licence, file_similarity) that has a
    licence or lies below one that has."""
    placed = files.withColumn("dir", parent(F.coalesce("path", F.lit(""))))
    set_by = placed.where("file_licence is not null").groupBy("dir").agg(F.min(F.struct((-F.col("file_similarity")).alias("s"), "file_licence", "path")).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.file_licence").alias("dir_licence"))
    steps = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))))
    dirs = placed.select("dir").distinct().select("dir", F.posexplode(steps).alias("depth", "from_dir"))
    found = salted_lookup(dirs, set_by, "from_dir", "dir", how="inner")
    return found.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_licence")).alias("m")).select("dir", "m.from_dir", "m.dir_licence")


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, file_share: float = FILE_SHARE, limit: int = 200_000) -> DataFrame:
    """One row for each row of ``files`` (doc_id, path, text): doc_id, path, licence (its own), similarity,
    licence_file, effective_licence (its own or the nearest directory's), from_dir (null: its own or none). Up to ``limit``
    matches and directories are broadcast; beyond it matches are looked up with hot digests dealt out."""
    matches, rows = _matches(files, templates or TEMPLATES, threshold, file_share)
    found, cued = durable(matches, "licences"), rows.where("digest is not null")
    if found.count() <= limit:  # rows of up to 200 bytes
        met = cued.join(F.broadcast(found), "digest", "left")
    else:
        uses = cued.groupBy("digest").agg(F.count(F.lit(1)).alias("uses"))
        met = weighed_lookup(cued, durable(found.join(uses, "digest"), "uses"), ["digest"], "uses", F.struct("path", "doc_id"), "left").drop("uses")
    # Files without a cue have no digest: they pass by the join, in which they would be one hot key.
    scored = met.unionByName(rows.where("digest is null"), allowMissingColumns=True)
    own = durable(scored.withColumn("licence_file", F.col("file_licence").isNotNull()).drop("digest"), "files")
    near = durable(nearest_licences(own), "dirs")
    placed = own.withColumn("dir", parent(F.coalesce("path", F.lit(""))))
    joined = placed.join(F.broadcast(near), "dir", "left") if near.count() <= limit else salted_lookup(placed, near, "dir", "path")
    return joined.select("doc_id", "path", "licence", "similarity", "licence_file", F.coalesce("licence", "dir_licence").alias("effective_licence"), F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of a table of documents: a directory for each source, language and thousand of ids."""
    name = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("_"))
    return docs.select("doc_id", F.concat_ws("/", name("source"), name("lang"), F.coalesce(F.expr("doc_id div 1000").cast("string"), F.lit("_")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt"))).alias("path"), "text")


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> str:
    """The scan of ``document_files`` in DuckDB: every line, run of lines and file is scored, without cues."""
    lengths = sorted({sum(terms_of(text).values()) for _, text in templates})
    rows = ", ".join(f"({k}, '{name}', '{t}', {c})" for k, (name, text) in enumerate(templates) for t, c in terms_of(text).items())
    return rf"""
WITH f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         concat_ws('/', coalesce(replace(source, '/', '_'), '_'), coalesce(replace(lang, '/', '_'), '_'), coalesce(CAST(doc_id // 1000 AS VARCHAR), '_'),
                   coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt') AS path FROM documents),
t(n, licence, term, c) AS (VALUES {rows}),
parts AS (
  SELECT r, -1 AS k, text AS part FROM f
  UNION ALL SELECT r, unnest(range(len(s))) AS k, unnest(s) AS part FROM (SELECT r, string_split(text, chr(10)) AS s FROM f)),
single AS (
  SELECT r, k, term, count(*) AS tf FROM (SELECT r, k, unnest(regexp_split_to_array(lower(part), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM parts) WHERE term <> '' GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS p, sum(n) OVER (PARTITION BY r ORDER BY k) AS upto FROM (SELECT r, k, sum(tf) AS n FROM single WHERE k >= 0 GROUP BY 1, 2)),
runs AS (
  SELECT DISTINCT r, k, p, q FROM (
    SELECT a.r, a.k, a.p, l, min(b.p) AS q FROM placed a CROSS JOIN (SELECT unnest({lengths}) AS l) JOIN placed b ON b.r = a.r AND b.p BETWEEN a.p AND a.p + {max(lengths) - 1} AND b.upto >= a.upto - a.n + l GROUP BY ALL) WHERE q > p),
counted AS (
  SELECT r, k, 0 AS more, term, tf FROM single
  UNION ALL SELECT x.r, x.k, x.q - x.p AS more, term, CAST(sum(tf) AS BIGINT) FROM runs x JOIN placed b ON b.r = x.r AND b.p BETWEEN x.p AND x.q JOIN single c ON c.r = b.r AND c.k = b.k GROUP BY ALL),
idf AS (
  SELECT term, ln((SELECT count(*) + 1 FROM f) / (count(c.r) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT term FROM t) LEFT JOIN (SELECT r, term FROM single WHERE k = -1) c USING (term) GROUP BY term),
v AS (SELECT n, licence, term, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY n)) AS u FROM t JOIN idf USING (term)),
w AS (SELECT r, k, more, term, tf, tf * coalesce(idf, 1.0) AS w FROM counted LEFT JOIN idf USING (term)),
norms AS (SELECT r, k, more, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM w GROUP BY 1, 2, 3),
scored AS (
  SELECT r, k, more, licence, round(sum(w * u) / any_value(norm), 6) AS similarity, any_value(words) AS words
  FROM w JOIN v USING (term) JOIN norms USING (r, k, more) GROUP BY r, k, more, n, licence),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY similarity DESC, licence, k, more) AS o FROM scored WHERE similarity >= {threshold}) WHERE o = 1),
filed AS (
  SELECT * FROM (SELECT s.r, s.licence AS file_licence, s.similarity AS file_similarity, row_number() OVER (PARTITION BY s.r ORDER BY s.k >= 0, s.similarity DESC, s.licence, s.k, s.more) AS o
    FROM scored s JOIN norms a ON a.r = s.r AND a.k = -1 WHERE s.similarity >= {threshold} AND s.words / a.words >= {file_share}) WHERE o = 1),
own AS (
  SELECT f.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, b.licence, b.similarity, t.r IS NOT NULL AS licence_file, file_licence, file_similarity
  FROM f LEFT JOIN best b USING (r) LEFT JOIN filed t USING (r)),
set_by AS (SELECT dir AS from_dir, file_licence AS dir_licence FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY file_similarity DESC, file_licence, path) AS o FROM own WHERE licence_file) WHERE o = 1),
near AS (
  SELECT dir, from_dir, dir_licence FROM (
    SELECT d.dir, s.*, row_number() OVER (PARTITION BY d.dir ORDER BY length(s.from_dir) DESC) AS o
    FROM (SELECT DISTINCT dir FROM own) d JOIN set_by s ON d.dir = s.from_dir OR s.from_dir = '' OR starts_with(d.dir, s.from_dir || '/')) WHERE o = 1)
SELECT doc_id, path, licence, similarity, licence_file, coalesce(licence, dir_licence) AS effective_licence, CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN near USING (dir)
"""
