"""License scans by diagonal voting (DataFrame functions only).

Every template (a short phrase or a longer notice) is a list of words; its k-grams, k being 2 for phrases and 4 for
notices, are hashed with their positions, and so are the rolling k-grams of every document. Spark joins the two on the hash and compares the words themselves.
A match votes for the diagonal "position in the document minus position in the template". Votes are counted by
diagonal; for a notice, diagonals that lie within GAP of each other are merged, so that a few words put in or left out
do not part a passage; the span of a merged diagonal is verified by the share of the template's k-grams it covers.
Licenses whose texts share most of their words (those of the GPL family) are reported side by side.
A phrase is found where one diagonal holds all its k-grams, that is, where its words stand consecutively.

Defined results for odd input: a null or empty text has 0 words, no places and score 0; each row is scanned by itself,
rows that repeat a doc_id too; the templates are a small fixed table, broadcast; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_K = 2
NOTICE_K = 4
GAP = 6
COVERED = 0.6

#: The phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: License texts and notices of public licenses, each with its label.
NOTICES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "apache",
        """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the
        NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF
        licenses this file to you under the Apache License, Version 2.0""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    ),
    (
        "gpl",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided as-is, without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software""",
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "epl",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    ),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work""",
    ),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({LICENSE_WORD})"), F.lit(1))


def template_grams(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(template, label, phrase, n_grams, t_pos, t_gram, hash) of each template k-gram, hashed over all its words."""
    rows = [(text, label, True, PHRASE_K) for text, label in phrases] + [(text, label, False, NOTICE_K) for label, text in notices]
    raw = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "template int, text string, label string, phrase boolean, k int")
    words = raw.withColumn("w", words_of(F.col("text"))).withColumn("n_grams", F.size("w") - F.col("k") + 1)
    at = words.withColumn("t_pos", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)))
    gram = F.slice("w", F.col("t_pos") + 1, F.col("k"))
    return at.select("template", "label", "phrase", "n_grams", "t_pos", F.array_join(gram, " ").alias("t_gram")).withColumn("hash", F.xxhash64("t_gram"))


def gram_matches(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, pos, template columns): the matches, and for each row of docs at least one line.

    A row's first place stays even where nothing matches, so the texts are read once and rows without a match are kept.
    """
    rest = F.greatest(F.size("w"), F.lit(1))
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))
    shifted = [F.slice("w", n, rest).alias(f"w{n}") for n in (2, 3, 4)]
    places = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("w1"), *shifted)).alias("pos", "g"))
    two = F.concat_ws(" ", "g.w1", "g.w2")  # grams over the end of a text are shorter than any template's
    four = F.concat_ws(" ", "g.w1", "g.w2", "g.w3", "g.w4")
    places = places.select("row", "doc_id", "n_words", "pos", F.explode(F.array(two, four)).alias("gram")).withColumn("g_hash", F.xxhash64("gram"))
    found = places.join(F.broadcast(grams), (F.col("g_hash") == F.col("hash")) & (F.col("gram") == F.col("t_gram")), "left")
    found = found.where(F.col("template").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return found.select("row", "doc_id", "n_words", "template", "label", "phrase", "n_grams", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos")


def license_spans(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """(row, doc_id, n_words, template, label, phrase, start, end, cover): the verified spans; one line without a template for a row that has none."""
    found = gram_matches(docs, template_grams(docs.sparkSession, phrases, notices))
    votes = found.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("phrase").alias("phrase"),
        F.first("n_grams").alias("n_grams"),
        F.collect_set("t_pos").alias("t_pos"),
        F.min("pos").alias("start"),
        F.max("pos").alias("last"),
    )
    # A phrase is one diagonal with all its grams; other diagonals of a phrase say nothing, but the row is kept.
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > gap), F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(by_diagonal))
    spans = merged.groupBy("row", "template", "passage").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("phrase").alias("phrase"),
        F.first("n_grams").alias("n_grams"),
        F.size(F.array_distinct(F.flatten(F.collect_list("t_pos")))).alias("hits"),
        F.min("start").alias("start"),
        F.max("last").alias("last"),
    )
    share = F.col("hits") / F.col("n_grams")
    good = F.when(F.col("phrase"), share == 1.0).otherwise((share >= covered) & (F.col("last") - F.col("start") < 2 * F.col("n_grams")))
    keep = F.coalesce(good, F.lit(False))
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(NOTICE_K)
    only = lambda c: F.when(keep, c)
    return spans.select("row", "doc_id", "n_words", only(F.col("template")).alias("template"), only(F.col("label")).alias("label"), only(F.col("phrase")).alias("phrase"), only(F.col("start")).alias("start"), only(F.col("last") + k).alias("end"), only(share).alias("cover"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = lambda c: F.when(F.col("phrase"), c)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("long").alias("first_word"),
        F.max(base(F.col("start"))).cast("long").alias("last_word"),
        labels(base(F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


SQL = r"""
WITH templates AS (
  SELECT template - 1 AS template, label, phrase, k, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (VALUES __TEMPLATES__) AS t(template, label, phrase, k, text)
), grams AS (
  SELECT template, label, phrase, k, len(w) - k + 1 AS n_grams, p AS t_pos, list_slice(w, p + 1, p + k) AS g
  FROM (SELECT *, unnest(range(len(w) - k + 1)) AS p FROM templates)
), words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT row, w, unnest(range(len(w))) AS pos FROM words
), hits AS (
  SELECT p.row, g.template, g.label, g.phrase, g.k, g.n_grams, g.t_pos, p.pos, p.pos - g.t_pos AS diagonal
  FROM (SELECT row, pos, list_slice(w, pos + 1, pos + 2) AS g2, list_slice(w, pos + 1, pos + 4) AS g4 FROM places) p
  JOIN grams g ON (g.k = 2 AND p.g2 = g.g) OR (g.k = 4 AND p.g4 = g.g)
), votes AS (
  SELECT row, template, label, phrase, k, n_grams, diagonal, list(DISTINCT t_pos) AS ts, min(pos) AS start, max(pos) AS last FROM hits GROUP BY ALL
), passages AS (
  SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS passage
  FROM (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > 6, true) THEN 1 ELSE 0 END AS apart FROM votes)
), spans AS (
  SELECT row, template, label, phrase, start, CAST(hits AS DOUBLE) / n_grams AS cover
  FROM (SELECT row, template, label, phrase, n_grams, passage, len(list_distinct(flatten(list(ts)))) AS hits, min(start) AS start, max(last) AS last FROM passages GROUP BY ALL)
  WHERE CASE WHEN phrase THEN hits = n_grams ELSE hits >= 0.6 * n_grams AND last - start < 2 * n_grams END
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(count(CASE WHEN s.phrase THEN 1 END) AS BIGINT) AS n_base,
       CAST(min(CASE WHEN s.phrase THEN s.start END) AS BIGINT) AS first_word, CAST(max(CASE WHEN s.phrase THEN s.start END) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT CASE WHEN s.phrase THEN s.label END, ',' ORDER BY CASE WHEN s.phrase THEN s.label END), '') AS base_labels,
       coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, coalesce(max(s.cover), CAST(0 AS DOUBLE)) AS score
FROM words w LEFT JOIN spans s ON s.row = w.row GROUP BY w.row, w.doc_id, w.w
""".replace(
    "__TEMPLATES__",
    ", ".join("({}, '{}', {}, {}, '{}')".format(n + 1, label, phrase, k, " ".join(text.split())) for n, (label, phrase, k, text) in enumerate([(label, "true", PHRASE_K, text) for text, label in PHRASES] + [(label, "false", NOTICE_K, text) for label, text in NOTICES])),
)
