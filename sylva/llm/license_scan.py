"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: Words of a gram: of a base phrase, of a template.
BASE_GRAM, GRAM = 2, 3
#: Diagonals this close are merged: words put in or left out of a copied passage.
NEAR = 4
#: Share of a template's grams that a span must hold, in the template's order.
COVER = 0.6
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of which every place counts: (words, label). Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Public licence texts, their notices and the lines that name them, found also when somewhat altered: (text, label). Fixed values.
TEMPLATES = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("released under the MIT License", "mit"),
    ("licensed under the MIT License", "mit"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unlicense"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-2.0"),
    ("licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License", "apache-2.0"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "gnu"),
    ("licensed under the GNU General Public License", "gnu"),
    ("licensed under the GNU Lesser General Public License", "lgpl"),
    ("licensed under the GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("licensed under CC BY 4.0", "cc-by-only"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under CC BY-ND 4.0", "cc-by-nd"),
    ("licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def gram_rows(base, templates) -> list[tuple]:
    """(g0, g1, g2, tid, tpos, exact, label, grams, words): the grams of all templates; g2 is null in those of base phrases."""
    rows, tid = [], 0
    for exact, group in ((True, base), (False, templates)):
        for text, label in group:
            w = [x for x in re.split(BREAK, text.lower()) if x]
            k = BASE_GRAM if exact else GRAM
            if len(w) < k:
                raise ValueError(f"{text!r} has less than {k} words")
            n = len(w) - k + 1
            rows += [(w[i], w[i + 1], None if exact else w[i + 2], tid, i, exact, label, n, k) for i in range(n)]
            tid += 1
    return rows


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """(row_key, doc_id, n_words, spans) of documents(doc_id, text); spans: array of (tid, exact, label, start, cover).

    The hash of each two neighbouring words is joined to the positions of the templates' grams, a table as small as the
    templates and so broadcast; words are then compared, the third one of a template's gram too. A hit votes for the
    diagonal (template, position less template position). A base phrase is a diagonal with all its grams. For the other
    templates, diagonals at most `near` apart are merged and the span is verified: its hits are read in the order of the
    text, and only those count that stand further on in the template than all before; they must be `cover` of its grams.
    Of templates whose spans overlap in the text the best covered one stands, then the longest, then the first; so of
    licences that differ in a word the one that has it. Rows equal in id and text share a key. Null and empty texts have
    no words; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    grams = rows.select("doc_id", "key", F.posexplode(F.expr("transform(w, (x, i) -> named_struct('w0', x, 'w1', get(w, i + 1), 'w2', get(w, i + 2)))")))
    grams = grams.select("doc_id", "key", F.col("pos").alias("at"), "col.w0", "col.w1", "col.w2")
    t = spark.createDataFrame(gram_rows(base, templates), "g0 string, g1 string, g2 string, tid int, tpos int, exact boolean, label string, grams int, k int")
    t = t.withColumn("t_gram", F.xxhash64("g0", "g1"))
    same = (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1")) & (F.col("g2").isNull() | (F.col("w2") == F.col("g2")))
    hits = grams.join(F.broadcast(t), (F.xxhash64("w0", "w1") == F.col("t_gram")) & same)
    by = ["doc_id", "key", "tid", "exact", "label", "grams", "k"]
    diagonals = hits.groupBy(*by, (F.col("at") - F.col("tpos")).alias("diagonal")).agg(F.collect_set(F.struct("at", "tpos")).alias("votes"))  # a template's length at most
    order = Window.partitionBy(*by).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("exact"), 0).otherwise(near)).cast("int"), F.lit(0))
    merged = (
        diagonals.withColumn("new", new)
        .withColumn("strip", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "strip")
        .agg(F.array_sort(F.flatten(F.collect_list("votes"))).alias("votes"))
        .filter(F.size("votes") >= cover * F.col("grams"))
    )
    ordered = F.expr("aggregate(votes, named_struct('top', -1, 'n', 0), (a, x) -> if(x.tpos > a.top, named_struct('top', x.tpos, 'n', a.n + 1), a), a -> a.n)")
    spans = merged.withColumns({"cover": ordered / F.col("grams"), "start": F.col("votes")[0]["at"], "end": F.element_at("votes", -1)["at"] + F.col("k")})
    spans = spans.filter(F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= cover))
    place = Window.partitionBy("doc_id", "key", "exact").orderBy("start", "end", "tid")
    apart = F.coalesce(F.col("start") >= F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | F.col("exact")
    placed = spans.withColumn("island", F.sum(apart.cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("cover", "grams", (-F.col("tid")).alias("least"), F.struct("tid", "exact", "label", "start", "cover").alias("span"))
    best = placed.groupBy("doc_id", "key", "exact", "island").agg(F.max(one).getField("span").alias("span"))
    found = best.groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "spans")
    return rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words")).join(
        found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left"
    ).select("doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<tid:int,exact:boolean,label:string,start:int,cover:double>>)")).alias("spans"))


def op7_license(spark, sf_dir) -> DataFrame:
    base = F.filter("spans", lambda s: s.exact)
    starts = F.transform(base, lambda s: s.start)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0)).alias("score"),
    )


def sql(base=BASE, templates=TEMPLATES, near: int = NEAR, cover: float = COVER) -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join(f"({', '.join(map(quoted, r))})" for r in gram_rows(base, templates))
    return rf"""
WITH g(g0, g1, g2, tid, tpos, exact, label, grams, size) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT k, unnest(w) AS w0, unnest(list_concat(w[2:], [NULL])) AS w1, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w2, unnest(range(len(w))) AS pos FROM d),
h AS (SELECT k, tid, exact, label, grams, size, pos - tpos AS diagonal, tpos, pos FROM p JOIN g ON w0 = g0 AND w1 = g1 AND (g2 IS NULL OR g2 = w2)),
v AS (SELECT DISTINCT k, tid, exact, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > CASE WHEN exact THEN 0 ELSE {near} END THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY k, tid ORDER BY diagonal)),
s AS (SELECT k, tid, diagonal, sum(fresh) OVER (PARTITION BY k, tid ORDER BY diagonal) AS strip FROM n),
o AS (SELECT h.*, strip, tpos > coalesce(max(tpos) OVER (PARTITION BY k, tid, strip ORDER BY pos, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS further FROM h JOIN s USING (k, tid, diagonal)),
m AS (SELECT k, tid, exact, label, any_value(grams) AS grams, count(*) FILTER (further)::DOUBLE / any_value(grams) AS cover, min(pos) AS pos, max(pos) + any_value(size) AS past FROM o GROUP BY k, tid, exact, label, strip),
f AS (SELECT * FROM m WHERE CASE WHEN exact THEN cover = 1 ELSE cover >= {cover} END),
l AS (SELECT *, CASE WHEN exact OR pos >= max(past) OVER (PARTITION BY k, exact ORDER BY pos, past, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS apart FROM f),
i AS (SELECT *, sum(apart) OVER (PARTITION BY k, exact ORDER BY pos, past, tid ROWS UNBOUNDED PRECEDING) AS island FROM l),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY k, exact, island ORDER BY cover DESC, grams DESC, tid) = 1),
a AS (SELECT k, count(*) FILTER (exact) AS n_base, min(pos) FILTER (exact) AS first_word, max(pos) FILTER (exact) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM b GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (k)
"""
