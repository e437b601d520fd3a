"""License scans by MinHash bands over overlapping windows, by DataFrame functions alone.

Texts are shingled by five words. WIDTH consecutive shingles are a window: of the templates from every position, of the
documents from every STRIDE-th. BANDS bands of ROWS MinHash values each are taken of every window; an equal band
retrieves the window's template. Two windows of Jaccard similarity j collide with a probability of at least
1 - (1 - j**ROWS)**BANDS: 1 for equal windows, 0.95 at j = 0.8, 0.87 at 0.7, 0.74 at 0.6. A text that holds WIDTH + STRIDE - 1
shingles of a template in a row has an equal window, so is retrieved for certain: that is every text that holds 0.8 of
the template in one stretch, as templates have SMALL shingles or more. Where single words were changed, at most n / 20 of
n shingles' words so that 0.8 are left, stretches of at least seven shingles remain; a window that meets six of them and
two others has j = 0.6, and there are two such windows for each stretch: 0.99 for two stretches. Templates of fewer than
SMALL shingles are windows of one shingle each, which collide for certain. Retrieved templates are then verified: the
share of the template's distinct shingles that the text holds must be 0.8 or more.

Words are runs of letters and digits, lower-cased. Defined results: null, empty and shorter texts hold no license; a
row without a doc_id is scanned like any other, and what rows of one id (or without one) hold is reported once, with the
largest containment; a long text is exploded to windows, only its words and shingles are held as arrays; repeated rows
give the result of one; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, materialize, word_hashes

SHINGLE, SHARE = 5, 0.8
#: Shingles of a window, between windows of a document, and from which a template has such windows.
WIDTH, STRIDE, SMALL = 8, 4, 14
BANDS, ROWS = 3, 2
#: Bound on the bands of all templates, which are broadcast.
MAX_BANDS = 1_000_000

# Notices that licenses ask to be placed in a work, and texts of short licenses, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-notice": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("template")) for k, v in sorted(TEMPLATES.items())])
    return spark.range(1).select(F.inline(rows))


def _shingles(text: Column) -> Column:
    """The hashes of a text's shingles, in order; empty for a text of fewer than SHINGLE words."""

    def of(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))

    return let(word_hashes(text), of)


def _windows(texts: DataFrame, text: str, stride: int, *keys: str) -> DataFrame:
    """keys, s0, s1, ... and left for every stride-th shingle of a text: it and those behind it (0 behind the last), and how many there are."""
    fields = lambda s, i: [*[F.coalesce(F.get(s, i + k), F.lit(0).cast("long")).alias(f"s{k}") for k in range(WIDTH)], (F.size(s) - i).alias("left")]
    starts = lambda s: F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(stride))
    rows = let(_shingles(F.col(text)), lambda s: F.transform(starts(s), lambda i: F.struct(*fields(s, i))))
    return texts.select(*keys, F.explode(rows).alias("w")).select(*keys, "w.*")


def _least(k: int) -> Column:
    """A MinHash value: the window's least hash under one of many orders, the distance (an exclusive or) to a point of its own."""
    point = F.lit((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63)).cast("long")
    return F.least(*[F.col(f"s{i}").bitwiseXOR(point) for i in range(WIDTH)])


def bands() -> list[Column]:
    """The bands of a window, hashes of ROWS MinHash values each; null where the window is cut off.

    The points of a band lie near each other, so that its values go together; that makes a collision likelier yet.
    """
    return [F.when(F.col("left") >= WIDTH, F.xxhash64(F.lit(b), *[_least(BANDS * r + b) for r in range(ROWS)])) for b in range(BANDS)]


def _lone(k: int) -> Column:
    """The k-th shingle as a window of its own."""
    return F.when(F.col("left") > k, F.xxhash64(F.lit(-1), F.col(f"s{k}")))


def find_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id, matched, total and containment for each template (license_id, template) that a text holds."""
    whole = known.select("license_id", "template", F.array_distinct(_shingles(F.col("template"))).alias("t"))
    sized = whole.withColumn("n", F.size("t"))
    theirs = _windows(sized.where(F.col("n") >= SMALL), "template", 1, "license_id").select("license_id", F.explode(F.array(*bands())).alias("value"))
    theirs = theirs.unionByName(_windows(sized.where(F.col("n") < SMALL), "template", 1, "license_id").select("license_id", _lone(0).alias("value")))
    theirs = materialize(theirs.where("value is not null").distinct())
    if theirs.count() > MAX_BANDS:
        raise ValueError(f"the templates have more than {MAX_BANDS} bands")

    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").where("text is not null")
    ours = F.explode(F.array(*bands(), *[_lone(k) for k in range(STRIDE)])).alias("value")
    near = _windows(texts, "text", STRIDE, "doc_id", "row").select("doc_id", "row", ours).join(F.broadcast(theirs), "value")
    # Written out, so that few pairs are broadcast to the texts in place of a shuffle of these.
    pairs = materialize(near.select("doc_id", "row", "license_id").distinct())
    asked = materialize(pairs.groupBy("doc_id", "row").agg(F.collect_set("license_id").alias("licenses"))).toDF("_id", "_row", "licenses")

    of_text = texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["row"] == asked["_row"])
    held = texts.join(asked, of_text).select("doc_id", "row", "licenses", F.array_distinct(_shingles(F.col("text"))).alias("own"))
    near = held.select("doc_id", "own", F.explode("licenses").alias("license_id")).join(F.broadcast(whole.select("license_id", "t")), "license_id")
    judged = near.select("doc_id", "license_id", F.size("t").cast("long").alias("total"), F.size(F.array_intersect("t", "own")).cast("long").alias("matched"))
    found = judged.where(F.col("matched") >= F.col("total") * F.lit(SHARE)).groupBy("doc_id", "license_id", "total").agg(F.max("matched").alias("matched"))
    return found.select("doc_id", "license_id", "matched", "total", (F.col("matched") / F.col("total")).alias("containment"))


def _sql() -> str:
    quoted = lambda v: v.replace("'", "''")
    rows = ", ".join(f"('{k}', '{quoted(v)}')" for k, v in sorted(TEMPLATES.items()))
    return rf"""
with known(license_id, template) as (values {rows}),
words as (
  select license_id as id, null::bigint as doc_id, list_filter(string_split_regex(lower(template), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from known
  union all
  select null, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') from documents),
starts as (select id, doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from words where len(w) >= 5),
shingles as (select distinct id, doc_id, array_to_string(w[i:i+4], ' ') as s from starts),
totals as (select id, count(*) as total from shingles where id is not null group by id)
select d.doc_id, t.id as license_id, count(*)::bigint as matched, max(n.total)::bigint as total, count(*) / max(n.total) as containment
from shingles d join shingles t on d.s = t.s and d.id is null and t.id is not null join totals n on n.id = t.id
group by d.doc_id, t.id having count(*) >= 0.8 * max(n.total)
"""


SQL = _sql()
