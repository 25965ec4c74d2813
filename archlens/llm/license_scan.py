"""Licence scan: Dice coefficient over word bigrams against licence templates. Built-in functions only.

Units of a text are its lines and its paragraphs (lines up to a blank one). A unit and a template of a and b distinct
bigrams reach a coefficient t only if t / (2 - t) <= a / b <= (2 - t) / t, so most units are compared with none or few of
the templates. Templates are constants: they travel inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and grants as their licences word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    import re

    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.trim(unit), r"[ \n]+"), lambda w: w != "")
    # A lambda over an array of one binds the words, which would else be split again for each bigram.
    pair = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.flatten(F.transform(F.array(words), pair)))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, license, dice): each unit of a text and each template whose coefficient reaches the threshold.

    A unit without two words has no bigrams and matches nothing.
    """
    grams = {k: bigrams_of(v) for k, v in sorted((TEMPLATES if templates is None else templates).items())}
    grams = {k: v for k, v in grams.items() if v}
    if not grams:
        return docs.select("doc_id", F.lit("").alias("kind"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where(F.lit(False))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    text = F.regexp_replace(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}\n]+", " ")
    normal = docs.select("doc_id", text.alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.struct(F.lit("line").alias("kind"), x.alias("unit")))
    several = F.filter(F.split("t", r"\n *\n"), lambda x: F.trim(x).contains("\n"))
    whole = F.transform(several, lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("unit")))
    units = normal.select("doc_id", F.explode(F.concat(lines, whole)).alias("u")).select("doc_id", "u.kind", "u.unit")
    # A unit of n characters has no more than n / 2 words, and one word fewer bigrams.
    shortest = low * min((len(g) for g in grams.values()), default=1)
    longest = high * max((len(g) for g in grams.values()), default=0)
    # Of a unit that reaches the threshold a share of ``low`` of the bigrams lies in a template: most units end here. The
    # condition is one lambda over the bigrams, so they are made once, and again only for what passes.
    known = sorted({x for g in grams.values() for x in g})
    passes = lambda g: (F.size(g) >= shortest - 1e-9) & (F.size(g) <= longest + 1e-9) & (F.size(F.filter(g, lambda x: x.isin(known))) >= low * F.size(g) - 1e-9)
    sized = units.where((F.length("unit") >= 2 * shortest) & F.exists(F.array(_bigrams(F.col("unit"))), passes)).withColumn("grams", _bigrams(F.col("unit"))).withColumn("n", F.size("grams"))
    found = F.array(
        *[
            F.when((F.col("n") >= low * len(g) - 1e-9) & (F.col("n") <= high * len(g) + 1e-9), F.struct(F.lit(k).alias("license"), (2.0 * F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in g]))) / (F.col("n") + len(g))).alias("dice")))
            for k, g in grams.items()
        ]
    )
    hits = sized.select("doc_id", "kind", F.filter(found, lambda x: x["dice"] >= threshold).alias("hits")).where(F.size("hits") > 0)
    return hits.select("doc_id", "kind", F.explode("hits").alias("h")).select("doc_id", "kind", "h.license", "h.dice")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licenses, n_matches, best_license, best_dice) for each distinct doc_id of docs(doc_id, text, ...).

    licenses: names of all templates that match, in order, joined by commas; the best is the one with the highest coefficient,
    the first name on ties. Texts that match nothing, null and empty ones have "" , 0 and nulls. Rows that repeat a doc_id
    are scanned as one document, a null doc_id as another. An empty table gives an empty result; further columns are ignored.
    """
    hits = license_matches(docs, templates, threshold).select("doc_id", "license", "dice")
    all_ = docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    # One row for each document and template before the last step, whatever the number of units.
    per = all_.unionByName(hits).groupBy("doc_id", "license").agg(F.count("dice").alias("n"), F.max("dice").alias("dice"))
    top = F.min(F.when(F.col("dice").isNotNull(), F.struct((-F.col("dice")).alias("d"), F.col("license").alias("name"))))
    out = per.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.sum("n").alias("n_matches"), top.alias("top"))
    return out.select("doc_id", "licenses", "n_matches", F.col("top.name").alias("best_license"), F.round(-F.col("top.d"), 6).alias("best_dice"))


def oracle() -> str:
    """The same for DuckDB."""
    values = ", ".join("('{}', [{}])".format(k, ", ".join("'" + g.replace("'", "''") + "'" for g in bigrams_of(v))) for k, v in sorted(TEMPLATES.items()))
    return rf"""
with t(license, grams) as (values {values}),
n as (select doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') as t from documents),
u as (select doc_id, unnest(string_split(t, chr(10))) as unit from n
  union all select doc_id, unit from (select doc_id, unnest(regexp_split_to_array(t, '\n *\n')) as unit from n) where contains(trim(unit), chr(10))),
w as (select doc_id, list_filter(regexp_split_to_array(unit, '[ \n]+'), lambda x: x <> '') as words from u),
g as (select doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) > 1),
d as (select doc_id, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice from g, t
  where len(g.grams) between 0.5 * len(t.grams) and 2 * len(t.grams)),
h as (select * from d where dice >= 0.8),
a as (select doc_id, string_agg(distinct license, ',' order by license) as licenses, count(*) as n_matches, arg_min(license, (-dice, license)) as best_license, max(dice) as best_dice from h group by doc_id)
select doc_id, coalesce(licenses, '') as licenses, coalesce(n_matches, 0) as n_matches, best_license, round(best_dice, 6) as best_dice
from (select distinct doc_id from documents) left join a using (doc_id)
"""
