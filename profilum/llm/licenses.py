"""Licence scans with Spark expressions only.

A document, each of its paragraphs and each of its lines is normalised (lower
case, runs of other characters than a-z and 0-9 as one space) and compared to
licence templates by the Dice coefficient over distinct word bigrams,
2 * |A & B| / (|A| + |B|).  A coefficient of t or more is only possible if
|A| lies between t / (2 - t) and (2 - t) / t times |B|, so other templates
are never compared.  It also needs more than t / (2 - t) of the template's
bigrams, so a document in which none of a set of words occurs that touches
enough bigrams of each template is not cut up at all.  Neither bound loses a match.

``passages`` finds a licence wherever it stands: it also compares every run of
successive words, over line and paragraph ends and inside lines, of up to
(2 - t) / t times as many bigrams, repeats counted, as the template has.  ``scan``
keeps to the units above.

Everything happens within a row: no shuffle, no join.

Cases: null or empty texts match nothing; texts of one word have no bigrams
and match nothing; equal texts get equal results; ties in the coefficient go
to the name that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.sources.tables import read_table

THRESHOLD = 0.7

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Public licence texts and the notices by which they are referred to.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": _MIT,
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    """Normalised words."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams of normalised words, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


#: Words so frequent in any prose that finding them says nothing.
COMMON = frozenset("a and any as at be by for from in is it not of on or that the this to was will with you".split())


def cover(templates: dict[str, str], threshold: float) -> list[str]:
    """A few words so that each match of a template holds at least one of them."""
    pairs = {name: [p.split() for p in bigrams_of(text)] for name, text in templates.items()}
    needed = {name: threshold / (2 - threshold) * len(p) for name, p in pairs.items()}
    chosen: list[str] = []
    while open_ := [name for name, left in pairs.items() if left and len(left) >= needed[name]]:
        gain: dict[str, float] = {}
        for name in open_:
            for p in pairs[name]:
                for w in set(p):
                    gain[w] = gain.get(w, 0) + 1 / needed[name]
        best = max(gain, key=lambda w: (gain[w] / (1000 if w in COMMON else 1 if len(w) > 5 else 3), w))
        chosen.append(best)
        pairs = {name: [p for p in left if best not in p] for name, left in pairs.items()}
    return sorted(chosen)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def widest(threshold: float) -> Fraction:
    """How many times as long as a template a run may be, as an exact fraction."""
    t = Fraction(str(threshold))
    return (2 - t) / t


def _table(templates: dict[str, str], threshold: float) -> list[Column]:
    """Name, bounds of the size and bigrams of each template; reach is the longest run of bigrams compared to it."""
    table = []
    for name in sorted(templates):
        pairs = bigrams_of(templates[name])
        if pairs:
            low, high = threshold / (2 - threshold) * len(pairs), (2 - threshold) / threshold * len(pairs)
            reach = int(widest(threshold) * (len(words_of(templates[name])) - 1))
            fields = F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(reach).alias("reach"), F.array(*map(F.lit, pairs)).alias("pairs")
            table.append(F.struct(*fields))
    return table


def _likely(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """Whether any of the covering words occurs."""
    lowered = F.lower(text)
    likely = F.lit(False)
    words = cover(templates, threshold)
    for word in words:
        if len(word) > 5:
            likely = likely | F.contains(lowered, F.lit(word))
    if short := [w for w in words if len(w) <= 5]:
        likely = likely | lowered.rlike(rf"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])")
    return likely


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _best_run(pairs: Column, t: Column) -> Column:
    """The run of bigrams closest to the template, as (against, from, to) in words; null if too few of its bigrams stand together."""
    reach, whole = t["reach"], F.size(t["pairs"])
    least = F.ceil(t["low"] - 1e-9).cast("int")

    def closest(start: Column, steps: Column) -> Column:
        def longer(state: Column, step: Column) -> Column:
            new = step["before"] < start
            n = state["n"] + new.cast("int")
            hits = state["hits"] + (new & step["known"]).cast("int")
            dice = F.lit(2.0) * hits / (n + whole)
            more = dice > state["dice"]
            return F.struct(n.alias("n"), hits.alias("hits"), (state["size"] + 1).alias("size"), F.when(more, dice).otherwise(state["dice"]).alias("dice"), F.when(more, state["size"] + 1).otherwise(state["best"]).alias("best"))

        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0).alias("size"), F.lit(0.0).alias("dice"), F.lit(0).alias("best"))
        return F.aggregate(F.slice(steps, start + 1, reach), none, longer, lambda s: F.struct((-s["dice"]).alias("against"), start.alias("from"), (start + s["best"] + 1).alias("to")))

    # steps: whether a bigram is the template's, and where it last stood within reach
    before = lambda b, i: _let(F.array_position(F.reverse(F.slice(pairs, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, reach))), b).cast("int"), lambda back: F.when(back > 0, i - back).otherwise(-1))
    steps = F.transform(pairs, lambda b, i: F.struct(before(b, i).alias("before"), F.array_contains(t["pairs"], b).alias("known")))
    known = F.filter(F.transform(pairs, lambda b, i: F.when(F.array_contains(t["pairs"], b), i)), lambda i: i.isNotNull())
    starts = _let(known, lambda at: F.filter(F.transform(at, lambda p, k: F.when(F.get(at, k + least - 1) - p < reach, p)), lambda p: p.isNotNull()))
    return _let(starts, lambda ps: F.when(F.size(ps) > 0, _let(steps, lambda s: F.array_min(F.transform(ps, lambda p: closest(p, s))))))


def _found(text: Column, known: Column, threshold: float, likely: Column) -> Column:
    """Matches of the whole text, its blank-line paragraphs and its lines."""
    # exact: blank-line paragraphs and lines of what is left after the cheap test
    units = F.when(likely, F.array_distinct(F.transform(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n")), _normal))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.transform(units, lambda u: F.split(u, " ")), lambda w: F.array_distinct(_pairs(w)))
    dice = lambda b, t: F.lit(2.0) * F.size(F.array_intersect(b, t["pairs"])) / (F.size(b) + F.size(t["pairs"]))
    fitting = F.transform(pairs, lambda b: F.transform(F.filter(known, lambda t: F.size(b).between(t["low"], t["high"])), lambda t: F.struct((-dice(b, t)).alias("against"), t["name"].alias("name"))))
    return F.filter(F.flatten(fitting), lambda m: -m["against"] >= threshold)


def passages(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_licenses, best_license, best_dice, licenses (sorted, comma-joined), and passages.

    These are the licences that ``scan`` finds and those in any run of successive
    words.  passages holds the closest run of each (license, dice, and the
    normalised words from and to); a licence that only a longer unit of many
    repeats reaches has none, but is named.
    """
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = _table(templates, threshold)
    nothing = F.lit(None).cast("struct<runs:array<struct<against:double,name:string,from:int,to:int>>,units:array<struct<against:double,name:string>>>")
    if table:
        every = F.array(*map(F.lit, sorted({p for t in templates.values() for p in bigrams_of(t)})))
        # no unit and no run reaches a template without enough of its bigrams somewhere in the text
        near = lambda own: _let(F.array_intersect(own, every), lambda some: F.filter(F.array(*table), lambda t: F.size(F.array_intersect(some, t["pairs"])) >= t["low"] - 1e-9))
        named = lambda own, t: _let(_best_run(own, t), lambda r: F.struct(r["against"].alias("against"), t["name"].alias("name"), r["from"].alias("from"), r["to"].alias("to")))
        runs = lambda own, ts: F.filter(F.transform(ts, lambda t: named(own, t)), lambda r: -r["against"] >= threshold)
        both = lambda own, ts: F.when(F.size(ts) > 0, F.struct(runs(own, ts).alias("runs"), _found(text, ts, threshold, F.lit(True)).alias("units")))
        found = F.when(_likely(text, templates, threshold), _let(F.split(_normal(text), " "), lambda w: _let(_pairs(w), lambda own: _let(near(own), lambda ts: both(own, ts))))).otherwise(nothing)
    else:
        found = nothing
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found")).select(
        "doc_id", *(F.coalesce(F.col("found")[k], F.array().cast(kind)).alias(k) for k, kind in (("runs", "array<struct<against:double,name:string,from:int,to:int>>"), ("units", "array<struct<against:double,name:string>>")))
    )
    alike = F.concat("units", F.transform("runs", lambda r: F.struct(r["against"].alias("against"), r["name"].alias("name"))))
    names = F.array_sort(F.array_distinct(F.transform(alike, lambda m: m["name"])))
    best = F.array_min(alike)
    return read.select(
        "doc_id",
        F.size(names).cast("long").alias("n_licenses"),
        best["name"].alias("best_license"),
        F.round(F.coalesce(-best["against"], F.lit(0.0)), 6).alias("best_dice"),
        F.array_join(names, ",").alias("licenses"),
        F.transform("runs", lambda r: F.struct(r["name"].alias("license"), F.round(-r["against"], 6).alias("dice"), r["from"].alias("from"), r["to"].alias("to"))).alias("passages"),
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_matches (pairs of a distinct passage and a template), best_license, best_dice, licenses (sorted, comma-joined)."""
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = _table(templates, threshold)
    if table:
        found = _found(text, F.array(*table), threshold, _likely(text, templates, threshold))
    else:
        found = F.array().cast("array<struct<against:double,name:string>>")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found"))
    best = F.array_min("found")
    return read.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        best["name"].alias("best_license"),
        F.round(F.coalesce(-best["against"], F.lit(0.0)), 6).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ",").alias("licenses"),
    )


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit and every run of words of every whole text against every template."""
    found = passages(read_table(spark, f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_licenses", "best_license", "best_dice", "licenses", F.size("passages").cast("long").alias("n_passages"))


def _oracle() -> str:
    """Units as lists, and runs as pairs of a first and a last word pair counted by windows over word positions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in sorted(TEMPLATES.items()))
    pairs = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    normal = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    far = widest(THRESHOLD)
    return f"""
WITH t AS (
  SELECT name, {pairs} AS b, (len(w) - 1) * {far.numerator} // {far.denominator} AS reach
  FROM (SELECT name, string_split({normal.format("text")}, ' ') AS w FROM (VALUES {rows}) AS v(name, text))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT DISTINCT doc_id, {normal.format("part")} AS part
  FROM (SELECT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10)))) AS part FROM d)),
b AS (SELECT doc_id, {pairs} AS b FROM (SELECT doc_id, string_split(part, ' ') AS w FROM u)),
units AS (
  SELECT doc_id, name, 2.0 * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice
  FROM b JOIN t ON len(b.b) BETWEEN {THRESHOLD} / (2 - {THRESHOLD}) * len(t.b) AND (2 - {THRESHOLD}) / {THRESHOLD} * len(t.b)),
tb AS (SELECT name, unnest(b) AS k FROM t),
w AS (SELECT doc_id, string_split({normal.format("text")}, ' ') AS w FROM d),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM w)),
hits AS (SELECT doc_id, name, i FROM p JOIN tb USING (k)),
near AS (
  SELECT doc_id, name FROM p JOIN tb USING (k) JOIN t USING (name)
  GROUP BY doc_id, name, len(t.b) HAVING count(DISTINCT k) >= {THRESHOLD} / (2 - {THRESHOLD}) * len(t.b) - 0.5),
pl AS (SELECT doc_id, i, k, coalesce(lag(i) OVER (PARTITION BY doc_id, k ORDER BY i), 0) AS before FROM p WHERE doc_id IN (SELECT doc_id FROM near)),
step AS (
  SELECT s.doc_id, s.name, s.i AS a, pl.i, pl.before < s.i AS new, h.i IS NOT NULL AS known
  FROM hits s JOIN near USING (doc_id, name) JOIN t USING (name) JOIN pl ON pl.doc_id = s.doc_id AND pl.i BETWEEN s.i AND s.i + t.reach - 1
  LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.name = s.name AND h.i = pl.i),
grown AS (
  SELECT doc_id, name, sum(CAST(new AS INTEGER)) OVER o AS n, sum(CAST(new AND known AS INTEGER)) OVER o AS hits
  FROM step WINDOW o AS (PARTITION BY doc_id, name, a ORDER BY i ROWS UNBOUNDED PRECEDING)),
runs AS (SELECT doc_id, name, max(2.0 * hits / (n + len(t.b))) AS dice FROM grown JOIN t USING (name) GROUP BY doc_id, name HAVING max(2.0 * hits / (n + len(t.b))) >= {THRESHOLD}),
g AS (
  SELECT doc_id, count(DISTINCT name) AS n, first(name ORDER BY dice DESC, name) AS best, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS names
  FROM (SELECT * FROM units WHERE dice >= {THRESHOLD} UNION ALL SELECT * FROM runs) GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n_licenses, best AS best_license, round(CAST(coalesce(g.dice, 0) AS DOUBLE), 6) AS best_dice, coalesce(names, '') AS licenses, coalesce(r.n, 0) AS n_passages
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id) r USING (doc_id)
"""


ORACLE_SQL = _oracle()
