"""Operator 7: license scans by the Dice coefficient over word bigrams.

Lines, paragraphs, whole texts and sentences are normalised to ASCII words and compared to license templates as sets of
word bigrams. Dice = 2 common / (a + b) can reach t only if the smaller set has at least t / (2 - t) of the larger, so
sizes alone rule most templates out. The same bound says how many of a template's bigrams a unit may lack: words whose
bigrams are more than these are needed, and a text or unit without any of them is not compared at all. DataFrame
functions only; a document never leaves its row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Production parameter: the least Dice coefficient.
LEAST = 0.8

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices and, as ``-body``, whole texts of public licenses by their short names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-grant": _BSD_GRANT,
    "BSD-2-Clause-body": f"{_BSD_GRANT}\n\n{_BSD_TERMS}{_BSD_REST}",
    "BSD-3-Clause-body": f"{_BSD_GRANT}\n\n{_BSD_TERMS}{_BSD_NAMES}{_BSD_REST}",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT_GRANT,
    "MIT-body": f"{_MIT_GRANT}\n\n{_MIT_REST}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """The sorted set of word bigrams of a template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every unit that fits a template holds at least one.

    A unit that fits has at least ``least / (2 - least)`` of the template's bigrams; words are taken, long ones first, until
    their bigrams are more than it may lack.
    """
    taken: set[str] = set()
    for template in sorted(templates.values(), key=lambda t: (len(t), t)):
        grams = [set(b.split()) for b in bigrams(template)]
        spare = len(grams) - math.ceil(len(grams) * least / (2 - least) - 1e-9)
        for word in sorted(set().union(*grams), key=lambda w: (-len(w), w)):
            if sum(not g.isdisjoint(taken) for g in grams) > spare:
                break
            taken.add(word)
    return sorted(taken)


#: Ends of sentences and paragraphs, alike in Java's patterns and RE2.
_END = r"[.!?][^a-z0-9 \t\r\n]*[ \t\r\n]+|\n[ \t\r]*\n"


def _units(low: Column, clean: Column) -> Column:
    """Lines, paragraphs of several lines, the text if it has several paragraphs, and each sentence that is none of these.

    ``low``: the text in lower case, ``clean``: its ASCII words, single blanks and line ends.
    """
    flat = lambda u: F.btrim(F.regexp_replace(u, r"[ \n]+", " "))
    paragraphs = F.filter(F.split(clean, r"\n ?\n"), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(clean.rlike(r"\n ?\n"), F.array(flat(clean))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(F.transform(F.split(clean, "\n"), lambda u: F.btrim(u)), F.transform(paragraphs, flat), whole)
    sentences = F.transform(F.split(low, _END), lambda p: F.btrim(F.regexp_replace(p, "[^a-z0-9]+", " ")))
    return let(blocks, lambda b: F.concat(b, F.array_except(sentences, b)))


def _best(words: Column, templates: dict[str, str], least: float) -> Column:
    """The best (dice, license) of a unit's words, or null."""
    known = {name: bigrams(t) for name, t in templates.items()}
    every = F.array(*[F.lit(b) for b in sorted({b for x in known.values() for b in x})])
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("size"), F.array(*[F.lit(x) for x in b]).alias("grams")) for name, b in known.items()])
    bound = least / (2 - least)
    smallest = min(map(len, known.values())) * bound
    largest = max(map(len, known.values())) / bound
    pairs = F.array_distinct(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))))

    def scored(grams: Column) -> Column:
        size = F.size(grams)
        fits = F.filter(rows, lambda t: (F.least(size, t["size"]) >= F.greatest(size, t["size"]) * bound - 1e-9))
        dice = F.transform(fits, lambda t: F.struct((F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (size + t["size"])).alias("dice"), t["license"].alias("license")))
        compared = (size >= smallest - 1e-9) & (size <= largest + 1e-9) & F.arrays_overlap(grams, every)
        return F.when(compared, F.array_max(F.filter(dice, lambda s: s["dice"] >= least)))

    return F.when(F.size(words) - 1 >= smallest - 1e-9, let(pairs, scored))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, n_units, dice), a license's units that it fits best and the best of them.

    Units are lines, paragraphs, whole texts, and distinct sentences that are no unit already, so a notice is found inside
    a longer line and over several lines; one that is only part of a sentence is no unit. Of templates that fit a unit
    equally well the last name counts. Null and empty texts have an empty array, an empty table no rows. Repeated rows are
    each scanned; texts of any length are scanned whole. A column of ``docs`` named ``licenses`` is replaced.
    """
    needed = needed_words(templates, least)
    any_needed = lambda t: F.greatest(*[F.contains(t, F.lit(w)) for w in needed], F.lit(False))

    def hits(t: Column) -> Column:
        units = F.filter(_units(t["low"], t["clean"]), any_needed)
        words = F.transform(units, lambda u: F.split(u, " "))
        return F.filter(F.transform(words, lambda w: _best(w, templates, least)), lambda s: s.isNotNull())

    def scanned(low: Column) -> Column:
        none = F.array().cast("array<struct<dice:double,license:string>>")
        of = lambda t: F.when(any_needed(t["clean"]), hits(t)).otherwise(none)
        return let(F.struct(low.alias("low"), F.regexp_replace(low, r"[^a-z0-9\n]+", " ").alias("clean")), of)

    def grouped(found: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(found, lambda s: s["license"])))

        def one(name: Column) -> Column:
            own = F.filter(found, lambda s: s["license"] == name)
            return F.struct(name.alias("license"), F.size(own).cast("long").alias("n_units"), F.array_max(F.transform(own, lambda s: s["dice"])).alias("dice"))

        return F.transform(names, one)

    return docs.drop("licenses").withColumn("licenses", let(let(F.lower(F.coalesce("text", F.lit(""))), scanned), grouped))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.license", "l.n_units", F.round("l.dice", 6).alias("dice"))


_VALUES = ",\n  ".join(f"('{name}', '{' '.join(re.sub(r'[^a-z0-9]+', ' ', t.lower()).split())}')" for name, t in TEMPLATES.items())
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
OP7_SQL = rf"""
WITH templates(license, t) AS (VALUES {_VALUES}),
t AS (SELECT license, {_PAIRS.format("string_split(t, ' ')")} AS g FROM templates),
d AS (SELECT doc_id, row_number() OVER () AS r, lower(coalesce(text, '')) AS l, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS c FROM documents),
k AS (SELECT r, doc_id, unnest(string_split(c, chr(10))) AS u FROM d
  UNION ALL SELECT r, doc_id, p FROM (SELECT r, doc_id, unnest(string_split_regex(c, '\n ?\n')) AS p FROM d) WHERE contains(p, chr(10))
  UNION ALL SELECT r, doc_id, c FROM d WHERE regexp_matches(c, '\n ?\n')),
v AS (SELECT r, doc_id, trim(regexp_replace(u, '[ \n]+', ' ', 'g')) AS u FROM k),
p AS (SELECT DISTINCT r, doc_id, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS u FROM (SELECT r, doc_id, unnest(string_split_regex(l, '{_END}')) AS s FROM d)),
u AS (SELECT doc_id, u FROM v UNION ALL SELECT doc_id, u FROM p ANTI JOIN v USING (r, u)),
n AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(u, '[ \n]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT n, doc_id, {_PAIRS.format("w")} AS g FROM n WHERE len(w) > 1),
s AS (SELECT n, doc_id, license, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g, t
  WHERE least(len(g.g), len(t.g)) >= greatest(len(g.g), len(t.g)) * {LEAST / (2 - LEAST)} - 1e-9),
b AS (SELECT * FROM s WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY n ORDER BY dice DESC, license DESC) = 1)
SELECT doc_id, license, count(*) AS n_units, round(max(dice), 6) AS dice FROM b GROUP BY doc_id, license
"""
