"""Licence scan: TF-IDF cosine of headers and files to templates, then directory inheritance.

DataFrame functions only.  What is compared are the units of a text: the whole text, its
paragraphs (so a notice that is wrapped over lines is one unit) and its statements (lines,
and sentences where a capital follows).  A unit is a sparse vector of (1 + ln tf) * idf
over the templates (common words have the lowest idf, terms of no template the highest), and a file's licence is
that of its best unit, if the cosine reaches `LEAST` and the unit shares at least two
different terms with the template that are not common words (one word alone, such as the
German "mit", states nothing).

Most units are far from every template, and two conditions that any match must meet keep
them out before their terms are counted:

* By Cauchy-Schwarz a cosine is at most the length of the template's part in the terms
  that both have.  So a template may leave out terms as long as they hold too little of
  its length, and a matching unit has one of the others (`keys`; the longer and less
  common words are kept, being rarer).  Texts without any key are dropped first.
* The same bound on all terms that a unit shares with a template.

Being alike is not enough, as notices of different licences are: the unit must have a name
of the template's family (`NAMES`), must not state another version, and must not state
another variant (`by-nc` and the like, Lesser and Affero).  An SPDX-License-Identifier of a
known licence counts as a match of 1.

A file with a licence of its own keeps it.  Licence files are those with a licence that
are named so (LICENSE, LICENCE, COPYING, UNLICENSE, NOTICE, with any extension) or whose
whole text matches a template.  The first of a directory, by path, covers the directory
and all below it, and a file without its own licence takes that of its nearest ancestor
directory.  Directories, not files, are joined with their ancestors, so a directory that
holds a third of all files is one row there.

Null and empty texts have no licence of their own.  Texts of any length are read whole.
Of equal scores the smaller licence name wins.  Repeated rows each get their row; rows
that share a path count as one file of all their units; rows without a path are left out.
Other columns are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import prepare, settle

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}
as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_EPL_HEADER = """This program and the accompanying materials are made available under the terms of the Eclipse Public License
2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
#: Creative Commons variants and versions, a notice each.
_CC = [(f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.") for version in ("4.0", "3.0") for kind in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")]

#: Notices, standard headers, titles and full texts by which works state
#: their licence, by SPDX name.  The long licences are known by header and title.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    *_CC,
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0."),
    ("EPL-2.0", _EPL_HEADER),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU_HEADER.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU_HEADER.format("General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU_HEADER.format("Lesser General Public License", 2.1)),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL_HEADER),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Unlicense", _UNLICENSE),
]
#: The words that name a licence family; of the texts without a name, words
#: that no other template has.
NAMES = {
    "AGPL": ("gnu",), "Apache": ("apache",), "BSD": ("bsd", "redistribution", "redistributions"), "CC": ("cc",), "CC0": ("cc0",), "EPL": ("eclipse", "epl"), "GPL": ("gnu",),
    "ISC": ("isc", "fee"), "LGPL": ("gnu",), "MIT": ("mit", "sublicense"), "MPL": ("mozilla", "mpl"), "Unlicense": ("unlicense", "unencumbered"),
}
#: Words that tell licences of the GNU family apart.
VARIANTS = {"AGPL": "affero", "LGPL": "lesser"}
#: The number behind a word that a version follows.
VERSION = r"(?:version|licen[cs]e,?|\bv\.?|\bcc0)[ \t\r\n]*(?:version|v\.?)?[ \t\r\n]*([0-9]{1,2}(?:\.[0-9]+)?)(?:[^0-9]|$)|\bby(?:-[a-z]{2})*[ \t]+([0-9]\.[0-9])(?:[^0-9]|$)"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6
SHARED = 2  # different terms, not common ones
NAMED = "(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
#: English words that say nothing about licences; their idf is the lowest,
#: as if every template had them.
COMMON = (
    "a all along also an and any anyone are as at be but by can charge code data deal do even event file files for form forms free from have hope however if in "
    "include included including into is it its january june kind large later law laws list loss made make may means more must name names neither no nor not november "
    "obtain obtaining of on one option or other otherwise our out present prior program required see sell services shall should so special specific such than that the this to "
    "under unless until use used useful version was way we were whether which whom will with within without work writing written you your"
).split()
#: Where a text is cut into statements and paragraphs.
CAPITAL, LINES, BLANK = r"([.!?])[ \t\r\n]+([A-Z])", "[\r\n]+", "\n[ \t\r]*\n"


def vectors() -> list[dict[str, tuple[float, float]]]:
    """Of each template: its terms' weights and idf."""
    tf = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    df = Counter(term for own in tf for term in own)
    idf = {t: 1.0 if t in COMMON else math.log((1 + len(tf)) / (1 + n)) + 1 for t, n in df.items()}
    return [{t: ((1 + math.log(n)) * idf[t], idf[t]) for t, n in own.items()} for own in tf]


def shares() -> list[dict[str, float]]:
    """Of each template: its terms' shares of the square of its length."""
    out = []
    for own in vectors():
        total = sum(w * w for w, _ in own.values())
        out.append({t: w * w / total for t, (w, _) in own.items()})
    return out


def _enough(least: float) -> float:
    """The share of a template that a cosine of `least` needs (scores are rounded to six digits)."""
    return max(0.0, least - 1e-6) ** 2 - 1e-9


def family(license: str) -> str:
    return license.split("-", 1)[0]


def version(license: str) -> str | None:
    """The version that a licence's name ends in, without a zero behind the point."""
    found = re.search(r"-([0-9]+\.[0-9]+)$", license)
    return found and re.sub(r"\.0$", "", found[1])


def _weights(spark: SparkSession) -> DataFrame:
    """(template, license, term, w, idf, norm, share, named), a row for each term of a template."""
    rows = []
    for n, (own, part) in enumerate(zip(vectors(), shares(), strict=True)):
        norm, license = math.sqrt(sum(w * w for w, _ in own.values())), TEMPLATES[n][0]
        rows += [f"({n}, '{license}', '{t}', {w!r}D, {idf!r}D, {norm!r}D, {part[t]!r}D, {str(t in NAMES[family(license)]).lower()})" for t, (w, idf) in own.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, license, term, w, idf, norm, share, named)")


def _kinds(spark: SparkSession) -> DataFrame:
    """(license, version, must, other): what a licence's units state: no version but its own,
    all of `must`, none of `other`; `cc` has the variant of Creative Commons."""
    rows = []
    for license in sorted({name for name, _ in TEMPLATES}):
        own, cc = VARIANTS.get(family(license)), license.lower()[3:-4] if license.startswith("CC-") else None
        other = [v for v in VARIANTS.values() if v != own] if family(license) in ("GPL", *VARIANTS) and own is None else []
        text = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
        rows.append(f"('{license}', {text(version(license))}, {text(own or cc)}, CAST(array({', '.join(map(text, other))}) AS array<string>), {str(cc == 'by').lower()})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(license, version, must, other, plain)")


def units(files: DataFrame) -> DataFrame:
    """(path, unit, whole) of the texts of `files` (path, text)."""
    statements = F.split(F.regexp_replace("text", CAPITAL, "$1\n$2"), LINES)
    every = F.array_distinct(F.concat(F.array("text"), F.split("text", BLANK), statements))
    return files.select("path", "text", F.explode(every).alias("unit")).select("path", "unit", (F.col("unit") == F.col("text")).alias("whole"))


def _terms(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TERM), F.lit(0))


def _versions(column: Column) -> Column:
    both = F.concat(*(F.regexp_extract_all(F.lower(column), F.lit(VERSION), F.lit(k)) for k in (1, 2)))
    return F.transform(F.filter(both, lambda v: v != ""), lambda v: F.regexp_replace(v, r"\.0$", ""))


def identified(files: DataFrame) -> DataFrame:
    """(path, license) of the files with the SPDX identifier of a known licence; of several
    the first counts."""
    names = F.create_map(*(F.lit(x) for name in sorted({n for n, _ in TEMPLATES}) for x in (name.lower(), name)))
    stated = F.regexp_replace(F.lower(F.regexp_extract("text", SPDX, 1)), r"(-only|-or-later|\+)$", "")
    found = files.where(F.col("text").contains("SPDX-License-Identifier:")).select("path", F.element_at(names, stated).alias("license"))
    return found.where("license IS NOT NULL").groupBy("path").agg(F.min("license").alias("license"))


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score, whole) of the files that state a licence."""
    spark = files.sparkSession
    known = F.broadcast(_weights(spark))  # the templates' terms, a fixed list
    anywhere = f"(?<![a-z0-9])(?:{'|'.join(sorted({n for own in NAMES.values() for n in own}))})(?![a-z0-9])"
    likely = units(files.where(F.lower("text").rlike(anywhere))).where(F.lower("unit").rlike(anywhere))
    likely = likely.select("path", F.md5("unit").alias("id"), "whole", _terms(F.col("unit")).alias("terms"), _versions(F.col("unit")).alias("versions"))
    telling = F.array(*(F.lit(t) for t in sorted({t for own in vectors() for t in own} - set(COMMON))))
    likely = likely.where(F.size(F.array_intersect("terms", telling)) >= SHARED)
    likely = settle(likely.groupBy("path", "id").agg(F.first("terms").alias("terms"), F.first("versions").alias("versions"), F.max("whole").alias("whole")))
    # Terms are found once; only units that share enough of a template with its name go on.
    shared = likely.select("path", "id", F.explode(F.array_distinct("terms")).alias("term")).join(known, "term")
    enough = (F.sum("share") >= _enough(least)) & (F.sum((F.col("idf") > 1).cast("int")) >= SHARED) & F.max("named")
    near = shared.groupBy("path", "id", "template", "license").agg(enough.alias("enough")).where("enough").select("path", "id", "template", "license")
    kinds = F.broadcast(_kinds(spark))  # a row a licence
    same = F.col("version").isNull() | (F.size("versions") == 0) | F.array_contains("versions", F.col("version"))
    variant = F.col("must").isNull() | F.array_contains("terms", F.col("must"))
    mixed = F.arrays_overlap("terms", "other") | (F.col("plain") & F.exists("terms", lambda t: t.rlike("^by(-(nc|nd|sa))+$")))
    near = near.join(likely, ["path", "id"]).join(kinds, "license").where(same & variant & ~F.coalesce(mixed, F.lit(False)))
    near = settle(near.select("path", "id", "template", "license", "terms", "whole"))
    counted = near.dropDuplicates(["path", "id"]).select("path", "id", F.explode("terms").alias("term"))
    tf = counted.groupBy("path", "id", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = F.broadcast(_weights(spark).select("term", "idf").distinct())
    own = tf.join(idf, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + len(TEMPLATES)) + 1)))
    lengths = own.groupBy("path", "id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = own.drop("idf").join(known, "term").groupBy("path", "id", "template", "license", "norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(near.select("path", "id", "template", "whole"), ["path", "id", "template"]).join(lengths, ["path", "id"])
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6)).where(F.col("score") >= least).select("path", "license", "score", "whole")
    scored = scored.unionByName(identified(files).select("path", "license", F.lit(1.0).alias("score"), F.lit(False).alias("whole")))
    best = F.min(F.struct((-F.col("score")).alias("loss"), F.col("license").alias("license")))
    return scored.groupBy("path").agg(best.alias("b"), F.max("whole").alias("whole")).select("path", F.col("b.license").alias("license"), (-F.col("b.loss")).alias("score"), "whole")


def _parent(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score, origin, from_path) of every row of `files` (path, text);
    origin is own, inherited or none."""
    prepare(files.sparkSession)
    files = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("path IS NOT NULL")
    own = settle(own_licenses(files, least))
    placed = files.select("path", _parent(F.col("path")).alias("dir"))
    covers = own.where(F.col("whole") | F.col("path").rlike(NAMED)).groupBy(_parent(F.col("path")).alias("above")).agg(
        F.min(F.struct("path", "license", "score")).alias("c")
    )
    dirs = placed.select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("n")).select("dir", "n", F.concat_ws("/", F.slice(F.split("dir", "/"), 1, F.col("n"))).alias("above"))
    nearest = above.join(covers, "above").groupBy("dir").agg(F.max(F.struct("n", "c")).alias("x")).select("dir", F.col("x.c").alias("c"))
    found = placed.join(own.drop("whole"), "path", "left").join(nearest, "dir", "left")
    return found.select(
        "path",
        F.coalesce("license", "c.license").alias("license"),
        F.coalesce("score", "c.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("c").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("c.path")).alias("from_path"),
    )


def oracle_sql(paths: str, least: float = LEAST) -> str:
    """The same over `paths`, a DuckDB query that gives (doc_id, path, text), by the
    definition alone: every unit against every template, nothing kept out beforehand."""
    rows = ", ".join(f"({n}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for n, (name, text) in enumerate(TEMPLATES))
    names = " ".join(f"WHEN '{own}' THEN {list(words)}" for own, words in NAMES.items())
    has = lambda word: f"list_contains(ts, '{word}')"
    n, common = len(TEMPLATES), ", ".join(f"'{w}'" for w in COMMON)
    parent = "regexp_replace({}, '/?[^/]*$', '')"
    return rf"""
WITH files AS ({paths}),
t AS (SELECT template, license, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM (VALUES {rows}) AS t(template, license, text)),
tf AS (SELECT template, license, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, CASE WHEN term IN ({common}) THEN 1.0::DOUBLE ELSE ln((1 + {n}) / (1.0 + count(*))) + 1 END AS idf FROM tf GROUP BY term),
w AS (SELECT template, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM tf JOIN d USING (term)),
s AS (SELECT path, text, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '{BLANK}'), regexp_split_to_array(regexp_replace(text, '{CAPITAL}', '\1' || chr(10) || '\2', 'g'), '{LINES}')))) AS unit FROM files),
k AS (SELECT path, unit, bool_or(unit = text) AS whole FROM s GROUP BY ALL),
term AS (SELECT path, unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM k),
v AS (SELECT path, unit, term, (1 + ln(count(*))) * coalesce(any_value(idf), ln(1.0 + {n}) + 1) AS v FROM term LEFT JOIN d USING (term) GROUP BY ALL),
norm AS (SELECT path, unit, sqrt(sum(v * v)) AS length FROM v GROUP BY ALL),
dot AS (SELECT path, unit, template, license, sum(v * w) AS dot, any_value(norm) AS norm FROM v JOIN w USING (term) GROUP BY ALL HAVING count(*) FILTER (WHERE term NOT IN ({common})) >= {SHARED}),
alike AS (SELECT path, unit, lower(unit) AS u, license, split_part(license, '-', 1) AS family, round(dot / (norm * length), 6) AS score, whole FROM dot JOIN norm USING (path, unit) JOIN k USING (path, unit) WHERE dot / (norm * length) > {least} - 0.001),
stated AS (SELECT *, regexp_extract_all(u, '{TERM}') AS ts, list_concat(regexp_extract_all(u, '{VERSION}', 1), regexp_extract_all(u, '{VERSION}', 2)) AS vs, regexp_extract(license, '-([0-9]+[.][0-9]+)$', 1) AS v FROM alike),
spdx AS (SELECT path, lower(regexp_extract(text, '{SPDX}', 1)) AS id FROM files WHERE text LIKE '%SPDX-License-Identifier:%'),
scored AS (
  SELECT path, license, score, whole FROM stated
  WHERE list_has_any(ts, CASE family {names} END)
    AND (v = '' OR len(list_filter(vs, lambda x: x <> '')) = 0 OR list_contains(list_transform(vs, lambda x: regexp_replace(x, '[.]0$', '')), regexp_replace(v, '[.]0$', '')))
    AND CASE family WHEN 'AGPL' THEN {has("affero")} WHEN 'LGPL' THEN {has("lesser")} WHEN 'GPL' THEN NOT {has("affero")} AND NOT {has("lesser")}
      WHEN 'CC' THEN list_contains(ts, lower(license[4:-5])) AND (license NOT LIKE 'CC-BY-_._' OR len(list_filter(ts, lambda x: regexp_matches(x, '^by(-(nc|nd|sa))+$'))) = 0) ELSE true END
  UNION ALL SELECT s.path, t.license, 1.0, false FROM spdx s JOIN (SELECT DISTINCT license FROM t) t ON lower(t.license) = regexp_replace(s.id, '(-only|-or-later|[+])$', '')),
own AS (SELECT path, arg_min(license, (-score, license)) AS license, max(score) AS score, bool_or(whole) AS whole FROM scored WHERE score >= {least} GROUP BY path),
covers AS (SELECT {parent.format("path")} AS above, min(path) AS path, arg_min(license, path) AS license, arg_min(score, path) AS score FROM own WHERE whole OR regexp_matches(path, '{NAMED}') GROUP BY ALL),
dirs AS (SELECT DISTINCT {parent.format("path")} AS dir FROM files),
ups AS (SELECT dir, n, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS above FROM dirs, (SELECT unnest(range(0, 32)) AS n) WHERE n <= len(string_split(dir, '/'))),
nearest AS (SELECT dir, arg_max(c.path, n) AS path, arg_max(c.license, n) AS license, arg_max(c.score, n) AS score FROM ups JOIN covers c USING (above) GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(o.license, c.license) AS license, coalesce(o.score, c.score) AS score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN c.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN f.path ELSE c.path END AS from_path
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN nearest c ON c.dir = {parent.format("f.path")}
"""
