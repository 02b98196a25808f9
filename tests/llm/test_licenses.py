import collections
import math
import random
import re

from leafmark.llm import licenses

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def test_scan(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/x/one.py", "code " * 90), ("a/x/y/two.py", None), ("a/x/y/three.py", "# " + GPL + "\n" + " ".join(f"w{i}" for i in range(90))), ("b/four.py", "code"), ("a/x/five.py", "the license is lost"),
        ("COPYING", "Licensed under CC BY-NC 4.0."), ("b/c/LICENSE", "Licenced under the Apache License Version 2.0"), ("b/c/d/six.py", ""), (None, MIT), ("b/c/d/six.py", ""),
    ]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, score double")
    found = {}
    for r in licenses.scan(frame).collect():
        found.setdefault(r.path, []).append((r.license, r.origin, r.from_path))
    assert found["a/LICENSE"] == [("MIT", "own", "a/LICENSE")]
    assert found["a/x/one.py"] == found["a/x/y/two.py"] == found["a/x/five.py"] == [("MIT", "inherited", "a/LICENSE")]
    assert found["a/x/y/three.py"] == [("GPL-3.0", "own", "a/x/y/three.py")]
    assert found["b/four.py"] == [("CC-BY-NC-4.0", "inherited", "COPYING")]
    assert found["b/c/LICENSE"][0][0] == "Apache-2.0"
    assert found["b/c/d/six.py"] == [("Apache-2.0", "inherited", "b/c/LICENSE")] * 2
    assert len(found) == 9


def test_empty_and_plain(spark):
    frame = spark.createDataFrame([("x/a", "no notice here")], "path string, text string")
    assert [(r.license, r.origin) for r in licenses.scan(frame).collect()] == [(None, "none")]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_every_template_finds_itself(spark):
    frame = spark.createDataFrame([(f"{i}/{n}", t) for i, (n, t) in enumerate(licenses.TEMPLATES)], "path string, text string")
    for r in licenses.scan(frame).collect():
        assert r.path.endswith(f"/{r.license}") and r.score >= 0.999


def test_full_licence_files_and_wrapped_headers(spark):
    full = {n: t for n, t in licenses.TEMPLATES if len(t) > 900}
    header = "/*\n * " + next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and "compliance" in t).replace("\n", "\n * ") + "\n */\n\n" + " ".join(f"call{i}();" for i in range(300))
    rows = [("m/LICENSE", full["MIT"]), ("m/a/b/one.c", "int x;"), ("n/license.md", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + full["MIT"]), ("n/two.c", None), ("o/three.c", header), ("o/four.c", "x")]
    rows += [("p/other", full["BSD-3-Clause"]), ("p/five.c", "x"), ("q/six", " ".join(f"prose{i}" for i in range(9000)) + "\n\n" + full["BSD-2-Clause"]), ("q/seven", "x")]
    found = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found["m/LICENSE"] == ("MIT", "own") and found["m/a/b/one.c"] == ("MIT", "inherited")
    assert found["n/license.md"] == ("MIT", "own") and found["n/two.c"] == ("MIT", "inherited")
    assert found["o/three.c"] == ("Apache-2.0", "own") and found["o/four.c"] == (None, "none")
    assert found["p/other"] == ("BSD-3-Clause", "own") and found["p/five.c"] == ("BSD-3-Clause", "inherited")
    assert found["q/six"] == ("BSD-2-Clause", "own") and found["q/seven"] == (None, "none")


def contradicted(unit, name):
    """Whether a unit lacks the licence's name, or states another version or variant."""
    low = unit.lower()
    terms = set(re.findall(licenses.TERM, low))
    if not terms & set(licenses.NAMES[name.split("-")[0]]):
        return True
    versions = {float(v) for pair in re.findall(licenses.VERSION, low) for v in pair if v}
    own = re.search(r"-(\d+\.\d+)$", name)
    if own and versions and float(own[1]) not in versions:
        return True
    variants = {t for t in terms if re.fullmatch("by(-(nc|nd|sa))*", t)}
    if name.startswith("CC-"):
        kind = name.lower()[3:-4]
        return kind not in variants or (kind == "by" and variants != {"by"})
    gnu = {"AGPL": {"affero"}, "LGPL": {"lesser"}, "GPL": set()}.get(name.split("-")[0])
    return gnu is not None and (not gnu <= terms or (not gnu and bool(terms & {"affero", "lesser"})))


def brute(rows, least=licenses.LEAST):
    """Own licences by the definition: every unit against every template."""
    terms = lambda t: collections.Counter(re.findall(licenses.TERM, t.lower()))
    templates = [(n, terms(t)) for n, t in licenses.TEMPLATES]
    df = collections.Counter(t for _, own in templates for t in own)
    idf = lambda t: 1 if t in df and t in licenses.COMMON else math.log((1 + len(templates)) / (1 + df[t])) + 1
    vector = lambda c: {t: (1 + math.log(n)) * idf(t) for t, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(n, vector(c)) for n, c in templates]
    out = {}
    for path, text in rows:
        units = {text, *re.split("\n[ \t\r]*\n", text), *re.split("[\r\n]+", re.sub(r"([.!?])[ \t\r\n]+([A-Z])", r"\1\n\2", text))}
        found = []
        for unit in units:
            u = vector(terms(unit))
            for name, t in templates:
                both = u.keys() & t.keys()
                if len(both - set(licenses.COMMON)) >= 2 and not contradicted(unit, name):
                    found.append((-round(sum(u[x] * t[x] for x in both) / length(u) / length(t), 6), name))
        out[path] = min((x for x in found if -x[0] >= least), default=None)
    return out


def test_against_every_unit_and_template(spark):
    rng = random.Random(8)
    words = sorted({w for _, t in licenses.TEMPLATES for w in re.findall("[A-Za-z0-9.-]+", t)}) + ["mit", "By", "code", "der", "é"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(licenses.TEMPLATES)[1].split(" ")
            kind = rng.random()
            if kind < 0.4:  # an edited notice
                own = [rng.choice(words) if rng.random() < 0.3 else w for w in own if rng.random() < 0.8]
            elif kind < 0.8:
                own = rng.choices(words, k=rng.randint(1, 25))
            parts.append(" ".join(own))
        rows.append((f"d{i}/f", rng.choice(["\n", "\n\n", ". ", "\r\n"]).join(parts)))
    found = {r.path: r.license and (-r.score, r.license) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    expected = brute(rows)
    assert sum(x is not None for x in expected.values()) > 100
    for path, got in found.items():
        want = expected[path]
        assert (got is None) == (want is None) and (got is None or (got[1] == want[1] and abs(got[0] - want[0]) < 2e-6)), (path, got, want)


def test_statements_without_a_key(spark):
    rows = [
        ("a/COPYING", "This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("b/COPYING", "Dedicated to the public domain under CC0 1.0.", "CC0-1.0"),
        ("c/COPYING", "Released under MIT.", "MIT"),
        ("d/COPYING", "The software is with the public.\nBy.\nmit", None),
    ]
    frame = spark.createDataFrame([r[:2] for r in rows] + [("a/x/one", "code")], "path string, text string")
    found = {r.path: r.license for r in licenses.scan(frame).collect()}
    assert found == {**{r[0]: r[2] for r in rows}, "a/x/one": "Unlicense"}


NEGATIVE = """Released under the license.|Licensed under CC BY 2.0.|Licensed under the license, version 2.0.|This library is licensed under the GNU Lesser General Public License, version 2.0.
Licensed under CC BY-NC-ND 2.5.|Released under the terms.|This work is licensed under the license.|Licensed under the Apache License, Version 1.1.|Licensed under the Apache License, Version 3.|Mozilla Public License Version 1.1
This work is licensed under the GNU General Public License, version 1.|This work is licensed under the General Public License.|The license is the license.|Version 2.0|Version 3, 29 June 2007|Licensed under 4.0.|Licensed under the public license 2.0.
This Source Code Form is subject to the terms of the Public License.|This is free software released into the public domain.|Dedicated to the public domain.|Dedicated to the public domain under the 1.0 license.|The software is provided "as is".
Permission is hereby granted.|Licensed to the reader.|Public License Version 2.0|This program is licensed under the public license, version 3.|Copyright notice and this permission notice.|By by by by.|mit|cc|isc|gnu|apache|Released
Licensed under CC BY-XX 4.0.|License License License.|This program is distributed in the hope that it will be useful.|you may not use this file except in compliance with the License|A license for the dog, version 2.0|General Public License Version 2, June 1991
See the License for the specific language governing permissions and limitations under the License.|Unless required by applicable law or agreed to in writing|The Eclipse of the sun, version 2.0|Licensed under the Eclipse Public License 1.0.
This work is licensed under the GNU Affero General Public License, version 1.|This library is free.|Software is furnished to do so|Subject to the terms of the contract, v. 2.0.|License Version 2.0, January 2004|Released under license of the king.
SPDX-License-Identifier: Unknown-1.0|SPDX-License-Identifier:|SPDX: MIT""".replace("\n", "|").split("|")


def test_negative_statements(spark):
    assert len(NEGATIVE) >= 50
    frame = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(NEGATIVE)], "path string, text string")
    assert {NEGATIVE[int(r.path[1:-2])]: r.license for r in licenses.scan(frame).collect() if r.license} == {}


def test_versions_variants_and_identifiers(spark):
    rows = [
        ("... under CC BY-NC-ND 4.0.", None), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"), ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPL-2.1"), ("Licensed under the Apache License, Version 2.", "Apache-2.0"),
        ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-only\ncode", "GPL-2.0"), ("/* SPDX-License-Identifier: (Apache-2.0 OR MIT) */", "Apache-2.0"), ("SPDX-License-Identifier: lgpl-2.1-or-later", "LGPL-2.1"),
        ("Licensed under the Eclipse Public License 2.0.", "EPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0"), ("Released under the MIT license.", "MIT"),
    ]
    found = {r.path: r.license for r in licenses.scan(spark.createDataFrame([(f"d{i}/f", t) for i, (t, _) in enumerate(rows)], "path string, text string")).collect()}
    got = {t: found[f"d{i}/f"] for i, (t, _) in enumerate(rows)}
    assert {t: x for t, x in got.items() if t != rows[0][0]} == dict(rows[1:])
    assert got[rows[0][0]] in (None, "CC-BY-NC-ND-4.0")


def test_clashing_names_and_long_texts(spark):
    text = "x " * 600_000 + "\n\n" + MIT
    frame = spark.createDataFrame([("a/b", text, 1, "t", "l", True, 2)], "path string, text string, unit int, term string, license string, whole boolean, score int")
    assert [(r.license, r.origin) for r in licenses.scan(frame).collect()] == [("MIT", "own")]


def test_null_source(spark, tmp_path):
    from leafmark.llm import queries

    frame = spark.createDataFrame([(5310, None, MIT), (5313, None, "code"), (5314, "s", "code"), (5320, "s", MIT)], "doc_id long, source string, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.path, r.license) for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    assert found == {5310: ("/5/LICENSE.5310", "MIT"), 5313: ("/5/53/5313", "MIT"), 5314: ("s/5/53/5314", "MIT"), 5320: ("s/5/LICENSE.5320", "MIT")}
