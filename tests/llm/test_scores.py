import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lavrado.llm import grammar, language_id, licences, toxicity
from lavrado.llm.queries import oracle_sql, queries

from . import cases


def test_licences_against_sql(spark, sf_dir):
    got = queries()["op1_licence_scan"](spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(oracle_sql()["op1_licence_scan"])
    assert want.columns == got.columns
    assert cases.table(got) == sorted(want.fetchall(), key=repr)
    assert got.where("n_known > 0").count() > 0


def test_licences_of_odd_rows(spark):
    got = {r.doc_id: r for r in licences.scan(cases.frame(spark)).collect()}
    assert got[21].licences == "Apache-2.0" and got[21].n_known == 3 and got[21].n_unmatched == 0
    assert got[0].licences == "" and got[3].n_known == 0
    assert licences.scan(cases.frame(spark)).count() == len(cases.fixture_rows())
    assert licences.scan(cases.frame(spark, [])).count() == 0


BSD_TEXT = """Copyright {who}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
NAMES = "   * Neither the name of {} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
ADVERT = "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the University.\n"
FREE = "This {what} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation; either version {n} of the License, or\n(at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
PUBLISHED = [
    (BSD_TEXT.format(who="2008 Google Inc", by="THE COPYRIGHT HOLDERS AND CONTRIBUTORS", more=NAMES.format("Google Inc.")), "BSD-3-Clause"),
    (BSD_TEXT.format(who="(c) 2011, The Some Thing Project Authors", by="THE COPYRIGHT HOLDERS AND CONTRIBUTORS", more=NAMES.format("the copyright holder")), "BSD-3-Clause"),
    (BSD_TEXT.format(who="(c) 1990 The Regents of the University of California", by="THE REGENTS AND CONTRIBUTORS", more=ADVERT + NAMES.format("the University")), "BSD-4-Clause"),
    (BSD_TEXT.format(who="2020 Foo", by="THE AUTHOR AND CONTRIBUTORS", more=""), "BSD-2-Clause"),
    (FREE.format(what="program", kind="", n=2), "GPL-2.0-or-later"), (FREE.format(what="program", kind="", n=3), "GPL-3.0-or-later"), (FREE.format(what="library", kind="Lesser ", n="2.1"), "LGPL-2.1-or-later"), (FREE.format(what="library", kind="Library ", n=2), "LGPL-2.0-or-later"),
    (FREE.format(what="file", kind="Lesser ", n=3), "LGPL-3.0-or-later"), (FREE.format(what="program", kind="Affero ", n=3), "AGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License version 2 as published by the\nFree Software Foundation.", "GPL-2.0-only"),
    ("Copyright (c) 2004 X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\")", "BSL-1.0"),
    (" * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at x", "EPL-2.0"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0-only"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("SPDX-License-Identifier: MIT-0", "MIT-0"),
    ("Copyright 2020 Foo. All rights reserved.", "Proprietary"), ("No licence here, but a license is spoken of.", ""),
]


def test_published_texts(spark):
    """What the texts are was written by hand, not taken from the tables."""
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PUBLISHED)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(rows).collect()}
    assert [(got[k].licences, got[k].n_unmatched) for k in range(len(PUBLISHED))] == [(w, 0) for _, w in PUBLISHED]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(k, t) for k, (t, _) in enumerate(PUBLISHED)])
    assert sorted(con.sql(licences.sql()).fetchall()) == sorted((r.doc_id, r.n_known, r.sentence_ids, r.licences, r.n_unmatched, len(r.unknown)) for r in got.values())


def test_a_rule_needs_its_sentences_in_order(spark):
    rows = [(1, "You may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0."), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licences, r.n_unmatched) for r in got] == [("Apache-2.0", 1), ("Apache-2.0", 0)]


MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2024, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


BSD3 = BSD + """
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL2_TERMS = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"
GPL3_TERMS = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"
APACHE_TERMS = "                                 Apache License\n                           Version 2.0, January 2004\n"


def scanned(spark, rows):
    """The scan in Spark; it has to be what the SQL gives."""
    got = sorted((tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "n_known", "sentence_ids", "licences", "n_unmatched", "cast(size(unknown) as bigint)").collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(con.sql(licences.sql()).fetchall(), key=repr)
    return {r[0]: dict(zip(("n_known", "sentence_ids", "licences", "n_unmatched", "n_unknown"), r[1:])) for r in got}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_licences_of_whole_wrapped_texts(spark, end):
    comment = lambda t: "/*\n" + "".join(f" * {x}\n" if x else " *\n" for x in t.split("\n")) + " */\nint main;"
    every = lambda t: [t, comment(t), t.replace("\n", " "), "Some intro.\n\n" + t.upper()]
    gpl2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    negated = "This project is not licensed under the\nMIT License."
    parts = "Licensed under the Apache License,\n\nVersion 2.0"
    texts = {
        "MIT": every(MIT), "BSD": [BSD, comment(BSD)], "BSD-3-Clause": every(BSD3), "BSD-2-Clause": every(BSD2), "MPL-2.0": every(MPL), "GPL-3.0-or-later": every(GPL), "GPL-2.0-or-later": every(gpl2), "Apache-2.0": [*every(APACHE), *every(APACHE_TERMS)],
        "GPL-2.0": every(GPL2_TERMS), "GPL-3.0": every(GPL3_TERMS), "": [negated, parts, "licensed" + " " * 100_000 + "under. " + "." * 100_000, "\n" * 100_000 + "license", "\x01 <MITrel> \x03"],
    }
    rows = [(i, t.replace("\n", end), want) for i, (t, want) in enumerate((t, want) for want, own in texts.items() for t in own)]
    got = scanned(spark, [r[:2] for r in rows])
    assert {i: r["licences"] for i, r in got.items()} == {i: want for i, _, want in rows}
    assert got[0]["sentence_ids"] == "MITgrant;MITnotice;AsIsCaps"
    assert all(r["n_unmatched"] == (1 if want == "BSD" else 0) for r, (_, _, want) in zip((got[i] for i in sorted(got)), rows))


def test_unknown_licence_sentences_are_reported(spark):
    rows = [(1, "Use is granted under the Foo\nPublic License 1.1. The end."), (2, "All rights reserved. All rights reserved.\nAll rights reserved"), (3, "A licensee walks."), (4, None), (5, "")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].unknown == ["use is granted under the foo public license 1 1"] and got[2].sentence_ids == "Reserved;Reserved;Reserved"
    assert got[2].unknown == got[3].unknown == got[4].unknown == got[5].unknown == []
    scanned(spark, rows)


def test_language_id_on_held_out_rows(spark, sf_dir):
    got = queries()["op6_language_id"](spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").collect()
    assert all(r.held_out == cases.held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None and any(c.isalpha() for c in r.text or "")]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)


def test_language_id_of_odd_rows(spark):
    df = cases.frame(spark)
    model = language_id.fitted(df)
    got = language_id.identify(df, model)
    assert got.count() == len(cases.fixture_rows())
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert {by[0], by[2], by[4]} == {"und"} and by[8] in ("en", "de")
    assert language_id.fitted(df.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    only = language_id.fitted(df.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(df, only).collect()} == {"und", "en"}


def test_texts_of_signs_have_no_language(spark):
    rows = [(1, "½"), (2, "² ③ Ⅷ"), (3, "1_2"), (4, "ª"), (5, "中"), (6, "x")]
    model = language_id.fitted(cases.frame(spark))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i for i, p in got.items() if p == "und"} == {i for i, t in rows if not any(c.isalpha() for c in t)} == {1, 2, 3}


def test_a_language_of_one_repeated_text_is_learned(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'ein Satz' else concat('a sentence ', id) end text", "case when id % 3 = 0 then 'de' else 'en' end lang")
    for rows in (5, 50, 500):
        assert language_id.fitted(df, rows=rows).languages == ["de", "en"]


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 7, 12])
def test_codewords_differ(languages):
    code = language_id.codewords(languages)
    assert len({tuple(row) for row in code.tolist()}) == languages


def test_toxicity_on_held_out_rows(spark, sf_dir):
    got = queries()["op9_toxicity"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.9
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_finds_toxic_rows_of_every_language(spark, sf_dir):
    sf = f"{os.path.dirname(sf_dir)}/sf0.1"  # smaller tables hold one held-out toxic row of a language
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    got = queries()["op9_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").join(docs, "doc_id")
    rates = {(r.lang, r.toxic): r.right for r in got.groupBy("lang", "toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).collect()}
    print(rates)
    assert {lang for lang, toxic in rates if toxic} >= {"en", "de", "fr", "es"}
    assert min(right for (_, toxic), right in rates.items() if toxic) > 0.85
    assert min(right for (_, toxic), right in rates.items() if not toxic) > 0.95


def test_stem_keys_tell_stems_apart():
    words = ["fool", "fools", "foolish", "foo", "boco", "bocoas"]
    pairs = [(s, k) for w in words for s, k in zip(toxicity.stems(w), toxicity.stem_keys(w), strict=True)]
    assert len({s for s, _ in pairs}) == len({k for _, k in pairs}) == len(set(pairs))
    assert toxicity.stems("abcdefgh") == ["abcdefgh", "abcd*", "abcde*", "abcdef*", "abcdefg*"]
    assert toxicity.matches("abcdefgh", {"abcdefg*": 2.0})[0] == 2


def test_toxicity_of_odd_rows(spark):
    df = cases.frame(spark)
    model = toxicity.fitted(df.selectExpr("text", "cast(doc_id % 2 as int) label"))
    got = toxicity.score(df, model)
    assert got.count() == len(cases.fixture_rows()) and got.where("score is null").count() == 0
    assert toxicity.score(df.limit(0), toxicity.fitted(df.limit(0).selectExpr("text", "1 label"))).count() == 0


def test_clause_grammar():
    lexicon = {"fool": 2.0}
    kinds = lambda t: {k: x for k, x in zip(toxicity.KINDS, toxicity.matches(t, lexicon)) if x}
    assert kinds("a fool walks") == {"plain": 2}
    assert kinds("you fool") == kinds("what a fool you are") == {"directed": 2}
    assert kinds("fool and more words between you") == {"plain": 2}
    assert kinds("not a fool") == kinds("you aren't a fool") == {"negated": 2} and kinds("no, you fool") == {"directed": 2}
    assert kinds("She said: nothing. He said that one is a fool") == {"reported": 2}
    assert kinds('he said: "you are a fool"') == {"reported": 2}
    assert kinds('he said: "go home. you are a fool". you fool') == {"reported": 2, "directed": 2}
    assert kinds('"you are a fool", the man said') == {"reported": 2} and kinds('"you are a fool", the man left') == {"directed": 2}
    assert kinds("i will kill you") == {"threat": 1} and kinds("kill the process") == {}
    assert kinds("i will not kill you") == {"negated": 1}
    assert kinds("she said he will kill you") == {"reported": 1}
    assert kinds("kill the process. you fool") == {"directed": 2}
    assert kinds("you " + "word " * 50 + "fool\nyou") == {"plain": 2}


# Sentences that no list was written from.
THREATS = ["he killed you", "they will be murdered by me, you", "ich schlage dich", "sie wurde ermordet, du bist der nächste", "je te frapperai", "nous vous brûlerons", "te golpearemos", "los quemaron, y a ti también", "i am going to be strangling him", "wir zerstören euch", "il sera puni, lui", "te destruirán"]


@pytest.mark.parametrize("sentence", THREATS)
def test_verbs_of_harm_in_other_forms(sentence):
    assert toxicity.matches(sentence, {})[toxicity.KINDS.index("threat")] >= 1


@pytest.mark.parametrize("sentence", ["ich tue das für dich", "my mate, you are late", "the material was found", "the candle burned all night", "la mesa es roja", "he was never killed"])
def test_sentences_without_a_threat(sentence):
    assert toxicity.matches(sentence, {})[toxicity.KINDS.index("threat")] == 0


def test_sentences_by_themselves_are_like_a_whole_line(monkeypatch):
    draw = random.Random(6)
    words = ["fool", "kill", "you", "not", "said", "word", "other", ",", ":", ".", "!", "things"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    apart = [toxicity.matches(t, {"fool": 2.0}) for t in texts]
    monkeypatch.setattr(toxicity.Matcher, "stretches", lambda self, text: text.splitlines())
    assert apart == [toxicity.matches(t, {"fool": 2.0}) for t in texts]


def test_composed_machine_against_the_machines_in_turn():
    """All paths of each machine, one machine after the other, over random symbols."""

    def paths(m, symbols):
        live = [(m.start, 0, "")]
        for x in symbols:
            live = [(after, w + v, out + z) for state, w, out in live for z, v, after in m.arcs.get(state, {}).get(x, [])]
        return {(w, out) for state, w, out in live if state in m.final}

    draw = random.Random(8)
    parts = [grammar.negation(), grammar.report(), grammar.target()]
    for _ in range(400):
        symbols = "".join(draw.choice("iihttnrwwckqqe") for _ in range(draw.randint(1, 9))) + "z"
        found = {(w + v + u, c) for w, a in paths(parts[0], symbols) for v, b in paths(parts[1], a) for u, c in paths(parts[2], b)}
        most = max(w for w, _ in found)
        got = grammar.best(grammar.machine(), symbols)
        assert (most, got) in found, symbols
