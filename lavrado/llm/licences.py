"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised to words and ends: A-Z lower-cased, all but a-z and 0-9 one space; marks before white space,
line ends and empty lines become signs of their own.  A known licence sentence that lies between two ends, or an
official one anywhere, becomes its identifier, in its place; line ends (comment signs at their sides are no words)
don't cut a sentence, and marks don't cut an official one.  The identifiers in order are matched against
licence rules, first rule first, and a rule takes the identifiers that it matches.  A sentence that is left and
speaks of a licence is reported as unknown.  Row-local: no shuffle, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .shared import documents

# Identifiers of licence sentences and their normalised wording.
SENTENCES = {
    "MITrel": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MITgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "MITnotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIsCaps": ["the software is provided as is without warranty of any kind express or implied"],
    "Apache2": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at"],
    "GPL3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "GPL2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GPLfree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "GPLhope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "LGPL3": ["licensed under the gnu lesser general public license version 3"],
    "AGPL3": ["licensed under the gnu affero general public license version 3"],
    "MPL2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "BSDredist": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDrel": ["licensed under the bsd license", "released under the bsd license"],
    "CCBY4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "CCBYNC4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "CCBYSA4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "CC0": ["licensed under cc0 1 0", "this work is dedicated to the public domain"],
    "Reserved": ["all rights reserved"],
}
# Licences whose SPDX tags are known; one that starts with another one's words comes before it.
TAGS = (
    "MIT-0", "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "GPL-2.0-or-later", "GPL-2.0-only", "GPL-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-3.0", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-2.1",
    "LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL-3.0", "AGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "Zlib", "BSL-1.0", "EPL-1.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
)
# Licence rules in order; a rule's identifiers have to follow each other.
RULES = [
    ("BSD-4-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDadvert", "BSDnames", "BSDasis"]),
    ("BSD-3-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDnames", "BSDasis"]),
    ("BSD-2-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDasis"]),
    ("MIT", ["MITgrant", "MITnotice", "AsIsCaps"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("Apache-2.0", ["Apache2", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["Apache2", "ApacheUse"]),
    *[(name, own) for name, first in (("GPL-2.0-or-later", "GPL2later"), ("GPL-3.0-or-later", "GPL3later"), ("GPL-2.0-only", "GPL2only"), ("LGPL-2.0-or-later", "LGPL20later"), ("LGPL-2.1-or-later", "LGPL21later"), ("LGPL-3.0-or-later", "LGPL3later"), ("AGPL-3.0-or-later", "AGPL3later")) for own in ([first, "GPLhope"], [first])],
    ("GPL", ["GPLfree", "GPLhope"]),
    ("ISC", ["ISCgrant"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["ZlibGrant"]),
    ("BSL-1.0", ["BSL1title", "BSL1grant"]),
    ("BSL-1.0", ["BSL1grant"]),
    ("BSL-1.0", ["BSL1title"]),
    ("EPL-2.0", ["EPL2"]),
    ("EPL-1.0", ["EPL1"]),
    ("LGPL-2.1", ["LGPL21text"]),
    *[(name, [f"Tag{re.sub('[^A-Za-z0-9]', '', name)}"]) for name in TAGS],
    ("MIT", ["MITrel"]),
    ("Apache-2.0", ["Apache2"]),
    ("Apache-2.0", ["Apache2text"]),
    ("GPL-3.0", ["GPL3text"]),
    ("GPL-2.0", ["GPL2text"]),
    ("LGPL-3.0", ["LGPL3text"]),
    ("AGPL-3.0", ["AGPL3text"]),
    ("MPL-2.0", ["MPL2text"]),
    ("GPL-3.0", ["GPL3"]),
    ("GPL-2.0", ["GPL2"]),
    ("LGPL-3.0", ["LGPL3"]),
    ("AGPL-3.0", ["AGPL3"]),
    ("MPL-2.0", ["MPL2"]),
    ("BSD", ["BSDredist"]),
    ("BSD", ["BSDrel"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC0-1.0", ["CC0"]),
    ("Proprietary", ["Reserved"]),
]
# Whole sentences as published, normalised, by identifier, with `*` for names; a rarer word of each is looked for first.
# They are long enough to be told without their ends.
OFFICIAL = [
    ("MITgrant", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITnotice", "substantial", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("AsIsCaps", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GPL2later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL3later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2only", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("GPL2only", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("LGPL20later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("LGPL21later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LGPL3later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("AGPL3later", "redistribute", "this * is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPLhope", "merchantability", "this * is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("Apache2", "apache", "licensed under the apache license version 2 0 the license"),
    ("ApacheUse", "compliance", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "obtain", "you may obtain a copy of the license at"),
    ("BSDredist", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDbinary", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDadvert", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSDnames", "endorse", "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDnames", "endorse", "neither the names of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDnames", "endorse", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDasis", "disclaimed", "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("ISCgrant", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCgrant", "purpose", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("ZlibGrant", "applications", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BSL1title", "boost", "boost software license version 1 0"),
    ("BSL1grant", "accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("EPL2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("EPL2", "eclipse", "eclipse public license v 2 0"),
    ("EPL1", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("EPL1", "eclipse", "eclipse public license v 1 0"),
    ("LGPL21text", "lesser", "gnu lesser general public license version 2 1 february 1999"),
    ("Apache2text", "apache", "apache license version 2 0 january 2004"),
    ("GPL3text", "june", "gnu general public license version 3 29 june 2007"),
    ("GPL2text", "june", "gnu general public license version 2 june 1991"),
    ("LGPL3text", "lesser", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL3text", "affero", "gnu affero general public license version 3 19 november 2007"),
    ("MPL2text", "mozilla", "mozilla public license version 2 0 1 definitions"),
    ("MPL2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    *[(f"Tag{re.sub('[^A-Za-z0-9]', '', name)}", "spdx", " ".join(["spdx license identifier", *re.split("[-.]", name.lower())])) for name in TAGS],
]
#: What a name in a sentence, written `*`, may be: up to 12 words.
_NAME = "[a-z0-9]+(?: [a-z0-9\x02\x03]+){0,11}"
#: A licence that counts only without another one; its rule is the last.
ALONE = "Proprietary"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs of an empty line, a line end and a mark.  Each is written twice, so that two sentences can have one each.
GAP, LINE, MARK = "\x01", "\x02", "\x03"
#: Words of sentences that speak of a licence.
SPEAKS = ("license", "licence", "licensed", "licenses", "licences", "sublicense", "copyright", "copyrighted", "copyleft")
#: (pattern, what comes in its place), in turn, for lower-cased texts without the three signs.
NORMAL = [("[.!?;:]([ \t\r\f\x0b\n]|$)", f" {MARK} {MARK} $1"), ("\n[^a-z0-9\n]*\n", f"\n{GAP} {GAP}\n"), ("\n", f" {LINE} {LINE} "), ("[^a-z0-9\x01-\x03]+", " ")]


def known_sentences() -> dict[str, str]:
    return {wording: name for name, wordings in SENTENCES.items() for wording in wordings}


def replacements() -> list[tuple[str, str, str]]:
    """(word, pattern, what comes in its place) of each sentence, in order; the patterns mean the same in Java and RE2."""
    out = [(word, "\\b" + "(?: [\x02\x03]){0,4} ".join(_NAME if w == "*" else w for w in wording.split()) + "\\b", f"{MARK} {MARK} <{name}> {MARK} {MARK}") for name, word, wording in OFFICIAL]
    for wording, name in known_sentences().items():
        out.append((max(wording.split(), key=len), "[\x01-\x03] " + "(?: \x02){0,2} ".join(wording.split()) + " [\x01-\x03]", f"{MARK} <{name}> {MARK}"))
    return out


def _identified(text: Column) -> Column:
    """The normalised text with identifiers, `<name>`, in the places of sentences."""
    out = F.replace(F.translate(F.coalesce(text, F.lit("")), _UPPER + GAP + LINE + MARK, _LOWER + "   "), F.lit("\r\n"), F.lit("\n"))
    for pattern, to in NORMAL[:-1]:
        out = F.regexp_replace(out, pattern, to)
    ends = F.lit(f"{GAP} {GAP} "), F.lit(f" {GAP} {GAP}")
    whole = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("pattern"), F.lit(x).alias("to")) for w, p, x in replacements()])
    return F.aggregate(whole, F.regexp_replace(F.concat(ends[0], out, ends[1]), *NORMAL[-1]), lambda t, s: F.when(F.contains(t, s["word"]), F.regexp_replace(t, s["pattern"], s["to"])).otherwise(t))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_ids, licences, n_unmatched, unknown for each row of df.

    The notice that all rights are reserved is a licence (Proprietary) only where no rule has found another one.
    sentence_ids: identifiers in order of the text, `;` between; licences: what the rules found, in order of
    the rules and each once, `;` between; n_unmatched: identifiers that no rule took; unknown: the sentences, as
    words, that speak of a licence and aren't known, in order.  Null and empty texts have none.  Rows with
    equal doc_id stay separate rows; an empty table gives an empty result.
    """
    speaks = f"\\b(?:{'|'.join(SPEAKS)})\\b"
    # A text without any of these words has neither a known sentence nor an unknown one, so it isn't normalised.
    telling = F.col(text).rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted({*SPEAKS, *[w for w, _, _ in replacements()]}))})(?![a-z0-9])")
    found = df.select(F.col(doc_id).alias("doc_id"), F.transform(F.array(_identified(F.when(telling, F.col(text)))), lambda t: F.struct(F.regexp_extract_all(t, F.lit("<([A-Za-z0-9]+)>"), F.lit(1)).alias("ids"), F.when(t.rlike(speaks), t).alias("left")))[0].alias("f"))
    left = F.transform(F.split(F.regexp_replace("f.left", "<[A-Za-z0-9]+>", MARK), "[\x01\x03]"), lambda x: F.trim(F.regexp_replace(x, "[ \x02]+", " ")))
    unknown = F.coalesce(F.filter(left, lambda x: x.rlike(speaks)), F.array().cast("array<string>"))
    found = found.select("doc_id", F.col("f.ids").alias("ids"), unknown.alias("unknown"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in own)).alias("own"), F.lit(name == ALONE).alias("alone")) for name, own in RULES])
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")).alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.struct(F.replace(a["left"], r["own"], F.lit("|")).alias("left"), F.when(F.contains(a["left"], r["own"]) & ~(r["alone"] & (F.size(a["names"]) > 0)), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"))
    matched = F.when(F.size("ids") > 0, F.aggregate(rules, start, step))
    out = found.withColumn("m", matched)
    names = F.coalesce(F.array_join(F.array_distinct(F.col("m.names")), ";"), F.lit(""))
    left = F.coalesce(F.length(F.regexp_replace(F.col("m.left"), "[^<]", "")), F.lit(0)).cast("long")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ";").alias("sentence_ids"), names.alias("licences"), left.alias("n_unmatched"), "unknown")


def sql() -> str:
    """The scan of `documents` as DuckDB SQL, with the number of unknown sentences."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    # Escapes stand for the signs and white space, in patterns and in what is put in.
    shown = lambda s: s.replace("\x01", "\\x01").replace("\x02", "\\x02").replace("\x03", "\\x03").replace("\t", "\\t").replace("\r", "\\r").replace("\f", "\\f").replace("\x0b", "\\x0b").replace("\n", "\\n")
    pattern, put = lambda s: q(shown(s)), lambda s: "E" + q(shown(s).replace("$1", "\\\\1"))
    normal = f"replace(translate(coalesce(text, ''), E'{_UPPER}\\x01\\x02\\x03', '{_LOWER}   '), E'\\r\\n', E'\\n')"
    for p, to in NORMAL[:-1]:
        normal = f"regexp_replace({normal}, {pattern(p)}, {put(to)}, 'g')"
    normal = f"regexp_replace(E'\\x01 \\x01 ' || {normal} || E' \\x01 \\x01', {pattern(NORMAL[-1][0])}, ' ', 'g')"
    steps = [f"t0 AS MATERIALIZED (SELECT doc_id, {normal} AS t FROM documents)"]
    every = replacements()
    for k, (word, p, to) in enumerate(every, 1):
        steps.append(f"t{k} AS (SELECT doc_id, CASE WHEN contains(t, {q(word)}) THEN regexp_replace(t, {pattern(p)}, {put(to)}, 'g') ELSE t END AS t FROM t{k - 1})")
    speaks = f"\\b(?:{'|'.join(SPEAKS)})\\b"
    steps.append(f"i AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '<([A-Za-z0-9]+)>', 1) AS ids, len(list_filter(string_split_regex(regexp_replace(t, '<[A-Za-z0-9]+>', E'\\x03', 'g'), '[\\x01\\x03]'), lambda x: regexp_matches(x, '{speaks}'))) AS n_unknown FROM t{len(every)})")
    steps.append("r0 AS (SELECT doc_id, ids, n_unknown, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS l, CAST([] AS VARCHAR[]) AS names FROM i)")
    for k, (name, own) in enumerate(RULES, 1):
        mark = q("".join(f"<{i}>" for i in own))
        steps.append(f"r{k} AS (SELECT doc_id, ids, n_unknown, replace(l, {mark}, '|') AS l, CASE WHEN contains(l, {mark}){' AND len(names) = 0' if name == ALONE else ''} THEN list_append(names, {q(name)}) ELSE names END AS names FROM r{k - 1})")
    listed = "\n".join(f"{x}," for x in steps).rstrip(",")
    return f"""WITH {listed}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ';'), '') AS sentence_ids,
 coalesce(array_to_string(list_transform(list_filter(list_zip(names, range(1, len(names) + 1)), lambda x: list_position(names, x[1]) = x[2]), lambda x: x[1]), ';'), '') AS licences,
 CAST(length(regexp_replace(l, '[^<]', '', 'g')) AS BIGINT) AS n_unmatched, CAST(n_unknown AS BIGINT) AS n_unknown FROM r{len(RULES)}"""


def op1_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).withColumn("n_unknown", F.size("unknown").cast("long")).drop("unknown")
