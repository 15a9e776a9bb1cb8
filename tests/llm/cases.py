"""Rows with everything an operator has to bear, and brute-force versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, spans string, items string, n int, anchor long, kept string, score double, node long, label string, contamination string, lang_pred string, ids string"


def fixture_rows() -> list[tuple]:
    draw = random.Random(5)
    vocabulary = ["Wald", "river", "maison", "perro", "the", "of", "und", "le", "el", "casa", "stone", "über", "niño", "été", "42", "a-b"]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base = prose(120)
    long = prose(9000)
    licence = "Intro text here. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nAll rights reserved."
    texts = [None, None, "", "", " \n\t ", "a", "A", "ñ", base, base, base.replace("river", "rivers", 1), base + " end", prose(40), prose(40), long, long + " tail", "x" * 700, "ab" * 400, "…" * 300, base[:220] + " " + prose(30), prose(30) + base[20:400], licence, licence, "<|endoftext|> Hello <|startoftext|>", "  " * 6000 + "end", "You are not a fool, he said.", "\U0001f600́ z​q 中文字"]
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "web")[i % 2], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[3]]  # the same row again
    rows += [(None, base, "en", None, None), (None, None, None, None, None), (2**40, "tie " * 60, "en", "w", 1), (2**40 + 1, "tie " * 60, "en", "w", 1)]
    extra = ("r", "d", "s", "i", 1, 2, "k", 0.5, 3, "l", "c", "p", "x")
    return [r + (extra if k % 2 else (None,) * len(extra)) for k, r in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(fixture_rows() if rows is None else rows, SCHEMA)


def table(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near(rows: list[tuple], k: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; doc_ids are different."""
    sets = {}
    for i, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    to = {i: i for i in sets}

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 80 * large and 100 * len(both := sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and both:
                p, q = sorted((find(a), find(b)))
                to[q] = p
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets.items())


def contaminated(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        own = cut(t)
        for j in range(max(1, len(own) - 12) if own else 0):
            windows.setdefault(tuple(own[j : j + 13]), set()).update([] if i is None else [str(i)])
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        own, hit, names = cut(t), set(), set()
        for n in sizes:
            for j in range(len(own) - n + 1):
                if (who := windows.get(tuple(own[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    names |= who
        out.append((i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def cut_repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all windows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, x in texts:
        for j in range(len(x) - length + 1):
            w = hashlib.md5(x[j : j + length]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, x in texts:
        gone, at, spans, kept, last = 0, 0, 0, [], -2
        covered = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if seen[hashlib.md5(x[j : j + length]).digest()] > 1:
                start = max(j, at)
                covered[start : j + length] = b"\1" * (j + length - start)
                at = j + length
        for p, c in enumerate(covered):
            if c:
                gone += 1
                spans += last != p - 1
                last = p
            else:
                kept.append(x[p])
        out.append((i, len(x), gone, spans, hashlib.sha256(bytes(kept)).hexdigest()))
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
