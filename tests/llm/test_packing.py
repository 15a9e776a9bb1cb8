"""Packing against the tokenizer's own ids, and its bins against plain first-fit."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from lavrado.llm import packing
from lavrado.llm.queries import queries

from . import cases

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def encoded(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])], dtype="<u4")


def sequences_are_gapless(pieces, size):
    by = {}
    for p in pieces:
        assert p["length"] > 0
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for some in by.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= size and (at == size or at & (at - 1) == 0)
    return by


def test_query(spark, sf_dir, library):
    pieces = [r.asDict() for r in queries()["op13_packing"](spark, sf_dir).collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sequences = sequences_are_gapless(pieces, 4096)
    total = 0
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert by.keys() == texts.keys()
    for doc, some in by.items():
        ids, at = encoded(library, texts[doc], 2), 0
        total += len(ids)
        for p in sorted(some, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["padding"]) == (at, len(ids), 0)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert len(sequences) <= -(-total // 4096) + 12  # one group


@pytest.mark.parametrize("group", [3, 4096])
@pytest.mark.parametrize("end", [None, 7])
def test_odd_rows(spark, library, group, end):
    pieces = [r.asDict() for r in packing.packed(cases.frame(spark), WORDS, end=end, size=64, group=group).collect()]
    sequences_are_gapless(pieces, 64)
    got = sorted(((repr(p["doc_id"]), p["doc_tokens"], p["start"], p["length"]) for p in pieces))
    want = {}
    for i, t, *_ in cases.fixture_rows():
        ids = encoded(library, t, end)
        want.setdefault(repr(i), []).append(ids)
    for i in want:
        have = sorted(x for x in got if x[0] == i)
        assert sum(x[3] for x in have) == sum(map(len, want[i]))
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4")
        assert any(len(w) == p["doc_tokens"] and np.array_equal(ids, w[p["start"] : p["start"] + p["length"]]) for w in want[repr(p["doc_id"])])


def test_no_rows_and_wrong_sizes(spark):
    assert packing.packed(cases.frame(spark, []), WORDS, end=2).count() == 0
    with pytest.raises(ValueError):
        packing.packed(cases.frame(spark), WORDS, size=100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing(lengths):
    lengths.sort(reverse=True)
    plain, room = [], []
    for k, n in enumerate(lengths):
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            plain.append([])
            room.append(64)
        plain[b].append(k)
        room[b] -= n
    assert packing.first_fit(lengths, 64) == plain
    sequences = packing.packed_group(lengths, 64)
    spans = sorted(x for s in sequences for x in s)
    for k, n in enumerate(lengths):
        own = [(a, b) for p, a, b in spans if p == k]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    sizes = [sum(b - a for _, a, b in s) for s in sequences]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6


def test_a_long_text_is_cut_between_words(library):
    from lavrado.llm.shared import WordBpe

    text = "Some words, and " * 150_000 + "x" * 1_500_000 + " the end. " * 1000
    own = np.frombuffer(WordBpe(WORDS).ids(text[: 2_000_000].encode()), dtype="<u4")
    assert np.array_equal(own, encoded(library, text[:2_000_000], None))
