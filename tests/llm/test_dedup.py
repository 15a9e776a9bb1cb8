import hashlib
import pickle
import random

import numpy as np
import pytest

from lavrado.llm import decontaminate, near_dedup, suffix_dedup
from lavrado.llm.queries import queries

from . import cases


def pairs(spark, sf_dir, name="documents", key="doc_id"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]


def test_near_dedup_against_all_pairs(spark, sf_dir):
    got = queries()["op3_near_dedup"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert cases.table(got) == sorted(cases.near(pairs(spark, sf_dir), 2), key=repr)


def test_near_dedup_of_odd_rows(spark):
    rows = [r for r in cases.fixture_rows() if r[0] is not None]
    for k in (2, 5):
        got = near_dedup.near_duplicates(cases.frame(spark, rows), shingle=k)
        want = cases.near(list({(r[0], r[1]) for r in rows}), k)
        assert sorted(set(map(tuple, got.collect()))) == want
        assert got.count() == len(rows)
    everything = near_dedup.near_duplicates(cases.frame(spark))
    assert everything.where("doc_id is null").select("component_id", "kept").distinct().collect() == [(None, True)]
    assert near_dedup.near_duplicates(cases.frame(spark, [])).count() == 0


def test_near_dedup_links_chains_in_one_bucket(spark):
    """Each text is close to the next only: all links have to be found for one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 150])) for i in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert cases.table(got) == sorted(cases.near(rows, 2), key=repr)


def test_near_dedup_without_common_shingles(spark, sf_dir, monkeypatch):
    """What is common and what isn't take different ways to the same links."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = [draw.choice(words) for _ in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(60)] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    want = sorted(cases.near(rows, 2), key=repr)
    assert 6 <= sum(r[3] for r in want) < len(rows)
    for common in (0, 2, 10**6):
        monkeypatch.setattr(near_dedup, "COMMON", common)
        assert cases.table(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)) == want


def test_least_matches_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(1)
    steps = near_dedup.least_matches(0.8, 1e-6)
    matches = (draw.random((4000, near_dedup.HASHES)) < 0.8).cumsum(axis=1)
    lost = np.zeros(4000, dtype=bool)
    for n, least in steps:
        lost |= matches[:, n - 1] < least
    assert lost.mean() < 1e-3


def test_decontaminate_against_every_window(spark, sf_dir):
    got = queries()["op4_decontaminate"](spark, sf_dir)
    want = cases.contaminated(pairs(spark, sf_dir), pairs(spark, sf_dir, "benchmark", "item_id"))
    assert cases.table(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == sorted(want, key=repr)
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_decontaminate_by_many_blocks(spark, sf_dir, monkeypatch, bits):
    """The whole table against a benchmark of several blocks, with a sieve that everything passes and one that little does."""
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    size = sum(len(r.text or "") for r in items.select("text").collect())
    marked = decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), items, most=size // 5)
    one = decontaminate.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), items)
    assert cases.table(marked.select("doc_id", "contamination.*")) == cases.table(one.select("doc_id", "contamination.*"))


def test_the_sieve_misses_no_window():
    draw = np.random.default_rng(9)
    texts = [b" ".join(b"w%d" % k for k in draw.integers(0, 500, n)) for n in (0, 1, 5, 12, 13, 14, 60, 400)]
    sieve = decontaminate.Sieve(1 << 16)
    for some in (texts[:4], texts[4:]):
        sieve.add(decontaminate.Windows(some, [["x"]] * len(some), 13))
    other = [b" ".join(b"v%d" % k for k in draw.integers(0, 500, 60)) for _ in range(2000)]
    have, passed = sieve.passed([*texts, *other, b"v " + texts[6][10:80] + b" v"])
    assert have[:8].tolist() == [0, 1, 5, 12, 13, 14, 60, 400] and passed[:8].tolist() == [False] + [True] * 7
    assert passed[8:-1].mean() < 0.02


def test_decontaminate_odd_rows_and_blocks(spark):
    docs = cases.frame(spark)
    base = next(r[1] for r in cases.fixture_rows() if r[0] == 8)
    items = spark.createDataFrame([(1, base[60:200]), (2, "river"), (2, "stone"), (3, None), (None, "casa"), (4, ""), (5, base[60:200]), (None, "no item")], "item_id long, text string")
    want = cases.contaminated([(r[0], r[1]) for r in cases.fixture_rows()], [tuple(r) for r in items.collect()])
    for most in (decontaminate.MOST_BYTES, 40):
        marked = decontaminate.contamination(docs, items, most=most)
        assert marked.columns == [c for c in docs.columns if c != "contamination"] + ["contamination"]
        c = "contamination."
        got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in marked.select("doc_id", c + "n_words", c + "n_hit", c + "items", c + "contaminated").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontaminate.without_documents(docs, items)
    assert clean.schema == docs.schema and clean.count() == sum(not w[-1] for w in want)
    cut = decontaminate.without_spans(docs.where("doc_id = 25"), spark.createDataFrame([(1, "a fool")], "item_id long, text string"))
    assert cut.first()["text"] == "You are not , he said." and cut.schema == docs.schema
    assert decontaminate.contamination(docs, items.limit(0)).where("contamination.contaminated").count() == 0
    assert decontaminate.contamination(cases.frame(spark, []), items).count() == 0


def test_a_block_of_the_benchmark_is_bounded():
    draw = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % k for k in draw.integers(0, 5000, 60)) for _ in range(3000)]
    held = decontaminate.Windows(texts, [[str(k)] for k in range(len(texts))], 13)
    sent = len(pickle.dumps(held))
    assert held.nbytes <= sent <= 8 * sum(map(len, texts))
    have, spans, names = held.finder()([b"", texts[7], b"w1", texts[8][:-9]])
    assert have[1] == 60 and decontaminate.merged(spans[1]) == [(0, 60)] and names[1] >= {"7"} and not spans[0] and not spans[2] and "8" in names[3]


def test_suffix_dedup_against_a_table_of_windows(spark, sf_dir):
    got = queries()["op8_suffix_dedup"](spark, sf_dir)
    assert cases.table(got) == sorted(cases.cut_repeats(pairs(spark, sf_dir), 200), key=repr)


def test_suffix_dedup_of_odd_rows(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in cases.fixture_rows()]
    want = sorted(cases.cut_repeats(rows, 50), key=repr)
    assert cases.table(suffix_dedup.suffix_dedup(cases.frame(spark), length=50)) == want
    kept = suffix_dedup.without_repeats(cases.frame(spark), length=50)
    assert kept.schema == cases.frame(spark).schema and kept.count() == len(rows)
    assert suffix_dedup.suffix_dedup(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [3, 4096])
def test_windows_meet_across_shards(spark, monkeypatch, shard):
    """With shards of three contexts, most windows' partners are in another shard; some contexts occur twice."""
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "RANGES", 5)
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(i, f"{i} " * 30 + passage[i % 30 : 150 + 3 * (i % 30)] + f" {i * 7} " * 20) for i in range(40)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=60)
    assert cases.table(got) == sorted(cases.cut_repeats(rows, 60), key=repr)


@pytest.mark.parametrize("piece", [1, 64, 500])
def test_long_texts_are_hashed_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    rows = [(1, "x" * 100 + passage), (2, passage[37:] + "y" * 90), (3, "ab" * 120), (4, ""), (5, "short"), (6, passage[:60])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=60)
    assert cases.table(got) == sorted(cases.cut_repeats(rows, 60), key=repr)


def test_merged_runs_are_keys_of_two_runs():
    draw = np.random.default_rng(3)
    sets = [{bytes(draw.integers(0, 2, 16, dtype=np.uint8)) for _ in range(n)} for n in (400, 1, 0, 700, 90)]
    runs = [np.array(sorted(s), dtype="S16") for s in sets]
    want = sorted(k for k in set().union(*sets) if sum(k in s for s in sets) > 1)
    assert [k.ljust(16, b"\0") for k in suffix_dedup.merged_runs(runs).tolist()] == want and want


def test_repeats_are_cut_beside_columns_of_any_name(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(-(2**63), text + "-tail", b"1", [1]), (None, text + "+more", b"2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cut binary, _digest array<int>")
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(df, length=100).collect()}
    assert out[-(2**63)].text == "-tail" and out[None].text == "+more" and (out[None]["_cut"], out[-(2**63)]["_digest"]) == (b"2", [1])
    assert sorted(map(repr, suffix_dedup.suffix_dedup(df, length=100).select("doc_id", "n_removed").collect())) == ["Row(doc_id=-9223372036854775808, n_removed=300)", "Row(doc_id=None, n_removed=300)"]


def test_suffix_array_is_the_sorted_suffixes():
    strings = [b"banana", b"ananas", b"aaaaaaa", b"", b"nan"]
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    order, _ = suffix_dedup.suffix_array(data, starts, ends, 10)
    suffix = lambda i: strings[np.searchsorted(ends, i, side="right")][i - starts[np.searchsorted(ends, i, side="right")] :]
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(data)))
