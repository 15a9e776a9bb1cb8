import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from lavrado.llm import media, tiktoken_codec, token_counts, token_files
from lavrado.llm.queries import queries
from lavrado.llm.shared import word_bpe

from . import cases

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def counted(library, rows):
    return sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows), key=repr)


def rows_of(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts(spark, sf_dir, library):
    assert cases.table(queries()["op2_token_counts"](spark, sf_dir)) == counted(library, rows_of(spark, sf_dir))
    odd = [(r[0], r[1]) for r in cases.fixture_rows()]
    for hot in (200_000, 3):
        assert cases.table(token_counts.token_counts(cases.frame(spark), WORDS, hot=hot)) == counted(library, odd)
    assert token_counts.token_counts(cases.frame(spark, []), WORDS).count() == 0


def filed(library, rows, end):
    out, at = [], 0
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, sf_dir, library):
    got = queries()["op5_token_files"](spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == filed(library, rows_of(spark, sf_dir), 2)


def test_token_files_of_odd_rows(spark, library, tmp_path):
    at = f"file://{tmp_path}/t"
    token_files.write_token_files(cases.frame(spark), at, WORDS, end=7, block=500)
    rows = token_files.read_token_files(spark, at).collect()
    assert len(rows) == len(cases.fixture_rows())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(bytes(r.ids))
    for i, t, *_ in cases.fixture_rows():
        assert np.array([*library.encode(t or "", add_special_tokens=False).ids, 7], dtype="<u4").tobytes() in by[i]
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    token_files.write_token_files(cases.frame(spark, []), f"{at}0", WORDS)
    assert token_files.read_token_files(spark, f"{at}0").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=9000), min_size=1, max_size=4))
def test_numeral_system_round_trip(blocks):
    counts = np.bincount(np.array([x for b in blocks for x in b], dtype=np.int64), minlength=301)
    coder = token_files.Coder(token_files.shared_frequencies({i: int(n) for i, n in enumerate(counts) if n}, 301))
    coded = coder.encode([np.array(b, dtype=np.uint32) for b in blocks])
    back = coder.decode([(len(b), *c) for b, c in zip(blocks, coded)])
    assert [x.tolist() for x in back] == blocks


def test_damage_is_found(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    token_files.write_token_files(cases.frame(spark), at, WORDS, end=7)
    blocks = spark.read.parquet(f"{at}/blocks")
    from pyspark.sql import functions as F

    blocks.withColumn("words", F.concat(F.col("words"), F.lit(b"abcd"))).write.parquet(f"{at}2/blocks")
    spark.read.parquet(f"{at}/frequencies").write.parquet(f"{at}2/frequencies")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_token_files(spark, f"{at}2").count()


def test_byte_bpe(spark, sf_dir):
    codec = tiktoken_codec.encoding(BYTES, public_tokenizers.PATTERN)

    def want(rows):
        out = []
        for i, t in rows:
            ids = codec.encode_ordinary(t or "")
            out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        return sorted(out, key=repr)

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert cases.table(queries()["op7_byte_bpe"](spark, sf_dir).select(columns)) == want(rows_of(spark, sf_dir))
    odd = [(r[0], r[1]) for r in cases.fixture_rows()]
    got = tiktoken_codec.token_digests(cases.frame(spark), BYTES, public_tokenizers.PATTERN)
    assert cases.table(got.select(columns)) == want(odd) and got.where("not round_trip").count() == 0
    assert tiktoken_codec.token_digests(cases.frame(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0
    there = tiktoken_codec.encode_column(cases.frame(spark).drop("ids"), BYTES, public_tokenizers.PATTERN)
    back = tiktoken_codec.decode_column(there, BYTES, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .\n\t'sé", max_size=400), st.integers(1, 40))
def test_texts_are_cut_at_safe_places(text, size):
    codec = _codec()
    assert tiktoken_codec.encode(codec, text, size) == codec.encode_ordinary(text)


_CODEC = []


def _codec():
    if not _CODEC:
        _CODEC.append(tiktoken_codec.encoding(BYTES, public_tokenizers.PATTERN))
    return _CODEC[0]


def test_media(spark, sf_dir, tmp_path):
    def check(got, rows):
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            raw = (t or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) for r in by[i])

    check(queries()["op10_media"](spark, sf_dir).collect(), rows_of(spark, sf_dir))
    odd = [(r[0], r[1]) for r in cases.fixture_rows()]
    check(media.media_columns(cases.frame(spark), f"file://{tmp_path}/m").collect(), odd)
    assert media.media_columns(cases.frame(spark, []), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("bits", [64, media.MARKS])
def test_media_files_are_tar_files_of_png(spark, tmp_path, bits):
    import tarfile

    index = media.stored(cases.frame(spark), f"file://{tmp_path}/m", bits=bits).collect()
    assert len(index) == len({r[1] or "" for r in cases.fixture_rows()})
    texts = {hashlib.sha256((r[1] or "").encode()).digest(): (r[1] or "").encode() for r in cases.fixture_rows()}
    seen = 0
    for path in (tmp_path / "m").glob("*.tar"):
        with tarfile.open(path) as tar:
            for member in tar:
                seen += 1
                raw = tar.extractfile(member).read()
                assert media.decoded(raw) == media.payload(texts[bytes.fromhex(member.name[:-4])])
    assert seen == len(index)


def test_frequent_pretokens_are_bounded(spark):
    df = spark.range(1, 2001).selectExpr("concat('t', id) pretoken", "cast(2000 / id as bigint) n", "1L pieces")
    counts = [2000 // k for k in range(1, 2001)]
    for most in (0, 1, 10, 300, 1999, 2000, 5000):
        least = token_counts.frequent(df, most)
        assert sum(n >= least for n in counts) <= most and (most < 2000 or least == 1)
    assert token_counts.frequent(df.limit(0), 5) == 1


def test_other_tokenizers_are_refused(spark, tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"]["normalizers"].pop()  # no lower-casing
    (tmp_path / "t.json").write_text(json.dumps(told))
    df = cases.frame(spark)
    with pytest.raises(ValueError):
        token_counts.token_counts(df, f"{tmp_path}/t.json")
    with pytest.raises(ValueError):
        token_files.write_token_files(df, f"{tmp_path}/out", f"{tmp_path}/t.json")


@pytest.mark.parametrize("text", [" " * 70_000 + "x", "a" * 70_000, "ab, " * 20_000, "\n\t " * 30_000, "é " * 40_000 + " " * 6000 + "b", "1" * 66_000])
def test_long_texts_without_safe_places(text):
    assert tiktoken_codec.encode(_codec(), text) == _codec().encode_ordinary(text)


def test_media_headers_are_read_without_the_payload(spark, tmp_path):
    index = media.stored(spark.createDataFrame([("a" * 200,), ("b",)], "text string"), f"file://{tmp_path}/m")
    for r in index.collect():  # spoil all that follows the headers
        with open(r.file.removeprefix("file://"), "r+b") as f:
            f.seek(r.offset + media.HEADER)
            f.write(bytes(r.length - media.HEADER))
    got = media.header_columns(index)
    assert sorted((r.width, r.height, r.bits) for r in got.collect()) == [(64, 1, 8), (64, 4, 8)]
    with pytest.raises(Exception, match="checksum"):
        media.features(index).collect()


def test_a_media_file_of_an_earlier_attempt_stays(tmp_path):
    files, folder = media.store(str(tmp_path))
    for text in (b"first", b"second"):
        (tmp_path / "t").write_bytes(text)
        media.finished(files, f"{folder}/t", f"{folder}/x.tar")
        assert (tmp_path / "x.tar").read_bytes() == b"first" and not (tmp_path / "t").exists()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZéÇ!'.,#<|>1²9·İßŁſ́ʼn -_x ɐДs", max_size=12))
def test_chunks_have_the_ids_of_the_library(library, text):
    assert word_bpe(WORDS).ids(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
