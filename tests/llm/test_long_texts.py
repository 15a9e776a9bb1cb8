"""Very long texts: bounded time, and memory in proportion to a text rather than to a batch of them."""

import time
import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lavrado.llm import tiktoken_codec, token_files
from lavrado.llm.shared import BATCH_BYTES, small_batches

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_trailing_blanks_take_linear_time():
    codec = tiktoken_codec.encoding(BYTES, public_tokenizers.PATTERN)
    text = "word " * 20_000 + " " * 5_000_000
    began = time.thread_time()
    parts = list(tiktoken_codec.parts(text))
    assert time.thread_time() - began < 5 and "".join(parts) == text
    short = "word " * 20_000 + " " * 300_000
    assert tiktoken_codec.encode(codec, short) == codec.encode_ordinary(short)
    runs = ("x" + " " * 4_900) * 300
    began = time.thread_time()
    assert "".join(tiktoken_codec.parts(runs)) == runs and time.thread_time() - began < 5


def test_blanks_before_a_letter_are_cut_where_the_pattern_cuts():
    codec = tiktoken_codec.encoding(BYTES, public_tokenizers.PATTERN)
    for text in ("a" * 70_000 + " " * 6_000 + "b" + "\n" * 6_000, " " * 70_000 + "end", "x" * 70_000 + "\t" * 5_000 + " " * 100 + "y z"):
        assert tiktoken_codec.encode(codec, text) == codec.encode_ordinary(text)


def test_a_long_block_is_not_padded_to():
    """64 blocks of usual length beside one of a million ids: memory goes with the ids there are."""
    draw = np.random.default_rng(3)
    freq = token_files.shared_frequencies({k: k + 1 for k in range(500)}, 500)
    coder = token_files.Coder(freq)
    blocks = [draw.integers(0, 500, n).astype(np.uint32) for n in [8192] * 64 + [1_000_000] + [9000, 12_000, 1, 0]]
    tracemalloc.start()
    coded = coder.encode(blocks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * 1_000_000
    back = coder.decode([(len(b), *c) for b, c in zip(blocks, coded)])
    assert all(np.array_equal(a, b) for a, b in zip(back, blocks))


def test_batches_are_bounded_by_bytes(spark):
    small_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    got = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(300_000)).alias("t")).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 200 and max(r.bytes for r in got) < BATCH_BYTES + 400_000
