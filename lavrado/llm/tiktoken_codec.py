"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Row-local: no shuffle.  Long texts are cut before a single space between two ASCII letters or digits,
where the pattern always starts a new match, so the parts' ids joined are the whole text's ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import documents, small_batches

#: Characters after which a long text is cut at the next safe boundary.
PART = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: So long a run of white space is cut before its last character, if something follows it: the pattern would have to
#: step back over all of it.  Runs are looked for from their starts only, so the search is linear.
_BLANK = re.compile(r"(?<!\s)\s{5000,}")


def encoding(path: str, pattern: str):
    """A tiktoken encoding from a rank file's lines of base64 bytes and rank, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text cut at safe boundaries into parts of about `size` characters."""
    if len(text) <= size:
        yield text
        return
    cuts = [m.end() - 1 for m in _BLANK.finditer(text) if m.end() < len(text)]
    at = 0
    while (m := _SAFE.search(text, at + size)) is not None:
        cuts.append(at := m.start())
    at = 0
    for cut in sorted(set(cuts)):
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(codec, text: str, size: int = PART) -> list[int]:
    if len(text) <= size:
        return codec.encode_ordinary(text)
    return [i for part in parts(text, size) for i in codec.encode_ordinary(part)]


def _digests(path: str, pattern: str, keep: bool) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        codec = names = None
        for batch in batches:
            if codec is None:
                codec = encoding(path, pattern)
                names = list(map(str, range(codec.n_vocab)))
            n, ids_sha, text_sha, whole, kept = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(codec, text) if text else []
                back = codec.decode_bytes(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                whole.append(back == (text or "").encode())
                if keep:
                    kept.append(array("I", ids).tobytes())
            more = {"ids": pa.array(kept, pa.binary())} if keep else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(whole), *more.values()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *more])

    return run


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of ids (array<int>) of each whole text; null and empty texts have an empty array."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(path, pattern)
        for some in texts:
            yield some.map(lambda x: encode(codec, x) if x else [])

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes of an array<int> column; a null or empty array gives empty bytes."""

    @F.pandas_udf("binary")
    def back(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(path, pattern)
        for some in rows:
            yield some.map(lambda x: codec.decode_bytes([int(i) for i in x]) if x is not None else b"")

    return df.withColumn(out, back(F.col(ids)))


def token_digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip for each row of df; if `keep`, ids too, as bytes of
    little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens and the digests of nothing.  Rows with equal doc_id stay separate
    rows; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_digests(path, pattern, keep), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids binary" if keep else ""))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
