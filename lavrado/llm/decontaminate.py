"""Benchmark decontamination: a hash set of normalised benchmark n-grams, sent out in blocks of a fixed bound.

Plan: equal item texts are put together and their sizes summed first; the benchmark is cut into as many blocks
as keep each within MOST_BYTES of text.  One block is one row-local pass over the texts that adds the hits to the
row.  With more blocks, a sieve of a fixed size that has the windows of all of them (a Bloom filter, which misses none)
is sent out first: texts that can't have a window are done after that one pass and are written nowhere; only the others
are written and meet one block after the other, so that a task holds one block's table.  No text is shuffled whatever
the sizes are.  A table is a few flat arrays (window hashes in order, the word each window starts at, the items' text
and words), four to eight bytes for each byte of text: in a pass, the windows of a batch of texts are hashed and
searched in it, and what is found is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .shared import documents, small_batches, staged, table, utf8

#: Bytes of benchmark text that are sent out at once.
MOST_BYTES = 8 << 20
#: Bits of the sieve (64 MB), and how many each window sets.  With 100 MB of benchmark text, some 17 million windows, one
#: in 10,000 other windows passes; with ten times as much one in five, so that most texts meet all blocks.
SIEVE_BITS, SIEVE_HASHES = 1 << 29, 5
_WORD = bytes(b if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256)).lower()
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of normalised bytes (see `_WORD`) start and end."""
    edge = np.diff(np.concatenate([[0], (data != 32).view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one array of normalised bytes, their words' starts and ends, and each word's text.

    Words are runs of ASCII letters, digits and all other than ASCII characters, A-Z lower-cased.
    """
    data = np.frombuffer(b" ".join(x.translate(_WORD) for x in texts) + b" ", dtype=np.uint8)
    starts, ends = words(data)
    after = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
    return data, starts, ends, np.searchsorted(after, starts, side="right")


def hashed(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, from the words' hashes."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = (out + words[j : j + m]) * _STEP
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of benchmark texts, by length."""

    def __init__(self, texts: list[bytes], ids: list[list[str]], size: int) -> None:
        data, starts, ends, owner = laid_out(texts)
        self.data, self.starts, self.ends, self.owner = data, starts.astype(np.int32), ends.astype(np.int32), owner.astype(np.int32)
        self.ids = ids
        have = np.bincount(owner, minlength=len(texts))
        each = hashing.spans(data, starts, ends)
        first = np.cumsum(have) - have
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({*np.minimum(have, size).tolist()} - {0}):
            h = hashed(each, n)
            if n == size:
                at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            else:  # an item of fewer words is one window
                at = first[have == n]
            order = at[np.argsort(h[at], kind="stable")]
            self.by_length[n] = (h[order], order.astype(np.int32))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.starts, self.ends, self.owner, *[x for pair in self.by_length.values() for x in pair]))

    def _known(self, n: int, lo: int) -> dict[bytes, tuple[str, ...]]:
        """The windows of one hash, as words, and the items that have them."""
        h, at = self.by_length[n]
        out: dict[bytes, set[str]] = {}
        for w in at[lo : np.searchsorted(h, h[lo], side="right")].tolist():
            own = b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[w : w + n].tolist(), self.ends[w : w + n].tolist()))
            out.setdefault(own, set()).update(self.ids[self.owner[w]])
        return {k: tuple(v) for k, v in out.items()}

    def finder(self) -> Callable[[list[bytes]], tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]]:
        """A function of texts to their numbers of words, and of each the word spans of windows that occur and their items."""
        known = lru_cache(maxsize=4096)(self._known)

        def find(texts: list[bytes]):
            data, starts, ends, owner = laid_out(texts)
            have = np.bincount(owner, minlength=len(texts))
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            each = hashing.spans(data, starts, ends)
            first = np.cumsum(have) - have
            for n, (table_, _) in self.by_length.items():
                h = hashed(each, n)
                place = np.minimum(np.searchsorted(table_, h), len(table_) - 1)
                at = np.flatnonzero((table_[place] == h) & (owner[: len(h)] == owner[n - 1 :]))
                for i, lo in zip(at.tolist(), place[at].tolist()):
                    own = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
                    found = known(n, lo).get(own)
                    if found is not None:
                        k, where = int(owner[i]), int(i - first[owner[i]])
                        spans[k].append((where, where + n))
                        names[k].update(found)
            return have, spans, names

        return find


class Sieve:
    """Which windows may be a benchmark's: all that are, and few others."""

    def __init__(self, bits: int) -> None:
        self.bits, self.lengths, self.table = bits, set(), np.zeros(-(-bits // 8), dtype=np.uint8)

    def _places(self, h: np.ndarray, n: int) -> Iterator[np.ndarray]:
        step = h ^ np.uint64(n)
        for _ in range(SIEVE_HASHES):
            step = (step + np.uint64(1)) * _STEP
            step ^= step >> np.uint64(32)
            yield (step % np.uint64(self.bits)).astype(np.int64)

    def add(self, windows: Windows) -> None:
        for n, (h, _) in windows.by_length.items():
            self.lengths.add(n)
            for at in self._places(h, n):
                np.bitwise_or.at(self.table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def passed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' numbers of words, and which of them have a window that passes."""
        data, starts, ends, owner = laid_out(texts)
        out, each = np.zeros(len(texts), dtype=bool), hashing.spans(data, starts, ends)
        for n in self.lengths:
            h = hashed(each, n)
            hit = owner[: len(h)] == owner[n - 1 :]
            for at in self._places(h, n):
                hit &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[owner[: len(h)][hit]] = True
        return np.bincount(owner, minlength=len(texts)), out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _scan(windows) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = windows.value.finder()
        for batch in batches:
            have, found, who = find([x or b"" for x in utf8(batch.column("text"))])
            spans = [[v for span in merged([*zip(s[::2], s[1::2]), *more]) for v in span] for s, more in zip(batch.column("spans").to_pylist(), found)]
            names = [sorted({*i, *more}) for i, more in zip(batch.column("items").to_pylist(), who)]
            new = {"n_words": pa.array(have, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run


def _sifted(sieve, passed: bool) -> Callable:
    """The rows whose texts pass the sieve, or the others; with their numbers of words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            have, maybe = sieve.value.passed([x or b"" for x in utf8(batch.column("text"))])
            counted = batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(have, pa.int64()))
            yield counted.filter(pa.array(maybe == passed))

    return run


def _marked(df: DataFrame, benchmark: DataFrame, text: str, item_id: str = "item_id", item_text: str = "text", size: int = 13, most: int = MOST_BYTES) -> DataFrame:
    """text, row (df's other columns) and contamination."""
    spark = df.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null")
    # Copies of a text are one entry, so that a block's size is what its texts and ids have.
    items = staged(items.groupBy("t").agg(F.collect_set("i").alias("i")), "items")
    total = items.agg(F.sum(F.length("t") + F.coalesce(F.length(F.array_join("i", "")), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-total // most))
    out = df.select(F.col(text).alias("text"), F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row")).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    block = lambda k: (items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else items).toArrow()  # about `most` bytes
    built = lambda some: Windows(some.column("t").to_pylist(), some.column("i").to_pylist(), size)
    done = None
    if blocks > 1:
        sieve = Sieve(SIEVE_BITS)
        for k in range(blocks):
            sieve.add(built(block(k)))
        sent = spark.sparkContext.broadcast(sieve)
        done = out.mapInArrow(_sifted(sent, False), out.schema)
        out = staged(out.mapInArrow(_sifted(sent, True), out.schema), "sifted")
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(built(block(k)))
        out = out.mapInArrow(_scan(shared), out.schema)
        if k + 1 < blocks:
            out = staged(out, "scanned")
            shared.destroy()
    out = out if done is None else out.unionByName(done)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    found = out.withColumn("n_hit", hit)
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("text", "row", F.struct("n_words", "n_hit", "spans", "items", bad.alias("contaminated")).alias("contamination"))


def _own(columns: list[str], text: str) -> list:
    return [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in columns]


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with contamination: struct<n_words, n_hit, spans, items, contaminated>.

    spans: merged hit word places, start and end by turns; items: the ids, as sorted strings, of items of
    which a window occurs.  An item of fewer than `size` words, but not none, is one window.  Null and empty
    texts have no words, and items without words no windows; rows of one item_id are one item.  An item without
    an id has its windows, which are hits, but no name in `items`.  With several blocks df is read twice, so it has to give
    the same rows both times.  `most` bounds the bytes of item text that a task holds at once (one item longer than that
    is held as a whole).  Extra columns are kept as they are; a column named contamination is replaced.
    """
    keep = [c for c in df.columns if c != "contamination"]
    return _marked(df, benchmark, text, **options).select(*_own(keep, text), "contamination")


def without_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df without its contaminated rows, with all of its columns."""
    return _marked(df, benchmark, text, **options).where("not contamination.contaminated").select(*_own(df.columns, text))


def without_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with the hit words cut from its texts; what lies between two words of a span goes with them."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(x, s):
            if x is None or not len(s):
                return x
            raw, at, out = x.encode(), 0, []
            places = [m.span() for m in _RUN.finditer(raw)]
            for a, b in zip(s[::2], s[1::2]):
                out.append(raw[at : places[a][0]])
                at = places[b - 1][1]
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(x, s) for x, s in zip(texts, spans)])

    marked = _marked(df, benchmark, text, **options)
    return marked.withColumn("text", cut(F.col("text"), F.col("contamination.spans"))).select(*_own(df.columns, text))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    marked = contamination(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return marked.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"), c.contaminated.alias("contaminated"))
