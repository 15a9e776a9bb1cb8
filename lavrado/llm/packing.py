"""Packing documents into sequences of tokens: first-fit decreasing over a tournament tree of bin capacities.

A document of `size` ids or more gives whole sequences first; what is left of each document is an item.  Items are dealt
out at random into groups of about GROUP, and each group is packed by itself: the longest item first, each into the
first bin that has room, which a tournament tree of the bins' capacities finds in steps of its depth.  Then bins that
aren't full are filled from the emptiest one, whose pieces are cut for it, so one bin at most is left; it is dealt out
over sequences whose lengths are powers of two, which need no padding.

Plan: ids are encoded and cut where the text is and written, two bytes each where they fit; one shuffle, of items only,
brings groups together; a task holds one group, at most GROUP items of fewer than `size` ids on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from .shared import documents, modelled, small_batches, staged, utf8, word_bpe
from .token_files import _narrow, _widened

SIZE = 4096
#: Items of a group, on average.
GROUP = 4096
_SEED = 13


def first_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins, as lists of places in `lengths`, which are in descending order."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)  # room[k] is the larger one of room[2k] and room[2k + 1]; bins are the last half
    bins: list[list[int]] = []
    for place, n in enumerate(lengths):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        if k - leaves == len(bins):
            bins.append([])
        bins[k - leaves].append(place)
        room[k] -= n
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
    return bins


def packed_group(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences, as lists of (place in `lengths`, from, to): all of them have `size` ids or a power of two."""
    bins = [[(p, 0, lengths[p]) for p in some] for some in first_fit(lengths, size)]
    fill = [sum(b - a for _, a, b in some) for some in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < size), key=lambda k: (-fill[k], k))
    to, of = 0, len(order) - 1
    while to < of:
        into, out = order[to], order[of]
        p, a, b = bins[out].pop()
        n = min(b - a, size - fill[into])
        bins[into].append((p, b - n, b))
        if n < b - a:
            bins[out].append((p, a, b - n))
        fill[into] += n
        fill[out] -= n
        to += fill[into] == size
        of -= not bins[out]
    full = [some for k, some in enumerate(bins) if fill[k] == size]
    rest = [some for k, some in enumerate(bins) if 0 < fill[k] < size]
    for some in rest:  # one at most
        total = sum(b - a for _, a, b in some)
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            wanted, taken = 1 << bit, []
            while wanted:
                p, a, b = some.pop(0)
                n = min(b - a, wanted)
                taken.append((p, a, a + n))
                if n < b - a:
                    some.insert(0, (p, a + n, b))
                wanted -= n
            full.append(taken)
    return full


def padding(length: int, size: int) -> int:
    return 0 if length & (length - 1) == 0 else size - length


_CUT = "row long, doc_id long, doc_tokens long, start long, length int, sequence_id long, ids binary"


def _cut(path: str, end: int | None, size: int) -> Callable:
    """Whole sequences of long documents, and what is left of each document, without a sequence_id."""

    def rows(batches: Iterator) -> Iterator[tuple]:
        import numpy as np
        from pyspark import TaskContext

        row = whole = TaskContext.get().partitionId() << 36
        last = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            bpe = word_bpe(path)
            for doc, x in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                ids = (bpe.ids(x) if x else b"") + last
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    full = len(part) == 4 * size
                    yield row, doc, n, start, len(part) // 4, 2 * whole if full else None, _narrow(part)
                    whole += full
                row += 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _batches(rows(batches), ["row", "doc_id", "doc_tokens", "start", "length", "sequence_id", "ids"], [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()])

    return run


_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padding")
_PIECES = ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in _NAMES)


def _batches(rows: Iterator[tuple], names: list[str], types: list, size: int = 1 << 22) -> Iterator:
    import pyarrow as pa

    out, held = [], 0
    for r in rows:
        out.append(r)
        held += sum(len(x) for x in r if isinstance(x, bytes)) + 100
        if held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _pieces(rows: Callable) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _batches(rows(batches), list(_NAMES), [pa.binary() if k == "ids" else pa.int64() for k in _NAMES])

    return run


def _whole(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        b = {k: batch.column(k).to_pylist() for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "ids")}
        for doc, start, n, total, seq, ids in zip(b["doc_id"], b["start"], b["length"], b["doc_tokens"], b["sequence_id"], b["ids"]):
            yield doc, start, n, _widened(ids).astype("<u4").tobytes(), total, seq, 0, 0


def _grouped(size: int) -> Callable:
    """The pieces of items that come by group, the longest first."""

    def items(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in ("group", "doc_id", "doc_tokens", "start", "length", "ids")))

    def rows(batches: Iterator) -> Iterator[tuple]:
        for group, some in groupby(items(batches), key=lambda x: x[0]):
            some = list(some)
            for k, sequence in enumerate(packed_group([x[4] for x in some], size)):
                offset, more = 0, padding(sum(b - a for _, a, b in sequence), size)
                for p, a, b in sequence:
                    _, doc, total, start, _, ids = some[p]
                    yield doc, start + a, b - a, _widened(ids)[a:b].astype("<u4").tobytes(), total, 2 * (group << 32 | k) + 1, offset, more
                    offset += b - a

    return rows


def packed(df: DataFrame, tokenizer: str, end: int | None = None, size: int = SIZE, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `size` ids (a power of two): doc_id, start (its document's ids before
    it), length, ids (binary, little-endian uint32), doc_tokens (its document's ids, `end` included), sequence_id,
    offset (ids before it in its sequence) and padding (of its sequence: 0, as sequences are full or a power of two).

    Null and empty texts have no ids besides `end`; without `end` they have no piece.  Rows with equal or null doc_id
    are documents of their own.  Which documents share a sequence depends on how the table is dealt out over tasks.
    An empty table gives no pieces.  A tokenizer that texts can't be cut for is refused (ValueError).
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size has to be a power of two")
    spark = df.sparkSession
    modelled(tokenizer)
    small_batches(spark)
    cut = staged(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(tokenizer, end, size), _CUT), "cut")
    items = cut.where("sequence_id is null")
    groups = max(1, -(-items.count() // group))
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.lit(_SEED), "row"), F.lit(groups))).repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "row")
    return cut.where("sequence_id is not null").mapInArrow(_pieces(_whole), _PIECES).unionByName(dealt.mapInArrow(_pieces(_grouped(size)), _PIECES))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")
