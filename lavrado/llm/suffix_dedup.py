"""Suffix-array deduplication: every byte covered by a string of `length` bytes that also starts elsewhere goes.

Plan: (1) where the text is, the smallest hash of ANCHOR bytes in every `length`-byte window is an anchor,
so equal windows have the same anchor at the same place in them; texts are known by their digest, equal
texts are one source; (2) anchors that occur once are dropped by a count; (3) the texts that have other
anchors give each anchor's context, the stretch of the windows that have it; equal contexts are
counted, not repeated; (4) anchors with several contexts go to shards: in a shard, a suffix array of the
contexts is built by Larsson-Sadakane refinement, Kasai's method gives common prefixes, and windows of one
anchor and place with a common prefix of `length` are repeated.  (5) An anchor with more than SHARD contexts
has several shards.  Each gives its distinct windows as a sorted run of keys (digests of place and window),
cut into RANGES or more equal ranges of keys; a task merges the runs of one range two by two, by binary search
of one run's keys in the other, and keys met in two runs are repeated windows.  A range holds no more than a
shard does, whatever the anchor's size is.  (6) The spans of each context are put together before they go back to
the context's occurrences, and are cut from the input's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .shared import documents, dropped, partitions, small_batches, staged, utf8

ANCHOR = 32
#: Contexts of one anchor in one shard, and bytes of contexts that are sorted at once.
SHARD, TOGETHER = 4096, 1 << 20
#: Bytes of text that are hashed at once (about a hundred bytes of memory for each).
PIECE = 1 << 20
#: Ranges of keys, at least, that a shard's windows are cut into.
RANGES = 64


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of texts that lie in data one after the other: the k-byte string of the smallest hash, the
    rightmost of equal ones, in each window of `length` bytes.  For each: where the windows that have it
    start, the bytes that they span, its place and its hash."""
    h = hashing.rolling(data, k)
    w = length - k + 1
    if len(h) < w:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    n = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = key
    grid = full.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - w + 1], before[w - 1 : n])
    inside = np.zeros(len(least) + 1, dtype=np.int32)  # windows that lie in one text
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    first = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = least[first]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (first[1:] != first[:-1] + 1)]) if len(own) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    at = (np.uint64(0xFFFFFFFF) - (own[heads] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return first[heads], np.diff(np.append(heads, len(own))) + length - 1, at, h[at]


def pieces(texts: list[bytes], length: int, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, place, bytes) of all texts, in lists of about `most` bytes.  A longer text is cut into pieces
    that share length - 1 bytes, so each window of `length` bytes is in one of them."""
    out: list[tuple[int, int, bytes]] = []
    held = 0
    for k, x in enumerate(texts):
        for at in range(0, max(1, len(x) - length + 1), most):
            out.append((k, at, x[at : at + most + length - 1]))
            held += len(out[-1][2])
            if held >= most:
                yield out
                out, held = [], 0
    if out:
        yield out


def _anchored(length: int, k: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column("text"))]
            found: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(5)]
            for some in pieces(texts, length, PIECE):
                ends = np.cumsum([len(x) for _, _, x in some], dtype=np.int64)
                starts = ends - np.array([len(x) for _, _, x in some], dtype=np.int64)
                first, size, at, h = anchors(np.frombuffer(b"".join(x for _, _, x in some), dtype=np.uint8), starts, ends, length, k)
                piece = np.searchsorted(ends, first, side="right")
                row, place = (np.array([x[j] for x in some], dtype=np.int64) for j in (0, 1))
                for col, v in zip(found, (row[piece], h.view(np.int64), first - starts[piece] + place[piece], at - first, size)):
                    col.append(v)
            owner, h, start, before, size = (np.concatenate(c) for c in found)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (h, start, before.astype(np.int32), size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([len(x) for x in texts], pa.int64()), *lists],
                ["doc_id", "digest", "sha256", "n_bytes", "anchor", "start", "before", "size"],
            )

    return run


def _contexts(batches: Iterator) -> Iterator:
    """Texts with their anchors to (digest, anchor, context_id, before, start, size) of each anchor's context."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for digest, x, found in zip(batch.column("digest").to_pylist(), utf8(batch.column("text")), batch.column("found").to_pylist()):
            for f in found:
                start, size, before = f["start"], f["size"], f["before"]
                for col, v in zip(out, (digest, f["anchor"], hashlib.md5(b"%d " % before + x[start : start + size]).digest(), before, start, size)):
                    col.append(v)
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["digest", "anchor", "context_id", "before", "start", "size"])


def _bytes_of(batches: Iterator) -> Iterator:
    """Texts with the contexts that are wanted of them to rows of these, with their bytes."""
    import pyarrow as pa

    names = ["anchor", "salt", "shards", "context_id", "before", "n"]
    for batch in batches:
        rows = [(w, x[w["start"] : w["start"] + w["size"]]) for x, some in zip(utf8(batch.column("text")), batch.column("wanted").to_pylist()) for w in some]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array([w[c] for w, _ in rows], t) for c, t in zip(names, kinds)], pa.array([x for _, x in rows], pa.binary())], [*names, "context"])


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the strings data[start:end], ordered on at least their first `depth` bytes, and their ranks.

    Larsson-Sadakane refinement: suffixes start ordered by what a word holds; each round, those that still share
    a rank are ordered by the rank of the suffix as far on as the order already reaches, which doubles it.
    A suffix does not go on past its string.
    """
    n = len(data)
    end = np.repeat(ends, ends - starts)
    place = np.arange(n, dtype=np.int64)
    letters = np.unique(data)
    code = np.zeros(256, dtype=np.uint64)
    code[letters] = np.arange(1, len(letters) + 1, dtype=np.uint64)
    bits = len(letters).bit_length()
    h = 63 // bits
    padded = np.concatenate([code[data], np.zeros(h, dtype=np.uint64)])
    left = end - place
    key = np.zeros(n, dtype=np.uint64)
    for j in range(h):
        key = (key << np.uint64(bits)) | np.where(left > j, padded[j : n + j], np.uint64(0))
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    while h < depth:
        shared = ~new
        shared[:-1] |= ~new[1:]
        spots = np.flatnonzero(shared)
        if not len(spots):
            break
        own = order[spots]
        on = own + h
        second = np.where(on < end[own], rank[np.minimum(on, n - 1)] + 1, 0)
        both = rank[own] * (n + 1) + second
        sub = np.argsort(both)
        own, both = own[sub], both[sub]
        order[spots] = own
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        new[spots] = fresh
        rank[own] = spots[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
        h *= 2
    tied = ~new
    tied[:-1] |= ~new[1:]
    spots = np.flatnonzero(tied)
    order[spots] = order[spots][np.argsort(rank[order[spots]] * (n + 1) + order[spots])]  # equal suffixes by place
    return order, rank


def common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for each place of the order, the bytes (at most `most`) its suffix shares with the one before;
    0 for suffixes of fewer than `most` bytes.

    From one suffix to the next of its string the number falls by one at most, so each string is walked
    once; all strings are walked side by side, eight bytes at a time and then one.
    """
    n = len(data)
    end = np.repeat(ends, ends - starts)
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    before = np.where(at > 0, order[np.maximum(at - 1, 0)], -1)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)[:n].copy().view(np.uint64).ravel()
    out = np.zeros(n, dtype=np.int64)
    lanes = np.flatnonzero(ends - starts >= most)
    place, stop, shared = starts[lanes].copy(), ends[lanes] - most, np.zeros(len(lanes), dtype=np.int64)
    while len(place):
        other = before[place]
        room = np.where(other >= 0, np.minimum(end[other] - other, most), 0)
        shared = np.minimum(shared, room)
        live = np.flatnonzero(shared + 8 <= room)
        while len(live):
            live = live[eight[place[live] + shared[live]] == eight[other[live] + shared[live]]]
            shared[live] += 8
            live = live[shared[live] + 8 <= room[live]]
        live = np.flatnonzero(shared < room)
        while len(live):
            live = live[data[place[live] + shared[live]] == data[other[live] + shared[live]]]
            shared[live] += 1
            live = live[shared[live] < room[live]]
        out[at[place]] = shared
        place = place + 1
        shared = np.maximum(shared - 1, 0)
        go = place <= stop
        if not go.all():
            place, stop, shared = place[go], stop[go], shared[go]
    return out


def repeated_windows(contexts: list[bytes], before: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks over the joined contexts' bytes: the windows that another context of the group has at the same
    place, and of those one for each distinct window."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    order, _ = suffix_array(data, starts, ends, int(sizes.max()))  # to the end: Kasai's step needs the whole order
    same = common_prefixes(data, starts, ends, order, length) >= length
    run = np.cumsum(~same)  # suffixes of one run share a window
    owner = np.repeat(np.arange(len(contexts)), sizes)[order]
    where = order - starts[owner] - before[owner]  # from the anchor
    good = same.copy()
    good[:-1] |= same[1:]
    spots = np.flatnonzero(good)
    sub = spots[np.lexsort((where[spots], group[owner[spots]], run[spots]))]
    equal = (run[sub][1:] == run[sub][:-1]) & (group[owner[sub]][1:] == group[owner[sub]][:-1]) & (where[sub][1:] == where[sub][:-1])
    hit = np.zeros(len(sub), dtype=bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    marks = np.zeros(len(data), dtype=bool)
    marks[order[sub[hit]]] = True
    one = np.zeros(len(data), dtype=bool)
    hit[1:] &= ~equal
    one[order[sub[hit]]] = True
    return marks, one


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _keyed(part: list[dict], places: list[np.ndarray], length: int) -> Iterator[tuple]:
    """(anchor, range, shard, keys, contexts, starts) of one shard's windows: the contexts of part, and the places
    of each that are to meet other shards' windows.  A context that is cut as a whole has starts of -1."""
    keys, contexts, starts = [], [], []
    for r, found in zip(part, places):
        x, at = r["context"], r["before"]
        keys += [hashlib.md5(b"%d " % (i - at) + x[i : i + length]).digest() for i in found.tolist()]
        contexts += [r["context_id"]] * len(found)
        starts.append(np.full(len(found), -1, dtype="<i4") if r["n"] > 1 else found.astype("<i4"))
    if not keys:
        return
    own, who, where = np.array(keys, dtype="S16"), np.array(contexts, dtype="S16"), np.concatenate(starts)
    order = np.argsort(own, kind="stable")
    own, who, where = own[order], who[order], where[order]
    ranges = max(RANGES, part[0]["shards"])
    cuts = np.searchsorted(own, np.array([(k * (1 << 64) // ranges).to_bytes(8, "big") for k in range(1, ranges)], dtype="S16"))
    edges = np.concatenate([[0], cuts, [len(own)]])
    for k in np.flatnonzero(np.diff(edges)).tolist():
        s, e = edges[k], edges[k + 1]
        yield part[0]["anchor"], k, part[0]["salt"], own[s:e].tobytes(), who[s:e].tobytes(), where[s:e].tobytes()


def _sharded(length: int) -> Callable:
    """Rows ordered by anchor and salt to contexts with spans (keys is null), and runs of keys for the other shards."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("anchor", "context_id", "spans", "range", "shard", "keys", "contexts", "starts")
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

        def rows(part: list[dict]):
            keys = {}
            group = np.array([keys.setdefault((r["anchor"], r["salt"]), len(keys)) for r in part])
            before = np.array([r["before"] for r in part], dtype=np.int64)
            sizes = [len(r["context"]) for r in part]
            marks, one = repeated_windows([r["context"] for r in part], before, group, length)
            out, shard, places, at = [], [], [], 0
            for k, (r, n) in enumerate(zip(part, sizes)):
                own, first = marks[at : at + n], one[at : at + n]
                at += n
                if r["n"] > 1:  # the context as a whole is there again
                    own, first = np.arange(n) + length <= n, np.ones(n, dtype=bool)
                s, e = _runs(own)
                if len(s):
                    out.append((r["anchor"], r["context_id"], np.stack([s, e + length - 1], axis=1).ravel().tolist(), *[None] * 5))
                if r["shards"] > 1:
                    shard.append(r)
                    places.append(np.flatnonzero((~own | first)[: max(0, n - length + 1)]))
                    if k + 1 == len(part) or group[k + 1] != group[k]:
                        out += [(a, None, None, *x) for a, *x in _keyed(shard, places, length)]
                        shard, places = [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names)

        part, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held >= TOGETHER and (r["anchor"], r["salt"]) != (part[-1]["anchor"], part[-1]["salt"]):
                    yield rows(part)
                    part, held = [], 0
                part.append(r)
                held += len(r["context"])
        if part:
            yield rows(part)

    return run


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """The keys that at least two of some sorted runs have, each run's keys being different; runs are merged two by
    two, by binary search of the shorter one's keys in the longer one."""
    some = [(r, np.zeros(len(r), dtype=bool)) for r in runs]
    while len(some) > 1:
        after = []
        for k in range(0, len(some) - 1, 2):
            (b, hit_b), (a, hit_a) = sorted(some[k : k + 2], key=lambda x: len(x[0]))
            at = np.searchsorted(a, b)
            met = at < len(a)
            met[met] = a[at[met]] == b[met]
            hit_a[at[met]] = True
            after.append((np.insert(a, at[~met], b[~met]), np.insert(hit_a, at[~met], hit_b[~met])))
        some = after + some[len(some) // 2 * 2 :]
    return some[0][0][some[0][1]] if some else np.zeros(0, dtype="S16")


def _met(length: int) -> Callable:
    """Runs ordered by anchor, range and shard to (anchor, context_id, spans)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(anchor: int, part: list[dict]):
            keys, contexts = ([np.frombuffer(r[c], dtype="S16") for r in part] for c in ("keys", "contexts"))
            starts = np.concatenate([np.frombuffer(r["starts"], dtype="<i4") for r in part]).astype(np.int64)
            both = merged_runs(keys)
            own, who = np.concatenate(keys), np.concatenate(contexts)
            at = np.minimum(np.searchsorted(both, own), max(0, len(both) - 1))
            good = np.flatnonzero((both[at] == own) & (starts >= 0)) if len(both) else np.zeros(0, dtype=np.int64)
            good = good[np.lexsort((starts[good], who[good]))]
            who, starts = who[good], starts[good]
            spans: dict[bytes, list[int]] = {}
            for c, x in zip(who.tolist(), starts.tolist()):
                s = spans.setdefault(c, [])
                if s and x <= s[-1]:
                    s[-1] = x + length
                else:
                    s += [x, x + length]
            return pa.RecordBatch.from_arrays([pa.array([anchor] * len(spans), pa.int64()), pa.array([c.ljust(16, b"\0") for c in spans], pa.binary()), pa.array(list(spans.values()), pa.list_(pa.int64()))], ["anchor", "context_id", "spans"])

        part: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if part and (part[-1]["anchor"], part[-1]["range"]) != (r["anchor"], r["range"]):
                    yield rows(part[-1]["anchor"], part)
                    part = []
                part.append(r)
        if part:
            yield rows(part[-1]["anchor"], part)

    return run


def _merged(spans: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(text: bytes, spans: list[int]) -> tuple[bytes, int]:
    """The bytes outside all spans (start and end by turns), and the number of maximal spans."""
    own, at, out = _merged(spans), 0, []
    for s, e in own:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]]), len(own)


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        left = [kept_bytes(x or b"", s) for x, s in zip(utf8(batch.column("text")), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(x) for x, _ in left], pa.int64()), pa.array([n for _, n in left], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in left])], ["digest", "left", "runs", "left_sha256"])


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, k: int = ANCHOR, keep: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """What is repeated in df's texts, as (rows, texts, spans); texts only if they are to be kept.  Each step's table
    is deleted when its last reader has finished.

    rows: doc_id, digest, sha256, n_bytes and copies of each row; texts: digest and text of those that have
    an anchor that recurs; spans: digest and array of start and end places, by turns, to be cut.  Texts with
    copies are not in spans: all of them goes if they have `length` bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    # A null doc_id is one of its own, and equal to itself in joins.
    base = df.select(F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found_in = staged(base.mapInArrow(_anchored(length, k), "doc_id struct<none:boolean,id:bigint>, digest binary, sha256 string, n_bytes long, anchor array<bigint>, start array<bigint>, before array<int>, size array<int>"), "anchors")
    rows = staged(found_in.select("doc_id", "digest", "sha256", "n_bytes"), "rows")
    copies = staged(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")), "copies")
    # One row for each distinct text (identical rows stay together; they are copies anyway).
    source = found_in.where(F.size("anchor") > 0).select("digest", "doc_id", "anchor", "start", "before", "size").join(copies, ["digest", "doc_id"], "left_semi")
    # Written, so that the join below has shuffles of its own, of which Spark can split a large key's.
    recurring = staged(source.select(F.explode("anchor").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"), "recurring")
    each = source.select("digest", "doc_id", F.inline(F.arrays_zip("anchor", "start", "before", "size")))
    found = each.join(recurring, "anchor").groupBy("digest", "doc_id").agg(F.collect_list(F.struct("anchor", "start", "before", "size")).alias("found"))
    keyed = base.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = staged(keyed.join(found, ["digest", "doc_id"]), "texts")
    dropped(found_in)
    dropped(recurring)
    # Only the contexts' digests are written and counted; the bytes of those that have to be sorted are cut out later.
    contexts = staged(texts.select("digest", "text", "found").mapInArrow(_contexts, "digest binary, anchor long, context_id binary, before int, start long, size int"), "contexts")
    met_by = contexts.groupBy("anchor", "context_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "start")).alias("one"), F.min("before").alias("before"), F.min("size").alias("size"))
    distinct = staged(met_by, "distinct")
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most"))
    # An anchor's only context, met several times, is repeated as a whole; the others are sorted.
    single = sizes.where("m = 1 and most > 1").select("anchor")
    alone = staged(distinct.select("anchor", "context_id", F.col("size").cast("long").alias("size")).join(single, "anchor").select("anchor", "context_id", F.array(F.lit(0).cast("long"), "size").alias("spans")), "alone")
    several = sizes.where("m > 1").select("anchor", F.ceil(F.col("m") / SHARD).cast("int").alias("shards"))
    salted = distinct.join(several, "anchor").withColumn("salt", F.pmod(F.xxhash64("context_id"), F.col("shards")).cast("int"))
    wanted = salted.groupBy(F.col("one.digest").alias("digest")).agg(F.collect_list(F.struct("anchor", "salt", "shards", "context_id", "before", "n", F.col("one.start").alias("start"), "size")).alias("wanted"))
    cut_out = texts.select("digest", "text").join(wanted, "digest").mapInArrow(_bytes_of, "anchor long, salt int, shards int, context_id binary, before int, n long, context binary")
    spread = cut_out.repartition(partitions(spark), "anchor", "salt").sortWithinPartitions("anchor", "salt", "context_id")
    shape = "anchor long, context_id binary, spans array<bigint>, range int, shard int, keys binary, contexts binary, starts binary"
    sorted_ = staged(spread.select("anchor", "salt", "shards", "context_id", "context", "before", "n").mapInArrow(_sharded(length), shape), "sorted")
    dropped(distinct)
    if not keep:
        dropped(texts)
    runs = sorted_.where("keys is not null").select("anchor", "range", "shard", "keys", "contexts", "starts")
    dealt = runs.repartition(partitions(spark), "anchor", "range").sortWithinPartitions("anchor", "range", "shard")
    late = staged(dealt.mapInArrow(_met(length), "anchor long, context_id binary, spans array<bigint>"), "late")
    marked = sorted_.where("spans is not null").select("anchor", "context_id", "spans").unionByName(late).unionByName(alone)
    # One row a context: the join makes a row for each occurrence of a context, whatever was found in it.
    marked = staged(marked.groupBy("anchor", "context_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "marked")
    for done in (sorted_, late, alone):
        dropped(done)
    placed = contexts.select("digest", "anchor", "context_id", "start").join(marked, ["anchor", "context_id"])
    spans = placed.groupBy("digest").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("start")))).alias("spans"))
    return rows.join(copies.select("digest", "copies"), "digest").withColumn("doc_id", F.when(~F.col("doc_id.none"), F.col("doc_id.id"))), texts.select("digest", "text") if keep else None, spans


def suffix_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of df.

    Places are judged on the input's UTF-8 bytes, never across rows.  Null and empty texts, and texts of
    fewer than `length` bytes, lose nothing.  Rows with equal doc_id stay separate rows; equal texts of
    `length` bytes or more all lose everything.  An empty table gives an empty result.
    """
    rows, texts, spans = repeats(df, doc_id, text, length)
    cut = spans.join(texts, "digest").dropDuplicates(["digest"]).select("digest", "text", "spans").mapInArrow(_cut, "digest binary, left long, runs long, left_sha256 string")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.select("doc_id", "digest", "sha256", "n_bytes", "copies").join(cut, "digest", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0))).alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha256", "sha256")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """df with the repeated bytes cut from its texts (broken characters at a cut go too); all rows and columns stay."""
    rows, _, spans = repeats(df, doc_id, text, length, keep=False)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or s is None else kept_bytes(x.encode(), list(s))[0].decode("utf-8", "ignore") for x, s in zip(texts, spans)], dtype=object)

    whole = F.array(F.lit(0).cast("long"), F.col("n_bytes"))
    some = rows.where("copies > 1").groupBy("digest").agg(F.min("n_bytes").alias("n_bytes")).where(F.col("n_bytes") >= length).select("digest", whole.alias("whole"))
    marks = spans.join(some, "digest", "full").select("digest", F.coalesce("whole", "spans").alias("cut"))
    # df's columns travel in one of their own, so that no name of theirs meets ours.
    own = df.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    keyed = own.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return keyed.join(marks, "digest", "left").withColumn("text", cut(F.col("text"), F.col("cut"))).select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in df.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
