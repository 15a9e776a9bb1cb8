"""Token files: ids in ascending document order, entropy-coded by a static range asymmetric numeral system.

Format: a Parquet table, one row a block.  A block holds whole documents of at least `block` ids (its last
document may make it longer), coded with LANES interleaved states under one frequency table that all blocks
share.  Each block has its documents' ids and lengths, its 32-bit words, decoder states and word offsets at
every STEP-th step (checkpoints: each stretch between two can be decoded by itself), and checksums of the
words and of the ids.  The table's files are Spark's own output, so they live on any store Spark can write
and a lost task is written again.

Plan: encode where the text is; write; count ids (a row for each id and task); range-partition by doc_id;
write blocks; read them back.  Only the frequency table (bounded by the vocabulary) and one row for each
partition of the output are shared.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from .shared import documents, dropped, fresh_path, modelled, partitions, small_batches, staged, utf8, word_bpe

#: Bits of the shared frequencies' total; states are 64 bits wide and give off 32 at a time.
BITS = 20
LANES = 32
#: Steps between two checkpoints; a step codes LANES ids.
STEP = 256
BLOCK = 1 << 15

BLOCK_SCHEMA = "part int, block int, part_start long, n_ids long, doc_ids array<bigint>, doc_ns array<bigint>, words binary, states binary, offsets binary, words_crc long, ids_crc long"


def shared_frequencies(counts: dict[int, int], size: int) -> "np.ndarray":  # noqa: F821
    """Counts scaled to a total of 2**BITS, at least 1 for each id that occurs."""
    import numpy as np

    have = np.zeros(size, dtype=np.float64)
    for k, v in counts.items():
        have[k] = v
    out = np.zeros(size, dtype=np.int64)
    if not counts:
        return out
    total = 1 << BITS
    out[have > 0] = np.maximum(1, np.floor(have[have > 0] * (total / have.sum()))).astype(np.int64)
    order = np.lexsort((np.arange(size), -out))
    left = total - int(out.sum())
    if left > 0:
        out[order[0]] += left
    for k in order:  # takes what rounding up has added back from the most frequent
        if left >= 0:
            break
        less = min(int(out[k]) - 1, max(1, int(-left * out[k] // total) + 1), -left)
        out[k] -= less
        left += less
    while left < 0:
        for k in order:
            if out[k] > 1 and left < 0:
                out[k] -= 1
                left += 1
    return out


class Coder:
    """Codes and decodes many blocks at once; the arrays' axes are block and lane."""

    def __init__(self, freq) -> None:
        import numpy as np

        self.f = np.append(freq, 1 << BITS).astype(np.uint64)  # the last is a filler that leaves a state as it is
        self.c = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list) -> list[tuple[bytes, bytes, bytes]]:
        """For each array of ids its words, states and offsets.  Blocks of like lengths go side by side: they are filled up
        to the longest one's length, which is at most half as much again as the shortest one's."""
        out: list = [None] * len(blocks)
        order, k = sorted(range(len(blocks)), key=lambda i: len(blocks[i])), 0
        while k < len(order):
            least = len(blocks[order[k]])
            some = [i for i in order[k:] if 2 * len(blocks[i]) <= 3 * least] or [order[k]]
            for i, coded in zip(some, self._encoded([blocks[i] for i in some])):
                out[i] = coded
            k += len(some)
        return out

    def _encoded(self, blocks: list) -> list[tuple[bytes, bytes, bytes]]:
        import numpy as np

        n = len(blocks)
        steps = max(1, max(-(-len(b) // LANES) for b in blocks))
        ids = np.full((n, steps * LANES), len(self.f) - 1, dtype=np.uint32)
        for k, b in enumerate(blocks):
            ids[k, : len(b)] = b
        ids = ids.reshape(n, steps, LANES)
        x = np.full((n, LANES), 1 << 32, dtype=np.uint64)
        sent = np.zeros((n, steps, LANES), dtype=bool)
        words = np.zeros((n, steps, LANES), dtype=np.uint32)
        states = np.zeros((n, -(-steps // STEP), LANES), dtype=np.uint64)
        full, low, wide = np.uint64(64 - BITS), np.uint64(32), np.uint64(BITS)
        for t in range(steps - 1, -1, -1):
            f, c = self.f[ids[:, t]], self.c[ids[:, t]]
            over = (x >> full) >= f
            words[:, t] = x.astype(np.uint32)
            sent[:, t] = over
            x = np.where(over, x >> low, x)
            q = x // f
            x = (q << wide) + (x - q * f) + c
            if t % STEP == 0:
                states[:, t // STEP] = x
        out = []
        for k, b in enumerate(blocks):
            own = -(-len(b) // LANES)
            marks = max(1, -(-own // STEP))
            each = np.concatenate([[0], np.cumsum(sent[k].sum(axis=1))])
            out.append((words[k][sent[k]].astype("<u4").tobytes(), states[k, :marks].astype("<u8").tobytes(), each[: marks * STEP : STEP][:marks].astype("<u4").tobytes()))
        return out

    def decode(self, blocks: list[tuple[int, bytes, bytes, bytes]]) -> list:
        """For each (number of ids, words, states, offsets) its ids; all stretches are decoded side by side."""
        import numpy as np

        x, at, lengths, base, flat = [], [], [], 0, []
        for n, words, states, offsets in blocks:
            w = np.frombuffer(words, dtype="<u4")
            x.append(np.frombuffer(states, dtype="<u8").reshape(-1, LANES))
            at.append(np.frombuffer(offsets, dtype="<u4").astype(np.int64) + base)
            lengths += [min(STEP * LANES, n - k * STEP * LANES) for k in range(len(x[-1]))]
            flat.append(w)
            base += len(w)
        flat = np.concatenate([*flat, np.zeros(1, dtype="<u4")])
        x, at, left = np.concatenate(x).astype(np.uint64), np.concatenate(at), np.array(lengths)
        steps = max(0, -(-int(left.max()) // LANES))
        out = np.zeros((len(x), max(1, steps), LANES), dtype=np.uint32)
        lane, mask, wide, low, least = np.arange(LANES), np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(1 << 32)
        for t in range(steps):
            live = (t * LANES + lane)[None, :] < left[:, None]
            r = x & mask
            s = self.slot[r]
            y = self.f[s] * (x >> wide) + r - self.c[s]
            need = live & (y < least)
            place = at[:, None] + np.cumsum(need, axis=1) - 1
            y = np.where(need, (y << low) | flat[np.where(need, place, len(flat) - 1)].astype(np.uint64), y)
            at = at + need.sum(axis=1)
            x = np.where(live, y, x)
            out[:, t] = s
        found, k = [], 0
        out = out.reshape(len(out), -1)
        for n, _, states, _ in blocks:
            marks = len(states) // (8 * LANES)
            found.append(np.concatenate([out[k + i, : max(0, min(STEP * LANES, n - i * STEP * LANES))] for i in range(marks)]))
            k += marks
        return found


def _ids(path: str, end: int | None) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            bpe = word_bpe(path)
            found = [(bpe.ids(x) if x else b"") + last for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_narrow(x) for x in found], pa.binary())], ["doc_id", "ids"])

    return run


def _narrow(ids: bytes) -> bytes:
    """Ids as they are staged: two bytes each where they fit, marked by the first byte."""
    import numpy as np

    wide = np.frombuffer(ids, dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids


def _widened(x: bytes):
    import numpy as np

    return np.frombuffer(x, dtype="<u2" if x[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _counted(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        some = [_widened(x) for x in batch.column("ids").to_pylist()]
        found = np.bincount(np.concatenate(some)) if some else total
        a, b = sorted((total, found), key=len)
        total = b.astype(np.int64)
        total[: len(a)] += a
    have = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have], pa.int64())], ["id", "n"])


def _blocks(freq, size: int, together: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, coder, block, start = TaskContext.get().partitionId(), Coder(freq.value), 0, 0
        ready: list = []
        docs: list = []
        held = waiting = 0

        def rows():
            nonlocal ready, block, start
            ids = [np.concatenate([x for _, x in d]) for d in ready]
            cols: list[list] = [[] for _ in range(11)]
            for d, x, (words, states, offsets) in zip(ready, ids, coder.encode(ids)):
                for col, v in zip(cols, (part, block, start, len(x), [k for k, _ in d], [len(v) for _, v in d], words, states, offsets, zlib.crc32(words), zlib.crc32(x.astype("<u4").tobytes()))):
                    col.append(v)
                block, start = block + 1, start + len(x)
            ready = []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "block", "part_start", "n_ids", "doc_ids", "doc_ns", "words", "states", "offsets", "words_crc", "ids_crc"])

        for batch in batches:
            for k, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append((k, _widened(x)))
                held += len(docs[-1][1])
                if held >= size:
                    ready.append(docs)
                    waiting += held
                    docs, held = [], 0
                    if waiting >= together * size:
                        yield rows()
                        waiting = 0
        if docs:
            ready.append(docs)
        if ready:
            yield rows()

    return run


def _read(freq, digests: bool) -> Callable:
    """Documents' ids, or in their place the crc32, so that ids that nobody asks for don't leave the task."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = None
        for batch in batches:
            coder = coder or Coder(freq.value)
            b = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            for words, crc in zip(b["words"], b["words_crc"]):
                if zlib.crc32(words) != crc:
                    raise ValueError("a block's words don't have their checksum")
            found = coder.decode(list(zip(b["n_ids"], b["words"], b["states"], b["offsets"]))) if b["words"] else []
            out: list[list] = [[] for _ in range(5)]
            for part, start, ks, ns, ids, crc in zip(b["part"], b["part_start"], b["doc_ids"], b["doc_ns"], found, b["ids_crc"]):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != crc:
                    raise ValueError("a block's ids don't have their checksum")
                at = 0
                for k, n in zip(ks, ns):
                    own = memoryview(raw)[4 * at : 4 * (at + n)]
                    for col, v in zip(out, (part, k, start + at, n, zlib.crc32(own) if digests else own)):
                        col.append(v)
                    at += n
            last = pa.int64() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), last))], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def write_token_files(df: DataFrame, at: str, tokenizer: str, end: int | None = None, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, files: int | None = None) -> None:
    """Write `at/blocks` and `at/frequencies`: the ids of every whole text, in ascending doc_id order, each followed by `end`.

    Null and empty texts have no ids besides `end`.  Null doc_ids come first; rows with equal doc_id follow
    each other in the order of their ids.  An empty table gives empty files.
    A tokenizer that texts can't be cut for is refused (ValueError).
    """
    spark = df.sparkSession
    modelled(tokenizer)
    small_batches(spark)
    ids = staged(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_ids(tokenizer, end), "doc_id long, ids binary"), "ids")
    counts = ids.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # at most one row for each id of the vocabulary
    size = max(counts["id"], default=0) + 1
    freq = shared_frequencies(dict(zip(counts["id"], counts["n"])), size)
    spark.createDataFrame([(k, int(v)) for k, v in enumerate(freq) if v], "id long, frequency long").coalesce(1).write.parquet(f"{at}/frequencies")
    shared = spark.sparkContext.broadcast(freq)
    ordered = ids.repartitionByRange(files or partitions(spark), F.asc("doc_id")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_blocks(shared, block, 64), BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{at}/blocks")
    dropped(ids)


def read_token_files(spark, at: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (binary, little-endian uint32), or their crc32, from written files."""
    small_batches(spark)
    counted = spark.read.parquet(f"{at}/frequencies").toArrow().to_pydict()  # bounded by the vocabulary
    import numpy as np

    freq = np.zeros(max(counted["id"], default=0) + 1, dtype=np.int64)
    freq[counted["id"]] = counted["frequency"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{at}/blocks")
    from pyspark.sql import Window

    # One row for each partition of the writer.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    shared = spark.sparkContext.broadcast(freq)
    rows = blocks.mapInArrow(_read(shared, digests), f"part int, doc_id long, part_start long, n_tokens long, {'ids_crc32 long' if digests else 'ids binary'}")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32" if digests else "ids")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = fresh_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), at, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_token_files(spark, at, digests=True)
