"""Media columns: content-addressed payloads in tar shards, with digest, offset and length in the rows.

A text's payload (UTF-8, zeros up to a positive multiple of 64 bytes) is stored as an 8-bit grey PNG of
width 64.  Plan: (1) digests are counted, and those that occur more than once are marked in a bitmap of a fixed
size (MARKS bits, whatever the input's size); (2) one pass over the texts encodes those that aren't marked, which
have no copies, and writes them to tar files where they are read; marked ones (copies, and what shares a
bit with one) are passed on, once for each task, meet by digest and are then encoded and written, so each
payload is stored once and no payload is shuffled but copies' texts.  Tar files are written under temporary
names in the shared folder and renamed to names made from their content: a task that runs again makes the
same files, and finds those that an earlier attempt has left.  (3) Header-only range reads (the first 33 bytes of a
member) fill width, height and bits; features come from reads of whole members.  Both are made once for each
payload and joined by digest, where copies of one text don't matter to the join's size, as Spark splits a large
key of the other side.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import deleted, documents, fresh_path, partitions, small_batches, staged, utf8

WIDTH = 64
#: Bytes after which a task goes on to another tar file.
SHARD = 64 << 20
#: Bits of the map of digests that recur.  If it is full, all texts meet by digest; no result depends on it.
MARKS = 1 << 25
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
#: The folder of files that aren't finished.
UNFINISHED = "_unfinished"


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def encoded(samples: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, rows unfiltered."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> dict[str, int]:
    """Width, height and bits a sample from a PNG's first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != int.from_bytes(first[29:33], "big"):
        raise ValueError("not a PNG header")
    return {"width": int.from_bytes(first[16:20], "big"), "height": int.from_bytes(first[20:24], "big"), "bits": first[24]}


def decoded(png: bytes) -> bytes:
    """The samples of a PNG that `encoded` made; checksums are verified."""
    shape, at, data = header(png), 8, b""
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(png[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk doesn't have its checksum")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(shape["height"], shape["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, entropy in bits (both in thousandths) and a 64-bit average hash of 64 equal stretches, in hexadecimal."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    means = x.reshape(WIDTH, -1).mean(axis=1)
    bits = int("".join("1" if m > x.mean() else "0" for m in means), 2)
    return f"{round(1000 * float(x.mean()))}-{round(-1000 * float((share * np.log2(share)).sum()))}-{bits:016x}"


def store(path: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Shards:
    """The tar files that one task writes; `add` and `close` give the rows (digest, file, offset, length) of finished ones."""

    def __init__(self, at: str) -> None:
        self.at, (self.files, self.folder), self.out = at, store(at), None
        self.files.create_dir(f"{self.folder}/{UNFINISHED}", recursive=True)

    def add(self, digest: bytes, media: bytes) -> list[tuple]:
        if self.out is None:
            self.temporary, self.part, self.name, self.place = f"{self.folder}/{UNFINISHED}/{uuid.uuid4().hex}", [], hashlib.sha256(), 0
            self.out = self.files.open_output_stream(self.temporary)
        member = tarfile.TarInfo(digest.hex() + ".png")
        member.size = len(media)
        head = member.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        self.part.append((digest, self.place + len(head), len(media)))
        self.place += len(head) + len(media) + -len(media) % 512
        self.name.update(digest)
        return self.close() if self.place >= SHARD else []

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.write(bytes(1024))
        self.out.close()
        self.out, name = None, f"{self.name.hexdigest()}.tar"
        finished(self.files, self.temporary, f"{self.folder}/{name}")
        return [(digest, f"{self.at}/{name}", offset, length) for digest, offset, length in self.part]


def finished(files, temporary: str, final: str) -> None:
    """Give a file its name; one that another attempt has left under it has the same content and stays."""
    from pyarrow import fs

    there = lambda: files.get_file_info(final).type == fs.FileType.File
    if not there():
        try:
            files.move(temporary, final)
            return
        except OSError:
            if not there():
                raise
    files.delete_file(temporary)


def _batch(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def marked(digest: bytes, bits: int = MARKS) -> tuple[int, int]:
    """The word of 64 bits and the bit that stand for a digest."""
    k = (int.from_bytes(digest[:4], "big") >> 4) % bits
    return k >> 6, k & 63


def _alone(at: str, marks) -> Callable:
    """Texts without copies to (digest, file, offset, length); others, once a task if they come close together, to (digest, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shards, words, seen = _Shards(at), marks.value, set()
        names, kinds = ["digest", "file", "offset", "length", "text"], [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for x in utf8(batch.column("text")):
                x = x or b""
                digest = hashlib.sha256(x).digest()
                word, bit = marked(digest, 64 * len(words))
                if not int(words[word]) >> bit & 1:
                    out += [(*row, None) for row in shards.add(digest, encoded(payload(x)))]
                elif digest not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(digest)
                    out.append((digest, None, None, None, x))
            if out:
                yield _batch(out, names, kinds)
        yield _batch([(*row, None) for row in shards.close()], names, kinds)

    return run


def _met(at: str) -> Callable:
    """(digest, text) rows ordered by digest to (digest, file, offset, length) of each digest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shards, last = _Shards(at), None
        names, kinds = ["digest", "file", "offset", "length"], [pa.binary(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for digest, x in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                if digest != last and (out := shards.add(digest, encoded(payload(x)))):
                    yield _batch(out, names, kinds)
                last = digest
        yield _batch(shards.close(), names, kinds)

    return run


def _members(batches: Iterator) -> Iterator[tuple]:
    """(batch, a function that reads so many bytes of each member of the batch); one file is open at a time."""
    opened: dict = {}
    for batch in batches:

        def read(most: int | None = None) -> Iterator[bytes]:
            nonlocal opened
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    files, path = store(file)
                    opened = {file: files.open_input_file(path)}
                yield opened[file].read_at(length if most is None else min(most, length), offset)

        yield batch, read


def _headers(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch, read in _members(batches):
        shapes = [header(x) for x in read(HEADER)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([s[k] for s in shapes], pa.int32()) for k in ("width", "height", "bits")]], [*batch.schema.names, "width", "height", "bits"])


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch, read in _members(batches):
        out = []
        for media in read():
            samples = decoded(media)
            out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        found = _batch(out, names, kinds)
        yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], [*batch.schema.names, *names])


def stored(df: DataFrame, at: str, text: str = "text", bits: int = MARKS) -> DataFrame:
    """Write the texts' payloads to tar files in the folder `at`; (digest, file, offset, length) of each distinct one.

    Null texts are empty ones.  `bits`, a multiple of 64 up to 2**28, bounds what is sent out of the digests that recur.
    """
    spark = df.sparkSession
    small_batches(spark)
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    again = df.select(sha.alias("sha")).groupBy("sha").count().where("count > 1")
    k = F.conv(F.substring("sha", 1, 7), 16, 10).cast("long") % bits
    found = again.select(k.alias("k")).groupBy(F.shiftright("k", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint64)
    marks = spark.sparkContext.broadcast(words)
    first = staged(df.select(F.col(text).alias("text")).mapInArrow(_alone(at, marks), "digest binary, file string, offset long, length long, text binary"), "alone")
    copies = first.where("file is null").select("digest", "text").repartition(partitions(spark), "digest").sortWithinPartitions("digest")
    rest = staged(copies.mapInArrow(_met(at), "digest binary, file string, offset long, length long"), "copies")
    deleted(spark, f"{at}/{UNFINISHED}")  # what failed attempts have left
    return first.where("file is not null").drop("text").unionByName(rest)


def header_columns(index: DataFrame) -> DataFrame:
    """index (file, offset, length and other columns) with width, height and bits, of which only members' headers are read."""
    small_batches(index.sparkSession)
    return index.mapInArrow(_headers, f"{_ddl(index)}, width int, height int, bits int")


def features(index: DataFrame) -> DataFrame:
    """index with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, of whole members."""
    small_batches(index.sparkSession)
    return index.mapInArrow(_features, f"{_ddl(index)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def media_columns(df: DataFrame, at: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and what the stored payload gives, for each row of df.

    Null texts are empty texts, whose payload is 64 zero bytes.  Equal texts share one stored member.  Rows
    with equal doc_id stay separate rows; an empty table gives an empty result.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.octet_length(own).cast("long").alias("n_bytes"), F.unhex(F.sha2(own.cast("binary"), 256)).alias("digest"))
    return rows.join(staged(features(header_columns(stored(df, at, text))), "features"), "digest").drop("digest")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), fresh_path(spark, "tar"))
