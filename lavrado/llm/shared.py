"""What the operators have in common: shared folders, staged tables, batch sizes, word-BPE caching."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from array import array
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python, and bytes after which a batch ends sooner: texts can be long.
BATCH_ROWS = 256
BATCH_BYTES = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.  The cluster names it; only on one machine (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "lavrado-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/lavrado/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once and its lineage ends there."""
    spark = df.sparkSession
    at = fresh_path(spark, label)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # the write is the shuffles' only reader
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table whose last reader has finished."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lavrado/" in at:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def deleted(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and the bytes of an Arrow batch, unless the session bounds them lower.

    Spark reads these settings when a plan runs, after an operator has returned, so they stay in the session.  A text
    longer than BATCH_BYTES is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def utf8(column) -> list[bytes | None]:
    """An Arrow string column's values as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(text: bytes) -> list[bytes]:
    """Pre-tokens of a text for the word BPE: runs without ASCII white space.

    The tokenizer (see `modelled`) drops white space and no piece crosses it, so a text's ids are those of its
    chunks, joined.
    """
    return text.split()


#: Bytes of a text that are cut into chunks at a time, and what chunks end at.
LONG = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\f\v]")
_LETTERS = "a-z" + "".join(filter(str.isalpha, map(chr, range(0x80, 0x250))))
#: A letter, digit or ASCII sign other than an apostrophe, over and over; and its pieces.
_PLAIN = re.compile(f"[{_LETTERS}0-9!-&(-/:-@\\[-`{{-~]+")
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


# The normaliser and the splitter that `chunks` and WordBpe stand for.
MODELLED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def modelled(path: str) -> None:
    """Raise unless a tokenizer file has the normaliser and the splitter of MODELLED, a byte-level BPE without drop-out
    and no special string other than `<|...|>`: only then the ids of a text are those of its chunks and pieces."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    same = all(told.get(k) == v for k, v in MODELLED.items()) and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    plain = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not set(t["content"]) & set(" \t\n\r\f\v") for t in told["added_tokens"])
    if not (same and plain):
        raise ValueError(f"{path}: its normaliser, splitter or model isn't the one that texts are cut for")


class WordBpe(dict):
    """Chunk: its ids (bytes of little-endian uint32), or how many, by the tokenizers library.

    A chunk is encoded when it is first asked for.  The library lower-cases, so a chunk with A-Z takes what
    its lower-case form has (unless it may hold a special string, whose case counts).  It cuts between letters,
    single digits and runs of other signs, so a chunk of Latin letters, digits and ASCII signs has the ids of
    these pieces (unless an apostrophe may start a suffix).  At `most` entries the later half goes.
    """

    def __init__(self, path: str, counts: bool = False, most: int = 600_000) -> None:
        super().__init__()
        modelled(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.most, self.counts, self.model = most, counts, self.library.model
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(256, 512))
        self.byte_names = {b: b if b in plain else next(other) for b in range(256)}

    def encoded(self, chunk: bytes):
        word = chunk.decode("utf-8", "replace")
        low = word.lower()
        if not _PLAIN.fullmatch(low) or b"<|" in chunk:
            ids = self.library.encode(word, add_special_tokens=False).ids
        elif low != word:
            return self[low.encode()]
        elif len(pieces := _PIECE.findall(word)) > 1:
            parts = [self[x.encode()] for x in pieces]
            return sum(parts) if self.counts else b"".join(parts)
        else:  # one piece, which the library's normaliser and splitter leave as it is
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else chunk.decode("latin-1").translate(self.byte_names))]
        return len(ids) if self.counts else array("I", ids).tobytes()

    def __missing__(self, chunk: bytes):
        if len(self) >= self.most:
            first = list(islice(self.items(), self.most // 2))  # the frequent ones came early
            self.clear()
            self.update(first)
        if (low := chunk.lower()) != chunk and b"<|" not in chunk:
            found = self[low]
        else:
            found = self.encoded(chunk)
        self[chunk] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """A text's ids, a megabyte or so of its chunks at a time."""
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, text.split()))
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(self.__getitem__, text[at:end].split())))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def word_bpe(path: str, counts: bool = False) -> WordBpe:
    """One map for all tasks that a Python worker runs."""
    return WordBpe(path, counts)
