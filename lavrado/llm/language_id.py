"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (log-odds of the
n-gram under the bit's languages against the others) predicts the bit.  A text's margins are decoded by
loss: the bits' logistic losses, weighted by how far apart the classifier's two sides are, are summed for
every codeword and the least wins; a second one close by flags the text as ambiguous.

Plan: a count by language, a bounded sample of labelled rows (each row by itself, so copies of one text neither all
come in nor all stay out), one aggregation of n-gram counts (at most BUCKETS a language and task, and BUCKETS rows
a language at the driver), then a row-local pass over all texts.  What is sent out is BUCKETS x bits numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import documents, small_batches, utf8

BUCKETS = 1 << 17
#: Labelled rows a language that the classifiers are fitted on, in expectation.
TRAIN_ROWS = 4000
#: Texts whose two nearest codewords' losses lie closer are ambiguous.
CLOSE = 0.1
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Numeric signs such as ½ or ² are no letters."""
    return _LATIN.search(text) is not None or any(map(str.isalpha, text))


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every 2-, 3- and 4-byte string of letters and spaces, A-Z lower-cased."""
    spaced = [b" " + x.translate(_LETTERS) + b" " for x in texts]
    sizes = np.array([len(x) for x in spaced], dtype=np.int64)
    data = np.frombuffer(b"".join(spaced) + b"   ", dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = int(sizes.sum())
    three = (data[:n] << np.uint32(16)) | (data[1 : n + 1] << np.uint32(8)) | data[2 : n + 2]
    four = three * np.uint32(0x01000193) ^ data[3 : n + 3]
    buckets = [((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) for x in (three, four)]
    return np.stack([buckets[0], buckets[1] + BUCKETS // 2]), owner


def codewords(languages: int) -> np.ndarray:
    """Languages x bits of +-1: every split into two sides for up to seven languages, else random ones, all different."""
    if languages <= 7:
        bits = [[1 if (s >> k) & 1 else -1 for k in range(languages)] for s in range(1, 1 << max(0, languages - 1))]
        return np.array(bits or [[1]], dtype=np.float64).T
    draw, count = np.random.default_rng(7), int(np.ceil(15 * np.log2(languages)))
    out: list = []
    while len(out) < count:
        bit = draw.choice([-1.0, 1.0], languages)
        if abs(bit.sum()) < languages:
            out.append(bit)
    return np.array(out).T


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column("lang").to_pylist()
        texts = utf8(batch.column("text"))
        for lang in set(names):
            b, _ = ngrams([t for t, x in zip(texts, names) if x == lang])
            total[lang] = total.get(lang, 0) + np.bincount(b.ravel(), minlength=BUCKETS)
    for lang, counts in total.items():
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(have)), pa.array(have, pa.int32()), pa.array(counts[have], pa.int64())], ["lang", "bucket", "n"])


class Model:
    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.languages])
        weights, middle, spread = [], [], []
        for bit in self.code.T:
            yes = p[bit > 0].mean(axis=0)
            no = p[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            w = np.log(yes) - np.log(no)
            a, b = (yes * w).sum(), (no * w).sum()
            weights.append(w)
            middle.append((a + b) / 2)
            spread.append(max((a - b) / 2, 1e-9))
        self.weights, self.middle, self.spread = np.array(weights, dtype=np.float32).T.copy(), np.array(middle), np.array(spread)
        self.trust = self.spread / self.spread.sum()

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages; each text's margins are means over its n-grams."""
        buckets, owner = ngrams(texts)
        sums = np.zeros((len(texts), self.weights.shape[1]))
        starts = np.searchsorted(owner, np.arange(len(texts)))
        for row in buckets:
            for a in range(self.weights.shape[1]):
                sums[:, a] += np.add.reduceat(self.weights[row, a], starts)
        z = (sums / (2 * np.bincount(owner, minlength=len(texts)))[:, None] - self.middle) / self.spread
        return np.stack([(np.log1p(np.exp(-np.clip(3 * z * word, -50, 50))) * self.trust).sum(axis=1) for word in self.code], axis=1)


def _predicted(model) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own, texts = model.value, batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t and own is not None and has_letter(t)]
            name, score, vague = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if some:
                loss = own.losses([texts[i].encode() for i in some])
                order = np.sort(loss, axis=1)
                best = loss.argmin(axis=1)
                share = np.exp(-8 * (loss - order[:, :1]))
                for k, i in enumerate(some):
                    name[i], score[i] = own.languages[best[k]], float(1 / share[k].sum())
                    vague[i] = bool(loss.shape[1] > 1 and order[k, 1] - order[k, 0] < CLOSE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name), pa.array(score, pa.float64()), pa.array(vague)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return run


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """The classifiers of the languages of a table's rows with text and label; None if there is none.

    `rows` bounds the rows of a language that are learned from, in expectation; a language with fewer rows is
    learned from all of them.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    some = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in some.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])
    sample = some.where(F.rand(11) < share[F.col("lang")])
    found = sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS a language
    counts = {}
    for k, part in found.groupby("lang"):
        counts[k] = np.zeros(BUCKETS)
        counts[k][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model(counts) if counts else None


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and ambiguous.

    Texts that are null or have no letter, and all texts if there is no model, are `und` with score 0 and
    ambiguous.  A letter is what Unicode calls one.  Ties go to the first language by name.  Other columns are kept; columns of the new names are
    replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "ambiguous")
    keep = [c for c in df.columns if c not in new]
    base = df.select(F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep if c != text]).alias("row"))
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([*base.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    return base.mapInArrow(_predicted(shared), schema).select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in keep], *new)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
