"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Plan: (1) each task sums its pre-tokens, one shuffle by pre-token gives the corpus vocabulary;
(2) the library counts the pieces of every distinct pre-token once, the table is written;
(3) a document's frequent pre-tokens (at most `hot` of them, by a histogram of frequencies, so the map that is sent
out has a fixed bound) are summed where the document is, all others become (row, pre-token, frequency) rows that are
joined to the table by pre-token and summed by row.  Ids are never kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from .shared import chunks, documents, modelled, small_batches, staged, utf8, word_bpe


def _summed(text: str, flush: int = 200_000) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(seen: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for x in utf8(batch.column(text)):
                if x:
                    seen.update(chunks(x))
                    if len(seen) > flush:
                        yield rows(seen)
                        seen = Counter()
        if seen:
            yield rows(seen)

    return run


def _pieces(path: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bpe = word_bpe(path, counts=True)
            words = batch.column("pretoken").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array([bpe[w] for w in words], pa.int64())], ["pretoken", "n", "pieces"])

    return run


def _frequencies(doc_id: str, text: str, hot) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        known, row = hot.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, rows, docs, lengths, words, times = batch.column(doc_id), [], [], [], [], []
            own: list = []
            for k, x in enumerate(utf8(batch.column(text))):
                total, rare = 0, []
                for w, n in Counter(chunks(x or b"")).items():
                    p = known.get(w)
                    if p is None:
                        rare.append((w, n))
                    else:
                        total += p * n
                rows.append(row)
                docs.append(k)
                lengths.append(len(x or b""))
                words.append(b" %d" % row)  # no pre-token has a space, and no two rows meet under one key
                times.append(total)
                for w, n in rare:
                    own.append((row, w, n))
                row += 1
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows + [x[0] for x in own], pa.int64()),
                    pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(n, pa.int64())]),
                    pa.array(lengths + [None] * n, pa.int64()),
                    pa.array(words + [x[1] for x in own], pa.binary()),
                    pa.array(times + [x[2] for x in own], pa.int64()),
                ],
                ["row", "doc_id", "n_bytes", "pretoken", "times"],
            )

    return run


def pretoken_table(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken binary, n long, pieces long): each distinct pre-token of the corpus, encoded once; written to the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    seen = df.select(text).mapInArrow(_summed(text), "pretoken binary, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return staged(seen.mapInArrow(_pieces(path), "pretoken binary, n long, pieces long"), "pretokens")


def frequent(pieces: DataFrame, most: int) -> int:
    """A frequency that at most `most` pre-tokens have, and almost as many: from a histogram by sixteenths of a power of
    two, so that no task sorts the vocabulary."""
    bucket = F.floor(F.log2("n") * 16)
    rows = pieces.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("n").alias("top")).collect()  # 1024 at most
    held, least = 0, None
    for r in sorted(rows, reverse=True):
        if held + r["size"] > most:
            return r["top"] + 1
        held, least = held + r["size"], r["least"]
    return least or 1


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, hot: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df.

    Null and empty texts have 0 bytes and 0 tokens.  Rows with equal or null doc_id stay separate rows.
    Special strings inside a text count as the library's default counts them.  An empty table gives an
    empty result.  A tokenizer that texts can't be cut for is refused (ValueError).  hot: the pre-tokens that are summed without a shuffle, a bound of about 30 bytes each.
    """
    spark = df.sparkSession
    modelled(path)
    pieces = pretoken_table(df, path, text)
    top = pieces.where(F.col("n") >= frequent(pieces, hot)).select("pretoken", "pieces").toArrow()  # at most `hot` rows
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_frequencies("doc_id", "text", known), "row long, doc_id long, n_bytes long, pretoken binary, times long")
    # One plan reads the texts once: the rows with a document's own sum find no partner in the join.
    joined = rows.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("times")).otherwise(F.col("times") * F.col("pieces"))
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
