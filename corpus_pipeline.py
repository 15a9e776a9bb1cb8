"""The corpus pipeline: documents in, token ids and digests of what is kept out.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again as the
next one's docs.  Every stage takes tables with null doc_ids and texts, repeated rows, further columns of any name and
no rows at all; all but the last return the columns that they were given, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavrado.llm import decontaminate, language_id, near_dedup, suffix_dedup, tiktoken_codec
from lavrado.llm.shared import documents, staged, table

#: SQL can't express the language classifiers, the suffix deduplication or the encoding; tests hold them against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go, and so do null and empty texts.

    Rows are judged one by one, so repeated rows all stay or all go.  If no row has a language to learn from, every
    text with a letter stays.
    """
    model = language_id.fitted(docs.where(~language_id.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    base = docs.select(F.col("text"), F.struct(*_columns(docs)).alias("own"))
    return language_id.identify(base, model).where("lang_pred <> 'und'").select("own.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), one of the smallest doc_id.

    Rows are told apart by a key of their own, so repeated rows and rows without a doc_id are copies like others; of
    rows with equal doc_ids the first one read stays.  Rows without a word (null and empty texts) are nobody's copies.
    """
    key = _free(docs, "_row")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # written, so that the keys stay
    groups = near_dedup.near_duplicates(rows, doc_id=key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = groups.join(ids, "row").groupBy("component_id").agg(first.alias("x")).select(F.col("x.row").alias(key))
    return rows.join(kept, key, "left_semi").select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once; n_chars follows.

    Repeated rows are strings that occur more than once, so nothing is left of their texts if they are long enough (the
    stage before leaves one of them).  Null texts stay null.
    """
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items; null and empty texts aren't, and repeated rows share one fate."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every kept document, one row for each; null and empty texts have no ids."""
    import public_tokenizers

    return tiktoken_codec.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=True)


STAGES = [("language", languages), ("near_dedup", near_copies), ("suffix_dedup", repeated_passages), ("decontaminate", benchmark_texts), ("byte_bpe", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
