"""Reports over responses: stored days of counts, coverage and mergeable sketches, rolled up without the responses.

A day's rows are made once from that day's responses and written in place of what was there of that day.  A report
over any days and keys merges stored rows: counts are summed, sketches united.  A stored row is bounded (about 4 KB
of distinct issuers, 2^12 registers, and 20 KB of totals), whatever the number of responses it stands for, and both
steps aggregate before they shuffle, so a key that has a third of all responses is no large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F

from .quality import WEIGHTS, Record

#: The registers' logarithm of sketches of distinct values; their relative standard error is 1.04 / 2^(LG / 2), 1.6 %.
LG = 12
#: The size of sketches of quantiles; a rank is right to 0.4 % of the rows at 99 % of the time.
K = 800
QUANTILES = (0.5, 0.9, 0.99)


def daily(responses: DataFrame, day: Column, keys: Sequence[str] = ("extraction_method", "detected_category"), of: str | None = "data") -> DataFrame:
    """One row for each day and keys: n, failed, scored, hundredths, cents, n_totals, filled, issuers and totals.

    responses has the keys, status, confidence and the record (`of`: a struct column, None: columns).  hundredths: the sum
    of the confidences of the `scored` ones; cents: the sum of the totals, of which there are n_totals; filled: for each
    field of WEIGHTS, in order, how many records have it; issuers and totals: sketches.  Null days and keys are groups of
    their own; failed responses count in n and failed, and with what their record has.  An empty table gives none.
    """
    own = Record(responses, of)
    field = lambda name: own[name] if name in own.kinds else F.lit(None)
    total = field("total_fiscal_document").cast("long")
    issuer = F.nullif(F.trim(field("issuer_cnpj").cast("string")), F.lit(""))
    made = responses.select(
        day.cast("date").alias("day"), *[F.col(f"`{k}`") for k in keys], (F.col("status") == "error").alias("_failed"), F.rint(F.col("confidence") * 100).cast("long").alias("_hundredths"), total.alias("_total"), issuer.alias("_issuer"),
        F.array(*[F.coalesce(own.has_value(name), F.lit(False)) for name in WEIGHTS]).alias("_has"),
    )
    filled = F.array(*[F.sum(F.col("_has")[k].cast("long")) for k in range(len(WEIGHTS))])
    return made.groupBy("day", *[f"`{k}`" for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_failed").alias("failed"), F.count("_hundredths").alias("scored"), F.coalesce(F.sum("_hundredths"), F.lit(0)).alias("hundredths"), F.coalesce(F.sum("_total"), F.lit(0)).alias("cents"), F.count("_total").alias("n_totals"),
        filled.alias("filled"), F.hll_sketch_agg("_issuer", F.lit(LG)).alias("issuers"), F.kll_sketch_agg_bigint("_total", F.lit(K)).alias("totals"),
    )


def stored(days: DataFrame, path: str) -> DataFrame:
    """Writes rows of daily() to a table by day, in place of what it has of these days, and gives the table.

    A day that is computed again, after late responses or a lost job, therefore counts once.
    """
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return opened(days.sparkSession, path, days)


def opened(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table, with the columns of `like`; conditions on the day prune its files."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def _merged(groups: GroupedData, *more: Column) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "failed", "scored", "hundredths", "cents", "n_totals")]
    filled = F.array(*[F.sum(F.col("filled")[k]) for k in range(len(WEIGHTS))]).alias("filled")
    return groups.agg(*more, *sums, filled, F.hll_union_agg("issuers").alias("issuers"), F.kll_merge_agg_bigint("totals", F.lit(K)).alias("totals"))


def merged(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of daily(), or of this, for each of `by`; without any, one row for all."""
    return _merged(rows.groupBy(*by))


def rolled_up(rows: DataFrame, *by: str) -> DataFrame:
    """For each head of the list `by`, from all of it to none of it; `level` is how many of the last keys are summed over
    (a null key of level 0 is a group, not a sum)."""
    level = sum((F.grouping(k) for k in by), F.lit(0)).cast("long")
    return _merged(rows.rollup(*by), level.alias("level"))


def told(rows: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Merged rows with figures in place of sketches: n_issuers, total_quantiles (null without totals), mean_confidence
    (null without scores) and coverage, a map of each field to the share of records that have it."""
    share = F.transform("filled", lambda x: x / F.col("n"))
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return rows.withColumns({
        "n_issuers": F.hll_sketch_estimate("issuers"),
        "total_quantiles": F.when(F.col("n_totals") > 0, F.kll_sketch_get_quantile_bigint("totals", at)),
        "mean_confidence": F.when(F.col("scored") > 0, F.col("hundredths") / F.col("scored") / 100),
        "coverage": F.map_from_arrays(F.array(*map(F.lit, WEIGHTS)), share),
    }).drop("issuers", "totals", "filled")
