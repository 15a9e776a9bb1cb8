"""Queries of corpus reports, of rules called from SQL, of codes in texts and of prompts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ids
from ..operators import catalog, extract, quality, reports, xml_fiscal
from ..streaming import ingest
from . import services

#: What sketches of the report are held to: four standard errors of the issuers' count, and ranks within 1.5 % of the rows.
ISSUERS_WITHIN, RANKS_WITHIN = 4 * 1.04 / 2 ** (reports.LG / 2), 0.015


def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all invoices by segment and status, from stored days, and whether sketches are within their bounds.

    The exact figures that they are held against are computed from the same responses.
    """
    from .queries import invoices  # the invoices of orders, which are in the module that lists this one's queries

    at = ingest.stream_folder(spark)
    parsed = xml_fiscal.parsed(invoices(spark, sf_dir)).withColumn("segment", F.coalesce("segment", F.lit("-")))
    judged = quality.assessed(parsed)
    bad = F.col("error").isNotNull()
    record = F.struct(*[F.col(c) for c in quality.WEIGHTS if c in judged.columns])
    kept = judged.select("segment", F.when(bad, "error").otherwise(F.col("status")).alias("status"), F.when(~bad, F.col("confidence")).alias("confidence"), F.when(~bad, record).alias("data"))
    kept.write.parquet(f"{at}/responses")
    responses = spark.read.schema(kept.schema).parquet(f"{at}/responses")
    keys = ("segment", "status")
    days = reports.stored(reports.daily(responses, F.to_date(F.left("data.issued_at", F.lit(10))), keys), f"{at}/days")
    got = reports.told(reports.rolled_up(days, *keys))
    exact = responses.rollup(*keys).agg(sum((F.grouping(k) for k in keys), F.lit(0)).cast("long").alias("level"), F.count_distinct("data.issuer_cnpj").alias("issuers"))
    # How many totals are below and up to each quantile: a row of responses meets the three groups that it is in.
    levels = F.array(*[F.struct(F.lit(n).cast("long").alias("level"), *[(F.col(k) if len(keys) - j > n else F.lit(None)).cast("string").alias(k) for j, k in enumerate(keys)]) for n in range(len(keys) + 1)])
    each = responses.select("data.total_fiscal_document", F.explode(levels).alias("g")).where("total_fiscal_document is not null").select("total_fiscal_document", "g.*")
    same = lambda a, b: (a["level"] == b["level"]) & a["segment"].eqNullSafe(b["segment"]) & a["status"].eqNullSafe(b["status"])
    told = got.select("level", *keys, F.col("total_quantiles").alias("q"), "n_totals")
    met = each.join(told, same(each, told)).groupBy(each["level"], each["segment"], each["status"]).agg(
        F.max("n_totals").alias("m"), *[F.count_if(each["total_fiscal_document"] < told["q"][k]).alias(f"below{k}") for k in range(len(reports.QUANTILES))], *[F.count_if(each["total_fiscal_document"] <= told["q"][k]).alias(f"upto{k}") for k in range(len(reports.QUANTILES))]
    )
    right = F.lit(True)
    for k, q in enumerate(reports.QUANTILES):
        right = right & (F.col(f"below{k}") / F.col("m") <= q + RANKS_WITHIN) & (F.col(f"upto{k}") / F.col("m") >= q - RANKS_WITHIN)
    met = met.select("level", *keys, right.alias("quantiles_ok"))
    out = got.join(exact, same(got, exact)).drop(exact["level"], *[exact[k] for k in keys])
    out = out.join(met, same(out, met), "left").drop(met["level"], *[met[k] for k in keys])
    return out.select(
        "level", *keys, "n", "failed", "scored", "hundredths", "cents", "n_totals", F.col("issuers").alias("n_issuers"), (F.abs(F.col("n_issuers") - F.col("issuers")) <= F.greatest(F.lit(1.0), ISSUERS_WITHIN * F.col("issuers"))).alias("issuers_ok"),
        F.coalesce("quantiles_ok", F.col("n_totals") == 0).alias("quantiles_ok"), *[F.round(F.col("coverage")[k] * F.col("n")).cast("long").alias(f"with_{k}") for k in ("fiscal_document_number", "recipient_document", "payment")],
    )


def sql_tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers of customers, made, spoilt and checked by functions of SQL."""
    catalog.register(spark)
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(
        """SELECT c_custkey, fiscal_valid_cnpj(a) AS cnpj_ok, fiscal_valid_cpf(b) AS cpf_ok, fiscal_valid_document(concat('CNPJ ', a)) AS document_ok, fiscal_format_cpf(b) AS cpf, fiscal_first_document(concat('emitida por ', fiscal_format_cnpj(a))) = fiscal_format_cnpj(a) AS found
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat(left(a, 13), translate(right(a, 1), '0123456789', '1234567890')) ELSE a END AS a, b
 FROM (SELECT c_custkey, concat(lpad(c_custkey, 8, '0'), '0001', fiscal_cnpj_digits(concat(lpad(c_custkey, 8, '0'), '0001'))) AS a, concat(lpad(c_custkey, 9, '0'), fiscal_cpf_digits(lpad(c_custkey, 9, '0'))) AS b FROM {t}))""",
        t=t,
    )


def sql_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount of every text, by a table function."""
    catalog.register(spark)
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT d.doc_id, cast(a.place AS bigint) AS place, a.literal, a.cents FROM {t} d, LATERAL fiscal_amounts(d.text) a", t=t)


def sql_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts' documents of all categories need, and the weight of it, by table functions of the rules."""
    catalog.register(spark)
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(
        """SELECT c.category, count(DISTINCT p.p_partkey) AS n_documents, count(*) AS n_fields, cast(sum(w.weight) AS bigint) AS weight
 FROM (SELECT p_partkey, fiscal_classified(p_name, CASE p_partkey % 5 WHEN 0 THEN 'nfe' WHEN 1 THEN 'NFSE' WHEN 2 THEN 'boleto' WHEN 3 THEN 'utility_gas' END) AS c FROM {t}) p, LATERAL fiscal_required(p.c.category) r JOIN fiscal_weights() w ON w.field = r.field GROUP BY c.category""",
        t=t,
    )


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access keys, telephone numbers, numbers with a series and states in a line of text for each order."""
    t = services.orders(spark, sf_dir)
    k = F.col("k").cast("string")
    base = F.lpad(k, 43, "3517")
    digit = F.when(F.col("k") % 4 == 0, (ids.key_digit(base) + 1) % 10).otherwise(ids.key_digit(base))
    spaced = F.regexp_replace(F.concat(base, digit.cast("string")), "(\\d{4})(?=\\d)", "$1 ")
    said = F.concat(F.lit("Chave "), spaced, F.lit(" tel. (41) 3000-"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.lit(" Nota "), F.lpad((F.col("k") % 1000).cast("string"), 9, "0"), F.lit(" / 2A de PR a XX e "), F.element_at(F.array(*map(F.lit, ids.STATES)), (F.col("k") % len(ids.STATES)).cast("int") + 1))
    t = t.select("k", said.alias("t"))
    series = ids.numbers_with_series(F.col("t"))
    joined: Column = F.array_join(ids.states(F.col("t")), ",")
    return t.select("k", F.size(ids.access_keys(F.col("t"))).cast("long").alias("n_keys"), F.element_at(ids.phones(F.col("t")), -1).alias("phone"), F.element_at(series, -1)["number"].alias("number"), F.element_at(series, -1)["series"].alias("series"), joined.alias("states"))


def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each text as a page of a PDF with a hint of three kinds, under its key."""
    content = F.concat(F.lit("%PDF-1.7 ").cast("binary"), F.col("doc_id").cast("string").cast("binary"))
    hint = F.when(F.col("doc_id") % 3 == 0, " NFE ").when(F.col("doc_id") % 3 == 1, "auto")
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select(content.alias("content"), F.array("text").alias("pages"), F.array("text").alias("ocr_pages"), hint.alias("document_type"))
    return extract.prompts(t).select("cache_key", F.col("prompt").isNotNull().alias("asked"), F.regexp_extract("prompt", "^Documento em Markdown:\n(.*\n)?---\n", 1).alias("hint"), F.endswith("prompt", F.lit("\n---")).alias("closed"), F.regexp_count("prompt", F.lit("\n\n\n")).cast("long").alias("wide"))


QUERIES = [report_rollup, sql_tax_ids, sql_amounts, sql_required, code_scan, model_prompts]


def oracle_sql() -> dict[str, str]:
    held = "CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 13 ELSE 0 END"
    rows = f"""SELECT coalesce(c_mktsegment, '-') AS segment, CASE WHEN bad OR o_orderkey % 4 = 0 THEN 'error' WHEN 81 - gone < 70 THEN 'partial' ELSE 'success' END AS status, CASE WHEN NOT bad THEN 81 - gone END AS h,
 CASE WHEN NOT bad THEN round(o_totalprice * 100)::BIGINT END AS cents, CASE WHEN NOT bad THEN o_custkey END AS issuer, NOT bad AND o_orderkey % 4 <> 0 AS numbered, NOT bad AND o_orderkey % 5 <> 0 AS received
 FROM (SELECT *, o_orderkey % 11 = 0 AS bad, {held} AS gone FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
    required = [(c, len(f), sum(quality.WEIGHTS[x] for x in f)) for c, f in quality.REQUIRED.items()]
    listed = ", ".join(f"('{c}', {n}, {w})" for c, n, w in required)
    stated = "[" + ", ".join(f"'{x}'" for x in ids.STATES) + "]"
    cents = "CASE WHEN regexp_full_match(p, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN round_even(CAST(p AS DOUBLE) * 100, 0)::BIGINT END"
    last = lambda c: f"(CASE WHEN contains({c}, ',') AND contains({c}, '.') AND strpos(reverse({c}), ',') > strpos(reverse({c}), '.') THEN replace({c}, ',', '') WHEN contains({c}, ',') THEN replace(replace({c}, '.', ''), ',', '.') ELSE {c} END)"
    return {
        "report_rollup": f"""SELECT (grouping(segment) + grouping(status))::BIGINT AS level, segment, status, count(*) AS n, count(*) FILTER (status = 'error') AS failed, count(h) AS scored, coalesce(sum(h), 0)::BIGINT AS hundredths, coalesce(sum(cents), 0)::BIGINT AS cents, count(cents) AS n_totals,
 count(DISTINCT issuer) AS n_issuers, true AS issuers_ok, true AS quantiles_ok, count(*) FILTER (numbered) AS with_fiscal_document_number, count(*) FILTER (received) AS with_recipient_document, 0::BIGINT AS with_payment FROM ({rows}) GROUP BY ROLLUP (segment, status)""",
        "sql_tax_ids": """SELECT c_custkey, c_custkey % 5 <> 0 AS cnpj_ok, c_custkey % 111111111 <> 0 AS cpf_ok, c_custkey % 5 <> 0 AS document_ok, k[1:3] || '.' || k[4:6] || '.' || k[7:9] || '-' || d1 || (11 - (list_sum(list_transform(range(9), lambda i: CAST(k[i + 1] AS INT) * (11 - i))) + 2 * d1)::INT % 11) % 11 % 10 AS cpf, true AS found
 FROM (SELECT *, (11 - list_sum(list_transform(range(9), lambda i: CAST(k[i + 1] AS INT) * (10 - i)))::INT % 11) % 11 % 10 AS d1 FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k FROM customer))""",
        "sql_amounts": f"""SELECT doc_id, place, literal, {cents} AS cents FROM (SELECT doc_id, place, literal, {last('literal')} AS p FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS place, unnest(m) AS literal FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:R\\$\\s*)?(\\d{{1,3}}(?:[.,]\\d{{3}})*[.,]\\d{{2}})', 1) AS m FROM documents)))""",
        "sql_required": f"""SELECT category, count(*) AS n_documents, sum(f)::BIGINT AS n_fields, sum(w)::BIGINT AS weight FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'nfe' WHEN 1 THEN 'nfse' WHEN 2 THEN 'boleto' WHEN 3 THEN 'utility_gas' ELSE 'other' END AS category FROM part)
 JOIN (VALUES {listed}) AS r(category, f, w) USING (category) GROUP BY category""",
        "code_scan": f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n_keys, '413000' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone, o_orderkey % 1000 AS number, '2A' AS series, 'PR,' || {stated}[o_orderkey % {len(ids.STATES)} + 1] AS states FROM orders""",
        "model_prompts": """SELECT sha256('%PDF-1.7 ' || doc_id) AS cache_key, t <> '' AS asked, CASE WHEN t = '' THEN NULL WHEN doc_id % 3 = 0 THEN 'Tipo informado por quem enviou, a usar se couber: nfe' || chr(10) ELSE '' END AS hint, CASE WHEN t <> '' THEN true END AS closed, CASE WHEN t <> '' THEN 0::BIGINT END AS wide
 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
    }
