"""Stored days of figures and sketches: repeats, empty tables, errors, pruning; and rules called from SQL."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lavrado.functions import dates, ids, money, text
from lavrado.operators import catalog, classify, extract, payload, quality, reports, typed

RESPONSE = "day string, extraction_method string, detected_category string, status string, confidence double, data struct<issuer_cnpj:string,total_fiscal_document:bigint,line_items:array<string>>"


def days_of(spark, rows):
    return reports.daily(spark.createDataFrame(rows, RESPONSE), F.col("day"))


def test_days_replace_themselves(spark, tmp_path):
    one = [("2024-01-01", "llm", "nfe", "success", 0.9, ("a", 5, ["x"])), ("2024-01-01", "llm", "nfe", "partial", 0.5, ("a", None, [])), (None, None, "nfe", "error", None, None), ("2024-01-02", "llm", "boleto", "error", None, (" ", 7, None))]
    at = str(tmp_path / "days")
    reports.stored(days_of(spark, one), at)
    late = [*one[:2], ("2024-01-01", "llm", "nfe", "success", 1.0, ("b", 100, None))]
    table = reports.stored(days_of(spark, late), at)
    got = {(r.day, r.detected_category): r for r in reports.told(reports.merged(table, "day", "detected_category")).collect()}
    first = got[datetime.date(2024, 1, 1), "nfe"]
    assert len(got) == 3 and (first.n, first.failed, first.scored, first.hundredths, first.cents, first.n_totals, first.n_issuers) == (3, 0, 3, 240, 105, 2, 2)
    assert first.total_quantiles == [5, 100, 100] and first.mean_confidence == pytest.approx(0.8) and first.coverage["line_items"] == pytest.approx(1 / 3) and first.coverage["payment"] == 0
    none = got[None, "nfe"]
    assert (none.n, none.failed, none.cents, none.n_totals, none.n_issuers, none.total_quantiles, none.mean_confidence) == (1, 1, 0, 0, 0, None, None)
    assert got[datetime.date(2024, 1, 2), "boleto"].n_issuers == 0
    levels = {(r.level, r.detected_category, r.extraction_method): r.n for r in reports.rolled_up(table, "detected_category", "extraction_method").collect()}
    assert levels == {(0, "nfe", "llm"): 3, (0, "nfe", None): 1, (0, "boleto", "llm"): 1, (1, "nfe", None): 4, (1, "boleto", None): 1, (2, None, None): 5}
    plan = table.where("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "numPartitions" not in plan


def test_no_rows(spark):
    assert days_of(spark, []).count() == 0 and reports.rolled_up(days_of(spark, []), "detected_category").count() <= 1


def test_sketches_within_bounds(spark):
    """Days of very different sizes, one with most rows; merged figures against all rows."""
    rng = random.Random(5)
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "2024-01-01").otherwise(F.format_string("2024-01-%02d", (F.col("id") % 28 + 1).cast("int"))).alias("day"), F.lit("llm").alias("extraction_method"), F.when(F.col("id") % 100 == 0, "cte").otherwise("nfe").alias("detected_category"), F.lit("success").alias("status"), F.lit(1.0).alias("confidence"),
        F.struct((F.col("id") * rng.randrange(1, 10**6) % 20_011).cast("string").alias("issuer_cnpj"), (F.col("id") * F.col("id") % 1_000_003).alias("total_fiscal_document"), F.array().cast("array<string>").alias("line_items")).alias("data"),
    )
    (got,) = reports.told(reports.merged(reports.merged(reports.daily(rows, F.col("day")), "day"))).collect()
    totals = sorted(k * k % 1_000_003 for k in range(n))
    assert got.n == n and got.cents == sum(totals) and abs(got.n_issuers - 20_011) <= 4 * 0.01625 * 20_011
    for q, x in zip(reports.QUANTILES, got.total_quantiles):
        low, high = (sum(t < x for t in totals) / n, sum(t <= x for t in totals) / n)
        assert low - 0.015 <= q <= high + 0.015


SAID = [
    "", None, "  \t ", "R$ 1.234,56", "1,234.56", "-0,29", "1.5", "x", "45.997.418/0001-53 e 529.982.247-25", "52998224725", "11111111111", "Emissão 05/03/2024 10:11 a 31/02/2024", "03/2024", "Água ﬁ ½ 中", "NFS-e 183\r\nkWh\n", " a \t b ", "PI", "pi", "3517" * 11, "1" + ".000" * 9 + ",00", "' \\ ${x} \"",
    "tel. (86) 3232-1234, (11) 98888 7777; Número 12 / A1 em SP; XX",
]
PAIRS = {
    "strip": text.strip, "squeezed": text.squeezed, "digits": text.digits, "folded": text.folded, "valid_cnpj": ids.valid_cnpj, "valid_cpf": ids.valid_cpf, "valid_document": ids.valid_document, "valid_access_key": ids.valid_access_key, "format_cnpj": ids.format_cnpj, "format_cpf": ids.format_cpf, "first_cnpj": ids.first_cnpj,
    "first_document": ids.first_document, "is_state": ids.is_state, "cents_text": money.cents_text, "cents_payload": money.cents_payload, "cents_xml": money.cents_xml, "moment": dates.moment, "competence": dates.competence, "cnpj_digits": lambda c: ids.cnpj_digits(c), "cpf_digits": lambda c: ids.cpf_digits(c), "key_digit": lambda c: ids.key_digit(c),
}


@pytest.fixture(scope="module")
def said(spark):
    names = catalog.register(spark)
    rows = spark.createDataFrame(list(enumerate(SAID)), "k int, t string")
    rows.createOrReplaceTempView("said")
    yield rows
    for name in names:
        spark.sql(f"DROP TEMPORARY FUNCTION {name}")


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_scalar_functions(spark, said, name):
    sql = spark.sql(f"SELECT k, fiscal_{name}(t) AS x FROM said ORDER BY k").collect()
    assert sql == said.select("k", PAIRS[name](F.col("t")).alias("x")).orderBy("k").collect()


def test_other_functions(spark, said):
    assert spark.sql("SELECT k, fiscal_classified(t) AS x FROM said ORDER BY k").collect() == said.select("k", classify.classified(F.col("t"), F.lit(None).cast("string")).alias("x")).orderBy("k").collect()
    assert spark.sql("SELECT fiscal_cents_value(parse_json('7.5')), fiscal_cache_key(cast('a' AS binary)) = sha2('a', 256)").first() == (750, True)
    lists = {"lines": ("line", text.lines), "amounts": ("cents", money.literals), "phones": ("phone", ids.phones), "states": ("state", ids.states)}
    for name, (column, of) in lists.items():
        want = [(r.k, x) for r in said.select("k", of(F.col("t")).alias("x")).orderBy("k").collect() for x in r.x or []]
        assert [tuple(r) for r in spark.sql(f"SELECT s.k, f.{column} FROM said s, LATERAL fiscal_{name}(s.t) f ORDER BY s.k, f.place").collect()] == want and want
    assert {(r.kind, r.number, r.valid) for r in spark.sql("SELECT f.* FROM said s, LATERAL fiscal_documents(s.t) f WHERE s.k = 8").collect()} == {("cnpj", "45.997.418/0001-53", True), ("cpf", "529.982.247-25", True)}
    assert spark.sql("SELECT sum(weight) FROM fiscal_weights()").first()[0] == 100 == sum(quality.WEIGHTS.values())
    assert [r.field for r in spark.sql("SELECT field FROM fiscal_required('nothing') ORDER BY place").collect()] == quality.REQUIRED["other"]
    assert [r.pattern for r in spark.sql("SELECT pattern FROM fiscal_rules() ORDER BY place").collect()] == [r[2] for r in classify.RULES]


def test_functions_of_a_schema(spark):
    """Not temporary: they are found by name from other sessions, until they are dropped."""
    with pytest.raises(ValueError):
        catalog.register(spark, "r_", temporary=False)
    spark.sql("CREATE DATABASE IF NOT EXISTS rules")
    try:
        catalog.register(spark, "rules.r_", temporary=False)
        assert spark.newSession().sql("SELECT rules.r_valid_cpf('529.982.247-25')").first()[0]
    finally:
        spark.sql("DROP DATABASE rules CASCADE")


def test_prompts(spark):
    long = "a line of text that is long enough not to be a scanned page\n\n\n\nend "
    rows = [(1, b"%PDF-1.7 1", [long], None, "NFE"), (2, b"%PDF-1.7 2", [long], None, "auto"), (3, b"%PDF-1.7 3", [""], None, None), (4, b"<NFe/>", [long], None, None), (5, b"", [long], None, None), (6, b"%PDF-1.7 6", ["x"], ["seen"], " ")]
    df = spark.createDataFrame([(k, bytearray(b), *r) for k, b, *r in rows], "k int, content binary, pages array<string>, ocr_pages array<string>, document_type string")
    got = [r.prompt for r in extract.prompts(df).collect()]
    body = "a line of text that is long enough not to be a scanned page\n\nend"
    assert got == [f"Documento em Markdown:\nTipo informado por quem enviou, a usar se couber: nfe\n---\n{body}\n---", f"Documento em Markdown:\n---\n{body}\n---", None, None, None, "Documento em Markdown:\n---\nseen\n---"]
    lines = extract.instructions().split("\n")
    assert "payment.due_date: AAAA-MM-DD" in lines and "taxes[].type: texto (obrigatório)" in lines and "status: " in typed.described(payload.RECORD)
