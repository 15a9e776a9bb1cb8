"""What a value is made of is in a plan once, however often the value is used: copies are computed as often as they are there."""

import pytest
from pyspark.sql import functions as F

from lavrado.functions import dates, ids, money, text
from lavrado.operators import abrasf, json_payload, saopaulo, xml_fiscal
from lavrado.plans import queries, services


def copies(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("said") / "t")
    spark.createDataFrame([("a 1,00", "A 1,00")], "t string, u string").write.parquet(at)
    return spark.read.parquet(at)


OF = {"cents_text": money.cents_text, "cents_payload": money.cents_payload, "cents_xml": money.cents_xml, "found": lambda c: ids.found(c, "x"), "competence": dates.competence, "lines": text.lines, "full_lines": text.full_lines}


@pytest.mark.parametrize("name", sorted(OF))
def test_a_text_is_computed_once(said, name):
    assert copies(said.select(OF[name](F.regexp_replace("t", "marker", "")).alias("x")), "marker") == 1


def test_a_table_of_amounts_folds_its_lines_once(said):
    assert copies(said.select(saopaulo._table(F.col("t"), saopaulo.KEPT_COLUMNS).alias("x")), "upper(") == 1


@pytest.mark.parametrize("query,head", [(services.nfse_abrasf_extract, "Prefeitura Municipal de Exemplo"), (services.nfse_saopaulo_extract, "SECRETARIA MUNICIPAL DA FAZENDA\n"), (services.heuristic_cascade, "Prefeitura Municipal de Exemplo")])
def test_a_text_is_written_and_squeezed_once(spark, sf_dir, query, head):
    df = query(spark, sf_dir)
    assert copies(df, head) == 1
    assert copies(df, "{2,}|[") == (2 if query is services.heuristic_cascade else 1)  # one for each layout


# Mostly ASCII, and mostly not; characters that become none, one and several others.
@pytest.mark.parametrize("said_,plain", [("R$ 5 – Nº ½ ™ 𝐀 中 ĳ", "R$ 5  NO 12 TM A  IJ"), ("çãõ" * 40 + "½–中", "CAO" * 40 + "12"), ("ÿ", "Y"), ("\u0080", ""), ("ß", ""), ("–", "")])
def test_folding_piece_by_piece(spark, said_, plain):
    assert spark.range(1).select(text.folded(F.lit(said_)).alias("x")).first()["x"] == plain


@pytest.mark.parametrize("c", [chr(k) for k in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
def test_white_space(spark, c):
    r = spark.range(1).select(text.strip(F.lit(f"{c}{c}a{c}b{c}")).alias("x"), text.strip(F.lit(c)).alias("y"), text.strip(F.lit(f"​{c}")).alias("z")).first()
    assert (r.x, r.y, r.z) == (f"a{c}b", "", "​")


def test_layouts_as_columns_and_as_expressions_agree(spark, sf_dir):
    t = services.orders(spark, sf_dir).where("k < 200").select("k", "c", "cents", "day")
    t = t.select("k", F.explode(F.array(services.municipal_text(), services.paulista_text(), F.lit("x"), F.lit(None))).alias("t")).withColumn("u", text.folded(F.col("t")))
    for layout in (abrasf.LAYOUT, saopaulo.LAYOUT):
        both = layout.recorded(t, "r", "t", "u", F.lit(None)).withColumn("s", layout.parsed(F.col("t"), F.lit(None)))
        assert both.where("to_json(r) is distinct from to_json(s)").count() == 0
        assert both.where("r is not null").count() > 0


def test_elements_that_several_fields_are_in_are_cut_out_once(said):
    df = xml_fiscal.recorded(said, "t")
    assert copies(df, "ide(?=[") == 1 and copies(df, "Valores(?=[") == 1


def test_payload_cents_are_compiled(spark, sf_dir):
    assert "lambda" not in queries.money_payload_cents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    said_ = spark.createDataFrame([(x,) for x in ("1.234,5", "1,234.56", "1,2,3", "1.2.3", "-", ",", "", "x1e5", "--7", "9" * 40, " - 3,005", ".5", "7.", None)], "t string")
    got = [r.x for r in said_.select(money.cents_payload_column(F.col("t")).alias("x")).collect()]
    assert got == [123450, 123, None, None, None, None, None, 1500, None, None, -300, 50, 700, None]


ODD = ["{}", "[1]", "7", "null", "{", None, '{"subtotal": "1e5", "pis_value": "", "icms_value": " - ", "payment": null, "iss_value": [1], "cofins_value": {"a": 1}}',
       '{"subtotal": true, "pis_value": 1e3, "total_services": "1.234,565", "line_items": [null, 7, {"discount": "x"}, {"discount": 1.005}], "payment": {"total_amount": -7.255}, "fiscal_info": {"approximate_taxes": "1.2.3"}, "taxes": [{"base": "(3,10)"}], "withholdings": {}}']


def test_amounts_by_projections_are_those_of_the_expression(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ODD], "p string")
    v = F.try_parse_json("p")
    rows = json_payload.with_amounts(df.withColumn("b", json_payload.amounts(v)), "a", v).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a.subtotal is not None for r in rows) == 2
    plan = services.money_variant_cents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression" in plan


# Told once a text whether its lines need a search by pattern: what comes out is the same.
@pytest.mark.parametrize("said_,plain", [("a\n\nb c\n", True), (" a\nb ", True), ("a \nb", False), ("a\n b", False), ("a\r\nb", False), ("a b", False), ("a\u0085b", False), ("a b", False), ("", True), ("ç–\nº", True)])
def test_lines_of_tidy_texts(spark, said_, plain):
    t = F.lit(said_)
    row = spark.range(1).select(text.tidy(t).alias("p"), text.tidy(t, text.usual_only(t)).alias("q"), text.full_lines(t).alias("x"), text.full_lines(t, text.tidy(t)).alias("y"), text.lines(t, text.tidy(t)).alias("z")).first()
    assert (row.p, row.q) == (plain, plain)
    assert row.x == row.y == [x.strip() for x in said_.splitlines() if x.strip()] and row.z == said_.splitlines()


@pytest.mark.parametrize("said_", ["Nº  5 ção", "a  é", "a ´ b", "a – b", "½  x", "a\t b", "´", "  é  "])
def test_a_squeezed_text_is_folded_by_way_of_the_whole(spark, said_):
    t = F.lit(said_)
    seen = text.squeezed_usual(t, text.usual_only(t), text.squeezed(t))
    row = spark.range(1).select(text.folded_usual(seen).alias("x"), text.folded(text.squeezed(t)).alias("y")).first()
    assert row.x == row.y


# The first line with a postal code is the street, a line of letters below it the city, the first number the ie.
def test_a_party_of_sao_paulo_is_what_comes_first(spark):
    block = "PRESTADOR\nAlto Bairro\nCNPJ:\n12-34\n7.777\n12345678000195\nCasa Exemplo  LTDA\nRUA A 5 - CEP 01999-111\nRUA B 6 - CEP 01999-222\nUF: XX\nSP\nUF: PR\nCampinas\nMunicípio: São Paulo"
    row = spark.createDataFrame([(block,)], "b string").select(saopaulo._party(F.col("b"), F.lit(True)).alias("p")).first().p
    assert (row.document, row.ie, row.name) == ("12.345.678/0001-95", "12-34", "Alto Bairro")
    assert (row.address.street, row.address.city, row.address.state) == ("RUA A", "Campinas", "SP")
