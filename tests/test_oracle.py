"""Every fiscal query against its SQL, and scalar cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lavrado.functions import ids, money, text
from lavrado.operators import quality, xml_fiscal
from lavrado.plans import queries
from lavrado.sources import files


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Of two kinds of separators the last is decimal; one kind alone is decimal.
@pytest.mark.parametrize("literal,cents", [("7,05", 705), ("12.034,5", 1203450), (" R$ 88.000,10 ", 8800010), ("0,004", 0), ("0,015", 2), ("0,025", 2), ("77.5", 7750), ("2.345", round(2.345 * 100)), ("9,876.54", 987654), ("9.876.543,21", 987654321), ("-3,10", -310), ("1,2,3", None), ("cem", None), ("1_000,00", None), ("4.5.6", None), ("9" * 20 + ",00", None), ("R$", None), ("", None), (None, None)])
def test_cents_text(spark, literal, cents):
    assert one(spark, money.cents_text(F.lit(literal).cast("string"))) == cents


@pytest.mark.parametrize("literal,cents", [("BRL 7,05", 705), ("12.034,50", 1203450), ("77.5", 7750), ("9,876.54", 988), ("0.005", 0), ("0.015", 2), ("(3,10)", 310), ("-3,10", -310), ("-", None), ("\t", None), (None, None), ("n/a", None), ("9" * 20 + ",00", None), ("9" * 40, None)])
def test_cents_payload(spark, literal, cents):
    assert one(spark, money.cents_payload(F.lit(literal).cast("string"))) == cents


@pytest.mark.parametrize("value,cents", [("7", 7), ("7.0", 700), ("-7.255", -726), ("1e3", 100000), ("true", 1), ('"7"', 700), ('"7,5"', 750), ("1e300", None), ('"' + "9" * 21 + '"', None), ("null", None), ("[7]", None), ('{"a": 7}', None)])
def test_cents_variant(spark, value, cents):
    assert one(spark, money.cents_variant(F.parse_json(F.lit(value)))) == cents


def brute_digits(base: str, weights: list[int]) -> str:
    for first in weights:
        total = sum(int(d) * w for d, w in zip(base, range(first, 0, -1))) if first > 9 else sum(int(d) * ((len(base) - 1 - i) % 8 + 2) for i, d in enumerate(base))
        base += str(11 - total % 11 if total % 11 > 1 else 0)
    return base


def test_check_digits_against_a_plain_loop(spark):
    bases = [f"{(k * 7919 + 13) % 10**9:09d}" for k in range(60)]
    cpf = [brute_digits(b, [10, 11]) for b in bases]
    cnpj = [brute_digits(b + "001", [1, 1]) for b in bases]
    key = [brute_digits((b * 5)[:43], [1]) for b in bases]
    spoilt = lambda n: n[:-1] + str((int(n[-1]) + 1) % 10)
    rows = [(n, True) for n in cpf + cnpj] + [(spoilt(n), False) for n in cpf + cnpj] + [("2" * 11, False), ("3" * 14, False), ("123", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "n string, good boolean").select("n", "good", ids.valid_document(F.col("n")).alias("x"))
    assert got.where("x is distinct from good").collect() == []
    keys = spark.createDataFrame([(n, True) for n in key] + [(spoilt(n), False) for n in key] + [("1" * 43, False)], "n string, good boolean")
    assert keys.where(ids.valid_access_key(F.col("n")) != F.col("good")).collect() == []


@pytest.mark.parametrize("said,found", [("n. 45 997 418 0001 53 ok", "45.997.418/0001-53"), ("CPF 390.533.447-05 e CNPJ 45997418000153", "45.997.418/0001-53"), ("CPF 390533447 05", "390.533.447-05"), ("x45997418000153", None), ("459974180001534", None), ("", None), (None, None)])
def test_first_document(spark, said, found):
    assert one(spark, ids.first_document(F.lit(said).cast("string"))) == found


@pytest.mark.parametrize("said,plain", [("Serviço Nº ½ … – ação", "SERVICO NO 12 ...  ACAO"), ("ﬁscal ﬂuxo ㎏ ⑩ 𝐀", "FISCAL FLUXO KG 10 A"), ("plain", "PLAIN"), ("中文😀", ""), ("", ""), (None, None)])
def test_folding(spark, said, plain):
    assert one(spark, text.folded(F.lit(said).cast("string"))) == plain


# (text, title, what comes out): empty texts are the bare title; of empty lines one stays, at the top too, but none at the end.
MARKDOWN = [
    ("ITENS DO PEDIDO  \n\n\n\numa linha\t\n\n", "x.pdf", "# x.pdf\n\n## ITENS DO PEDIDO\n\numa linha\n"), ("", "x.pdf", "x.pdf"), (None, None, ""), ("", "", ""), (" \n ", None, "\n"), (" \n ", "t", "# t\n"), ("\n\n\na", "t", "# t\n\n\na\n"),
    ("TRES PALAVRAS ÀQUI\nUM DOIS\n1,00 2,00 3,00", " t ", "# t\n\nTRES PALAVRAS ÀQUI\nUM DOIS\n## 1,00 2,00 3,00\n"), ("a\fb\u2028c", None, "a\nb\nc\n"),
]


@pytest.mark.parametrize("said,title,want", MARKDOWN)
def test_markdown(spark, said, title, want):
    assert one(spark, text.markdown(F.lit(said).cast("string"), F.lit(title).cast("string"))) == want


@pytest.mark.parametrize("content,kind", [(b"RIFF\0\0\0\0WEBPVP8 ", "image/webp"), (b"RIFF\0\0\0\0WAVEfmt ", None), (b"RIFF\x05tUwD%PE\0\0\0\0", None), (b"%PDF", None), (b"%PDF-", "application/pdf"), (b"", None)])
def test_first_bytes(spark, content, kind):
    assert one(spark, files.sniffed(F.lit(content))) == kind


def test_title_case(spark):
    assert one(spark, text.title_case(F.lit("SÃO joão d'ÁGUA 2a"))) == "SÃO joão d'ÁGUA 2a".title()


@pytest.mark.parametrize("blanks,error", [(0, None), (63, None), (64, None), (2000, None), (4095, None), (4096, "UNSUPPORTED_FILE_TYPE")])
def test_xml_after_a_long_blank_head(spark, blanks, error):
    content = (b" \t\r\n\f\x0b" * 700)[:blanks] + b"<a/>"
    r = files.detected(spark.createDataFrame([(bytearray(content), "a.bin")], "content binary, path string")).first()
    assert (r.mime == "application/xml", r.error) == (error is None, error)


def test_lines(spark):
    assert one(spark, text.lines(F.lit("a\r\nb\n\nc\x0bd\n"))) == "a\r\nb\n\nc\x0bd\n".splitlines()


def test_score(spark):
    assert quality.assessed(spark.sql("select 'other' document_category")).first()["missing_fields"] == ["total_fiscal_document"]
    core = spark.sql("select 'nfe' document_category, '11222333000181' issuer_cnpj, '52998224725' recipient_document, '1' fiscal_document_number, 100L total_fiscal_document, '2024-01-01' issued_at")
    r = quality.assessed(core).first()
    assert (r.confidence, r.missing_fields, r.warnings, r.status) == (0.51, [], [], "partial")
    assert sum(quality.WEIGHTS.values()) == 100


def test_odd_xml(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<a>"), (4, "<html/>"), (5, '<!DOCTYPE x><NFe><infNFe Id="NFe1"/></NFe>'), (6, '<NFe><infNFe Id="NFe1"/></NFe>')], "id long, content string")
    assert {r.id: r.error for r in xml_fiscal.parsed(df).collect()} == {1: "PARSE_FAILED", 2: "PARSE_FAILED", 3: "PARSE_FAILED", 4: "PARSE_FAILED", 5: "PARSE_FAILED", 6: None}
