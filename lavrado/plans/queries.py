"""The queries of the fiscal operators over the test tables, and their DuckDB SQL.

The tables hold no fiscal documents, so queries make them from keys and cents; the SQL gives what has to come
out from the tables' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, ids, money, text
from ..operators import cache, classify, quality, xml_fiscal
from ..sources import files
from ..streaming import ingest
from . import records, reports, services, streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CENTS = "(l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 1009) % 100000000"


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_CENTS} AS cents")
    t = t.withColumns({"r": F.expr("cast(cents div 100 as string)"), "c": F.expr("lpad(cast(cents % 100 as string), 2, '0')")})
    grouped = lambda mark: F.regexp_replace("r", "(?<=\\d)(?=(\\d{3})+$)", mark)
    return t.select("l_orderkey", "l_linenumber", F.concat(F.lit("R$ "), grouped("."), F.lit(","), "c").alias("br"), F.concat(grouped(","), F.lit("."), "c").alias("us"), F.concat("r", F.lit("."), "c").alias("bare"), F.concat(F.lit("total "), "r").alias("junk"))


def money_text_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _literals(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", *[money.cents_text(F.col(c)).alias(c) for c in ("br", "us", "bare", "junk")])


def money_payload_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _literals(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", *[money.cents_payload_column(F.col(c)).alias(c) for c in ("br", "us", "bare")])


def money_literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(money.literals(F.col("text"))).cast("long").alias("n_literals"))


def tax_ids_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer").select("c_custkey")
    base14, base11 = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("0001")), F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    spoilt = lambda d, n: F.when(F.col("c_custkey") % n == 0, F.translate(F.substring(d, -1, 1), "0123456789", "1234567890")).otherwise(F.substring(d, -1, 1))
    t = t.withColumns({"a": F.concat(base14, ids.cnpj_digits(base14)), "b": F.concat(base11, ids.cpf_digits(base11))})
    t = t.withColumns({"a": F.concat(F.expr("left(a, 13)"), spoilt(F.col("a"), 5)), "b": F.concat(F.expr("left(b, 10)"), spoilt(F.col("b"), 7))})
    return t.select("c_custkey", ids.valid_cnpj(F.col("a")).alias("cnpj_ok"), ids.valid_cpf(F.col("b")).alias("cpf_ok"), ids.valid_document(F.col("a")).alias("document_ok"), F.substring(ids.format_cnpj(F.col("a")), 1, 15).alias("cnpj_root"))


def access_key_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lpad(F.col("o_orderkey").cast("string"), 43, "3517")
    digit = ids.key_digit(base)
    key = F.concat(base, F.when(F.col("o_orderkey") % 3 == 0, (digit + 1) % 10).otherwise(digit).cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", ids.valid_access_key(key).alias("key_ok"))


def sniff_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = ["255044462D312E37", "FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425056503820", "504B0304", "20200A3C", "3F3F3F3F", ""]
    name = ["a.bin", "b", "c.PNG", "d.x", "e.docx", "f.txt", "g.bin", "h.pdf"]
    kind = (F.col("page_id") % 8).cast("int")
    content = F.when(kind == 7, F.lit(b"")).otherwise(F.concat(F.unhex(F.element_at(F.array(*map(F.lit, head)), kind + 1)), F.col("html").cast("binary")))
    t = _table(spark, sf_dir, "pages").select("page_id", content.alias("content"), F.element_at(F.array(*map(F.lit, name)), kind + 1).alias("path"))
    return files.detected(t).select("page_id", "mime", "category", "error")


_SAMPLES = [
    ("Consumo medido pela Eletropaulo no mês", "nf3e", "enel", 0.9), ("nota de débito 12", "rental_invoice", "nota_debito", 0.9), ("Locação de bens móveis", "rental_invoice", "rental", 0.9), ("NFS-e 183 emitida", "nfse", "nfse_sp", 0.9),
    ("código CGNFSe", "other", None, 0.0), ("CHAVE DE ACESSO 3517", "nfe", "danfe", 0.9), ("Fatura de serviços de água", "utility_water", "sabesp", 0.9), ("www.vivo.com.br", "utility_telecom", "vivo", 0.9), ("Claro empresas", "utility_telecom", "telecom", 0.9),
    ("120 kWh no período", "utility_electricity", "electricity", 0.9), ("gás encanado", "utility_gas", "gas", 0.9), ("LINHA DIGITÁVEL 34191.7", "boleto", "boleto", 0.9), ("Nota fiscal de consumidor", "nfce", "nfce", 0.9), ("conhecimento de transporte", "cte", "cte", 0.9),
    ("VENCIMENTO 10/10", "invoice", None, 0.4), ("  \n ", "other", None, 0.0),
]


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % len(_SAMPLES)).cast("int") + 1
    t = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*[F.lit(s[0]) for s in _SAMPLES]), k), F.lit("\n")).alias("t"), F.when(F.col("p_partkey") % 7 == 0, "NFE").when(F.col("p_partkey") % 7 == 1, "auto").alias("hint"))
    c = classify.classified(F.col("t"), F.col("hint"))
    return t.select("p_partkey", c.alias("c")).select("p_partkey", "c.category", "c.subtype", "c.confidence")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, segment, content): an NF-e of each order; plain and wrapped, prefixed and default namespaces, some malformed."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey, "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # the orders can be one small file, and parsing costs far more than dealing them out
    base = F.concat(F.lpad(F.coalesce(F.col("o_custkey"), F.lit(0)).cast("string"), 8, "0"), F.lit("0001"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    amount = F.concat(F.expr("cast(cents div 100 as string)"), F.lit("."), F.expr("lpad(cast(cents % 100 as string), 2, '0')"))
    key = F.lpad(F.col("o_orderkey").cast("string"), 44, "0")
    body = F.concat(
        F.lit('<infNFe Id="NFe'), key, F.lit('"><ide><natOp>VENDA</natOp><mod>55</mod><serie>1</serie>'), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("<nNF>"), F.col("o_orderkey").cast("string"), F.lit("</nNF>"))).otherwise(""),
        F.lit("<dhEmi>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00-03:00</dhEmi><tpNF>"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("0"), F.lit("</tpNF></ide><emit><CNPJ>"), base, ids.cnpj_digits(base), F.lit("</CNPJ><xNome> Fornecedor "), F.col("o_custkey").cast("string"),
        F.lit(" </xNome><xFant>F</xFant><IE>123</IE><CRT>3</CRT><enderEmit><xLgr>Rua A</xLgr><nro>1</nro><xMun>Teresina</xMun><UF>PI</UF></enderEmit></emit>"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("<dest><CPF>52998224725</CPF><xNome>Cliente</xNome></dest>")).otherwise(""),
        F.lit("<total><ICMSTot><vProd>"), amount, F.lit("</vProd><vNF>"), amount, F.lit("</vNF></ICMSTot></total></infNFe>"),
    )
    prefixed = F.regexp_replace(F.regexp_replace(body, "<(/?)([A-Za-z])", "<$1n:$2"), "^<n:infNFe", '<n:infNFe xmlns:n="http://www.portalfiscal.inf.br/nfe"')
    form = F.expr("(o_orderkey div 7) % 4")
    batch = F.concat(F.lit('<?xml version="1.0"?><enviNFe xmlns="http://www.portalfiscal.inf.br/nfe"><idLote>1</idLote><NFe>'), body, F.lit('</NFe><NFe><infNFe Id="NFe9"/></NFe></enviNFe>'))
    content = F.when(form == 3, batch).when(form == 0, F.concat(F.lit('<nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe>'), body, F.lit("</NFe></nfeProc>"))).when(form == 1, F.concat(F.lit('<NFe xmlns="http://www.portalfiscal.inf.br/nfe">'), body, F.lit("</NFe>"))).otherwise(F.concat(F.lit('<n:NFe xmlns:n="http://www.portalfiscal.inf.br/nfe">'), prefixed, F.lit("</n:NFe>")))
    spoilt = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("<NFe><infNFe>"), key)).otherwise(content)
    return t.withColumn("cents", cents).select("o_orderkey", F.col("c_mktsegment").alias("segment"), spoilt.alias("content"))


def nfe_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = xml_fiscal.parsed(invoices(spark, sf_dir))
    return t.select("o_orderkey", "access_key", "fiscal_document_number", "direction", "issued_at", "issuer_name", "recipient_document", "total_fiscal_document", F.col("issuer_address.city").alias("issuer_city"), F.col("issuer_address.country").alias("issuer_country"), "error")


def nfe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("00", "20", "60"))), (F.col("l_partkey") % 3).cast("int") + 1)
    tax = F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("<imposto><ICMS><ICMS"), kind, F.lit("><CST>"), kind, F.lit("</CST><vICMS>1,50</vICMS></ICMS"), kind, F.lit("></ICMS></imposto>"))).otherwise("")
    item = F.concat(F.lit('<det nItem="'), F.col("l_linenumber").cast("string"), F.lit('"><prod><cProd>'), F.col("l_partkey").cast("string"), F.lit("</cProd><qCom>"), F.col("l_quantity").cast("string"), F.lit("</qCom><vProd>"), F.expr("concat(cast(cents div 100 as string), '.', lpad(cast(cents % 100 as string), 2, '0'))"), F.lit("</vProd></prod>"), tax, F.lit("</det>"))
    docs = t.withColumn("cents", cents).select("l_orderkey", item.alias("item")).groupBy("l_orderkey").agg(F.concat(F.lit("<NFe><infNFe>"), F.array_join(F.sort_array(F.collect_list("item")), ""), F.lit("</infNFe></NFe>")).alias("content"))
    x = xml_fiscal.parsed(docs).select("l_orderkey", F.explode("line_items").alias("x"))
    return x.select("l_orderkey", F.col("x.number").cast("long").alias("number"), "x.code", "x.quantity", "x.total_price", "x.cst", "x.icms_value")


def nfe_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = xml_fiscal.parsed(invoices(spark, sf_dir)).select("o_orderkey", F.explode("parties").alias("p"))
    return t.select("o_orderkey", "p.role", "p.document_type", F.substring("p.document", 1, 8).alias("root"), "p.name", "p.fancy_name", "p.ie")


def nfe_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, those that can't be read as errors."""
    t = quality.assessed(xml_fiscal.parsed(invoices(spark, sf_dir)))
    good = F.col("error").isNull()
    of = lambda c: F.when(good, F.array_join(c, ";")).otherwise("")
    return t.select("o_orderkey", F.coalesce("segment", F.lit("-")).alias("segment"), F.when(good, F.col("confidence")).alias("confidence"), of("missing_fields").alias("missing_fields"), of("warnings").alias("warnings"), F.when(good, F.col("status")).otherwise("error").alias("status"), "error")


def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nfe_quality(spark, sf_dir).rollup("segment", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("hundredths"))
    return t


def dedupe_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return cache.first_of_each(t, "doc_id", "text").select("doc_id", "cache_key", F.col("place").cast("long").alias("place"), "extraction_method")


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache that holds the texts of those with labels."""
    t = _table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = t.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(cache.key(F.col("text")).alias("cache_key")).withColumn("status", F.lit("success"))
    hits, misses = cache.probe(t, seen, "text")
    return hits.select("doc_id", "status").unionByName(misses.select("doc_id", F.lit("computed").alias("status")))


def issue_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    t = F.when(F.col("o_orderkey") % 9 == 0, F.lit("Emissao 31/02/2024 10:00")).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Data "), day, F.lit(" 09:31:05 fim"))).otherwise(F.concat(F.lit("Data "), day))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", F.date_format(dates.moment(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("issued_at"), dates.competence(F.col("t")).cast("string").alias("competence_at"))


#: Characters that become several letters, some outside of the first plane; and what they become.
_COMPOUND, _PLAIN = " ﬁscal ﬄuxo ㎏ ⑩ 𝐀𝟗 ½ № Ⅷ … ™ ĳ", " FISCAL FFLUXO KG 10 A9 12 NO VIII ... TM IJ"


def fold_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.col("text"), F.lit(_COMPOUND))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded(mixed).cast("binary")).alias("folded_md5"), F.right(text.folded(mixed), F.lit(36)).alias("tail"))


def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.markdown(F.col("text"), F.col("source")).cast("binary")).alias("markdown_md5"))


def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Cabeçalho\nPrestador do Serviço\nnome "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\nTomador do Serviço\nx")).otherwise("")).alias("t"))
    return o.select("o_orderkey", text.section(F.col("t"), ["PRESTADOR DO SERVICO", "DADOS DO PRESTADOR"], ["TOMADOR DO SERVICO", "DESTINATARIO"]).alias("section"))


_STATE = {"error": "FAILURE", "click": "STARTED", "view": "PENDING", "signup": "RETRY", "purchase": "SUCCESS"}


def _jobs(events: DataFrame) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in _STATE.items() for x in pair])[F.col("event_type")]
    return events.select("event_id", ingest.shown_state(state, F.when(F.col("event_id") % 2 == 0, "error").otherwise("success")).alias("state"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(_table(spark, sf_dir, "events"))


def job_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in _STATE.items() for x in pair])[F.col("event_type")]
    id_ = F.col("event_id").cast("string")
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"status": "error", "error_code": "E'), id_, F.lit('", "message": "m"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"status": "success", "n": '), id_, F.lit("}"))).otherwise("")
    r = ingest.job_response(state, payload)
    return _table(spark, sf_dir, "events").select("event_id", F.explode(F.array(r)).alias("r")).select("event_id", "r.*")


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ingest.stream_folder(spark)
    schema = _table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table can be a file or a folder
    return ingest.run_available(spark, source, _jobs, f"{at}/out", f"{at}/state")


QUERIES = [money_text_cents, money_payload_cents, money_literal_scan, tax_ids_valid, access_key_valid, sniff_and_gate, classify_documents, nfe_header, nfe_items, nfe_quality, quality_rollup, dedupe_sha256, cache_probe, issue_dates, fold_upper, markdown_render, section_slice, job_states, stream_job_states, nfe_parties, job_responses, *services.QUERIES, *records.QUERIES, *streams.QUERIES, *reports.QUERIES]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_HEADING = "[A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 ,.:;/()\\-—+%R$°ºª''\"]{6,}"


def oracle_sql() -> dict[str, str]:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    case = lambda k, values: f"CASE {k} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"
    sample = lambda i: case(f"p_partkey % {len(_SAMPLES)}", [s[i] for s in _SAMPLES])
    hinted = f"p_partkey % 7 = 0 AND p_partkey % {len(_SAMPLES)} <> {len(_SAMPLES) - 1}"
    segment = "coalesce(c_mktsegment, '-')"
    assessed = f"""SELECT o_orderkey, {segment} AS segment, CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 13 ELSE 0 END AS gone FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
    judged = f"""SELECT o_orderkey, segment, CASE WHEN o_orderkey % 11 <> 0 THEN (81 - gone) / 100.0::DOUBLE END AS confidence, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0 THEN 'fiscal_document_number' ELSE '' END AS missing_fields, '' AS warnings,
 CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 4 = 0 THEN 'error' WHEN 81 - gone < 70 THEN 'partial' ELSE 'success' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'PARSE_FAILED' END AS error FROM ({assessed})"""
    states = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'succeeded' END ELSE 'queued' END"
    cents = f"({_CENTS})"
    bad = "o_orderkey % 11 = 0"
    return {
        "money_text_cents": f"SELECT l_orderkey, l_linenumber, {cents} AS br, {cents} AS us, {cents} AS bare, CAST(NULL AS BIGINT) AS junk FROM lineitem",
        "money_payload_cents": f"""SELECT l_orderkey, l_linenumber, c AS br, c AS bare, CASE WHEN c < 100000 THEN c WHEN c < 100000000 THEN (c // 100000) * 100 + CAST(round_even((c % 100000) / 1000.0, 0) AS BIGINT) END AS us
 FROM (SELECT l_orderkey, l_linenumber, {cents} AS c FROM lineitem)""",
        "money_literal_scan": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?:R\\$\\s*)?(\\d{1,3}(?:[.,]\\d{3})*[.,]\\d{2})')) AS BIGINT) AS n_literals FROM documents",
        "tax_ids_valid": "SELECT c_custkey, c_custkey % 5 <> 0 AS cnpj_ok, c_custkey % 7 <> 0 AS cpf_ok, c_custkey % 5 <> 0 AS document_ok, k[1:2] || '.' || k[3:5] || '.' || k[6:8] || '/0001' AS cnpj_root FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k FROM customer)",
        "access_key_valid": "SELECT o_orderkey, o_orderkey % 3 <> 0 AS key_ok FROM orders",
        "sniff_and_gate": f"""SELECT page_id, {case('page_id % 8', ['application/pdf', 'image/jpeg', 'image/png', 'image/webp', files.DOCX, 'application/xml', 'application/octet-stream', 'application/pdf'])} AS mime,
 {case('page_id % 8', ['pdf', 'image', 'image', 'image', 'docx', 'xml', 'unknown', 'pdf'])} AS category, {case('page_id % 8', [None] * 6 + ['UNSUPPORTED_FILE_TYPE', 'EMPTY_FILE'])} AS error FROM pages""",
        "classify_documents": f"SELECT p_partkey, CASE WHEN {hinted} THEN 'nfe' ELSE {sample(1)} END AS category, CASE WHEN {hinted} THEN 'NFE' ELSE {sample(2)} END AS subtype, CAST(CASE WHEN {hinted} THEN 0.85 ELSE {sample(3)} END AS DOUBLE) AS confidence FROM part",
        "nfe_header": f"""SELECT o_orderkey, CASE WHEN {bad} THEN NULL ELSE lpad(CAST(o_orderkey AS VARCHAR), 44, '0') END AS access_key, CASE WHEN {bad} OR o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS fiscal_document_number,
 CASE WHEN {bad} THEN NULL WHEN o_orderkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, CASE WHEN {bad} THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00-03:00' END AS issued_at, CASE WHEN {bad} THEN NULL ELSE 'Fornecedor ' || o_custkey END AS issuer_name,
 CASE WHEN {bad} OR o_orderkey % 5 = 0 THEN NULL ELSE '52998224725' END AS recipient_document, CASE WHEN {bad} THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS total_fiscal_document, CASE WHEN {bad} THEN NULL ELSE 'Teresina' END AS issuer_city, CASE WHEN {bad} THEN NULL ELSE 'BRASIL' END AS issuer_country, CASE WHEN {bad} THEN 'PARSE_FAILED' END AS error FROM orders""",
        "nfe_items": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS number, CAST(l_partkey AS VARCHAR) AS code, l_quantity AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_price, CASE WHEN l_partkey % 5 <> 0 THEN CASE l_partkey % 3 WHEN 0 THEN '00' WHEN 1 THEN '20' END END AS cst, CASE WHEN l_partkey % 5 <> 0 AND l_partkey % 3 <> 2 THEN 150 END AS icms_value FROM lineitem",
        "nfe_quality": judged,
        "quality_rollup": f"SELECT segment, status, count(*) AS n, CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM ({judged}) GROUP BY ROLLUP (segment, status)",
        "dedupe_sha256": "SELECT doc_id, k AS cache_key, n AS place, CASE WHEN n > 1 THEN 'cache' ELSE 'computed' END AS extraction_method FROM (SELECT doc_id, sha256(text) AS k, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)",
        "cache_probe": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)) THEN 'success' ELSE 'computed' END AS status FROM documents",
        "issue_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:31:05' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS issued_at, CASE WHEN o_orderkey % 9 = 0 THEN '2024-02-01' ELSE strftime(o_orderdate, '%Y-%m') || '-01' END AS competence_at FROM orders",
        "fold_upper": f"SELECT doc_id, md5(f) AS folded_md5, right(f, 36) AS tail FROM (SELECT doc_id, regexp_replace(upper(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g') || '{_PLAIN}' AS f FROM documents)",
        "nfe_parties": """SELECT o_orderkey, 'issuer' AS role, 'cnpj' AS document_type, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS root, 'Fornecedor ' || o_custkey AS name, 'F' AS fancy_name, '123' AS ie FROM orders WHERE o_orderkey % 11 <> 0
 UNION ALL SELECT o_orderkey, 'recipient', 'cpf', '52998224', 'Cliente', NULL, NULL FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0""",
        "markdown_render": f"""SELECT doc_id, md5(CASE WHEN coalesce(text, '') = '' THEN coalesce(source, '') ELSE regexp_replace(head || body, '\\n+$', '') || chr(10) END) AS markdown_md5
 FROM (SELECT doc_id, text, source, CASE WHEN coalesce(source, '') <> '' THEN '# ' || trim(source) || chr(10) || chr(10) ELSE '' END AS head,
 regexp_replace(regexp_replace(array_to_string(list_transform(list_transform(string_split_regex(text, '{_ENDS}'), lambda x: regexp_replace(x, '{_SPACE}+$', '')), lambda x: CASE WHEN regexp_full_match(regexp_replace(x, '^{_SPACE}+', ''), '{_HEADING}') AND len(regexp_extract_all(x, '[^ ]+')) BETWEEN 3 AND 10 THEN '## ' || regexp_replace(x, '^{_SPACE}+', '') ELSE x END), chr(10)), '^\\n+', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM documents)""",
        "section_slice": "SELECT o_orderkey, 'Prestador do Serviço' || chr(10) || 'nome ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END AS section FROM orders",
        "job_states": f"SELECT event_id, {states} AS state FROM events",
        "job_responses": """SELECT event_id, CASE WHEN s = 'FAILURE' THEN 'failed' WHEN s = 'SUCCESS' THEN CASE WHEN k = 0 THEN 'failed' ELSE 'succeeded' END WHEN s IN ('STARTED', 'RETRY') THEN 'processing' ELSE 'queued' END AS state,
 CASE WHEN s = 'FAILURE' THEN 'TASK_FAILED' WHEN s = 'SUCCESS' AND k = 0 THEN 'E' || event_id END AS error_code, CASE WHEN s = 'FAILURE' THEN CASE WHEN p = '' THEN 'Task failed' ELSE p END WHEN s = 'SUCCESS' AND k = 0 THEN 'm' END AS message, CASE WHEN s = 'SUCCESS' AND k = 1 THEN p END AS result
 FROM (SELECT event_id, event_id % 3 AS k, CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'click' THEN 'STARTED' WHEN 'view' THEN 'PENDING' WHEN 'signup' THEN 'RETRY' WHEN 'purchase' THEN 'SUCCESS' END AS s,
 CASE event_id % 3 WHEN 0 THEN '{"status": "error", "error_code": "E' || event_id || '", "message": "m"}' WHEN 1 THEN '{"status": "success", "n": ' || event_id || '}' ELSE '' END AS p FROM events)""",
        "stream_job_states": f"SELECT event_id, {states} AS state FROM events",
        **services.oracle_sql(),
        **records.oracle_sql(),
        **streams.oracle_sql(),
        **reports.oracle_sql(),
    }
