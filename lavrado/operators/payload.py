"""The record that every extractor gives: one struct of plain fields, amounts in cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .typed import Cents, Day, Field, Kind, Moment, Number, OneOf, Open, Struct, Text, Truth, Whole, many

_TEXT, _CENTS, _DAY = Text(), Cents(), Day()


def _all(kind: Kind, names: str) -> dict[str, Kind]:
    return dict.fromkeys(names.split(), kind)


# Names, kinds and enumerated values of a record's fields, and of what is inside.
CATEGORIES = ("nfe", "nfse", "nfce", "cte", "nf3e", "utility_water", "utility_electricity", "utility_gas", "utility_telecom", "rental_invoice", "boleto", "invoice", "receipt", "other")
ROLES = ("issuer", "recipient", "provider", "customer", "payer", "beneficiary", "intermediary")
WITHHELD = ("iss", "irrf", "inss", "pis", "cofins", "csll", "ipi", "icms", "icms_st", "other")
AMOUNTS = (
    "total_services", "subtotal", "total_fiscal_document", "fiscal_document_net_value", "total_discount", "total_products", "total_freight",
    "iss_value", "pis_value", "cofins_value", "inss_value", "irrf_value", "csll_value", "icms_value", "icms_st_value", "ipi_value",
)
PLACE = Struct(**_all(_TEXT, "street number complement neighborhood city state"), country=Field(_TEXT, default="'BRASIL'"), zip=_TEXT, block=_TEXT)
PARTY = Struct(role=Field(OneOf(*ROLES), needed=True, null=False), document_type=OneOf("cnpj", "cpf"), **_all(_TEXT, "document name fancy_name ie im email phone"), address=PLACE)
ITEM = Struct(
    number=Field(Whole(), key="line_number"), **_all(_TEXT, "code description ncm cfop unit"), quantity=Number(), unit_price=_CENTS, total_price=_CENTS, cst=_TEXT, icms_base=_CENTS, icms_value=_CENTS,
    discount=_CENTS, service_code=_TEXT, tax_rate=Number(), ipi_value=_CENTS,
)
WITHHOLDING = Struct(type=Field(OneOf(*WITHHELD), needed=True, null=False), base=_CENTS, rate=Number(), amount=_CENTS, retained_by=OneOf("issuer", "recipient"), description=_TEXT)
TAX = Struct(type=Field(_TEXT, needed=True, null=False), base=_CENTS, rate=Number(), amount=_CENTS)
PAYMENT = Struct(
    has_boleto=Truth(), has_pix=Truth(), **_all(_TEXT, "barcode digitable_line pix_code"), due_date=_DAY, **_all(_TEXT, "bank bank_code agency account beneficiary_code our_number document_number"),
    total_amount=_CENTS, installment_number=Whole(), installments_total=Whole(), auto_debit_code=_TEXT,
)
CONSUMPTION = Struct(unit=_TEXT, **_all(Number(), "current_reading previous_reading consumption"), **_all(_TEXT, "meter_id supply_code customer_code tariff_group"))
BILLING = Struct(reference_month=_TEXT, **_all(_DAY, "start_date end_date issue_date presentation_date next_reading_date"))
FISCAL = Open(
    **_all(_TEXT, "issqn_exigibility issqn_municipality issqn_responsible issqn_retention"), simples_nacional=Truth(), **_all(_TEXT, "special_tax_regime cnae service_code verification_code rps_number rps_series national_identifier service_municipality"),
    approximate_taxes=_CENTS, approximate_taxes_rate=Number(),
)
RECORD = Struct(
    document_category=Field(OneOf(*CATEGORIES), null=False, default="'other'"), **_all(_TEXT, "document_subtype access_key fiscal_document_number series model nature_operation"),
    type=OneOf("entrada", "saida"), direction=OneOf("inbound", "outbound"), origin=OneOf("pdf_upload", "xml_upload", "manual", "image_upload", "docx_upload"), document_status=Field(OneOf("authorized", "cancelled", "denied", "pending", "paid", "open"), key="status"),
    issued_at=Moment(), competence_at=_DAY, due_at=_DAY, **_all(_TEXT, "issuer_cnpj issuer_name issuer_fancy_name issuer_ie issuer_crt"), issuer_address=PLACE, **_all(_TEXT, "recipient_document recipient_name recipient_ie"), recipient_address=PLACE,
    **dict.fromkeys(AMOUNTS, _CENTS), additional_info=_TEXT, line_items=many(ITEM), parties=many(PARTY), fiscal_info=FISCAL,
    installments_count=Whole(), **_all(_TEXT, "contract_number customer_code purchase_order"), withholdings=many(WITHHOLDING), taxes=many(TAX), payment=PAYMENT, consumption=CONSUMPTION, billing=BILLING,
)
ADDRESS = {k: f.kind.ddl for k, f in PLACE.fields.items()}
#: Name and type of each field.
FIELDS = {k: f.kind.ddl for k, f in RECORD.fields.items()}
SCHEMA = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def address(**fields: Column) -> Column:
    """An address; the country is BRASIL unless it is told."""
    told = {"country": F.lit("BRASIL"), **fields}
    return F.struct(*[(told[k] if k in told else F.lit(None)).cast("string").alias(k) for k in ADDRESS])


def record(fiscal_info: dict[str, Column] | None = None, **fields: Column) -> Column:
    """A record of some fields; unless they are told, those that every service invoice has alike.  Entries of
    fiscal_info that are null are left out."""
    told = {"document_category": F.lit("nfse"), "model": F.lit("99"), "type": F.lit("saida"), "direction": F.lit("outbound"), **fields}
    if fiscal_info:
        pairs = F.map_from_arrays(F.array(*map(F.lit, fiscal_info)), F.array(*[v.cast("string") for v in fiscal_info.values()]))
        told["fiscal_info"] = F.map_filter(pairs, lambda k, v: v.isNotNull())
    return F.struct(*[(told[k] if k in told else F.lit(None)).cast(kind).alias(k) for k, kind in FIELDS.items()])


def inner(of: Struct, **fields: Column) -> Column:
    """An item, a party or the like with some fields; the others are null."""
    return F.struct(*[(fields[k] if k in fields else F.lit(None)).cast(f.kind.ddl).alias(k) for k, f in of.fields.items()])


def bound(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once for each row: explode() of one element keeps the optimizer from copying
    its expression into every expression and filter that reads it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def own(operator: str, name: str) -> str:
    """A name for a column that an operator adds and drops again, apart from a caller's names.  (A caller's columns
    aren't packed into a struct instead: Spark loses track of one that is cut apart above an explode().)"""
    return f"_lavrado_{operator}_{name}"
