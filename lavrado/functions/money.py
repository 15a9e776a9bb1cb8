"""Money literals to integer cents: three notations that are kept apart, as they disagree on mixed separators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import once

#: A plain decimal number.
NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
#: A money literal in a text; no boundary on its left.
LITERAL = "(?:R\\$\\s*)?(\\d{1,3}(?:[.,]\\d{3})*[.,]\\d{2})"


def _cents(plain: Column) -> Column:
    """Half-even; null unless a plain decimal number whose cents fit into 64 bits."""
    return once(plain, lambda p: F.when(p.rlike(NUMBER), F.rint(p.try_cast("double") * 100).try_cast("long")))


def cents_text(c: Column) -> Column:
    """From text layouts: of two kinds of separators the last is decimal; a comma alone is decimal; a point alone is too."""

    def plain(x: Column) -> Column:
        point_last = F.contains(x, F.lit(".")) & F.contains(F.substring_index(x, ",", -1), F.lit("."))
        pointed = F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(~F.contains(x, F.lit(",")), x).when(point_last, F.replace(x, F.lit(","), F.lit(""))).otherwise(pointed)

    return _cents(once(F.regexp_replace(F.replace(c, F.lit("R$"), F.lit("")), "\\s+", ""), plain))


def cents_payload(c: Column) -> Column:
    """From strings of a payload: with both separators, points are always thousands.  Half-even; null unless a plain
    decimal number whose cents fit into 64 bits."""
    return once(c, cents_payload_column)


def cents_payload_column(c: Column) -> Column:
    """cents_payload of a column that is there: without a lambda, so it is compiled, but c is read several times."""
    kept = lambda mark: F.regexp_replace(c, f"[^0-9{mark}-]", "")
    plain = F.when(F.contains(c, F.lit(",")), F.replace(kept(","), F.lit(","), F.lit("."))).otherwise(kept("."))
    return F.when(c.rlike("[0-9]"), F.bround(plain.try_cast("decimal(30,8)") * 100, 0).try_cast("long"))  # of digits, points and - a number is what casts


def cents_number(c: Column) -> Column:
    """From numbers of a payload, which are reais (whole numbers of a payload are cents already)."""
    return F.rint(c.cast("double") * 100).try_cast("long")


def cents_xml(c: Column) -> Column:
    """From XML: a comma is a point, two points are no number."""
    return _cents(F.replace(F.trim(c), F.lit(","), F.lit(".")))


def literals(c: Column) -> Column:
    """The cents of all money literals of a text, in order; those that are no number are null."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LITERAL), F.lit(1)), cents_text)


def largest(c: Column) -> Column:
    return F.array_max(F.filter(literals(c), lambda x: x.isNotNull()))


def _variant_sql() -> str:
    plain = "CASE WHEN contains(s, ',') AND contains(s, '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '.') END"
    text = f"transform(transform(array(regexp_replace(try_variant_get(x, '$', 'string'), '[^0-9,.-]', '')), s -> {plain}), p -> CASE WHEN p RLIKE '{NUMBER}' THEN try_cast(bround(try_cast(p AS decimal(30, 8)) * 100, 0) AS bigint) END)[0]"
    real = "k LIKE 'DECIMAL%' OR k IN ('DOUBLE', 'FLOAT')"
    value = f"CASE WHEN k IN ('BIGINT', 'BOOLEAN') THEN try_variant_get(x, '$', 'bigint') WHEN {real} THEN try_cast(rint(try_variant_get(x, '$', 'double') * 100) AS bigint) WHEN k = 'STRING' THEN {text} END"
    return f"x -> transform(array(schema_of_variant(x)), k -> {value})[0]"


def cents_variant_sql(x: str) -> str:
    """SQL of cents_variant, of SQL of a VARIANT."""
    return f"transform(array({x}), {_variant_sql()})[0]"


def cents_variant(v: Column) -> Column:
    """From a value of a JSON payload: whole numbers (and booleans) are cents already, other numbers are reais,
    strings are read as cents_payload reads them; anything else is null."""
    return once(v, cents_field)


def cents_field(v: Column) -> Column:
    """cents_variant of what is cheap to read, such as a bound struct's field: kind and text are told once, and only of what is there."""
    given = lambda kind: F.when(kind == "STRING", once(F.try_variant_get(v, "$", "string"), cents_payload_column)).otherwise(_cents_of_number(v, kind))
    return F.when(v.isNotNull(), once(F.schema_of_variant(v), given))


def cents_field_column(v: Column) -> Column:
    """cents_field of a column's field: but for texts without a lambda, so it is compiled, and the kind is told several times."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNotNull(), F.when(kind == "STRING", once(F.try_variant_get(v, "$", "string"), cents_payload_column)).otherwise(_cents_of_number(v, kind)))


def _cents_of_number(v: Column, kind: Column) -> Column:
    """Of a value of a payload that is no string; kind: its schema_of_variant()."""
    real = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT")
    return F.when(kind.isin("BIGINT", "BOOLEAN"), F.try_variant_get(v, "$", "bigint")).when(real, cents_number(F.try_variant_get(v, "$", "double")))
