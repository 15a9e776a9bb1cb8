"""Brazilian tax numbers and access keys: check digits by modulo 11.

A number is bound once by a lambda and its digits are summed by an aggregate, so that an expression's size
doesn't grow with its argument's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import digits, once, unless_empty

# The shapes of numbers in a text.
CNPJ = "\\b\\d{2}[.\\s]?\\d{3}[.\\s]?\\d{3}[/\\s]?\\d{4}[-\\s]?\\d{2}\\b"
CPF = "\\b\\d{3}[.\\s]?\\d{3}[.\\s]?\\d{3}[-\\s]?\\d{2}\\b"
CEP = "\\b\\d{5}[-\\s]?\\d{3}\\b"
ACCESS_KEY = "\\b\\d{4}(?:[\\s.]?\\d{4}){10}\\b"
PHONE = "\\(?(\\d{2})\\)?\\s*\\d{4,5}[-\\s]?\\d{4}"
NUMBER_SERIES = "\\b(\\d{1,9})\\s*[/\\-]\\s*([A-Z0-9]{1,3})\\b"
CNAE = "\\b\\d{4}[-\\s]?\\d[/\\s]?\\d{2}[-\\s]?\\d{2}\\b"
STATE = "\\b([A-Z]{2})\\b"
SERVICE_CODE = "\\b\\d{2}[.,]\\d{2}\\b"
# The codes of states.
STATES = ("AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or its group; null if there is none."""
    # Where no digit is, a boundary needn't be looked for, which takes longer than anything else.
    first = "(?=\\d)" if re.match(r"\\b\(?\\d", pattern) else ""
    return unless_empty(F.regexp_extract(c, f"(?Ud){first}{pattern}", group))


def weighted(d: Column, weights: list[int]) -> Column:
    """The sum of the first digits times their weights."""
    parts = F.zip_with(F.slice(F.split(d, ""), 1, len(weights)), F.array(*map(F.lit, weights)), lambda x, w: x.try_cast("int") * w)
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x)


def _digit(total: Column) -> Column:
    """11 less the remainder; 10 and 11 are 0."""
    return (F.lit(11) - total % 11) % 11 % 10


def _two_digits(base: Column, first: list[int], second: list[int]) -> Column:
    """Two check digits; the second's weights are for the base, and the first digit's weight is 2."""
    return once(base, lambda b: once(_digit(weighted(b, first)), lambda a: F.concat(a.cast("string"), _digit(weighted(b, second) + 2 * a).cast("string"))))


def cnpj_digits(base: Column) -> Column:
    """The two check digits of the first twelve digits."""
    return _two_digits(base, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3])


def cpf_digits(base: Column) -> Column:
    """The two check digits of the first nine digits."""
    return _two_digits(base, list(range(10, 1, -1)), list(range(11, 2, -1)))


def _varied(d: Column) -> Column:
    return ~d.rlike("^(.)\\1*$")


def _cnpj_holds(d: Column) -> Column:
    return F.when((F.length(d) == 14) & _varied(d), F.substring(d, 13, 2) == cnpj_digits(F.substring(d, 1, 12))).otherwise(False)


def _cpf_holds(d: Column) -> Column:
    return F.when((F.length(d) == 11) & _varied(d), F.substring(d, 10, 2) == cpf_digits(F.substring(d, 1, 9))).otherwise(False)


def valid_cnpj(c: Column) -> Column:
    return once(digits(c), _cnpj_holds)


def valid_cpf(c: Column) -> Column:
    return once(digits(c), _cpf_holds)


def valid_document(c: Column) -> Column:
    """A number of 14 digits as CNPJ, of 11 as CPF, others not."""
    return once(digits(c), lambda d: F.when(F.length(d) == 14, _cnpj_holds(d)).otherwise(_cpf_holds(d)))


def key_digit(base: Column) -> Column:
    """The check digit of an access key's first 43 digits: weights 2 to 9 from the right, over and over."""
    return _digit(weighted(base, [(42 - k) % 8 + 2 for k in range(43)]))


def valid_access_key(c: Column) -> Column:
    return once(digits(c), lambda d: F.when(F.length(d) == 44, F.substring(d, 44, 1) == key_digit(d).cast("string")).otherwise(False))


def format_cnpj(c: Column) -> Column:
    return F.regexp_replace(digits(c), "^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$", "$1.$2.$3/$4-$5")


def format_cpf(c: Column) -> Column:
    return F.regexp_replace(digits(c), "^(\\d{3})(\\d{3})(\\d{3})(\\d{2})$", "$1.$2.$3-$4")


def first_cnpj(c: Column) -> Column:
    """The first CNPJ of a text, formatted; null if there is none."""
    return once(found(c, CNPJ), lambda x: F.when(x.isNotNull(), format_cnpj(x)))


def first_document(c: Column) -> Column:
    """The first CNPJ of a text, else its first CPF, formatted; null if there is none."""
    return F.coalesce(first_cnpj(c), once(found(c, CPF), lambda x: F.when(x.isNotNull(), format_cpf(x))))


def is_state(c: Column) -> Column:
    return F.coalesce(c.isin(*STATES), F.lit(False))


def _each(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?Ud){pattern}"), F.lit(group))


def access_keys(c: Column) -> Column:
    """The digits of all access keys of a text that have the right check digit, in order."""
    return F.filter(F.transform(_each(c, ACCESS_KEY), digits), valid_access_key)


def phones(c: Column) -> Column:
    """The digits of all telephone numbers with an area code, in order."""
    return F.transform(_each(c, PHONE), digits)


def numbers_with_series(c: Column) -> Column:
    """All places of the form number/series, as structs<number, series>, numbers without leading zeros."""
    pair = lambda k: _each(c, NUMBER_SERIES, k)
    return F.zip_with(pair(1), pair(2), lambda n, s: F.struct(n.try_cast("long").alias("number"), s.alias("series")))


def states(c: Column) -> Column:
    """The codes of states among a text's words of two capitals, in order, each as often as it occurs."""
    return F.filter(_each(c, STATE, 1), is_state)
