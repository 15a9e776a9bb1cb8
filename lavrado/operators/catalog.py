"""The rules as functions of SQL: bodies in SQL, registered in a catalog and called from spark.sql.

A function's body may call functions before it in the list.  Spark expands calls when it analyses a query, so they
are planned and compiled as if they had been written out, and no Python runs on rows.  Functions give what the
Column functions of the same rules give; nulls do as there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import ids, money
from ..functions.text import LINE_END, translations
from . import classify, quality


def quoted(x: str) -> str:
    """A string as a literal of SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _summed(digits: str, weights: list[int]) -> str:
    """The sum of the first digits times their weights."""
    parts = f"zip_with(slice(split({digits}, ''), 1, {len(weights)}), array({', '.join(map(str, weights))}), (x, w) -> try_cast(x AS int) * w)"
    return f"aggregate({parts}, 0, (total, x) -> total + x)"


def _check(total: str) -> str:
    return f"(11 - ({total}) % 11) % 11 % 10"


def _found(pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract(t, {quoted('(?Ud)' + pattern)}, {group}), '')"


def _each(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(coalesce(t, ''), {quoted('(?Ud)' + pattern)}, {group})"


def scalars(p: str) -> list[tuple[str, str, str, str]]:
    """(name, parameters, type, body) of each scalar function; p is the prefix of all names."""
    single, plain, several = translations()
    other = quoted("[^\\x00-\\x7F]")
    rare = f"array_distinct(regexp_extract_all(s, {quoted('([^' + chr(92) + 'x00-' + chr(92) + 'x7F])')}, 1))"
    known = f"from_json({quoted(several)}, 'map<string,string>')"
    pairs = f"filter(transform({rare}, c -> named_struct('a', c, 'b', {known}[c])), q -> q.b IS NOT NULL)"
    rest = f"regexp_replace(aggregate({pairs}, s, (x, q) -> replace(x, q.a, q.b)), {quoted('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]+')}, '')"
    first12, first13 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    dots = "replace(replace(x, '.', ''), ',', '.')"
    cents = lambda x: f"CASE WHEN {x} RLIKE {quoted(money.NUMBER)} THEN try_cast(rint(try_cast({x} AS double) * 100) AS bigint) END"
    bare = f"regexp_replace(replace(t, 'R$', ''), {quoted('\\s+')}, '')"
    shown = f"CASE WHEN contains(x, ',') AND contains(x, '.') AND instr(reverse(x), ',') > instr(reverse(x), '.') THEN replace(x, ',', '') WHEN contains(x, ',') THEN {dots} ELSE x END"
    sent = f"CASE WHEN contains(x, ',') AND contains(x, '.') THEN {dots} ELSE replace(x, ',', '.') END"
    exact = f"CASE WHEN y RLIKE {quoted(money.NUMBER)} THEN try_cast(bround(try_cast(y AS decimal(30, 8)) * 100, 0) AS bigint) END"
    when = quoted("(\\d{2}/\\d{2}/\\d{4})\\s+(\\d{2}:\\d{2}(?::\\d{2})?)")
    time = f"regexp_extract(t, {when}, 2)"
    day = f"regexp_extract(t, {quoted('\\d{2}/\\d{2}/\\d{4}')}, 0)"
    month = f"regexp_extract(t, {quoted('\\b\\d{2}/\\d{4}\\b')}, 0)"
    varied = quoted("^(.)\\1*$")
    text = "t STRING"
    return [
        (f"{p}strip", text, "STRING", f"regexp_replace(t, {quoted('(?U)^[' + chr(92) + 's' + chr(0x1C) + '-' + chr(0x1F) + ']+|[' + chr(92) + 's' + chr(0x1C) + '-' + chr(0x1F) + ']+$')}, '')"),
        (f"{p}squeezed", text, "STRING", f"{p}strip(regexp_replace(t, {quoted('[ ' + chr(9) + chr(0xA0) + ']+')}, ' '))"),
        (f"{p}digits", text, "STRING", "regexp_replace(coalesce(t, ''), '[^0-9]', '')"),
        (f"{p}folded", text, "STRING", f"upper(CASE WHEN t RLIKE {other} THEN transform(array(translate(t, {quoted(single)}, {quoted(plain)})), s -> CASE WHEN s RLIKE {other} THEN {rest} ELSE s END)[0] ELSE t END)"),
        (f"{p}cnpj_digits", text, "STRING", f"transform(array({_check(_summed('t', first12))}), a -> concat(cast(a AS string), cast({_check(_summed('t', first13[:12]) + ' + 2 * a')} AS string)))[0]"),
        (f"{p}cpf_digits", text, "STRING", f"transform(array({_check(_summed('t', list(range(10, 1, -1))))}), a -> concat(cast(a AS string), cast({_check(_summed('t', list(range(11, 2, -1))) + ' + 2 * a')} AS string)))[0]"),
        (f"{p}key_digit", text, "INT", _check(_summed("t", [(42 - k) % 8 + 2 for k in range(43)]))),
        (f"{p}valid_cnpj", text, "BOOLEAN", f"CASE WHEN length({p}digits(t)) = 14 AND NOT {p}digits(t) RLIKE {varied} THEN right({p}digits(t), 2) = {p}cnpj_digits(left({p}digits(t), 12)) ELSE false END"),
        (f"{p}valid_cpf", text, "BOOLEAN", f"CASE WHEN length({p}digits(t)) = 11 AND NOT {p}digits(t) RLIKE {varied} THEN right({p}digits(t), 2) = {p}cpf_digits(left({p}digits(t), 9)) ELSE false END"),
        (f"{p}valid_document", text, "BOOLEAN", f"{p}valid_cnpj(t) OR {p}valid_cpf(t)"),
        (f"{p}valid_access_key", text, "BOOLEAN", f"CASE WHEN length({p}digits(t)) = 44 THEN right({p}digits(t), 1) = cast({p}key_digit({p}digits(t)) AS string) ELSE false END"),
        (f"{p}format_cnpj", text, "STRING", f"regexp_replace({p}digits(t), {quoted('^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$')}, '$1.$2.$3/$4-$5')"),
        (f"{p}format_cpf", text, "STRING", f"regexp_replace({p}digits(t), {quoted('^(\\d{3})(\\d{3})(\\d{3})(\\d{2})$')}, '$1.$2.$3-$4')"),
        (f"{p}first_cnpj", text, "STRING", f"CASE WHEN {_found(ids.CNPJ)} IS NOT NULL THEN {p}format_cnpj({_found(ids.CNPJ)}) END"),
        (f"{p}first_document", text, "STRING", f"coalesce({p}first_cnpj(t), CASE WHEN {_found(ids.CPF)} IS NOT NULL THEN {p}format_cpf({_found(ids.CPF)}) END)"),
        (f"{p}is_state", text, "BOOLEAN", f"coalesce(t IN ({', '.join(map(quoted, ids.STATES))}), false)"),
        (f"{p}cents_text", text, "BIGINT", f"transform(transform(array({bare}), x -> {shown}), y -> {cents('y')})[0]"),
        (f"{p}cents_payload", text, "BIGINT", f"CASE WHEN {p}strip(t) <> '' THEN transform(transform(array(regexp_replace(t, '[^0-9,.-]', '')), x -> {sent}), y -> {exact})[0] END"),
        (f"{p}cents_xml", text, "BIGINT", f"transform(array(replace(trim(t), ',', '.')), y -> {cents('y')})[0]"),
        (f"{p}cents_value", "v VARIANT", "BIGINT", money.cents_variant_sql("v")),
        (f"{p}moment", text, "TIMESTAMP_NTZ", f"cast(coalesce(try_to_timestamp(concat(regexp_extract(t, {when}, 1), ' ', {time}, CASE WHEN length({time}) = 5 THEN ':00' ELSE '' END), 'dd/MM/yyyy HH:mm:ss'), try_to_timestamp({day}, 'dd/MM/yyyy')) AS timestamp_ntz)"),
        (f"{p}competence", text, "DATE", f"CASE WHEN {month} <> '' THEN cast(try_to_timestamp(concat('01/', {month}), 'dd/MM/yyyy') AS date) END"),
        (f"{p}cache_key", "content BINARY", "STRING", "sha2(content, 256)"),
    ]


def _classifier(p: str) -> tuple[str, str, str, str]:
    made = lambda c, s, k: f"named_struct('category', {c}, 'subtype', {s}, 'confidence', {k}D)"
    null = "cast(NULL AS string)"
    flags = "(?Uid)"
    rules = " ".join(f"WHEN {p}strip(t) RLIKE {quoted(flags + r)} THEN {made(quoted(c), quoted(s), 0.9)}" for c, s, r in classify.RULES)
    hints = ", ".join(map(quoted, classify.HINTS))
    body = f"CASE WHEN {p}strip(coalesce(t, '')) = '' THEN {made(quoted('other'), null, 0.0)} WHEN lower(hint) IN ({hints}) THEN {made('lower(hint)', 'hint', 0.85)} {rules} WHEN {p}strip(t) RLIKE {quoted(flags + classify.GENERIC)} THEN {made(quoted('invoice'), null, 0.4)} ELSE {made(quoted('other'), null, 0.0)} END"
    return (f"{p}classified", "t STRING, hint STRING DEFAULT NULL", "STRUCT<category: STRING, subtype: STRING, confidence: DOUBLE>", body)


def tables(p: str) -> list[tuple[str, str, str, str]]:
    """(name, parameters, columns, query) of each table function; places count from 1."""
    text = "t STRING"
    all_of = lambda pattern, group=0: f"(SELECT posexplode({_each(pattern, group)}) AS (k, x))"
    literals = f"(SELECT posexplode(regexp_extract_all(coalesce(t, ''), {quoted(money.LITERAL)}, 1)) AS (k, x))"
    cut = f"split(t, {quoted(LINE_END)})"
    kept = f"CASE WHEN t = '' THEN array() WHEN element_at({cut}, -1) = '' THEN slice({cut}, 1, size({cut}) - 1) ELSE {cut} END"
    values = lambda rows: "VALUES " + ", ".join("(" + ", ".join(x if x.isdigit() else quoted(x) for x in map(str, row)) + ")" for row in rows)
    required = [(c, k, f) for c, fields in quality.REQUIRED.items() for k, f in enumerate(fields, 1)]
    return [
        (f"{p}lines", text, "place INT, line STRING", f"SELECT k + 1, x FROM (SELECT posexplode({kept}) AS (k, x))"),
        (f"{p}amounts", text, "place INT, literal STRING, cents BIGINT", f"SELECT k + 1, x, {p}cents_text(x) FROM {literals}"),
        (f"{p}access_keys", text, "place INT, access_key STRING, valid BOOLEAN", f"SELECT k + 1, {p}digits(x), {p}valid_access_key(x) FROM {all_of(ids.ACCESS_KEY)}"),
        (f"{p}documents", text, "kind STRING, place INT, number STRING, valid BOOLEAN", f"SELECT 'cnpj', k + 1, {p}format_cnpj(x), {p}valid_cnpj(x) FROM {all_of(ids.CNPJ)} UNION ALL SELECT 'cpf', k + 1, {p}format_cpf(x), {p}valid_cpf(x) FROM {all_of(ids.CPF)}"),
        (f"{p}phones", text, "place INT, phone STRING", f"SELECT k + 1, {p}digits(x) FROM {all_of(ids.PHONE)}"),
        (f"{p}states", text, "place INT, state STRING", f"SELECT k + 1, x FROM {all_of(ids.STATE, 1)} WHERE {p}is_state(x)"),
        (f"{p}weights", "", "field STRING, weight INT", f"SELECT * FROM {values(quality.WEIGHTS.items())} AS v(field, weight)"),
        (f"{p}required", "of STRING", "place INT, field STRING", f"SELECT place, field FROM {values(required)} AS v(category, place, field) WHERE category = CASE WHEN of IN ({', '.join(map(quoted, quality.REQUIRED))}) THEN of ELSE 'other' END"),
        (f"{p}rules", "", "place INT, category STRING, subtype STRING, pattern STRING", f"SELECT * FROM {values((k, *r) for k, r in enumerate(classify.RULES, 1))} AS v(place, category, subtype, pattern)"),
    ]


def register(spark: SparkSession, prefix: str = "fiscal_", temporary: bool = True) -> list[str]:
    """Registers all functions, for the session or, not `temporary`, in the catalog for whoever uses it; gives their names.

    prefix: what all names start with; of functions in the catalog it has to name the schema too (`rules.fiscal_`), as they
    call one another wherever they are called from.  What was registered under these names is replaced.
    """
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    if not temporary and "." not in prefix:
        raise ValueError("the prefix of functions in the catalog names their schema")
    one = [*scalars(prefix), _classifier(prefix)]
    for name, parameters, type_, body in one:
        spark.sql(f"CREATE OR REPLACE {kind} {name}({parameters}) RETURNS {type_} RETURN {body}")
    several = tables(prefix)
    for name, parameters, columns, body in several:
        spark.sql(f"CREATE OR REPLACE {kind} {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return [f[0] for f in (*one, *several)]
