"""Scalar functions of the dialect as Spark SQL text: built-ins wherever they agree."""

from __future__ import annotations

from collections.abc import Callable

#: What TRIM strips by default: all ASCII white space.
_SPACES = r"' \t\n\r\f\u000b'"
_INTEGRAL = "('tinyint', 'smallint', 'int', 'bigint')"
_REAL = {"real", "float", "double", "numeric", "decimal"}
_WHOLE = {"integer", "int", "tinyint", "smallint", "mediumint", "bigint", "boolean", "bool"}


def _both_integral(a: str, b: str) -> str:
    return f"typeof({a}) IN {_INTEGRAL} AND typeof({b}) IN {_INTEGRAL}"


def divide(a: str, b: str) -> str:
    """Integers: the floor, exactly, as bigint; a real operand: the quotient as double; by zero: NULL.

    ``typeof`` folds to a constant; a variant holds either result, so neither is cast to the other's type.
    """
    kind = f"regexp_replace(regexp_replace(typeof({a} % {b}), '^(tiny|small|big)?int$', 'bigint'), '^(float|decimal.*)$', 'double')"
    whole = f"CAST(try_cast({a} AS BIGINT) div nullif(try_cast({b} AS BIGINT), 0) - CASE WHEN try_mod({a}, {b}) <> 0 AND ({a} < 0) <> ({b} < 0) THEN 1 ELSE 0 END AS VARIANT)"
    return f"variant_get(CASE WHEN {_both_integral(a, b)} THEN {whole} ELSE CAST(try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS VARIANT) END, '$', {kind})"


def modulo(a: str, b: str) -> str:
    """The remainder with the divisor's sign; by zero: NULL."""
    return f"(try_mod({a}, {b}) + CASE WHEN try_mod({a}, {b}) <> 0 AND (try_mod({a}, {b}) < 0) <> ({b} < 0) THEN {b} ELSE 0 END)"


def cast(x: str, kind: str) -> str:
    base = kind.split("(")[0].strip().lower()
    if base in _WHOLE:
        return f"CAST(try_cast({x} AS DOUBLE) AS BIGINT)"
    if base in _REAL:
        return f"try_cast({x} AS DOUBLE)"
    if base in {"blob", "bytes", "binary", "varbinary"}:
        return f"CAST({x} AS BINARY)"
    return f"CAST({x} AS STRING)"


def substr(s: str, start: str, size: str | None = None) -> str:
    s = f"CAST({s} AS STRING)"
    at = f"CAST(greatest({start}, -char_length({s})) AS INT)"
    return f"substring({s}, {at})" if size is None else f"substring({s}, {at}, CAST({size} AS INT))"


def _trim(side: str) -> Callable[..., str]:
    return lambda x, chars=_SPACES: f"trim({side} {chars} FROM CAST({x} AS STRING))"


def replace(s: str, a: str, b: str) -> str:
    return f"replace(CAST({s} AS STRING), coalesce(CAST({a} AS STRING), ''), coalesce(CAST({b} AS STRING), ''))"


def round_(x: str, digits: str | None = None) -> str:
    if digits is None or digits.strip() == "0":
        return f"CAST(rint(CAST({x} AS DOUBLE)) AS BIGINT)"
    return f"bround(CAST({x} AS DOUBLE), {digits})"


def typeof(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('boolean', 'tinyint', 'smallint', 'int', 'bigint') THEN 'integer' WHEN typeof({x}) IN ('double', 'float') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END"


FORMS: dict[str, Callable[..., str | None]] = {
    "/": divide,
    "mod": modulo,
    "cast": cast,
    "ifnull": lambda a, b: f"coalesce({a}, {b})",
    "nvl": lambda a, b: f"coalesce({a}, {b})",
    "upper": lambda x: f"upper(CAST({x} AS STRING))",
    "lower": lambda x: f"lower(CAST({x} AS STRING))",
    "length": lambda x: f"char_length(CAST({x} AS STRING))",
    "trim": _trim("BOTH"),
    "ltrim": _trim("LEADING"),
    "rtrim": _trim("TRAILING"),
    "substr": substr,
    "substring": substr,
    "replace": replace,
    "instr": lambda s, sub: f"coalesce(instr(CAST({s} AS STRING), CAST({sub} AS STRING)), 0)",
    "abs": lambda x: f"abs({x})",
    "round": round_,
    "ceil": lambda x: f"CAST(ceil({x}) AS BIGINT)",
    "ceiling": lambda x: f"CAST(ceil({x}) AS BIGINT)",
    "floor": lambda x: f"CAST(floor({x}) AS BIGINT)",
    "random": lambda: "xxhash64(uuid())",
    "randomblob": lambda n: f"substring(unhex(concat_ws('', transform(sequence(0, CAST({n} AS INT) DIV 16), i -> replace(uuid(), '-', '')))), 1, CAST({n} AS INT))",
    "typeof": typeof,
    "current_timestamp": lambda: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')",
    "current_date": lambda: "date_format(current_timestamp(), 'yyyy-MM-dd')",
    "current_time": lambda: "date_format(current_timestamp(), 'HH:mm:ss')",
    "printf": lambda fmt, *a: f"rs_printf({fmt}, array({', '.join(f'CAST({x} AS STRING)' for x in a)}))" if a else f"rs_printf({fmt}, CAST(array() AS ARRAY<STRING>))",
    "format": lambda fmt, *a: f"rs_printf({fmt}, array({', '.join(f'CAST({x} AS STRING)' for x in a)}))" if a else f"rs_printf({fmt}, CAST(array() AS ARRAY<STRING>))",
    "json": lambda x: f"rs_json({x})",
    "json_valid": lambda x: f"CASE WHEN try_parse_json(CAST({x} AS STRING)) IS NOT NULL AND trim(CAST({x} AS STRING)) <> 'null' THEN 1 ELSE 0 END",
    "json_quote": lambda x: f"rs_json_quote(CAST({x} AS STRING), typeof({x}))",
    "json_type": lambda x, p="'$'": f"rs_json_type({x}, {p})",
    "json_extract": lambda x, *p: f"get_json_object({x}, {p[0]})" if len(p) == 1 else f"rs_json_extract({x}, array({', '.join(p)}))",
    "json_array": lambda *a: f"rs_json_array(array({', '.join(f'CAST({x} AS STRING)' for x in a)}), array({', '.join(f'typeof({x})' for x in a)}))" if a else "'[]'",
    "json_object": lambda *a: f"rs_json_object(array({', '.join(f'CAST({x} AS STRING)' for x in a)}), array({', '.join(f'typeof({x})' for x in a)}))" if a else "'{}'",
    **{
        f"json_{k}": (lambda k: lambda x, *a: f"rs_json_edit('{k}', {x}, array({', '.join(f'CAST({y} AS STRING)' for y in a)}), array({', '.join(f'typeof({y})' for y in a)}))")(k)
        for k in ("set", "insert", "replace", "remove")
    },
    "json_patch": lambda a, b: f"rs_json_patch({a}, {b})",
    "json_array_length": lambda x, p="'$'": f"json_array_length(get_json_object({x}, {p}))",
}
