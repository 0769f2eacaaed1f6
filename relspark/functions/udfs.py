"""The few functions without a built-in form, as Arrow-batched UDFs."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf

from . import jsonvalue as jv

_SPEC = re.compile(r"%([-+ 0#]*)(\d*)(?:\.(\d+))?([%a-zA-Z])")


def _number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.0


def printf(fmt, args):
    if fmt is None:
        return None
    left = iter(args or [])

    def one(m: re.Match) -> str:
        flags, width, digits, spec = m.groups()
        if spec == "%":
            return "%"
        arg = next(left, None)
        how = f"%{flags}{width}" + (f".{digits}" if digits else "")
        if spec in "diu":
            return f"{how}d" % int(_number(arg))
        if spec in "oxX":
            return f"{how}{spec}" % int(_number(arg))
        if spec in "eEfgG":
            return f"{how}{spec}" % _number(arg)
        if spec in "qQ":
            if arg is None:
                return "NULL" if spec == "Q" else "(NULL)"
            text = str(arg).replace("'", "''")
            return f"'{text}'" if spec == "Q" else text
        return f"{how}s" % ("" if arg is None else arg)

    return _SPEC.sub(one, fmt)


def _json(x):
    v = jv.loads(x)
    return None if jv.missing(v) else jv.dumps(v)


def _json_quote(x, kind):
    return jv.dumps(jv.typed(x, kind))


def _json_type(x, path):
    v, p = jv.loads(x), jv.steps(path or "")
    if x is None or jv.missing(v) or p is None:
        return None
    return jv.kind(jv.find(v, p))


def _json_extract(x, paths):
    v = jv.loads(x)
    if jv.missing(v):
        return None
    got = []
    for path in paths or []:
        p = jv.steps(path or "")
        if p is None:
            return None
        e = jv.find(v, p)
        got.append(None if jv.missing(e) else e)
    if len(got) > 1:
        return jv.dumps(got)
    e = got[0] if got else None
    if e is None:
        return None
    if isinstance(e, bool):
        return "1" if e else "0"
    return e if isinstance(e, str) else jv.dumps(e)


def _json_array(values, kinds):
    return jv.dumps([jv.typed(v, k) for v, k in zip(values, kinds)])


def _json_object(values, kinds):
    if len(values) % 2 or any(k is None for k in values[::2]):
        return None
    return jv.dumps({k: jv.typed(v, t) for k, v, t in zip(values[::2], values[1::2], kinds[1::2])})


def _json_edit(mode, x, values, kinds):
    v = jv.loads(x)
    if jv.missing(v):
        return None
    if mode == "remove":
        for path in values:
            p = jv.steps(path or "")
            if p is None:
                return None
            v = jv.cut(v, p)
        return None if jv.missing(v) else jv.dumps(v)
    for path, new, kind in zip(values[::2], values[1::2], kinds[1::2]):
        p = jv.steps(path or "")
        if p is None:
            return None
        v = jv.put(v, p, jv.typed(new, kind), mode)
    return jv.dumps(v)


def _json_patch(a, b):
    x, y = jv.loads(a), jv.loads(b)
    return None if jv.missing(x) or jv.missing(y) else jv.dumps(jv.merge(x, y))


_ALL = {
    "rs_printf": printf,
    "rs_json": _json,
    "rs_json_quote": _json_quote,
    "rs_json_type": _json_type,
    "rs_json_extract": _json_extract,
    "rs_json_array": _json_array,
    "rs_json_object": _json_object,
    "rs_json_edit": _json_edit,
    "rs_json_patch": _json_patch,
}


class _JsonEach:
    """``json_each`` in FROM: the elements of one level."""

    deep = False

    def eval(self, text: str, path: str = "$"):
        from ..operators.tablefunc import json_rows

        yield from json_rows(text, path, self.deep)


class _JsonTree(_JsonEach):
    deep = True


def register(spark: SparkSession) -> None:
    from ..operators.tablefunc import SCHEMA

    spark.udtf.register("rs_json_each", udtf(_JsonEach, returnType=SCHEMA))
    spark.udtf.register("rs_json_tree", udtf(_JsonTree, returnType=SCHEMA))
    for name, f in _ALL.items():
        spark.udf.register(name, udf(f, "string", useArrow=True))
