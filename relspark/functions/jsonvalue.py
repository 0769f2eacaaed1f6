"""JSON values and paths ($, .key, ."quoted key", [n]) for what Spark's built-ins can't express."""

from __future__ import annotations

import json
import re

_STEP = re.compile(r'\.("(?:[^"\\]|\\.)*"|[^.\[]+)|\[(\d+)\]')
_MISSING = object()


def loads(text):
    if text is None:
        return _MISSING
    try:
        return json.loads(text)
    except (ValueError, TypeError):
        return _MISSING


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def steps(path: str) -> list | None:
    if not path or path[0] != "$":
        return None
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        out.append(int(m[2]) if m[2] is not None else m[1].strip('"'))
        at = m.end()
    return out


def find(value, path: list):
    for s in path:
        if isinstance(s, int) and isinstance(value, list) and s < len(value):
            value = value[s]
        elif isinstance(s, str) and isinstance(value, dict) and s in value:
            value = value[s]
        else:
            return _MISSING
    return value


def missing(value) -> bool:
    return value is _MISSING


def kind(value) -> str:
    if value is _MISSING or value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    for t, name in ((int, "integer"), (float, "real"), (list, "array"), (dict, "object")):
        if isinstance(value, t):
            return name
    return "text"


def typed(text, spark_type: str):
    """An SQL argument, passed as text and its Spark type, as a JSON value."""
    if text is None:
        return None
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return int(text)
    if spark_type in ("double", "float") or spark_type.startswith("decimal"):
        return float(text)
    if spark_type == "boolean":
        return text == "true"
    return text


def put(value, path: list, new, mode: str):
    """``value`` with ``new`` at the path; mode is set, insert (only where absent) or replace (only where present)."""
    if not path:
        return new if mode != "insert" else value
    head, rest = path[0], path[1:]
    if isinstance(head, str) and isinstance(value, dict):
        if head in value:
            return {k: (put(v, rest, new, mode) if rest else (v if mode == "insert" else new)) if k == head else v for k, v in value.items()}
        return value if rest or mode == "replace" else {**value, head: new}
    if isinstance(head, int) and isinstance(value, list):
        if head < len(value):
            old = value[head]
            return [*value[:head], put(old, rest, new, mode) if rest else (old if mode == "insert" else new), *value[head + 1 :]]
        return [*value, new] if head == len(value) and not rest and mode != "replace" else value
    return value


def cut(value, path: list):
    if not path:
        return _MISSING
    head, rest = path[0], path[1:]
    if isinstance(head, str) and isinstance(value, dict) and head in value:
        if rest:
            return {**value, head: cut(value[head], rest)}
        return {k: v for k, v in value.items() if k != head}
    if isinstance(head, int) and isinstance(value, list) and head < len(value):
        return [*value[:head], *([cut(value[head], rest)] if rest else []), *value[head + 1 :]]
    return value


def merge(value, patch):
    """A JSON merge patch (RFC 7396)."""
    if not isinstance(patch, dict):
        return patch
    out = dict(value) if isinstance(value, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out
