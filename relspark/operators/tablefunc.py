"""Table-valued functions and user aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SCHEMA = "key string, value string, type string, atom string, id long, parent long, fullkey string, path string"


def json_rows(text: str | None, path: str | None, deep: bool) -> list[tuple]:
    """The rows of json_each (``deep``: json_tree) for one document."""
    from ..functions import jsonvalue as jv

    value, steps = jv.loads(text), jv.steps(path or "$")
    if jv.missing(value) or steps is None:
        return []
    top = jv.find(value, steps)
    if jv.missing(top):
        return []
    out: list[tuple] = []

    def visit(key, v, parent, where: str, root: str) -> None:
        plain = None if v is None else v if isinstance(v, str) else ("1" if v else "0") if isinstance(v, bool) else jv.dumps(v)
        me = len(out)
        out.append((None if key is None else str(key), plain, jv.kind(v), None if isinstance(v, (dict, list)) else plain, me, parent, where, root))
        if deep and isinstance(v, (dict, list)):
            children(v, me, where)

    def children(v, parent, where: str) -> None:
        items = v.items() if isinstance(v, dict) else enumerate(v)
        for k, c in items:
            visit(k, c, parent, f"{where}[{k}]" if isinstance(k, int) else f"{where}.{k}", where)

    if deep or not isinstance(top, (dict, list)):
        visit(None, top, None, path or "$", path or "$")
    else:
        children(top, None, path or "$")
    return out


def json_each(df: DataFrame, column: str, path: str = "$", deep: bool = False) -> DataFrame:
    """``df`` with a row for each element of the JSON in ``column``."""

    @F.udf(returnType=f"array<struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>>", useArrow=True)
    def rows(text):
        return json_rows(text, path, deep)

    return df.select("*", F.inline(rows(F.col(column))))


def user_aggregate(cls: type, returns: str | DataType):
    """A grouped aggregate from a class with ``step(value)`` and ``finalize()``."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> object:
        state = cls()
        for v in values:
            state.step(None if v is None or v != v else v)
        return state.finalize()

    return run


class _Sum:
    def __init__(self):
        self.total = 0

    def step(self, value):
        self.total += value or 0

    def finalize(self):
        return int(self.total)


def user_aggregate_demo(orders: DataFrame) -> DataFrame:
    """A sum by ``step`` and ``finalize`` beside a built-in count."""
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sums = orders.groupBy("o_orderstatus").agg(user_aggregate(_Sum, "long")(F.col("o_orderkey")).alias("s"))
    return counts.join(sums, "o_orderstatus")
