"""Recursive queries that Spark's WITH RECURSIVE lacks: UNION with duplicates removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import OperationalError
from ..sources import shared


#: Rounds after which a recursion counts as endless.
ROUNDS = 1000


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """All rows reached from ``base`` by ``step``; a row seen before (nulls equal) is not followed again.

    Each round's new rows are written to the shared folder, which ends the lineage. If rows still
    come after ``rounds`` rounds, that is an error, never a part of the result.
    """
    spark, rounds = base.sparkSession, ROUNDS if rounds is None else rounds
    names = base.columns
    new = shared.settle(base.distinct(), "recursive")
    seen = new
    for _ in range(rounds + 1):
        got = step(new).toDF(*names).distinct()
        old = seen.toDF(*(f"_{i}" for i in range(len(names))))
        same = None
        for i, n in enumerate(names):
            one = got[n].eqNullSafe(old[f"_{i}"])
            same = one if same is None else same & one
        new = shared.settle(got.join(old, same, "left_anti"), "recursive")
        if new.isEmpty():
            return seen
        seen = seen.union(spark.read.schema(new.schema).parquet(*new.inputFiles()))
    raise OperationalError(f"recursion did not end in {rounds} rounds")
