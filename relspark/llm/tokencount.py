"""Token counts from flat token files without an index.

Every block of a file is searched at once for the end-of-document id. A block
gives the lengths between its own separators; what stands before its first
separator belongs to a document that began earlier, and a prefix scan over the
blocks' summaries (separators, ids after the last one) says how much to add and
which ordinal the block's first document has. Blocks are listed, summed up and scanned
on the executors, file by file; the driver only knows the files' names.

Defined cases: an empty file or list gives no rows; ids after the last separator
of a file are one more document without an end, with ``closed`` false; two
separators in a row are a document of 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Ids in a block.
BLOCK_IDS = 1 << 20


def scan_counts(spark: SparkSession, files: list[str], dtype: str, end: int, block: int = BLOCK_IDS) -> DataFrame:
    """Rows ``file, ordinal, n_tokens, closed``: documents by file and position in it."""
    item, width = np.dtype(dtype).itemsize, 4 * spark.sparkContext.defaultParallelism
    known = spark.createDataFrame(list(enumerate(files)), "file int, uri string").repartition(max(1, min(len(files), width)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, uri in zip(b.column("file").to_pylist(), b.column("uri").to_pylist()):
                at = np.arange(0, store.length(uri) // item, block, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), file, np.int32)), pa.array([uri] * len(at), pa.string()), pa.array(at)], names=["file", "uri", "at"])

    def ends(uri: str, at: int) -> tuple[np.ndarray, int]:
        ids = store.array(uri, dtype, at, block)
        return np.flatnonzero(ids == end), len(ids)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ends(*x) for x in zip(b.column("uri").to_pylist(), b.column("at").to_pylist())]
            found = pa.array([len(e) for e, _ in got], pa.int64())
            after = pa.array([n - 1 - int(e[-1]) if len(e) else n for e, n in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, found, after], names=["file", "uri", "at", "found", "after"])

    kinds = "file int, uri string, at long"
    blocks = known.mapInArrow(listed, kinds).repartition(width)
    sums = store.settle(blocks.mapInArrow(summary, kinds + ", found long, after long"), "token-blocks")
    own = Window.partitionBy("file").orderBy("at")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    scanned = sums.withColumns({
        "ordinal": F.coalesce(F.sum("found").over(before), F.lit(0)),
        "last": F.lead("at").over(own).isNull(),
        "open": F.sum((F.col("found") > 0).cast("long")).over(own),  # blocks from one with a separator up to the next
    })
    since = Window.partitionBy("file", "open").orderBy("at")
    tail = F.sum("after").over(since)  # ids since the last separator, with this block
    scanned = scanned.withColumn("tail", tail).withColumn("carry", F.coalesce(F.lag("tail").over(own), F.lit(0)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, n = ends(row["uri"], row["at"])
                size = np.diff(np.concatenate([[-1], at])) - 1
                if len(size):
                    size[0] += row["carry"]
                rest = n - 1 - int(at[-1]) if len(at) else n + row["carry"]
                closed = np.ones(len(size), bool)
                if row["last"] and rest:
                    size, closed = np.append(size, rest), np.append(closed, False)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), row["file"], np.int32)), pa.array(row["ordinal"] + np.arange(len(size))), pa.array(size.astype(np.int64)), pa.array(closed)], names=["file", "ordinal", "n_tokens", "closed"])

    todo = scanned.select("file", "uri", "at", "ordinal", "carry", "last").repartition(width)
    return todo.mapInArrow(counts, "file int, ordinal long, n_tokens long, closed boolean")


def with_ids(counts: DataFrame, sidecars: list[str], id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens``: the ids of ordinals, from files that list them per file."""
    from .binary import NULL_ID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            file, at = b.column("file").to_numpy(), b.column("ordinal").to_numpy()
            own = np.zeros(len(at), np.int64)
            for f in np.unique(file).tolist():
                own[file == f] = store.array(sidecars[f], "<i8")[at[file == f]]
            yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), b.column("n_tokens")], names=[id_col, "n_tokens"])

    return counts.mapInArrow(run, f"`{id_col}` long, n_tokens long")
