"""Token files: flat unsigned integers plus 64-bit document offsets.

A data set is a folder of parts. ``part-N.bin`` holds the ids of its documents
end to end, two bytes an id where the vocabulary allows and four elsewhere;
``part-N.idx`` holds the start of each document in the part and the part's
length as signed 64-bit integers; ``part-N.ids`` holds the documents' own ids.
Parts are ranges of the document id, so the whole is in ascending order, and a
part's base is the prefix sum of the lengths before it.

Defined cases: a null or empty text is a document of the end id only; null ids
come first and rows that repeat an id stand next to each other, ordered by a hash of the
text (so that an id with many rows can be dealt to several parts); an empty table gives no
parts; other columns are not read. Ids are numbers; a text id that is none counts as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .exchange import partitions
from .tokens import END_ID, encoder

NULL_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: a row for each part, in order, with its bases."""

    uri: str
    dtype: str
    parts: list[tuple[int, int, int, int, int]]  # part, documents, tokens, documents before, tokens before


def write_tokens(docs: DataFrame, tokenizer: str, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END_ID, parts: int | None = None, ordered: bool = True, marks: bool = True) -> TokenFiles:
    """Writes the files; unless ``ordered``, parts are the input's own partitions and no text is shuffled. ``marks``: as in ``tokens``."""
    spark = docs.sparkSession
    uri = uri or store.fresh(spark, "tokens")
    src = docs.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    if ordered:
        size = src.agg(F.sum(F.octet_length("_t").cast("long"))).first()[0] or 0
        src = src.withColumn("_k", F.xxhash64("_t")).repartitionByRange(parts or partitions(spark, size), "_id", "_k").sortWithinPartitions("_id", "_k", "_t").select("_id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, marks), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if enc.small else "<u4")
        ids, sizes = [], []

        def encoded() -> Iterator[bytes]:
            for b in batches:
                buf, offs = tc.text_buffers(b.column(1))
                ids.append(np.asarray(b.column(0).fill_null(int(NULL_ID)), np.int64))
                for i, j in tc.slices(offs):
                    tokens, at = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end)
                    sizes.append(np.diff(at))
                    yield tokens.astype(kind).tobytes()

        name = f"{uri}/part-{part:06d}"
        store.put(f"{name}.bin", encoded())
        if not ids or not sum(map(len, ids)):
            return
        n = np.concatenate(sizes)
        store.put(f"{name}.idx", [np.concatenate([[0], np.cumsum(n)]).astype("<i8").tobytes()])
        store.put(f"{name}.ids", [np.concatenate(ids).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(n)], "tokens": [int(n.sum())], "small": [enc.small]})

    rows = sorted(map(tuple, src.mapInArrow(run, "part long, docs long, tokens long, small boolean").collect()))  # one row a part
    done, docs_before, before = [], 0, 0
    for part, n, tokens, _ in rows:
        done.append((part, n, tokens, docs_before, before))
        docs_before, before = docs_before + n, before + tokens
    return TokenFiles(uri, "<u2" if not rows or rows[0][3] else "<u4", done)


def read_tokens(spark: SparkSession, files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens and ids_crc32, from the files alone."""
    uri, dtype = files.uri, files.dtype
    todo = spark.createDataFrame(files.parts or [], "part int, docs long, tokens long, docs_before long, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                name = f"{uri}/part-{row['part']:06d}"
                ids, offs, own = store.array(f"{name}.bin", dtype), store.array(f"{name}.idx", "<i8"), store.array(f"{name}.ids", "<i8")
                for i in range(0, len(own), 4096):
                    j = min(i + 4096, len(own))
                    cut = (offs[i : j + 1] - offs[i]).tolist()
                    wide = memoryview(ids[offs[i] : offs[j]].astype("<u4").tobytes())
                    crc = [zlib.crc32(wide[4 * s : 4 * e]) for s, e in zip(cut, cut[1:])]
                    mask = np.asarray(own[i:j]) == NULL_ID
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(own[i:j]), mask=mask), pa.array(offs[i:j] + row["before"]), pa.array(np.diff(offs[i : j + 1])), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return todo.repartition(max(1, len(files.parts))).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
