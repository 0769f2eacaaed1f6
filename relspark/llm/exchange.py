"""Moving numpy columns between tasks as packed blocks.

A task packs what it sends to each of P partitions into a few binary rows, and
one Spark shuffle moves them, so tens of millions of small records cost the JVM
only thousands of rows. Blocks are plain shuffle data: a lost executor's blocks
are recomputed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "p int, kind int, data binary"
_ARROW = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


#: Bytes of text for each partition of an exchange at most; a task holds a few times that.
PART_BYTES = 256 << 20


def partitions(spark: SparkSession, text_bytes: int = 0) -> int:
    """The session's number of shuffle partitions, or more of them if the texts need it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PART_BYTES))


def _murmur_int(k: int, seed: int = 42) -> int:
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    k = rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rot(seed ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * by & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def part_keys(n: int) -> np.ndarray:
    """For each of n hash partitions, an int that Spark's partitioner sends there."""
    keys, left, k = np.full(n, -1, np.int32), n, 0
    while left:
        at = _murmur_int(k) % n
        if keys[at] < 0:
            keys[at], left = k, left - 1
        k += 1
    return keys


class Packer:
    """Gathers columns by partition; ``flush`` yields record batches of blocks."""

    def __init__(self, n: int, keys: np.ndarray, limit: int = 32 << 20):
        self.n, self.keys, self.limit, self.held, self.bytes = n, keys, max(limit, n << 9), [], 0  # blocks of some hundred bytes at least

    def add(self, part: np.ndarray, *cols: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
        if len(part):
            self.held.append((kind, part, cols))
            self.bytes += sum(c.nbytes for c in cols) + 2 * len(part)
        if self.bytes > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.bytes = self.held, [], 0
        for kind in sorted({k for k, _, _ in held}):
            part = np.concatenate([p for k, p, _ in held if k == kind]).astype(np.uint16 if self.n <= 65536 else np.uint32)
            order = np.argsort(part, kind="stable")
            cols = [np.concatenate(c)[order] for c in zip(*(c for k, _, c in held if k == kind))]
            cuts = np.searchsorted(part[order], np.arange(self.n + 1))
            full = np.flatnonzero(np.diff(cuts))
            data = [squeeze([c[cuts[i] : cuts[i + 1]] for c in cols]) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[full], pa.int32()), pa.array(np.full(len(full), kind, np.int32)), pa.array(data, pa.binary())], schema=_ARROW)


def deal(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "p")


def squeeze(cols: list[np.ndarray]) -> bytes:
    """Columns as one compressed block; bytes of equal rank stand together, so that ids and places shrink."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"" for c in map(np.ascontiguousarray, cols))
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def unpack(data: bytes, types: list) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(expand(data), np.uint8)
    n, at, out = len(planes) // sum(sizes), 0, []
    for t, size in zip(types, sizes):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(t)[:, 0])
        at += n * size
    return out


def gather(batches: Iterator[pa.RecordBatch], types: dict[int, list]) -> dict[int, list[np.ndarray]]:
    """All blocks of this partition, joined by kind."""
    got: dict[int, list] = {k: [] for k in types}
    for b in batches:
        for kind, data in zip(b.column("kind").to_pylist(), b.column("data").to_pylist()):
            got[kind].append(unpack(data, types[kind]))
    return {k: [np.concatenate(c) for c in zip(*v)] if v else [np.zeros(0, t) for t in types[k]] for k, v in got.items()}
