"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of token ids. Every window of the output grants each
queue its target share of the window's tokens; what a queue was granted but
could not use because tokens are whole is its deficit and is carried to the next
window. For a cumulative grant of x tokens a queue has therefore been served
``floor(x * share)`` tokens plus at most one, so the state of the round-robin at
any window is a formula, and no task waits for another: a document's place
follows from its offset in its queue, which a prefix sum over partitions gives.
Queues that run dry end a phase; the others then share the windows anew.

A source that is due less than two tokens a window is thin: all thin sources share one
queue, in the order of the input (so that their own mixture is kept over the windows), and
that queue is granted two tokens a window at least. Sources that the targets leave out
share a queue that is served when all others are empty.

The driver knows a number for each task and queue (at most ``window / 2 + 2`` queues); the
offsets that follow from them are a file that tasks read a row of.

Defined cases: a null or empty text is a document of the end id only; a null
source is a queue of its own; repeated rows are packed each; an empty table
packs to nothing; other columns are not read. Ids are numbers; a text id that is none
counts as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .tokens import END_ID, encoder

WINDOW = 4096


@dataclass(frozen=True)
class Phase:
    """Tokens ``begin`` to ``end`` of the output, dealt by ``weight`` from ``served`` on."""

    begin: int
    end: int
    served: np.ndarray
    weight: np.ndarray


def plan_phases(totals: np.ndarray, weights: np.ndarray) -> list[Phase]:
    """The phases that serve queues of these lengths wholly."""
    totals = totals.astype(np.int64)
    served, at, out = np.zeros_like(totals), 0, []
    while (left := totals - served).any():
        w = np.where(left > 0, weights, 0).astype(np.longdouble)
        w = left.astype(np.longdouble) if w.sum() <= 0 else w
        w /= w.sum()
        full = int(left.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            n = int(np.floor(np.where(w > 0, left / w, np.inf).min() + np.longdouble(1e-9)))
        if n < 1 or n >= full - len(totals):
            n, w = full, left.astype(np.longdouble) / full
        phase = Phase(at, at + n, served.copy(), w)
        out.append(phase)
        served = served_at(phase, np.array([at + n]), totals)[0]
        at += n
    return out


def served_at(phase: Phase, x: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens taken from each queue once ``x`` tokens of output are full (x: many)."""
    due = (x - phase.begin).astype(np.longdouble)[:, None] * phase.weight[None, :]
    base = np.floor(due).astype(np.int64)
    room = totals[None, :] - phase.served[None, :]
    base = np.minimum(base, room)
    short = (x - phase.begin) - base.sum(axis=1)
    rank = np.argsort(np.argsort(np.where((base < room) & (phase.weight > 0), base - due, 2).astype(np.float64), axis=1, kind="stable"), axis=1, kind="stable")
    return phase.served + base + (rank < short[:, None])


class Schedule:
    """Where each token of each queue goes; the same in every task."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int):
        self.totals, self.window, self.phases = totals, window, plan_phases(totals, weights)
        self.length = int(totals.sum())

    def served(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.totals)), np.int64)
        for p in self.phases:
            at = (x >= p.begin) & (x <= p.end)
            if at.any():
                out[at] = served_at(p, x[at], self.totals)
        return out

    def _window_of(self, queue: int, token: int) -> int:
        lo, hi = 0, -(-self.length // self.window)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.served(np.array([min(mid * self.window, self.length)]))[0, queue] <= token else (lo, mid)
        return lo

    def pieces(self, queue: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(queue offsets where pieces begin, windows, offsets in the windows)`` of tokens first..last-1."""
        lo, hi = self._window_of(queue, first), self._window_of(queue, last - 1)
        starts, windows, offsets = [], [], []
        step = max(16, (1 << 18) // len(self.totals))
        for a in range(lo, hi + 1, step):
            w = np.arange(a, min(a + step, hi + 1))
            c = self.served(np.minimum(np.append(w, w[-1] + 1) * self.window, self.length))
            before = (c[1:] - c[:-1])[:, :queue].sum(axis=1)
            begin = np.maximum(c[:-1, queue], first)
            some = np.minimum(c[1:, queue], last) > begin
            starts.append(begin[some])
            windows.append(w[some])
            offsets.append((before + begin - c[:-1, queue])[some])
        return np.concatenate(starts), np.concatenate(windows), np.concatenate(offsets)


@dataclass(frozen=True)
class Queues:
    """Which queue a source stands in."""

    number: dict[str | None, int]
    other: int  # of sources not named
    count: int

    def of(self, sources: list[str | None]) -> list[int]:
        return [self.number.get(s, self.other) for s in sources]


#: Tokens of a window that a source of its own queue is due at least.
LEAST = 2


def queues_of(docs: DataFrame, text_col: str, source_col: str | None, window: int, targets: Mapping[str | None, float] | None) -> tuple[Queues, np.ndarray | None]:
    """Queues: one for each source that is due LEAST tokens a window, one for the thin ones, one for those without a target. And their targets."""
    if targets is None:
        # Bytes stand for tokens here: they only decide which sources share a queue.
        size = (F.octet_length(F.col(text_col).cast("string")) + 1).cast("long")
        named = docs.select(_source(source_col).alias("s"), F.coalesce(size, F.lit(1)).alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
        whole = named.agg(F.sum("n")).first()[0] or 0
        heavy = [r.s for r in named.where(F.col("n") * window >= LEAST * whole).collect()]  # at most window / LEAST
        number = {q: i for i, q in enumerate(sorted(heavy, key=lambda q: (q is not None, q)))}
        return Queues(number, len(number), len(number) + 2), None
    shares = {q: float(w) for q, w in targets.items() if w > 0}
    whole = sum(shares.values())
    heavy = sorted((q for q, w in shares.items() if w * window >= LEAST * whole), key=lambda q: (q is not None, q))
    thin = [q for q in shares if q not in heavy]
    number = {q: i for i, q in enumerate(heavy)} | dict.fromkeys(thin, len(heavy))
    return Queues(number, len(heavy) + 1, len(heavy) + 2), np.array([*(shares[q] for q in heavy), sum(shares[q] for q in thin), 0.0])


def _source(source_col: str | None) -> Column:
    return F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")


def encode_docs(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str | None, end: int, queues: Queues) -> DataFrame:
    """The encoded documents as a shared table; each row knows its task and its offset in the task's part of its queue."""
    src = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t"), _source(source_col).alias("queue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        at = np.zeros(queues.count, np.int64)
        for b in batches:
            buf, offs = tc.text_buffers(b.column(1))
            heads = np.array(queues.of(b.column(2).to_pylist()), np.int32)
            for i, j in tc.slices(offs):
                ids, cut = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end)
                ids, n, place, head = ids.astype("<u2" if enc.small else "<u4"), np.diff(cut), np.zeros(j - i, np.int64), heads[i:j]
                for q in np.unique(head).tolist():
                    own = np.flatnonzero(head == q)
                    total = np.cumsum(n[own])
                    place[own] = at[q] + total - n[own]
                    at[q] += total[-1]
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(cut * ids.itemsize)), pa.py_buffer(ids)]).cast(pa.binary())
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(head), pa.array(np.full(j - i, part, np.int32)), pa.array(place), pa.array(n), pa.array(np.full(j - i, enc.small)), blob]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "queue", "head", "part", "place", "n", "small", "ids"])

    return store.settle(src.mapInArrow(run, "doc_id long, queue string, head int, part int, place long, n long, small boolean, ids binary"), "packing")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows of pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue`` (the source).

    ``targets`` maps sources to shares of the tokens (sources it lacks get none
    until the others are empty); by default every source gets its share of the
    corpus, so all queues empty together. ``with_ids`` adds the ids themselves.
    """
    spark = docs.sparkSession
    queues, weights = queues_of(docs, text_col, source_col, window, targets)
    table = encode_docs(docs, tokenizer, id_col, text_col, source_col, end, queues)
    sums = table.groupBy("part", "head").agg(F.sum("n").alias("n")).collect()  # tasks x queues
    grid = np.zeros((max((r.part for r in sums), default=-1) + 1, queues.count), np.int64)
    for r in sums:
        grid[r.part, r["head"]] = r.n
    totals = grid.sum(axis=0)
    weights = totals.astype(float) if weights is None else weights
    weights = np.where(weights > 0, np.maximum(weights, 1.5 * weights.sum() / window), 0.0)  # a grant never shrinks
    bases = store.fresh(spark, "packing-bases")
    store.put(bases, [(np.cumsum(grid, axis=0) - grid).astype("<i8").tobytes()])
    shared = spark.sparkContext.broadcast(Schedule(totals, weights, window))  # numbers by queue and phase
    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = shared.value
        base: dict[int, np.ndarray] = {}
        for b in batches:
            head, part, place, n = b.column("head").to_pylist(), b.column("part").to_numpy(), b.column("place").to_numpy(), b.column("n").to_numpy()
            small = b.column("small").to_pylist()
            base = {p: base[p] if p in base else store.array(bases, "<i8", p * queues.count, queues.count) for p in set(part.tolist())}
            first = np.array([base[p][q] for p, q in zip(part.tolist(), head)], np.int64) + place
            groups: dict[int, list[int]] = {}
            for k, q in enumerate(head):
                groups.setdefault(q, []).append(k)
            for q, members in groups.items():
                members = np.array(members)[np.argsort(first[members], kind="stable")]
                breaks = np.flatnonzero(first[members][1:] != (first[members] + n[members])[:-1]) + 1
                for chain in np.split(members, breaks):  # documents that follow one another in the queue
                    begin, stop = first[chain], first[chain] + n[chain]
                    cut, window_no, offset = schedule.pieces(q, int(begin[0]), int(stop[-1]))
                    edges = np.union1d(cut, begin)
                    at = np.searchsorted(cut, edges, "right") - 1
                    doc = chain[np.searchsorted(begin, edges, "right") - 1]
                    size = np.diff(np.append(edges, stop[-1]))
                    start = edges - first[doc]
                    crc, raw, view = [], [], (-1, None)
                    for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist()):
                        if view[0] != d:
                            view = (d, memoryview(np.frombuffer(b.column("ids")[d].as_buffer(), "<u2" if small[d] else "<u4").astype("<u4").tobytes()))
                        piece = view[1][4 * s : 4 * (s + m)]
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            raw.append(bytes(piece))
                    cols = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window_no[at]), pa.array(offset[at] + edges - cut[at]), b.column("queue").take(pa.array(doc))]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=names_out)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return table.mapInArrow(run, kinds + ", ids binary" * with_ids)
