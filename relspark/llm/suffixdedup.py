"""Suffix-array dedup of bytes by a depth-limited radix sort.

Suffixes are ordered only through the threshold: most-significant-digit passes
over digits of eight bytes, where a suffix that stands alone after a digit leaves the
sort, and a group whose digits are all equal needs no ordering in that pass. Suffixes
still together after the last digit are exactly the repeated windows (bytes decide, no
hash); all but the earliest of each group are removed.

Suffixes travel as runs of neighbours in one piece of context, dealt by the
anchor they share; near a hot anchor the runs are cut into short blocks and dealt by
the bytes that all suffixes of a block share.

Defined cases: a null or empty text has no bytes; shorter texts than the
threshold stay whole; rows that repeat an id and text are one document; rows that share
an id or are both without one never remove from each other; a null id is the smallest;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import repeats as rp
from . import textcore as tc

WINDOW, DIGIT = 100, 8
#: Neighbours in a block near a hot anchor, and bytes of context sorted at once.
BLOCK, SORT_BYTES = 8, 4 << 20
_HEAD = np.dtype([("rem", "<u4"), ("id", "<i8"), ("fp", "<i8"), ("fq", "<i8"), ("pos", "<u4"), ("n", "<u4")])


class _Contexts:
    """Runs of suffixes packed by partition: a head for each run, then the bytes."""

    def __init__(self, n: int, keys: np.ndarray, window: int, limit: int = 32 << 20):
        self.n, self.keys, self.window, self.limit, self.held, self.bytes = n, keys, window, limit, [], 0

    def add(self, part: np.ndarray, head: np.ndarray, buf: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = head["n"].astype(np.int64) + self.window - 1
        at = np.concatenate([[0], np.cumsum(size)])
        data = buf[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        self.held.append((part, head, data, at))
        self.bytes += len(data) + head.nbytes
        if self.bytes > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.bytes = self.held, [], 0
        if not held:
            return
        part = np.concatenate([h[0] for h in held])
        order = np.argsort(part, kind="stable")
        head = np.concatenate([h[1] for h in held])[order]
        size = np.concatenate([np.diff(h[3]) for h in held])
        at = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        data, size = np.concatenate([h[2] for h in held]), size[order]
        total = np.concatenate([[0], np.cumsum(size)])
        data = data[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        cuts = np.searchsorted(part[order], np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(cuts))
        rows = []
        for i in full:
            h, text = ex.squeeze([head[cuts[i] : cuts[i + 1]]]), ex.squeeze([data[total[cuts[i]] : total[cuts[i + 1]]]])
            rows.append(len(h).to_bytes(8, "little") + h + text)
        yield pa.RecordBatch.from_arrays([pa.array(self.keys[full], pa.int32()), pa.array(np.full(len(full), 0, np.int32)), pa.array(rows, pa.binary())], names=["p", "kind", "data"])


def _digits(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The eight bytes (all of a shorter window) at each place, as numbers that order like them; the text ends with eight spare bytes."""
    rows = np.lib.stride_tricks.as_strided(text, shape=(len(text) - DIGIT + 1, DIGIT), strides=(1, 1))
    out = np.ascontiguousarray(rows[at]).view(">u8")[:, 0].astype(tc.U)
    return out >> tc.U(8 * max(0, DIGIT - window))


def _places(window: int) -> list[int]:
    """Where the digits of a window begin; the last may overlap the one before."""
    return [min(d, max(0, window - DIGIT)) for d in range(0, window, DIGIT)]


def radix_order(text: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree with another through the window, in the order of their bytes, and their groups (ascending)."""
    text = np.concatenate([text, np.zeros(DIGIT, np.uint8)])
    active, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for place in _places(window):
        if not len(active):
            break
        digit = _digits(text, start[active] + place, window)
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][(group[1:] == group[:-1]) & (digit[1:] != digit[:-1])]] = True
        todo = np.flatnonzero(mixed[group])  # groups that this digit tells apart
        if len(todo):
            by = np.lexsort((digit[todo], group[todo])) if len(mixed) > 1 else np.argsort(digit[todo], kind="stable")
            active[todo], digit[todo] = active[todo][by], digit[todo][by]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        group = np.cumsum(fresh) - 1
        kept = np.bincount(group)[group] > 1
        active, group = active[kept], group[kept]
        if len(group):
            group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    return active, group


def _here_before(buf: np.ndarray, at: np.ndarray, name: np.ndarray, who: rp.Who, pos: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes the slice has earlier too: found by their hashes, compared by their bytes."""
    gone = np.zeros(len(at), bool)
    some = np.flatnonzero(tc.repeated(name))
    if len(some):
        _, head, group = np.unique(name[some], return_index=True, return_inverse=True)
        text, like = np.concatenate([buf, np.zeros(DIGIT, np.uint8)]), at[some[head]][group]
        same = np.ones(len(some), bool)
        for place in _places(window):
            same &= _digits(text, at[some] + place, window) == _digits(text, like + place, window)
        some, group = some[same], group[same]
        gone[some[rp.not_first(group, rp.pick(who, some), pos[some])]] = True
    return gone


def _flags(docs: DataFrame, id_col: str, text_col: str, who: tuple, window: int) -> DataFrame:
    spark = docs.sparkSession
    src = rp.prepare(docs, id_col, text_col, who)
    total, size = rp.size_of(src)
    n, unit = ex.partitions(spark, size), rp.Unit(False, window, max(1, min(32, window // 3)))
    keys = ex.part_keys(n)
    hot = spark.sparkContext.broadcast(rp.hot_anchors(src, total, unit))
    core = max(1, min(64, window - BLOCK + 1))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, deal = ex.Packer(n, keys), _Contexts(n, keys, window)
        for b, buf, offs in rp._texts(batches, True):
            s = rp.open_slice(buf, offs, unit)
            whole, own = b.column("whole").to_numpy(zero_copy_only=False), rp.who_of(b)
            yield from pack.add(*rp.with_part(rp.whole_copies(own, np.diff(s.offs), whole, window), n), kind=1)
            at, least, h = rp.candidates(s, unit, b.column("data").to_pylist(), whole)
            if not len(at):
                continue
            doc = np.searchsorted(s.offs, at, "right") - 1
            gone = _here_before(buf, at, s.prefix.runs(window)[at], rp.pick(own, doc), at - s.offs[doc], window)
            yield from pack.add(*rp.with_part(rp.flag_runs(rp.pick(own, doc[gone]), at[gone] - s.offs[doc[gone]]), n), kind=1)
            at, doc, least, h = at[~gone], doc[~gone], least[~gone], h[~gone]
            if not len(at):
                continue
            block = np.where(tc.member(h, hot.value), (least - at) // BLOCK, -1)
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (block[1:] != block[:-1])])
            count = np.diff(np.r_[cut, len(at)])
            common = least[cut] - block[cut] * BLOCK  # the last start that the block can hold
            shared = s.prefix.span(np.minimum(common, len(buf) - core), np.minimum(common, len(buf) - core) + core) if len(buf) >= core else h[cut]
            key = np.where(block[cut] >= 0, tc.mix(shared + block[cut].astype(tc.U)), h[cut])
            head = np.zeros(len(cut), _HEAD)
            head["rem"], head["n"], head["pos"] = key >> tc.U(32), count, at[cut] - s.offs[doc[cut]]
            head["id"], head["fp"], head["fq"] = rp.pick(own, doc[cut])
            yield from deal.add((key % tc.U(n)).astype(np.int64), head, buf, at[cut])
        yield from deal.flush()
        yield from pack.flush()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, heads, data = ex.Packer(n, keys), [], []
        for b in batches:
            for kind, raw in zip(b.column("kind").to_pylist(), b.column("data").to_pylist()):
                if kind:
                    cols = ex.unpack(raw, rp.FLAGS)
                    yield from pack.add(*rp.with_part(tuple(cols), n))
                else:
                    k = int.from_bytes(raw[:8], "little")
                    heads.append(ex.unpack(raw[8 : 8 + k], [_HEAD])[0])
                    data.append(np.frombuffer(ex.expand(raw[8 + k :]), np.uint8))
        if heads:
            head, data = np.concatenate(heads), np.concatenate(data)
            size = head["n"].astype(np.int64) + window - 1
            at = np.cumsum(size) - size
            by = np.argsort(head["rem"], kind="stable")
            rem = head["rem"][by]
            edge = np.flatnonzero(np.r_[True, rem[1:] != rem[:-1], True])  # runs that share a key stay together
            weight = np.concatenate([[0], np.cumsum(size[by])])[edge]
            i = 0
            while i < len(edge) - 1:
                j = max(i + 1, int(np.searchsorted(weight, weight[i] + SORT_BYTES, "right")) - 1)
                yield from pack.add(*_sorted(head[by[edge[i] : edge[j]]], at[by[edge[i] : edge[j]]], data, window, n))
                i = j
        yield from pack.flush()

    found = ex.deal(rp.joined(src, unit, hot.value, n).mapInArrow(suffixes, ex.SCHEMA), n).mapInArrow(order, ex.SCHEMA)
    return rp.flags_by_document(found, n)


def _sorted(head: np.ndarray, at: np.ndarray, data: np.ndarray, window: int, n: int) -> tuple[np.ndarray, ...]:
    """The radix sort of some runs; what is later than its group's earliest, as flags."""
    count = head["n"].astype(np.int64)
    size = count + window - 1
    total = np.concatenate([[0], np.cumsum(size)])
    text = data[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
    base = np.concatenate([[0], np.cumsum(count)])
    run = np.repeat(np.arange(len(head)), count)
    step = np.arange(base[-1]) - base[run]
    suffix, group = radix_order(text, total[run] + step, window)
    own, pos = tuple(head[c][run[suffix]] for c in ("id", "fp", "fq")), head["pos"][run[suffix]].astype(np.int64) + step[suffix]
    late = rp.not_first(group, own, pos)
    return rp.with_part(rp.flag_runs(rp.pick(own, late), pos[late]), n)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id (as long), n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay."""
    who = rp.identity(docs, id_col, text_col)
    flags = _flags(docs, id_col, text_col, who, window)
    named = docs.select(F.col(id_col).try_cast("long").alias("_old"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *(c.alias(k) for c, k in zip(who, rp.KEY)))
    df = named.join(flags.hint("merge"), list(rp.KEY), "left").select("_old", "_t", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in rp._texts(batches):
            out = []
            for data, a, e in zip(b.column("data").to_pylist(), offs.tolist(), offs[1:].tolist()):
                text = buf[a:e]
                gone = rp.removed(data, e - a, window)
                kept = text[~gone] if data else text
                out.append((e - a, int(gone.sum()), len(tc.runs(gone)[0]), hashlib.sha256(kept.tobytes()).hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return df.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
