"""Repeated passages of whole corpora, shared by the two substring operators.

Looking at every suffix of the corpus would shuffle many times its size. Three
steps keep that in proportion to what can repeat:

1. Winnowing picks anchors, short grams such that every window of the wanted
   length holds at least one, at the same relative place in equal windows. Only
   their hashes are dealt out, and each learns whether it occurs elsewhere.
2. A window whose least gram occurs once can't repeat. The suffixes
   that are left are dealt out and ordered exactly (``radix`` or ``tree``).
3. Windows found to start earlier too go back to their documents as runs.

Anchors in a percent of a bounded sample of documents are called hot. They are
known to repeat without a look, and the suffixes near them are dealt by their
content, so no task gathers a hot passage; this steers work only, never results.
Every map task also settles repeats within a slice of its own before it deals.

Documents are told apart by their id and, where an id occurs more than once, by 128
bits of the text's hash: rows that repeat both count as one document and speak once a
task. Of rows that share an id only, none is earlier than another. A null id is the
smallest id; a text that is no number counts as a null id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import store
from . import textcore as tc

NULL_ID = np.iinfo(np.int64).min
#: What tells documents apart, in tables and in dealt blocks; slots that ids are hashed to, to name those that occur twice.
KEY, WHO, SLOTS = ("_id", "_fp", "_fq"), ["<i8", "<i8", "<i8"], 1 << 14
#: Documents sampled to name hot anchors and prefixes, and the share of them that makes one hot.
SAMPLE_DOCS, HOT_SHARE = 8192, 0.01


@dataclass(frozen=True)
class Unit:
    """What a window consists of: ``window`` items, anchored by grams of ``gram`` items."""

    words: bool
    window: int
    gram: int

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Slice:
    """Some documents with their items (bytes or words) and the hashes of their grams."""

    buf: np.ndarray
    offs: np.ndarray  # of documents, in items
    items: np.ndarray | None  # word hashes
    prefix: tc.PrefixHash | None
    starts: np.ndarray | None
    ends: np.ndarray | None


def open_slice(buf: np.ndarray, offs: np.ndarray, unit: Unit) -> Slice:
    if unit.words:
        starts, ends, woffs = tc.word_bounds(buf, offs)
        return Slice(buf, woffs, tc.span_hash(buf, starts, ends), None, starts, ends)
    return Slice(buf, offs, None, tc.PrefixHash(buf), None, None)


def grams_of(s: Slice, unit: Unit) -> np.ndarray:
    return tc.grams(s.items, unit.gram) if unit.words else s.prefix.runs(unit.gram)


def order_of(g: np.ndarray) -> np.ndarray:
    """What winnowing compares: 31 bits of a gram's hash."""
    return (g >> tc.U(33)).astype(np.uint32)


def anchors(s: Slice, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in items of the slice) and hashes of the anchors."""
    g = grams_of(s, unit)
    if not len(g):
        return np.zeros(0, np.int64), g
    pick = tc.minimizers(order_of(g), unit.reach)
    at = np.flatnonzero(pick)
    doc = np.searchsorted(s.offs, at, "right") - 1
    at = at[at + unit.gram <= s.offs[doc + 1]]
    return at, g[at]


def identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Columns that tell documents apart: a number for the id, and 128 bits of the text's hash (0 where the id occurs once)."""
    number = F.coalesce(F.col(id_col).try_cast("long"), F.lit(int(NULL_ID)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    twice = docs.select(number.alias("_id")).groupBy("_id").count().where("count > 1")
    slots = twice.select(F.pmod(F.xxhash64("_id"), F.lit(SLOTS)).alias("s")).distinct().collect()  # at most SLOTS numbers
    if not slots:
        return number, F.lit(0).cast("long"), F.lit(0).cast("long")
    seen = bytearray(SLOTS)
    for r in slots:
        seen[r.s] = 1
    # Ids that share a slot with a repeated one are hashed too: more bytes, the same result.
    shared = F.substring(F.lit(bytes(seen)), (F.pmod(F.xxhash64(number), F.lit(SLOTS)) + 1).cast("int"), F.lit(1)) == F.lit(b"\1")
    return number, F.when(shared, F.xxhash64(text).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"), F.when(shared, F.xxhash64(F.lit(1), text)).otherwise(F.lit(0)).cast("long")


def prepare(docs: DataFrame, id_col: str, text_col: str, who: tuple[Column, Column, Column]) -> DataFrame:
    """``_id, _fp, _fq`` of ``identity``, and the text ``_t``."""
    return docs.select(*(c.alias(n) for c, n in zip(who, KEY)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))


def size_of(src: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text."""
    got = src.agg(F.count("*"), F.sum(F.octet_length("_t").cast("long"))).first()
    return got[0], got[1] or 0


Who = tuple[np.ndarray, np.ndarray, np.ndarray]


def who_of(b: pa.RecordBatch) -> Who:
    return tuple(b.column(c).to_numpy() for c in KEY)


def pick(who: Who, at: np.ndarray) -> Who:
    return tuple(c[at] for c in who)


def other_doc(who: Who) -> np.ndarray:
    """Which rows (but the first) are of another document than the row before."""
    ids, fps, fqs = who
    return (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1]) | (fqs[1:] != fqs[:-1])


def doc_keys(who: Who) -> tuple[np.ndarray, ...]:
    """Keys of a lexsort that brings a document's rows together, ids ascending."""
    ids, fps, fqs = who
    return (fqs, fps, ids) if fps.any() else (ids,)


def _once(b: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Without the rows whose id and text this task had before."""
    who = who_of(b)
    at = np.flatnonzero(who[1])
    if not len(at):
        return b
    keep = np.ones(len(b), bool)
    for k, key in zip(at.tolist(), zip(*(c[at].tolist() for c in who))):
        keep[k] = key not in seen
        seen.add(key)
    return b.filter(pa.array(keep))


def _texts(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of ``prepare`` in slices, with bytes and offsets; ``once``: repeated documents once."""
    seen: set = set()
    for b in batches:
        b = _once(b, seen) if once else b
        buf, offs = tc.text_buffers(b.column("_t"))
        for i, j in tc.slices(offs):
            yield b.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def sample_counts(src: DataFrame, total: int, values: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list:
    """Hashes found in at least HOT_SHARE of the sampled documents."""
    if not total:
        return []
    bound = int(min(1.0, SAMPLE_DOCS / total) * (1 << 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in _texts(batches, True):
            h = values(buf, offs)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    some = src.where(F.pmod(F.xxhash64("_id", "_fp"), F.lit(1 << 31)) < bound)
    least = max(3, int(HOT_SHARE * min(total, SAMPLE_DOCS)))
    return [r.h for r in some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").collect()]  # at most grams a document / HOT_SHARE


def hot_anchors(src: DataFrame, total: int, unit: Unit) -> np.ndarray:
    def values(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        s = open_slice(buf, offs, unit)
        at, h = anchors(s, unit)
        doc = np.searchsorted(s.offs, at, "right") - 1
        order = np.lexsort((doc, h))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        return h[order][fresh]

    return np.sort(np.array(sample_counts(src, total, values), np.int64).view(tc.U))


def copies(src: DataFrame) -> DataFrame:
    """The keys of documents whose whole text stands under a smaller id too."""
    keys = src.select(*KEY, F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(1), "_t").alias("b"))
    first = keys.groupBy("a", "b").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("most > least").select("a", "b", "least")
    first = store.settle(first, "copies")  # no longer dealt by the text: a group of many copies can be split by the join
    return keys.join(first.hint("merge"), ["a", "b"]).where("_id > least").select(*KEY).distinct()


def by_document(replies: DataFrame, n: int, types: list, pack_row: Callable[..., bytes]) -> DataFrame:
    """Dealt replies ``(id, fp, fq, ...)`` as one row ``_id, _fp, _fq, data`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ex.gather(batches, {0: types})[0]
        if not len(cols[0]):
            return
        order = np.lexsort((cols[3], *doc_keys(cols[:3])))
        cols = [c[order] for c in cols]
        cut = np.flatnonzero(np.r_[True, other_doc(cols[:3]), True])
        for i in range(0, len(cut) - 1, 4096):
            c = cut[i : i + 4097]
            data = [pack_row(*(x[a:b] for x in cols[3:])) for a, b in zip(c.tolist(), c[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[c[:-1]]) for x in cols[:3]), pa.array(data, pa.binary())], names=[*KEY, "data"])

    return ex.deal(replies, n).mapInArrow(run, "_id long, _fp long, _fq long, data binary")


def doc_part(who: Who, n: int) -> np.ndarray:
    ids, fps, _ = who
    return (tc.mix(ids.view(tc.U) ^ tc.mix(fps.view(tc.U))) % tc.U(n)).astype(np.int64)


def repeating_anchors(src: DataFrame, unit: Unit, hot: np.ndarray, n: int) -> DataFrame:
    """``_id, _fp, _fq, data``: for each document, its anchors that occur elsewhere too (document offsets, unsigned 32 bits).

    Anchors that a slice has twice are known to repeat; one of them asks on behalf of
    the slice, so what meets in a task grows with the slices and not with the occurrences.
    """
    keys = ex.part_keys(n)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = ex.Packer(n, keys)
        for b, buf, offs in _texts(batches, True):
            s = open_slice(buf, offs, unit)
            at, h = anchors(s, unit)
            doc = np.searchsorted(s.offs, at, "right") - 1
            who, pos = pick(who_of(b), doc), (at - s.offs[doc]).astype(np.uint32)
            known = tc.member(h, hot)
            asks = ~known
            rest = np.flatnonzero(asks)
            if len(rest):
                rest = rest[np.argsort(h[rest], kind="stable")]
                same = h[rest][1:] == h[rest][:-1]
                asks[rest[1:][same]] = False
                known[rest[np.r_[False, same] | np.r_[same, False]]] = True
            yield from pack.add(doc_part(pick(who, known), n), *pick(who, known), pos[known], kind=1)
            yield from pack.add((h[asks] % tc.U(n)).astype(np.int64), (h[asks] >> tc.U(32)).astype(np.uint32), *pick(who, asks), pos[asks])
        yield from pack.flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ex.gather(batches, {0: ["<u4", *WHO, "<u4"], 1: [*WHO, "<u4"]})
        pack = ex.Packer(n, keys)
        yield from pack.add(doc_part(got[1][:3], n), *got[1])
        h, *who, pos = got[0]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order
        who = pick(who, twice)
        yield from pack.add(doc_part(who, n), *who, pos[twice])
        yield from pack.flush()

    found = ex.deal(src.mapInArrow(find, ex.SCHEMA), n).mapInArrow(answer, ex.SCHEMA)
    return by_document(found, n, [*WHO, "<u4"], lambda pos: pos.tobytes())


def candidates(s: Slice, unit: Unit, data: list[bytes | None], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose least gram occurs elsewhere too: their starts, and that gram's position and hash.

    Equal windows have the same least gram at the same place; of ties, the first.
    """
    none = np.zeros(0, np.int64)
    total, g = int(s.offs[-1]), grams_of(s, unit)
    if total < unit.window:
        return none, none, none.view(tc.U)
    twice = np.zeros(len(g), bool)
    for d, raw in enumerate(data):
        if raw:
            twice[np.frombuffer(raw, "<u4").astype(np.int64) + s.offs[d]] = True
    key = (order_of(g).astype(tc.U) << tc.U(33)) | np.where(twice, tc.U(0), tc.U(1 << 32)) | np.arange(len(g), dtype=tc.U)
    low = tc.sliding(key, unit.reach, np.minimum)
    start = np.flatnonzero((low >> tc.U(32)) & tc.U(1) == 0)
    doc = np.searchsorted(s.offs, start, "right") - 1
    start = start[(start + unit.window <= s.offs[doc + 1]) & ~whole[doc]]
    at = (low[start] & tc.U(0xFFFFFFFF)).astype(np.int64)
    return start, at, g[at]


def not_first(group: np.ndarray, who: Who, pos: np.ndarray | None) -> np.ndarray:
    """Of grouped windows, those of a larger id than their group's least; with ``pos`` also those that an equal one precedes in their document."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.lexsort((*([] if pos is None else [pos]), *doc_keys(who), group))
    g, own = group[order], pick(who, order)
    head = np.r_[True, g[1:] != g[:-1]]
    ids = own[0]
    late = ids > ids[np.flatnonzero(head)[np.cumsum(head) - 1]]
    if pos is not None:
        p = pos[order]
        doc = head | np.r_[True, other_doc(own)]
        late |= p > p[np.flatnonzero(doc)[np.cumsum(doc) - 1]]
    out = np.zeros(len(group), bool)
    out[order] = late
    return out


FLAGS = [*WHO, "<u4", "<u4"]  # the document, start, windows in a row


def flag_runs(who: Who, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Flagged windows as runs of windows that follow one another."""
    if not len(pos):
        return (*who, pos.astype(np.uint32), pos.astype(np.uint32))
    order = np.lexsort((pos, *doc_keys(who)))
    who, pos = pick(who, order), pos[order].astype(np.int64)
    cut = np.flatnonzero(np.r_[True, other_doc(who) | (pos[1:] > pos[:-1] + 1)])
    last = np.r_[cut[1:], len(pos)] - 1
    return (*pick(who, cut), pos[cut].astype(np.uint32), (pos[last] - pos[cut] + 1).astype(np.uint32))


def with_part(runs: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """Runs with the partition of their documents before them, as ``Packer.add`` takes them."""
    return (doc_part(runs[:3], n), *runs)


def whole_copies(who: Who, size: np.ndarray, whole: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """One run of all windows for each document that copies an earlier one."""
    at = np.flatnonzero(whole & (size >= window))
    return (*pick(who, at), np.zeros(len(at), np.uint32), (size[at] - window + 1).astype(np.uint32))


def flags_by_document(found: DataFrame, n: int) -> DataFrame:
    return by_document(found, n, FLAGS, lambda pos, run: pos.tobytes() + run.tobytes())


def removed(data: bytes | None, total: int, window: int) -> np.ndarray:
    """Which items the flagged windows of a document cover."""
    if not data:
        return np.zeros(total, bool)
    pos, run = np.frombuffer(data, "<u4").reshape(2, -1).astype(np.int64)
    if (pos + run + window - 1 > total).any():
        raise ValueError("a flagged window lies outside its document")
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, pos, 1)
    np.add.at(step, pos + run + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def joined(src: DataFrame, unit: Unit, hot: np.ndarray, n: int) -> DataFrame:
    """Documents with repeating anchors: ``prepare``'s columns, ``data`` and ``whole`` (a copy of an earlier text)."""
    known = repeating_anchors(src, unit, hot, n)
    twins = copies(src).withColumn("whole", F.lit(True))
    return src.join(known.hint("merge"), list(KEY)).join(twins.hint("merge"), list(KEY), "left").select(*KEY, "_t", "data", F.coalesce("whole", F.lit(False)).alias("whole"))
