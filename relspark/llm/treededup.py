"""Substring dedup of words by prefix-partitioned suffix trees.

A suffix here is a window of words. Suffixes are split by prefixes of variable
length: a prefix that too many sampled documents share is lengthened, so that a
group fits in a task. From each group a suffix tree is built by elastic ranges (several
words an edge, named by hashes of the path from the root): its leaves are the sorted
suffixes, its internal nodes the ranges of leaves that agree further than their
surroundings. Nodes as deep as the window are the repeats; in a document, the union of
the windows below such nodes gives its maximal repeats, and a leaf below such a node is
removed if another leaf's document has a smaller id.

Defined cases: a null or empty text has no words; texts shorter than the window
stay whole; rows that repeat an id and text are one document and get one answer each;
rows that share an id or are both without one never remove from each other; a null id is
smaller than all others; an empty table gives no rows; columns other than id and text are
not read by ``mark`` and are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import repeats as rp
from . import textcore as tc

WINDOW = 13
#: Lengths of prefixes that split suffixes; the last is the whole window.
PREFIXES = (1, 2, 4, 8)
#: Bits of each edge that are dealt. The last stands for the whole path, so any two windows are told apart by 64 bits at least.
EDGE_BITS = (16, 16, 64)


def _ends(window: int) -> list[int]:
    """Depths where edges of the tree end."""
    return [max(1, window // 3), max(1, 2 * window // 3), window]


def _edges(items: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of the words of each suffix from its start to the end of an edge of the tree, for each edge."""
    h, done = items[at].copy(), 1
    out = []
    for end in _ends(window):
        for j in range(done, end):
            h = h * tc.MUL + items[at + j]
        done = end
        out.append(tc.mix(h))
    return out


@dataclass
class Subtree:
    """A suffix tree down to the window: leaves in their order, and internal nodes as ranges of leaves."""

    leaf: np.ndarray  # the suffix of each leaf
    depth: np.ndarray  # of each internal node, in words
    left: np.ndarray  # its first leaf, and the one after its last
    right: np.ndarray
    parent: np.ndarray  # the next node above it; -1 below the root

    def repeats(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves below the nodes that are ``window`` deep, and the node of each."""
        deep = np.flatnonzero(self.depth >= window)
        size = self.right[deep] - self.left[deep]
        at = np.repeat(self.left[deep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.leaf[at], np.repeat(deep, size)


def subtree(edges: list[np.ndarray], ends: list[int]) -> Subtree:
    """The tree of suffixes from the hashes of their paths to the depths ``ends``."""
    leaf = np.lexsort(edges[::-1]) if len(edges[0]) else np.zeros(0, np.int64)
    same, agree = np.ones(max(0, len(leaf) - 1), bool), np.zeros(max(0, len(leaf) - 1), np.int8)
    for e in edges:
        e = e[leaf]
        same &= e[1:] == e[:-1]
        agree += same
    depth, left, right, parent = [], [], [], []
    above, nodes = np.full(len(leaf), -1), 0  # the deepest node so far over each leaf
    for level, end in enumerate(ends, 1):
        begin, stop = tc.runs(agree >= level)
        if len(begin):
            branches = np.minimum.reduceat(agree, begin) if level < len(ends) else np.full(len(begin), level)
            # reduceat runs on to the next range, through neighbours that agree less
            low = [int(agree[x:y].min()) for x, y in zip(begin[branches < level].tolist(), stop[branches < level].tolist())]
            branches[branches < level] = low
            own = branches == level  # the others branch further down only: no node here
            begin, stop = begin[own], stop[own] + 1
            depth.append(np.full(len(begin), end))
            left.append(begin)
            right.append(stop)
            parent.append(above[begin])
            size = stop - begin
            above[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(nodes + np.arange(len(begin)), size)
            nodes += len(begin)
    return Subtree(leaf, *(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (depth, left, right, parent)))


def _prefix(items: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = items[at].copy()
    for j in range(1, n):
        h = h * tc.MUL + items[at + j]
    return tc.mix(h + tc.U(n))


def _heavy_prefixes(src: DataFrame, total: int, window: int) -> np.ndarray:
    def values(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        s = rp.open_slice(buf, offs, rp.Unit(True, window, 5))
        out = []
        for n in PREFIXES:
            if n < window and len(s.items) >= n:
                at = np.flatnonzero(tc.within(s.offs, n, len(s.items)))
                doc = tc.owners(s.offs)[at].astype(tc.U)
                h = _prefix(s.items, at, n)
                _, one = np.unique(tc.mix(h ^ tc.mix(doc)), return_index=True)
                out.append(h[one])
        return np.concatenate(out) if out else np.zeros(0, tc.U)

    return np.sort(np.array(rp.sample_counts(src, total, values), np.int64).view(tc.U))


def _flags(docs: DataFrame, id_col: str, text_col: str, who: tuple, window: int) -> DataFrame:
    spark = docs.sparkSession
    src = rp.prepare(docs, id_col, text_col, who)
    total, size = rp.size_of(src)
    n, unit = ex.partitions(spark, size), rp.Unit(True, window, max(1, (window + 1) // 3 + 1))
    keys, kinds = ex.part_keys(n), [f"<u{b // 8}" for b in EDGE_BITS]
    hot = spark.sparkContext.broadcast(rp.hot_anchors(src, total, unit))
    heavy = spark.sparkContext.broadcast(_heavy_prefixes(src, total, window))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = ex.Packer(n, keys)
        for b, buf, offs in rp._texts(batches, True):
            s = rp.open_slice(buf, offs, unit)
            whole, own = b.column("whole").to_numpy(zero_copy_only=False), rp.who_of(b)
            yield from pack.add(*rp.with_part(rp.whole_copies(own, np.diff(s.offs), whole, window), n), kind=1)
            at, _, _ = rp.candidates(s, unit, b.column("data").to_pylist(), whole)
            doc = np.searchsorted(s.offs, at, "right") - 1
            edges = _edges(s.items, at, window)
            gone = _here_before(s.items, at, edges[-1], rp.pick(own, doc), window)  # an earlier document of this slice has it
            yield from pack.add(*rp.with_part(rp.flag_runs(rp.pick(own, doc[gone]), at[gone] - s.offs[doc[gone]]), n), kind=1)
            at, doc, edges = at[~gone], doc[~gone], [e[~gone] for e in edges]
            route = np.zeros(len(at), tc.U)
            todo = np.arange(len(at))
            for length in (*(p for p in PREFIXES if p < window), window):
                h = _prefix(s.items, at[todo], length)
                route[todo] = h
                todo = todo[tc.member(h, heavy.value)] if length < window else todo[:0]
            yield from pack.add((route % tc.U(n)).astype(np.int64), *((e >> tc.U(64 - b)).astype(k) for e, b, k in zip(edges, EDGE_BITS, kinds)), *rp.pick(own, doc), (at - s.offs[doc]).astype(np.uint32))
        yield from pack.flush()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ex.gather(batches, {0: [*kinds, *rp.WHO, "<u4"], 1: rp.FLAGS})
        pack = ex.Packer(n, keys)
        yield from pack.add(*rp.with_part(tuple(got[1]), n))
        edges, own, pos = got[0][: len(kinds)], tuple(got[0][len(kinds) : -1]), got[0][-1]
        leaf, node = subtree(edges, _ends(window)).repeats(window)
        leaf = leaf[rp.not_first(node, rp.pick(own, leaf), None)]
        yield from pack.add(*rp.with_part(rp.flag_runs(rp.pick(own, leaf), pos[leaf]), n))
        yield from pack.flush()

    found = ex.deal(rp.joined(src, unit, hot.value, n).mapInArrow(suffixes, ex.SCHEMA), n).mapInArrow(grow, ex.SCHEMA)
    return rp.flags_by_document(found, n)


def _here_before(items: np.ndarray, at: np.ndarray, path: np.ndarray, who: rp.Who, window: int) -> np.ndarray:
    """Which suffixes an earlier document of the slice has too, compared word by word."""
    gone = np.zeros(len(at), bool)
    some = np.flatnonzero(tc.repeated(path))
    if len(some):
        _, head, group = np.unique(path[some], return_index=True, return_inverse=True)
        like = at[some[head]][group]
        same = np.ones(len(some), bool)
        for j in range(window):
            same &= items[at[some] + j] == items[like + j]
        some, group = some[same], group[same]
        gone[some[rp.not_first(group, rp.pick(who, some), None)]] = True
    return gone


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    who = rp.identity(docs, id_col, text_col)
    flags = _flags(docs, id_col, text_col, who, window)
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), *(c.alias(k) for c, k in zip(who, rp.KEY)))
    return named.join(flags.hint("merge"), list(rp.KEY), "left")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Maximal repeats that a document of a smaller id has too: ``id, start, n_words``, a row for each and for each row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_x"))
    df = _marked(slim, "_i", "_x", window).where("data is not null").select("c0", F.coalesce("c1", F.lit("")).alias("_t"), "data")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in rp._texts(batches):
            total = np.diff(tc.word_bounds(buf, offs)[2]).tolist()
            found = [tc.runs(rp.removed(d, k, window)) for d, k in zip(b.column("data").to_pylist(), total)]
            row = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            first, last = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in ([x for x, _ in found], [y for _, y in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(first), pa.array(last - first)], names=[id_col, "start", "n_words"])

    return df.mapInArrow(run, f"`{id_col}` {kind}, start long, n_words long")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 of the kept words joined by a space."""
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_x"))
    df = _marked(slim, "_i", "_x", window).select("c0", F.coalesce("c1", F.lit("")).alias("_t"), "data")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in rp._texts(batches):
            words, gone, sha = [], [], []
            for text in _kept(b, buf, offs, window, words, gone):
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return df.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def _kept(b: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, window: int, words: list, gone: list) -> Iterator[bytes]:
    """The kept words of each document, joined by a space; notes the counts."""
    starts, ends, woffs = tc.word_bounds(buf, offs)
    data = b.column("data").to_pylist()
    drop = np.concatenate([rp.removed(d, int(n), window) for d, n in zip(data, np.diff(woffs))]) if len(data) else np.zeros(0, bool)
    stay = np.flatnonzero(~drop)
    size = ends[stay] - starts[stay] + 1
    total = np.concatenate([[0], np.cumsum(size)])
    src = np.repeat(starts[stay] - total[:-1], size) + np.arange(total[-1])
    spaced = np.concatenate([buf, [32]]).astype(np.uint8)[src]
    spaced[total[1:] - 1] = 32
    cut = total[np.searchsorted(stay, woffs)]
    count = np.concatenate([[0], np.cumsum(drop)])[woffs]
    words += np.diff(woffs).tolist()
    gone += np.diff(count).tolist()
    for a, e in zip(cut.tolist(), cut[1:].tolist()):
        yield spaced[a : e - 1].tobytes() if e > a else b""


def _cut(b: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, window: int) -> Iterator[bytes]:
    """Each text without its removed words and the white space after them."""
    starts, _, woffs = tc.word_bounds(buf, offs)
    data = b.column("data").to_pylist()
    for d, (a, e) in enumerate(zip(woffs.tolist(), woffs[1:].tolist())):
        text = buf[offs[d] : offs[d + 1]]
        if data[d]:
            gone = np.zeros(len(text), bool)
            first, last = tc.runs(rp.removed(data[d], e - a, window))
            edge = np.append(starts[a:e] - offs[d], len(text))
            for x, y in zip(edge[first].tolist(), edge[last].tolist()):
                gone[x:y] = True
            text = text[~gone]
        yield text.tobytes()


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages, and the white space after them, cut out; all other texts and columns stay."""
    df = _marked(docs, id_col, text_col, window)
    cols, at = docs.columns, docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(cols))]
    touched = df.select(*names, F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")).alias("_t"), "data")
    out_schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs in rp._texts(batches):
            old = b.column(names[at])
            new = [o if not d else k.decode("utf-8", "replace") for o, d, k in zip(old.to_pylist(), b.column("data").to_pylist(), _cut(b, buf, offs, window))]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if c == names[at] else b.column(c) for c in names], names=names)

    return touched.mapInArrow(run, out_schema).toDF(*cols)
