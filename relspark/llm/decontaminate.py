"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item if some passage of it is within edit distance
``EDIT_SHARE`` of the item's length, both lower-cased (A-Z) with white space runs
as one blank. The CGK random walk copies characters of a string to an output while a shared random
function says when to step on; strings of small edit distance get outputs
of small Hamming distance. Sampled output positions are hash keys (LSH for Hamming
distance), and several walks and samples reach the target recall.

Windows as long as an item's pieces start at every word of the items and of the documents:
pieces have 64 characters, those of an item of under 64 have 32, and of under 32 have 16;
each such class of items has blocks of its own, so an item is searched alike whatever
others there are. A leak of d edits has pieces with far fewer, so
some piece may meet its twin. Document windows that can't
be within 4 edits of any piece, as too few of their 8-grams are the items',
are not embedded. A hit gives the place where the whole item would lie, and the exact edit
distance there (bit-parallel) decides.

Walks find leaks of many edits by chance only, and edits spread evenly leave no window
under that filter. So that none is missed, an item that may have k edits is also cut in
k + 1 parts, at least one of which stands unchanged in a leak. Places of a part's first 8
bytes are candidates too, if the stretch of up to 6 parts about it is there with fewer edits
than it has parts; of the stretches of a leak, one always is.

Items are taken in blocks of bounded size, each a file in the shared folder. A task holds some
megabytes of documents and takes one block after another, so a large benchmark is
neither a large broadcast nor many passes over the documents.

Defined cases: a null or empty text leaks nothing; items shorter than ``shortest`` (16 bytes, unless
told otherwise) or null are no evidence; where items under 16 bytes are wanted, they are looked up
exactly, as whole words; rows are judged one by one; repeated items each count; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import textcore as tc

EDIT_SHARE = 0.10
#: Characters of a piece, of a gram, and edits in a piece that the gram filter must let through.
PIECE, GRAM, PIECE_EDITS = 64, 8, 4
SHORTEST = 16
CLASSES = (PIECE, PIECE // 2, SHORTEST)
#: Walks, samples of each walk, and positions in a sample; what they miss is found by unchanged parts.
WALKS, SAMPLES, POSITIONS = 6, 4, 14
#: Bytes of a part that are looked up (at most a word of 64 bits), and parts in a stretch (at most 64 bytes).
SEED, STRETCH = 8, 6
#: Candidates compared at once.
CHUNK = 1 << 14
#: Bytes of items in a block (their index takes about seventy times that in a worker), blocks that a worker keeps, and bytes of documents held for a round of all blocks.
BLOCK_BYTES, KEPT, HELD_BYTES = 1 << 20, 2, 32 << 20


def fold(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, white space runs as one blank, none at either end of a document."""
    starts, ends, woffs = tc.word_bounds(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    low = np.append(tc.lower_ascii(buf), np.uint8(32))
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = low[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    out[at[1:] - 1] = 32
    return out, at[woffs]  # each word with one blank after it


def walk(text: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK outputs of the windows ``start``..``end`` of a text, a row each."""
    rng = np.random.default_rng(seed)
    move = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
    out = np.zeros((steps, len(start)), np.uint8)
    at = start.copy()
    pad = np.append(text, np.uint8(0))
    for j in range(steps):
        c = np.where(at < end, pad[np.minimum(at, len(text))], 0)
        out[j] = c
        at += move[j][c]
    return out


def sample_keys(out: np.ndarray, seed: int, within: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed + 1)
    for k in range(SAMPLES):
        pick = np.sort(rng.choice(within, POSITIONS, replace=False))
        h = np.full(out.shape[1], tc.U(seed * 64 + k + 1))
        for p in pick:
            h = h * tc.MUL + out[p].astype(tc.U) + tc.U(1)
        yield tc.mix(h)


@dataclass
class Index:
    """Pieces of a block of items."""

    ids: list
    texts: list[bytes]
    piece: int
    grams: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # sorted keys and their pieces, by walk and sample
    item: np.ndarray  # of a piece
    offset: np.ndarray
    seeds: dict[int, tuple[np.ndarray, ...]]  # by length: sorted bytes, and their stretch, item, and places in both
    stretch: np.ndarray  # for each byte (7 bits), where a stretch has it
    size: np.ndarray  # of a stretch
    spare: np.ndarray  # edits that a stretch may have
    exact: dict[bytes, list]  # items that are looked up whole, and their ids


def grams8(text: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM = 8 bytes."""
    if len(text) < GRAM:
        return np.zeros(0, tc.U)
    view = np.lib.stride_tricks.sliding_window_view(text, GRAM)
    return tc.mix(np.ascontiguousarray(view).view(tc.U)[:, 0])


def words_at(text: np.ndarray, size: int) -> np.ndarray:
    """All runs of ``size`` <= 8 bytes as numbers."""
    if len(text) < size:
        return np.zeros(0, tc.U)
    pad = np.append(text, np.zeros(8 - size, np.uint8))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad, 8)).view(tc.U)[:, 0] & tc._MASK[size]


def seeds_of(texts: list[bytes]) -> tuple[dict[int, tuple[np.ndarray, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the items by the length that is looked up, and the stretches that they stand in."""
    parts: dict[int, list] = {}
    stretches, spare = [], []
    for i, t in enumerate(texts):
        n = int(EDIT_SHARE * len(t)) + 1
        cut = [len(t) * j // n for j in range(n + 1)]
        many = -(-n // STRETCH)
        for k in range(many):
            a, b = n * k // many, n * (k + 1) // many
            for j in range(a, b):
                size = min(SEED, cut[j + 1] - cut[j])
                word = int.from_bytes(t[cut[j] : cut[j] + size], "little")
                parts.setdefault(size, []).append((word, len(stretches), i, cut[j] - cut[a], cut[j]))
            stretches.append(t[cut[a] : cut[b]])
            spare.append(b - a - 1)
    seeds = {}
    for size, rows in parts.items():
        rows.sort()
        seeds[size] = (np.array([r[0] for r in rows], tc.U), *(np.array([r[c] for r in rows], np.int64) for c in range(1, 5)))
    masks = np.zeros((len(stretches), 128), tc.U)
    for row, t in zip(masks, stretches):
        for j, c in enumerate(t):
            row[c & 127] |= tc.U(1 << j)
    return seeds, masks, np.array(list(map(len, stretches)), np.int64), np.array(spare, np.int64)


def close(index: Index, which: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether stretches lie about ``start`` in a text with no more edits than they may have (as ``least_edits``, many at once)."""
    spare, one = index.spare[which], tc.U(1)
    score = index.size[which]
    best, high = score.copy(), (score - 1).astype(tc.U)
    pv, mv = np.full(len(which), ~tc.U(0)), np.zeros(len(which), tc.U)
    masks, row = index.stretch.reshape(-1), which * 128
    first = start - spare
    for j in range(int((score + 2 * spare).max()) if len(which) else 0):
        at = first + j
        eq = masks[row + (text[np.clip(at, 0, len(text) - 1)] & 127)]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + (ph >> high & one).astype(np.int64) - (mh >> high & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best <= spare


def unchanged(index: Index, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates from parts that stand unchanged in a text: where the part is, the item, and where it would begin."""
    for size, (words, which, item, inner, outer) in index.seeds.items():
        key = words_at(text, size)
        mixed = np.unique(tc.mix(words))
        at = np.flatnonzero(tc.member(tc.mix(key), mixed))
        a, b = np.searchsorted(words, key[at]), np.searchsorted(words, key[at], "right")
        ends = np.cumsum(b - a)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
            n = (b - a)[lo:hi]
            pos = np.repeat(at[lo:hi], n)
            seed = np.repeat(a[lo:hi] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            ok = close(index, which[seed], text, pos - inner[seed])
            pos, seed = pos[ok], seed[ok]
            yield pos, item[seed], pos - outer[seed]
            lo = hi


def exact_index(ids: list, texts: list[bytes]) -> Index:
    """Items that are looked up whole."""
    exact: dict[bytes, list] = {}
    for i, t in zip(ids, texts):
        exact.setdefault(t, []).append(i)
    none = np.zeros(0, np.int64)
    return Index([], [], 0, none, [], none, none, {}, none, none, none, exact)


def whole_words(index: Index, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, object, int]]:
    """Where the exact items stand in a folded text, as whole words."""
    start = np.flatnonzero(np.r_[True, text[:-1] == 32])
    by_size: dict[int, list[bytes]] = {}
    for t in index.exact:
        by_size.setdefault(len(t), []).append(t)
    for size, items in by_size.items():
        part = min(8, size)
        s = start[start + size < len(text)]
        s = s[text[s + size] == 32]
        s = s[np.searchsorted(at, s, "right") == np.searchsorted(at, s + size, "right")]
        words = words_at(text, part)
        name = tc.mix(words[s] + tc.mix(words[s + size - part]))
        mine = [np.frombuffer(t, np.uint8) for t in items]
        known = np.array([tc.mix(words_at(m, part)[:1] + tc.mix(words_at(m, part)[-1:]))[0] for m in mine], tc.U)
        order = np.argsort(known)
        hit = np.flatnonzero(tc.member(name, known[order]))
        which = order[np.searchsorted(known[order], name[hit])]
        found = np.unique(np.stack([np.searchsorted(at, s[hit], "right") - 1, which]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
        for d, k in found.T.tolist():
            for i in index.exact[items[k]]:
                yield d, i, 0


def build(ids: list, texts: list[bytes]) -> Index:
    """The index of items of 16 bytes and more; they should be of one class."""
    piece = next(c for c in CLASSES if c <= min(map(len, texts)))
    text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = ends - [len(t) for t in texts]
    start = np.flatnonzero(np.r_[True, text[:-1] == 32])
    item = np.searchsorted(ends, start, "right")
    fits = (item < len(texts)) & (start + piece <= ends[np.minimum(item, len(texts) - 1)])
    start, item = start[fits], item[fits]
    tables = []
    for seed in range(WALKS):
        out = walk(text, start, start + piece, 2 * piece, seed)
        for key in sample_keys(out, seed, 3 * piece // 2):
            order = np.argsort(key)
            tables.append((key[order], order))
    owned = np.concatenate([grams8(np.frombuffer(t, np.uint8)) for t in texts])
    return Index(ids, texts, piece, np.unique(owned), tables, item, start - begins[item], *seeds_of(texts), {})


def least_edits(item: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of the item to any substring of the text, if at most ``most`` (bit-parallel)."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, score)
    return best if best <= most else None


def search(index: Index, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, object, int]]:
    """``(document, item id, edits)`` of the leaks in a slice."""
    yield from search_folded(index, *fold(buf, offs))


def search_folded(index: Index, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, object, int]]:
    piece = index.piece
    if not len(text):
        return
    if index.exact:
        yield from whole_words(index, text, at)
        return
    g = grams8(text)
    # Windows with enough of the items' grams: GRAM grams are lost with each edit.
    hit = np.concatenate([[0], np.cumsum(tc.member(g, index.grams))])
    need = max(1, piece - GRAM + 1 - GRAM * min(PIECE_EDITS, piece // (2 * GRAM)))
    start = np.flatnonzero(np.r_[True, text[:-1] == 32])
    last = np.minimum(start + piece - GRAM + 1, len(g))
    start = start[(hit[np.maximum(last, np.minimum(start, len(g)))] - hit[np.minimum(start, len(g))]) >= need]
    doc = np.searchsorted(at, start, "right") - 1
    found: set[tuple[int, int, int]] = set()
    for lo in range(0, len(start), 100_000):
        s, d = start[lo : lo + 100_000], doc[lo : lo + 100_000]
        table = 0
        for seed in range(WALKS):
            out = walk(text, s, np.minimum(s + piece, at[d + 1]), 2 * piece, seed)
            for key in sample_keys(out, seed, 3 * piece // 2):
                keys, pieces = index.tables[table]
                table += 1
                a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                rows = np.flatnonzero(b > a)
                n = (b - a)[rows]
                if not len(rows):
                    continue
                p = pieces[np.repeat(a[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                row = np.repeat(rows, n)
                place = (s[row] - at[d[row]] - index.offset[p]) >> 4  # about where the item begins
                found.update(zip(d[row].tolist(), index.item[p].tolist(), place.tolist()))
    for pos, item, begin in unchanged(index, text):
        d = np.searchsorted(at, pos, "right") - 1
        found.update(zip(d.tolist(), item.tolist(), (begin - at[d] >> 4).tolist()))
    best: dict[tuple[int, int], int] = {}
    for d, i, place in sorted(found):
        item = index.texts[i]
        most = int(EDIT_SHARE * len(item))
        if best.get((d, i), most + 1) == 0:
            continue
        a, e = int(at[d]), int(at[d + 1]) - 1  # without the blank after the last word
        lo = max(a, a + place * 16 - 2 * most - 8)
        hi = min(e, a + place * 16 + 16 + len(item) + 2 * most + 8)
        edits = least_edits(item, text[lo:hi].tobytes(), most)
        if edits is not None:
            best[d, i] = min(edits, best.get((d, i), edits))
    for (d, i), edits in best.items():
        yield d, index.ids[i], edits


def blocks(benchmark: DataFrame, item_col: str, text_col: str, shortest: int = SHORTEST) -> Iterator[Index]:
    """Indexes of the items, class by class, of about BLOCK_BYTES of items each (an item is never split)."""
    held: dict[int, tuple[list, list]] = {}
    size: dict[int, int] = {}

    def flush(c: int) -> Index:
        ids, texts = held.pop(c)
        size[c] = 0
        return build(ids, texts) if c else exact_index(ids, texts)

    rows = benchmark.select(F.col(item_col).try_cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        raw = np.frombuffer((r.t or "").encode(), np.uint8)
        t = fold(raw, np.array([0, len(raw)]))[0].tobytes()[:-1]
        if len(t) < max(1, shortest):
            continue
        c = next((c for c in CLASSES if c <= len(t)), 0)
        ids, texts = held.setdefault(c, ([], []))
        ids.append(r.i)
        texts.append(t)
        size[c] = size.get(c, 0) + len(t)
        if size[c] > BLOCK_BYTES:
            yield flush(c)
    for c in sorted(held):
        yield flush(c)


def stored_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, shortest: int) -> list[str]:
    """The blocks as files in the shared folder; the driver holds one at a time."""
    out = []
    for index in blocks(benchmark, item_col, text_col, shortest):
        out.append(store.fresh(spark, "benchmark-block"))
        store.put(out[-1], [pickle.dumps(index, protocol=5)])
    return out


_KEPT: dict[str, Index] = {}


def _block(uri: str) -> Index:
    if uri not in _KEPT:
        while len(_KEPT) >= KEPT:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[uri] = pickle.loads(store.array(uri, "u1").tobytes())
    return _KEPT[uri]


def searched(uris: list[str], batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, object, int]]]]:
    """Slices of the batches, and what their rows leak."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list]]:
        found: list[list] = [[] for _ in held]
        for uri in uris:
            index = _block(uri)
            for k, (_, text, at) in enumerate(held):
                found[k] += search_folded(index, text, at)
        yield from zip([b for b, _, _ in held], found)
        held.clear()

    for b in batches:
        buf, offs = tc.text_buffers(b.column(col))
        for i, j in tc.slices(offs):
            held.append((b.slice(i, j - i), *fold(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])))
            size += len(held[-1][1])
            if len(uris) <= KEPT or size > HELD_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Pairs ``id, item, edits``: documents and the items that they leak."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` long, edits int"
    uris = stored_blocks(spark, benchmark, item_col, item_text, shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in searched(uris, batches, 1):
            rows = pa.array([d for d, _, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([x for _, x, _ in got], pa.int64()), pa.array([e for _, _, e in got], pa.int32())], names=[id_col, item_col, "edits"])

    return slim.mapInArrow(run, schema) if uris else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without the rows that leak an item; columns as they were, no shuffle. Cases as in ``leaks``."""
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    at = cols.index(text_col)
    named = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    uris = stored_blocks(docs.sparkSession, benchmark, item_col, item_text, shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in searched(uris, batches, at):
            keep = np.ones(len(b), bool)
            keep[[d for d, _, _ in got]] = False
            yield b.filter(pa.array(keep))

    return named.mapInArrow(run, schema).toDF(*cols) if uris else docs
