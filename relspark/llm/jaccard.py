"""N-gram Jaccard join by universe partition and pigeonhole.

A document is its set of word shingles. Two sets of sizes r and s reach similarity
t only if their symmetric difference is at most H = (1-t)/(1+t) * (r+s). Shingles are
hashed into m segments, with m by size band: if the weights of the segments sum to
more than H, similar sets agree in one segment up to its weight - exactly for
weight 1, up to one deletion for weight 2. A document emits the subsets of its
segments (and their one-deletion neighbourhoods for weight 2); documents that share
one are candidates, and candidates are verified on the whole sets.

Allocation by cost: small bands use few segments of weight 2, as single small
subsets would be shared by chance; larger bands use weight 1, with 2*d segments more
than the pigeonhole needs, so that each document may leave out its d costliest
subsets (empty ones, then those whose rarest shingle is frequent around it). An empty
subset is never a key, as unrelated documents share it: a document whose keys would hold one
emits the shingles of its prefix instead (of n shingles in hash order the first
n - 0.8 n + 1, one of which similar sets always share).

Equal sets count as one node throughout. Subsets shared by a few nodes give all
pairs; those shared by many give a star and a chain first, and only what these
leave in different components is compared further. A candidate's parity sketch (a
bit for each of 4n cells; every shingle not shared flips one) gives a lower bound of the
symmetric difference, which rules most false candidates out before whole sets travel. Long lists are
compared in pairs of tiles, each a task of its own. ``link`` gives components: of the
members of a list that are connected already, it doesn't look at further links.
No cap drops a link between components.

Defined cases: fewer words than a shingle has make one shingle of all; no words or
a null text make an empty set, linked with nothing; null ids form links but never name
a component of others; rows are kept as they are, repeated ones link with each other;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import store
from . import textcore as tc

SHINGLE, NUM, DEN = 5, 80, 100
#: Nodes that share a subset and are compared pair by pair at once; more of them are linked up first.
PAIRWISE = 12
#: Bands whose H is at most this use segments of weight 2.
SMALL_H = 6
#: Subsets that may be left out, in percent of those that the pigeonhole needs: about as many as are empty at a band's lower end.
SPARE_PERCENT = 12


@dataclass(frozen=True)
class Plan:
    segments: int
    weight: int
    spare: int  # subsets that a document may leave out


@lru_cache(None)
def bands(limit: int) -> np.ndarray:
    """Largest sizes of the bands; similar sets lie in the same band or neighbours."""
    out, lo = [], 1
    while not out or out[-1] < limit:
        out.append(lo * DEN // NUM)
        lo = out[-1] + 1
    return np.array(out)


@lru_cache(None)
def plan(band: int) -> Plan | None:
    """For pairs with the smaller set in ``band``."""
    hi = int(bands(1 << 40)[band])
    most = (DEN - NUM) * (hi + hi * DEN // NUM) // (DEN + NUM)
    if most == 0:
        return None  # only equal sets
    if most <= SMALL_H:
        return Plan(-(-(most + 1) // 2), 2, 0)
    spare = 2 + (most + 1) * SPARE_PERCENT // 100
    return Plan(most + 1 + 2 * spare, 1, spare)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: each document's distinct shingles, ascending."""
    buf = tc.lower_ascii(buf)
    starts, ends, woffs = tc.word_bounds(buf, offs)
    h = tc.span_hash(buf, starts, ends)
    size = np.diff(woffs)
    inside = tc.within(woffs, SHINGLE, len(h))
    doc, g = tc.owners(woffs)[: len(inside)][inside], tc.grams(h, SHINGLE)[inside]
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    whole = np.array([int(tc.grams(h[woffs[d] : woffs[d + 1]], int(size[d]))[0]) ^ (int(size[d]) << 60) for d in few], np.uint64)
    doc, g = np.concatenate([doc, few]), np.concatenate([g, whole])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[fresh], g[fresh]
    return g, np.searchsorted(doc, np.arange(len(offs)))


def set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, tc.U), np.cumsum(tc.mix(g ^ tc.MUL), dtype=tc.U)])
    n = np.diff(at)
    sid = tc.mix((total[at[1:]] - total[at[:-1]]) ^ (n.astype(tc.U) << tc.U(40)))
    return np.where(n > 0, np.maximum(sid, tc.U(1)), tc.U(0))


def signatures(g: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(document, key)`` arrays, a pair for each band plan: similar sets share a key."""
    size = np.diff(at)
    if not len(g):
        return
    edges = bands(max(64, int(size.max()) * 2))
    band = np.searchsorted(edges, np.maximum(size, 1))
    order = np.argsort(g)
    run = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1], True])
    freq = np.empty(len(g), np.int32)
    freq[order] = np.repeat(np.diff(run), np.diff(run))
    place = tc.mix(g ^ tc.mix(np.full(1, 77, tc.U))[0])
    bare = np.zeros(len(size), bool)
    for k in np.unique(band[size > 0]).tolist():
        for group in (k, k - 1):
            p = plan(group) if group >= 0 else None
            docs = np.flatnonzero((band == k) & (size > 0))
            if p is None:
                continue
            count = size[docs]
            src = np.repeat(at[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            cell = np.repeat(np.arange(len(docs)) * p.segments, count) + ((place[src] >> tc.U(32)) * tc.U(p.segments) >> tc.U(32)).astype(np.int64)
            cells = len(docs) * p.segments
            value = tc.mix(place[src] + tc.MUL)
            by = np.argsort(cell, kind="stable")
            cell, value, f = cell[by], value[by], freq[src][by]
            first = np.searchsorted(cell, np.arange(cells + 1))
            running = np.concatenate([np.zeros(1, tc.U), np.cumsum(value, dtype=tc.U)])
            total = running[first[1:]] - running[first[:-1]]
            n = np.diff(first)
            seed = tc.mix((np.arange(cells) % p.segments).astype(tc.U) + tc.U(group << 32))
            cost = np.full(cells, np.iinfo(np.int32).max, np.int32)
            full = np.flatnonzero(n)
            cost[full] = np.minimum.reduceat(f, first[:-1][full]) if len(full) else 0
            keep = np.ones((len(docs), p.segments), bool)
            if p.spare:
                worst = np.argpartition(-cost.reshape(len(docs), p.segments), p.spare - 1, axis=1)[:, : p.spare]
                np.put_along_axis(keep, worst, False, axis=1)
            keep = keep.ravel()
            void = n <= p.weight - 1  # agrees with other void subsets by being empty, if need be up to a deletion
            bare[docs[np.flatnonzero(keep & void) // p.segments]] = True
            keep &= n > 0
            key = tc.mix(total ^ seed)
            yield docs[np.flatnonzero(keep) // p.segments], key[keep]
            if p.weight == 2:
                some = ~void[cell]
                less = tc.mix((total[cell] - value) ^ seed[cell])
                yield docs[cell[some] // p.segments], less[some]
    docs = np.flatnonzero(bare)
    count = size[docs] - -(-NUM * size[docs] // DEN) + 1
    doc = np.repeat(docs, count)
    first = np.repeat(at[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())  # shingles ascend
    yield doc, tc.mix(g[first] + tc.mix(np.full(1, 99, tc.U))[0])


def _known(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).try_cast("long").alias("_id"), F.xxhash64(text).alias("_fp"), text.alias("_t"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        buf, offs = tc.text_buffers(b.column("_t"))
        for i, j in tc.slices(offs):
            g, at = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield b.slice(i, j - i), g, at, set_ids(g, at)
    tc.release()


def _info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, _, at, sid in _sets(batches):
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_fp"), pa.array(sid.view(np.int64)), pa.array(np.diff(at))], names=["_id", "_fp", "sid", "n"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def pairs_of(key: np.ndarray, sid: np.ndarray, n: np.ndarray, pairwise: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of nodes that share keys; members (list of nodes, sid) of keys with more than ``pairwise`` nodes."""
    some = np.flatnonzero(tc.repeated(key)) if len(key) else np.zeros(0, np.int64)
    order = some[np.lexsort((sid[some], n[some], key[some]))]
    k, s = key[order], sid[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    order = order[fresh]
    k, s, m = key[order], sid[order], n[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(k)])
    own = np.repeat(size, size)
    left, right = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = _near(m[i], m[j])
        left.append(s[i[ok]])
        right.append(s[j[ok]])

    longest = int(size.max()) if len(size) else 0
    for d in range(1, min(longest, pairwise)):
        i = np.flatnonzero((k[d:] == k[:-d]) & (own[d:] <= pairwise))
        take(i, i + d)
    big, bucket = np.zeros(0, np.int64), np.zeros(0, tc.U)
    if len(head) and (size > pairwise).any():
        lists = np.add.reduceat(tc.mix(s), head)  # many keys have the same nodes: one list of them is enough
        large, wanted = np.flatnonzero(size > pairwise), np.zeros(len(head), bool)
        wanted[large[np.unique(lists[large], return_index=True)[1]]] = True
        big = np.flatnonzero(np.repeat(wanted, size))
        bucket = np.repeat(lists, size)[big]
        i = big[:-1][k[big[1:]] == k[big[:-1]]]
        take(i, i + 1)
        take(np.repeat(head, size)[big], big)
    a, b = (np.concatenate(x) if x else np.zeros(0, tc.U) for x in (left, right))
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[one], b[one]
    return a, b, bucket, s[big]


_KEYS = ["<u4", "<u8", "<u4"]


def _pairs_frame(dealt: DataFrame, n: int) -> DataFrame:
    """Distinct candidate pairs ``a, b`` from dealt blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ex.gather(batches, {0: ["<u8", "<u8"]})[0]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64))], names=["a", "b"])

    return ex.deal(dealt.select("p", "kind", "data"), n).mapInArrow(run, "a long, b long")


def _candidates(src: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs, and the members ``bucket, sid`` of subsets that many nodes share."""
    keys = ex.part_keys(n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = ex.Packer(n, keys)
        for _, g, at, sid in _sets(batches):
            size = np.diff(at)
            _, one = np.unique(sid, return_index=True)  # equal sets of a slice speak once
            first = np.zeros(len(sid), bool)
            first[one] = True
            for doc, key in signatures(g, at):
                said = first[doc]
                doc, key = doc[said], key[said]
                yield from pack.add((key % tc.U(n)).astype(np.int64), (key >> tc.U(32)).astype(np.uint32), sid[doc], size[doc].astype(np.uint32))
        yield from pack.flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sid, size = ex.gather(batches, {0: _KEYS})[0]
        pack = ex.Packer(n, keys)
        a, b, bucket, member = pairs_of(key.astype(tc.U) << tc.U(32), sid, size.astype(np.int64), PAIRWISE)
        yield from pack.add((tc.mix(a) % tc.U(n)).astype(np.int64), a, b)
        yield from pack.add((tc.mix(member) % tc.U(n)).astype(np.int64), bucket, member, kind=1)
        yield from pack.flush()

    found = store.settle(ex.deal(src.mapInArrow(emit, ex.SCHEMA), n).mapInArrow(match, ex.SCHEMA), "jaccard-candidates")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                bucket, sid = ex.unpack(data, ["<u8", "<u8"])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(sid.view(np.int64))], names=["bucket", "sid"])

    return store.settle(_pairs_frame(found.where("kind = 0"), n), "jaccard-pairs"), found.where("kind = 1").mapInArrow(members, "bucket long, sid long")


def sketch(g: np.ndarray) -> bytes:
    """The parity of the set's hashes in each of about 4n cells, as bits: each shingle that two sets don't share flips one."""
    width = max(256, 1 << int(4 * len(g) - 1).bit_length())
    return np.packbits(np.bincount((g >> tc.U(20)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A sketch in ``width`` bytes: its halves (cells of equal low bits) together."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0)


def apart(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """True where sketches prove that sets of ``total`` shingles together are not similar."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) > (DEN - NUM) * total // (DEN + NUM)


def _set_table(src: DataFrame, info: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, set`` of the wanted nodes, each from one document that has the set."""
    one = info.join(wanted, "sid").groupBy("sid").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_fp")).alias("d")).select("sid", F.col("d._id").alias("_id"), F.col("d._fp").alias("_fp"))
    texts = src.join(one.hint("merge"), src["_id"].eqNullSafe(one["_id"]) & (src["_fp"] == one["_fp"])).select("sid", src["_t"].alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, g, at, _ in _sets(batches):
            cut = list(zip(at.tolist(), at[1:].tolist()))
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(np.diff(at)), pa.array([sketch(g[x:y]) for x, y in cut], pa.binary()), pa.array([g[x:y].tobytes() for x, y in cut], pa.binary())], names=["sid", "n", "sketch", "set"])

    return store.settle(texts.mapInArrow(run, "sid long, n long, sketch binary, set binary"), "jaccard-sets")


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, tc.U), np.frombuffer(b, tc.U)
    small, big = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    same = int((big[at] == small).sum())
    return DEN * same >= NUM * (len(x) + len(y) - same)


def _may_be(a: tuple[int, bytes], b: tuple[int, bytes]) -> bool:
    width = min(len(a[1]), len(b[1]))
    return not apart(folded(a[1], width), folded(b[1], width), np.array(a[0] + b[0]))


def _tested(pairs: DataFrame, sets: DataFrame, n: int, whole: bool) -> DataFrame:
    """The pairs whose sets are similar (``whole``) or whose sketches allow it. A node travels once to each partition that needs it."""
    data = F.col("set") if whole else F.col("sketch")
    slim = sets.select("sid", "n", data.alias("data"))
    part = F.pmod(F.xxhash64("b"), F.lit(n * 2)).cast("int")
    asked = pairs.groupBy("a", part.alias("q")).agg(F.collect_list("b").alias("bs"))
    asked = asked.join(slim.toDF("a", "an", "adata").hint("merge"), "a").select("q", "a", "an", "adata", "bs")
    held = slim.select(F.pmod(F.xxhash64("sid"), F.lit(n * 2)).cast("int").alias("q"), "sid", "n", "data")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        have = dict(zip(right.column("sid").to_pylist(), zip(right.column("n").to_pylist(), right.column("data").to_pylist())))
        out_a, out_b = [], []
        for a, size, data, bs in zip(*(left.column(c).to_pylist() for c in ("a", "an", "adata", "bs"))):
            for b in bs:
                if b in have and (_similar(data, have[b][1]) if whole else _may_be((size, data), have[b])):
                    out_a.append(a)
                    out_b.append(b)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return asked.groupBy("q").cogroup(held.groupBy("q")).applyInArrow(run, "a long, b long")


#: Nodes whose ids (8 bytes each) may be broadcast to pick their sets; more of them are joined by a shuffle.
BROADCAST_NODES = 250_000


def _similar_pairs(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The settled pairs whose whole sets are similar; only the sets they name travel."""
    ends = store.settle(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "jaccard-ends")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_NODES else ends.hint("merge")
    return _tested(pairs, sets.join(ends, "sid", "left_semi"), n, True)


def _verified(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The pairs whose sets are similar: sketches rule most others out, the whole sets decide."""
    return _similar_pairs(store.settle(_tested(pairs, sets, n, False), "jaccard-likely"), sets, n)


def components(edges: DataFrame) -> DataFrame:
    """``sid, comp`` for the ends of ``edges`` (a, b), by contraction to the least neighbour."""
    spark, maps = edges.sparkSession, []
    edges = store.settle(edges.where("a <> b").distinct(), "jaccard-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = store.settle(both.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("comp")), "jaccard-up")
        maps.append(up)
        x, y = up.toDF("a", "pa"), up.toDF("b", "pb")
        edges = store.settle(edges.join(x, "a").join(y, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "jaccard-edges")
    if not maps:
        return spark.createDataFrame([], "sid long, comp long")
    out = maps[0]
    for up in maps[1:]:
        out = out.join(up.toDF("comp", "next"), "comp", "left").select("sid", F.coalesce("next", "comp").alias("comp"))
    return store.settle(out, "jaccard-components")


#: Sketches compared with one another at once, and members of a list compared in one task (a long list is cut in tiles of half as many), in rows.
TILE, LIST_ROWS = 512, 8192


def cross_pairs(sid: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[bytes], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of one bucket, the pairs of different components (and sides, if given) that their sketches allow, tile by tile."""
    order = np.argsort(size, kind="stable")
    sid, comp, size = sid[order], comp[order], size[order]
    side = np.arange(len(sid)) if side is None else side[order]
    width = min(map(len, bits))
    cells = np.stack([folded(bits[i], width) for i in order])
    left, right = [], []
    for i in range(0, len(sid), TILE):
        most = int(np.searchsorted(size, int(size[min(i + TILE, len(sid)) - 1]) * DEN // NUM, "right"))
        for j in range(i, most, TILE):
            x, y = slice(i, min(i + TILE, len(sid))), slice(j, min(j + TILE, most))
            for r in range(x.start, x.stop):  # a row against a tile
                ok = (comp[y] != comp[r]) & (side[y] != side[r]) & (np.arange(y.start, y.stop) > r) & _near(size[y], size[r])
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[~apart(cells[y][at], cells[r], size[y][at] + size[r])]
                    left.append(np.full(len(at), sid[r]))
                    right.append(sid[y][at])
    a, b = (np.concatenate(v) if v else np.zeros(0, sid.dtype) for v in (left, right))
    return np.minimum(a, b), np.maximum(a, b)


def _further(members: DataFrame, comps: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Pairs of members of a bucket that are in different components and that sketches allow."""
    named = members.join(comps, "sid", "left").select("bucket", "sid", F.coalesce("comp", "sid").alias("comp"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y")
    mixed = store.settle(mixed.select("bucket", F.when(F.col("m") > LIST_ROWS, F.ceil(F.col("m") * 2 / LIST_ROWS)).otherwise(1).cast("int").alias("tiles")), "jaccard-mixed")
    rows = named.join(mixed, "bucket").join(sets.select("sid", "n", "sketch").hint("merge"), "sid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    rows = rows.select("bucket", "sid", "comp", "n", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sid", "comp", "n", "sketch", "own")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        bucket, lo, hi, sid, comp, size, own = (table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "sid", "comp", "n", "own"))
        bits = table.column("sketch")
        order = np.lexsort((hi, lo, bucket))
        key = np.stack([bucket[order], lo[order], hi[order]])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        for x, y in zip(cut.tolist(), cut[1:].tolist()):
            at = order[x:y]
            a, b = cross_pairs(sid[at], comp[at], size[at], bits.take(pa.array(at)).to_pylist(), own[at] if lo[at[0]] != hi[at[0]] else None)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition(n, "bucket", "lo", "hi").mapInArrow(match, "a long, b long").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, and ``_fp`` (a hash of the text)."""
    spark = docs.sparkSession
    src = _known(docs, id_col, text_col)
    n = ex.partitions(spark, src.agg(F.sum(F.octet_length("_t").cast("long"))).first()[0] or 0)
    info = store.settle(src.mapInArrow(_info, "_id long, _fp long, sid long, n long"), "jaccard-info")
    pairs, members = _candidates(src, n)
    members = store.settle(members.distinct(), "jaccard-members")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(members.select("sid")).distinct()
    sets = _set_table(src, info.where("n > 0"), ends)
    good = store.settle(_verified(pairs, sets, n), "jaccard-links")
    comps = components(good)
    more = store.settle(_further(members, comps, sets, n).join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    if not more.isEmpty():
        good = good.union(_similar_pairs(more, sets, n))
        comps = components(good)
    named = info.join(comps, "sid", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sid")))
    least = store.settle(named.where("n > 0").groupBy("comp").agg(F.min("_id").alias("least")), "jaccard-least")  # so that the join can split a large component
    return named.join(least, "comp", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"), "_fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id. Rows without words all stay."""
    linked = link(docs, id_col, text_col)
    blank = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    one = linked.where(~blank).groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_fp")).alias("d")).select(F.col(f"d.{id_col}").alias("_kid"), F.col("d._fp").alias("_kfp"))
    free = linked.where(blank).select(F.col(id_col).alias("_kid"), F.col("_fp").alias("_kfp"))
    kept = one.withColumn("_free", F.lit(False)).union(free.distinct().withColumn("_free", F.lit(True)))
    names = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*names).withColumns({"_fid": F.col(names[docs.columns.index(id_col)]).try_cast("long"), "_ffp": F.xxhash64(F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit("")))})
    joined = named.join(kept.hint("merge"), F.col("_fid").eqNullSafe(F.col("_kid")) & (F.col("_ffp") == F.col("_kfp")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("_fid", "_ffp").orderBy(F.lit(1)))  # only rows that repeat id and text share a partition
    return joined.withColumn("_r", rank).where(F.col("_free") | (F.col("_r") == 1)).select(*names).toDF(*docs.columns)
