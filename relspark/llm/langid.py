"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is cut greedily
into the longest phrases that occur in that text (Ziv-Merhav cross-parsing); with
n bytes of training text, a phrase costs log2(n) bits, and the language that
needs the fewest bits for a text's bytes wins. Both are parsed as words of letters in lower
case with a blank before, between and after them, in UTF-8; phrases run across words.

A parse is a walk through a table (state, byte) -> (state, phrases that end), so texts are
cut in segments that are all walked at once, each from the automaton's root. Where the
segment before ended in another state, the walk is repeated from that state until it meets
the first one, which takes some phrases only. The result is that of one walk over the whole text.

Languages are learned in blocks of bounded size, each a flat file in the shared folder (mapped into
memory where it can be, so that the workers of a machine share it), and every label is learned. The sample of labelled rows is bounded by ``SAMPLE_DOCS`` whole documents and
``SAMPLE_BYTES`` of text a language; documents larger than that are drawn only
where a language has no other (then a short one is).

Defined cases: a null text or one without a letter is ``und`` with score 0, and so
is every text where nothing is labelled; of languages that need the same bits the first in
alphabetical order wins, with score 0; rows are judged one by one, whatever rows share
their id; a null id counts as held out; repeated rows are drawn once; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from . import textcore as tc

UNKNOWN = "und"
#: Bounds of the labelled sample: whole documents, and bytes of text, a language.
SAMPLE_DOCS, SAMPLE_BYTES = 100, 48_000
#: Languages in a block, blocks that a task keeps, bytes of a segment, and bytes of text parsed at once.
BLOCK_LANGUAGES, KEPT, SEGMENT, AT_ONCE = 16, 2, 256, 1 << 20

#: Code points below this are looked up; above it stand ideographs, which have no case.
_LOOKED_UP = 0x20000


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, its kind (1: a mark, 2: a letter) and its small letter."""
    points = [chr(c) for c in range(_LOOKED_UP)]
    kind = np.array([2 if c.isalpha() else unicodedata.category(c)[0] == "M" for c in points], np.uint8)
    small = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in points], np.uint32)
    return kind, small


def plain(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as they are parsed, their offsets, and the letters of each."""
    kind_of, small_of = _tables()
    lead = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offs]  # offsets in code points
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = np.minimum(points, _LOOKED_UP - 1)
    kind, points = kind_of[low], np.where(points < _LOOKED_UP, small_of[low], points)
    for i in np.flatnonzero(points >= _LOOKED_UP).tolist():
        kind[i] = 2 * chr(points[i]).isalpha()
    letters = np.concatenate([[0], np.cumsum(kind == 2)])[at]
    word = kind > 0
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    # Each word has a blank before it, the last one of a document also behind it.
    words = np.concatenate([[0], np.cumsum(begins)])
    some = np.concatenate([[0], np.cumsum(words[at[1:]] > words[at[:-1]])])  # documents with a word
    kept = np.concatenate([[0], np.cumsum(word)])
    out = np.full(int(kept[-1] + words[-1] + some[-1]), 32, np.uint32)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    mine = np.flatnonzero(word)
    out[kept[mine] + words[mine + 1] + some[doc[mine]]] = points[mine]
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    text = np.frombuffer(out.tobytes().decode("utf-32-le", "replace").encode("utf-8"), np.uint8)
    return text, np.concatenate([[0], np.cumsum(width)])[kept[at] + words[at] + some], np.diff(letters)


@dataclass
class Automaton:
    """Where a byte leads from a state, and how many phrases end: ``step[state + code[byte]] = next << 2 | phrases``; state 0 is the root."""

    language: str
    code: np.ndarray
    step: np.ndarray
    bits: float  # of a phrase


def automaton(language: str, text: bytes) -> Automaton:
    """The suffix automaton of a text."""
    move: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in text:
        cur, p = len(move), last
        move.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if depth[q] != depth[p] + 1:
                twin = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                depth.append(depth[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[cur] = q
        last = cur
    used = sorted(set(text))
    width = len(used) + 1  # code 0: a byte that the text lacks
    code = np.zeros(256, np.int32)
    code[used] = np.arange(1, width)
    root = np.zeros(width, np.int64)
    for c, to in move[0].items():
        root[code[c]] = to * width
    # Without a way on, the phrase ends; the byte begins the next one, or is one by itself if the text lacks it.
    step = np.tile(np.where(root > 0, root << 2 | 1, 2), (len(move), 1))
    edges = np.array([(s, c, to) for s, out in enumerate(move) for c, to in out.items()], np.int64).reshape(-1, 3)
    step[edges[:, 0], code[edges[:, 1]]] = edges[:, 2] * width << 2
    step[0] = np.where(root > 0, root << 2, 1)
    return Automaton(language, code, step.ravel().astype(np.int32), float(np.log2(max(2, len(text)))))


def phrases(a: Automaton, text: np.ndarray, offs: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Phrases of each document."""
    size = np.diff(offs)
    per = -(-size // segment)
    if not per.sum():
        return np.zeros(len(size), np.int64)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[doc] + nth * segment
    length = np.minimum(segment, offs[doc + 1] - start)
    lane = np.argsort(-length, kind="stable")  # of the rows of the tables below, the segment
    start, length, nth, doc = start[lane], length[lane], nth[lane], doc[lane]
    place = np.empty(len(lane), np.int64)
    place[lane] = np.arange(len(lane))
    before = np.where(nth > 0, place[np.maximum(lane - 1, 0)], -1)  # the row of the segment before
    deep = int(length[0])
    live = np.searchsorted(-length, -np.arange(1, deep + 1), "right")
    code = a.code[np.append(text, np.zeros(deep, np.uint8))]
    here = np.zeros((deep, len(lane)), np.int32)
    after = np.zeros((deep, len(lane)), np.int32)
    ended = np.zeros((deep, len(lane)), np.uint8)
    state = np.zeros(len(lane), np.int32)
    for j in range(deep):
        m = int(live[j])
        here[j, :m] = code[start[:m] + j]
        v = a.step[state[:m] + here[j, :m]]
        np.right_shift(v, 2, out=state[:m])
        after[j, :m] = state[:m]
        ended[j, :m] = v & 3
    rows = np.arange(len(lane))
    entry = np.zeros(len(lane), np.int32)
    todo = np.flatnonzero(before >= 0)
    while len(todo):
        begin = after[length[before[todo]] - 1, before[todo]]
        todo, begin = todo[begin != entry[todo]], begin[begin != entry[todo]]
        entry[todo] = begin
        now, state, j, open_ = todo, begin, 0, []
        while len(now):  # until the walks meet
            v = a.step[state + here[j, now]]
            state = v >> 2
            ended[j, now] = v & 3
            apart = after[j, now] != state
            after[j, now] = state
            j += 1
            over = length[now] <= j
            open_.append(now[apart & over])
            now, state = now[apart & ~over], state[apart & ~over]
        changed = np.zeros(len(lane), bool)
        changed[np.concatenate(open_) if open_ else todo[:0]] = True
        todo = np.flatnonzero((before >= 0) & changed[before])
    count = np.bincount(doc, ended.sum(axis=0, dtype=np.int64), len(size)).astype(np.int64)
    final = nth + 1 == per[doc]
    return count + np.bincount(doc[final], after[length - 1, rows][final] != 0, len(size)).astype(np.int64)


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """The training text of each language: whole labelled documents that are not held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    slim = known.select(lang.alias("l"), F.octet_length(text).alias("n"), F.xxhash64(F.lit(11), F.col(id_col), text).alias("h"))
    fits = F.col("n") <= SAMPLE_BYTES
    stats = slim.groupBy("l").agg(F.approx_count_distinct(F.when(fits, F.col("h"))).alias("fit"), F.approx_count_distinct("h").alias("all"))
    # By hash, some times as many as are drawn, so that what is ranked doesn't grow with the input.
    share = F.lit(8.0 * SAMPLE_DOCS * (1 << 31)) / F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("all"))
    some = slim.join(F.broadcast(stats), "l").where((fits | (F.col("fit") == 0)) & (F.pmod("h", F.lit(1 << 31)) < share))  # stats: a row a language
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.when(~fits, F.col("n")), "h"))
    slim = some.select("l", "n", "h").distinct()
    drawn: dict[str, list] = {}
    for r in slim.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS).collect():  # SAMPLE_DOCS numbers a language
        drawn.setdefault(r.l, []).append((r.r, r.n, r.h))
    chosen: dict[int, tuple[str, int]] = {}
    for name, rows in drawn.items():
        room = SAMPLE_BYTES
        for r, n, h in sorted(rows):
            if n <= room or r == 1:
                chosen[h] = (name, r)
                room -= n
    if not chosen:
        return {}
    texts = known.select(F.xxhash64(F.lit(11), F.col(id_col), text).alias("h"), lang.alias("l"), text.alias("t")).where(F.col("h").isin(list(chosen))).groupBy("h", "l").agg(F.min("t").alias("t"))
    found: dict[str, list] = {}
    for r in texts.collect():  # SAMPLE_BYTES a language
        if chosen[r.h][0] == r.l:
            found.setdefault(r.l, []).append((chosen[r.h][1], r.t))
    out = {}
    for name, rows in found.items():
        raw = [t.encode() for _, t in sorted(rows)]
        text = plain(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))[0]
        if len(text):
            out[name] = text.tobytes()
    return out


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[str]:
    """Learns every language; the automata as files in the shared folder, some languages each, in alphabetical order."""
    spark: SparkSession = docs.sparkSession
    texts, out = sample(docs, id_col, text_col, lang_col), []
    names = sorted(texts)
    for i in range(0, len(names), BLOCK_LANGUAGES):
        out.append(store.fresh(spark, "languages"))
        block = [automaton(n, texts[n]) for n in names[i : i + BLOCK_LANGUAGES]]
        store.put(f"{out[-1]}/steps", [a.step.astype("<i4").tobytes() for a in block])
        store.put(f"{out[-1]}/names", [pickle.dumps([(a.language, a.code, len(a.step), a.bits) for a in block])])
    return out


_MODELS: dict[str, list[Automaton]] = {}


def _models(uri: str) -> list[Automaton]:
    if uri not in _MODELS:
        while len(_MODELS) >= KEPT:
            _MODELS.pop(next(iter(_MODELS)))
        steps, block, at = np.asarray(store.array(f"{uri}/steps", "<i4")), [], 0
        for language, code, size, bits in pickle.loads(store.array(f"{uri}/names", "u1").tobytes()):
            block.append(Automaton(language, code, steps[at : at + size], bits))
            at += size
        _MODELS[uri] = block
    return _MODELS[uri]


def judge(uris: list[str], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of some documents."""
    text, at, letters = plain(buf, offs)
    size = np.maximum(np.diff(at), 1)
    least, rest = np.full(len(size), np.inf), np.full(len(size), np.inf)
    name = np.full(len(size), UNKNOWN, object)
    for uri in uris:
        for a in _models(uri):
            bits = phrases(a, text, at) * a.bits / size
            better = bits < least
            rest = np.where(better, least, np.minimum(rest, bits))
            least = np.where(better, bits, least)
            name[better] = a.language
    rest = np.where(np.isinf(rest), 2 * least, rest)  # a single language
    blank = (letters == 0) | np.isinf(least)
    name[blank] = UNKNOWN
    with np.errstate(invalid="ignore"):
        score = np.where(blank, 0.0, 1 - least / np.maximum(rest, 1e-12))
    return name, score.clip(0, 1)


def _judged(uris: list[str], batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    try:
        for b in batches:
            buf, offs = tc.text_buffers(b.column(col))
            for i, j in tc.slices(offs, AT_ONCE):
                yield b.slice(i, j - i), *judge(uris, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
    finally:
        _MODELS.clear()  # the worker lives on, for tasks of other stages
        tc.release()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (0: another language is as good; towards 1: far better than all)."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), held_out(id_col).alias("_o"))
    kind = docs.schema[id_col].dataType.simpleString()
    uris = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, name, score in _judged(uris, batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(name.tolist(), pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told: ``und``, or two languages need the same bits (score 0). Cases as in ``identify``."""
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    named, at = docs.toDF(*names), cols.index(text_col)
    uris = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, name, score in _judged(uris, batches, at):
            yield b.filter(pa.array((name != UNKNOWN) & (score > 0)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return named.mapInArrow(run, schema).toDF(*cols)
