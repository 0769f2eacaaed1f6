"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths are compared inside each
document; what counts is the share of characters that lie in later copies of an
n-gram or of a line. One pass over the text, no shuffle.

Defined cases: a null or empty text has all counts 0 and fails the base rule;
rows are judged one by one, so repeated rows get equal answers and an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Largest share of characters in later copies of an n-gram, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of characters, in lines equal to an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
#: Base rule: fewer words than this, or a larger percentage of words in repeated 5-word windows, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

_BASE, _MORE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), ("n_lines", "dup_line_chars")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(flag: np.ndarray, offs: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag if weight is None else np.where(flag, weight, 0), out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def measure(buf: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """All counts of a slice of documents."""
    starts, ends, woffs = tc.word_bounds(buf, offs)
    h, doc = tc.span_hash(buf, starts, ends), tc.owners(woffs)
    lead = (buf & 0xC0) != 0x80
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    wchars = chars[ends] - chars[starts]
    out = {"n_words": np.diff(woffs), "word_chars": _per_doc(np.ones(len(h), bool), woffs, wchars), "n_symbols": _per_doc(_SYMBOL[buf], offs)}

    cut = np.unique(np.concatenate([offs, np.flatnonzero(buf == 10) + 1]))  # a document's end also ends its line
    ls, le = cut[:-1], cut[1:]
    if len(ls):
        le = np.where(buf[np.maximum(le - 1, 0)] == 10, le - 1, le)
        has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le = ls[has], le[has]
    ldoc = np.searchsorted(offs, ls, "right") - 1
    twin = tc.later(tc.mix(tc.PrefixHash(buf).span(ls, le) ^ tc.mix(ldoc.astype(tc.U)))) if len(ls) else np.zeros(0, bool)
    loffs = np.searchsorted(ldoc, np.arange(len(offs)))
    out |= {"n_lines": np.diff(loffs), "n_dup_lines": _per_doc(twin, loffs)}
    wtotal = np.zeros(len(h) + 1, np.int64)
    np.cumsum(wchars, out=wtotal[1:])
    lchars = wtotal[np.searchsorted(starts, le)] - wtotal[np.searchsorted(starts, ls)] if len(ls) else np.zeros(0, np.int64)
    out["dup_line_chars"] = _per_doc(twin, loffs, lchars)

    salt = tc.mix(doc.astype(tc.U) + tc.U(1))
    for n in sorted({5, *lengths}):
        inside = tc.within(woffs, n, len(h))
        at = np.flatnonzero(inside)
        key = tc.mix(tc.grams(h, n)[at] ^ salt[at])
        again = tc.repeated(key)
        for name, hit in (("n_repeat_words", again), (f"dup_{n}", None)):
            if name == "n_repeat_words" and n != 5:
                continue
            if hit is None:
                hit = np.zeros(len(at), bool)
                some = np.flatnonzero(again)
                hit[some[tc.later(key[some])]] = True
            flag = np.zeros(len(h), bool)
            flag[at[hit]] = True
            covered = tc.cover(flag, n)
            out[name] = _per_doc(covered, woffs, None if name == "n_repeat_words" else wchars)
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Mapping[int, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, and the verdicts."""
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    lengths = tuple(sorted(limits))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    more = [*_MORE, *(f"dup_{n}" for n in sorted({5, *lengths}))]
    id_type = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tc.text_buffers(b.column(1))
            for i, j in tc.slices(offs):
                m = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lengths)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                total = np.maximum(m["word_chars"], 1)
                good = (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"]) & (m["dup_line_chars"] <= LINE_CHAR_LIMIT * total)
                for n, most in limits.items():
                    good &= m[f"dup_{n}"] <= most * total
                base, rest = ([pa.array(m[k].astype(np.int64)) for k in names] for names in (_BASE, more))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *base, pa.array(failed), pa.array(good & ~failed), *rest], names=[id_col, *_BASE, "base_failed", "kept", *more])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{k} long" for k in _BASE) + ", base_failed boolean, kept boolean, " + ", ".join(f"{k} long" for k in more)
    return src.mapInArrow(run, schema)
