"""Encoding whole texts with a public tokenizer, word by word where that is exact.

Both supported pre-tokenizers split a text at every white space character that
follows a non-space, and between an ASCII letter and ASCII punctuation (other
than the apostrophe of contractions). Cutting a text there and encoding the
pieces one by one therefore gives the ids of the whole text; each distinct piece
is encoded by the tokenizers library once per worker and its ids are reused.

Added tokens (such as an end-of-text mark) are found by the library before it splits, so
a text that holds the literal of one is encoded whole. With ``marks=False`` such a
literal is ordinary text and never becomes the mark's id.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

from . import textcore as tc

END_ID = 2
#: Distinct pieces a worker remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 3_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LONG = 96


class Encoder:
    """Ids of slices of documents by a tokenizer file, with a memory of pieces."""

    def __init__(self, path: str, marks: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not marks
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Lower-cased literals that the library looks for in a text.
        self.literals = sorted({t.content.lower().encode() for t in added if marks or not t.special})
        normalizer = self.tokenizer.normalizer
        #: The tokenizer lowers case and drops white space itself: then pieces needn't differ in them.
        self.folds = normalizer is not None and "Lowercase" in str(normalizer)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, tc.U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            self.forget()
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        for i in range(0, len(pieces), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((x for e in ids for x in e), np.uint32, int(n.sum()))
            if self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(flat)), np.uint32)])
            self.store[self.used : self.used + len(flat)] = flat
            size[i : i + len(n)] = n
            at[i : i + len(n)] = self.used + np.cumsum(n) - n
            self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _marked(self, buf: np.ndarray, offs: np.ndarray) -> list[int]:
        """Documents that may hold the literal of an added token."""
        found: set[int] = set()
        low = tc.lower_ascii(buf).tobytes() if self.literals else b""
        for literal in self.literals:
            at = low.find(literal)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                found.add(d)
                at = low.find(literal, int(offs[d + 1]))
        return sorted(found)

    def encode(self, buf: np.ndarray, offs: np.ndarray, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: uint32 ids of all documents, each closed by ``end``."""
        marked = self._marked(buf, offs)
        if not marked:
            return self._encode(buf, offs, end)
        parts, sizes, at = [], [], 0
        for d in [*marked, len(offs) - 1]:
            if d > at:
                ids, cut = self._encode(buf[offs[at] : offs[d]], offs[at : d + 1] - offs[at], end)
                parts.append(ids)
                sizes.append(np.diff(cut))
            if d < len(offs) - 1:  # whole, as the library does it
                ids = self.tokenizer.encode(buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
                parts.append(np.array(ids + ([] if end is None else [end]), np.uint32))
                sizes.append(np.array([len(parts[-1])], np.int64))
            at = d + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode(self, buf: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offs) - 1
        if self.folds and len(buf):
            # A capital before a byte of another script may compose with it otherwise than the small letter does.
            plain = np.append(buf[1:] < 0x80, True)
            buf = np.where(plain, tc.lower_ascii(buf), buf)
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            prev, cur = buf[:-1], buf[1:]
            wide = np.zeros(len(prev), bool)  # ends a two-byte letter above the Latin-1 controls
            wide[1:] = (prev[1:] >= 0x80) & (prev[1:] < 0xC0) & (prev[:-1] >= 0xC3) & (prev[:-1] < 0xE0)
            cut[1:-1] = (_SPACE[cur] & (((prev > 32) & (prev < 127)) | wide)) | (_LETTER[prev] & _PUNCT[cur])
        cut[offs] = True
        cut[len(buf)] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        first = np.searchsorted(starts, offs)
        if self.folds and len(starts):
            starts = np.where(_SPACE[buf[starts]] & (ends - starts > 1), starts + 1, starts)
        size = ends - starts
        short = size <= _LONG
        h = np.zeros(len(starts), tc.U)
        h[short] = tc.span_hash(buf, starts[short], ends[short])
        for i in np.flatnonzero(~short):
            h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        keys, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(found, len(self.keys) - 1)] != keys
        if new.any():
            text = buf.tobytes()
            make = np.ones(len(keys), bool) if len(self.keys) + int(new.sum()) > CACHE_ENTRIES else new
            self._learn(keys[make], [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in one[make]])
            found = np.searchsorted(self.keys, keys)
        found = found[inverse]
        size, at = self.size[found].astype(np.int64), self.at[found]
        tail = 0 if end is None else 1
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        doc_offs = total[first] + tail * np.arange(n_docs + 1)
        out = np.zeros(int(doc_offs[-1]), np.uint32)
        src = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        where = np.arange(total[-1]) + tail * np.repeat(np.arange(n_docs), np.diff(total[first])) if tail else slice(None)
        out[where] = self.store[src]
        if tail:
            out[doc_offs[1:] - 1] = end
        return out, doc_offs


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, marks: bool = True) -> Encoder:
    """The worker's own encoder of a file; kept for later tasks of the worker."""
    if (path, marks) not in _ENCODERS:
        _ENCODERS[path, marks] = Encoder(path, marks)
    return _ENCODERS[path, marks]
