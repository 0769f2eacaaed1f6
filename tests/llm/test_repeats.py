"""Both substring operators against brute force."""

import hashlib
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(rows, window):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first.setdefault(b[s : s + window], (i, s)) != (i, s):
                gone[s : s + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, window):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = [x.group().encode() for x in WORD.finditer(text or "")]
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), i) != i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [True, False])
def test_bytes(docs, rows, empty, monkeypatch, hot):
    from relspark.llm import repeats, suffixdedup

    if hot:
        monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)
    got = suffixdedup.mark(docs).collect()
    want = brute_bytes([r[:2] for r in rows], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0 and suffixdedup.mark(empty).count() == 0


@pytest.mark.parametrize("hot", [True, False])
def test_words(docs, rows, empty, monkeypatch, hot):
    from relspark.llm import repeats, treededup

    if hot:
        monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)
    got = treededup.mark(docs).collect()
    want = brute_words([r[:2] for r in rows], 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0 and treededup.mark(empty).count() == 0


def test_clean_keeps_columns_and_whole_texts(docs, rows):
    from relspark.llm import treededup

    out = treededup.clean(docs)
    want = brute_words([r[:2] for r in rows], 13)
    assert out.columns == docs.columns
    for r in out.collect():
        old = next(x for x in rows if x[0] == r.doc_id)
        assert (r.lang, r.source, r["size"]) == old[2:]
        if not want[r.doc_id][1]:
            assert r.text == old[1]
        else:
            assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2]


def test_odd_ids(spark):
    from relspark.llm import suffixdedup, treededup

    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (3, None), (2, "x " + text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in treededup.mark(df).collect())
    assert got == [(False, 0, 40, 0), (True, 2, 1, 0), (True, 2, 41, 40), (True, 3, 0, 0), (True, 3, 40, 40), (True, 3, 40, 40)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffixdedup.mark(df).collect())
    n = len(text)
    assert got == [(0, 0), (5, 0), (n, 0), (n, n), (n, n), (n + 2, n)]


def test_shared_passage_that_goes_on_differently(spark):
    from relspark.llm import treededup

    passage = " ".join(f"word{i}" for i in range(52))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(14))) for i in range(4000)]
    got = treededup.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 13)


def shared_ids():
    """Rows that share an id or have none, with own texts, shared passages and repeats."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(7, f"start{i} {passage} own{i} " + " ".join(f"x{i}y{j}" for j in range(i % 30))) for i in range(4000)]
    rows += [(None, f"null{i} " + " ".join(f"n{i}m{j}" for j in range(20)) + (f" {passage}" if i % 2 else "")) for i in range(2000)]
    rows += [(9, f"tail {passage}")] * 500 + [(1, f"{passage} first"), (1, f"other {passage}"), (3, passage)]
    return rows


@pytest.mark.parametrize("part", ["all", "one id", "null ids"])
def test_rows_that_share_an_id(spark, part):
    from relspark.llm import suffixdedup, treededup

    rows = [r for r in shared_ids() if part == "all" or r[0] == (7 if part == "one id" else None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Without null ids the smallest id is never cut; with them a null one is smaller than all.
    least = min((r[0] is not None, r[0] or 0) for r in rows)
    passage = " ".join(f"word{i}" for i in range(60))
    words, size = [], []
    for i, text in rows:
        cut = (i is not None, i or 0) != least and passage in text
        words.append((i, len(text.split()), 60 if cut else 0))
        size.append((i, len(text), cut))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in treededup.mark(df).collect()), key=order) == sorted(words, key=order)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed >= len(passage)) for r in suffixdedup.mark(df).collect()), key=order) == sorted(size, key=order)


def test_byte_windows_of_shared_ids_exactly(spark):
    """Every row against brute force: a window is late if a smaller id has it, or its own text before."""
    from relspark.llm import suffixdedup

    rows = [r for r in shared_ids() if (zlib.crc32(r[1].encode()) % 11 == 0 or r[0] in (1, 3)) and r[0] != 9] + [(5, "ab" * 200), (5, "ab" * 200), (5, "ba" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first: dict = {}
    for i, text in rows:
        for s in range(len(text) - 99):
            w = text[s : s + 100]
            first[w] = min(first.get(w, (1 << 60,)), (-1 if i is None else i,))
    want = []
    for i, text in rows:
        gone, own = [False] * len(text), set()
        for s in range(len(text) - 99):
            w = text[s : s + 100]
            if first[w] < (-1 if i is None else i,) or w in own:
                gone[s : s + 100] = [True] * 100
            own.add(w)
        want.append((-1 if i is None else i, len(text), sum(gone)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.mark(df).collect()) == sorted(want)


@pytest.mark.parametrize("window", [3, 8, 20, 100])
def test_radix_order(window):
    import numpy as np

    from relspark.llm.suffixdedup import radix_order

    r = np.random.default_rng(window)
    text = np.concatenate([r.integers(97, 99, 400, np.uint8)] * 3 + [r.integers(97, 100, 900, np.uint8)])
    start = r.permutation(len(text) - window + 1)
    suffix, group = radix_order(text, start, window)
    raw = text.tobytes()
    got = [raw[s : s + window] for s in start[suffix]]
    every = sorted(raw[s : s + window] for s in start)
    assert got == [w for w in every if every.count(w) > 1]
    assert [a == b for a, b in zip(group, group[1:])] == [a == b for a, b in zip(got, got[1:])]


def test_subtree_nodes_are_maximal():
    """Internal nodes of the tree against the branching prefixes of all windows."""
    import numpy as np

    from relspark.llm import treededup as td

    r = np.random.default_rng(5)
    items = np.concatenate([r.integers(1, 4, 300, np.uint64), *[r.integers(1, 9, 40, np.uint64)] * 3])
    at = np.arange(len(items) - 12)
    tree = td.subtree(td._edges(items, at, 13), td._ends(13))
    windows = [tuple(items[a : a + 13].tolist()) for a in at]
    want = set()
    for end, deeper in ((4, 8), (8, 13), (13, None)):
        for p in {w[:end] for w in windows}:
            below = [w for w in windows if w[:end] == p]
            if len(below) > 1 and (deeper is None or len({w[:deeper] for w in below}) > 1):
                want.add((end, p, len(below)))
    got = [(int(d), windows[tree.leaf[x]][: int(d)], int(y - x)) for d, x, y in zip(tree.depth, tree.left, tree.right)]
    assert set(got) == want and len(got) == len(want)
    for k, p in enumerate(tree.parent.tolist()):
        if p >= 0:
            assert tree.depth[p] < tree.depth[k] and tree.left[p] <= tree.left[k] and tree.right[p] >= tree.right[k]
    leaf, node = tree.repeats(13)
    assert sorted(leaf.tolist()) == [i for i, w in enumerate(windows) if windows.count(w) > 1]
    assert all(windows[a] == windows[b] for a, b, same in zip(leaf, leaf[1:], node[1:] == node[:-1]) if same)


def test_passages(docs, rows):
    from relspark.llm import treededup

    got = {}
    for r in treededup.passages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_words))
    first, want = {}, {}
    for i, text in sorted((r[:2] for r in rows), key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = bytearray(len(w))
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) != i:
                gone[s : s + 13] = b"\1" * 13
        if any(gone):
            want[i] = [(m.start(), m.end() - m.start()) for m in re.finditer(rb"\x01+", bytes(gone))]
    assert {k: sorted(v) for k, v in got.items()} == want
