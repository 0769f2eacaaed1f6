"""Repetition rules, token files, counts, packing and sharding against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ids_of(rows):
    from tokenizers import Tokenizer

    def run(name, marks=True):
        t = Tokenizer.from_file(P.path(name))
        t.encode_special_tokens = not marks
        return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in rows}

    return run


def covered_chars(words, n, skip_first):
    seen, hit = set(), set()
    count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if count[g] > 1 and (not skip_first or g in seen):
            hit |= set(range(i, i + n))
        seen.add(g)
    return hit


def test_repetition(docs, rows, empty):
    from relspark.llm.repetition import LINE_CHAR_LIMIT, LINE_LIMIT, NGRAM_LIMITS, repetition_rules

    got = {r.doc_id: r for r in repetition_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        text = text or ""
        words, r = WORD.findall(text), got[i]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = [k for k, x in enumerate(lines) if x in lines[:k]]
        rep = len(covered_chars(words, 5, False))
        total = sum(map(len, words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), total, sum(c in "#*$%&|<>" for c in text), len(dup), rep)
        failed = len(words) < 10 or 100 * rep > 20 * len(words)
        good = len(dup) <= LINE_LIMIT * len(lines) and sum(len("".join(WORD.findall(lines[k]))) for k in dup) <= LINE_CHAR_LIMIT * max(total, 1)
        for n, most in NGRAM_LIMITS.items():
            good &= sum(len(words[k]) for k in covered_chars(words, n, True)) <= most * max(total, 1)
        assert (r.base_failed, r.kept) == (failed, good and not failed)
    assert repetition_rules(empty).count() == 0


def test_token_files(spark, docs, rows, empty, ids_of, crc):
    from relspark.llm.binary import read_tokens, write_tokens

    want, at = {}, 0
    ids = ids_of("byte_bpe_50k.json")
    for i in sorted(ids):
        n = ids[i] + [2]
        want[i] = (at, len(n), crc(n))
        at += len(n)
    got = read_tokens(spark, write_tokens(docs, P.path("byte_bpe_50k.json"))).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    assert read_tokens(spark, write_tokens(empty, P.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    """Short strings of letters, marks, white space, punctuation and literals, whole batches at a time."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from relspark.llm.tokens import Encoder

    r = random.Random(4)
    atoms = [*"abTWYJHtwyjhKkIi01", *" \t\n\r\x0b\x0c", *"'.,<>|=#", "'s", "'LL", "it's", "\u030a", "\u0308", "\u030c", "\u0331", "\u0338", "\u0301", "\u0327", "é", "É", "ß", "İ", "\u212a", "\u00a0", "\u0085", "\u2028", "漢", "字", "ก", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>"]
    whole, own = Tokenizer.from_file(P.path(name)), Encoder(P.path(name))
    for _ in range(100):
        texts = ["".join(r.choice(atoms) for _ in range(r.randrange(0, 9))) for _ in range(200)]
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum(list(map(len, raw)))])
        ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
        for t, a, e, want in zip(texts, at, at[1:], whole.encode_batch(texts, add_special_tokens=False)):
            assert ids[a:e].tolist() == [*want.ids, 2], repr(t)


def test_token_files_odd_ids(spark):
    from relspark.llm.binary import read_tokens, write_tokens

    df = spark.createDataFrame([(None, "b"), (5, "x y"), (5, "a"), (None, None), (3, "")], "doc_id long, text string")
    got = read_tokens(spark, write_tokens(df, P.path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 5, 5]
    assert sorted(r.n_tokens for r in got[:2]) == [1, 2] and got[2].n_tokens == 1 and sorted(r.n_tokens for r in got[3:]) == [2, 3]


def test_an_id_of_many_rows_is_dealt_to_several_parts(spark):
    from relspark.llm.binary import read_tokens, write_tokens

    df = spark.createDataFrame([(None, f"text {i}") for i in range(900)] + [(5, "again")] * 20, "doc_id long, text string").repartition(3)
    files = write_tokens(df, P.path("byte_bpe_50k.json"), parts=6)
    got = read_tokens(spark, files).orderBy("start").collect()
    assert max(p[1] for p in files.parts) < 600 and [r.doc_id for r in got] == [None] * 900 + [5] * 20
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


@pytest.mark.parametrize("ordered", [True, False])
def test_counts_over_blocks(spark, docs, ids_of, ordered):
    from relspark.llm.binary import write_tokens
    from relspark.llm.tokencount import scan_counts, with_ids

    files = write_tokens(docs, P.path("byte_bpe_50k.json"), end=50256, ordered=ordered, marks=False)
    names = [f"{files.uri}/part-{p[0]:06d}" for p in files.parts]
    for block in (7, 64, 1 << 20):
        counts = scan_counts(spark, [f"{n}.bin" for n in names], files.dtype, 50256, block)
        got = {r.doc_id: r.n_tokens for r in with_ids(counts, [f"{n}.ids" for n in names]).collect()}
        assert got == {i: len(x) for i, x in ids_of("byte_bpe_50k.json", False).items()}


def test_counts_unclosed(spark, tmp_path):
    import numpy as np

    from relspark.llm.tokencount import scan_counts

    for k, ids in enumerate(([9, 9, 0, 0, 9], [], [0], [9] * 10)):
        np.array(ids, "<u2").tofile(tmp_path / f"{k}.bin")
    got = scan_counts(spark, [f"file://{tmp_path}/{k}.bin" for k in range(4)], "<u2", 0, 3).orderBy("file", "ordinal").collect()
    assert [(r.file, r.ordinal, r.n_tokens, r.closed) for r in got] == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 1, False), (2, 0, 0, True), (3, 0, 10, False)]


@pytest.mark.parametrize("targets", [None, {"hot": 1, "b": 3}])
@pytest.mark.parametrize("window", [256, 4096])
def test_packing(docs, rows, empty, ids_of, crc, targets, window):
    from relspark.llm.packing import pack

    ids = {i: x + [2] for i, x in ids_of("word_bpe_49k.json").items()}
    got = pack(docs, P.path("word_bpe_49k.json"), window, targets).collect()
    by_doc, by_seq, share = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
        share[r.sequence_id][r.queue] += r.length
    for pieces, full in ((by_doc, {i: len(x) for i, x in ids.items()}), (by_seq, {s: window for s in by_seq})):
        for k, p in pieces.items():
            at = 0
            for a, n in sorted(p):
                assert a == at
                at += n
            assert at == full[k] or (pieces is by_seq and k == max(by_seq))
    assert set(by_doc) == set(ids) and sorted(by_seq) == list(range(len(by_seq)))
    total = sum(map(len, ids.values()))
    assert len(by_seq) == -(-total // window)
    if targets is None:
        want = Counter()
        for i, _, _, s, _ in rows:
            want[s] += len(ids[i])
        for s, c in ((s, c) for s, c in share.items() if s != max(share)):
            assert all(abs(c[q] - window * want[q] / total) <= 2 for q in want)
    else:
        assert abs(share[0]["b"] - 0.75 * window) <= 2
    assert pack(empty, P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("targets", [None, {"s1": 100, "s2": 1, **{f"thin{i}": 0.001 for i in range(300)}}])
def test_packing_many_thin_sources(spark, targets):
    from relspark.llm.packing import pack

    rows = [(i, "some words " * (i % 9), None if i % 50 == 7 else "s1" if i % 3 else f"thin{i % 300}" if i % 2 else "s2") for i in range(1500)] + [(None, None, None), (1, "", "s2"), (1, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = pack(df, P.path("word_bpe_49k.json"), 64, targets).collect()
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length, r.queue))
    for k, p in by_seq.items():
        at = 0
        for a, n, _ in sorted(p, key=lambda x: x[:2]):
            assert a == at and n > 0
            at += n
        assert at == 64 or k == max(by_seq)
    assert sum(r.length for r in got) == sum((i or 0) % 9 * 2 + 1 if t else 1 for i, t, _ in rows) and sorted(by_seq) == list(range(len(by_seq)))
    if targets is None:  # the thin sources' tokens are spread over the windows
        with_thin = sum(any((q or "").startswith("thin") for _, _, q in p) for p in by_seq.values())
        assert with_thin >= 0.9 * len(by_seq)
    else:  # no target: only when all others are empty
        first = min(k for k, p in by_seq.items() if any(q is None for _, _, q in p))
        assert all(q is None for k, p in by_seq.items() if k > first for _, _, q in p)


def test_sharding(spark, docs, rows, empty):
    from relspark.llm.sharding import shard

    got = shard(docs, 4).collect()
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        where[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    assert max(load.values()) <= 1.1 * sum(load.values()) / 4
    assert shard(empty, 4).count() == 0


def test_sharding_splits_a_group_that_fills_shards(spark):
    from relspark.llm.sharding import shard

    df = spark.createDataFrame([(i, "hot text of many rows" if i % 3 == 0 else f"text {i}") for i in range(6000)] + [(None, None)], "doc_id long, text string")
    got = shard(df, 8).groupBy("shard").agg({"size": "sum", "slot": "count"}).collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(got) == 8 and max(sizes) <= 1.1 * sum(sizes) / 8


def test_sharding_splits_rows_that_repeat_id_and_text(spark):
    from relspark.llm.sharding import shard

    df = spark.createDataFrame([(7, "hot text of many rows")] * 4000 + [(i, f"text {i}") for i in range(390)], "doc_id long, text string")
    got = shard(df, 16).groupBy("shard").agg({"size": "sum", "slot": "count"}).collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(got) == 16 and max(sizes) <= 1.05 * sum(sizes) / 16 and min(sizes) >= 0.95 * sum(sizes) / 16


def test_sharding_counts_tokens_of_scripts_without_blanks():
    import numpy as np

    from relspark.llm.sharding import tokens_of

    rows = [("two words", 2), ("漢字 かな", 4), ("", 0), ("mixed漢word", 3), ("a\tb\nc", 3), ("  ", 0), ("กข", 2), ("字", 1), ("end", 1), ("\ud55c\uad6d dal", 2), ("ạ́b ’x", 2)]
    raw = [t.encode() for t, _ in rows]
    got = tokens_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))
    assert got.tolist() == [n for _, n in rows]
