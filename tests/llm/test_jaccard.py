"""The similarity join against all pairs."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, schema="doc_id long, text string"):
    from relspark.llm.jaccard import link

    got = link(spark.createDataFrame(rows, schema)).collect()
    want = brute([r[:2] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    return want


def test_corpus(spark, docs, rows, empty):
    from relspark.llm.jaccard import link

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(docs).collect()}
    assert got == brute([r[:2] for r in rows])
    assert link(empty).count() == 0


@pytest.mark.parametrize("size", [4, 6, 9, 14, 25, 60, 200])
def test_edges_of_the_threshold(spark, size):
    """Sets whose similarity lies close to the threshold, at every size of band."""
    r = random.Random(size)
    rows = []
    for k in range(24):
        words = [f"w{r.randrange(10**6)}" for _ in range(size + 4)]
        for j in range(5):
            w = list(words)
            for _ in range(r.randrange(0, 1 + size // 20)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            w = w[: len(w) - r.randrange(0, 1 + size // 6)] + [f"t{r.randrange(10**6)}" for _ in range(r.randrange(0, 1 + size // 8))]
            rows.append((5 * k + j, " ".join(w)))
    check(spark, rows)


def test_many_share_a_passage_and_many_are_near(spark):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join([f"u{r.randrange(10**6)}" for _ in range(r.randrange(3, 60))] + passage)))
    for i in range(150, 250):
        w = list(base)
        w[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_nulls_and_repeats(spark):
    from relspark.llm.jaccard import keep_first, link

    df = spark.createDataFrame([(None, "a b c d e f g"), (7, "A b c d e f g"), (7, "A b c d e f g"), (5, None), (5, " "), (6, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in link(df).collect()), key=str)
    assert got == [(0, 3, 7), (5, 0, 5), (5, 0, 5), (6, 1, 6), (7, 3, 7), (7, 3, 7)]
    kept = keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, ""), (5, " "), (6, "x"), (7, "A b c d e f g")]


@pytest.mark.parametrize("words", [(8, 20), (20, 60)])
def test_unrelated_texts_share_no_subset(words):
    """No key stands for an empty subset, so unrelated texts give no long lists."""
    import numpy as np

    from relspark.llm import jaccard

    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(10**5)}" for _ in range(r.randrange(*words))).encode() for _ in range(20_000)]
    g, at = jaccard.shingles(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))]))
    keys = np.concatenate([k[np.unique(np.stack([d.astype(np.uint64), k]), axis=1, return_index=True)[1]] for d, k in jaccard.signatures(g, at)])
    assert np.unique(keys, return_counts=True)[1].max() <= 4


def test_long_lists_in_tiles(spark, monkeypatch):
    from relspark.llm import jaccard

    monkeypatch.setattr(jaccard, "LIST_ROWS", 16)
    monkeypatch.setattr(jaccard, "PAIRWISE", 2)
    r = random.Random(8)
    rows = []
    for i in range(120):  # all alike, links of neighbours only
        w = [f"p{j}" for j in range(70)]
        for j in range(i % 6):
            w[10 * j + i // 30] = f"x{i}y{j}"
        rows.append((i, " ".join(w[: 50 + r.randrange(20)])))
    check(spark, rows)
