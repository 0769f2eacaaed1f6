"""Held-out accuracy of language identification; leaks against brute force and planted edits."""

import random
import zlib

import pytest

MORPHS = {"en": "the in er on at ing ed st th re".split(), "fr": "le eau oi que des é è ai ou ment".split(), "de": "der sch ich ung ei ü ß au ge ber".split()}


def labelled(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(MORPHS))
        words = ["".join(r.choice(MORPHS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if i % 7 else None, "s", 0, lang))
    return rows


def test_held_out_accuracy(spark):
    from relspark.llm.langid import identify

    rows = labelled(600, 1)
    got = {r.doc_id: r for r in identify(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r.held_out)
    assert sum(got[i].lang_pred == rows[i][5] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def greedy(text, train):
    """Phrases of a greedy parse, the slow way."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        at, n = at + k, n + 1
    return n


@pytest.mark.parametrize("segment", [1, 3, 16, 256])
def test_phrases_against_greedy_parsing(segment):
    import numpy as np

    from relspark.llm.langid import automaton, phrases

    r = random.Random(segment)
    train = ("".join(r.choice("ab cé") for _ in range(300)) + " the cat sat on the mat and the hat ").encode()
    model = automaton("x", train)
    texts = [b"", b"z", b" the ", b" matsat catmat zoo ", train, train[100:] * 3] + ["".join(r.choice("ab cé") + r.choice(["", "", "q", " the "]) for _ in range(r.randrange(0, 400))).encode() for _ in range(60)]
    offs = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    got = phrases(model, np.frombuffer(b"".join(texts), np.uint8), offs, segment)
    assert got.tolist() == [greedy(t, train) for t in texts]


def test_plain_text():
    import numpy as np

    from relspark.llm.langid import plain

    texts = ["", "  ", "1, 2", "Hello,  WORLD!", "ÉTÉ 3x", "漢字 का", "\U00020000!", "İß", "a"]
    raw = [t.encode() for t in texts]
    buf, at, letters = plain(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))
    assert [buf[x:y].tobytes().decode() for x, y in zip(at, at[1:])] == ["", "", "", " hello world ", " été x ", " 漢字 का ", " \U00020000 ", " İß ", " a "]
    assert letters.tolist() == [0, 0, 0, 10, 4, 3, 1, 2, 1]


def test_predictions_against_a_slow_parser(spark, monkeypatch):
    """Whole predictions, with more languages than a block holds."""
    import math

    from relspark.llm import langid

    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 2)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 2000)
    rows = labelled(200, 3) + [(1000 + i, f"zz{i} qq yy zz{i}", f"rare{i}", "s", 0, "") for i in range(70)] + [(9001, "Der Tag", "de", "s", 0, "")] * 3
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    train = langid.sample(df, "doc_id", "text", "lang")
    assert {r[2] for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5} == set(train)
    whole = {" " + " ".join("".join(c if c.isalpha() else " " for c in r[1].lower()).split()) + " " for r in rows}
    for name, text in train.items():  # whole documents, each once
        rest, seen = text.decode(), []
        while rest:
            part = max((w for w in whole if rest.startswith(w)), key=len)
            seen.append(part)
            rest = rest[len(part) :]
        assert len(text) <= 2100
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in text_of[r.doc_id].lower()).split()) + " "
        raw = t.encode()
        cost = {n: greedy(raw, x) * math.log2(len(x)) / len(raw) for n, x in train.items()}
        best = min(sorted(cost), key=cost.get)
        second = min(v for n, v in cost.items() if n != best)
        assert r.lang_pred == best and abs(r.score - (1 - cost[best] / second)) < 1e-9


def test_language_of_odd_rows(spark, docs, rows, empty):
    from relspark.llm.langid import UNKNOWN, identify, keep_identified

    got = {r.doc_id: r for r in identify(docs).collect()}
    for i, text, *_ in rows:
        assert (got[i].lang_pred == UNKNOWN) == (not any(c.isalpha() for c in text or ""))
    assert identify(empty).count() == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    none = identify(spark.createDataFrame([(1, "abc", None), (None, None, "en")], "doc_id long, text string, lang string")).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in none] == [(1, UNKNOWN, 0.0), (None, UNKNOWN, 0.0)]


def brute_edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_least_edits():
    from relspark.llm.decontaminate import least_edits

    r = random.Random(2)
    for _ in range(200):
        item = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 90)))
        text = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 60)))
        assert least_edits(item, text, 1000) == brute_edits(item, text)


def test_leaks(spark, docs, empty):
    from relspark.llm.decontaminate import EDIT_SHARE, clean, leaks

    r = random.Random(9)
    words = [f"{a}{b}" for a in "the in er on at ing".split() for b in "ed st th re ly o a e i".split()]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randrange(8, 50)).capitalize()) for i in range(30)]
    rows, planted = [], set()
    for d in range(300):
        body = text(r.randrange(0, 120))
        if d % 3 == 0:
            i, s = r.choice(items)
            c = list(s.upper() if d % 2 else s.replace(" ", "\n"))
            for _ in range(int(r.random() * 0.09 * len(c))):
                c[r.randrange(len(c))] = r.choice(["x", "", "qz"])
            body = f"{body} {''.join(c)}  {text(20)}"
        rows.append((d, body))
    bench = spark.createDataFrame([*items, (98, None), (99, "short")], "item_id long, text string")
    df = spark.createDataFrame([*rows, (None, None), (400, "")], "doc_id long, text string")
    fold = lambda s: " ".join(s.lower().split()).encode()
    for d, body in rows:
        t = fold(body)
        for i, s in items:
            s = fold(s)
            if brute_edits(s, t) <= int(EDIT_SHARE * len(s)):
                planted.add((d, i))
    got = {(x.doc_id, x.item_id) for x in leaks(df, bench).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted) and len(planted) >= 90
    kept = clean(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {None, 400, *range(300)} - {d for d, _ in got}
    assert leaks(empty, bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def searched(items, texts):
    import numpy as np

    from relspark.llm.decontaminate import build, search

    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    return {(d, i): e for d, i, e in search(build(list(range(len(items))), items), buf, offs)}


@pytest.mark.parametrize("n", [3, 15, 20, 40, 80, 300])
@pytest.mark.parametrize("percent", [2, 4, 6, 8, 10])
def test_recall_of_edits_by_share(n, percent):
    from relspark.llm.decontaminate import least_edits

    r = random.Random(n * 100 + percent)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 10))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [t.encode() for t in (text(n) for _ in range(40)) if len(t) >= 16]
    texts, want = [], set()
    for i, item in enumerate(items):
        for even in (True, False):
            c, k = list(item.decode()), len(item) * percent // 100
            first = r.randrange(10)
            for j in range(k):
                at = min(len(c) - 1, first + j * len(c) // max(1, k)) if even else r.randrange(len(c))
                c[at] = "z" if even else r.choice(["z", "", "z" + c[at]])
            texts.append(f"{text(30)} {''.join(c)} {text(30)}")
            if least_edits(item, " ".join(texts[-1].split()).encode(), len(item) // 10) is not None:
                want.add((len(texts) - 1, i))
    got = searched(items, texts)
    assert want <= set(got) and len(want) >= len(items)
    for d, i in got:
        assert got[d, i] == least_edits(items[i], " ".join(texts[d].split()).encode(), len(items[i]) // 10)


def test_short_items_and_classes(spark, monkeypatch):
    """Items under 16 bytes exactly, as whole words; blocks by class of length; several blocks a worker."""
    from relspark.llm import decontaminate as dc

    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    monkeypatch.setattr(dc, "KEPT", 1)
    long = [f"item number {i} is about the " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(9)]
    items = [(1, "Yes"), (2, "new  york"), (3, "a longer one 1"), (4, "yes"), (5, None), (6, ""), (7, "sixteen chars ok"), (8, "of thirty-two characters or more"), *((10 + i, t) for i, t in enumerate(long))]
    docs = [(1, "well YES sir"), (2, "yesterday in New\nYork"), (3, "new"), (4, "york"), (5, None), (6, "say a longer one 1"), (7, "a longer one 12"), (8, "are sixteen chara ok now"), (9, f"see {long[3]}."), (10, long[8].replace("about", "abaut")), (11, "yes"), (11, "yes")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in dc.leaks(df, bench, shortest=1).collect())
    assert got == [(1, 1, 0), (1, 4, 0), (2, 2, 0), (6, 3, 0), (8, 7, 1), (9, 13, 0), (10, 18, 1), *[(11, 1, 0)] * 2, *[(11, 4, 0)] * 2]
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()) == [(8, 7), (9, 13), (10, 18)]
    assert sorted(r.doc_id for r in dc.clean(df, bench).collect()) == [1, 2, 3, 4, 5, 6, 7, 11, 11]


def test_pipeline(spark, docs, rows, tmp_path):
    pytest.importorskip("public_tokenizers")
    from corpus_pipeline import STAGES, run

    bench = spark.createDataFrame([(1, " ".join((rows[5][1] or "a b c d e f g").split()[:40]))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.withColumnsRenamed({"size": "n_chars"}).write.parquet(f"{tmp_path}/documents.parquet")
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [cur.count()]
    for name, stage in STAGES[:-1]:
        out = stage(spark, cur, str(tmp_path))
        assert out.columns == cur.columns and [f.dataType for f in out.schema] == [f.dataType for f in cur.schema], name
        out.write.parquet(f"{tmp_path}/{name}")
        cur = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(cur.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[-1] > 0
    last = run(spark, str(tmp_path))
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in cur.collect()}
