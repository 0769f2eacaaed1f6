import random
import zlib

import pytest

#: Texts of every awkward kind: null, empty, blank, ties, repeats, long, many bytes a character.
ODD = [
    None, "", " ", "\n\n\t", "one", "one", "One two three four five", "one two three four five", "é" * 300, "漢字 仮名 " * 80,
    "same line here\nsame line here\nother", "a b c d e " * 60, "x" * 5000, "tail with odd spaces\r\nand lines ", "#$% && ** <|endoftext|> it's we'll",
]


def corpus(n: int, seed: int) -> list[tuple]:
    """Random documents with copies, near copies and shared passages."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("the", "in", "re", "ou") for b in ("", "at", "er", "sh") for c in ("", "ed", "ing", "é")]
    passage = [" ".join(r.choice(words) for _ in range(60)) for _ in range(3)]
    texts = list(ODD)
    while len(texts) < n:
        kind = r.random()
        if kind < 0.15:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts[-1]:
            w = texts[-1].split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            w = [r.choice(words) for _ in range(r.randrange(1, 300))]
            if kind > 0.7:
                at = r.randrange(len(w))
                w[at:at] = r.choice(passage).split(" ")
            texts.append(r.choice([" ", " ", "\n", "  "]).join(w))
    order = list(range(n))
    r.shuffle(order)
    return [(i, texts[i], ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4], i) for i in order]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus(160, 7)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnsRenamed({"n_chars": "size"})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crc():
    return lambda ids: zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
