from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The same and columns whose names the operators use themselves.
CLASHING = SCHEMA + ", key string, kept string, digest string, keep_id string, n_words string, cls string, gone string, `odd name.x` string, a string, b string, root string, slot string, body string"


def sentence(rnd: random.Random, n: int) -> str:
    parts = ["the", "of", "ne", "or", "ka", "li", "ti", "on", "é", "ß", "an", "re"]
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(n))


def altered(rnd: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = "x" + str(rnd.randrange(999))
    return " ".join(words)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows with exact and near copies, a shared passage, junk, nulls, empty, short and long texts, ties and repeated rows."""
    rnd = random.Random(seed)
    texts: list[str | None] = [sentence(rnd, rnd.randint(1, 200)) for _ in range(n)]
    texts += [rnd.choice(texts) for _ in range(n // 4)]
    base = sentence(rnd, 300)
    texts += [base, *[altered(rnd, base, rnd.randint(1, 12)) for _ in range(12)]]
    passage = sentence(rnd, 120)
    texts += [f"{sentence(rnd, rnd.randint(3, 40))}\n{passage}\n{sentence(rnd, rnd.randint(3, 40))}" for _ in range(8)]
    texts += ["", None, " ", "\n", None, "", "a", "one two", "same line\n" * 60, "ab" * 700, "é" * 900, sentence(rnd, 6000), "!!! $$$ " * 90, "###\x00 \x85 ’", "1234 5678"]
    rows = [(i, t, rnd.choice(["en", "de", None]), f"src{rnd.randrange(3)}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [rows[0], rows[0], rows[5], (rows[7][0], "another text with an id that is taken", None, None, None), (None, "no id", "en", None, 5), (None, None, None, None, None), (None, texts[3], "en", None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = tuple("x" for _ in CLASHING.split(", ")[5:])
    return spark.createDataFrame([(*r, *extra) for r in rows], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
