from __future__ import annotations

import random

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Columns beyond those of documents, with the names that operators use inside.
CLASHES = ["fp", "h", "of", "bucket", "marks", "ranges", "key", "place", "score", "id", "c0", "size", "rest", "copies2"]
SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        *[StructField(name, DoubleType()) for name in CLASHES],
    ]
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *[float(k) for k in range(len(CLASHES))])


def invented(rng: random.Random, words: int) -> str:
    parts = ["an", "thé", "or", "ing", "wh", "es", "tion", "lö", "ba", "x"]
    text = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + rng.choice(["", "", "", ",", ".\n"]) for w in text)


def corpus(seed: int = 3) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeats in themselves, and odd rows."""
    rng = random.Random(seed)
    passages = [invented(rng, 70) for _ in range(3)]
    texts = [invented(rng, rng.choice([1, 3, 12, 40, 150, 400])) for _ in range(60)]
    for k in range(0, 60, 4):
        texts[k] = texts[k] + " " + rng.choice(passages) + " " + invented(rng, 20)
    texts += [texts[3]] * 5 + [texts[8]] * 3
    for k in range(8):
        near = texts[30 + k].split(" ")
        near[len(near) // 2] = "CHANGED"
        texts.append(" ".join(near))
    texts += ["ab" * 400, "x" * 350, " ".join(["same"] * 200), invented(rng, 30) * 3, "é" * 120 + "è" * 120 + "é" * 120]
    texts += ["", None, "   \t\n ", "one", "a b", "123 !!", "あい"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [row(7 * place + 1, texts[k], rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]))
            for place, k in enumerate(order)]
    rows += [rows[5], rows[5], rows[11]]  # whole rows that repeat
    rows += [row(None, texts[3]), row(None, None, None, None), row(None, passages[0])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
