"""Language identification: averaged embeddings of hashed subwords, and a linear softmax.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams (a-z for A-Z, everything
that is no letter a space, grams that begin outside words left out), hashed to `ROWS` rows. A
linear softmax over the average gives the languages. Both are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows (`PER_LANGUAGE` for each
language, texts of at most `LONGEST` bytes; a bound on the sample only). A temperature and the
confidence below which an answer is rejected are calibrated on rows kept back from training.
All documents are then scored over their whole texts in one pass without a shuffle: embedding
and softmax are linear, so that a task only needs the product of the two tables.

A text that is null or has no letter is `und` with score 0. With no labelled rows every answer
is `und`. Only doc_id, text and lang are read; lang only of rows used for training. Repeated
rows get equal answers. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import U64, chunks, flat, held_out, sent
from tarsift.session import ship_with_tasks

ROWS = 1 << 16
WIDTH = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 1500
LONGEST = 20_000
EPOCHS = 4
RATE = 0.5
KEPT_BACK = 8
#: Share of right answers on the rows kept back that rejection may cost.
LOST = 0.005
UNKNOWN = "und"

_code = np.arange(256)
FOLD = np.where((_code >= 65) & (_code < 91), _code + 32, _code)
#: Letters of ASCII, and the bytes of other characters, as they are; all else is a space.
FOLD = np.where(((FOLD >= 97) & (FOLD < 123)) | (_code >= 128), FOLD, 32).astype(np.uint32)


def subwords(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table row of every gram of the flat texts, and the text it is from."""
    body = FOLD[data]
    n = len(body)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    letter = body != 32
    begins = letter.copy()
    begins[:-1] |= letter[1:]
    out, whose = [], []
    packed = body.astype(np.uint64)
    for size in range(2, max(GRAMS) + 1):
        following = np.zeros(n, np.uint64)
        if n >= size:
            following[: n - size + 1] = body[size - 1 :]
        packed = packed * U64(256) + following
        if size in GRAMS:
            i = np.flatnonzero(begins & (left >= size))
            mixed = (packed[i] + U64(size << 40)) * U64(0x9E3779B97F4A7C15)
            out.append((mixed >> U64(64 - ROWS.bit_length() + 1)).astype(np.int64))
            whose.append(row[i])
    return np.concatenate(out), np.concatenate(whose)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # rows of the embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, by text."""
        gram, row = subwords(data, at)
        n = len(at) - 1
        count = np.bincount(row, minlength=n)
        logits = np.stack([np.bincount(row, self.table[gram, k], n) for k in range(len(self.names))], axis=1)
        return softmax((logits / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over texts, one at a time, with a falling rate."""
    names = sorted(set(labels))
    want = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = (rng.random((ROWS, WIDTH)) - 0.5) / WIDTH
    weights, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    bags = []
    for text in texts:
        gram, _ = subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        names_of, count = np.unique(gram, return_counts=True)
        bags.append((names_of, count / max(1, count.sum())))
    order = rng.permutation(len(texts))
    back, fit = order[: len(order) // KEPT_BACK], order[len(order) // KEPT_BACK :]
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            rate = RATE * (1 - done / steps)
            done += 1
            gram, share = bags[k]
            if not len(gram):
                continue
            mean = share @ table[gram]
            error = softmax((mean @ weights + bias)[None])[0]
            error[want[k]] -= 1
            back_to = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # The averaged gradient is small for every gram: scaled up, as the shares are small.
            table[gram] -= (rate * WIDTH) * share[:, None] * back_to
    model = Model(names, table @ weights, bias, 1.0, 0.0)
    calibrate(model, [bags[k] for k in back], want[back])
    return model


def calibrate(model: Model, bags: list, want: np.ndarray) -> None:
    """Sets the temperature of least loss and the confidence below which answers are rejected."""
    if not len(bags):
        return
    logits = np.stack([share @ model.table[gram] + model.bias for gram, share in bags])
    grid = np.geomspace(0.02, 20, 61)
    loss = [-np.log(softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    chance = softmax(logits / model.temperature)
    right = chance.argmax(1) == want
    if right.any():
        model.least = float(np.quantile(chance.max(1)[right], LOST))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model from rows with a lang that are not held out."""
    labelled = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    uniform = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = (
        labelled.where((uniform < share) & (F.octet_length("text") <= LONGEST))
        .limit(2 * per_language * len(counts))
        .toArrow()
        .sort_by("doc_id")
    )
    texts = [(t.as_py() or "").encode() for t in sample["text"]]
    return train(texts, sample["lang"].to_pylist()) if texts else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected (less sure than right answers are), by row."""
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    if model is None:
        return chosen.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )
    shared = sent(docs.sparkSession, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        names = np.array([*model.names, UNKNOWN], object)
        for batch in batches:
            data, at = flat(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            parts = [model.scores(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in chunks(data, at)]
            chance = np.concatenate(parts) if parts else np.zeros((0, len(model.names)))
            best = np.where(lettered, chance.argmax(1), len(model.names))
            score = np.where(lettered, chance.max(1, initial=0.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(score < model.least)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return chosen.mapInArrow(scan, "doc_id long, lang_pred string, score double, rejected boolean")


ship_with_tasks(__name__)
