"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text is a bag of terms: trigrams of character classes (lower case, upper case, digits, stops,
brackets, signs, ...), and what its words do (repeat the word before, the one before that, an
earlier line; are short, long, end in signs), and the words themselves, hashed to `WORDS` places.
Terms are weighted by inverse document frequency over a bounded sample of labelled rows, and
projected on the sample's leading singular vectors.
The sample's vectors, labels and the projection are broadcast (`SAMPLE` rows of `RANK` numbers,
whatever the corpus holds). Every document's cosine to every labelled vector is computed exactly
in blocks; its `NEIGHBOURS` nearest vote with their similarity, to the power `VOTE_POWER`, as weight.

Texts are read whole, in one pass without a shuffle. Labels are learned only from rows that are
not held out; several labels of one doc_id each count, null labels do not, texts of more than
`LONGEST` bytes are not learned from (a bound on the sample only). A null text is an empty one;
an empty text is a bag without terms and its vector zero, for which all neighbours are equal:
its score is the labels' mean. Without labels every score is 0.5. Only doc_id, text and the
label are read. Repeated rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import U64, chunks, documents, flat, held_out, prefix_sums, range_hash, sent, words
from tarsift.session import ship_with_tasks

SAMPLE = 4000
LONGEST = 20_000
RANK = 48
NEIGHBOURS = 15
#: A vote's weight is the cosine to this power: nearer neighbours count for more.
VOTE_POWER = 8
THRESHOLD = 0.3
#: Documents whose terms are counted, and whose cosines to all labelled vectors are computed, together.
BLOCK = 512

#: Character classes, a number for each byte.
GROUPS = (b" \t\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",",
          b"!?", b"()[]{}\"'`", b"|", b"*#$%&@^~", b"/\\<>=+_-", b":;")
CLASSES = len(GROUPS) + 2
KIND = np.full(256, len(GROUPS), np.int64)
KIND[128:] = len(GROUPS) + 1
for _k, _group in enumerate(GROUPS):
    KIND[list(_group)] = _k
UPPER = np.zeros(256, bool)
UPPER[list(GROUPS[3])] = True
LETTER = np.zeros(256, bool)
LETTER[list(GROUPS[2] + GROUPS[3])] = True
LETTER[128:] = True
#: What words and lines do.
HABITS = 12
#: Places that words, A-Z as a-z, are hashed to.
WORDS = 1024
#: How much of a text's weight its words are beside the trigrams.
WORD_PART = 0.25
TERMS = CLASSES**3 + HABITS + WORDS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bags(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Terms of each text, as shares: of the trigrams, of the words that have a habit, of the words."""
    rows, n = len(at) - 1, len(data)
    out = np.zeros((rows, TERMS), np.float32)
    if not n:
        return out
    row = np.repeat(np.arange(rows), np.diff(at))
    kind = KIND[data]
    i = np.flatnonzero(np.arange(n) + 3 <= at[row + 1])
    gram = (kind[i] * CLASSES + kind[i + 1]) * CLASSES + kind[i + 2]
    count = np.bincount(row[i] * CLASSES**3 + gram, minlength=rows * CLASSES**3).reshape(rows, -1)
    out[:, : CLASSES**3] = count / np.maximum(1, count.sum(1, keepdims=True))
    out[:, CLASSES**3 : CLASSES**3 + HABITS] = habits(data, at)
    out[:, CLASSES**3 + HABITS :] = word_shares(LOWER[data], at)
    return out


def word_shares(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    start, end, first = words(data, at)
    place = (range_hash(prefix_sums(data), start, end) % U64(WORDS)).astype(np.int64)
    rows = len(at) - 1
    whose = np.repeat(np.arange(rows), np.diff(first))
    count = np.bincount(whose * WORDS + place, minlength=rows * WORDS).reshape(rows, WORDS)
    return WORD_PART * count / np.maximum(1, count.sum(1, keepdims=True))


def habits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    start, end, first = words(data, at)
    total, rows = np.maximum(1, np.diff(first)), len(at) - 1
    whose = np.repeat(np.arange(rows), np.diff(first))
    h, size = range_hash(prefix_sums(data), start, end), end - start
    upper = np.concatenate(([0], np.cumsum(UPPER[data])))
    letter = np.concatenate(([0], np.cumsum(LETTER[data])))
    uppers, letters = upper[end] - upper[start], letter[end] - letter[start]

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(whose[flag], minlength=rows) / total

    def again(step: int) -> np.ndarray:
        out = np.zeros(len(h), bool)
        out[step:] = (h[step:] == h[:-step]) & (whose[step:] == whose[:-step])
        return out

    def seen(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """True where the text had the value before."""
        order = np.lexsort((np.arange(len(values)), values, of))
        out = np.zeros(len(values), bool)
        out[order[1:]] = (values[order[1:]] == values[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        return out

    pair = np.zeros(len(h), np.uint64)
    pair[1:] = h[1:] * U64(31) + h[:-1]
    tail = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    flags = [
        again(1), again(2), again(3), seen(h, whose), seen(pair, whose), (uppers == letters) & (letters > 1),
        letters == 0, letters < size / 2, size <= 2, size >= 15, np.isin(KIND[tail], (7, 9, 10, 11)),
        KIND[tail] == 5,
    ]
    return np.stack([share(f) for f in flags], axis=1)


@dataclass
class Model:
    weight: np.ndarray  # of terms
    basis: np.ndarray  # terms by rank
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray

    def project(self, bag: np.ndarray) -> np.ndarray:
        vector = (np.sqrt(bag) * self.weight) @ self.basis
        return vector / np.maximum(1e-12, np.linalg.norm(vector, axis=1, keepdims=True))

    def scores(self, bag: np.ndarray) -> np.ndarray:
        out = np.empty(len(bag))
        some = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(bag), BLOCK):
            vectors = self.project(bag[a : a + BLOCK])
            near = vectors @ self.vectors.T
            top = np.argpartition(-near, some - 1, axis=1)[:, :some]
            weight = np.maximum(0, np.take_along_axis(near, top, 1)).astype(np.float64) ** VOTE_POWER
            vote = (weight * self.labels[top]).sum(1)
            empty = ~bag[a : a + BLOCK].any(axis=1) | (weight.sum(1) <= 0)
            out[a : a + BLOCK] = np.where(empty, self.labels.mean(), vote / np.maximum(weight.sum(1), 1e-300))
        return np.clip(out, 0, 1)


def leading(matrix: np.ndarray, rank: int, rounds: int = 20) -> np.ndarray:
    """The leading right singular vectors, by block power iteration."""
    some = min(matrix.shape[1], rank + 32)
    block = np.linalg.qr(np.random.default_rng(7).normal(size=(matrix.shape[1], some)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(matrix.T @ (matrix @ block))[0]
    return block @ np.linalg.svd(matrix @ block, full_matrices=False)[2].T[:, :rank]


def train(bag: np.ndarray, labels: np.ndarray) -> Model:
    """Term weights and the leading singular vectors of the sample (by its terms' products)."""
    seen = (bag > 0).sum(0)
    weight = np.where(seen > 0, np.log((1 + len(bag)) / (1 + seen)) + 1, 0).astype(np.float32)
    matrix = np.sqrt(bag) * weight
    used = np.flatnonzero(seen)
    basis = np.zeros((bag.shape[1], min(RANK, len(used), len(bag))), np.float32)
    basis[used] = leading(matrix[:, used].astype(np.float64), basis.shape[1])
    model = Model(weight, basis, np.zeros((0, 0), np.float32), labels.astype(np.float64))
    model.vectors = model.project(bag)
    return model


def bag_rows(docs: DataFrame) -> DataFrame:
    """doc_id and label of the sample with the texts' terms that occur."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            packed = []
            for a, b in chunks(data, at, most_rows=BLOCK):
                for bag in bags(data[at[a] : at[b]], at[a : b + 1] - at[a]):
                    i = np.flatnonzero(bag)
                    packed.append(i.astype("<u4").tobytes() + bag[i].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "label", "bag"]
            )

    return docs.select("doc_id", "text", "label").mapInArrow(scan, "doc_id long, label int, bag binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model from at most about `sample` labelled rows that are not held out."""
    learned = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    total = learned.count()
    if not total:
        return None
    uniform = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # About `sample` short rows, whatever the corpus holds: their broadcast has a fixed bound.
    chosen = learned.where(uniform < min(1.0, sample / total)).limit(2 * sample)
    texts = documents(docs).where(F.octet_length("text") <= LONGEST)
    rows = bag_rows(texts.join(F.broadcast(chosen), "doc_id")).limit(4 * sample).toArrow()
    if not len(rows):
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    bag = np.zeros((len(rows), TERMS), np.float32)
    for k, blob in enumerate(rows["bag"].to_pylist()):
        n = len(blob) // 8
        bag[k, np.frombuffer(blob, "<u4", n)] = np.frombuffer(blob, "<f4", n, 4 * n)
    return train(bag, rows["label"].to_numpy())


def scored(frame: DataFrame, model: Model | None, columns: list[str], schema: str) -> DataFrame:
    """The columns and the score of their text, by row."""
    if model is None:
        return frame.select(*columns, F.lit(0.5).alias("score"))
    shared = sent(frame.sparkSession, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            data, at = flat(batch.column("text"))
            parts = [
                model.scores(bags(data[at[a] : at[b]], at[a : b + 1] - at[a]))
                for a, b in chunks(data, at, most_rows=BLOCK)
            ]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(score)], [*columns, "score"]
            )

    return frame.mapInArrow(scan, f"{schema}, score double")


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted, by row."""
    out = scored(documents(docs), model, ["doc_id"], "doc_id long")
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that are not rejected."""
    names = docs.columns
    hidden = [f"c{k}" for k in range(len(names))]
    text = F.coalesce(F.col(hidden[names.index("text")]).cast("string"), F.lit("")).alias("text")
    frame = docs.toDF(*hidden).select(*hidden, text)
    schema = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in hidden)
    return scored(frame, model, hidden, schema).where(F.col("score") >= THRESHOLD).select(*hidden).toDF(*names)


ship_with_tasks(__name__)
