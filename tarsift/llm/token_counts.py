"""Token counts of a unigram segmentation, by dynamic programming shared over a trie.

A pre-token is a word ([^\\x20\\x09-\\x0D]+) with the word mark before it. Its best segmentation
maximises the sum of its pieces' scores; of equal sums the one with fewer tokens counts. The
forward score of a prefix does not depend on what follows, so the distinct pre-tokens of a task
are inserted in a trie and the recurrence runs once for each node: a new word costs only what it
does not share. The node on which a word ends gives its count, which is stored; a word met again
costs one lookup. Characters that no piece covers become byte tokens.

The vocabulary is a file of a public tokenizer, whose pieces stand in the order of their ranks.
Scores are log shares by Zipf's law over the ranks (a parameter); nothing is trained. It is
broadcast; its size is the file's. Tasks keep at most `NODES` nodes and start anew beyond; of a
word only the first `SHARED` characters are kept as nodes, the rest is computed for itself, so
that memory does not depend on the texts. Texts are read whole, in one pass without a shuffle.

A null or empty text has no tokens. Rows without doc_id and repeated rows are counted like
others. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarsift.llm.common import documents
from tarsift.session import ship_with_tasks

MARK = "▁"
NODES = 1 << 20
SHARED = 64
#: What a byte token scores below the rarest piece.
BYTE_PENALTY = 10.0
OFFSET = 2.7


def unigram_pieces(path: str, offset: float = OFFSET) -> dict[str, float]:
    """Piece to log share: 1 / (rank + offset), over all ordinary pieces of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    share = 1.0 / (np.arange(len(own)) + offset)
    return dict(zip(map(model.id_to_piece, own), np.log(share / share.sum()).tolist(), strict=True))


class Trie(dict):
    """Word (bytes) to its number of tokens; a missing word is inserted and computed.

    Nodes are numbers; `child` leads from (node, character) to the next, `score` and `count` are
    the forward values of the prefix that ends there.
    """

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def __missing__(self, word: bytes) -> int:
        if len(self.score) > NODES or len(self) > NODES:
            self.restart()
        text = MARK + word.decode("utf-8", "replace")
        scores, counts, node = [0.0], [0], 0
        for end, char in enumerate(text, 1):
            step = self.child.get((node, char)) if node >= 0 else None
            if step is None:
                best, tokens = self.forward(text, end, scores, counts)
                if node >= 0 and end <= SHARED:
                    step = len(self.score)
                    self.child[node, char] = step
                    self.score.append(best)
                    self.count.append(tokens)
                else:
                    step = -1
            else:
                best, tokens = self.score[step], self.count[step]
            scores.append(best)
            counts.append(tokens)
            node = step
        self[word] = counts[-1]
        return counts[-1]

    def forward(self, text: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """The best (score, tokens) of the prefix, from those of all shorter prefixes."""
        pieces, best, tokens = self.pieces, None, 0
        for begin in range(max(0, end - self.longest), end):
            own = pieces.get(text[begin:end])
            if own is not None:
                value, count = scores[begin] + own, counts[begin] + 1
                if best is None or value > best or (value == best and count < tokens):
                    best, tokens = value, count
        if text[end - 1] not in pieces:
            size = len(text[end - 1].encode())
            value, count = scores[end - 1] + self.byte, counts[end - 1] + size
            if best is None or value > best or (value == best and count < tokens):
                best, tokens = value, count
        return best, tokens


def token_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """doc_id, n_words, n_tokens, by row."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()):
                found = text.as_py().split()
                words.append(len(found))
                tokens.append(sum(map(trie.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return documents(docs).mapInArrow(scan, "doc_id long, n_words long, n_tokens long")


ship_with_tasks(__name__)
