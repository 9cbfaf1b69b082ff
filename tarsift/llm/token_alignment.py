"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

1. `parts`: one pass over the texts. Each text, with a space before it, is cut in front of every
   space that follows a character other than white space (but not before trailing white space).
   Neither tokenizer has a token across such a cut (checked of both vocabularies; where it does
   not hold texts stay whole), so a text is a row of pieces, and a piece is tokenized and aligned
   once for each part that holds it.
2. `coalesce`: the tokens of both sides as intervals of bytes, sorted by start (np.lexsort); with
   the running maximum of their ends (np.maximum.accumulate) a group begins where a start reaches
   it, that is where tokens of both sides end. Within a group overlapping pairs are expanded.
3. Linked id pairs are summed for each part, then over the corpus by a grouping on the pair; the
   highest count of each B id is a window over that id's pairs, at most as many as A has ids.
   Parts get the counts of their own pairs back by joins on the pair and on the part.

A part is at most PART pieces, or one text: nothing grows with the corpus. Texts that are null or
empty, or whose tokens do not give back the text's bytes (B takes U+2581 for a space, for
example), have no tokens: zeros and an empty groups_sha256. Rows stay rows: repeated rows and
rows without doc_id are reported as they occur. Only doc_id and text are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarsift.llm.common import stored
from tarsift.session import ship_with_tasks

#: Pieces of a part; a longer text is a part of its own.
PART = 1 << 21
#: Characters of a text that are cut into pieces together.
STRETCH = 1 << 20
#: Pieces that are tokenized together.
TOGETHER = 1 << 16
CUT = re.compile(r"(?<=\S)(?= \s*\S)")
COLUMNS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
PART_COLUMNS = (
    "part long, doc_id array<long>, ends array<long>, sizes array<long>, sha array<string>, pieces binary, "
    "link_ends binary, links binary, pairs binary, times binary"
)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones as they are, the
    others as the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, from their files' contents, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, token in entries.items():
            known = all(c in letters for c in entry)
            self.a_bytes[token] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(k) else name.replace("▁", " ").encode()
            for k, name in enumerate(names)
        ]
        self.sizes = tuple(np.fromiter(map(len, e), np.int64, len(e)) for e in (self.a_bytes, self.b_bytes))
        set_up = json.loads(a_file)
        before = set_up.get("pre_tokenizer") or {}
        self.cuts = (
            set_up.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and letters.keys() <= entries.keys()
            and not any(re.search("[^▁]▁", name) for name in names)
        )

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of both sides for pieces that begin with a space, which B adds itself."""
        a = [one.ids for one in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        return a, self.b.encode([piece[1:] for piece in pieces], num_threads=1)

    def encode_cut(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """As `encode`; many short pieces go to A as one text, and its tokens are dealt out by
        their bytes. Pieces that end with white space would blend with the next one."""
        alone = [k for k, piece in enumerate(pieces) if piece[-1:].isspace() or len(piece) > 1000]
        lonely = set(alone)
        rows = [k for k in range(len(pieces)) if k not in lonely]
        a: list[list[int]] = [[] for _ in pieces]
        sizes = self.sizes[0]
        for at in range(0, len(rows), 2000):
            some = rows[at : at + 2000]
            ids = self.a.encode_batch_fast(["".join([pieces[k] for k in some])], add_special_tokens=False)[0].ids
            ends = np.cumsum([len(pieces[k].encode()) for k in some])
            cuts = np.searchsorted(np.cumsum(sizes[ids]), ends, "right").tolist()
            start = 0
            for k, end in zip(some, cuts, strict=True):
                a[k] = ids[start:end]
                start = end
        for k, ids in zip(alone, self.a.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False), strict=True):
            a[k] = ids.ids
        return a, self.b.encode([piece[1:] for piece in pieces], num_threads=1)


def coalesce(
    start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group of each A and each B token, and the A and B token of each overlapping pair.

    Both sides are ordered, and each covers the bytes without a gap."""
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    new = np.ones(len(order), np.int64)
    new[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.searchsorted(end_b, start_a, "right")
    last = np.searchsorted(start_b, end_a, "left")
    count = last - first
    left = np.repeat(np.arange(len(start_a)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[: len(start_a)], group[len(start_a) :], left, right


class Aligned:
    """Distinct pieces, aligned: of each its sizes, its groups as text and its linked pairs."""

    def __init__(self, tokenizers: Tokenizers, pieces: list[str]):
        self.ok = np.zeros(len(pieces), bool)
        self.sizes = np.zeros((len(pieces), 4), np.int64)
        self.text: list[str] = [""] * len(pieces)
        ends, links = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(pieces), TOGETHER):
            ends.append(self.some(tokenizers, at, pieces[at : at + TOGETHER], links))
        self.link_ends = np.cumsum(np.concatenate(ends))
        self.links = np.concatenate(links)

    def some(self, tokenizers: Tokenizers, at: int, pieces: list[str], links: list[np.ndarray]) -> np.ndarray:
        """Aligns pieces[at : ...]; returns the number of linked pairs of each."""
        encode = tokenizers.encode_cut if tokenizers.cuts else tokenizers.encode
        a_ids, b_ids = encode(pieces)
        for k, piece in enumerate(pieces):
            body = piece.encode()
            if (
                b"".join(map(tokenizers.a_bytes.__getitem__, a_ids[k])) == body
                and b"".join(map(tokenizers.b_bytes.__getitem__, b_ids[k])) == body
            ):
                self.ok[at + k] = True
            else:
                a_ids[k], b_ids[k] = [], []
        n = len(pieces)
        sides = []
        for ids, size in zip((a_ids, b_ids), tokenizers.sizes, strict=True):
            count = np.fromiter(map(len, ids), np.int64, n)
            flat = np.fromiter((t for one in ids for t in one), np.int64, int(count.sum()))
            end = np.cumsum(size[flat])
            sides.append((count, flat, end - size[flat], end))
        (n_a, a, start_a, end_a), (n_b, b, start_b, end_b) = sides
        group_a, group_b, left, right = coalesce(start_a, end_a, start_b, end_b)
        of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        n_links = np.bincount(of_a[left], minlength=n)
        first = np.ones(len(a), bool)
        first[1:] = group_a[1:] != group_a[:-1]
        self.sizes[at : at + n] = np.stack((n_a, n_b, np.bincount(of_a[first], minlength=n), n_links), 1)
        links.append((a[left].astype(np.uint64) << np.uint64(32)) | b[right].astype(np.uint64))
        # Groups as text: A ids, then B ids, each with the sign that follows it.
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        order = np.lexsort((np.repeat([0, 1], (len(a), len(b))), np.concatenate((group_a, group_b))))
        written = [f"{t}|" if e else f"{t}," for t, e in zip(a.tolist(), last_a.tolist(), strict=True)]
        written += [f"{t};" if e else f"{t}," for t, e in zip(b.tolist(), last_b.tolist(), strict=True)]
        row = list(map(written.__getitem__, order.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        begin = 0
        for k, end in enumerate(ends):
            self.text[at + k] = "".join(row[begin:end])
            begin = end
        return n_links


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about STRETCH characters, ending at a cut."""
    at = 0
    while len(text) - at > STRETCH:
        found = CUT.search(text, at + STRETCH)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 by byte planes, compressed."""
    planes = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def spread(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.Codec("zstd").decompress(blob[8:], 4 * n, asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view(np.uint32).reshape(-1).astype(np.int64)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs that end at `ends`."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))] if len(ends) else values[:0]


def parts(docs: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """Rows of PART_COLUMNS: texts as numbers of pieces, pieces as numbers of linked pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_file, b_file)
        known: dict[str, int] = {}
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        ends: list[int] = []
        total = made = 0
        kind = pa.schema(
            [
                ("part", pa.int64()),
                ("doc_id", pa.list_(pa.int64())),
                ("ends", pa.list_(pa.int64())),
                ("sizes", pa.list_(pa.int64())),
                ("sha", pa.list_(pa.string())),
                *((name, pa.binary()) for name in ("pieces", "link_ends", "links", "pairs", "times")),
            ]
        )

        def finished() -> pa.RecordBatch:
            aligned = Aligned(tokenizers, list(known))
            numbers = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            at, sizes, sha, kept, stops = 0, [], [], [], []
            stop = 0
            for end in ends:
                some = numbers[at:end]
                if len(some) and aligned.ok[some].all():
                    body = hashlib.sha256()
                    for k in range(0, len(some), PART):
                        piece = "".join(map(aligned.text.__getitem__, some[k : k + PART].tolist()))
                        body.update((piece if k + PART < len(some) else piece[:-1]).encode())
                    sha.append(body.hexdigest())
                    sizes.extend(aligned.sizes[some].sum(0).tolist())
                    kept.append(some)
                    stop += len(some)
                else:
                    sha.append("")
                    sizes.extend([0, 0, 0, 0])
                stops.append(stop)
                at = end
            used = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            pairs, links = np.unique(aligned.links, return_inverse=True)
            begins = np.concatenate(([0], aligned.link_ends))
            weight = np.repeat(np.bincount(used, minlength=len(known)), np.diff(begins))
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, links, weight)
            part = (TaskContext.get().partitionId() << 33) + made
            row = [part, ids[:], stops, sizes, sha, squeezed(used), squeezed(np.diff(begins)), squeezed(links)]
            row += [pairs.tobytes(), times.tobytes()]
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind, strict=True)], schema=kind)
            known.clear()
            ids.clear()
            rows.clear()
            ends.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id.as_py())
                if text:
                    text = " " + text
                    for stretch in stretches(text) if tokenizers.cuts else [text]:
                        pieces = CUT.split(stretch) if tokenizers.cuts else [stretch]
                        number = np.fromiter(
                            (known.setdefault(piece, len(known)) for piece in pieces), np.int64, len(pieces)
                        )
                        rows.append(number.astype(np.int32))
                        total += len(pieces)
                ends.append(total)
                if total >= PART or len(ids) >= PART // 8:
                    yield finished()
                    made, total = made + 1, 0
        if ids:
            yield finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, PART_COLUMNS
    )


def linked_pairs(cut: DataFrame) -> DataFrame:
    """part, a, b, n: how often a part's tokens a and b are linked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(pairs, np.uint64)
                n = np.frombuffer(times, np.int64)
                pair, n = pair[n > 0], n[n > 0]
                for k in range(0, len(pair), 1 << 16):
                    some = pair[k : k + (1 << 16)]
                    a, b = (some >> np.uint64(32)).astype(np.int32), some.astype(np.uint32).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), part)), pa.array(a), pa.array(b), pa.array(n[k : k + (1 << 16)])],
                        ["part", "a", "b", "n"],
                    )

    return cut.select("part", "pairs", "times").mapInArrow(scan, "part long, a int, b int, n long")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, links, best: an id pair's links in the corpus, and whether no A id has more with b."""
    counts = linked.groupBy("a", "b").agg(F.sum("n").alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def counted(cut: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one part with the counts of their links."""
    if not cut.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in zip(NAMES, KINDS, strict=True)})
    row = {name: cut[name][0].as_py() for name in cut.column_names}
    a, b = (answers[name].to_numpy().astype(np.uint64) for name in ("a", "b"))
    key = (a << np.uint64(32)) | b
    order = np.argsort(key)
    pairs = np.frombuffer(row["pairs"], np.uint64)
    value = np.zeros((len(pairs), 2), np.int64)
    if len(key):
        at = np.minimum(np.searchsorted(key[order], pairs), len(key) - 1)
        here = key[order][at] == pairs
        value[here, 0] = answers["best"].to_numpy(zero_copy_only=False)[order][at[here]]
        value[here, 1] = answers["links"].to_numpy()[order][at[here]]
    of_piece = sums(value[spread(row["links"])], np.cumsum(spread(row["link_ends"])))
    of_text = sums(of_piece[spread(row["pieces"])], np.array(row["ends"], np.int64))
    sizes = np.array(row["sizes"], np.int64).reshape(-1, 4)
    columns = [row["doc_id"], *sizes.T, of_text[:, 0], of_text[:, 1], row["sha"]]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(NAMES, columns, KINDS, strict=True)})


NAMES = [column.split()[0] for column in COLUMNS.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.string()]


def alignment(docs: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """COLUMNS, one row for each row of docs. a_file: contents of a byte-level BPE's JSON file,
    b_file: of a SentencePiece model (megabytes; they go to the tasks with the code)."""
    cut = stored(parts(docs, a_file, b_file))
    linked = linked_pairs(cut)
    answers = linked.select("part", "a", "b").join(pair_counts(linked), ["a", "b"])
    return cut.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(counted, COLUMNS)


ship_with_tasks(__name__)
