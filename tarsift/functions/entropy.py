"""Byte entropy as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tarsift.session import ship_with_tasks

ship_with_tasks(__name__)


#: Bytes whose histogram is taken at once.
PIECE = 1 << 22


def entropy_of(counts: np.ndarray) -> float | np.ndarray:
    """Bits per byte, from how often each of the 256 byte values occurs (last axis)."""
    total = counts.sum(axis=-1, keepdims=True)
    share = counts / np.maximum(total, 1)
    logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
    return -(share * logs).sum(axis=-1) + 0.0


def histogram(data: bytes | memoryview) -> np.ndarray:
    """How often each byte value occurs; a long text is counted in pieces."""
    whole = np.frombuffer(data, dtype=np.uint8)
    pieces = (np.bincount(whole[a : a + PIECE], minlength=256) for a in range(0, len(whole), PIECE))
    return sum(pieces, np.zeros(256, np.int64))


def bits_per_byte(data: bytes) -> float:
    """Shannon entropy of the bytes."""
    return float(entropy_of(histogram(data)))


def row_histograms(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 256 byte counts of each row, for rows that lie one after another.

    One histogram over row * 256 + byte for each PIECE of bytes, whatever rows it holds."""
    counts = np.zeros((len(ends), 256), np.int64)
    for at in range(0, len(data), PIECE):
        to = min(at + PIECE, len(data))
        first, last = np.searchsorted(ends, [at, to - 1], "right")
        row = np.searchsorted(ends[first : last + 1], np.arange(at, to), "right")
        here = np.bincount(row * 256 + data[at:to], minlength=(last + 1 - first) * 256)
        counts[first : last + 1] += here.reshape(-1, 256)
    return counts


@F.arrow_udf(DoubleType())
def byte_entropy(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Shannon entropy in bits per byte. Pass NULL for rows that need no answer: they
    then cost no transfer."""
    for batch in batches:
        column = batch.cast(pa.large_binary())
        _, offsets, body = column.buffers()
        ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
        found = entropy_of(row_histograms(data, ends[1:] - ends[0])) if len(column) else np.zeros(0)
        yield pa.array(found, pa.float64(), mask=column.is_null().to_numpy(zero_copy_only=False))
