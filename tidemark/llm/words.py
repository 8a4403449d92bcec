"""Words of an Arrow column of texts as numpy arrays: offsets and hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Words:
    """data: the bytes of all texts; starts, ends: of each word in them; first: number of the first word of each text,
    with the number of all words at the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of the bytes of each word: differences of running sums of byte times power."""
        data = lowered(self.data) if lower else self.data
        up, down = _POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        raw = self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        return raw if (self.starts[a + 1 : b] - self.ends[a : b - 1] == 1).all() and not _ODD.intersection(raw) else b" ".join(raw.split())


_ODD = frozenset(b"\t\n\x0b\x0c\r")


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def words_of(texts: pa.Array, blank: np.ndarray = _BLANK) -> Words:
    """Words are runs of bytes that `blank` does not mark, by default those other than space and \\t to \\r; null is an empty
    text. Marked bytes are below 0x80 and so never occur inside a UTF-8 character: bytes give the same words as characters."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = ~blank[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def runs_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbours (len(hashes) - n + 1 of them)."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[j : j + len(out)])
    return out
