"""Hashes of texts' words, many at once: a word's hash comes from prefix sums over the bytes, not from a loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
SEGMENT = 1 << 18


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest segment so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), SEGMENT + 1024)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    _powers.to(n)
    return _powers.up[:n], _powers.down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(values) + 1)[0][:-1])])


def sum_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many ranges, given prefix_sums(values): their differences, moved back to the same power."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def _segment(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    start, end = edges[::2], edges[1::2]
    return start, mix(sum_hashes(prefix_sums(_FOLD[raw]), start, end) + mix((end - start).astype(np.uint64)))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased), in order.

    Equal words have equal hashes. Long texts are taken in segments cut at white space, so memory stays bounded but for
    a single longer word.
    """
    places, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        cut = _SPACES.search(data, at + SEGMENT) if at + SEGMENT < len(data) else None
        end = cut.start() if cut else len(data)
        start, h = _segment(np.frombuffer(data, np.uint8, end - at, at))
        places.append(start + at)
        hashes.append(h)
        at = end
    return np.concatenate(places), np.concatenate(hashes)


def word_hashes(text: str | None) -> np.ndarray:
    return words_of((text or "").encode("utf-8", "surrogatepass"))[1]


def lots(texts: Iterable[str | None], size: int = 1 << 16) -> Iterator[list[bytes]]:
    """The texts' bytes in lists of about `size` bytes: short texts are worth a step of numpy only together."""
    lot, n = [], 0
    for text in texts:
        lot.append((text or "").encode("utf-8", "surrogatepass"))
        n += len(lot[-1])
        if n >= size:
            yield lot
            lot, n = [], 0
    if lot:
        yield lot


def many_word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """word_hashes() of each text."""
    for lot in lots(texts):
        places, hashes = words_of(b"\n".join(lot))
        ends = np.cumsum([len(data) + 1 for data in lot])
        yield from np.split(hashes, np.searchsorted(places, ends[:-1]))


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple]:
    """The key values and rows of each group of a sorted stream of batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if batch.num_rows > 1 else np.zeros(1, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            part = pa.Table.from_batches([batch.slice(s, e - s)])
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                rows, held = pa.concat_tables(held).combine_chunks(), []
                yield (*[rows.column(k)[0].as_py() for k in keys], rows)
            held.append(part)
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield (*[rows.column(k)[0].as_py() for k in keys], rows)
