"""Vectorised text helpers for code that runs in tasks: words, hashes, slices of Arrow columns.

Texts of a batch are laid end to end as bytes; words and character n-grams are hashed with array
operations over the whole run, so no Python code runs per word. Hashes have 64 bits and do not depend on
the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    have = _powers.get("n", 0)
    if have < n:
        n = max(n, 2 * SLICE_BYTES)
        inverse = pow(int(_BASE), -1, 1 << 64)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, each followed by a line feed, and where each begins (with the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.concatenate(([0], np.cumsum(sizes)))


def words_of(texts: list[bytes], lower: bool = False, space: np.ndarray = IS_SPACE):
    """Hashes of all words in order, where each text's words begin, and each word's first and last byte."""
    buf, begins = joined(texts)
    if lower:
        buf = LOWER[buf]
    gap = space[buf]
    gap = np.concatenate(([True], gap))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _WORD)
    return hashes, np.searchsorted(starts, begins), starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _WORD + hashes[j : j + n]
    return mix(out)


class Ranges:
    """Hashes of any ranges of a sequence of items, by prefix sums; equal items in equal order hash alike."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.up, self.down = _power(len(items) + 2)
        self.total = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items) * self.up[: len(items)], out=self.total[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _WORD)

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the range without its item ``at``, that of the shorter sequence."""
        joined = self.raw(start, at) + (self.total[end] - self.total[at + 1]) * self.down[start + 1]
        return mix(joined + (end - start - 1).astype(np.uint64) * _WORD)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least item of each run of w, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``limit`` bytes of text each, and the texts as bytes (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64) + 1
        at, total = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            part = batch.slice(at, stop - at)
            values = part.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            yield part, [v or b"" for v in values]
            at = stop


def lists(values: np.ndarray, counts: list[int], kind=pa.int64()) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
