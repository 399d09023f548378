"""Words of whole texts and their hashes, computed with numpy for many texts at a time.

Two kinds of words are known: ``SPACED`` (runs of bytes that are no ASCII white space) and
``ALNUM`` (runs of ASCII letters, digits and non-ASCII bytes). Both are defined on UTF-8 bytes;
separators are ASCII, so a character is never cut. A word has a 64-bit hash that depends only on
its bytes, and so has every window of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about so many bytes (a longer text is a chunk of its own), so
#: that the arrays of a task stay at some tens of MB whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 20

_BYTE = np.arange(256)
#: ``[^\x20\x09-\x0D]``
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_RANDOM = np.random.default_rng(20240229)
OF_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close numbers end far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.ones(1 << (n - 1).bit_length(), np.uint64)
            steps[1:] = self.base
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


POWERS, _WINDOW_POWERS = _Powers(_BASE), _Powers(_WINDOW_BASE)
#: For a second hash of a window, where 64 bits are too few to take equal hashes as equal windows.
CHECK_POWERS = _Powers(0xA24BAED4963EE407)


@dataclass
class Chunk:
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are the words of text ``at + i``."""

    at: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, powers: _Powers | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the ``width`` words from each word on, and whether they lie in one text; other ``powers`` give another hash."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = (powers or _WINDOW_POWERS).upto(len(self.hashes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:-1])])
        text = np.repeat(np.arange(len(self)), self.counts())
        return mix((total[width:] - total[:n]) * down[:n]), text[:n] == text[width - 1 :]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def chunks(column: pa.Array, kind: np.ndarray, lower: bool) -> Iterator[Chunk]:
    """The words of a column of texts; with ``lower``, A-Z count as a-z."""
    if not len(column):
        return
    offsets, data = _texts(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        own = data[offsets[at] : offsets[end]]
        yield _chunk(at, _LOWER[own] if lower else own, offsets[at : end + 1] - offsets[at], kind)
        at = end


def _chunk(at: int, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Chunk:
    inside = np.concatenate([[False], kind[data], [False]])
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]  # two texts meet here without a separator
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = POWERS.upto(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(OF_BYTE[data] * up[:-1])])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Chunk(at, data, starts, ends, np.searchsorted(starts, offsets), hashes)


def sliding(values: np.ndarray, width: int, reduce: np.ufunc) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = reduce(out[:-step], out[step:])
        done += step
    return out
