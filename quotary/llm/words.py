"""Words of many texts at once, as arrays: where each starts and ends, whose it is, and a 64-bit hash of it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: [\x20\x09-\x0D] separates words of the first kind.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F] separates words of the second kind, once A-Z is lower-cased.
MARKS = np.zeros(256, bool)
MARKS[:0x30] = MARKS[0x3A:0x61] = MARKS[0x7B:0x80] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of ``base`` modulo 2**64; those known times one more power give as many again."""
    out = np.ones(n, np.uint64)
    known = 1
    while known < n:
        more = out[known : 2 * known]
        np.multiply(out[: more.size], np.uint64(pow(int(base), known, 1 << 64)), out=more)
        known *= 2
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    buf: np.ndarray  # bytes of all texts, a newline between them
    starts: np.ndarray  # of each word, in buf
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one entry more than texts
    hashes: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(self.first.size - 1), np.diff(self.first))

    def joined(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The words, each followed by a space, and where each begins; only those that ``keep`` marks."""
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        edge = np.zeros(self.buf.size + 2, np.int8)
        edge[starts] += 1
        edge[ends + 1] -= 1
        spaced = np.append(self.buf, np.uint8(0x20))
        spaced[ends] = 0x20
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        return spaced[inside[: spaced.size]].tobytes(), at


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, from running sums over the whole buffer."""
    total = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_STEP, buf.size), dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_BACK, buf.size + 1)[starts] + (ends - starts).astype(np.uint64))


def spans(texts: pa.Array | list, separators: np.ndarray, lower: bool = False):
    """The texts' bytes with a newline between two, where each word starts and ends in them, and where each text begins."""
    raw = [x or b"" for x in (texts.cast(pa.binary()).to_pylist() if isinstance(texts, pa.Array) else texts)]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = np.zeros(buf.size + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    turn = np.diff(inside)
    return buf, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), np.cumsum([0, *[len(x) + 1 for x in raw]])


def scan(texts: pa.Array | list, separators: np.ndarray, lower: bool = False, hashes: bool = True) -> Words:
    """The words of each text; null has none. Without ``hashes`` words have none."""
    buf, starts, ends, begins = spans(texts, separators, lower)
    return Words(buf, starts, ends, np.searchsorted(starts, begins), hashed(buf, starts, ends) if hashes else np.zeros(0, np.uint64))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words, by its first word; runs over the end of a text are the caller's to leave out."""
    if hashes.size < size:
        return np.zeros(0, np.uint64)
    weights = np.random.default_rng([size, seed]).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(hashes.size - size + 1, np.uint64)
    for i, w in enumerate(weights):
        out += hashes[i : i + out.size] * w
    return mix(out)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indexes of the words at which a run of ``size`` words of one text starts."""
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(words.starts.size)
    return np.flatnonzero(left >= size)
