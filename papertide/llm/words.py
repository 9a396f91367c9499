"""Words and their 64-bit hashes for many texts at once, on numpy.

A `Chunk` joins a few megabytes of encoded texts into one buffer and finds all
words with array operations.  Hashes only pick candidates and routes; whoever
needs equality compares the words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
#: Bytes that separate words: white space, or everything of ASCII but digits and lower-case letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 1 << 22:  # a single huge text: not kept
            return tuple(made)
        _powers[size] = tuple(made)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Chunk:
    """starts, ends: byte places of the words in buf; lo, hi: the words of text i are lo[i]:hi[i]."""

    def __init__(self, texts: Sequence[bytes], separators: np.ndarray = SPACE):
        joined = b" ".join([*texts, b""]) or b" "
        self.raw = joined
        self.buf = buf = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~separators[buf]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.searchsorted(self.starts, at)
        self.lo, self.hi = cut[:-1], cut[1:]
        self.size = len(self.starts)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.buf))
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h ^ (self.ends - self.starts).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.hi - self.lo)

    def window_ok(self, k: int) -> np.ndarray:
        """For each place of a window of k words: whether it lies in one text."""
        n = max(0, self.size - k + 1)
        left = np.repeat(self.hi, self.hi - self.lo)[:n] - np.arange(n)
        return left >= k


def chunks(texts: Sequence[bytes], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive entries of h, by doubling."""
    c = (0xD6E8FEB86659FD93 + 2 * seed) | 1
    done, width, at, power, length = None, 0, h, c, 1
    while True:
        if k & length:
            done, width = (at, length) if done is None else (done[: len(h) - width - length + 1] * _U(pow(c, length, 1 << 64)) + at[width : width + len(h) - width - length + 1], width + length)
        if (length << 1) > k:
            break
        at = at[:-length] * _U(power) + at[length:] if len(at) > length else at[:0]
        power = power * power % (1 << 64)
        length <<= 1
        if len(at) == 0 and k >= length:
            return at
    return mix(done) if len(h) >= k else h[:0]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries."""
    if len(h) < w:
        return h[:0]
    at, length = h, 1
    while length * 2 <= w:
        at = np.minimum(at[:-length], at[length:])
        length *= 2
    rest = w - length
    return np.minimum(at[: len(at) - rest], at[rest:]) if rest else at
