"""Five-word shingles of whole texts, hashed in numpy inside tasks."""

from __future__ import annotations

import numpy as np

WORDS = 5
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64), 77)
_BASE = 0x5851F42D4C957F2D  # odd, so that products of powers stay invertible
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Hasher:
    """Word hashes from prefix sums of a polynomial; the powers are kept between texts."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        """One hash per word of the text with A-Z lowered."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self.up) <= len(raw):
            n = 1 << (len(raw) + 1).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes; fewer than five words are one shingle, no words none."""
        w = self.words(text)
        if not len(w):
            return w
        size = min(WORDS, len(w))
        total = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            total = mixed(total + w[k : k + len(total)], k)
        return np.unique(total)
