"""Vectorised word shingles: 64-bit hashes of words and word n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(256)).lower()
#: Texts are hashed together up to so many bytes.
CHUNK = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (splitmix64 finaliser)."""
    x = (x ^ _U((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the index of each word's text. A-Z count as a-z."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    gap = _GAP[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(limits, starts, side="right")


def shingle_sets(texts: list[bytes | None], n: int):
    """Yield each text's sorted distinct shingle hashes, in order.

    A text with fewer than ``n`` words, but some, has its whole word sequence as its one shingle;
    a null text or one without words has none.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") <= CHUNK):
            size += len(texts[to] or b"") + 1
            to += 1
        words, owner = word_hashes([t or b"" for t in texts[at:to]])
        bounds = np.searchsorted(owner, np.arange(to - at + 1))
        full = np.zeros(max(0, len(words) - n + 1), _U)
        for j in range(n):
            full = mix(full + words[j : j + len(full)], j + 1)
        for i in range(to - at):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                s = np.sort(full[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                h = np.zeros(1, _U)
                for j in range(b - a):
                    h = mix(h + words[a + j : a + j + 1], j + 1)
                yield mix(h, 1000 + b - a)
            else:
                yield np.zeros(0, _U)
        at = to
