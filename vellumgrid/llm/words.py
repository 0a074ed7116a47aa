"""Words and word n-grams of many texts at once, as NumPy arrays of 64-bit hashes.

A word is a longest run of letters or digits, lower-cased. Texts are handled in
chunks of about a quarter million characters, so memory does not grow with the
batch, and a single very long text is cut between words and put together again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U = np.uint64
CHUNK = 1 << 18
_TABLE = 0x3000
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _code(cp: int) -> int:
    """The lower-case code point plus one for letters and digits, 0 for all else."""
    if 0xD800 <= cp < 0xE000:
        return 0
    ch = chr(cp)
    return ord(ch.lower()[0]) + 1 if ch.isalnum() else 0


class _Tables:
    letters: np.ndarray | None = None
    powers = np.ones(1, U)
    rare: dict[int, int] = {}

    @classmethod
    def lookup(cls, cps: np.ndarray) -> np.ndarray:
        if cls.letters is None:
            codes = np.array([_code(c) for c in range(_TABLE)] + [0], dtype=U)
            cls.letters = np.where(codes > 0, mix(codes) | U(1), U(0))
        out = cls.letters[np.minimum(cps, _TABLE)]
        high = np.flatnonzero(cps >= _TABLE)
        if len(high):
            kinds, back = np.unique(cps[high], return_inverse=True)
            codes = np.array([_code(int(c)) for c in kinds], dtype=U)
            out[high] = np.where(codes > 0, mix(codes) | U(1), U(0))[back]
        return out

    @classmethod
    def power(cls, n: int) -> np.ndarray:
        if len(cls.powers) < n:
            size = max(64, 1 << (n - 1).bit_length())
            with np.errstate(over="ignore"):
                cls.powers = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, _BASE, U))))
        return cls.powers


def _hash(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last+1 position of each word."""
    t = _Tables.lookup(cps)
    live = np.flatnonzero(t)
    if not len(live):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none
    first = np.concatenate(([0], np.flatnonzero(np.diff(live) > 1) + 1))
    length = np.diff(np.append(first, len(live)))
    place = np.arange(len(live)) - np.repeat(first, length)
    h = np.add.reduceat(t[live] * _Tables.power(int(length.max()))[place], first)
    start = live[first]
    return mix(h ^ (length.astype(U) << U(56))), start, start + length


def beginnings(cps: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of all strict prefixes of the words at ``start:stop``, as these prefixes have them as words."""
    length = stop - start
    if not len(length):
        return np.zeros(0, U)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    part = _Tables.lookup(cps[np.repeat(start, length) + place]) * _Tables.power(int(length.max()))[place]
    total = np.cumsum(part)
    h = mix((total - np.repeat(total[first] - part[first], length)) ^ ((place + 1).astype(U) << U(56)))
    return h[place + 1 < np.repeat(length, length)]


@dataclass
class Chunk:
    """Words of the texts ``lo`` to ``hi`` (exclusive): text ``lo+k`` owns words ``bounds[k]:bounds[k+1]``."""

    lo: int
    hi: int
    bounds: np.ndarray
    hashes: np.ndarray
    points: np.ndarray | None = None  # code points, when kept
    start: np.ndarray | None = None
    stop: np.ndarray | None = None

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.bounds))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def chunks(texts: Sequence[str | None], keep: bool = False) -> Iterator[Chunk]:
    """The words of ``texts`` chunk by chunk; NULL counts as empty. ``keep``: with code points and word positions."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < CHUNK):
            size += len(texts[hi] or "") + 1
            hi += 1
        group = [x or "" for x in texts[lo:hi]]
        if size <= 2 * CHUNK or keep:
            cps = _points("\n".join(group) + "\n")
            h, start, stop = _hash(cps)
            ends = np.cumsum([len(x) + 1 for x in group])
            bounds = np.concatenate(([0], np.searchsorted(start, ends)))
            yield Chunk(lo, hi, bounds, h, *((cps, start, stop) if keep else ()))
        else:  # one long text, a piece at a time
            text, at, parts = group[0], 0, []
            while at < len(text):
                end = min(len(text), at + CHUNK)
                while end < len(text) and text[end].isalnum():
                    end += 1
                parts.append(_hash(_points(text[at:end]))[0])
                at = end
            h = np.concatenate(parts)
            yield Chunk(lo, hi, np.array([0, len(h)]), h)
        lo = hi


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return out


def gram_sets(texts: Sequence[str | None], n: int, least_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(index, words, sorted distinct n-grams)`` of every text with at least ``least_words`` words."""
    for c in chunks(texts):
        grams = ngrams(c.hashes, n)
        for k in np.flatnonzero(np.diff(c.bounds) >= max(least_words, n)):
            a, b = int(c.bounds[k]), int(c.bounds[k + 1])
            yield c.lo + int(k), b - a, np.unique(grams[a : b - n + 1])
