"""Word shingles of whole texts as sets of 64-bit hashes, by array operations on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
BLOCK = 1 << 18  # bytes of texts at once, so that their arrays stay in a core's cache


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_HELD = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n`` at least; a worker keeps the longest made so far."""
    if len(_HELD[0]) <= n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _HELD[:] = np.cumprod(up), np.cumprod(down)
    return _HELD[0], _HELD[1]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a text's bytes; a word's hash does not depend on where it stands."""
    data = _LOWER[data]
    gap = np.concatenate([[True], _SPACE[data], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[-1])


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(words) - n + 1, n * 0x632BE59BD9B4E019 & _MASK, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _STEP[k]
    return mix(out)


def sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text its distinct shingles of ``width`` words, sorted. Fewer words are one shingle, none give an empty set.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts are joined into blocks, so that short ones cost little.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < BLOCK):
            size += len(raw[end]) + 1
            end += 1
        starts, words = _words(np.frombuffer(b" ".join(raw[at:end]), np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[at:end])]))
        every = _combined(words, width) if len(words) >= width else words[:0]
        for k in range(end - at):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            else:
                yield _combined(words[a:b], b - a) if b > a else words[:0]
        at = end


def signatures(found: list[np.ndarray], size: int) -> np.ndarray:
    """(texts, size) 16-bit minhash components; rows of empty sets are zeros."""
    full = [k for k, s in enumerate(found) if len(s)]
    out = np.zeros((len(found), size), np.uint16)
    rng = np.random.default_rng(11)
    times, plus = rng.integers(0, 1 << 63, size, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)
    at = 0
    while at < len(full):
        end, n = at, 0
        while end < len(full) and (end == at or n < 200_000):
            n += len(found[full[end]])
            end += 1
        own = [found[k] for k in full[at:end]]
        every, first = np.concatenate(own), np.cumsum([0, *(len(s) for s in own[:-1])])
        for j in range(size):
            low = np.minimum.reduceat(every * times[j] + plus[j], first)
            out[full[at:end], j] = (low * _U(_BASE)) >> _U(48)
        at = end
    return out
