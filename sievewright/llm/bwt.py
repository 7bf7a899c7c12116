"""Common prefixes of many short strings, from the Burrows-Wheeler transform of their collection."""

from __future__ import annotations

import numpy as np


def collection(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, window of each place): bytes raised by one, every window closed by 0."""
    lengths = np.array([len(w) + 1 for w in windows])
    text = np.frombuffer(b"\x00".join(windows) + b"\x00", np.uint8).astype(np.int16) + 1
    text[np.cumsum(lengths) - 1] = 0
    return text, np.repeat(np.arange(len(windows)), lengths)


def suffix_array(text: np.ndarray, window: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first ``depth`` symbols at least; a suffix ends at its window's end mark, and end marks rank by window.

    Prefix doubling: seven symbols first, then pairs of ranks. Intervals of strings up to ``depth`` symbols, and so
    their mapping by backward extension, do not depend on how suffixes are ordered that share more.
    """
    n, closed = len(text), np.flatnonzero(text == 0)
    left = closed[window] - np.arange(n)  # symbols before the end mark
    padded = np.concatenate([text, np.zeros(7, np.int16)])
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(7):
        key = key << np.uint64(9) | np.where(alive, padded[k : k + n], 0).astype(np.uint64)
        alive &= left > k
    width, most = 7, min(int(left.max(initial=0)) + 1, depth)
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    while True:
        # A suffix that has ended within ``width`` symbols is told from its like by its window.
        at = np.minimum(np.arange(n) + width, n - 1)
        second = np.where(left < width, window, rank[at])
        pair = rank.astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        order = np.argsort(pair)
        if 2 * width >= most:
            return order
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        width *= 2


def prefix_boundaries(text: np.ndarray, window: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True at each place of ``order`` whose suffix shares fewer than ``least`` symbols with the one before it.

    Backward extension in breadth-first order: level l holds the intervals of all strings of length l whose right end
    has just been found. Extending an interval by each symbol before it gives the intervals of the next level, and a
    right end that no shorter string has set gets common prefix l. Levels stop at ``least``: the places left unset are
    those with a longer common prefix, and nothing beyond it is derived.
    """
    n = len(text)
    order = order.astype(np.int32)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # the last-to-first mapping
    step[by_symbol] = np.arange(n, dtype=np.int32)
    after = np.full(n, n, np.int32)  # next place with the same symbol before it
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before = np.full(n, -1, np.int32)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    # Level 0: one interval per end mark, and one per symbol.
    marks = int(window[-1]) + 1
    first = text[order]
    ends = np.concatenate([np.arange(1, marks + 1), np.flatnonzero(first[1:] != first[:-1]) + 1, [n]])
    ends = np.unique(ends).astype(np.int32)
    lows = np.concatenate([ends[:1] * 0, ends[:-1]])
    found[ends] = True
    for _ in range(1, least):
        if not len(lows):
            break
        sizes = ends - lows
        place = np.repeat(lows - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        letter = bwt[place] != 0
        last = place[letter & (after[place] >= np.repeat(ends, sizes))]
        head = place[letter & (before[place] < np.repeat(lows, sizes))]
        high, low = np.sort(step[last]) + 1, np.sort(step[head])
        new = ~found[high]
        found[high[new]] = True
        lows, ends = low[new], high[new]
    return found[:n]
