"""Locally consistent parsing of token strings by recompression, in numpy, many documents at once.

A round names maximal runs of one symbol, then pairs of symbols whose coins fall left and right. A name
is a hash of what it stands for, so every executor gives the same run or pair the same name in the
same round. Next to each symbol stands its context: the words that, wherever they occur, make the
parse produce that symbol there. Equal windows thus hold the same symbols with contexts inside.
"""

import numpy as np

ROUNDS = 4
_FAR = np.int64(1) << np.int64(40)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of two."""
    h = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(name, first, last, doc):
    """Name maximal runs. A symbol's context grows by its neighbours': they show where the run ends."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = end - start
    run = np.where(size > 1, mix(name[start], size.astype(np.uint64) + np.uint64(1 << 32)), name[start])
    a, b = np.minimum.reduceat(first, start), np.maximum.reduceat(last, start)
    left, right = np.maximum(start - 1, 0), np.minimum(end, n - 1)
    a2 = np.where((start > 0) & (doc[left] == doc[start]), np.minimum(a, first[left]), -_FAR)
    b2 = np.where((end < n) & (doc[right] == doc[start]), np.maximum(b, last[right]), _FAR)
    return run, a2, b2, doc[start]


def _pairs(name, first, last, doc, level):
    """Name pairs of a left and a right symbol; a symbol left alone depends on the neighbour it might have met."""
    n = len(name)
    right = (mix(name, np.uint64(level)) & np.uint64(1)).astype(bool)
    same = np.zeros(n, bool)
    same[:-1] = doc[1:] == doc[:-1]
    head = np.zeros(n, bool)
    head[:-1] = ~right[:-1] & right[1:] & same[:-1]
    tail = np.zeros(n, bool)
    tail[1:] = head[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    has_before = np.zeros(n, bool)
    has_before[1:] = same[:-1]
    new = np.where(head, mix(name, name[after]), name)
    a = np.where(head, np.minimum(first, first[after]), np.where(right, np.where(has_before, np.minimum(first, first[before]), -_FAR), first))
    b = np.where(head, np.maximum(last, last[after]), np.where(right, last, np.where(same, np.maximum(last, last[after]), _FAR)))
    keep = ~tail
    return new[keep], a[keep], b[keep], doc[keep]


def _least(size: int, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Smallest key of those whose range ``a..b`` holds each place (ranges of up to 64)."""
    ok = a <= b
    a, b, key = a[ok], b[ok], key[ok]
    k = np.floor(np.log2(b - a + 1)).astype(np.int64)
    table = np.full((7, size), _NONE)
    for j in range(7):
        at = k == j
        if at.any():
            np.minimum.at(table[j], a[at], key[at])
            np.minimum.at(table[j], b[at] - (1 << j) + 1, key[at])
    for j in range(6, 0, -1):
        half = 1 << (j - 1)
        np.minimum(table[j - 1], table[j], out=table[j - 1])
        np.minimum(table[j - 1][half:], table[j][:-half], out=table[j - 1][half:])
    return table[0]


def witnesses(words: np.ndarray, lens: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window starts, and each window's witness.

    The witness is the symbol of the highest round whose context lies inside the window, of several
    the one with the smallest name; every word is a symbol of round 0, so every window has one, and
    equal windows have equal witnesses. ``words``: hashes of the documents' words, one after another.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(lens)), lens)
    starts = np.cumsum(lens) - lens
    low, high = starts, starts + lens - window
    levels = [(words, np.arange(n), np.arange(n) + 1, doc)]
    for r in range(1, rounds + 1):
        levels.append(_pairs(*_runs(*levels[-1]), r))
    place = np.arange(n)
    is_window = place <= high[doc]
    found = np.full(n, _NONE)
    for r in range(rounds, -1, -1):
        name, first, last, of = levels[r]
        key = (name >> np.uint64(3)) | (np.uint64(rounds - r) << np.uint64(61))
        a, b = np.maximum(last - window, low[of]), np.minimum(first, high[of])
        # Lower rounds only serve the windows that no higher symbol lies in.
        open_ = np.concatenate([[0], np.cumsum(is_window & (found == _NONE))])
        if not open_[-1]:
            break
        near = np.flatnonzero((a <= b) & (open_[np.clip(b + 1, 0, n)] > open_[np.clip(a, 0, n)]))
        found = np.where(found == _NONE, _least(n, a[near], b[near], key[near]), found)
    at = np.flatnonzero(is_window)
    return at, found[at]


_BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of the window that starts at each place."""
    n = len(words)
    power = np.ones(n, np.uint64)
    power[1:] = np.uint64(_BASE)
    back = np.ones(n, np.uint64)
    back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power), dtype=np.uint64)])
    return (sums[at + window] - sums[at]) * np.cumprod(back)[at]
