"""Deep-shallow sorting of suffixes, for many groups at once.

Shallow: multikey passes, eight bytes as one character, each splitting all groups that are still together.
Deep: what still shares its prefix is put in blind tries, one per group: a node stores only the depth at which
its suffixes first differ (found by comparing each with the group's first) and branches on the byte there.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def _characters(text: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from each place on, as a big-endian number; past the end come zeros."""
    t = np.concatenate((text, np.zeros(depth + 16, dtype=np.uint8))).astype(np.uint64)
    n = len(text) + depth + 8
    c = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        c = (c << np.uint64(8)) | t[j : j + n]
    return c


def _starts(group: np.ndarray) -> np.ndarray:
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new)


def sort_suffixes(text: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` bytes, and numbers, rising along that order, of the groups
    that agree in all of them."""
    n = len(suffixes)
    char = _characters(text, depth)
    order = suffixes.copy()  # by place; the group of a place is the place where the group begins
    group = np.zeros(n, dtype=np.int64)
    open_ = np.arange(n)

    def split(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sorts the open places within their groups by the keys; gives those whose new group has several."""
        own = group[places]
        by = np.lexsort((keys, own))
        order[places] = order[places[by]]
        k = keys[by]
        new = np.ones(len(places), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(places)))
        group[places] = np.repeat(places[at], sizes)
        return places[np.repeat(sizes > 1, sizes)]

    d = 0
    while d < min(SHALLOW, depth - depth % 8) and len(open_):
        open_ = split(open_, char[order[open_] + d])
        d += 8
    # each open group is a blind trie's root; all suffixes below a node agree in `agreed` bytes
    agreed = np.full(len(open_), d, dtype=np.int64)
    while len(open_):
        own = group[open_]
        at = _starts(own)
        sizes = np.diff(np.append(at, len(open_)))
        lead = np.repeat(order[open_[at]], sizes)
        mine = order[open_]
        lcp = agreed.copy()
        todo = np.arange(len(open_))
        while len(todo):
            x = char[mine[todo] + lcp[todo]] ^ char[lead[todo] + lcp[todo]]
            same = x == 0
            # by halves, which floats hold exactly
            high = x[~same] >> np.uint64(32)
            bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((x[~same] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
            lcp[todo[~same]] += (64 - bits) // 8
            lcp[todo[same]] += 8
            todo = todo[same]
            todo = todo[lcp[todo] < depth]
        node = np.repeat(np.minimum(np.minimum.reduceat(lcp, at), depth), sizes)
        going = node < depth
        open_, node = open_[going], node[going]
        if not len(open_):
            break
        branch = (char[order[open_] + node] >> np.uint64(56)).astype(np.int64)
        before = open_
        open_ = split(open_, branch)
        agreed = node[np.searchsorted(before, open_)] + 1
    return order, group
