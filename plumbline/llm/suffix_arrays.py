"""Suffix arrays in numpy: refinement by doubling (Larsson and Sadakane) and common prefixes (Kasai)."""

from __future__ import annotations

import numpy as np

#: Stretches of a text whose common prefixes are computed side by side.
LANES = 2048
#: Numbers of eight bytes that are compared at once where two suffixes agree in the first eight.
AHEAD = 16


def suffix_array(keys: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a sequence in order, and the rank of each.

    ``keys`` holds for each place an integer that orders the next ``width`` symbols. Suffixes that share a first key form
    a group; each round orders the members of every group that is left by the rank of the suffix that begins where the
    compared part ends, so the compared part doubles. Groups of one take no part any more. The order is total: common
    prefixes carry from one place to the next only then.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    if not n:
        return order, rank
    ordered = keys[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    left = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    while left.size:
        at = order[left]
        then = at + width
        inside = then < n
        second = np.where(inside, rank[np.where(inside, then, 0)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        new = np.argsort(pair, kind="stable")
        at, pair = at[new], pair[new]
        order[left] = at
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = left[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))]
        left = left[~(head & np.concatenate((head[1:], [True])))]
        width *= 2
    return order, rank


def _leading(differ: np.ndarray) -> np.ndarray:
    """Equal bytes at the head of numbers of eight bytes, none of which agree in all."""
    return 8 - sum((differ >= np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8)) - 1


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int | None = None, eights: np.ndarray | None = None) -> np.ndarray:
    """For each rank, the length that this suffix has in common with the one before it in order (0 for the first).

    The text is cut in stretches, in each of which the length known for one place, less one, is where the next
    begins to compare. All stretches advance together. ``depth`` ends the comparison. For bytes, ``eights`` (the next eight
    bytes of each place as one unsigned number, zeros beyond the end) lets eight be compared at once.
    """
    n = len(symbols)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    most = n if depth is None else depth
    if eights is not None:
        eights, ahead = np.concatenate((eights, np.zeros(8 * AHEAD, np.uint64))), 8 * np.arange(AHEAD)
    size = max(64, -(-n // LANES))
    starts = np.arange(0, n, size)
    same = np.zeros(len(starts), np.int64)
    by_place = np.zeros(n, np.int64)
    for step in range(size):
        i = starts + step
        if i[-1] >= n:
            i = i[:-1]
            starts, same = starts[: len(i)], same[: len(i)]
            if not len(i):
                break
        j = before[i]
        same = np.where(j < 0, 0, np.maximum(same - 1, 0))
        going, first = np.flatnonzero((j >= 0) & (same < most)), True
        while going.size:
            a, b = i[going] + same[going], j[going] + same[going]
            inside = (a < n) & (b < n)
            going, a, b = going[inside], a[inside], b[inside]
            if eights is None:
                going = going[symbols[a] == symbols[b]]
                same[going] += 1
            elif first:
                differ = eights[a] ^ eights[b]
                last = differ != 0
                same[going[last]] += _leading(differ[last])
                going = going[~last]
                same[going] += 8
                first = False
            else:  # few are left: many bytes at once
                differ = eights[a[:, None] + ahead] ^ eights[b[:, None] + ahead]
                last = differ.any(axis=1)
                at = (differ[last] != 0).argmax(axis=1)
                same[going[last]] += 8 * at + _leading(differ[last][np.arange(len(at)), at])
                going = going[~last]
                same[going] += 8 * AHEAD
            going = going[same[going] < most]
        if eights is not None:
            same = np.minimum(same, np.minimum(most, n - np.maximum(i, j)))
        by_place[i] = same
    found[:] = by_place[order]
    return found


def longest_repeats(symbols: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring beginning there that begins elsewhere too."""
    out = np.empty(len(symbols), np.int64)
    out[order] = np.maximum(shared, np.concatenate((shared[1:], [0]))) if len(symbols) else 0
    return out
