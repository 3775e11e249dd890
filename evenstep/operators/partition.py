"""Balanced number partitioning into groups of equal cardinality.

partition() cuts sorted keys into k groups of n/k items with nearly equal sums, by repeatedly
combining the two most uneven blocks of k partial groups (balanced largest differencing). The
Meld heuristic first evens out the second block with the third if both are small against the
first. This is the only part that runs as Python, on numpy arrays, for one group of rows at a time.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import count

import numpy as np

HEURISTICS = ("bldm", "meld")


class Block:
    """k partial groups: their sums in ascending order, and a row of item numbers for each."""

    __slots__ = ("members", "spread", "sums")

    def __init__(self, sums: np.ndarray, members: np.ndarray):
        order = np.argsort(sums, kind="stable")
        self.sums, self.members = sums[order], members[order]
        self.spread = int(self.sums[-1] - self.sums[0])

    def fold(self, other: Block) -> Block:
        """The smallest groups of one with the largest of the other."""
        return Block(self.sums + other.sums[::-1], np.concatenate([self.members, other.members[::-1]], 1))

    def meld(self, other: Block, threshold: int) -> Block:
        """Pairs of groups that stay apart by `threshold`, so that a later fold can use the difference.

        The largest group of other joins a group of self, and the smallest of self one of other,
        chosen as the first of equal rank (from self's smallest, from other's largest) that
        make the sums differ by the threshold; if none does, the last. The difference grows
        along the ranks, so that rank is found by bisection.
        """
        low, high = list(range(len(self.sums))), list(range(len(other.sums)))[::-1]
        own, others = self.sums.tolist(), other.sums.tolist()
        pairs = []
        while low:
            least, most = low.pop(0), high.pop(0)
            if not low:
                pairs.append((least, most))
                break
            want = threshold - others[most] + own[least]
            rank = min(bisect_left(range(len(low)), want, key=lambda i: own[low[i]] - others[high[i]]), len(low) - 1)
            left, right = low.pop(rank), high.pop(rank)
            pairs += [(left, most), (least, right)]
        a, b = np.array(pairs, np.int64).T
        return Block(self.sums[a] + other.sums[b], np.concatenate([self.members[a], other.members[b]], 1))


def partition(keys: np.ndarray, k: int, heuristic: str = "meld") -> np.ndarray:
    """Rows of item numbers: k groups of len(keys) / k items, in ascending order of their sums.

    keys must be sorted, ascending or descending. No keys: k empty groups (k may be 0). Ties of
    sums keep their order, ties of spreads go by age, so the result is always the same.
    """
    if heuristic not in HEURISTICS:
        raise ValueError(f"heuristic must be one of {HEURISTICS}")
    n = len(keys)
    if not n:
        return np.zeros((k, 0), np.int64)
    if k <= 0 or n % k:
        raise ValueError("the number of items must be a multiple of the number of groups")
    keys = np.asarray(keys, np.int64)
    return combined([Block(keys[i : i + k], np.arange(i, i + k)[:, None]) for i in range(0, n, k)], heuristic).members


def combined(blocks: list[Block], heuristic: str = "meld") -> Block:
    """One block of all, the two most uneven ones folded again and again."""
    age = count()
    heap = [(-b.spread, next(age), b) for b in blocks]
    heapq.heapify(heap)
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if heuristic == "meld" and heap and second.spread + heap[0][2].spread < first.spread:
            second = second.meld(heapq.heappop(heap)[2], first.spread)
        made = first.fold(second)
        heapq.heappush(heap, (-made.spread, next(age), made))
    return heap[0][2]


def spread(sums) -> float:
    """(largest - smallest) / smallest of sums; 0 without sums."""
    sums = np.asarray(sums)
    return float((sums.max() - sums.min()) / sums.min()) if len(sums) and sums.min() else 0.0
