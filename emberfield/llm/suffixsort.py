"""Suffix sorting of one block of bytes by linear grouping construction.

The longest Lyndon prefix of a suffix reaches up to its next smaller suffix, and suffixes
are ordered by these prefixes first. Phase one finds the groups of suffixes with equal
Lyndon prefix: starting from one group for each byte, groups are taken from the highest
down; each suffix of the group finds the nearest position before it in a lower group
(its previous-smaller pointer), and that position's prefix grows by the group's, which
moves it into a new group right above the one it was in. Phase two walks the sorted order
from the empty suffix up; each suffix fills the next place in the groups of those whose
Lyndon prefix ends where it begins, found along the pointers. No suffix is renamed and
nothing recurses; both phases do a bounded number of steps for each position.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def lyndon_groups(text: bytes) -> tuple[list[int], list[int]]:
    """For each position the first rank of its group, and its previous-smaller pointer (-1 if none)."""
    n = len(text)
    order = np.argsort(np.frombuffer(text, np.uint8), kind="stable")
    at = order.tolist()  # positions, group after group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    begin = np.cumsum(counts) - counts
    group = begin[np.frombuffer(text, np.uint8)].tolist()
    size = [0] * (n + 1)
    for g, c in zip(begin.tolist(), counts.tolist(), strict=True):
        if c:
            size[g] = c
    before = [-1] * n
    end = n
    while end:
        s = at[end - 1]
        start = group[s]
        if end - start == 1:  # most groups
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            end = start
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    last = g + left
                    size[g] = left
                    i, q = place[p], at[last]
                    at[last], at[i] = p, q
                    place[p], place[q] = last, i
                    group[p], size[last] = last, 1
            continue
        members = sorted(at[start:end])
        grown = []
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                grown.append(p)
        end = start
        if not grown:
            continue
        times = None
        if len(grown) > 1:
            times = Counter(grown)
            if len(times) == len(grown):
                times = None
        # Positions that grow by more repeats of the prefix end up higher: they move first.
        rounds = (grown,) if times is None else ([p for p in times if times[p] == k] for k in sorted(set(times.values()), reverse=True))
        for moved in rounds:
            for p in moved:
                g = group[p]
                last = g + size[g] - 1
                size[g] -= 1
                i, q = place[p], at[last]
                at[last], at[i] = p, q
                place[p], place[q] = last, i
            for p in moved:
                g = group[p]
                own = g + size[g]
                group[p] = own
                if own != g:
                    size[own] += 1
            for p in moved:
                g = group[p]
                if not size[g]:
                    size[g] = _run(at, group, g, n)
    return group, before


def _run(at: list[int], group: list[int], g: int, n: int) -> int:
    """Members of the group that starts at rank g: it took the place of the one it came from."""
    i = g
    while i < n and group[at[i]] == g:
        i += 1
    return i - g


def suffix_array(text: bytes) -> list[int]:
    """Positions in the order of their suffixes."""
    n = len(text)
    group, before = lyndon_groups(text)
    free = list(range(n))  # next place of the group that starts at this rank
    out = [0] * n
    waiting = [True] * n
    s, rank = n, -1
    while True:
        p = s - 1
        while p >= 0 and waiting[p]:
            waiting[p] = False
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = before[p]
        rank += 1
        if rank == n:
            return out
        s = out[rank]
