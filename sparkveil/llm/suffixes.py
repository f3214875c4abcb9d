"""Suffix arrays by linear grouping.

Suffixes are grouped by the longest Lyndon word they start with. First, groups
are processed in descending order: every member points to the nearest earlier
suffix in a lower group (its previous smaller one), and each suffix so pointed
to moves to a new group right above its own, apart by how many members point to
it, for its Lyndon prefix grows by as many copies of theirs. Then each group's
order is emitted in one ascending pass: the suffix before a placed one, and its
chain of previous smaller ones, take the next free place of their groups. No
names are made and nothing recurses.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (integers) in ascending order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    if not n:
        return []
    first: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(symbols):
        first[c].append(i)
    values = sorted(first)
    # group k: its members (some may have moved on), and the group below it; 0 stands for the end
    members: list[list[int]] = [[]] + [first[c] for c in values]
    below = list(range(-1, len(values)))
    rank = {c: k for k, c in enumerate(values, 1)}
    group = [rank[c] for c in symbols]
    above = {k - 1: k for k in range(1, len(values) + 1)}
    done = bytearray(n)  # its group is processed
    previous = [-1] * n
    current = len(values)
    order: list[int] = []
    while current > 0:
        own = [i for i in members[current] if group[i] == current and not done[i]]
        own.sort()
        members[current] = own
        pointed: dict[int, int] = {}
        for i in own:
            done[i] = 1
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        order.append(current)
        if pointed:
            by: dict[tuple[int, int], list[int]] = {}
            for p, k in pointed.items():
                at = (k, group[p])
                if at in by:
                    by[at].append(p)
                else:
                    by[at] = [p]
            for k, g in sorted(by, reverse=True) if len(by) > 1 else by:
                new = len(members)
                moved = by[k, g]
                members.append(moved)
                for p in moved:
                    group[p] = new
                up = above.get(g)
                below.append(g)
                above[g] = new
                if up is not None:
                    below[up] = new
                    above[new] = up
        current = below[current]
    place = [0] * len(members)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = bytearray(n)

    def chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            j = previous[j]

    chain(n - 1)
    i = 0
    while i < n:
        j = out[i] - 1
        i += 1
        if j >= 0 and not placed[j]:
            chain(j)
    return out


def common_prefixes(symbols: Sequence[int], order: Sequence[int]) -> np.ndarray:
    """For each place in ``order`` the length of the prefix shared with the suffix before it (0 at the first)."""
    n = len(order)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(out, np.int64)
