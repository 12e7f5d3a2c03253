"""Suffix arrays by linear grouping: suffixes are grouped by their longest Lyndon prefix, then each group is put in order.

First phase. Suffixes start grouped by first symbol. Groups are taken in descending order; each member finds its previous
smaller suffix, the nearest to the left in a group not taken yet, along the pointers found so far. Suffixes pointed to have a
longer Lyndon prefix than the rest of their group, the longer the more members point to them: they move to new groups
right behind their own, most pointers last. Second phase. From the end marker on, in ascending order, each finished suffix
releases the one before it and that one's previous smaller suffixes, which take the next places of their groups. Every
suffix is handled a constant number of times in either phase; nothing is renamed and solved again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of integers; the end of the text is smaller than any symbol."""
    n = len(text)
    symbols, first = np.unique(text, return_inverse=True)
    group_of: list[int] = first.tolist()
    by = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[by], np.arange(len(symbols) + 1))
    members: list[list[int]] = [by[a:z].tolist() for a, z in zip(cuts[:-1], cuts[1:])]
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    taken = [False] * len(members)
    smaller = [-1] * n

    group = len(symbols) - 1
    while group >= 0:
        taken[group] = True
        own = members[group]
        if size[group] < len(own):
            own = [i for i in own if group_of[i] == group]
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[group_of[j]]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            most = max(pointed.values())
            levels: list[dict[int, list[int]]] = [{} for _ in range(most)]
            for j, k in pointed.items():
                levels[k - 1].setdefault(group_of[j], []).append(j)
            for level in reversed(levels):
                for old, moved in level.items():
                    if len(moved) == size[old]:
                        continue  # the group moves as a whole and stays where it is
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    taken.append(False)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for j in moved:
                        group_of[j] = new
        group = below[group]

    place = [0] * len(members)
    group = int(group_of[int(np.argmin(text))]) if n else -1
    while group >= 0 and below[group] >= 0:
        group = below[group]
    at = 0
    while group >= 0:
        place[group] = at
        at += size[group]
        group = above[group]
    out, free = [0] * n, [True] * n
    j = n - 1
    k = -1
    while True:
        while j >= 0 and free[j]:
            g = group_of[j]
            out[place[g]] = j
            place[g] += 1
            free[j] = False
            j = smaller[j]
        k += 1
        if k == n:
            break
        j = out[k] - 1
    return np.array(out, np.int64)
