"""Suffix arrays by linear grouping.

First phase: suffixes stand in groups by their known prefix, at first one character. Groups are taken in
descending order; every member points to the nearest suffix before it in a lower group (its previous smaller one),
and a suffix that k members point to has its prefix longer by k copies of the group's, so it moves behind
those of its group with fewer. At the end groups hold the suffixes of equal Lyndon prefix. Second phase: in ascending
order, each placed suffix places its left neighbour and that one's chain of previous smaller suffixes at the next
free places of their groups. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(s: list[int] | bytes) -> list[int]:
    """Starts of the suffixes of s in ascending order; a suffix that begins another comes before it."""
    n = len(s)
    by_first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        if c in by_first:
            by_first[c].append(i)
        else:
            by_first[c] = [i]
    group, members, size, start_of = [0] * n, {}, {}, {}
    at = 0
    for c in sorted(by_first):
        some = by_first[c]
        for i in some:
            group[i] = at
        members[at] = some
        size[at] = len(some)
        start_of[at + len(some)] = at
        at += len(some)
    prev = [-1] * n
    end = n
    while end:
        low = start_of[end]
        pointed: dict[int, int] = {}
        for i in members[low]:
            if group[i] != low:  # moved on since
                continue
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                if p in pointed:
                    pointed[p] += 1
                else:
                    pointed[p] = 1
        if len(pointed) == 1:
            for p in pointed:
                if size[group[p]] > 1:
                    _split(members, size, start_of, group, group[p], [[p]])
        elif pointed:
            moved: dict[int, dict[int, list[int]]] = {}
            for p, k in pointed.items():
                g = group[p]
                if g in moved:
                    if k in moved[g]:
                        moved[g][k].append(p)
                    else:
                        moved[g][k] = [p]
                else:
                    moved[g] = {k: [p]}
            for g, by in moved.items():
                if len(by) == 1:
                    (some,) = by.values()
                    if len(some) == size[g]:
                        continue
                    parts = [some]
                else:
                    parts = [by[k] for k in sorted(by)]
                _split(members, size, start_of, group, g, parts)
        end = low
    free = list(range(n))  # next free place of a group, by its start
    out = [-1] * n
    placed = [False] * n
    i = n - 1
    while i >= 0:
        g = group[i]
        out[free[g]] = i
        free[g] += 1
        placed[i] = True
        i = prev[i]
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = prev[i]
    return out


def _split(members: dict, size: dict, start_of: dict, group: list[int], g: int, parts: list[list[int]]) -> None:
    """Groups of their own, after what stays in g, in the order of parts; members keep text order.

    The list of g keeps those that leave; they are told by their new group.
    """
    at = g + size[g]
    for part in parts:
        at -= len(part)
    size[g] = at - g
    if size[g]:
        start_of[at] = g
    for part in parts:
        part.sort()
        for p in part:
            group[p] = at
        members[at] = part
        size[at] = len(part)
        start_of[at + len(part)] = at
        at += len(part)
