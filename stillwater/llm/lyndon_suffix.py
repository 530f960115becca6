"""Suffix arrays by grouping suffixes by their Lyndon prefixes (linear time, no recursion).

Suffixes start in groups by first symbol.  Groups are processed from the highest
to the lowest: every suffix of the group points to the nearest suffix before it
that lies in a lower group (its previous-smaller pointer), and the pointed-to
suffixes move to new groups right above their own, those that are pointed to
more often higher.  Afterwards a group holds the suffixes with one Lyndon
prefix, and one pass over the array, following the same pointers, emits the
order inside every group: nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(s: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, first place of each group, previous-smaller pointers, -1 where none)."""
    n = len(s)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        members.setdefault(c, []).append(i)
    order = sorted(members)
    lists = [members[c] for c in order]
    lower = list(range(-1, len(order) - 1))  # the next lower group
    upper = [*range(1, len(order)), -1]
    group = [0] * n
    for g, m in enumerate(lists):
        for i in m:
            group[i] = g
    done, prev = bytearray(n), [-1] * n
    g = len(order) - 1
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        own.sort()
        for i in own:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        by_hits: dict[int, dict[int, list[int]]] = {}
        for j, k in hits.items():
            by_hits.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by_hits, reverse=True):
            for old, moved in by_hits[k].items():
                new = len(lists)
                lists.append(moved)
                up = upper[old]
                lower.append(old)
                upper.append(up)
                upper[old] = new
                if up >= 0:
                    lower[up] = new
                for j in moved:
                    group[j] = new
        lists[g] = own
        g = lower[g]
    bottom = 0 if n else -1
    while bottom >= 0 and lower[bottom] >= 0:
        bottom = lower[bottom]
    first, at = [0] * len(lists), 0
    while bottom >= 0:
        first[bottom] = at
        at += sum(1 for i in lists[bottom] if group[i] == bottom)
        bottom = upper[bottom]
    return group, first, prev


def suffix_array(s: Sequence[int]) -> list[int]:
    """The suffix array of s, whose last symbol must be smaller than all others (a sentinel)."""
    n = len(s)
    if n == 0:
        return []
    group, free, prev = lyndon_groups(s)
    out, placed = [-1] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return out
