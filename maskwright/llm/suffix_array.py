"""Suffix sorting by grouping, in linear time and without renaming.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix: groups are taken from the highest down; each suffix of
a group points to the previous suffix of a lower group, and the suffixes pointed to move to new groups right
above their old ones, the more pointers the higher. Phase 2 reads the order off: from the smallest suffix on, the
suffixes that end in front of it take the next places of their groups, along the previous-smaller pointers.
"""

from __future__ import annotations

from itertools import accumulate


def lyndon_groups(text: list[int], width: int) -> tuple[list[int], list[int]]:
    """text of symbols below width -> start of each suffix's group, and its previous-smaller pointer (-1: none)."""
    n = len(text)
    size_of = [0] * (width + 1)
    for s in text:
        size_of[s + 1] += 1
    first = list(accumulate(size_of))
    group = [first[s] for s in text]
    size = [0] * (n + 1)
    place, order = [0] * n, [0] * n
    for i, g in enumerate(group):
        at = g + size[g]
        order[at], place[i] = i, at
        size[g] += 1
    before = [-1] * n
    top = n - 1
    while top >= 0:
        low = group[order[top]]
        if low == top:
            i = order[top]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0 and size[group[j]] > 1:
                g = group[j]
                size[g] -= 1
                end = g + size[g]
                other, at = order[end], place[j]
                order[at], place[other] = other, at
                order[end], place[j] = j, end
                group[j], size[end] = end, 1
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[low : top + 1]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, []).append(j)
            for times in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for j in by_count[times]:
                    g = group[j]
                    size[g] -= 1
                    end = g + size[g]
                    other, at = order[end], place[j]
                    order[at], place[other] = other, at
                    order[end], place[j] = j, end
                    moved[g] = moved.get(g, 0) + 1
                start = {g: g + size[g] for g in moved}
                for j in by_count[times]:
                    group[j] = start[group[j]]
                for g, count in moved.items():
                    size[start[g]] = count
        top = low - 1
    return group, before


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of text in order; text is of small non-negative integers."""
    text = [s + 1 for s in text] + [0]
    n = len(text)
    group, before = lyndon_groups(text, max(text) + 1)
    out, placed, front = [-1] * n, [False] * n, list(range(n))
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return out[1:]
