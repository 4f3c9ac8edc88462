"""Suffix sorting by linear grouping.

Phase one sorts suffixes into groups that share their longest Lyndon prefix. The
groups start as the suffixes with one first symbol and are processed from the
highest to the lowest: every suffix of the group finds the closest suffix before
it in a lower group (its previous smaller one), and a suffix that is found k
times starts with a prefix that is followed by k copies of the processed group's
prefix. It moves up, behind the rest of its own group, by k. Phase two goes
through the finished order from the smallest suffix on: when a suffix gets its
place, the suffixes whose Lyndon prefix ends just before it take the next free
places of their groups. No names are given out and nothing is recursive.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; a proper prefix comes first."""
    n = len(symbols)
    if not n:
        return []
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if at and symbols[i] != symbols[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1

    # phase one
    before = [-1] * n
    end = n - 1
    while end >= 0:
        first = group[order[end]]
        if first == end:
            # one suffix finds one other, which moves alone
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0 and size[g := group[j]] > 1:
                size[g] -= 1
                to, at = g + size[g], place[j]
                other = order[to]
                order[at], order[to] = other, j
                place[other], place[j] = at, to
                group[j], size[to] = to, 1
            end -= 1
            continue
        times: dict[int, int] = {}
        for i in sorted(order[first : end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        if sum(times.values()) == len(times):
            by_times[1] = list(times)
        else:
            for j, k in times.items():
                by_times.setdefault(k, []).append(j)
        for k in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for j in by_times[k]:
                g = group[j]
                done = moved.get(g, 0)
                # swap to the end of what is left of the group
                to, at = g + size[g] - 1 - done, place[j]
                other = order[to]
                order[at], order[to] = other, j
                place[other], place[j] = at, to
                moved[g] = done + 1
            for g, count in moved.items():
                if count == size[g]:
                    continue
                new = g + size[g] - count
                size[g] -= count
                size[new] = count
                for at in range(new, new + count):
                    group[order[at]] = new
        end = first - 1

    # phase two: suffixes whose Lyndon prefix ends before each position
    free = list(range(n))
    placed = bytearray(n)
    out = [-1] * n
    for at in range(-1, n):
        j = (out[at] if at >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out
