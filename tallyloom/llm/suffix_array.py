"""Suffix arrays by linear grouping (the idea of Baier, Linear-time Suffix Sorting, 2016).

A suffix's Lyndon prefix is its longest prefix that is smaller than all its own proper suffixes; the rest of the text after it is
the next smaller suffix. First, suffixes are put into groups of equal Lyndon prefix, in the prefixes' order: groups start
as those of the first symbol and are closed from the largest down. When a group closes, its prefix is known; each member
extends the position before it that is in a smaller group, found by pointers to the previous smaller one. A position that was extended k times
moves up in its group, above those extended less often. Then the groups are emitted from the smallest up: a suffix is its
Lyndon prefix and a smaller suffix, so members of a group follow in the order of those smaller suffixes. Nothing is
renamed or sorted recursively; each step costs time linear in the text.
"""

from __future__ import annotations

from array import array


def suffix_array(text) -> array:
    """Start positions of the suffixes of a sequence of under 2^31 non-negative numbers (bytes) in ascending order.

    Some 30 bytes of memory for each symbol.
    """
    n = len(text) + 1  # with an end smaller than every symbol
    if n == 1:
        return array("i")
    # groups of the first symbol: `order` holds the positions, a group is named by where it starts
    starts, at = {}, 1
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    for c in sorted(counts):
        starts[c] = at
        at += counts[c]
    free = dict(starts)
    zeros = array("i", bytes(4 * n))
    order, place, group, size = zeros[:], zeros[:], zeros[:], zeros[:]
    order[0], size[0] = n - 1, 1
    for c, s in starts.items():
        size[s] = counts[c]
    for i, c in enumerate(text):
        k = free[c]
        free[c] = k + 1
        order[k], place[i], group[i] = i, k, starts[c]
    length, before = array("i", [1]) * n, array("i", [-2]) * n

    high = n - 1
    while high > 0:
        low = group[order[high]]
        if low == high:  # one member, as most groups have: the same steps without lists
            s = order[high]
            p = s - 1
            while p >= 0 and group[p] >= low:  # all closed, so their pointers are known
                p = before[p]
            before[s] = p
            if p >= 0:
                length[p] += length[s]
                g = group[p]
                z = size[g] - 1
                size[g] = z
                last, mine = g + z, place[p]
                if last != mine:
                    other = order[last]
                    order[mine], place[other] = other, mine
                    order[last], place[p] = p, last
                group[p] = last
                size[last] = 1
            high = low - 1
            continue
        members = order[low : high + 1]
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            if p >= 0 and group[p] >= low:
                # over closed groups by their pointers; over members of this one, whose pointers are found on the way
                chain = []
                while p >= 0:
                    g = group[p]
                    if g < low:
                        break
                    if before[p] == -2:
                        chain.append(p)
                        p -= 1
                    else:
                        p = before[p]
                for q in chain:
                    before[q] = p
            before[s] = p
        for s in members:
            p = before[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            unit = length[members[0]]
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
                length[p] += k * unit
            for k in sorted(by_times, reverse=True) if len(by_times) > 1 else by_times:
                moved = by_times[k]
                touched = {}
                for p in moved:
                    g = group[p]
                    z = size[g] - 1
                    size[g] = z
                    touched[g] = touched.get(g, 0) + 1
                    last, mine = g + z, place[p]
                    if last != mine:
                        other = order[last]
                        order[mine], place[other] = other, mine
                        order[last], place[p] = p, last
                for p in moved:
                    g = group[p]
                    group[p] = g + size[g]
                for g, c in touched.items():
                    size[g + size[g]] = c
        high = low - 1

    out = zeros
    out[0] = n - 1
    following = array("i", range(n))
    for i in range(n):
        s = out[i]
        j = s - 1
        while j >= 0 and j + length[j] == s:
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            j = before[j]
    return out[1:]
