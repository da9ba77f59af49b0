"""Suffix arrays by linear grouping, without recursion or renaming.

First pass: suffixes are grouped by first byte, then groups are handled from the highest down.  Each
suffix of a group points to the nearest suffix to its left that lies in a lower group (its previous
smaller one).  Whoever is pointed to from a group gets that group's string appended to its own prefix,
as often as it is pointed to, and so moves up to a group of its own inside its former one.  In the end a
group holds the suffixes that share their longest Lyndon prefix.

Second pass: suffixes are emitted in order.  When one is emitted, the suffix before it, and in turn
what that one points to, is the next of its group, so each group is filled from its front.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of ``text`` in order; values are small non-negative integers."""
    n = len(text)
    if n < 2:
        return list(range(n))
    values = np.asarray(text, np.int64)
    by_group = np.argsort(values, kind="stable")
    place = np.empty(n, np.int64)
    place[by_group] = np.arange(n)
    ordered = values[by_group]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(fresh)
    ends = np.concatenate([heads[1:], [n]])
    first = np.empty(n, np.int64)  # a suffix's group is named by its first place
    first[by_group] = np.repeat(heads, ends - heads)
    size_at = np.zeros(n, np.int64)
    size_at[heads] = ends - heads
    order, spot, group, size = by_group.tolist(), place.tolist(), first.tolist(), size_at.tolist()
    before = [-2] * n  # previous smaller; -2: not known yet
    end = n
    while end:
        head = group[order[end - 1]]
        members = order[head:end]
        end = head
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = before[j] if before[j] != -2 else j - 1
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # members of this group are out of the way for good; their pointers lead past them
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[c]:
                moved.setdefault(group[j], []).append(j)
            for g, those in moved.items():
                left = size[g] - len(those)
                if not left:
                    continue  # the whole group moves up together
                last = g + size[g]
                for j in those:  # to the back of their group, behind those that stay
                    last -= 1
                    other, at = order[last], spot[j]
                    order[at], order[last] = other, j
                    spot[other], spot[j] = at, last
                    group[j] = -1 - g
                size[g] = left
                for j in those:
                    group[j] = last
                size[last] = len(those)
    return _emit(order, group, before, n)


def _emit(order: list[int], group: list[int], before: list[int], n: int) -> list[int]:
    out = [-1] * n
    fill = list(range(n))  # next free place of the group that starts here
    done = bytearray(n)

    def place(j: int) -> None:
        while j >= 0 and not done[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            done[j] = 1
            j = before[j]

    place(n - 1)
    for k in range(n):
        place(out[k] - 1)
    return out
