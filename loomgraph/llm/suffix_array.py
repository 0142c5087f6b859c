"""Linear suffix sorting by grouping.

Suffixes start in groups of their first symbol, and groups are processed from the highest to the
lowest. For each suffix of a group the nearest earlier position in a lower group (its previous
smaller one) is looked up; the positions found move to new groups right behind their own, those
found more often further behind. After that, each group holds the suffixes of one Lyndon prefix, and a
second pass over the array writes the suffixes in order by following the same pointers. Nothing is
renamed or sorted recursively.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | bytes | np.ndarray) -> np.ndarray:
    """The start positions of all suffixes in ascending order; a suffix is above its own prefixes."""
    text = np.asarray(np.frombuffer(symbols, dtype=np.uint8) if isinstance(symbols, bytes | bytearray) else symbols, dtype=np.int64)
    n = len(text) + 1  # an end below all symbols
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    first = np.append(text - text.min() + 1, 0)
    order = np.argsort(first, kind="stable")
    low = np.flatnonzero(np.diff(first[order], prepend=-1))
    group_of = np.empty(n, dtype=np.int64)  # a group's name is where it starts in the array
    group_of[order] = np.repeat(low, np.diff(np.append(low, n)))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    sizes = np.zeros(n, dtype=np.int64)
    sizes[low] = np.diff(np.append(low, n))
    sa, group, at, size = order.tolist(), group_of.tolist(), place.tolist(), sizes.tolist()
    before = _grouped(sa, group, at, size)
    return np.array(_emitted(group, before, n)[1:], dtype=np.int64)


def _grouped(sa: list[int], group: list[int], at: list[int], size: list[int]) -> list[int]:
    """Refines the groups in place and returns each suffix's previous smaller position."""
    before = [-1] * len(sa)
    end = len(sa)
    while end > 0:
        start = group[sa[end - 1]]
        if end - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[s] = p
            if p >= 0:  # one suffix with one parent: it becomes the last of its group
                old = group[p]
                left = size[old] - 1
                if left:
                    size[old] = left
                    last = old + left
                    q, k = sa[last], at[p]
                    sa[k], at[q] = q, k
                    sa[last], at[p] = p, last
                    group[p], size[last] = last, 1
            end = start
            continue
        found: dict[int, int] = {}
        for s in sorted(sa[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if found:
            most = max(found.values())
            if most == 1:
                _moved(found, sa, group, at, size)
            else:
                by: dict[int, list[int]] = {}
                for p, k in found.items():
                    by.setdefault(k, []).append(p)
                for k in sorted(by, reverse=True):
                    _moved(by[k], sa, group, at, size)
        end = start
    return before


def _moved(parents, sa: list[int], group: list[int], at: list[int], size: list[int]) -> None:
    """Takes the parents out of their groups into new ones right behind."""
    olds = []
    for p in parents:
        old = group[p]
        left = size[old] - 1
        size[old] = left
        last = old + left
        q, k = sa[last], at[p]
        sa[k], at[q] = q, k
        sa[last], at[p] = p, last
        olds.append(old)
    new: Counter = Counter()
    for p, old in zip(parents, olds):
        start = old + size[old]
        if size[old]:
            group[p] = start
            new[start] += 1
        else:  # the whole group moved: it stays what it is
            new[old] += 1
    for start, n in new.items():
        size[start] = n


def _emitted(group: list[int], before: list[int], n: int) -> list[int]:
    """The suffixes in order: each one written places the suffix before it, and the pointers of that."""
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    free = list(range(n))
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return out
