"""How much of two sequences is the same, in order: longest common blocks, left and right of each again.

The longest block of two ranges is found along a suffix automaton of the one; of equally long ones that which starts first in the first sequence, then
in the second, is taken. Elements are numbers, equal ones having the same.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class _Automaton:
    """All blocks of a range of a sequence; each state knows where its blocks end first."""

    def __init__(self, items: Sequence[int], low: int, high: int):
        self.length, self.link, self.next, self.end = [0], [-1], [{}], [low - 1]
        last = 0
        for at in range(low, high):
            x = items[at]
            now = self._state(self.length[last] + 1, at)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][x]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = self._state(self.length[p] + 1, self.end[q])
                    self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def _state(self, length: int, end: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append({})
        self.end.append(end)
        return len(self.length) - 1

    def longest(self, items: Sequence[int], low: int, high: int) -> tuple[int, int, int]:
        """(start in items, start in the sequence, size) of the longest block of items[low:high]; size 0 if none."""
        state, size, best = 0, 0, (low, 0, 0)
        for at in range(low, high):
            x = items[at]
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state, size = self.next[state][x], size + 1
            if size > best[2]:
                best = (at + 1 - size, self.end[state] + 1 - size, size)
        return best


def common_size(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Elements in blocks that the two sequences have in common, in order."""
    numbers: dict[Hashable, int] = {}
    x, y = ([numbers.setdefault(v, len(numbers)) for v in s] for s in (a, b))
    total, ranges = 0, [(0, len(x), 0, len(y))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        if alo == ahi or blo == bhi:
            continue
        if x[alo:ahi] == y[blo:bhi]:  # then the whole is the longest block
            total += ahi - alo
            continue
        i, j, size = _Automaton(y, blo, bhi).longest(x, alo, ahi)
        if size:
            total += size
            ranges += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def identical_share(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """common_size over the longer sequence; 1 for two empty ones."""
    longest = max(len(a), len(b))
    return common_size(a, b) / longest if longest else 1.0
