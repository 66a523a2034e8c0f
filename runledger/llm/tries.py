"""Double-array tries over byte strings, walked by numpy for many strings at once.

Child of state s by code c is ``base[s] + c`` where ``check`` of that cell is s.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

ROOT = 0


@dataclass
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    #: States by depth (root first) with their parent and code.
    order: np.ndarray
    parent: np.ndarray
    code: np.ndarray

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        cells = self.base[states] + codes
        cells = np.minimum(cells, len(self.check) - 1)
        return cells, self.check[cells] == states


def double_array(keys: Iterable[tuple[tuple[int, ...] | bytes, int]], n_codes: int = 256) -> DoubleArray:
    """Trie of (codes, value) pairs, values from 0; a repeated key keeps its first value."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys:
        node = 0
        for c in key:
            following = children[node].get(c)
            if following is None:
                following = len(children)
                children[node][c] = following
                children.append({})
                values.append(-1)
            node = following
        if values[node] < 0:
            values[node] = value
    size = 2 * len(children) + 4 * n_codes
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    value = np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    order, parent, code = [0], [-1], [-1]
    cell_of = {0: 0}
    value[0] = values[0]
    free, high, queue, at = n_codes, n_codes, [0], 0  # from n_codes on, no shift is negative
    while at < len(queue):
        node = queue[at]
        at += 1
        mine = cell_of.pop(node)
        codes = sorted(children[node])
        if not codes:
            continue
        while taken[free]:
            free += 1
        start, tries = free, 0
        while True:
            shift = start - codes[0]
            if not any(taken[shift + c] for c in codes):
                break
            start += 1
            tries += 1
            if tries == 64 and len(codes) > 1:  # do not search the crowded part of the array for long
                start = high + 1
            if start + n_codes >= len(taken):
                grow = len(taken)
                taken.extend(bytes(grow))
                base = np.concatenate([base, np.zeros(grow, np.int32)])
                check = np.concatenate([check, np.full(grow, -1, np.int32)])
                value = np.concatenate([value, np.full(grow, -1, np.int32)])
        base[mine] = shift
        high = max(high, shift + codes[-1])
        for c in codes:
            child, cell = children[node][c], shift + c
            taken[cell] = 1
            check[cell], value[cell] = mine, values[child]
            cell_of[child] = cell
            order.append(cell)
            parent.append(mine)
            code.append(c)
            queue.append(child)
    check[0] = -1
    return DoubleArray(base, check, value, np.array(order), np.array(parent), np.array(code))


def flatten(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end as int32 codes, and the bounds of each string."""
    bounds = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=bounds[1:])
    return np.frombuffer(b"".join(strings), np.uint8).astype(np.int32), bounds
