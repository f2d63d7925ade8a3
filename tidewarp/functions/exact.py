"""Sums that do not depend on their order: values as multiples of 2^-104, added up as integers.

A value below 2^26 is split into four integers of 26 bits with its sign, all exact in a double; a double of at
least 2^-52 is split without loss, a smaller one to within 2^-105. Sums of some rows are
exact in doubles, sums of tasks are longs, and the whole sum is a Python integer. Any partitioning gives the same bits.
"""

from __future__ import annotations

import numpy as np

LIMBS, BITS = 4, 26
SHIFT = LIMBS * BITS
LIMIT = float(1 << BITS)


def split(x: np.ndarray) -> np.ndarray:
    """(rows, LIMBS x w): the integers of the columns of ``x`` (rows, w) as doubles, the highest of all columns first."""
    rest = np.rint(np.ldexp(x, SHIFT))
    out = []
    for i in range(LIMBS - 1, 0, -1):
        limb = np.trunc(np.ldexp(rest, -BITS * i))
        rest = rest - np.ldexp(limb, BITS * i)
        out.append(limb)
    return np.concatenate([*out, rest], axis=1)


def group_sums(parts: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """(groups, LIMBS x w) integer sums of the rows of ``parts`` (what ``split`` gives) by ``group``."""
    out = np.zeros((groups, parts.shape[1]), np.int64)
    top = max(LIMIT, float(np.abs(parts).max(initial=0.0)))
    step = max(1, int(2.0 ** 53 / top) - 1)  # rows whose sum stays below 2^53
    for at in range(0, len(parts), step):
        own = group[at:at + step]
        order = np.argsort(own, kind="stable")
        names, first = np.unique(own[order], return_index=True)
        out[names] += np.add.reduceat(parts[at:at + step][order], first, axis=0).astype(np.int64)
    return out


def whole(sums) -> list[int]:
    """The w whole sums of a row of ``group_sums``."""
    w = len(sums) // LIMBS
    return [sum(int(sums[b * w + i]) << (BITS * (LIMBS - 1 - b)) for b in range(LIMBS)) for i in range(w)]


def quotient(total: int, count: int) -> float:
    """total / (2^104 count), rounded once."""
    return total / (count << SHIFT)
