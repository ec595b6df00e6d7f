"""Optimal assignment on one frame's small cost matrix (NumPy helper used inside tracking tasks)."""

from __future__ import annotations

import numpy as np


WIDE = 128  # columns from which whole-row steps in NumPy are quicker than plain loops


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of minimal total cost, one per row of the shorter side (shortest augmenting paths)."""
    cost = np.asarray(cost, dtype=float)
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assign(cost.T)]
    return _assign_small(cost.tolist(), cost.shape[1]) if cost.shape[1] < WIDE else _assign_wide(cost)


def _assign_small(cost: list[list[float]], m: int) -> list[tuple[int, int]]:
    """Step for step what ``_assign_wide`` does."""
    favourite = [row.index(min(row)) for row in cost]
    row_price, col_price, owner, waiting = [0.0, *[row[f] for row, f in zip(cost, favourite)]], [0.0] * (m + 1), [0] * (m + 1), []
    for row, f in enumerate(favourite, 1):
        if owner[f + 1]:
            waiting.append(row)
        else:
            owner[f + 1] = row
    for row in waiting:
        owner[0] = row
        col, slack, came, seen, free = 0, [np.inf] * (m + 1), [0] * (m + 1), [], list(range(1, m + 1))
        while True:
            seen.append(col)
            r = owner[col]
            line, price, step, nxt = cost[r - 1], row_price[r], np.inf, 0
            for j in free:
                gap = line[j - 1] - price - col_price[j]
                if gap < slack[j]:
                    slack[j], came[j] = gap, col
                if slack[j] < step:
                    step, nxt = slack[j], j
            for j in seen:
                row_price[owner[j]] += step
                col_price[j] -= step
            free.remove(nxt)
            for j in free:
                slack[j] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    return [(owner[c] - 1, c - 1) for c in range(1, m + 1) if owner[c]]


def _assign_wide(cost: np.ndarray) -> list[tuple[int, int]]:
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    # start from row minima: rows that like different columns are settled at once
    favourite = cost.argmin(axis=1)
    row_price[1:] = cost[np.arange(n), favourite]
    waiting = []
    for row in range(1, n + 1):
        if owner[favourite[row - 1] + 1] == 0:
            owner[favourite[row - 1] + 1] = row
        else:
            waiting.append(row)
    for row in waiting:
        owner[0] = row
        col, slack, seen, came = 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            seen[col] = True
            r = owner[col]
            gap = cost[r - 1] - row_price[r] - col_price[1:]
            better = ~seen[1:] & (gap < slack[1:])
            slack[1:][better] = gap[better]
            came[1:][better] = col
            nxt = 1 + int(np.argmin(np.where(seen[1:], np.inf, slack[1:])))
            step = slack[nxt]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            slack[~seen] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    return [(int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c]]


def matched_pairs(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """``assign`` on each group of rows and columns linked by allowed pairs; the rest cannot match anyway."""
    groups: list[tuple[int, list[int]]] = []  # columns as the bits of a number, rows
    rows = np.flatnonzero(allowed.any(axis=1))
    lines = dict(zip(rows.tolist(), cost[rows].tolist()))
    for row, packed in zip(lines, np.packbits(allowed[rows], axis=1, bitorder="little")):
        cols, mine, apart = int.from_bytes(packed.tobytes(), "little"), [], []
        for g in groups:
            if g[0] & cols:
                cols |= g[0]
                mine += g[1]
            else:
                apart.append(g)
        groups = [*apart, (cols, [*mine, row])]
    pairs: list[tuple[int, int]] = []
    for bits, r in groups:
        c = []
        while bits:
            c.append((bits & -bits).bit_length() - 1)
            bits &= bits - 1
        r.sort()
        if len(r) == len(c) == 1:
            pairs.append((r[0], c[0]))
        elif max(len(r), len(c)) >= WIDE:
            pairs += [(r[i], c[j]) for i, j in assign(cost[np.ix_(r, c)])]
        elif len(r) > len(c):
            pairs += [(r[i], c[j]) for j, i in _assign_small([[lines[i][j] for i in r] for j in c], len(r))]
        else:
            pairs += [(r[i], c[j]) for i, j in _assign_small([[lines[i][j] for j in c] for i in r], len(c))]
    return pairs
