"""Outline measures of one small region (NumPy helper used inside grouped tasks)."""

from __future__ import annotations

import numpy as np

# eight neighbours (row, column), clockwise from the left
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def outline(rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Outer boundary pixels of a connected region in order (each step to one of eight neighbours)."""
    filled = set(zip(rows.tolist(), cols.tolist()))
    first = min(filled)
    path, here, look = [first], first, 0
    while True:
        for k in range(8):
            d = (look + k) % 8
            nxt = (here[0] + AROUND[d][0], here[1] + AROUND[d][1])
            if nxt in filled:
                break
        else:
            return path
        if len(path) > 1 and here == first and nxt == path[1]:
            return path[:-1]
        path.append(nxt)
        here, look = nxt, (d + 5) % 8 if d % 2 else (d + 6) % 8


def polygon_area(points: list[tuple[int, int]]) -> float:
    y, x = np.array(points, dtype=float).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)


def perimeter(points: list[tuple[int, int]]) -> float:
    if len(points) < 2:
        return 0.0
    p = np.array(points, dtype=float)
    return float(np.hypot(*(p - np.roll(p, -1, axis=0)).T).sum())


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])
