"""Order-dependent kernels, one tile at a time, by grouped-map functions over numpy arrays."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def per_tile(cells: DataFrame, f: Callable[[np.ndarray], np.ndarray], name: str, column: str = "z") -> DataFrame:
    """(tile_id, r, c, name): f of each tile as an array; missing cells are NaN."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a = np.full((t.r.max() + 1, t.c.max() + 1), np.nan)
        a[t.r, t.c] = t[column]
        out = np.asarray(f(a), dtype=float)
        return pd.DataFrame({"tile_id": t.tile_id, "r": t.r, "c": t.c, name: out[t.r, t.c]})

    return cells.select("tile_id", "r", "c", column).groupBy("tile_id").applyInPandas(run, f"tile_id long, r int, c int, {name} double")


def pit_fill(z: np.ndarray) -> np.ndarray:
    """Heights raised so that every cell drains to the border: the least highest point of all ways out."""
    h, w = z.shape
    out, seen, heap = z.copy(), np.zeros(z.shape, bool), []
    for r in range(h):
        for c in range(w):
            if r in (0, h - 1) or c in (0, w - 1):
                heapq.heappush(heap, (z[r, c], r, c))
                seen[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for dr, dc in STEPS:
            a, b = r + dr, c + dc
            if 0 <= a < h and 0 <= b < w and not seen[a, b]:
                seen[a, b] = True
                out[a, b] = max(z[a, b], level)
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def directions(z: np.ndarray) -> np.ndarray:
    """Steepest of eight neighbours, 1..8 from north clockwise, the first of equals; 0 without a drop."""
    h, w = z.shape
    pad = np.pad(z, 1, constant_values=np.inf)
    drops = np.stack([(z - pad[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]) / np.hypot(dr, dc) for dr, dc in STEPS])
    return np.where(drops.max(axis=0) > 0, drops.argmax(axis=0) + 1, 0)


def accumulation(z: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
    d = directions(z) if d is None else d
    acc = np.ones(z.shape)
    for i in np.argsort(-z, axis=None, kind="stable"):
        r, c = divmod(int(i), z.shape[1])
        if d[r, c]:
            dr, dc = STEPS[d[r, c] - 1]
            acc[r + dr, c + dc] += acc[r, c]
    return acc


def strahler(z: np.ndarray, least: int = 50) -> np.ndarray:
    """Order of stream cells (accumulation of least or more), 0 elsewhere: one more where two of the highest order meet."""
    d = directions(z)
    acc = accumulation(z, d)
    best, times, order = np.zeros(z.shape, int), np.zeros(z.shape, int), np.zeros(z.shape, int)
    for i in np.argsort(-z, axis=None, kind="stable"):
        r, c = divmod(int(i), z.shape[1])
        if acc[r, c] < least:
            continue
        order[r, c] = 1 if not best[r, c] else best[r, c] + (times[r, c] >= 2)
        if d[r, c]:
            a, b = r + STEPS[d[r, c] - 1][0], c + STEPS[d[r, c] - 1][1]
            if order[r, c] > best[a, b]:
                best[a, b], times[a, b] = order[r, c], 1
            elif order[r, c] == best[a, b]:
                times[a, b] += 1
    return order


def horn(z: np.ndarray, r: int, c: int, cell: float) -> float:
    """The slope at an interior cell, by Horn's differences."""
    (a, b, e), (d, _, f), (g, h, i) = z[r - 1 : r + 2, c - 1 : c + 2].tolist()
    return float(np.hypot((e + 2 * f + i) - (a + 2 * d + g), (a + 2 * b + e) - (g + 2 * h + i))) / (8 * cell)


def mass_wasting(z: np.ndarray, repose_deg: float = 30.0, cell: float = 90.0) -> np.ndarray:
    """Interior cells that are steeper than the angle of repose, from high to low, give to their steepest lower neighbour half of what exceeds it; mass is kept."""
    z = z.copy()
    h, w = z.shape
    steep = np.tan(np.radians(repose_deg))
    for i in np.argsort(-z, axis=None, kind="stable"):
        r, c = divmod(int(i), w)
        if not (0 < r < h - 1 and 0 < c < w - 1) or horn(z, r, c, cell) <= steep:
            continue
        best, to = 0.0, None
        for dr, dc in STEPS:
            away = cell * np.hypot(dr, dc)
            drop = (z[r, c] - z[r + dr, c + dc]) / away
            if drop > best:
                best, to = drop, (r + dr, c + dc, away)
        if to:
            a, b, away = to
            moved = ((z[r, c] - z[a, b]) - steep * away) / 2
            if moved > 0:
                z[r, c] -= moved
                z[a, b] += moved
    return z


def stream_power(z: np.ndarray, k: float = 0.5, most: float = 10.0, rounds: int = 3, cell: float = 90.0, repose_deg: float = 30.0) -> np.ndarray:
    """Interior cells lose k times the root of the accumulation times Horn's slope, at most so many metres a round; nothing falls below 0; then mass wasting."""
    for _ in range(rounds):
        acc = accumulation(z, directions(z))
        lost = np.zeros(z.shape)
        n = lambda dr, dc: z[1 + dr : z.shape[0] - 1 + dr, 1 + dc : z.shape[1] - 1 + dc]
        gx = (n(-1, 1) + 2 * n(0, 1) + n(1, 1)) - (n(-1, -1) + 2 * n(0, -1) + n(1, -1))
        gy = (n(-1, -1) + 2 * n(-1, 0) + n(-1, 1)) - (n(1, -1) + 2 * n(1, 0) + n(1, 1))
        lost[1:-1, 1:-1] = np.minimum(k * np.sqrt(acc[1:-1, 1:-1]) * np.hypot(gx, gy) / (8 * cell), most)
        z = mass_wasting(np.maximum(z - lost, 0.0), repose_deg, cell)
    return z


def thinned(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning to lines of one cell."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        before = m.copy()
        for odd in (False, True):
            p = [m[1 + dr : m.shape[0] - 1 + dr, 1 + dc : m.shape[1] - 1 + dc] for dr, dc in STEPS]
            turns = sum((~p[i] & p[(i + 1) % 8]).astype(int) for i in range(8))
            n = sum(x.astype(int) for x in p)
            a, b = (p[0] & p[2] & p[4], p[2] & p[4] & p[6]) if not odd else (p[0] & p[2] & p[6], p[0] & p[4] & p[6])
            m[1:-1, 1:-1] &= ~((n >= 2) & (n <= 6) & (turns == 1) & ~a & ~b)
        if (m == before).all():
            return m[1:-1, 1:-1]
