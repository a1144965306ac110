"""Gradient noise on a lattice, vectorised; seeded by numpy, so equal to other generators in distribution only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def perlin2(x: np.ndarray, y: np.ndarray, seed: int = 42) -> np.ndarray:
    """Noise in about [-1, 1], 0 at lattice points."""
    r = np.random.default_rng(seed)
    perm = r.permutation(256)
    perm = np.concatenate([perm, perm])
    angle = r.random(256) * 2 * np.pi
    gx, gy = np.cos(angle), np.sin(angle)
    xi, yi = np.floor(x).astype(int), np.floor(y).astype(int)
    xf, yf = x - xi, y - yi

    def corner(dx: int, dy: int) -> np.ndarray:
        k = perm[perm[(xi + dx) & 255] + ((yi + dy) & 255)]
        return gx[k] * (xf - dx) + gy[k] * (yf - dy)

    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    u, v = fade(xf), fade(yf)
    low = corner(0, 0) * (1 - u) + corner(1, 0) * u
    high = corner(0, 1) * (1 - u) + corner(1, 1) * u
    return 1.5 * (low * (1 - v) + high * v)


def fbm(x: np.ndarray, y: np.ndarray, octaves: int = 5, hurst: float = 0.7, seed: int = 42) -> np.ndarray:
    """Octaves of noise, each twice as fine and 2**-hurst as high."""
    return sum(2 ** (-hurst * k) * perlin2(x * 2**k, y * 2**k, seed + k) for k in range(octaves))


def fbm_column(x: Column, y: Column, octaves: int = 5, hurst: float = 0.7, seed: int = 42) -> Column:
    """fbm of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fbm(a.to_numpy(float), b.to_numpy(float), octaves, hurst, seed))

    return run(x, y)
