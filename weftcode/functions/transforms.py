"""Closed-form dictionaries and permutations."""

from __future__ import annotations

import numpy as np


def dct(n: int) -> np.ndarray:
    """Orthonormal DCT-II, a basis vector per row."""
    k, i = np.mgrid[:n, :n]
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def dct_2d(height: int, width: int) -> np.ndarray:
    """Rows are the separable 2-D basis over flat (v, h) patches, in (v, h) order of frequencies."""
    return np.einsum("av,bh->abvh", dct(height), dct(width)).reshape(height * width, height * width)


def dct_frame(n: int) -> np.ndarray:
    """DCT over identity: a tight frame, D^T D = 2 I."""
    return np.concatenate([dct(n), np.eye(n)])


def zigzag_order(height: int, width: int) -> list[tuple[int, int]]:
    """Positions by anti-diagonal; odd diagonals run down, even ones up."""
    return sorted(np.ndindex(height, width), key=lambda p: (sum(p), p[1] if sum(p) % 2 == 0 else p[0]))


def zigzag(m: np.ndarray) -> np.ndarray:
    return np.array([m[p] for p in zigzag_order(*m.shape)], np.float64)


def inverse_zigzag(a: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    for p, x in zip(zigzag_order(height, width), a, strict=True):
        out[p] = x
    return out


def unit_sphere_walk(start: np.ndarray, angle: float, count: int, great_circle: bool = False, other: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """count points, a row each, the start first: each is the one before, turned by the angle.

    The turn is in a new random plane each time, or always in one: that of the start and ``other``, or a random one.
    """
    if other is not None and not great_circle:
        raise ValueError("another vector defines a great circle")
    rng = np.random.default_rng(seed)
    x = np.asarray(start, np.float64) / np.linalg.norm(start)
    out, towards = [x], None
    for _ in range(count - 1):
        if towards is None or not great_circle:
            towards = rng.normal(size=x.shape) if other is None else np.asarray(other, np.float64)
            towards = towards - (towards @ x) * x
            towards /= np.linalg.norm(towards)
        x, towards = np.cos(angle) * x + np.sin(angle) * towards, np.cos(angle) * towards - np.sin(angle) * x
        out.append(x)
    return np.array(out)
