"""Whitening and local normalization: dataset statistics from one aggregation, the rest per row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import filters
from ..functions.vectors import apply_rows, sum_matrices


def gram(df: DataFrame, col: str = "x") -> tuple[np.ndarray, np.ndarray, int]:
    """X^T X, column sums, rows: added up in the tasks, so n * n numbers leave each of them."""
    sums = sum_matrices(df, [col], lambda x: {"gram": x.T @ x, "sum": x.sum(0), "n": [[len(x)]]})
    if not sums:
        raise ValueError("no rows")
    return sums["gram"], sums["sum"][0], int(sums["n"][0, 0])


def covariance(df: DataFrame, col: str = "x", center: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Population covariance (or X^T X / D if not centred), means, rows."""
    g, s, n = gram(df, col)
    means = s / n
    return g / n - (np.outer(means, means) if center else 0), means, n


@dataclass
class ZCA:
    basis: np.ndarray  # a component per column
    variances: np.ndarray
    means: np.ndarray
    offset: float = 1e-4

    def matrix(self) -> np.ndarray:
        return self.basis / (np.sqrt(np.maximum(self.variances, 0)) + self.offset) @ self.basis.T

    def inverse(self) -> np.ndarray:
        return self.basis * (np.sqrt(np.maximum(self.variances, 0)) + self.offset) @ self.basis.T


def fit_zca(df: DataFrame, col: str = "x", check: bool = True) -> ZCA:
    """Needs ten times as many rows as components."""
    c, means, n = covariance(df, col)
    if check and len(c) > 0.1 * n:
        raise ValueError("too few rows for a ZCA fit")
    variances, basis = np.linalg.eigh(c)
    return ZCA(basis[:, ::-1], variances[::-1], means)


def whiten_zca(df: DataFrame, model: ZCA, col: str = "x", scalar_mean: bool = False) -> DataFrame:
    """Centre, decorrelate, scale, and put the scalar mean back. A given model centres by its scalar mean if asked."""
    m, mean = model.matrix(), float(model.means.mean())
    centre = mean if scalar_mean else model.means
    return apply_rows(df, [col], [col], lambda x: (x - centre) @ m + mean)


def unwhiten_zca(df: DataFrame, model: ZCA, col: str = "x", scalar_mean: bool = False) -> DataFrame:
    m, mean = model.inverse(), float(model.means.mean())
    centre = mean if scalar_mean else model.means
    return apply_rows(df, [col], [col], lambda x: (x - mean) @ m + centre)


def per_image(df: DataFrame, height: int, width: int, fn, col: str = "x", outs: list[str] | None = None) -> DataFrame:
    """Apply fn to all images of a batch at once, as a (height, width, planes) array; it returns one such array per output.

    A plane is a channel of an image; fn treats planes independently.
    """

    def rows(x):
        planes = x.reshape(len(x), height, width, -1).transpose(1, 2, 0, 3)
        got = fn(planes.reshape(height, width, -1))
        got = got if isinstance(got, tuple) else (got,)
        return tuple(g.reshape(planes.shape).transpose(2, 0, 1, 3).reshape(x.shape) for g in got)

    return apply_rows(df, [col], outs or [col], rows)


def filter_images(df: DataFrame, height: int, width: int, taps: np.ndarray, col: str = "x") -> DataFrame:
    return per_image(df, height, width, lambda i: filters.filter_spatial(i, taps), col)


def whiten_center_surround(df: DataFrame, height: int, width: int, low: float = 1e-3, high: float = 0.9, norm_and_threshold: bool = True, col: str = "x") -> DataFrame:
    dft = filters.center_surround((height, width), low, high, norm_and_threshold)
    return per_image(df, height, width, lambda i: filters.filter_frequency(i, dft), col)


def unwhiten_center_surround(df: DataFrame, height: int, width: int, low: float | None = None, dft: np.ndarray | None = None, col: str = "x") -> DataFrame:
    """Inverse by the filter that was used, or by the ramp of this low cutoff without the low-pass filter."""
    if dft is None:
        if low is None:
            raise ValueError("a filter or a low cutoff is needed")
        dft = np.maximum(filters.whitening_ramp((height, width), False), low)
    return per_image(df, height, width, lambda i: filters.filter_frequency(i, 1.0 / dft), col)


def local_contrast(df: DataFrame, height: int, width: int, sigma: int, col: str = "x") -> DataFrame:
    """x over the root of the gaussian-weighted mean of x^2 (1 where that is 0); also the normalizer."""
    taps = filters.gaussian_2d(sigma, (4 * sigma + 1, 4 * sigma + 1))

    def fn(image):
        v = filters.filter_spatial(image**2, taps)
        root = np.sqrt(np.where(v == 0, 1.0, v))
        return image / root, root

    return per_image(df, height, width, fn, col, [col, "normalizer"])


def local_luminance(df: DataFrame, height: int, width: int, sigma: int, col: str = "x") -> DataFrame:
    """x less its gaussian-weighted mean; also what was subtracted."""
    taps = filters.gaussian_2d(sigma, (4 * sigma + 1, 4 * sigma + 1))

    def fn(image):
        mean = filters.filter_spatial(image, taps)
        return image - mean, mean

    return per_image(df, height, width, fn, col, [col, "subtractor"])


def power_spectrum(df: DataFrame, height: int, width: int, col: str = "x") -> DataFrame:
    """|FFT|^2 of each image, zero frequency in the middle."""
    return per_image(df, height, width, lambda i: np.fft.fftshift(np.abs(np.fft.fft2(i, axes=(0, 1))) ** 2, axes=(0, 1)), col)
