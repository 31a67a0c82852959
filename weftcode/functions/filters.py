"""Filters as small driver-side arrays, and grids of them as tables."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binomial_1d(size: int) -> np.ndarray:
    """Binomial coefficients over their sum."""
    if size < 2:
        raise ValueError("a binomial filter has two taps at least")
    return np.array([comb(size - 1, k) for k in range(size)]) / 2.0 ** (size - 1)


def binomial_2d(height: int, width: int) -> np.ndarray:
    return np.outer(binomial_1d(height), binomial_1d(width))


def centred(n: int) -> np.ndarray:
    """Coordinates of n taps: symmetric for odd n, from -n/2 to n/2 - 1 for even n."""
    return np.arange(n) - n // 2


def gaussian_2d(sigma: float, window: tuple[int, int], normalized: bool = True) -> np.ndarray:
    v, h = np.meshgrid(centred(window[0]), centred(window[1]), indexing="ij")
    g = np.exp(-0.5 * (v * v + h * h) / sigma**2)
    return g / g.sum() if normalized else g


def frequencies(shape: tuple[int, int]) -> np.ndarray:
    """Radial frequency in cycles per sample, in DFT order."""
    return np.hypot(np.fft.fftfreq(shape[0])[:, None], np.fft.fftfreq(shape[1])[None])


def low_pass(shape: tuple[int, int], cutoff: float, order: float = 8.0, norm_and_threshold: bool = True) -> np.ndarray:
    """exp(-(f / (cutoff / 2)) ** order), as a DFT; floor of 1e-3 if thresholded."""
    g = np.exp(-((frequencies(shape) / (0.5 * cutoff)) ** order))
    return np.maximum(g, 1e-3) if norm_and_threshold else g


def whitening_ramp(shape: tuple[int, int], norm_and_threshold: bool = True) -> np.ndarray:
    """The radial frequency, as a DFT; over its maximum and at least 1e-5 if thresholded."""
    f = frequencies(shape)
    return np.maximum(f / f.max(), 1e-5) if norm_and_threshold else f


def center_surround(shape: tuple[int, int], low: float = 1e-3, high: float = 0.9, norm_and_threshold: bool = True) -> np.ndarray:
    """Whitening ramp, at least ``low``, times the low-pass filter of cutoff ``high``."""
    g = np.maximum(whitening_ramp(shape, False), low) * low_pass(shape, high, 8.0, False)
    return np.maximum(g / g.max(), 1e-3) if norm_and_threshold else g


def filter_spatial(image: np.ndarray, taps: np.ndarray, centre: tuple[int, int] | None = None) -> np.ndarray:
    """2-D convolution of (h, w) or (h, w, c), same size, mirrored edges that repeat the edge sample."""
    kh, kw = taps.shape
    cv, ch = centre or ((kh - 1) // 2, (kw - 1) // 2)
    padded = np.pad(image, [(kh, kh), (kw, kw)] + [(0, 0)] * (image.ndim - 2), mode="symmetric")
    out = np.zeros(image.shape)
    for a in range(kh):
        for b in range(kw):
            top, left = kh + cv - a, kw + ch - b
            out += taps[a, b] * padded[top : top + image.shape[0], left : left + image.shape[1]]
    return out


def filter_separable(image: np.ndarray, vertical: np.ndarray, horizontal: np.ndarray) -> np.ndarray:
    """Horizontal, then vertical pass; taps of even number are centred on the later of the middle two."""
    out = filter_spatial(image, horizontal[None], (0, len(horizontal) // 2))
    return filter_spatial(out, vertical[:, None], (len(vertical) // 2, 0))


def filter_frequency(image: np.ndarray, dft: np.ndarray) -> np.ndarray:
    """Multiply in the frequency domain; the filter covers the image at least, the result is cropped."""
    if dft.shape[0] < image.shape[0] or dft.shape[1] < image.shape[1]:
        raise ValueError("the filter is smaller than the image")
    gain = dft.reshape(dft.shape + (1,) * (image.ndim - 2))
    out = np.fft.ifft2(np.fft.fft2(image, dft.shape, axes=(0, 1)) * gain, axes=(0, 1)).real
    return out[: image.shape[0], : image.shape[1]]


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(v, h) of all positions."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("v"), (F.col("id") % width).cast("int").alias("h"))


def gaussian_grid(spark: SparkSession, sigma: float, height: int, width: int) -> DataFrame:
    """(v, h, g): the normalized gaussian as a table."""
    v, h = F.col("v") - height // 2, F.col("h") - width // 2
    raw = grid(spark, height, width).withColumn("g", F.exp(-0.5 * (v * v + h * h) / sigma**2))
    total = raw.agg(F.sum("g")).first()[0]
    return raw.select("v", "h", (F.col("g") / F.lit(total)).alias("g"))


def low_pass_grid(spark: SparkSession, height: int, width: int, cutoff: float, order: float) -> DataFrame:
    """(v, h, g): the low-pass DFT as a table, in DFT order."""
    signed = lambda c, n: F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n) / n
    f = F.sqrt(F.pow(signed("v", height), 2) + F.pow(signed("h", width), 2))
    return grid(spark, height, width).select("v", "h", F.exp(-F.pow(f / (0.5 * cutoff), order)).alias("g"))


def binomial_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(v, h, g): the 2-D binomial filter as a table, exact in doubles."""
    choose = lambda n, c: F.element_at(F.array(*(F.lit(comb(n - 1, k)) for k in range(n))), F.col(c) + 1)
    return grid(spark, height, width).select("v", "h", (choose(height, "v") * choose(width, "h") / F.lit(2.0 ** (height + width - 2))).alias("g"))
