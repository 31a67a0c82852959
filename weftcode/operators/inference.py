"""Sparse inference: codes of vectors (or images) in a given dictionary.

Every form is a numpy kernel over Arrow batches with the dictionary in its closure, so
rows never leave their task. The iterations have no coupling between rows, unless an
early-stopping threshold is set: that is a mean over a batch, so rows are then
grouped by an explicit batch column and results do not depend on partitioning.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.vectors import apply_rows


def lipschitz(dictionary: np.ndarray) -> float:
    """Largest eigenvalue of D^T D (of D D^T if that is smaller)."""
    d = np.asarray(dictionary, np.float64)
    return float(np.linalg.eigvalsh(d.T @ d if d.shape[0] >= d.shape[1] else d @ d.T)[-1])


def soft(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def threshold(x: np.ndarray, t: float, nonnegative: bool, hard: bool) -> np.ndarray:
    if hard:
        return np.where((x if nonnegative else np.abs(x)) < t, 0.0, x)
    return np.maximum(x - t, 0) if nonnegative else soft(x, t)


def proximal(start: np.ndarray, gradient, shrink, step: float, iterations: int, variant: str, epsilon: float | None) -> np.ndarray:
    """The loop that all variants share; FISTA evaluates gradients at extrapolated points."""
    if variant not in ("ista", "fista"):
        raise ValueError("the variant is ista or fista")
    if iterations < 1:
        raise ValueError("one iteration at least")
    point = old = np.array(start, np.float64)
    t = 1.0
    for k in range(iterations):
        codes = shrink(point - step * gradient(point))
        change = codes - old
        if variant == "fista":
            after = (1 + sqrt(1 + 4 * t * t)) / 2
            point = codes + (t - 1) / after * change
            t = after
        else:
            point = codes
        old = codes
        if epsilon is not None and k > 0 and np.abs(change).mean() / step < epsilon:
            break
    return old


def ista(x: np.ndarray, dictionary: np.ndarray, weight: float, iterations: int, variant: str = "ista", start: np.ndarray | None = None, epsilon: float | None = None, nonnegative: bool = False, hard: bool = False, step: float | None = None) -> np.ndarray:
    """Codes (b, s) of the rows of x; start is not changed."""
    step = step or 1 / lipschitz(dictionary)
    start = np.zeros((len(x), len(dictionary))) if start is None else start
    gradient = lambda c: (c @ dictionary - x) @ dictionary.T
    return proximal(start, gradient, lambda c: threshold(c, weight * step, nonnegative, hard), step, iterations, variant, epsilon)


def group_shrink(groups: np.ndarray, t: float) -> np.ndarray:
    """(b, groups, size): each group's norm shrinks by t; signs stay."""
    norm = np.linalg.norm(groups, axis=2, keepdims=True)
    return groups * np.maximum(1 - t / np.where(norm == 0, 1.0, norm), 0)


def subspace_ista(x: np.ndarray, dictionary: np.ndarray, groups: list[list[int]], weight: float, iterations: int, variant: str = "ista", start: np.ndarray | None = None, epsilon: float | None = None, hard: bool = False, summed: bool = True) -> np.ndarray:
    """Group-sparse codes. An element of several groups has a copy in each; copies are summed in the result."""
    if hard or not summed:
        raise NotImplementedError("only soft thresholds and summed copies")
    size = max(map(len, groups))
    index = np.zeros((len(groups), size), np.int64)
    real = np.zeros((len(groups), size), bool)
    for g, members in enumerate(groups):
        index[g, : len(members)], real[g, : len(members)] = members, True
    wide = np.where(real.ravel()[:, None], dictionary[index.ravel()], 0.0)
    step = 1 / lipschitz(wide)
    begin = np.zeros((len(x), wide.shape[0])) if start is None else np.where(real.ravel(), start[:, index.ravel()], 0.0)
    gradient = lambda c: (c @ wide - x) @ wide.T
    shrink = lambda c: group_shrink(c.reshape(len(c), len(groups), size), weight * step).reshape(c.shape)
    copies = proximal(begin, gradient, shrink, step, iterations, variant, epsilon)
    out = np.zeros((len(x), len(dictionary)))
    np.add.at(out.T, index.ravel()[real.ravel()], copies.T[real.ravel()])
    return out


def padding_amount(image: int, kernel: int, stride: int) -> tuple[int, int]:
    """Zeros before and after, so that every pixel is covered alike."""
    lead = kernel - stride
    return lead, lead + (stride - image % stride if image % stride else 0)


def code_size(padded: int, kernel: int, stride: int) -> int:
    return 1 + ceil((padded - kernel) / stride)


def mask_of(height: int, width: int, padding: tuple[tuple[int, int], tuple[int, int]] | None) -> np.ndarray:
    """1 inside, 0 in the padding; an amount of 0 masks nothing on that side."""
    out = np.ones((height, width))
    if padding:
        (top, bottom), (left, right) = padding
        out[:top], out[height - bottom :] = 0, 0
        out[:, :left], out[:, width - right :] = 0, 0
    return out


def conv_synthesis(codes: np.ndarray, kernels: np.ndarray, stride: tuple[int, int], size: tuple[int, int]) -> np.ndarray:
    """(b, s, sh, sw) codes and (s, c, kh, kw) kernels to images (b, c, h, w)."""
    b, _, sh, sw = codes.shape
    _, c, kh, kw = kernels.shape
    full = np.zeros((b, c, max(size[0], (sh - 1) * stride[0] + kh), max(size[1], (sw - 1) * stride[1] + kw)))
    parts = np.tensordot(codes, kernels, (1, 0))  # b, sh, sw, c, kh, kw
    for i in range(kh):
        for j in range(kw):
            full[:, :, i : i + sh * stride[0] : stride[0], j : j + sw * stride[1] : stride[1]] += parts[..., i, j].transpose(0, 3, 1, 2)
    return full[:, :, : size[0], : size[1]]


def conv_analysis(images: np.ndarray, kernels: np.ndarray, stride: tuple[int, int]) -> np.ndarray:
    """Inner products of each kernel with each placement: (b, s, sh, sw)."""
    views = np.lib.stride_tricks.sliding_window_view(images, kernels.shape[2:], (2, 3))[:, :, :: stride[0], :: stride[1]]
    return np.tensordot(views, kernels, ((1, 4, 5), (1, 2, 3))).transpose(0, 3, 1, 2)


def conv_ista(images: np.ndarray, kernels: np.ndarray, stride: tuple[int, int], padding, weight: float, iterations: int, variant: str = "ista", start: np.ndarray | None = None, epsilon: float | None = None, nonnegative: bool = False, hard: bool = False) -> np.ndarray:
    """Convolutional codes of padded images (b, c, h, w); the residual counts inside the padding only."""
    flat = kernels.reshape(len(kernels), -1)
    step = 1 / float(np.linalg.eigvalsh(flat @ flat.T)[-1])
    size = images.shape[2:]
    shape = (len(images), len(kernels), code_size(size[0], kernels.shape[2], stride[0]), code_size(size[1], kernels.shape[3], stride[1]))
    start = np.zeros(shape) if start is None else start
    if start.shape != shape:
        raise ValueError(f"start is {start.shape}, not {shape}")
    mask = mask_of(*size, padding)
    gradient = lambda c: conv_analysis(mask * (conv_synthesis(c, kernels, stride, size) - images), kernels, stride)
    return proximal(start, gradient, lambda c: threshold(c, weight * step, nonnegative, hard), step, iterations, variant, epsilon)


def infer(df: DataFrame, dictionary: np.ndarray, weight: float, iterations: int, groups: list[list[int]] | None = None, epsilon: float | None = None, batch_col: str | None = None, start_col: str | None = None, col: str = "x", out: str = "code", **options) -> DataFrame:
    """Add codes: FC ISTA/FISTA, or the subspace form if groups are given.

    With epsilon, batch_col is needed; a batch is what is held in memory at once.
    """
    d = np.asarray(dictionary, np.float64)
    if groups is None:
        options.setdefault("step", 1 / lipschitz(d))

    def codes(x, start=None):
        if groups is not None:
            return subspace_ista(x, d, groups, weight, iterations, start=start, epsilon=epsilon, **options)
        return ista(x, d, weight, iterations, start=start, epsilon=epsilon, **options)

    if epsilon is None:
        return apply_rows(df, [col, start_col] if start_col else [col], [out], codes)
    if batch_col is None:
        raise ValueError("early stopping is a matter of a batch: name its column")

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        start = np.stack(batch[start_col]) if start_col else None
        return batch.assign(**{out: list(codes(np.stack(batch[col]).astype(np.float64), start))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return df.groupBy(batch_col).applyInPandas(one, f"{schema}, `{out}` array<double>")


def infer_conv(df: DataFrame, kernels: np.ndarray, shape: tuple[int, int, int], stride: tuple[int, int], weight: float, iterations: int, padding=None, col: str = "x", out: str = "code", **options) -> DataFrame:
    """Add flattened convolutional codes; images are flat (c, h, w) rows, unpadded if padding is given."""
    k = np.asarray(kernels, np.float64)

    def fn(x):
        images = x.reshape(len(x), *shape)
        if padding:
            images = np.pad(images, ((0, 0), (0, 0), *padding))
        return conv_ista(images, k, stride, padding, weight, iterations, **options).reshape(len(x), -1)

    return apply_rows(df, [col], [out], fn)


def linear_codes(df: DataFrame, dictionary: np.ndarray, orthonormal: bool = False, col: str = "x", out: str = "code") -> DataFrame:
    """X D^T, or X D^-1 for a dictionary that is only invertible."""
    d = np.asarray(dictionary, np.float64)
    m = d.T.copy() if orthonormal else np.linalg.inv(d)
    return apply_rows(df, [col], [out], lambda x: x @ m)


def synthesize(df: DataFrame, dictionary: np.ndarray, col: str = "code", out: str = "recon") -> DataFrame:
    d = np.asarray(dictionary, np.float64)
    return apply_rows(df, [col], [out], lambda c: c @ d)


def synthesize_conv(df: DataFrame, kernels: np.ndarray, code_shape: tuple[int, int, int], stride: tuple[int, int], size: tuple[int, int], padding=None, col: str = "code", out: str = "recon") -> DataFrame:
    """Images from convolutional codes, without their padding."""
    k = np.asarray(kernels, np.float64)

    def fn(c):
        image = conv_synthesis(c.reshape(len(c), *code_shape), k, stride, size)
        if padding:
            (t, b), (le, r) = padding
            image = image[:, :, t : size[0] - b, le : size[1] - r]
        return image.reshape(len(c), -1)

    return apply_rows(df, [col], [out], fn)
