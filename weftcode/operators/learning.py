"""Dictionary learning with sufficient statistics.

For fixed codes C of data X a gradient needs A = C^T C, B = C^T X, the row count and
sum c^2 only. Tasks add these up where the rows are; s * s + s * n numbers leave them
whatever the data's size, and the driver, which holds the dictionary, makes the step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sum_matrices
from . import inference
from .whitening import covariance

LOWEST_CODE = 0.001


@dataclass
class Stats:
    cc: np.ndarray
    cx: np.ndarray
    n: int

    @property
    def energy(self) -> np.ndarray:
        """Mean squared code of each element."""
        return np.diag(self.cc) / self.n

    def gradient(self, d: np.ndarray) -> np.ndarray:
        """C^T (C D - X) / n"""
        return (self.cc @ d - self.cx) / self.n


def needed(sums: dict) -> dict:
    """The sums, of one row at least."""
    if not sums:
        raise ValueError("no rows")
    return sums


def code_stats(df: DataFrame, code: str = "code", col: str = "x") -> Stats:
    sums = needed(sum_matrices(df, [code, col], lambda c, x: {"cc": c.T @ c, "cx": c.T @ x, "n": [[len(c)]]}))
    return Stats(sums["cc"], sums["cx"], int(sums["n"][0, 0]))


def unit_rows(d: np.ndarray) -> np.ndarray:
    """Each element over its norm, kernels over the norm of the whole kernel."""
    flat = d.reshape(len(d), -1)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).reshape(d.shape)


def steepest(d: np.ndarray, stats: Stats, step: float, iterations: int = 1, normalize: bool = True) -> np.ndarray:
    for _ in range(iterations):
        d = d - step * stats.gradient(d)
        d = unit_rows(d) if normalize else d
    return d


def cheap_quadratic(d: np.ndarray, stats: Stats, hessian: np.ndarray, step: float, iterations: int = 1, lowest: float = LOWEST_CODE, normalize: bool = True) -> np.ndarray:
    """Each element's step over its Hessian estimate."""
    for _ in range(iterations):
        d = d - step * stats.gradient(d) / (hessian[:, None] + lowest)
        d = unit_rows(d) if normalize else d
    return d


def hessian_update(hessian: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Moving average of the codes' energies with weight 1/100."""
    return 0.99 * hessian + energy / 100


def alignment_gradient(d: np.ndarray, normalized: bool) -> np.ndarray:
    """Gradient of the sum over others of |cosine|, for each row of a group."""
    norm = np.ones(len(d)) if normalized else np.linalg.norm(d, axis=1)
    cos = d @ d.T / np.outer(norm, norm)
    sign = np.sign(cos)
    towards = (sign / np.outer(norm, norm)) @ d
    along = (sign * cos).sum(1)[:, None] * d / (norm**2)[:, None]
    return towards - along


def subspace_step(d: np.ndarray, stats: Stats, groups: list[list[int]], penalty: float, step: float, hessian: np.ndarray | None = None, iterations: int = 1, lowest: float = LOWEST_CODE, normalize: bool = True) -> np.ndarray:
    """Descent with an alignment penalty inside groups; with a Hessian the cheap quadratic form, without one the steepest."""
    for _ in range(iterations):
        g = stats.gradient(d)
        if penalty:
            for members in groups:
                g[members] += penalty * alignment_gradient(d[members], normalize)
        if hessian is not None:
            g = g / (hessian[:, None] + lowest)
        d = d - step * g
        d = unit_rows(d) if normalize else d
    return d


def ica_step(d: np.ndarray, cs: np.ndarray, n: int, step: float) -> np.ndarray:
    """Natural gradient with cs = C^T sign(C) summed over n rows."""
    return d + step * (cs / n - np.eye(len(d))) @ d


def conv_gradient(df: DataFrame, kernels: np.ndarray, code_shape: tuple[int, int, int], stride: tuple[int, int], size: tuple[int, int], padding=None, code: str = "code", col: str = "x") -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient over kernels (mean over images), energies of the codes (mean over images of the spatial sum), rows."""
    mask = inference.mask_of(*size, padding)

    def fn(c, x):
        codes = c.reshape(len(c), *code_shape)
        rest = mask * (inference.conv_synthesis(codes, kernels, stride, size) - x.reshape(len(x), kernels.shape[1], *size))
        views = np.lib.stride_tricks.sliding_window_view(rest, kernels.shape[2:], (2, 3))[:, :, :: stride[0], :: stride[1]]
        g = np.tensordot(codes, views, ((0, 2, 3), (0, 2, 3)))
        return {"g": g.reshape(len(kernels), -1), "e": (codes**2).sum((0, 2, 3)), "n": [[len(c)]]}

    sums = needed(sum_matrices(df, [code, col], fn))
    n = int(sums["n"][0, 0])
    return sums["g"].reshape(kernels.shape) / n, sums["e"][0] / n, n


def conv_step(kernels: np.ndarray, gradient: np.ndarray, step: float, hessian: np.ndarray | None = None, lowest: float = LOWEST_CODE, normalize: bool = True) -> np.ndarray:
    """The gradient, over the Hessian estimate if there is one, at the scale of the kernels, times the step."""
    g = gradient if hessian is None else gradient / (hessian[:, None, None, None] + lowest)
    size = np.linalg.norm(g)
    out = kernels - step * g * (np.linalg.norm(kernels) / size if size else 0.0)
    return unit_rows(out) if normalize else out


@dataclass
class Schedule:
    """Parameters that hold from an iteration on; iteration 0 must be there."""

    values: dict[int, object]

    def __post_init__(self):
        if 0 not in self.values:
            raise ValueError("the schedule has nothing for iteration 0")

    def at(self, iteration: int):
        return self.values[max(k for k in self.values if k <= iteration)]


@dataclass
class Trained:
    dictionary: np.ndarray
    hessian: np.ndarray
    metrics: list[dict] = field(default_factory=list)


#: Update rules by name, each (d, stats, hessian, groups, penalty, step) to the next dictionary.
RULES: dict[str, Callable] = {
    "steepest": lambda d, s, h, g, p, step: steepest(d, s, step),
    "cheap_quadratic": lambda d, s, h, g, p, step: cheap_quadratic(d, s, h, step),
    "subspace_steepest": lambda d, s, h, g, p, step: subspace_step(d, s, g, p, step),
    "subspace_cheap_quadratic": lambda d, s, h, g, p, step: subspace_step(d, s, g, p, step, h),
}


def train_sparse_coding(batches: Callable[[int], DataFrame], iterations: int, start: np.ndarray, weight: Schedule, steps: Schedule, code_iterations: int, rule: str = "steepest", groups: list[list[int]] | None = None, penalty: float = 0.0, checkpoint: Callable[[int, np.ndarray], None] | None = None, metrics: Callable[[int, np.ndarray], dict] | None = None, maintain: Callable[[int, np.ndarray], np.ndarray] | None = None, **options) -> Trained:
    """Alternate inference on batches(t) and a dictionary step.

    At iteration t, in this order: scheduled parameters, maintenance (reset of elements),
    checkpoint, metrics, inference, step; checkpoint and metrics see the dictionary before step t.
    """
    d = np.array(start, np.float64)
    if not np.allclose(np.linalg.norm(d, axis=1), 1, atol=1e-4):
        raise ValueError("elements of the first dictionary have norm 1")
    update, out = RULES[rule], Trained(d, np.zeros(len(d)))
    for t in range(iterations):
        lam, step = weight.at(t), steps.at(t)
        d = maintain(t, d) if maintain else d
        if checkpoint:
            checkpoint(t, d)
        if metrics:
            out.metrics.append({"iteration": t, **metrics(t, d)})
        coded = inference.infer(batches(t), d, lam, code_iterations, groups=groups, **options)
        stats = code_stats(coded)
        out.hessian = hessian_update(out.hessian, stats.energy)
        d = update(d, stats, out.hessian, groups, penalty, step)
    out.dictionary = d
    return out


def train_conv(batches: Callable[[int], DataFrame], iterations: int, start: np.ndarray, shape: tuple[int, int, int], stride: tuple[int, int], padding, weight: float, step: float, code_iterations: int, quadratic: bool = False, **options) -> Trained:
    """The convolutional form; images are flat (c, h, w) rows without their padding."""
    k = unit_rows(np.array(start, np.float64))
    (t, b), (le, r) = padding or ((0, 0), (0, 0))
    size = (shape[1] + t + b, shape[2] + le + r)
    code_shape = (len(k), inference.code_size(size[0], k.shape[2], stride[0]), inference.code_size(size[1], k.shape[3], stride[1]))
    out = Trained(k, np.zeros(len(k)))
    for i in range(iterations):
        coded = inference.infer_conv(batches(i), k, shape, stride, weight, code_iterations, padding, **options)
        from ..functions.vectors import apply_rows

        padded = apply_rows(coded, ["x"], ["x"], lambda x: np.pad(x.reshape(len(x), *shape), ((0, 0), (0, 0), (t, b), (le, r))).reshape(len(x), -1))
        g, energy, _ = conv_gradient(padded, k, code_shape, stride, size, padding)
        out.hessian = hessian_update(out.hessian, energy)
        k = conv_step(k, g, step, out.hessian if quadratic else None)
    out.dictionary = k
    return out


def train_ica(batches: Callable[[int], DataFrame], iterations: int, start: np.ndarray, step: float) -> np.ndarray:
    """Square dictionaries only: codes are X D^-1."""
    d = np.array(start, np.float64)
    if d.shape[0] != d.shape[1]:
        raise ValueError("the dictionary is not square")
    for t in range(iterations):
        inverse = np.linalg.inv(d)
        sums = needed(sum_matrices(batches(t), ["x"], lambda x, m=inverse: {"cs": (x @ m).T @ np.sign(x @ m), "n": [[len(x)]]}))
        d = ica_step(d, sums["cs"], int(sums["n"][0, 0]), step)
    return d


def train_pca(df: DataFrame, col: str = "x", tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Components as rows, by falling variance, and the variances. The data must be centred."""
    c, means, _ = covariance(df, col, center=False)
    if np.abs(means).max() >= tolerance:
        raise ValueError("the data is not centred")
    variances, basis = np.linalg.eigh(c)
    return basis[:, ::-1].T, variances[::-1]


def similar_pairs(d: np.ndarray, limit: float, groups: list[list[int]] | None = None) -> list[tuple[int, int, float]]:
    """(i, j, cosine) with i < j above the limit: |cosine| inside groups, the signed one over all."""
    unit = unit_rows(d)
    cos = unit @ unit.T
    if groups is None:
        i, j = np.nonzero(np.triu(cos, 1) > limit)
        return [(int(a), int(b), float(cos[a, b])) for a, b in zip(i, j)]
    return [(a, b, float(cos[a, b])) for g in groups for k, a in enumerate(g) for b in g[k + 1 :] if abs(cos[a, b]) > limit]


def similar_rows(df: DataFrame, limit: float, block: int = 512, id_col: str = "id", col: str = "x") -> DataFrame:
    """(a, b, cosine) with a < b of all rows whose cosine is above the limit; blocks of rows meet in tasks."""
    blocks = max(1, -(-df.count() // block))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("x"))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("k")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    left, right = (held.select(F.col("k").alias(f"k{s}"), F.col("rows.id").alias(f"id{s}"), F.col("rows.x").alias(f"x{s}")) for s in "ab")
    pairs = left.crossJoin(right).filter("ka <= kb").repartition(blocks * (blocks + 1) // 2)

    def kernel(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, others = np.array(r["ida"]), np.array(r["idb"])
                cos = unit_rows(np.array(r["xa"])) @ unit_rows(np.array(r["xb"])).T
                hit = cos > limit
                if r["ka"] == r["kb"]:
                    hit &= ids[:, None] < others[None, :]
                i, j = np.nonzero(hit)
                a, b = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(cos[i, j])], names=["a", "b", "cosine"])

    return pairs.mapInArrow(kernel, "a long, b long, cosine double")


def one_of_each(pairs, rng: np.random.Generator) -> list[int]:
    """A random member of each pair of which neither is chosen yet."""
    out: list[int] = []
    for a, b, *_ in pairs:
        if a not in out and b not in out:
            out.append(int((a, b)[rng.integers(2)]))
    return out


def reset_elements(d: np.ndarray, which: list[int], rng: np.random.Generator) -> np.ndarray:
    """Noise of the mean norm in these rows."""
    out, noise = d.copy(), rng.normal(size=(len(which), d.shape[1]))
    if which:
        out[which] = unit_rows(noise) * np.linalg.norm(d, axis=1).mean()
    return out


def prune_elements(d: np.ndarray, which: list[int], groups: list[list[int]] | None = None) -> tuple[np.ndarray, list[list[int]] | None]:
    """Without these rows; groups keep their members under new numbers."""
    keep = [i for i in range(len(d)) if i not in set(which)]
    number = {old: new for new, old in enumerate(keep)}
    return d[keep], None if groups is None else [[number[i] for i in g if i in number] for g in groups]


def nonuniformity(df: DataFrame, groups: list[list[int]], circles: int, seed: int = 0, bins: int = 20, code: str = "code") -> np.ndarray:
    """Per group: variance of the angle density of its codes' directions on random great circles, averaged over circles.

    The planes come from the seed; only histogram counts leave the tasks.
    """
    rng = np.random.default_rng(seed)
    planes = [[np.linalg.qr(rng.normal(size=(len(g), 2)))[0] for _ in range(circles)] for g in groups]
    edges = np.linspace(-np.pi, np.pi, bins + 1)

    def fn(c):
        rows = np.zeros((len(groups) * circles, bins))
        for k, g in enumerate(groups):
            part = c[:, g]
            norm = np.linalg.norm(part, axis=1)
            unit = part[norm > 0] / norm[norm > 0, None]
            for q, plane in enumerate(planes[k]):
                p = unit @ plane
                rows[k * circles + q] = np.histogram(np.arctan2(p[:, 1], p[:, 0]), edges)[0]
        return {"h": rows}

    counts = needed(sum_matrices(df, [code], fn))["h"]
    total = counts.sum(1, keepdims=True)
    density = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    return density.var(1).reshape(len(groups), circles).mean(1)


def outlier_groups(values: np.ndarray, least: float = 0.002) -> list[int]:
    """Groups more than a standard deviation from the mean and above the least value."""
    return [int(i) for i in np.flatnonzero((np.abs(values - values.mean()) > values.std()) & (np.abs(values) > least))]


def maintain(d: np.ndarray, kind: str, action: str, rng: np.random.Generator, groups: list[list[int]] | None = None, codes: DataFrame | None = None, count: int = 0, threshold: float | None = None, within_groups: bool = False, circles: int = 10) -> tuple[np.ndarray, list[list[int]] | None, list[int]]:
    """Reset or prune elements of a fully-connected dictionary: the next dictionary, its groups, which elements.

    kind random: ``count`` draws with replacement; cosine: one of each pair above the threshold; nonuniform: elements
    of groups whose codes are spread unlike those of the other groups.
    """
    if action not in ("reset", "prune"):
        raise ValueError("the action is reset or prune")
    if kind == "random":
        which = sorted(set(rng.integers(len(d), size=count).tolist()))
    elif kind == "cosine":
        if threshold is None or (within_groups and groups is None):
            raise ValueError("a threshold is needed, and groups to stay within them")
        which = one_of_each(similar_pairs(d, threshold, groups if within_groups else None), rng)
    elif kind == "nonuniform":
        if groups is None or codes is None:
            raise ValueError("groups and codes are needed")
        odd = outlier_groups(nonuniformity(codes, groups, circles, int(rng.integers(1 << 31))))
        which = sorted({i for g in odd for i in groups[g]})
    else:
        raise KeyError(f"no filter {kind}")
    if action == "reset":
        return reset_elements(d, which, rng), groups, which
    return *prune_elements(d, which, groups), which
