"""Metrics, densities and averages as aggregations; nothing but bounded summaries reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.filters import filter_spatial, gaussian_2d
from ..functions.vectors import apply_rows


def summed(x):
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def squared_error(a: str, b: str):
    return summed(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def decibel(magnitude, mse):
    """10 log10(magnitude^2 / mse); infinite for a perfect match."""
    return F.when(mse > 0, 10 * F.log10(magnitude * magnitude / mse)).otherwise(F.lit(float("inf")))


def psnr(df: DataFrame, target: str = "x", recon: str = "recon", magnitude: float | None = None, out: str = "psnr") -> DataFrame:
    """Add each row's pSNR; the signal's range is that of the row's target unless given."""
    size = F.array_max(target) - F.array_min(target) if magnitude is None else F.lit(float(magnitude))
    return df.withColumn(out, decibel(size, squared_error(target, recon) / F.size(target)))


def batch_psnr(df: DataFrame, batch_col: str, target: str = "x", recon: str = "recon") -> DataFrame:
    """(batch, psnr): mean over rows, with the batch's range; rows without error are left out, null if all are."""
    ranges = df.groupBy(batch_col).agg((F.max(F.array_max(target)) - F.min(F.array_min(target))).alias("__range"))
    rows = df.withColumn("__mse", squared_error(target, recon) / F.size(target)).join(ranges, batch_col)
    value = F.when(F.col("__mse") > 0, decibel(F.col("__range"), F.col("__mse")))
    return rows.groupBy(batch_col).agg(F.avg(value).alias("psnr"))


def ssim(df: DataFrame, height: int, width: int, target: str = "x", recon: str = "recon", magnitude: float = 1.0, sigma: float = 1.5, out: str = "ssim") -> DataFrame:
    """Add the mean structural similarity, gaussian-weighted, with population covariances; borders are left out."""
    taps = gaussian_2d(sigma, (11, 11))
    c1, c2 = (0.01 * magnitude) ** 2, (0.03 * magnitude) ** 2
    edge = min(5, (height - 1) // 2, (width - 1) // 2)

    def fn(x, y):
        x, y = (i.T.reshape(height, width, -1) for i in (x, y))
        mean = lambda i: filter_spatial(i, taps)
        ux, uy = mean(x), mean(y)
        vx, vy, cov = mean(x * x) - ux * ux, mean(y * y) - uy * uy, mean(x * y) - ux * uy
        s = (2 * ux * uy + c1) * (2 * cov + c2) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
        return s[edge : height - edge, edge : width - edge].mean((0, 1))[:, None]

    return apply_rows(df, [target, recon], ["__s"], fn).withColumn(out, F.get("__s", F.lit(0))).drop("__s")


def sparsity(df: DataFrame, code: str = "code") -> DataFrame:
    """Add l0 (share of nonzero components) and l1."""
    return df.withColumns({"l0": F.size(F.filter(code, lambda c: c != 0)) / F.size(code), "l1": summed(F.transform(code, F.abs))})


def group_norms(code: str, groups: list[list[int]]):
    """Sum over groups of the norm of a group's codes."""
    norms = [F.sqrt(sum((F.get(code, F.lit(i)) * F.get(code, F.lit(i)) for i in g), F.lit(0.0))) for g in groups]
    return sum(norms, F.lit(0.0))


def lasso(df: DataFrame, weight: float, batch_col: str | None = None, groups: list[list[int]] | None = None, target: str = "x", recon: str = "recon", code: str = "code") -> DataFrame:
    """Per batch (or once): l2 (half the mean squared error sum), lagrange (weight times the mean l1 or group norm), total, l0."""
    penalty = summed(F.transform(code, F.abs)) if groups is None else group_norms(code, groups)
    rows = df.groupBy(*([batch_col] if batch_col else [])).agg(
        F.avg(0.5 * squared_error(target, recon)).alias("l2"), (F.lit(weight) * F.avg(penalty)).alias("lagrange"),
        F.avg(F.size(F.filter(code, lambda c: c != 0)) / F.size(code)).alias("l0"),
    )
    return rows.withColumn("total", F.col("l2") + F.col("lagrange"))


def batch_average(metrics: DataFrame, batch_col: str) -> DataFrame:
    """Plain mean of per-batch metrics: a short last batch counts like any other."""
    return metrics.agg(*(F.avg(c).alias(c) for c in metrics.columns if c != batch_col))


def dictionary_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """(s, change): mean absolute change of each element; both are (s, i, value)."""
    both = now.join(before.select("s", "i", F.col("value").alias("__old")), ["s", "i"])
    return both.groupBy("s").agg(F.avg(F.abs(F.col("value") - F.col("__old"))).alias("change"))


def ignore_values(long: DataFrame, values: list[float], cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """Without rows in which one of the columns is one of the values."""
    for c in cols:
        long = long.filter(~F.col(c).isin(values))
    return long


def bin_of(x, lo: float, hi: float, bins: int):
    """Index of an equal-width bin; the last includes its right edge; outside is null."""
    at = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    return F.when((x >= lo) & (x <= hi), at.cast("int"))


def with_bins(keys: DataFrame, bins: int) -> DataFrame:
    """A row per key and bin."""
    return keys.select(*keys.columns, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))


def histogram(long: DataFrame, bins: int, by: list[str] | None = None, col: str = "x") -> DataFrame:
    """(by..., bin, density): share of values in each bin of the common range; empty bins are there.

    The range is one aggregation, the counts another with a map-side combine.
    """
    by = by or []
    lo, hi = long.agg(F.min(col), F.max(col)).first()
    if lo is None:
        raise ValueError("no values")
    hi = hi if hi > lo else lo + 1.0
    counts = long.withColumn("bin", bin_of(F.col(col), lo, hi, bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.select(*by).distinct() if by else long.sparkSession.range(1).select()
    full = with_bins(keys, bins).join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy())
    return full.select(*by, "bin", (F.col("n") / total).alias("density"))


def density_kurtosis(density: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kurtosis): Pearson's, of the bins' values; null where they are all equal."""
    return density.groupBy(*by).agg((F.kurtosis("density") + 3).alias("kurtosis"))


def joint_density(pairs: DataFrame, bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """(bx, by, density): counts over (rows x area of a bin), for bins that have rows."""
    lx, hx, ly, hy, n = pairs.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).first()
    if not n or hx <= lx or hy <= ly:
        raise ValueError("the pairs have no range")
    area = (hx - lx) / bins * (hy - ly) / bins
    counts = pairs.groupBy(bin_of(F.col(x), lx, hx, bins).alias("bx"), bin_of(F.col(y), ly, hy, bins).alias("by")).count()
    return counts.select("bx", "by", (F.col("count") / F.lit(n * area)).alias("density"))


def log_rescale(density: DataFrame, col: str = "density", out: str = "level") -> DataFrame:
    """log of nonzero values, rescaled to [0, 1] by their extremes; zeros stay 0. For tables of bins."""
    v = F.when(F.col(col) > 0, F.log(col))
    lo, hi = density.agg(F.min(v), F.max(v)).first()
    if lo is None or hi <= lo:
        return density.withColumn(out, F.when(F.col(col) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return density.withColumn(out, F.coalesce((v - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)))


def contour_levels(low: float, high: float, count: int, log_density: bool = False) -> list[float]:
    """Rising levels from low to high whose steps follow the root of geometric ones (of equal ones for log densities)."""
    if count < 2:
        raise ValueError("two levels at least")
    share = np.arange(count) / (count - 1)
    root = np.sqrt(1 + share) if log_density else 2.0 ** (share / 2)
    return (low + (high - low) * (root - root[0]) / (root[-1] - root[0])).tolist()


def rotational_average(image: DataFrame, bins: int, v: str = "v", h: str = "h", col: str = "x", by: list[str] | None = None, highest: float | None = None) -> DataFrame:
    """(by..., bin, left, mean) over rings of radius; corners beyond the largest coordinate are left out, empty rings null."""
    by = by or []
    top = highest if highest is not None else image.agg(F.greatest(F.max(F.abs(v)), F.max(F.abs(h)))).first()[0]
    radius = F.sqrt((F.col(v) * F.col(v) + F.col(h) * F.col(h)).cast("double"))
    rings = image.withColumn("bin", bin_of(radius, 0.0, float(top), bins)).filter("bin is not null")
    means = rings.groupBy(*by, "bin").agg(F.avg(col).alias("mean"))
    keys = image.select(*by).distinct() if by else image.sparkSession.range(1).select()
    return with_bins(keys, bins).join(means, [*by, "bin"], "left").select(*by, "bin", (F.col("bin") * F.lit(float(top) / bins)).alias("left"), "mean")


def adjacent_pairs(df: DataFrame, height: int, width: int, col: str = "x") -> DataFrame:
    """(id, x, y) of all pairs of 8-neighbours, in both directions, out of each image's own array."""
    moves = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    shifts = F.array(*(F.struct(F.lit(a).alias("dv"), F.lit(b).alias("dh")) for a, b in moves))

    def of(i):
        v, h = (i / width).cast("int"), i % width
        inside = lambda m: (v + m["dv"]).between(0, height - 1) & (h + m["dh"]).between(0, width - 1)
        pair = lambda m: F.struct(F.get(col, i).alias("x"), F.get(col, i + m["dv"] * width + m["dh"]).alias("y"))
        return F.transform(F.filter(shifts, inside), pair)

    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), of))
    return df.select("id", F.explode(pairs).alias("p")).select("id", "p.x", "p.y")


def safe_log10(df: DataFrame, col: str = "x", out: str = "log") -> DataFrame:
    """log10; zeros take the least of the logs."""
    v = F.when(F.col(col) > 0, F.log10(col))
    least = df.agg(F.min(v)).first()[0]
    return df.withColumn(out, F.when(F.col(col) == 0, F.lit(least).cast("double")).otherwise(v))


def display_range(df: DataFrame, col: str = "x", out: str = "shown") -> DataFrame:
    """Each row to [0, 1], and at_zero, at_half, at_one: the raw values shown as these.

    One sign: 0 is at its end of the range. Both signs: 0 is in the middle, the larger side reaches
    the end. A constant row is 0.5 throughout.
    """
    lo, hi = F.col("__lo"), F.col("__hi")
    most = F.greatest(-lo, hi)
    flat = lo == hi
    shown = F.transform(
        col, lambda v: F.when(flat, F.lit(0.5)).when(lo >= 0, v / hi).when(hi <= 0, v / -lo + 1).otherwise(v / (2 * most) + 0.5)
    )
    zero = F.when(flat, F.when(hi > 0, F.lit(0.0)).when(hi < 0, 2 * hi).otherwise(F.lit(-1.0))).when(lo >= 0, F.lit(0.0)).when(hi <= 0, lo).otherwise(-most)
    half = F.when(flat, hi).when(lo >= 0, hi / 2).when(hi <= 0, lo / 2).otherwise(F.lit(0.0))
    one = F.when(flat, F.when(hi > 0, 2 * hi).when(hi < 0, F.lit(0.0)).otherwise(F.lit(1.0))).when(lo >= 0, hi).when(hi <= 0, F.lit(0.0)).otherwise(most)
    ends = df.withColumns({"__lo": F.array_min(col), "__hi": F.array_max(col)})
    return ends.withColumns({out: shown, "at_zero": zero, "at_half": half, "at_one": one}).drop("__lo", "__hi")


def tile_layout(spark, count: int, height: int, width: int, margin: int = 2, order: list[int] | None = None) -> DataFrame:
    """(element, place, top, left) of elements in a near-square sheet, row by row, in the given order or their own."""
    columns = int(np.ceil(np.sqrt(count)))
    order = list(range(count)) if order is None else order
    rows = [(int(e), p, margin + (p // columns) * (height + margin), margin + (p % columns) * (width + margin)) for p, e in enumerate(order)]
    return spark.createDataFrame(rows, "element int, place int, top int, left int")


def grouped_layout(spark, groups: list[list[int]], height: int, width: int, margin: int = 2) -> DataFrame:
    """(element, group, top, left): a row of the sheet for each group."""
    rows = [(int(e), g, margin + g * (height + margin), margin + p * (width + margin)) for g, members in enumerate(groups) for p, e in enumerate(members)]
    return spark.createDataFrame(rows, "element int, group int, top int, left int")
