"""Patches of images: standardizing, tiling, assembling, padding, sampling, batching.

Images and patches are rows of an array in (v, h, c) order; in the long form a row is (id, v, h, x).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import literal, to_long


def standardize_range(df: DataFrame, col: str = "x") -> DataFrame:
    """(x - min) / (max - min) with the extremes of the whole dataset: one aggregation of two numbers."""
    lo, hi = df.agg(F.min(F.array_min(col)), F.max(F.array_max(col))).first()
    if lo is None or not hi > lo:
        raise ValueError("the data has no range")
    return df.withColumn(col, F.transform(col, lambda v: (v - F.lit(lo)) / F.lit(hi - lo)))


def exclude(df: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Rows but those of these ids: a list or a one-column DataFrame."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_anti")
    return df.filter(~F.col(id_col).isin(list(ids)) | F.col(id_col).isNull())


def as_image(df: DataFrame, width: int, channels: int = 1, col: str = "x") -> DataFrame:
    """Long form (id, v, h, x), or (id, v, h, c, x) with channels."""
    long = to_long(df, col)
    row = width * channels
    out = long.select(
        "id", (F.col("i") / row).cast("int").alias("v"), ((F.col("i") % row) / channels).cast("int").alias("h"), (F.col("i") % channels).alias("c"), "x"
    )
    return out if channels > 1 else out.drop("c")


def as_vectors(image: DataFrame, order: tuple[str, ...] = ("v", "h")) -> DataFrame:
    """Arrays in the order of these coordinates; ("c", "v", "h") is channel first."""
    pixels = F.array_sort(F.collect_list(F.struct(*order, "x")))
    return image.groupBy("id").agg(F.transform(pixels, lambda p: p["x"]).alias("x"))


def tile(image: DataFrame, height: int, width: int, tile_height: int, tile_width: int) -> DataFrame:
    """(id, tv, th, v, h, x): tiles side by side; what does not fill a tile at the right or bottom is left out."""
    rows, cols = height // tile_height * tile_height, width // tile_width * tile_width
    inside = image.filter((F.col("v") < rows) & (F.col("h") < cols))
    return inside.select(
        "id", (F.col("v") / tile_height).cast("int").alias("tv"), (F.col("h") / tile_width).cast("int").alias("th"),
        (F.col("v") % tile_height).alias("v"), (F.col("h") % tile_width).alias("h"), "x",
    )


def tile_arrays(df: DataFrame, height: int, width: int, tile_height: int, tile_width: int, cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """(id, tv, th, columns): the same tiles as arrays, cut out of each image's arrays without an exchange."""
    down, across = height // tile_height, width // tile_width

    def cut(c, tv, th):
        row = lambda r: F.slice(c, (tv * tile_height + r) * width + th * tile_width + 1, tile_width)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tile_height - 1)), row))

    def one(k):
        tv, th = (k / across).cast("int"), k % across
        return F.struct(tv.alias("tv"), th.alias("th"), *(cut(c, tv, th).alias(c) for c in cols))

    tiles = F.transform(F.sequence(F.lit(0), F.lit(down * across - 1)), one)
    return df.select("id", F.explode(tiles).alias("t")).select("id", "t.*")


def assemble(tiles: DataFrame, tile_height: int, tile_width: int) -> DataFrame:
    """(id, v, h, x) from tiles placed at (top, left); the image reaches to the last tile's end, uncovered places are 0.

    Columns of tiles: id, top, left, v, h, x. Where tiles overlap the one placed last in order (top, left) shows.
    """
    placed = tiles.select("id", (F.col("top") + F.col("v")).alias("v"), (F.col("left") + F.col("h")).alias("h"), "top", "left", "x")
    shown = placed.groupBy("id", "v", "h").agg(F.max_by("x", F.struct("top", "left")).alias("x"))
    size = tiles.groupBy("id").agg((F.max("top") + tile_height).alias("height"), (F.max("left") + tile_width).alias("width"))
    cells = size.select("id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("v"), "width")
    cells = cells.select("id", "v", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("h"))
    return cells.join(shown, ["id", "v", "h"], "left").select("id", "v", "h", F.coalesce("x", F.lit(0.0)).alias("x"))


def downsample(image: DataFrame, factor: int = 2) -> DataFrame:
    if not isinstance(factor, int) or factor < 1:
        raise ValueError("the factor is a positive integer")
    kept = image.filter((F.col("v") % factor == 0) & (F.col("h") % factor == 0))
    return kept.withColumns({"v": (F.col("v") / factor).cast("int"), "h": (F.col("h") / factor).cast("int")})


def pad(df: DataFrame, height: int, width: int, top: int, bottom: int, left: int, right: int, col: str = "x") -> DataFrame:
    """Zeros around each (height, width) patch, in the array itself."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    row = lambda r: F.concat(zeros(left), F.slice(col, r * width + 1, width), zeros(right))
    full = width + left + right
    body = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row))
    return df.withColumn(col, F.concat(zeros(top * full), body, zeros(bottom * full)))


def center_components(df: DataFrame, col: str = "x") -> tuple[DataFrame, list[float]]:
    """Each component less its mean over the dataset; also the means (one number a component)."""
    means = component_stats(df, col)[0]
    return df.withColumn(col, F.zip_with(col, literal(means), lambda a, b: a - b)), means


def normalize_variance(df: DataFrame, col: str = "x") -> tuple[DataFrame, list[float]]:
    """Each component over its population standard deviation, not centred; null where that is zero."""
    variances = component_stats(df, col)[1]
    scaled = F.zip_with(col, literal(variances), lambda a, b: F.when(b > 0, a / F.sqrt(b)))
    return df.withColumn(col, scaled), variances


def component_stats(df: DataFrame, col: str = "x") -> tuple[list[float], list[float]]:
    """Means and population variances of the components, in one aggregation with a map-side combine."""
    rows = df.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.avg("x"), F.var_pop("x")).collect()
    rows.sort()
    return [r[1] for r in rows], [r[2] for r in rows]


def center_samples(df: DataFrame, col: str = "x") -> DataFrame:
    """Each vector less its own mean."""
    mean = F.aggregate(col, F.lit(0.0), lambda a, v: a + v) / F.size(col)
    return df.withColumn("__mean", mean).withColumn(col, F.transform(col, lambda v: v - F.col("__mean"))).drop("__mean")


def numbered(df: DataFrame, bucket, order: tuple[str, ...], out: str = "number") -> DataFrame:
    """Add the rows' places, from 0, in the order of these columns.

    bucket is a column that never falls in that order and that depends on a row's values alone, so buckets are
    counted and rows are numbered inside them in plans of their own, whatever these plans' partitions are; one
    global window would put all rows into one task. Only the buckets' counts go to the driver.
    """
    rows = df.withColumn("__bucket", bucket)
    counts, before, total = sorted(tuple(r) for r in rows.groupBy("__bucket").count().collect()), [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "__bucket long, __before long")
    local = F.row_number().over(W.partitionBy("__bucket").orderBy(*order)) - 1
    placed = rows.withColumn("__local", local).join(F.broadcast(starts), "__bucket")
    return placed.withColumn(out, F.col("__before") + F.col("__local")).drop("__bucket", "__local", "__before")


#: Rows that a bucket of numbered rows has on average, and the most buckets there are.
BUCKET, BUCKETS = 1 << 16, 1 << 14


def sample_patches(images: DataFrame, n: int, height: int, width: int, patch: tuple[int, int], edge: int = 0, seed: int = 0, cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """n random patches: (patch_id, id, top, left, columns). images: distinct integer ids, x in (v, h) order.

    The image (by its place in the order of the ids) and the corner come from seeded hashes of the patch's number,
    uniform over the images and over corners edge <= corner < size - patch - edge.
    """
    k = images.count()
    down, across = height - patch[0] - 2 * edge, width - patch[1] - 2 * edge
    if k == 0 or down < 1 or across < 1:
        raise ValueError("no patch fits")

    def draw(what: str, m: int):
        digest = F.md5(F.concat_ws("-", F.lit(what), F.col("patch_id"), F.lit(seed)))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % m).cast("int")

    parts = min(BUCKETS, k // BUCKET)
    bounds = images.approxQuantile("id", [i / (parts + 1) for i in range(1, parts + 1)], 1 / (4 * parts)) if parts else []
    bucket = F.size(F.filter(literal(sorted(set(bounds))), lambda x: x <= F.col("id"))).cast("long") if bounds else F.lit(0).cast("long")
    held = numbered(images.select("id", *cols), bucket, ("id",), "__number")
    picks = images.sparkSession.range(n).withColumnRenamed("id", "patch_id")
    picks = picks.select("patch_id", draw("image", k).cast("long").alias("__number"), (draw("v", down) + edge).alias("top"), (draw("h", across) + edge).alias("left"))
    cut = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch[0] - 1)), lambda r: F.slice(c, (F.col("top") + r) * width + F.col("left") + 1, patch[1])))
    return picks.join(held, "__number").select("patch_id", "id", "top", "left", *(cut(c).alias(c) for c in cols))


def minibatches(df: DataFrame, batch_size: int, epoch: int = 0, id_col: str = "id") -> DataFrame:
    """Add batch_id: rows in the order of a hash of (id, epoch), cut into batches; the last may be short.

    The hash's first digits are the bucket (see ``numbered``), so buckets are about equally large.
    """
    key = F.md5(F.concat_ws("-", F.col(id_col), F.lit(epoch)))
    digits = next(d for d in range(1, 5) if 16**d * BUCKET > df.count() or 16 ** (d + 1) > BUCKETS)
    bucket = F.conv(F.substring("__key", 1, digits), 16, 10).cast("long")
    out = numbered(df.withColumn("__key", key), bucket, ("__key", id_col), "__number")
    return out.withColumn("batch_id", F.floor(F.col("__number") / batch_size)).drop("__key", "__number")


class Pipeline:
    """Ordered preprocessing of (id, x) images into patches, with the order checks made up front.

    On whole images: ("standardize",) first, ("filter", fn), ("whiten_center_surround", low, high),
    ("local_contrast", sigma) and ("local_luminance", sigma); what the last two divide or subtract by is cut at
    the same places and padded alike, as columns normalizer and subtractor. To cut: ("patch", n, (h, w), edge, seed) or
    ("tile", (h, w)). On patches: ("center_components",), ("normalize_variance",), ("center_samples",),
    ("whiten_zca",), ("pad", top, bottom, left, right).
    """

    BEFORE = {"standardize", "filter", "whiten_center_surround", "local_contrast", "local_luminance"}
    AFTER = {"center_components", "normalize_variance", "center_samples", "whiten_zca", "pad"}
    SIDES = {"local_contrast": "normalizer", "local_luminance": "subtractor"}

    def __init__(self, steps: list[tuple], height: int, width: int):
        cut = [i for i, s in enumerate(steps) if s[0] in ("patch", "tile")]
        if len(cut) > 1:
            raise ValueError("images are cut once")
        for i, (name, *_) in enumerate(steps):
            if name == "standardize" and i:
                raise ValueError("the range is standardized first, once")
            if name in self.BEFORE and cut and i > cut[0]:
                raise ValueError(f"{name} works on whole images")
            if name in self.AFTER and not (cut and i > cut[0]):
                raise ValueError(f"{name} works on patches")
            if name not in self.BEFORE | self.AFTER | {"patch", "tile"}:
                raise ValueError(f"no step {name}")
        self.steps, self.height, self.width = steps, height, width

    def run(self, images: DataFrame) -> tuple[DataFrame, dict]:
        """Patches and what the steps found (means, variances, zca)."""
        from . import whitening

        df, h, w, found, cols = images, self.height, self.width, {}, ("x",)
        for name, *args in self.steps:
            if name == "standardize":
                df = standardize_range(df)
            elif name == "filter":
                df = args[0](df)
            elif name == "whiten_center_surround":
                df = whitening.whiten_center_surround(df, h, w, *args, norm_and_threshold=False)
            elif name in self.SIDES:
                df = getattr(whitening, name)(df, h, w, *args)
                cols += (self.SIDES[name],)
            elif name == "patch":
                n, size, *rest = args
                df = sample_patches(df, n, h, w, size, *rest, cols=cols).select(F.col("patch_id").alias("id"), *cols)
                h, w = size
            elif name == "tile":
                per = (h // args[0][0]) * (w // args[0][1])
                number = F.col("id") * per + F.col("tv") * (w // args[0][1]) + F.col("th")
                df = tile_arrays(df, h, w, *args[0], cols=cols).select(number.alias("id"), *cols)
                h, w = args[0]
            elif name == "center_components":
                df, found["means"] = center_components(df)
            elif name == "normalize_variance":
                df, found["variances"] = normalize_variance(df)
            elif name == "center_samples":
                df = center_samples(df)
            elif name == "whiten_zca":
                found["zca"] = whitening.fit_zca(df)
                df = whitening.whiten_zca(df, found["zca"])
            else:
                for c in cols:
                    df = pad(df, h, w, *args, col=c)
                h, w = h + args[0] + args[1], w + args[2] + args[3]
        return df, found
