"""Queries over the tables, each with the SQL that says the same.

The 64 components of an embedding are an 8x8 patch, component i at (i div 8, i mod 8).
Results are long tables of integers, strings and numbers rounded to ``DIGITS``.
"""

from __future__ import annotations

import functools
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.transforms import dct, dct_frame, inverse_zigzag, unit_sphere_walk, zigzag_order
from ..functions.vectors import apply_rows, matrix_table, to_long, vectors
from ..operators import inference, jpeg, learning, metrics, patches, whitening
from ..sources import datasets

DIGITS = 6
SIDE = 8
N = SIDE * SIDE
#: Columns that are 64-bit integers in every result.
INDICES = {"i", "j", "k", "s", "v", "h", "tv", "th", "pos"}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def typed(spark, sf_dir):
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if c in INDICES and kind == "int"})

        QUERIES[fn.__name__] = typed
        if sql is not None:
            ORACLES[fn.__name__] = "WITH RECURSIVE " + BASE + sql
        return fn

    return register


def rounded(c, digits: int = DIGITS):
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def R(x: str, digits: int = DIGITS) -> str:
    return f"CASE WHEN abs({x}) < {0.5 * 10.0**-digits!r} THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


#: Tables that the SQL of many queries begins with.
BASE = """
vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
long AS (SELECT id, i, e[i + 1] AS x FROM vec, range(64) AS r(i)),
img AS (SELECT id, i // 8 AS v, i % 8 AS h, x FROM long),
dct AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 128.0) * sqrt(2 / 64.0) * CASE WHEN k = 0 THEN 1 / sqrt(2.0) ELSE 1.0 END AS w
        FROM range(64) AS a(k), range(64) AS b(i)),
frame AS (SELECT k AS s, i, w FROM dct UNION ALL
          SELECT 64 + a.j, b.i, CASE WHEN a.j = b.i THEN 1.0 ELSE 0.0 END FROM range(64) AS a(j), range(64) AS b(i)),
dct8 AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 16.0) * sqrt(2 / 8.0) * CASE WHEN k = 0 THEN 1 / sqrt(2.0) ELSE 1.0 END AS w
         FROM range(8) AS a(k), range(8) AS b(i)),
zig AS (SELECT row_number() OVER (ORDER BY v + h, CASE WHEN (v + h) % 2 = 0 THEN h ELSE v END) - 1 AS pos, v, h
        FROM range(8) AS a(v), range(8) AS b(h))
"""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedded(spark, sf_dir: str, scale: float = 1.0) -> DataFrame:
    return vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale)


def image(spark, sf_dir: str) -> DataFrame:
    return patches.as_image(embedded(spark, sf_dir), SIDE)


def long_codes(df: DataFrame, col: str, index: str, value: str) -> DataFrame:
    return df.select("id", F.posexplode(col).alias(index, "__v")).select("id", index, rounded("__v").alias(value))


def small(spark, m: np.ndarray, row: str, column: str, value: str) -> DataFrame:
    return matrix_table(spark, m, row, column, value).withColumn(value, rounded(value))


# patches


@query(f"SELECT id, i, {R('(x - lo) / (hi - lo)')} AS x FROM long, (SELECT min(x) AS lo, max(x) AS hi FROM long)")
def standardize_range(spark, sf_dir):
    return long_codes(patches.standardize_range(embedded(spark, sf_dir)), "x", "i", "x")


@query(f"SELECT id, i, {R('x - avg(x) OVER (PARTITION BY i)')} AS x FROM long")
def center_components(spark, sf_dir):
    return long_codes(patches.center_components(embedded(spark, sf_dir))[0], "x", "i", "x")


@query(f"SELECT id, i, {R('x - avg(x) OVER (PARTITION BY id)')} AS x FROM long")
def center_samples(spark, sf_dir):
    return long_codes(patches.center_samples(embedded(spark, sf_dir)), "x", "i", "x")


@query(f"SELECT id, i, {R('x / sqrt(var_pop(x) OVER (PARTITION BY i))')} AS x FROM long")
def normalize_variance(spark, sf_dir):
    return long_codes(patches.normalize_variance(embedded(spark, sf_dir))[0], "x", "i", "x")


@query("SELECT id, v // 4 AS tv, h // 4 AS th, v % 4 AS v, h % 4 AS h, x FROM img")
def tile_patches(spark, sf_dir):
    tiles = patches.tile_arrays(embedded(spark, sf_dir), SIDE, SIDE, 4, 4)
    cells = tiles.select("id", "tv", "th", F.posexplode("x").alias("i", "x"))
    return cells.select("id", "tv", "th", (F.col("i") / 4).cast("int").alias("v"), (F.col("i") % 4).alias("h"), "x")


@query("SELECT id, v, h, CASE WHEN v < 4 AND h >= 4 THEN 0.0 ELSE x END AS x FROM img")
def assemble_patches(spark, sf_dir):
    tiles = patches.tile(image(spark, sf_dir), SIDE, SIDE, 4, 4).filter("not (tv = 0 and th = 1)")
    placed = tiles.select("id", (F.col("tv") * 4).alias("top"), (F.col("th") * 4).alias("left"), "v", "h", "x")
    return patches.assemble(placed, 4, 4)


@query("SELECT id, v // 2 AS v, h // 2 AS h, x FROM img WHERE v % 2 = 0 AND h % 2 = 0")
def downsample(spark, sf_dir):
    return patches.downsample(image(spark, sf_dir), 2)


@query("SELECT id, v, h, coalesce(x, 0.0) AS x FROM (SELECT id, v, h FROM vec, range(11) AS a(v), range(9) AS b(h)) "
       "LEFT JOIN (SELECT id, v + 1 AS v, h AS h, x FROM img) USING (id, v, h)")
def pad_patches(spark, sf_dir):
    return patches.as_image(patches.pad(embedded(spark, sf_dir), SIDE, SIDE, 1, 2, 0, 1), SIDE + 1)


@query("SELECT id, (i % 2) * 32 + (i // 16) * 8 + (i % 16) // 2 AS i, x FROM long")
def channel_first(spark, sf_dir):
    # the patch as 4 x 8 with two channels
    return to_long(patches.as_vectors(patches.as_image(embedded(spark, sf_dir), 8, 2), ("c", "v", "h")))


@query("SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id NOT IN (SELECT n_nationkey FROM nation) GROUP BY label")
def exclude_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    kept = patches.exclude(df, table(spark, sf_dir, "nation").select("n_nationkey"))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT b AS batch_id, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM (SELECT c_custkey, "
       "(row_number() OVER (ORDER BY md5(c_custkey || '-1'), c_custkey) - 1) // 64 AS b FROM customer) GROUP BY b")
def minibatches(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return patches.minibatches(df, 64, epoch=1).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("keys"))


def _draw(what: str, m: str) -> str:
    return f"(('0x' || substr(md5('{what}-' || p || '-3'), 1, 13))::BIGINT % {m})"


@query(f"SELECT p AS patch_id, {_draw('image', 'n')} AS id, ({_draw('v', '2')} + 1)::INT AS top, ({_draw('h', '2')} + 1)::INT AS \"left\" "
       "FROM range(2000) AS r(p), (SELECT count(*) AS n FROM vec)")
def sample_patches(spark, sf_dir):
    dense = embedded(spark, sf_dir)
    return patches.sample_patches(dense, 2000, SIDE, SIDE, (4, 4), edge=1, seed=3).select("patch_id", "id", "top", "left")


@query("SELECT id * 4 + (v // 4) * 2 + h // 4 AS id, (v % 4) * 4 + h % 4 AS i, "
       + R("y - avg(y) OVER (PARTITION BY id, v // 4, h // 4)")
       + " AS x FROM (SELECT *, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS y FROM img)")
def preprocess_patches(spark, sf_dir):
    steps = [("standardize",), ("tile", (4, 4)), ("center_samples",)]
    return long_codes(patches.Pipeline(steps, SIDE, SIDE).run(embedded(spark, sf_dir))[0], "x", "i", "x")


# filters


@query(f"SELECT v, h, {R('g / sum(g) OVER ()')} AS g FROM (SELECT v, h, exp(-0.5 * ((v - 4) * (v - 4) + (h - 3) * (h - 3)) / (1.5 * 1.5)) AS g "
       "FROM range(9) AS a(v), range(6) AS b(h))")
def gaussian_filter(spark, sf_dir):
    return filters.gaussian_grid(spark, 1.5, 9, 6).withColumn("g", rounded("g"))


@query("SELECT v, h, (([1, 4, 6, 4, 1])[v + 1] * ([1, 2, 1])[h + 1] / 64.0)::DOUBLE AS g FROM range(5) AS a(v), range(3) AS b(h)")
def binomial_filter(spark, sf_dir):
    return filters.binomial_grid(spark, 5, 3)


@query("SELECT v, h, " + R("exp(-pow(sqrt(pow((CASE WHEN v < 8 THEN v ELSE v - 16 END) / 16.0, 2) + pow((CASE WHEN h < 6 THEN h ELSE h - 11 END) / 11.0, 2)) / 0.45, 8))")
       + " AS g FROM range(16) AS a(v), range(11) AS b(h)")
def low_pass_grid(spark, sf_dir):
    return filters.low_pass_grid(spark, 16, 11, 0.9, 8.0).withColumn("g", rounded("g"))


@query("SELECT v, h, " + R("greatest(f / max(f) OVER (), 1e-5)") + " AS g FROM (SELECT v, h, sqrt(pow((CASE WHEN v < 4 THEN v ELSE v - 8 END) / 8.0, 2) + "
       "pow((CASE WHEN h < 4 THEN h ELSE h - 8 END) / 8.0, 2)) AS f FROM range(8) AS a(v), range(8) AS b(h))")
def whitening_ramp(spark, sf_dir):
    return small(spark, filters.whitening_ramp((8, 8)), "v", "h", "g")


_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"
_GAUSS5 = "g5 AS (SELECT a, b, exp(-0.5 * (a * a + b * b)) AS g FROM range(-2, 3) AS p(a), range(-2, 3) AS q(b)), g5n AS (SELECT a, b, g / sum(g) OVER () AS g FROM g5)"


def _local(value: str) -> str:
    """Gaussian-weighted mean of an expression of pixel p around each pixel c."""
    return (f"loc AS (SELECT c.id, c.v, c.h, any_value(c.x) AS x, sum(g * {value}) AS m FROM img c, g5n JOIN img p ON p.id = c.id AND p.v = {_MIRROR.format('c.v - a')} "
            f"AND p.h = {_MIRROR.format('c.h - b')} GROUP BY c.id, c.v, c.h)")


@query(f", {_GAUSS5}, {_local('p.x')} SELECT id, v, h, {R('x - m')} AS x, {R('m')} AS subtractor FROM loc")
def local_luminance(spark, sf_dir):
    return _two_images(whitening.local_luminance(embedded(spark, sf_dir), SIDE, SIDE, 1), "subtractor")


@query(f", {_GAUSS5}, {_local('p.x * p.x')} SELECT id, v, h, {R('x / sqrt(CASE WHEN m = 0 THEN 1 ELSE m END)')} AS x, {R('sqrt(CASE WHEN m = 0 THEN 1 ELSE m END)')} AS normalizer FROM loc")
def local_contrast(spark, sf_dir):
    return _two_images(whitening.local_contrast(embedded(spark, sf_dir), SIDE, SIDE, 1), "normalizer")


def _two_images(df, second):
    both = df.select("id", F.posexplode(F.arrays_zip("x", second)).alias("i", "p"))
    return both.select("id", (F.col("i") / SIDE).cast("int").alias("v"), (F.col("i") % SIDE).alias("h"), rounded("p.x").alias("x"), rounded(f"p.{second}").alias(second))


@query(", bin3 AS (SELECT a, b, ([1, 2, 1])[a + 2] * ([1, 2, 1])[b + 2] / 16.0 AS g FROM range(-1, 2) AS p(a), range(-1, 2) AS q(b)) "
       f"SELECT c.id, c.v, c.h, {R('sum(g * p.x)')} AS x FROM img c, bin3 JOIN img p ON p.id = c.id AND p.v = {_MIRROR.format('c.v - a')} "
       f"AND p.h = {_MIRROR.format('c.h - b')} GROUP BY c.id, c.v, c.h")
def filter_images(spark, sf_dir):
    out = patches.as_image(whitening.filter_images(embedded(spark, sf_dir), SIDE, SIDE, filters.binomial_2d(3, 3)), SIDE)
    return out.withColumn("x", rounded("x"))


_GRID = "grid AS (SELECT a.v, b.h FROM range(8) AS a(v), range(8) AS b(h))"


@query(f""", {_GRID}, fq AS (SELECT v, h, sqrt(pow((CASE WHEN v < 4 THEN v ELSE v - 8 END) / 8.0, 2) + pow((CASE WHEN h < 4 THEN h ELSE h - 8 END) / 8.0, 2)) AS f FROM grid),
gain AS (SELECT v, h, greatest(f, 1e-3) * exp(-pow(f / 0.45, 8)) AS g FROM fq), norm AS (SELECT v, h, greatest(g / max(g) OVER (), 1e-3) AS g FROM gain),
ker AS (SELECT p.v, p.h, sum(g * cos(2 * pi() * (p.v * q.v + p.h * q.h) / 8.0)) / 64 AS k FROM grid p, norm q GROUP BY p.v, p.h)
SELECT id, grid.v * 8 + grid.h AS i, {R('sum(k * x)')} AS x FROM grid, img JOIN ker ON ker.v = (grid.v - img.v + 8) % 8 AND ker.h = (grid.h - img.h + 8) % 8 GROUP BY id, grid.v, grid.h""")
def whiten_center_surround(spark, sf_dir):
    return long_codes(whitening.whiten_center_surround(embedded(spark, sf_dir), SIDE, SIDE), "x", "i", "x")


@query(f"SELECT a.i, b.i AS j, {R('avg(a.x * b.x) - avg(a.x) * avg(b.x)')} AS c FROM long a JOIN long b USING (id) GROUP BY a.i, b.i")
def covariance(spark, sf_dir):
    return small(spark, whitening.covariance(embedded(spark, sf_dir))[0], "i", "j", "c")


def _quarters(spark, sf_dir):
    """Four 4x4 tiles of each embedding: enough rows for a ZCA fit of 16 components."""
    tiles = patches.tile_arrays(embedded(spark, sf_dir), SIDE, SIDE, 4, 4)
    return tiles.select((F.col("id") * 4 + F.col("tv") * 2 + F.col("th")).alias("id"), "x")


_MM = lambda a, b: (f"list_transform(range(256), lambda k: list_sum(list_transform(range(16), lambda m: {a}[k // 16 * 16 + m + 1] * {b}[m * 16 + k % 16 + 1])))")
_EYE = lambda d: f"CASE WHEN k // 16 = k % 16 THEN {d}::DOUBLE ELSE 0.0::DOUBLE END"
_QUARTERS = (", qt AS (SELECT id * 4 + (v // 4) * 2 + h // 4 AS id, (v % 4) * 4 + h % 4 AS i, x FROM img), mu AS (SELECT i, avg(x) AS m FROM qt GROUP BY i), "
             "qc AS (SELECT a.i, b.i AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS c FROM qt a JOIN qt b USING (id) GROUP BY a.i, b.i), "
             "cm AS (SELECT list(c ORDER BY i, j) AS c, sum(c) FILTER (WHERE i = j) AS t FROM qc) ")


@query(_QUARTERS + f""", root AS (
  SELECT 0 AS n, t, list_transform(c, lambda v: v / t) AS y, list_transform(range(256), lambda k: {_EYE('1.0')}) AS z FROM cm
  UNION ALL
  SELECT n + 1, t, {_MM('y', 's')}, {_MM('s', 'z')}
  FROM (SELECT n, t, y, z, list_transform(range(256), lambda k: ({_EYE('3.0')} - zy[k + 1]) / 2) AS s FROM (SELECT *, {_MM('z', 'y')} AS zy FROM root WHERE n < 40))),
b AS (SELECT list_transform(range(256), lambda k: sqrt(t) * y[k + 1] + {_EYE('1e-4')}) AS b FROM root WHERE n = 40),
inv AS (
  SELECT 0 AS n, b, list_transform(b, lambda v: v / list_sum(list_transform(b, lambda u: u * u))) AS x FROM b
  UNION ALL
  SELECT n + 1, b, {_MM('x', 'r')} FROM (SELECT n, b, x, list_transform(range(256), lambda k: {_EYE('2.0')} - bx[k + 1]) AS r FROM (SELECT *, {_MM('b', 'x')} AS bx FROM inv WHERE n < 80))),
w AS (SELECT k // 16 AS i, k % 16 AS j, x[k + 1] AS w FROM inv, range(256) AS r(k) WHERE n = 80)
SELECT id, j AS i, {R('sum((x - m) * w) + (SELECT avg(m) FROM mu)')} AS x FROM qt JOIN mu USING (i) JOIN w USING (i) GROUP BY id, j""")
def zca_whiten(spark, sf_dir):
    """The SQL finds the root of the covariance, then the inverse, by Newton's method."""
    df = _quarters(spark, sf_dir)
    return long_codes(whitening.whiten_zca(df, whitening.fit_zca(df)), "x", "i", "x")


@query(f"SELECT id * 4 + (v // 4) * 2 + h // 4 AS id, (v % 4) * 4 + h % 4 AS i, {R('x')} AS x FROM img")
def zca_round_trip(spark, sf_dir):
    df = _quarters(spark, sf_dir)
    model = whitening.fit_zca(df)
    return long_codes(whitening.unwhiten_zca(whitening.whiten_zca(df, model), model), "x", "i", "x")


@query(_QUARTERS + f", c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM qc a JOIN qc b ON a.j = b.i GROUP BY a.i, b.j) "
       f"SELECT 1 AS power, {R('sum(c)')} AS total FROM qc WHERE i = j UNION ALL SELECT 2, {R('sum(c)')} FROM c2 WHERE i = j "
       f"UNION ALL SELECT 3, {R('sum(a.c * b.c)')} FROM c2 a JOIN qc b ON a.i = b.j AND a.j = b.i UNION ALL SELECT 4, {R('sum(c * c)')} FROM c2 UNION ALL SELECT 0, 0.0::DOUBLE")
def pca_variances(spark, sf_dir):
    """Sums of powers of the variances (traces of powers of the covariance); 0: how far components are from eigenvectors."""
    df = patches.center_components(_quarters(spark, sf_dir))[0]
    basis, variances = learning.train_pca(df)
    rest = np.abs(whitening.covariance(df)[0] @ basis.T - basis.T * variances).max()
    rows = [(0, float(rest))] + [(p, float((variances**p).sum())) for p in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "power int, total double").withColumn("total", rounded("total"))


@query(f""", {_GRID}, ker AS (SELECT p.v, p.h, sum(cos(2 * pi() * (p.v * q.v + p.h * q.h) / 8.0) / greatest(q.f, 0.05)) / 64 AS k FROM grid p,
(SELECT v, h, sqrt(pow((CASE WHEN v < 4 THEN v ELSE v - 8 END) / 8.0, 2) + pow((CASE WHEN h < 4 THEN h ELSE h - 8 END) / 8.0, 2)) AS f FROM grid) q GROUP BY p.v, p.h)
SELECT id, grid.v * 8 + grid.h AS i, {R('sum(k * x)')} AS x FROM grid, img JOIN ker ON ker.v = (grid.v - img.v + 8) % 8 AND ker.h = (grid.h - img.h + 8) % 8 GROUP BY id, grid.v, grid.h""")
def unwhiten_center_surround(spark, sf_dir):
    return long_codes(whitening.unwhiten_center_surround(embedded(spark, sf_dir), SIDE, SIDE, low=0.05), "x", "i", "x")


@query("SELECT v, h, " + R("greatest(exp(-pow(sqrt(pow((CASE WHEN v < 4 THEN v ELSE v - 8 END) / 8.0, 2) + pow((CASE WHEN h < 4 THEN h ELSE h - 8 END) / 8.0, 2)) / 0.2, 8)), 1e-3)")
       + " AS g FROM range(8) AS a(v), range(8) AS b(h)")
def low_pass_floor(spark, sf_dir):
    return small(spark, filters.low_pass((SIDE, SIDE), 0.4), "v", "h", "g")


@query(ORACLES["filter_images"].removeprefix("WITH RECURSIVE " + BASE))
def filter_separable(spark, sf_dir):
    line = filters.binomial_1d(3)
    out = whitening.per_image(embedded(spark, sf_dir), SIDE, SIDE, lambda i: filters.filter_separable(i, line, line))
    return patches.as_image(out, SIDE).withColumn("x", rounded("x"))


# inference

_FRAME_STEP = 0.5  # the frame is tight: D^T D = 2 I
_WEIGHT, _STEPS = 0.1, 5

_LISTS = """, rws AS (SELECT list(r ORDER BY s) AS rws FROM (SELECT s, list(w ORDER BY i) AS r FROM frame GROUP BY s)),
cls AS (SELECT list(r ORDER BY i) AS cls FROM (SELECT i, list(w ORDER BY s) AS r FROM frame GROUP BY i)), """


def _ista_sql(codes: str, more: str = "", start: str = "list_transform(range(128), lambda j: 0.0::DOUBLE)") -> str:
    """Steps from zero or other codes; codes makes the next ones from the list zz that a gradient step gives."""
    return _LISTS + f"""
it AS (
  SELECT id, e, 0 AS k, {start} AS c FROM vec
  UNION ALL
  SELECT id, e, k + 1, {codes}
  FROM (SELECT *{more} FROM (
    SELECT *, list_transform(range(128), lambda j: c[j + 1] - 0.5 * list_dot_product(res, rws[j + 1])) AS zz
    FROM (SELECT id, e, k, c, rws, list_transform(range(64), lambda i: list_dot_product(c, cls[i + 1]) - e[i + 1]) AS res FROM it, rws, cls WHERE k < {_STEPS}))))
SELECT id, s, {R('c[s + 1]')} AS code FROM it, range(128) AS r(s) WHERE k = {_STEPS}"""


def _shrunk(z: str) -> str:
    return f"list_transform(zz, lambda z: {z})"


_SOFT = "CASE WHEN abs(z) > 0.05 THEN sign(z) * (abs(z) - 0.05) ELSE 0.0 END"


def _coded(spark, sf_dir, **options):
    return inference.infer(embedded(spark, sf_dir), dct_frame(N), _WEIGHT, _STEPS, **options)


@query(_ista_sql(_shrunk(_SOFT)))
def ista_codes(spark, sf_dir):
    return long_codes(_coded(spark, sf_dir), "code", "s", "code")


@query(_ista_sql(_shrunk(_SOFT), start="list_concat(e, e)"))
def warm_start_codes(spark, sf_dir):
    df = embedded(spark, sf_dir).withColumn("start", F.concat("x", "x"))
    return long_codes(inference.infer(df, dct_frame(N), _WEIGHT, _STEPS, start_col="start"), "code", "s", "code")


@query(_ista_sql(_shrunk("greatest(z - 0.05, 0.0)")))
def nonneg_ista_codes(spark, sf_dir):
    return long_codes(_coded(spark, sf_dir, nonnegative=True), "code", "s", "code")


@query(_ista_sql(_shrunk("CASE WHEN abs(z) < 0.05 THEN 0.0 ELSE z END")))
def hard_ista_codes(spark, sf_dir):
    return long_codes(_coded(spark, sf_dir, hard=True), "code", "s", "code")


@query(_LISTS + f"""
it AS (
  SELECT id, e, 0 AS k, 1.0::DOUBLE AS t, list_transform(range(128), lambda j: 0.0::DOUBLE) AS c, list_transform(range(128), lambda j: 0.0::DOUBLE) AS y FROM vec
  UNION ALL
  SELECT id, e, k + 1, t2, n, list_transform(range(128), lambda j: n[j + 1] + (t - 1) / t2 * (n[j + 1] - c[j + 1]))
  FROM (SELECT *, (1 + sqrt(1 + 4 * t * t)) / 2 AS t2,
          list_transform(list_transform(range(128), lambda j: y[j + 1] - 0.5 * list_dot_product(res, rws[j + 1])), lambda z: {_SOFT}) AS n
        FROM (SELECT *, list_transform(range(64), lambda i: list_dot_product(y, cls[i + 1]) - e[i + 1]) AS res FROM it, rws, cls WHERE k < {_STEPS})))
SELECT id, s, {R('c[s + 1]')} AS code FROM it, range(128) AS r(s) WHERE k = {_STEPS}""")
def fista_codes(spark, sf_dir):
    return long_codes(_coded(spark, sf_dir, variant="fista"), "code", "s", "code")


_MOST, _EPSILON = 40, 0.004


@query(_LISTS + f"""
it AS (
  SELECT id, e, 0 AS k, list_transform(range(128), lambda j: 0.0::DOUBLE) AS c, 0.0::DOUBLE AS d FROM vec
  UNION ALL
  SELECT id, e, k + 1, n, list_sum(list_transform(range(128), lambda j: abs(n[j + 1] - c[j + 1])))
  FROM (SELECT *, list_transform(list_transform(range(128), lambda j: c[j + 1] - 0.5 * list_dot_product(res, rws[j + 1])), lambda z: {_SOFT}) AS n
        FROM (SELECT id, e, k, c, rws, list_transform(range(64), lambda i: list_dot_product(c, cls[i + 1]) - e[i + 1]) AS res FROM it, rws, cls WHERE k < {_MOST}))),
stop AS (SELECT b, min(k) AS k FROM (SELECT id % 8 AS b, k, avg(d) / 128 / 0.5 AS m FROM it WHERE k > 1 GROUP BY ALL) WHERE m < {_EPSILON} OR k = {_MOST} GROUP BY b)
SELECT id, s, {R('c[s + 1]')} AS code FROM it JOIN stop ON id % 8 = b AND it.k = stop.k, range(128) AS r(s)""")
def early_stopping_codes(spark, sf_dir):
    df = embedded(spark, sf_dir).withColumn("batch_id", F.col("id") % 8)
    coded = inference.infer(df, dct_frame(N), _WEIGHT, _MOST, epsilon=_EPSILON, batch_col="batch_id")
    return long_codes(coded, "code", "s", "code")


@query(_ista_sql("list_transform(range(128), lambda j: zz[j + 1] * greatest(1 - 0.05 / CASE WHEN nn[j % 64 + 1] = 0 THEN 1 ELSE nn[j % 64 + 1] END, 0))",
                 ", list_transform(range(64), lambda j: sqrt(zz[j + 1] * zz[j + 1] + zz[j + 65] * zz[j + 65])) AS nn"))
def subspace_pair_codes(spark, sf_dir):
    """Groups of a cosine and a pixel each: without overlap the frame stays tight."""
    pairs = [[k, k + N] for k in range(N)]
    return long_codes(inference.infer(embedded(spark, sf_dir), dct_frame(N), _WEIGHT, _STEPS, groups=pairs), "code", "s", "code")


@query(""", rws AS (SELECT list(r ORDER BY s) AS rws FROM (SELECT s, list(w ORDER BY i) AS r FROM (FROM frame UNION ALL SELECT 128 + s, i, w FROM frame WHERE s < 3) GROUP BY s)),
cls AS (SELECT list(r ORDER BY i) AS cls FROM (SELECT i, list(w ORDER BY s) AS r FROM (FROM frame UNION ALL SELECT 128 + s, i, w FROM frame WHERE s < 3) GROUP BY i)), """ + f"""
it AS (
  SELECT id, e, 0 AS k, list_transform(range(131), lambda j: 0.0::DOUBLE) AS c FROM vec
  UNION ALL
  SELECT id, e, k + 1, list_transform(range(131), lambda j: zz[j + 1] * greatest(1 - 0.1 / 3 / CASE WHEN nn[CASE WHEN j < 128 THEN j % 64 + 1 ELSE 65 END] = 0 THEN 1
      ELSE nn[CASE WHEN j < 128 THEN j % 64 + 1 ELSE 65 END] END, 0))
  FROM (SELECT *, list_transform(range(65), lambda j: CASE WHEN j < 64 THEN sqrt(zz[j + 1] * zz[j + 1] + zz[j + 65] * zz[j + 65])
                                                   ELSE sqrt(zz[129] * zz[129] + zz[130] * zz[130] + zz[131] * zz[131]) END) AS nn
    FROM (SELECT *, list_transform(range(131), lambda j: c[j + 1] - list_dot_product(res, rws[j + 1]) / 3) AS zz
      FROM (SELECT id, e, k, c, rws, list_transform(range(64), lambda i: list_dot_product(c, cls[i + 1]) - e[i + 1]) AS res FROM it, rws, cls WHERE k < {_STEPS}))))
SELECT id, s, {R('c[s + 1] + CASE WHEN s < 3 THEN c[s + 129] ELSE 0.0 END')} AS code FROM it, range(128) AS r(s) WHERE k = {_STEPS}""")
def subspace_codes(spark, sf_dir):
    """Three elements are in two groups each: their copies make the largest eigenvalue 3."""
    groups = [[k, k + N] for k in range(N)] + [[0, 1, 2]]
    return long_codes(inference.infer(embedded(spark, sf_dir), dct_frame(N), _WEIGHT, _STEPS, groups=groups), "code", "s", "code")


_HAAR = (", haar AS (SELECT s, a, b, CASE WHEN s = 0 OR (s = 1 AND a = 0) OR (s = 2 AND b = 0) OR (s = 3 AND a = b) THEN 0.5 ELSE -0.5 END AS w "
         "FROM range(4) AS p(s), range(2) AS q(a), range(2) AS r(b)) ")


def _soft(z: str, t: float = 0.05) -> str:
    return f"CASE WHEN abs({z}) > {t} THEN sign({z}) * (abs({z}) - {t}) ELSE 0.0 END"


def haar_kernels() -> np.ndarray:
    return 0.5 * np.array([[[1, 1], [1, 1]], [[1, 1], [-1, -1]], [[1, -1], [1, -1]], [[1, -1], [-1, 1]]])[:, None]


@query(_HAAR + ", z AS (SELECT id, s * 16 + (v // 2) * 4 + h // 2 AS s, sum(x * w) AS z FROM img JOIN haar ON a = v % 2 AND b = h % 2 GROUP BY ALL) "
       f"SELECT id, s, {R(_soft('z'))} AS code FROM z")
def conv_haar_codes(spark, sf_dir):
    """Orthonormal kernels side by side: the iterations stay where the first one goes."""
    return long_codes(inference.infer_conv(embedded(spark, sf_dir), haar_kernels(), (1, SIDE, SIDE), (2, 2), 0.05, 3, variant="fista"), "code", "s", "code")


#: Kernels that overlap, at every place of an image padded by one: codes c of one step, residual r inside the padding, gradient g.
_CONV = (_HAAR + ", px AS (SELECT id, v + 1 AS v, h + 1 AS h, x FROM img), "
         f"c1 AS (SELECT id, s, p, q, {_soft('z')} AS c FROM (SELECT id, s, v - a AS p, h - b AS q, sum(w * x) AS z FROM px, haar GROUP BY ALL)), "
         "syn AS (SELECT id, p + a AS v, q + b AS h, sum(c * w) AS y FROM c1 JOIN haar USING (s) GROUP BY ALL), "
         "res AS (SELECT id, v, h, y - x AS r FROM px JOIN syn USING (id, v, h)), "
         "gr AS (SELECT id, s, v - a AS p, h - b AS q, sum(r * w) AS g FROM res, haar GROUP BY ALL) ")
_PADDED = ((1, 1), (1, 1))


@query(_CONV + f"SELECT id, s * 81 + p * 9 + q AS s, {R(_soft('(c - g)'))} AS code FROM c1 JOIN gr USING (id, s, p, q)")
def conv_codes(spark, sf_dir):
    coded = inference.infer_conv(embedded(spark, sf_dir), haar_kernels(), (1, SIDE, SIDE), (1, 1), 0.05, 2, _PADDED)
    return long_codes(coded, "code", "s", "code")


@query(_CONV + f"SELECT id, (v - 1) * 8 + h - 1 AS i, {R('y')} AS x FROM syn JOIN px USING (id, v, h)")
def conv_synthesis(spark, sf_dir):
    coded = inference.infer_conv(embedded(spark, sf_dir), haar_kernels(), (1, SIDE, SIDE), (1, 1), 0.05, 1, _PADDED)
    back = inference.synthesize_conv(coded, haar_kernels(), (4, 9, 9), (1, 1), (10, 10), _PADDED)
    return long_codes(back, "recon", "i", "x")


@query(f"SELECT id, k, {R('sum(x * w)')} AS code FROM long JOIN dct USING (i) GROUP BY id, k")
def dct_codes(spark, sf_dir):
    return long_codes(inference.linear_codes(embedded(spark, sf_dir), dct(N), True), "code", "k", "code")


@query(f"SELECT id, k, {R('sum(x * w) / (1 + k / 64.0)')} AS code FROM long JOIN dct USING (i) GROUP BY id, k")
def inverse_codes(spark, sf_dir):
    scaled = dct(N) * (1 + np.arange(N) / N)[:, None]
    return long_codes(inference.linear_codes(embedded(spark, sf_dir), scaled), "code", "k", "code")


@query(f"SELECT id, i, {R('CASE WHEN abs(x) > 0.1 THEN sign(x) * (abs(x) - 0.1) ELSE 0.0 END')} AS soft, {R('greatest(x - 0.1, 0.0)')} AS nonneg, "
       f"{R('CASE WHEN abs(x) < 0.1 THEN 0.0 ELSE x END')} AS hard, {R('CASE WHEN x < 0.1 THEN 0.0 ELSE x END')} AS nonneg_hard FROM long")
def thresholds(spark, sf_dir):
    kinds = {"soft": (False, False), "nonneg": (True, False), "hard": (False, True), "nonneg_hard": (True, True)}
    shrunk = apply_rows(embedded(spark, sf_dir), ["x"], list(kinds), lambda x: tuple(inference.threshold(x, 0.1, *k) for k in kinds.values()))
    cells = shrunk.select("id", F.posexplode(F.arrays_zip(*kinds)).alias("i", "c"))
    return cells.select("id", "i", *(rounded(f"c.{k}").alias(k) for k in kinds))


@query(f"SELECT id, i, {R('x * greatest(1 - 0.2 / CASE WHEN n = 0 THEN 1 ELSE n END, 0)')} AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id, i // 4)) AS n FROM long)")
def group_threshold(spark, sf_dir):
    fn = lambda x: inference.group_shrink(x.reshape(len(x), 16, 4), 0.2).reshape(x.shape)
    return long_codes(apply_rows(embedded(spark, sf_dir), ["x"], ["x"], fn), "x", "i", "x")


@query("SELECT image, kernel, stride, (kernel - stride)::INT AS lead, (kernel - stride + CASE WHEN image % stride > 0 THEN stride - image % stride ELSE 0 END)::INT AS trail, "
       "(1 + ceil((image + 2 * (kernel - stride) + CASE WHEN image % stride > 0 THEN stride - image % stride ELSE 0 END - kernel) / stride::DOUBLE))::INT AS code "
       "FROM (SELECT p_size::INT AS image, k::INT AS kernel, s::INT AS stride FROM (SELECT DISTINCT p_size FROM part WHERE p_size >= 8), (VALUES (8, 4), (6, 3), (5, 2)) AS v(k, s))")
def padding_dims(spark, sf_dir):
    sizes = [r[0] for r in table(spark, sf_dir, "part").filter("p_size >= 8").select("p_size").distinct().collect()]
    rows = []
    for n in sizes:
        for k, s in ((8, 4), (6, 3), (5, 2)):
            lead, trail = inference.padding_amount(n, k, s)
            rows.append((n, k, s, lead, trail, inference.code_size(n + lead + trail, k, s)))
    return spark.createDataFrame(rows, "image int, kernel int, stride int, lead int, trail int, code int")


@query("SELECT v, h, CASE WHEN v < 2 OR v >= 9 OR h < 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS inside FROM range(10) AS a(v), range(9) AS b(h)")
def padding_mask(spark, sf_dir):
    return small(spark, inference.mask_of(10, 9, ((2, 1), (1, 0))), "v", "h", "inside")


# learning

_CODES = ", one AS (SELECT id, s, CASE WHEN abs(z) > 0.05 THEN sign(z) * (abs(z) - 0.05) ELSE 0.0 END AS c FROM (SELECT id, s, 0.5 * sum(x * w) AS z FROM long JOIN frame USING (i) GROUP BY id, s)), nn AS (SELECT count(*) AS n FROM vec), "
_GRADIENT = ("cc AS (SELECT a.s, b.s AS t, sum(a.c * b.c) AS v FROM one a JOIN one b USING (id) GROUP BY a.s, b.s), "
             "cx AS (SELECT s, i, sum(c * x) AS v FROM one JOIN long USING (id) GROUP BY s, i), "
             "grad AS (SELECT cx.s, cx.i, (q.v - cx.v) / n AS g FROM cx JOIN (SELECT cc.s, i, sum(cc.v * w) AS v FROM cc JOIN frame ON cc.t = frame.s GROUP BY cc.s, i) q "
             "ON q.s = cx.s AND q.i = cx.i, nn), ")


def _one_step_stats(spark, sf_dir):
    return learning.code_stats(inference.infer(embedded(spark, sf_dir), dct_frame(N), _WEIGHT, 1, step=_FRAME_STEP))


@query(_CODES + _GRADIENT + f"d AS (SELECT s, i, w - 2.0 * g AS v FROM grad JOIN frame USING (s, i)) SELECT s, i, {R('v / sqrt(sum(v * v) OVER (PARTITION BY s))')} AS value FROM d")
def sc_gradient_step(spark, sf_dir):
    return small(spark, learning.steepest(dct_frame(N), _one_step_stats(spark, sf_dir), 2.0), "s", "i", "value")


@query(_CODES + _GRADIENT + "hes AS (SELECT s, avg(c * c) / 100 AS e FROM one GROUP BY s), d AS (SELECT s, i, w - 0.01 * g / (e + 0.001) AS v FROM grad JOIN frame USING (s, i) JOIN hes USING (s)) "
       f"SELECT s, i, {R('v / sqrt(sum(v * v) OVER (PARTITION BY s))')} AS value FROM d")
def cheap_quadratic_step(spark, sf_dir):
    stats = _one_step_stats(spark, sf_dir)
    hessian = learning.hessian_update(np.zeros(2 * N), stats.energy)
    return small(spark, learning.cheap_quadratic(dct_frame(N), stats, hessian, 0.01), "s", "i", "value")


@query(_CODES + f"hes AS (SELECT s, avg(c * c) AS e FROM one GROUP BY s) SELECT s, {R('0.99 * 0.5 + e / 100', 8)} AS hessian FROM hes")
def hessian_ema(spark, sf_dir):
    h = learning.hessian_update(np.full(2 * N, 0.5), _one_step_stats(spark, sf_dir).energy)
    return matrix_table(spark, h[:, None], "s", "one", "hessian").select(F.col("s").cast("long").alias("s"), rounded("hessian", 8).alias("hessian"))


@query(", c AS (SELECT id, k, sum(x * w) AS c FROM long JOIN dct USING (i) GROUP BY id, k), "
       "cs AS (SELECT a.k, b.k AS l, sum(a.c * sign(b.c)) / (SELECT count(*) FROM vec) - CASE WHEN a.k = b.k THEN 1.0 ELSE 0.0 END AS v FROM c a JOIN c b USING (id) GROUP BY a.k, b.k) "
       f"SELECT s, i, {R('d.w + 0.1 * u.v')} AS value FROM (SELECT cs.k AS s, i, sum(v * w) AS v FROM cs JOIN dct ON cs.l = dct.k GROUP BY cs.k, i) u JOIN (SELECT k AS s, i, w FROM dct) d USING (s, i)")
def ica_step(spark, sf_dir):
    df = embedded(spark, sf_dir)
    return small(spark, learning.train_ica(lambda t: df, 1, dct(N), 0.1), "s", "i", "value")


def _subspace_sql(divide: str) -> str:
    """Groups of a cosine and a pixel; of each pair, the other one's direction less one's own share of it."""
    return (_CODES + _GRADIENT + "hes AS (SELECT s, avg(c * c) / 100 AS e FROM one GROUP BY s), pr AS (SELECT a.s, sum(a.w * b.w) AS c FROM frame a JOIN frame b ON b.s = (a.s + 64) % 128 AND a.i = b.i GROUP BY a.s), "
            f"d AS (SELECT f.s, f.i, f.w - 0.01 * (g + 0.5 * (sign(c) * o.w - abs(c) * f.w)) / {divide} AS v FROM grad JOIN frame f USING (s, i) JOIN frame o ON o.s = (f.s + 64) % 128 AND o.i = f.i JOIN pr ON pr.s = f.s JOIN hes ON hes.s = f.s) "
            f"SELECT s, i, {R('v / sqrt(sum(v * v) OVER (PARTITION BY s))')} AS value FROM d")


def _subspace(spark, sf_dir, quadratic: bool):
    stats = _one_step_stats(spark, sf_dir)
    hessian = learning.hessian_update(np.zeros(2 * N), stats.energy) if quadratic else None
    pairs = [[k, k + N] for k in range(N)]
    return small(spark, learning.subspace_step(dct_frame(N), stats, pairs, 0.5, 0.01, hessian), "s", "i", "value")


@query(_subspace_sql("(e + 0.001)"))
def subspace_quadratic_step(spark, sf_dir):
    return _subspace(spark, sf_dir, True)


@query(_subspace_sql("1.0"))
def subspace_steepest_step(spark, sf_dir):
    return _subspace(spark, sf_dir, False)


def _round_sql(t: int, weight: float) -> str:
    """From dictionary d{t} and Hessian h{t}: codes of every fourth row in one step, statistics, the next of both."""
    return (f", c{t} AS (SELECT id, s, {_soft('z', weight / 2)} AS c FROM (SELECT id, s, 0.5 * sum(x * w) AS z FROM long JOIN d{t} USING (i) WHERE id % 4 = {t} GROUP BY id, s)), "
            f"n{t} AS (SELECT count(DISTINCT id) AS n FROM c{t}), cc{t} AS (SELECT a.s, b.s AS t, sum(a.c * b.c) AS v FROM c{t} a JOIN c{t} b USING (id) GROUP BY a.s, b.s), "
            f"cx{t} AS (SELECT s, i, sum(c * x) AS v FROM c{t} JOIN long USING (id) GROUP BY s, i), "
            f"h{t + 1} AS (SELECT s, 0.99 * any_value(e) + avg(c * c) / 100 AS e FROM c{t} JOIN h{t} USING (s) GROUP BY s), "
            f"u{t} AS (SELECT s, i, d{t}.w - 0.01 * (q.v - cx{t}.v) / n / (e + 0.001) AS w FROM cx{t} JOIN d{t} USING (s, i) JOIN h{t + 1} USING (s) "
            f"JOIN (SELECT cc{t}.s, i, sum(v * w) AS v FROM cc{t} JOIN d{t} ON cc{t}.t = d{t}.s GROUP BY cc{t}.s, i) q USING (s, i), n{t}), "
            f"d{t + 1} AS (SELECT s, i, w / sqrt(sum(w * w) OVER (PARTITION BY s)) AS w FROM u{t}) ")


@query(", d0 AS (FROM frame), h0 AS (SELECT s, 0.0 AS e FROM range(128) AS r(s)) " + _round_sql(0, 0.1) + _round_sql(1, 0.05) + f"SELECT s, i, {R('w')} AS value FROM d2")
def sparse_coding_training(spark, sf_dir):
    df = embedded(spark, sf_dir)
    batches = lambda t: df.filter(F.col("id") % 4 == t % 4)
    out = learning.train_sparse_coding(batches, 2, dct_frame(N), learning.Schedule({0: 0.1, 1: 0.05}), learning.Schedule({0: 0.01}), 1, "cheap_quadratic", step=_FRAME_STEP)
    return small(spark, out.dictionary, "s", "i", "value")


def _conv_sql(divide: str) -> str:
    return (_CONV + ", nn AS (SELECT count(*) AS n FROM vec), en AS (SELECT s, sum(c * c) / any_value(n) / 100 AS e FROM c1, nn GROUP BY s), "
            f"kg AS (SELECT s, v - p AS a, h - q AS b, sum(c * r) / any_value(n) / any_value({divide}) AS g FROM c1 JOIN res USING (id) JOIN en USING (s), nn "
            "WHERE v - p BETWEEN 0 AND 1 AND h - q BETWEEN 0 AND 1 GROUP BY s, v - p, h - q), "
            "kn AS (SELECT s, a, b, w - 0.1 * g * 2 / (SELECT sqrt(sum(g * g)) FROM kg) AS w FROM kg JOIN haar USING (s, a, b)) "
            f"SELECT s, a * 2 + b AS i, {R('w / sqrt(sum(w * w) OVER (PARTITION BY s))')} AS value FROM kn")


def _conv_trained(spark, sf_dir, quadratic: bool):
    df = embedded(spark, sf_dir)
    out = learning.train_conv(lambda t: df, 1, haar_kernels(), (1, SIDE, SIDE), (1, 1), _PADDED, 0.05, 0.1, 1, quadratic)
    return small(spark, out.dictionary.reshape(4, -1), "s", "i", "value")


@query(_conv_sql("1.0"))
def conv_training(spark, sf_dir):
    return _conv_trained(spark, sf_dir, False)


@query(_conv_sql("(e + 0.001)"))
def conv_quadratic_training(spark, sf_dir):
    return _conv_trained(spark, sf_dir, True)


@query(f"SELECT row_number() OVER (ORDER BY s) - 1 AS s, norm, first FROM (SELECT s, {R('sqrt(sum(w * w))')} AS norm, {R('sum(w) FILTER (WHERE i = 0)')} AS first FROM frame WHERE s % 5 <> 2 GROUP BY s)")
def prune_dictionary(spark, sf_dir):
    d, _ = learning.prune_elements(dct_frame(N), [s for s in range(2 * N) if s % 5 == 2])
    rows = [(s, float(np.linalg.norm(x)), float(x[0])) for s, x in enumerate(d)]
    return spark.createDataFrame(rows, "s int, norm double, first double").withColumns({"norm": rounded("norm"), "first": rounded("first")})


@query(f"SELECT s, {R('CASE WHEN s < 3 THEN (SELECT avg(n) FROM (SELECT s, sqrt(sum(w * w)) * (1 + s / 100) AS n FROM frame GROUP BY s)) ELSE sqrt(sum(w * w)) * (1 + s / 100) END')} AS norm, "
       "s < 3 AS changed FROM frame GROUP BY s")
def reset_dictionary(spark, sf_dir):
    """Noise of the mean norm in three elements; the others stay."""
    d = dct_frame(N) * (1 + np.arange(2 * N) / 100)[:, None]
    out = learning.reset_elements(d, [0, 1, 2], np.random.default_rng(1))
    rows = [(s, float(np.linalg.norm(x)), bool((x != y).any())) for s, (x, y) in enumerate(zip(out, d))]
    return spark.createDataFrame(rows, "s int, norm double, changed boolean").withColumn("norm", rounded("norm"))


@query(f"SELECT t AS point, i, {R('CASE WHEN i = 0 THEN cos(0.1 * t) WHEN i = 2 THEN sin(0.1 * t) ELSE 0.0 END')} AS value FROM range(50) AS a(t), range(3) AS b(i)")
def sphere_walk(spark, sf_dir):
    walk = unit_sphere_walk(np.array([2.0, 0, 0]), 0.1, 50, True, np.array([1.0, 0, 3.0]))
    return small(spark, walk, "point", "i", "value").withColumn("point", F.col("point").cast("long"))


@query(f", u AS (SELECT id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM vec), "
       f"p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON a.id < b.id) SELECT a, b, {R('c')} AS cosine FROM p WHERE c > 0.2")
def cosine_pairs(spark, sf_dir):
    return learning.similar_rows(embedded(spark, sf_dir), 0.2).withColumn("cosine", rounded("cosine"))


@query(f"SELECT id, {R('sqrt(sum(x * x))')} AS norm FROM long GROUP BY id")
def element_norms(spark, sf_dir):
    return embedded(spark, sf_dir).select("id", rounded(F.sqrt(metrics.summed(F.transform("x", lambda v: v * v)))).alias("norm"))


@query(f"SELECT s, {R('avg(abs(w - 0.5 * w - 0.13 * i / 64))')} AS change FROM frame GROUP BY s")
def dictionary_change(spark, sf_dir):
    d = dct_frame(N)
    before = 0.5 * d + 0.13 * np.arange(N) / N
    out = metrics.dictionary_change(matrix_table(spark, d, "s", "i", "value"), matrix_table(spark, before, "s", "i", "value"))
    return out.select(F.col("s").cast("long").alias("s"), rounded("change").alias("change"))


@query(f"SELECT 20 AS iteration, s, i, {R('w * 20')} AS value FROM frame")
def checkpoint_latest(spark, sf_dir):
    path = datasets.scratch(spark, "dictionaries")
    for t in (0, 5, 20):
        datasets.save_checkpoint(spark, path, t, dct_frame(N) * t)
    last, d = datasets.newest_checkpoint(spark, path)
    return small(spark, d, "s", "i", "value").withColumn("iteration", F.lit(last))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def registry_tables(spark, sf_dir):
    registry, names = datasets.Registry(), ("customer", "nation", "part")
    for name in names:
        registry.add_table(name, f"{sf_dir}/{name}.parquet")
    return reduce(DataFrame.unionByName, [registry.read(spark, k).select(F.lit(k).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")) for k in names])


@query(f"SELECT CASE WHEN id % 5 = 0 THEN 'validation' ELSE 'training' END AS split, i, count(*) AS n, {R('sum(x)')} AS total FROM long GROUP BY ALL")
def patch_dataset(spark, sf_dir):
    path, df = datasets.scratch(spark, "patches"), embedded(spark, sf_dir)
    datasets.save_patches(df.filter("id % 5 <> 0"), df.filter("id % 5 = 0"), path)
    both = [part.withColumn("split", F.lit(name)) for name, part in zip(("training", "validation"), datasets.load_patches(spark, path))]
    long = both[0].unionByName(both[1]).select("split", F.posexplode("x").alias("i", "x"))
    return long.groupBy("split", "i").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("total"))


@query("SELECT t * 10 AS iteration, m AS metric, (CASE m WHEN 'l0' THEN 1.0 / (t + 1) ELSE t * t END)::DOUBLE AS value FROM range(4) AS r(t), (VALUES ('l0'), ('loss')) AS v(m)")
def scalar_log(spark, sf_dir):
    path = datasets.scratch(spark, "metrics")
    for t in range(4):
        datasets.log_metrics(spark, path, t * 10, {"l0": 1 / (t + 1), "loss": t * t})
    return spark.read.parquet(path)


@query("SELECT * FROM (VALUES ('batch_size', '250'), ('lam', '0.1'), ('stride', '[2, 2]'), ('variant', 'fista')) AS v(name, value)")
def run_params(spark, sf_dir):
    path = datasets.scratch(spark, "params")
    datasets.save_params(spark, path, {"lam": 0.1, "variant": "fista", "batch_size": 250, "stride": (2, 2)})
    return spark.createDataFrame([(k, str(v)) for k, v in datasets.load_params(spark, path).items()], "name string, value string")


@query("SELECT t AS iteration, CASE WHEN t >= 60 THEN 0.01 WHEN t >= 10 THEN 0.05 ELSE 0.1 END::DOUBLE AS value FROM range(100) AS r(t)")
def parameter_schedule(spark, sf_dir):
    s = learning.Schedule({0: 0.1, 10: 0.05, 60: 0.01})
    return spark.createDataFrame([(t, s.at(t)) for t in range(100)], "iteration long, value double")


# metrics

_KEPT = ", kept AS (SELECT id, k, CASE WHEN abs(c) >= 0.1 THEN c ELSE 0.0 END AS c FROM (SELECT id, k, sum(x * w) AS c FROM long JOIN dct USING (i) GROUP BY id, k)), rec AS (SELECT id, i, sum(c * w) AS y FROM kept JOIN dct USING (k) GROUP BY id, i) "


def _reconstructed(spark, sf_dir):
    """Patches, their DCT codes without small ones, and what these give back."""
    coded = inference.linear_codes(embedded(spark, sf_dir), dct(N), True)
    kept = coded.withColumn("code", F.transform("code", lambda c: F.when(F.abs(c) >= 0.1, c).otherwise(F.lit(0.0))))
    return inference.synthesize(kept, dct(N))


@query(_KEPT + f"SELECT id, {R('10 * log10(pow(max(x) - min(x), 2) / avg((x - y) * (x - y)))')} AS psnr FROM long JOIN rec USING (id, i) GROUP BY id")
def psnr(spark, sf_dir):
    return metrics.psnr(_reconstructed(spark, sf_dir)).select("id", rounded("psnr").alias("psnr"))


@query(_KEPT + ", m AS (SELECT id, avg((x - y) * (x - y)) AS e FROM long JOIN rec USING (id, i) GROUP BY id), r AS (SELECT id % 8 AS batch_id, max(x) - min(x) AS r FROM long GROUP BY 1) "
       f"SELECT batch_id, {R('avg(10 * log10(r * r / e))')} AS psnr FROM m JOIN r ON m.id % 8 = batch_id WHERE e > 0 GROUP BY batch_id")
def batch_psnr(spark, sf_dir):
    df = _reconstructed(spark, sf_dir).withColumn("batch_id", F.col("id") % 8)
    return metrics.batch_psnr(df, "batch_id").select("batch_id", rounded("psnr").alias("psnr"))


@query(_KEPT + f"SELECT id, (count(*) FILTER (WHERE c <> 0) / 64.0)::DOUBLE AS l0, {R('sum(abs(c))')} AS l1 FROM kept GROUP BY id")
def l0_l1(spark, sf_dir):
    return metrics.sparsity(_reconstructed(spark, sf_dir)).select("id", "l0", rounded("l1").alias("l1"))


_LASSO = (_KEPT + ", a AS (SELECT id, 0.5 * sum((x - y) * (x - y)) AS l2 FROM long JOIN rec USING (id, i) GROUP BY id), b AS (SELECT id, sum(abs(c)) AS l1, count(*) FILTER (WHERE c <> 0) / 64.0 AS l0 FROM kept GROUP BY id), "
          "per AS (SELECT id % 6 AS batch_id, avg(l2) AS l2, 0.1 * avg(l1) AS lagrange, avg(l0) AS l0 FROM a JOIN b USING (id) GROUP BY 1) ")


def _lasso(spark, sf_dir):
    return metrics.lasso(_reconstructed(spark, sf_dir).withColumn("batch_id", F.col("id") % 6), 0.1, "batch_id")


@query(_LASSO + f"SELECT batch_id, {R('l2')} AS l2, {R('lagrange')} AS lagrange, {R('l0')} AS l0, {R('l2 + lagrange')} AS total FROM per")
def lasso_metrics(spark, sf_dir):
    return _lasso(spark, sf_dir).select("batch_id", *(rounded(c).alias(c) for c in ("l2", "lagrange", "l0", "total")))


@query(_LASSO + f"SELECT {R('avg(l2)')} AS l2, {R('avg(lagrange)')} AS lagrange, {R('avg(l0)')} AS l0, {R('avg(l2 + lagrange)')} AS total FROM per")
def validation_average(spark, sf_dir):
    out = metrics.batch_average(_lasso(spark, sf_dir), "batch_id")
    return out.select(*(rounded(c).alias(c) for c in ("l2", "lagrange", "l0", "total")))


@query(_KEPT + ", gn AS (SELECT id, k // 4 AS g, sqrt(sum(c * c)) AS n FROM kept GROUP BY id, k // 4) "
       f"SELECT {R('0.1 * avg(s)')} AS lagrange FROM (SELECT id, sum(n) AS s FROM gn GROUP BY id)")
def group_lasso(spark, sf_dir):
    out = metrics.lasso(_reconstructed(spark, sf_dir), 0.1, groups=[list(range(g, g + 4)) for g in range(0, N, 4)])
    return out.select(rounded("lagrange").alias("lagrange"))


_C1, _C2 = 0.01**2, 0.03**2


@query(_KEPT + ", g11 AS (SELECT a, b, exp(-0.5 * (a * a + b * b) / 2.25) AS g FROM range(-5, 6) AS p(a), range(-5, 6) AS q(b)), g11n AS (SELECT a, b, g / sum(g) OVER () AS g FROM g11), "
       "pix AS (SELECT id, i // 8 AS v, i % 8 AS h, x, y FROM long JOIN rec USING (id, i)), mid AS (SELECT id, v, h FROM pix WHERE v BETWEEN 3 AND 4 AND h BETWEEN 3 AND 4), "
       "mo AS (SELECT c.id, c.v, c.h, sum(g * x) AS ux, sum(g * y) AS uy, sum(g * x * x) AS xx, sum(g * y * y) AS yy, sum(g * x * y) AS xy "
       f"FROM mid c, g11n JOIN pix p ON p.id = c.id AND p.v = {_MIRROR.format('c.v - a')} AND p.h = {_MIRROR.format('c.h - b')} GROUP BY c.id, c.v, c.h) "
       f"SELECT id, {R(f'avg((2 * ux * uy + {_C1}) * (2 * (xy - ux * uy) + {_C2}) / ((ux * ux + uy * uy + {_C1}) * (xx - ux * ux + yy - uy * uy + {_C2})))')} AS ssim FROM mo GROUP BY id")
def ssim(spark, sf_dir):
    return metrics.ssim(_reconstructed(spark, sf_dir), SIDE, SIDE).select("id", rounded("ssim").alias("ssim"))


_HIST = (", lim AS (SELECT min(x) AS lo, max(x) AS hi FROM long), b AS (SELECT i, least(floor((x - lo) / ((hi - lo) / 20))::INT, 19) AS bin FROM long, lim), "
         "ct AS (SELECT i, bin, count(*) AS n FROM b GROUP BY i, bin), den AS (SELECT i, bin::INT AS bin, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY i) AS density "
         "FROM (SELECT i, bin FROM range(64) AS p(i), range(20) AS q(bin)) LEFT JOIN ct USING (i, bin)) ")


@query(_HIST + f"SELECT i, bin, {R('density')} AS density FROM den")
def coeff_histogram(spark, sf_dir):
    out = metrics.histogram(to_long(embedded(spark, sf_dir)), 20, ["i"])
    return out.withColumn("density", rounded("density"))


@query(_HIST + f", m AS (SELECT i, avg(density) AS m, var_pop(density) AS v FROM den GROUP BY i) SELECT i, {R('avg(pow(density - m, 4)) / pow(any_value(v), 2)')} AS kurtosis FROM den JOIN m USING (i) GROUP BY i")
def density_kurtosis(spark, sf_dir):
    out = metrics.density_kurtosis(metrics.histogram(to_long(embedded(spark, sf_dir)), 20, ["i"]), ["i"])
    return out.select("i", rounded("kurtosis").alias("kurtosis"))


_ADJACENT = (", adj AS (SELECT a.x AS x, b.x AS y FROM img a JOIN img b ON a.id = b.id AND abs(a.v - b.v) <= 1 AND abs(a.h - b.h) <= 1 AND (a.v <> b.v OR a.h <> b.h)), "
             "lim AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS n FROM adj), "
             "jd AS (SELECT bx, \"by\", count(*) / any_value(n * ((hx - lx) / 30) * ((hy - ly) / 30)) AS density FROM (SELECT least(floor((x - lx) / ((hx - lx) / 30))::INT, 29) AS bx, "
             "least(floor((y - ly) / ((hy - ly) / 30))::INT, 29) AS \"by\", n, hx, lx, hy, ly FROM adj, lim) GROUP BY bx, \"by\") ")


@query(_ADJACENT + f"SELECT bx, \"by\", {R('density')} AS density FROM jd")
def joint_density(spark, sf_dir):
    return metrics.joint_density(metrics.adjacent_pairs(embedded(spark, sf_dir), SIDE, SIDE), 30).withColumn("density", rounded("density"))


@query(_ADJACENT + f"SELECT bx, \"by\", {R('(ln(density) - min(ln(density)) OVER ()) / (max(ln(density)) OVER () - min(ln(density)) OVER ())')} AS level FROM jd")
def log_density(spark, sf_dir):
    joint = metrics.joint_density(metrics.adjacent_pairs(embedded(spark, sf_dir), SIDE, SIDE), 30)
    return metrics.log_rescale(joint).select("bx", "by", rounded("level").alias("level"))


@query(f"SELECT i, count(*) AS n, {R('var_pop(x)')} AS variance FROM long WHERE round(x, 2) NOT IN (0.0, 0.05) GROUP BY i")
def ignore_values(spark, sf_dir):
    long = to_long(embedded(spark, sf_dir)).withColumn("near", F.round("x", 2))
    kept = metrics.ignore_values(long, [0.0, 0.05], ("near",))
    return kept.groupBy("i").agg(F.count(F.lit(1)).alias("n"), rounded(F.var_pop("x")).alias("variance"))


@query(", ring AS (SELECT id, least(floor(sqrt(v * v + h * h) / 1.4)::INT, 4) AS bin, x FROM img WHERE sqrt(v * v + h * h) <= 7), "
       f"m AS (SELECT id, bin, avg(x) AS m FROM ring GROUP BY id, bin) SELECT id, bin::INT AS bin, {R('bin * 1.4')} AS \"left\", {R('m')} AS mean FROM (SELECT id, bin FROM vec, range(5) AS b(bin)) LEFT JOIN m USING (id, bin)")
def rotational_average(spark, sf_dir):
    out = metrics.rotational_average(image(spark, sf_dir), 5, by=["id"])
    return out.select("id", "bin", rounded("left").alias("left"), rounded("mean").alias("mean"))


@query(f""", {_GRID}, ft AS (SELECT id, grid.v, grid.h, sum(x * cos(2 * pi() * (grid.v * img.v + grid.h * img.h) / 8.0)) AS re,
sum(x * sin(2 * pi() * (grid.v * img.v + grid.h * img.h) / 8.0)) AS im FROM grid, img GROUP BY id, grid.v, grid.h),
ring AS (SELECT least(floor(sqrt(v * v + h * h)), 3)::INT AS bin, p FROM (SELECT CASE WHEN v < 4 THEN v ELSE v - 8 END AS v, CASE WHEN h < 4 THEN h ELSE h - 8 END AS h, re * re + im * im AS p FROM ft) WHERE sqrt(v * v + h * h) <= 4)
SELECT bin, bin::DOUBLE AS "left", {R('avg(p)')} AS mean FROM ring GROUP BY bin""")
def power_spectrum(spark, sf_dir):
    spectra = patches.as_image(whitening.power_spectrum(embedded(spark, sf_dir), SIDE, SIDE), SIDE)
    centred = spectra.withColumns({"v": F.col("v") - SIDE // 2, "h": F.col("h") - SIDE // 2})
    return metrics.rotational_average(centred, 4).select("bin", rounded("left").alias("left"), rounded("mean").alias("mean"))


@query(f", z AS (SELECT id, i, CASE WHEN x > 0 THEN x ELSE 0.0 END AS x FROM long) SELECT id, i, {R('CASE WHEN x = 0 THEN min(CASE WHEN x > 0 THEN log10(x) END) OVER () ELSE log10(CASE WHEN x > 0 THEN x END) END')} AS log FROM z")
def safe_log10(spark, sf_dir):
    long = to_long(embedded(spark, sf_dir)).withColumn("x", F.greatest("x", F.lit(0.0)))
    return metrics.safe_log10(long).select("id", "i", rounded("log").alias("log"))


_SHIFTED = "(SELECT id, i, x + CASE id % 3 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS x FROM long)"


def _shifted(spark, sf_dir):
    """Rows of one sign, of the other, and of both."""
    shift = F.when(F.col("id") % 3 == 1, 1.0).when(F.col("id") % 3 == 2, -1.0).otherwise(0.0)
    df = embedded(spark, sf_dir).withColumn("__shift", shift)
    return df.withColumn("x", F.transform("x", lambda v: v + F.col("__shift"))).drop("__shift")


@query(f", m AS (SELECT id, i, x, min(x) OVER (PARTITION BY id) AS lo, max(x) OVER (PARTITION BY id) AS hi FROM {_SHIFTED}) "
       f"SELECT id, i, {R('CASE WHEN lo >= 0 THEN x / hi WHEN hi <= 0 THEN x / -lo + 1 ELSE x / (2 * greatest(-lo, hi)) + 0.5 END')} AS shown FROM m")
def display_range(spark, sf_dir):
    return long_codes(metrics.display_range(_shifted(spark, sf_dir)), "shown", "i", "shown")


@query(f", m AS (SELECT id, min(x) AS lo, max(x) AS hi FROM {_SHIFTED} GROUP BY id) "
       f"SELECT id, {R('CASE WHEN lo >= 0 THEN 0.0 WHEN hi <= 0 THEN lo ELSE least(lo, -hi) END')} AS at_zero, "
       f"{R('CASE WHEN lo >= 0 THEN hi / 2 WHEN hi <= 0 THEN lo / 2 ELSE 0.0 END')} AS at_half, {R('CASE WHEN lo >= 0 THEN hi WHEN hi <= 0 THEN 0.0 ELSE greatest(-lo, hi) END')} AS at_one FROM m")
def display_ends(spark, sf_dir):
    return metrics.display_range(_shifted(spark, sf_dir)).select("id", *(rounded(c).alias(c) for c in ("at_zero", "at_half", "at_one")))


@query("SELECT n_nationkey::INT AS element, p::INT AS place, (2 + (p // 5) * 10)::INT AS top, (2 + (p % 5) * 10)::INT AS \"left\" "
       "FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) - 1 AS p FROM nation)")
def tile_layout(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # one row per element of a sheet
    order = [r.n_nationkey for r in sorted(names, key=lambda r: r.n_name, reverse=True)]
    return metrics.tile_layout(spark, len(order), SIDE, SIDE, order=order)


@query("SELECT k AS level, log, " + R("0.25 + 3 * (CASE WHEN log THEN (sqrt(1 + k / 6) - 1) / (sqrt(2) - 1) ELSE (pow(2, k / 12) - 1) / (sqrt(2) - 1) END)") + " AS height FROM range(7) AS a(k), (VALUES (true), (false)) AS b(log)")
def contour_levels(spark, sf_dir):
    rows = [(k, log, float(v)) for log in (True, False) for k, v in enumerate(metrics.contour_levels(0.25, 3.25, 7, log))]
    return spark.createDataFrame(rows, "level long, log boolean, height double").withColumn("height", rounded("height"))


@query('SELECT n_nationkey::INT AS element, n_regionkey::INT AS "group", (2 + n_regionkey * 10)::INT AS top, (2 + (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) * 10)::INT AS "left" FROM nation')
def grouped_layout(spark, sf_dir):
    groups: dict[int, list[int]] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # one row per element of a sheet
        groups.setdefault(r.n_regionkey, []).append(r.n_nationkey)
    return metrics.grouped_layout(spark, [groups[k] for k in sorted(groups)], SIDE, SIDE)


# source coding

#: Luminance widths along the zigzag.
_WIDTHS = ("16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40, 26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51, "
           "56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87, 95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99")
_QUANT = (", cod AS (SELECT id, k.k AS v, l.k AS h, sum(x * 255 * k.w * l.w) AS c FROM img JOIN dct8 k ON img.v = k.i JOIN dct8 l ON img.h = l.i GROUP BY id, k.k, l.k), "
          f"q AS (SELECT id, pos, floor(round(c, 9) / ([{_WIDTHS}])[pos + 1] + 0.5)::INT AS q FROM cod JOIN zig USING (v, h)) ")
_SYMBOLS = (_QUANT + ", nz AS (SELECT id, pos, q, pos - coalesce(lag(pos) OVER (PARTITION BY id ORDER BY pos), 0) - 1 AS gap, "
            "CASE WHEN q > 0 THEN bin(q) ELSE translate(bin(-q), '01', '10') END AS bits FROM q WHERE pos > 0 AND q <> 0), "
            "sy AS (SELECT id, pos, 0 AS z, gap // 16 AS times, 'f0' AS symbol, '' AS bits FROM nz WHERE gap >= 16 UNION ALL "
            "SELECT id, pos, 1, 1, lower(hex(gap % 16)) || lower(hex(length(bits))), bits FROM nz), "
            "dc AS (SELECT id, CASE WHEN q = 0 THEN '' WHEN q > 0 THEN bin(q) ELSE translate(bin(-q), '01', '10') END AS bits FROM q WHERE pos = 0) ")


def _quantized(spark, sf_dir):
    return jpeg.quantize(jpeg.analyze(embedded(spark, sf_dir, 255.0)), jpeg.bin_widths())


@query("SELECT pos, v, h FROM zig")
def zigzag_positions(spark, sf_dir):
    return spark.createDataFrame([(p, v, h) for p, (v, h) in enumerate(zigzag_order(SIDE, SIDE))], "pos long, v long, h long")


@query(_QUANT + "SELECT id, pos, q FROM q")
def quantize(spark, sf_dir):
    return _quantized(spark, sf_dir).select("id", F.posexplode("q").alias("pos", "q"))


@query(_SYMBOLS + "SELECT dc.id, coalesce(a.s, '') || '00' AS ac, CASE WHEN bits = '' THEN '-' ELSE lower(hex(length(bits))) END AS dc "
       "FROM dc LEFT JOIN (SELECT id, string_agg(repeat(symbol, times::BIGINT), '' ORDER BY pos, z) AS s FROM sy GROUP BY id) a USING (id)")
def run_length_symbols(spark, sf_dir):
    return jpeg.run_lengths(_quantized(spark, sf_dir)).select("id", F.array_join("ac", "").alias("ac"), "dc")


@query(_SYMBOLS + "SELECT 'ac' AS kind, symbol, sum(times)::BIGINT AS n FROM sy GROUP BY symbol UNION ALL SELECT 'ac', '00', count(*) FROM dc UNION ALL "
       "SELECT 'dc', CASE WHEN bits = '' THEN '-' ELSE lower(hex(length(bits))) END, count(*) FROM dc GROUP BY 2")
def symbol_counts(spark, sf_dir):
    return jpeg.symbol_counts(jpeg.run_lengths(_quantized(spark, sf_dir)))


@query(_SYMBOLS + ", al AS (SELECT lower(hex(r)) || lower(hex(z)) AS symbol, lpad(bin(r * 11 + z), 8, '0') AS code FROM range(16) AS a(r), range(11) AS b(z)), "
       "body AS (SELECT id, string_agg(repeat(code || sy.bits, times::BIGINT), '' ORDER BY pos, z) AS s FROM sy JOIN al USING (symbol) GROUP BY id) "
       "SELECT dc.id, coalesce(s, '') || (SELECT code FROM al WHERE symbol = '00') || lpad(bin(length(bits)), 8, '0') || bits AS bits FROM dc LEFT JOIN body USING (id)")
def bitstream(spark, sf_dir):
    coded = jpeg.run_lengths(_quantized(spark, sf_dir))
    return jpeg.encode(coded, jpeg.fixed_table(jpeg.ac_alphabet()), jpeg.fixed_table(jpeg.dc_alphabet())).select("id", "bits")


@query(_QUANT + f"SELECT id, pos, {R(f'q * ([{_WIDTHS}])[pos + 1]')} AS code FROM q")
def dequantize(spark, sf_dir):
    return long_codes(jpeg.dequantize(_quantized(spark, sf_dir), jpeg.bin_widths()), "code", "pos", "code")


@query("SELECT v, h, (pos + 0.5)::DOUBLE AS value FROM zig")
def inverse_zigzag_positions(spark, sf_dir):
    return small(spark, inverse_zigzag(np.arange(N) + 0.5, SIDE, SIDE), "v", "h", "value")


_ALPHABET = ("al AS (SELECT 'ac' AS kind, lower(hex(r)) || lower(hex(z)) AS symbol FROM range(16) AS a(r), range(11) AS b(z) UNION ALL SELECT 'dc', '-' "
             "UNION ALL SELECT 'dc', lower(hex(z)) FROM range(1, 15) AS b(z)) ")
_COUNTS = (_SYMBOLS + ", ct AS (SELECT 'ac' AS kind, symbol, sum(times)::BIGINT AS n FROM sy GROUP BY symbol UNION ALL SELECT 'ac', '00', count(*) FROM dc UNION ALL "
           "SELECT 'dc', CASE WHEN bits = '' THEN '-' ELSE lower(hex(length(bits))) END, count(*) FROM dc GROUP BY 2), " + _ALPHABET)
#: The two lightest nodes meet until one is left; members of the lighter one get a 0 in front, those of the other a 1.
_TABLES = (_COUNTS + ", tree AS (SELECT kind, 0 AS step, list_sort(list({'n': n, 's': symbol, 'm': [symbol]})) AS nodes, []::VARCHAR[] AS low, []::VARCHAR[] AS high "
           "FROM (SELECT kind, symbol, coalesce(n, 1) AS n FROM al FULL JOIN ct USING (kind, symbol)) GROUP BY kind UNION ALL "
           "SELECT kind, step + 1, list_sort(list_append(nodes[3:], {'n': nodes[1].n + nodes[2].n, 's': nodes[1].s, 'm': list_concat(nodes[1].m, nodes[2].m)})), nodes[1].m, nodes[2].m FROM tree WHERE len(nodes) > 1), "
           "tb AS (SELECT kind, symbol, string_agg(bit, '' ORDER BY step DESC) AS code FROM (SELECT kind, step, unnest(low) AS symbol, '0' AS bit FROM tree UNION ALL SELECT kind, step, unnest(high), '1' FROM tree) GROUP BY kind, symbol) ")


def _tables(spark, sf_dir):
    coded = jpeg.run_lengths(_quantized(spark, sf_dir))
    return coded, *jpeg.huffman_tables(coded)


@query(_TABLES + "SELECT kind, symbol, code FROM tb")
def huffman_codes(spark, sf_dir):
    _, ac, dc = _tables(spark, sf_dir)
    return spark.createDataFrame([(kind, s, c) for kind, t in (("ac", ac), ("dc", dc)) for s, c in t.items()], "kind string, symbol string, code string")


@query(_TABLES + ", body AS (SELECT id, string_agg(repeat(code || sy.bits, times::BIGINT), '' ORDER BY pos, z) AS s FROM sy JOIN tb ON kind = 'ac' AND tb.symbol = sy.symbol GROUP BY id) "
       "SELECT dc.id, coalesce(s, '') || (SELECT code FROM tb WHERE kind = 'ac' AND symbol = '00') || code || bits AS bits FROM dc LEFT JOIN body USING (id) "
       "JOIN tb ON kind = 'dc' AND symbol = CASE WHEN bits = '' THEN '-' ELSE lower(hex(length(bits))) END")
def huffman_bitstream(spark, sf_dir):
    return jpeg.encode(*_tables(spark, sf_dir)).select("id", "bits")


_MULTIPLIERS = [0.05, 0.1, 0.2, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


@query(f""", cod AS (SELECT id, k.k AS v, l.k AS h, sum(x * 255 * k.w * l.w) AS c FROM img JOIN dct8 k ON img.v = k.i JOIN dct8 l ON img.h = l.i GROUP BY id, k.k, l.k),
q AS (SELECT id, pos, m, c, floor(round(c, 9) / (b * m) + 0.5)::INT AS q, b * m AS w FROM (SELECT id, pos, c, ([{_WIDTHS}])[pos + 1] AS b FROM cod JOIN zig USING (v, h)), (SELECT unnest({_MULTIPLIERS})::DOUBLE AS m)),
ac AS (SELECT m, q, pos - coalesce(lag(pos) OVER (PARTITION BY m, id ORDER BY pos), 0) - 1 AS gap FROM q WHERE pos > 0 AND q <> 0),
sy AS (SELECT m, 'ac' AS kind, 'f0' AS symbol, sum(gap // 16)::BIGINT AS n FROM ac WHERE gap >= 16 GROUP BY m UNION ALL
       SELECT m, 'ac', lower(hex(gap % 16)) || lower(hex(length(bin(abs(q))))), count(*) FROM ac GROUP BY ALL UNION ALL SELECT m, 'ac', '00', count(*) FROM q WHERE pos = 0 GROUP BY m UNION ALL
       SELECT m, 'dc', CASE WHEN q = 0 THEN '-' ELSE lower(hex(length(bin(abs(q))))) END, count(*) FROM q WHERE pos = 0 GROUP BY ALL),
ct AS (SELECT m, kind, symbol, sum(n)::BIGINT AS n FROM sy GROUP BY ALL), {_ALPHABET},
tree AS (SELECT m, kind, list_sort(list({{'n': n, 's': symbol, 'r': r}})) AS nodes, 0::BIGINT AS coded
         FROM (SELECT m, kind, symbol, coalesce(n, 1) AS n, coalesce(n, 0) AS r FROM (SELECT DISTINCT m, kind, symbol FROM (SELECT m, kind, symbol FROM ct UNION ALL SELECT m, kind, symbol FROM al, (SELECT DISTINCT m FROM ct)))
               LEFT JOIN ct USING (m, kind, symbol)) GROUP BY m, kind
         UNION ALL SELECT m, kind, list_sort(list_append(nodes[3:], {{'n': nodes[1].n + nodes[2].n, 's': nodes[1].s, 'r': nodes[1].r + nodes[2].r}})), coded + nodes[1].r + nodes[2].r FROM tree WHERE len(nodes) > 1),
code AS (SELECT m, sum(coded) AS coded FROM tree WHERE len(nodes) = 1 GROUP BY m),
sums AS (SELECT m, sum(CASE WHEN q <> 0 THEN length(bin(abs(q))) ELSE 0 END) AS raw, sum((c - q * w) * (c - q * w)) / count(*) AS mse, count(*) AS size FROM q GROUP BY m)
SELECT m AS multiplier, round((raw + coded) / size, 6) AS bits_per_component, round(mse, 6) AS mse, round(10 * log10(255.0 * 255.0 / mse), 6) AS psnr FROM sums JOIN code USING (m)""")
def huffman_rate(spark, sf_dir):
    return jpeg.rate_distortion(embedded(spark, sf_dir, 255.0), _MULTIPLIERS)


def flagship(spark, sf_dir: str) -> DataFrame:
    return symbol_counts(spark, sf_dir)
