"""Properties: objectives fall, transforms invert, results do not depend on partitions, errors are errors."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcode.functions import filters
from weftcode.functions.transforms import dct, dct_2d, dct_frame, inverse_zigzag, unit_sphere_walk, zigzag
from weftcode.functions.vectors import apply_rows, from_long, sum_matrices, to_long, vectors
from weftcode.operators import inference, jpeg, learning, metrics, patches, whitening
from weftcode.sources import datasets
from weftcode.streaming.online import OnlineLearner

RNG = np.random.default_rng(7)
X = RNG.normal(size=(40, 16))
D = learning.unit_rows(RNG.normal(size=(24, 16)))


def frame(spark, x=X, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def column(df, col="x"):
    return np.array([r[col] for r in df.orderBy("id").collect()])


# vectors


def test_long_form_inverts(spark):
    assert np.array_equal(column(from_long(to_long(frame(spark)))), X)


def test_null_and_ragged_vectors_are_errors(spark):
    for bad in ([None], [[1.0, None]], [[1.0], [1.0, 2.0]]):
        df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "id long, x array<double>").coalesce(1)
        with pytest.raises(Exception, match="null|length"):
            apply_rows(df, ["x"], ["y"], lambda x: x).collect()


def test_sums_do_not_depend_on_partitions(spark):
    for parts in (1, 5):
        g = sum_matrices(frame(spark, parts=parts), ["x"], lambda x: {"g": x.T @ x})["g"]
        assert np.allclose(g, X.T @ X)
    assert sum_matrices(frame(spark).limit(0), ["x"], lambda x: {"g": x.T @ x}) == {}


def test_vectors_scale(spark):
    assert np.allclose(column(vectors(frame(spark), "id", "x", 2.0)), 2 * X)


# patches


def test_tiles_and_assembly_invert(spark):
    tiles = patches.tile(patches.as_image(frame(spark), 4), 4, 4, 2, 2)
    placed = tiles.select("id", (F.col("tv") * 2).alias("top"), (F.col("th") * 2).alias("left"), "v", "h", "x")
    assert np.array_equal(column(patches.as_vectors(patches.assemble(placed, 2, 2))), X)


def test_tiles_leave_the_overflow_out(spark):
    assert patches.tile(patches.as_image(frame(spark), 4), 4, 4, 3, 3).count() == 40 * 9


def test_padding_and_channels(spark):
    padded = column(patches.pad(frame(spark), 4, 4, 1, 2, 3, 0)).reshape(40, 7, 7)
    assert np.array_equal(padded, np.pad(X.reshape(40, 4, 4), ((0, 0), (1, 2), (3, 0))))
    first = column(patches.as_vectors(patches.as_image(frame(spark), 4, 2), ("c", "v", "h")))
    assert np.array_equal(first, X.reshape(40, 2, 4, 2).transpose(0, 3, 1, 2).reshape(40, 16))


def test_statistics_of_components_and_samples(spark):
    centred, means = patches.center_components(frame(spark))
    assert np.allclose(column(centred), X - X.mean(0)) and np.allclose(means, X.mean(0))
    scaled, variances = patches.normalize_variance(frame(spark))
    assert np.allclose(column(scaled), X / X.std(0)) and np.allclose(variances, X.var(0))
    assert np.allclose(column(patches.center_samples(frame(spark))), X - X.mean(1, keepdims=True))
    constant = patches.normalize_variance(frame(spark, np.ones((3, 2))))[0]
    assert all(r.x == [None, None] for r in constant.collect())
    with pytest.raises(ValueError):
        patches.standardize_range(frame(spark, np.ones((3, 2))))


def test_sampled_patches_are_parts_of_their_image(spark):
    rows = patches.sample_patches(frame(spark), 300, 4, 4, (2, 2), seed=1).collect()
    assert len(rows) == 300 and {r.top for r in rows} == {0, 1} == {r.left for r in rows}
    for r in rows:
        assert np.array_equal(np.reshape(r.x, (2, 2)), X[r.id].reshape(4, 4)[r.top : r.top + 2, r.left : r.left + 2])
    with pytest.raises(ValueError):
        patches.sample_patches(frame(spark), 5, 4, 4, (4, 4))


def test_minibatches_partition_the_rows(spark):
    rows = patches.minibatches(frame(spark), 7, epoch=2).select("id", "batch_id").collect()
    sizes = np.bincount([r.batch_id for r in rows])
    assert sorted(r.id for r in rows) == list(range(40)) and list(sizes) == [7] * 5 + [5]
    other = patches.minibatches(frame(spark, parts=1), 7, epoch=2).select("id", "batch_id").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, other))
    assert patches.minibatches(frame(spark).limit(0), 7).count() == 0


def test_minibatches_of_wide_rows_and_small_partitions(spark):
    """Adaptive execution joins partitions by their bytes: numbers must not depend on that."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "1m")
        spark.conf.set(names[1], "40")
        wide = spark.range(40_000).withColumn("x", F.expr("transform(sequence(1, 80), i -> rand())"))
        got = patches.minibatches(wide, 64).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("size")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.batch_id, r.n, r["size"]) for r in got) == [(b, 64, 80) for b in range(625)]


def test_sampling_of_images_whose_ids_have_gaps(spark):
    images = patches.exclude(frame(spark), list(range(0, 40, 3)))
    rows = patches.sample_patches(images, 500, 4, 4, (2, 2)).collect()
    assert len(rows) == 500 and {r.id for r in rows} == {i for i in range(40) if i % 3}
    for r in rows[:50]:
        assert np.array_equal(np.reshape(r.x, (2, 2)), X[r.id].reshape(4, 4)[r.top : r.top + 2, r.left : r.left + 2])


def test_numbered_rows_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(patches, "BUCKET", 100)
    ids = spark.range(0, 9000, 3).repartition(7).withColumn("x", F.array(F.col("id").cast("double")))
    rows = patches.sample_patches(ids, 4000, 2, 2, (1, 1), cols=()).groupBy("id").count().collect()
    assert sum(r[1] for r in rows) == 4000 and {r.id for r in rows} <= set(range(0, 9000, 3)) and len(rows) > 2000
    out = patches.minibatches(ids, 10, epoch=4).select("batch_id", "id").collect()
    assert list(np.bincount([r.batch_id for r in out])) == [10] * 300


def test_long_vectors_make_short_plans(spark):
    wide = frame(spark, RNG.normal(size=(4, 4096)))
    centred, means = patches.center_components(wide)
    assert len(means) == 4096 and len(centred._jdf.queryExecution().analyzed().toString()) < 200_000
    assert np.allclose(column(centred).mean(0), 0)


def test_order_of_steps_is_checked():
    for steps in ([("patch", 3, (2, 2)), ("standardize",)], [("tile", (2, 2)), ("filter", None)], [("center_samples",)], [("tile", (2, 2)), ("patch", 3, (1, 1))], [("spin",)]):
        with pytest.raises(ValueError):
            patches.Pipeline(steps, 4, 4)


def test_exclude(spark):
    assert patches.exclude(frame(spark), [0, 1]).count() == 38
    assert patches.exclude(frame(spark), spark.range(5)).count() == 35


# filters and whitening


def test_filters():
    assert filters.binomial_1d(4).tolist() == [0.125, 0.375, 0.375, 0.125] and np.isclose(filters.binomial_2d(3, 5).sum(), 1)
    assert np.isclose(filters.gaussian_2d(1.0, (5, 4)).sum(), 1) and filters.centred(4).tolist() == [-2, -1, 0, 1]
    image = RNG.normal(size=(9, 7))
    taps = filters.gaussian_2d(1.0, (3, 3))
    whole = np.pad(image, 1, mode="symmetric")
    want = sum(taps[a, b] * whole[2 - a : 11 - a, 2 - b : 9 - b] for a in range(3) for b in range(3))
    assert np.allclose(filters.filter_spatial(image, taps), want)
    line = filters.binomial_1d(3)
    assert np.allclose(filters.filter_separable(image, line, line), filters.filter_spatial(image, np.outer(line, line)))
    colour = np.stack([image, 2 * image], -1)
    assert np.allclose(filters.filter_spatial(colour, taps)[..., 1], 2 * filters.filter_spatial(image, taps))
    with pytest.raises(ValueError):
        filters.filter_frequency(image, np.ones((4, 4)))
    with pytest.raises(ValueError):
        filters.binomial_1d(1)
    assert filters.low_pass((8, 8), 0.2).min() == 1e-3 and filters.whitening_ramp((8, 8)).max() == 1


def test_whitening_round_trips(spark):
    x = RNG.normal(size=(400, 9)) @ RNG.normal(size=(9, 9)) + 3
    df = frame(spark, x)
    model = whitening.fit_zca(df)
    white = whitening.whiten_zca(df, model)
    assert np.allclose(np.cov(column(white).T, bias=True), np.eye(9), atol=2e-3)
    assert np.allclose(column(whitening.unwhiten_zca(white, model)), x)
    again = whitening.unwhiten_zca(whitening.whiten_zca(df, model, scalar_mean=True), model, scalar_mean=True)
    assert np.allclose(column(again), x)
    with pytest.raises(ValueError):
        whitening.fit_zca(frame(spark))
    dft = filters.center_surround((4, 4))
    surround = whitening.whiten_center_surround(frame(spark), 4, 4)
    assert np.allclose(column(whitening.unwhiten_center_surround(surround, 4, 4, dft=dft)), X)


def test_local_normalization_inverts(spark):
    lum = whitening.local_luminance(frame(spark), 4, 4, 1)
    assert np.allclose(column(lum) + column(lum, "subtractor"), X)
    con = whitening.local_contrast(frame(spark), 4, 4, 1)
    assert np.allclose(column(con) * column(con, "normalizer"), X)
    zero = whitening.local_contrast(frame(spark, np.zeros((2, 16))), 4, 4, 1)
    assert not column(zero).any()


# inference


def objective(c, d=D, weight=0.1):
    return 0.5 * ((c @ d - X) ** 2).sum() + weight * np.abs(c).sum()


@pytest.mark.parametrize("nonnegative", [False, True])
def test_objective_falls(nonnegative):
    values = [objective(inference.ista(X, D, 0.1, k, nonnegative=nonnegative)) for k in (1, 2, 5, 20, 80)]
    assert values == sorted(values, reverse=True)
    assert objective(inference.ista(X, D, 0.1, 20, "fista", nonnegative=nonnegative)) <= values[3] + 1e-9


def test_inputs_stay_and_warm_starts_matter():
    x, d, start = X.copy(), D.copy(), RNG.normal(size=(40, 24))
    before = start.copy()
    warm = inference.ista(x, d, 0.1, 3, start=start)
    assert np.array_equal(x, X) and np.array_equal(d, D) and np.array_equal(start, before)
    assert not np.allclose(warm, inference.ista(x, d, 0.1, 3))
    with pytest.raises(ValueError):
        inference.ista(x, d, 0.1, 0)
    with pytest.raises(ValueError):
        inference.ista(x, d, 0.1, 1, "newton")


def test_groups_of_one_are_plain_ista():
    for variant in ("ista", "fista"):
        plain = inference.ista(X, D, 0.1, 15, variant)
        assert np.allclose(inference.subspace_ista(X, D, [[i] for i in range(24)], 0.1, 15, variant), plain)
    with pytest.raises(NotImplementedError):
        inference.subspace_ista(X, D, [[0]], 0.1, 1, hard=True)


def test_overlapping_groups_sum_copies():
    groups = [[0, 2, 5], [1], [2, 3, 4, 5]]
    d = D[:6]
    wide = d[[i for g in groups for i in g]]
    step = 1 / inference.lipschitz(wide)
    z = step * X @ wide.T
    parts, at, want = [], 0, np.zeros((40, 6))
    for g in groups:
        part = z[:, at : at + len(g)]
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        parts.append(part * np.maximum(1 - 0.1 * step / norm, 0))
        for k, i in enumerate(g):
            want[:, i] += parts[-1][:, k]
        at += len(g)
    assert np.allclose(inference.subspace_ista(X, d, groups, 0.1, 1), want)


def test_early_stopping_is_by_batch(spark):
    df = frame(spark).withColumn("batch_id", F.col("id") % 4)
    with pytest.raises(ValueError):
        inference.infer(df, D, 0.1, 10, epsilon=1e-3)
    got = [column(inference.infer(df.repartition(p), D, 0.1, 500, epsilon=1e-3, batch_col="batch_id"), "code") for p in (1, 6)]
    assert np.array_equal(*got)
    want = np.zeros((40, 24))
    for b in range(4):
        want[b::4] = inference.ista(X[b::4], D, 0.1, 500, epsilon=1e-3)
    assert np.allclose(got[0], want)


def test_convolution_and_its_adjoint(spark):
    kernels, stride, size = RNG.normal(size=(5, 2, 4, 4)), (2, 2), (12, 10)
    codes = RNG.normal(size=(3, 5, inference.code_size(12, 4, 2), inference.code_size(10, 4, 2)))
    images = RNG.normal(size=(3, 2, *size))
    left = (inference.conv_synthesis(codes, kernels, stride, size) * images).sum()
    assert np.isclose(left, (codes * inference.conv_analysis(images, kernels, stride)).sum())
    kernels = learning.unit_rows(RNG.normal(size=(4, 1, 2, 2)))  # without overlap the step is safe
    coded = inference.infer_conv(frame(spark), kernels, (1, 4, 4), (2, 2), 0.05, 30, variant="fista")
    back = inference.synthesize_conv(coded, kernels, (4, 2, 2), (2, 2), (4, 4))
    assert ((column(back, "recon") - X) ** 2).sum() < 0.5 * (X**2).sum()


def test_masks_and_sizes():
    assert inference.mask_of(3, 3, None).all() and inference.mask_of(3, 3, ((1, 0), (0, 0))).sum() == 6
    assert inference.padding_amount(256, 16, 8) == (8, 8) and inference.padding_amount(10, 4, 3) == (1, 3)
    assert inference.code_size(272, 16, 8) == 33


def test_linear_codes_invert(spark):
    square = RNG.normal(size=(16, 16))
    assert np.allclose(column(inference.linear_codes(frame(spark), square), "code") @ square, X)
    coded = inference.linear_codes(frame(spark), dct(16), True)
    assert np.allclose(column(inference.synthesize(coded, dct(16)), "recon"), X)


# learning


def test_steps_keep_unit_rows_and_reduce_error(spark):
    coded = inference.infer(frame(spark), D, 0.05, 50)
    stats, codes = learning.code_stats(coded), column(coded, "code")
    error = lambda d: ((codes @ d - X) ** 2).sum()
    assert np.allclose(stats.gradient(D), codes.T @ (codes @ D - X) / 40)
    for d in (learning.steepest(D, stats, 0.1, normalize=False), learning.cheap_quadratic(D, stats, stats.energy, 0.1, normalize=False)):
        assert error(d) < error(D)
    for d in (learning.steepest(D, stats, 0.1, 3), learning.subspace_step(D, stats, [[0, 1], [2, 3]], 0.5, 0.1, stats.energy)):
        assert np.allclose(np.linalg.norm(d, axis=1), 1)


def test_alignment_gradient_is_the_derivative():
    d = RNG.normal(size=(4, 6))

    def value(m):
        u = learning.unit_rows(m)
        return np.abs(np.triu(u @ u.T, 1)).sum()

    g, eps = learning.alignment_gradient(d, False), 1e-6
    for i, j in ((0, 0), (2, 3), (3, 5)):
        up, down = d.copy(), d.copy()
        up[i, j] += eps
        down[i, j] -= eps
        assert np.isclose((value(up) - value(down)) / (2 * eps), g[i, j], atol=1e-5)


def test_training_reduces_the_objective(spark):
    df = frame(spark)
    for rule, groups in (("steepest", None), ("cheap_quadratic", None), ("subspace_steepest", [[i, i + 1] for i in range(0, 24, 2)])):
        seen = []
        out = learning.train_sparse_coding(
            lambda t: df, 4, D, learning.Schedule({0: 0.1}), learning.Schedule({0: 0.05}), 20, rule, groups, 0.1 if groups else 0.0,
            checkpoint=lambda t, d: seen.append((t, d.copy())), metrics=lambda t, d: {"n": len(d)},
        )
        assert [t for t, _ in seen] == [0, 1, 2, 3] and np.allclose(seen[0][1], D) and len(out.metrics) == 4
        if groups is None:
            fit = lambda d: objective(inference.ista(X, d, 0.1, 100), d)
            assert fit(out.dictionary) < fit(D)
    with pytest.raises(ValueError):
        learning.train_sparse_coding(lambda t: df, 1, 2 * D, learning.Schedule({0: 0.1}), learning.Schedule({0: 0.1}), 5)
    with pytest.raises(ValueError):
        learning.Schedule({1: 0.1})


def test_conv_training_and_ica(spark):
    out = learning.train_conv(lambda t: frame(spark), 2, RNG.normal(size=(3, 1, 2, 2)), (1, 4, 4), (1, 1), ((1, 1), (1, 1)), 0.05, 0.1, 10, True)
    assert np.allclose(np.linalg.norm(out.dictionary.reshape(3, -1), axis=1), 1) and (out.hessian > 0).all()
    start = np.linalg.qr(RNG.normal(size=(16, 16)))[0]
    c = X @ np.linalg.inv(start)
    want = start + 0.1 * (c.T @ np.sign(c) / 40 - np.eye(16)) @ start
    assert np.allclose(learning.train_ica(lambda t: frame(spark), 1, start, 0.1), want)
    with pytest.raises(ValueError):
        learning.train_ica(lambda t: frame(spark), 1, D, 0.1)


def test_no_rows_are_an_error(spark):
    none = frame(spark).limit(0)
    calls = [
        lambda: learning.train_ica(lambda t: none, 1, np.eye(16), 0.1), lambda: learning.code_stats(none.withColumn("code", F.col("x"))),
        lambda: learning.nonuniformity(none.withColumnRenamed("x", "code"), [[0, 1]], 2),
        lambda: learning.conv_gradient(none.withColumn("code", F.col("x")), np.ones((1, 1, 2, 2)), (1, 3, 3), (1, 1), (4, 4)),
    ]
    for call in calls:
        with pytest.raises(ValueError, match="no rows"):
            call()


def test_pca(spark):
    centred = X - X.mean(0)
    basis, variances = learning.train_pca(frame(spark, centred))
    assert np.allclose(basis @ basis.T, np.eye(16)) and (np.diff(variances) <= 1e-12).all()
    assert np.allclose(basis.T * variances @ basis, centred.T @ centred / 40)
    with pytest.raises(ValueError):
        learning.train_pca(frame(spark, X + 1))


def test_maintenance(spark):
    d = np.concatenate([D[:4], D[:1] + 1e-3, -D[1:2]])
    assert [p[:2] for p in learning.similar_pairs(d, 0.99)] == [(0, 4)]
    assert [p[:2] for p in learning.similar_pairs(d, 0.99, [[0, 4], [1, 5], [2, 3]])] == [(0, 4), (1, 5)]
    rng = np.random.default_rng(0)
    assert learning.one_of_each([(0, 4), (0, 5)], rng)[0] in (0, 4)
    fresh = learning.reset_elements(2 * D, [3], rng)
    assert np.isclose(np.linalg.norm(fresh[3]), 2) and np.array_equal(fresh[:3], 2 * D[:3])
    left, groups = learning.prune_elements(D[:5], [1], [[0, 1], [1, 4]])
    assert len(left) == 4 and groups == [[0], [3]]
    codes = np.concatenate([RNG.normal(size=(2000, 2)), np.sign(RNG.normal(size=(2000, 1))) * np.ones((1, 2))], 1)
    values = learning.nonuniformity(frame(spark, codes).withColumnRenamed("x", "code"), [[0, 1], [2, 3]], 3)
    assert values[1] > 10 * values[0] and learning.outlier_groups(np.array([0.01] * 9 + [0.5])) == [9]


# metrics


def test_similar_rows_are_all_pairs(spark):
    x = RNG.normal(size=(100, 8))
    got = sorted((r.a, r.b, round(r.cosine, 9)) for r in learning.similar_rows(frame(spark, x), 0.2, block=16).collect())
    assert got == [(a, b, round(c, 9)) for a, b, c in learning.similar_pairs(x, 0.2)]


def test_metrics(spark):
    df = apply_rows(frame(spark), ["x"], ["recon"], lambda x: x + 0.1)
    want = 10 * np.log10((X.max(1) - X.min(1)) ** 2 / 0.01)
    assert np.allclose(column(metrics.psnr(df), "psnr"), want)
    same = df.withColumn("recon", F.col("x"))
    assert np.isinf(column(metrics.psnr(same), "psnr")).all() and np.allclose(column(metrics.ssim(same, 4, 4), "ssim"), 1)
    assert metrics.batch_psnr(same.withColumn("b", F.lit(0)), "b").first().psnr is None
    dense = metrics.histogram(to_long(frame(spark)), 10).orderBy("bin").collect()
    assert np.allclose([r.density for r in dense], np.histogram(X, 10)[0] / X.size)
    joint = metrics.joint_density(frame(spark).select(F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y")), 4).collect()
    table = np.zeros((4, 4))
    for r in joint:
        table[r.bx, r["by"]] = r.density
    assert np.allclose(table, np.histogram2d(X[:, 0], X[:, 1], 4, density=True)[0])
    levels = metrics.contour_levels(0.25, 0.9, 5)
    assert np.allclose([levels[0], levels[-1]], [0.25, 0.9]) and (np.diff(levels, 2) > 0).all()
    assert (np.diff(metrics.contour_levels(0.25, 0.9, 5, True), 2) < 0).all()
    grouped = metrics.grouped_layout(spark, [[0, 1], [2]], 8, 8).collect()
    assert [(r.element, r.top, r.left) for r in grouped] == [(0, 2, 2), (1, 2, 12), (2, 12, 2)]


def test_walks_stay_on_the_sphere():
    walk = unit_sphere_walk(np.ones(5), 0.1, 30, True)
    assert np.allclose(np.linalg.norm(walk, axis=1), 1) and np.allclose((walk[1:] * walk[:-1]).sum(1), np.cos(0.1))
    assert np.allclose(walk[20] @ walk[0], np.cos(2.0))
    assert len(walk) == 30 and np.allclose(unit_sphere_walk([1, 0], np.pi / 2, 2, True, other=[1, 3])[1], [0, 1])
    loose = unit_sphere_walk(np.ones(5), 0.1, 30)
    assert np.allclose((loose[1:] * loose[:-1]).sum(1), np.cos(0.1))


# source coding


def test_transforms_invert():
    assert np.allclose(dct_2d(8, 4) @ dct_2d(8, 4).T, np.eye(32)) and np.allclose(dct_frame(8).T @ dct_frame(8), 2 * np.eye(8))
    m = RNG.normal(size=(5, 3))
    assert np.array_equal(inverse_zigzag(zigzag(m), 5, 3), m)
    assert zigzag(np.arange(9).reshape(3, 3)).tolist() == [0, 1, 3, 6, 4, 2, 5, 7, 8]


def zero_run_rows():
    rows = [[0] * 64, [5] + [0] * 63, [0] * 63 + [-7], [0, -1, 0, 0, 300, *[0] * 59], [-1023, *[1023] * 63]]
    for run in (14, 15, 16, 17, 32, 33):
        rows.append(([3] + [0] * run + [-2] + [0] * 64)[:64])
    return rows


def test_huffman_code():
    code = jpeg.huffman_code({"a": 5, "b": 2, "c": 1, "d": 1})
    assert {s: len(c) for s, c in code.items()} == {"a": 1, "b": 2, "c": 3, "d": 3}
    assert jpeg.huffman_code({"x": 3}) == {"x": "0"}
    codes = list(code.values())
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize("fixed", [True, False])
def test_streams_decode(spark, fixed):
    rows = zero_run_rows() + RNG.integers(-9, 9, (20, 64)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "id long, q array<int>").repartition(3)
    coded = jpeg.run_lengths(df)
    tables = (jpeg.fixed_table(jpeg.ac_alphabet()), jpeg.fixed_table(jpeg.dc_alphabet())) if fixed else jpeg.huffman_tables(coded)
    for r in jpeg.encode(coded, *tables).collect():
        assert jpeg.decode(r.bits, *tables, 64) == rows[r.id]
    symbols = {r.id: r.ac for r in coded.collect()}
    assert symbols[0] == ["00"] and symbols[2] == ["f0", "f0", "f0", "e3", "00"] and symbols[7] == ["f0", "02", "00"]


def test_quantizing_rounds_halves_up(spark):
    df = spark.createDataFrame([(0, [0.5, -0.5, 1.4, -1.6])], "id long, code array<double>")
    assert jpeg.quantize(df, [1, 1, 1, 1]).first().q == [1, 0, 1, -2]
    rates = jpeg.rate_distortion(frame(spark, RNG.uniform(0, 255, (30, 64))), [0.25, 1.0, 4.0]).orderBy("multiplier").collect()
    assert [r.bits_per_component for r in rates] == sorted((r.bits_per_component for r in rates), reverse=True)
    assert [r.psnr for r in rates] == sorted((r.psnr for r in rates), reverse=True)


# sources, sinks, streaming


def test_image_files(spark, tmp_path):
    stack, colour = RNG.normal(size=(2, 3, 4, 1)), RNG.normal(size=(5, 2, 3))
    for name, a in (("a", stack), ("b", colour)):
        buffer = io.BytesIO()
        np.save(buffer, a)
        (tmp_path / f"{name}.npy").write_bytes(buffer.getvalue())
    rows = {(r.path[-5], r.id): r for r in datasets.read_images(spark, f"{tmp_path}/*.npy", "npy").collect()}
    assert np.array_equal(np.reshape(rows["a", 1].x, (3, 4)), stack[1, ..., 0]) and (rows["b", 0].height, rows["b", 0].channels) == (5, 3)
    (tmp_path / "g.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    one = datasets.read_images(spark, f"{tmp_path}/*.pgm", "pgm").first()
    assert (one.height, one.width, one.x) == (2, 3, [0, 1, 2, 3, 4, 5])
    with pytest.raises(NotImplementedError):
        datasets.read_images(spark, str(tmp_path), "jpeg2000")


def test_sinks(spark, tmp_path):
    for t in (0, 10, 9):
        datasets.save_checkpoint(spark, f"{tmp_path}/d", t, D + t)
    last, d = datasets.newest_checkpoint(spark, f"{tmp_path}/d")
    assert last == 10 and np.allclose(d, D + 10)
    datasets.save_patches(frame(spark), frame(spark, X[:5]), f"{tmp_path}/p")
    assert [p.count() for p in datasets.load_patches(spark, f"{tmp_path}/p")] == [40, 5]
    datasets.save_params(spark, f"{tmp_path}/run", {"step": 0.1, "rule": "steepest"})
    assert datasets.load_params(spark, f"{tmp_path}/run") == {"step": 0.1, "rule": "steepest"}
    datasets.log_metrics(spark, f"{tmp_path}/m", 0, {"l2": 1.0})
    datasets.log_metrics(spark, f"{tmp_path}/m", 1, {"l2": 0.5})
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
    registry = datasets.Registry()
    registry.add_table("patches", f"{tmp_path}/p")
    assert registry.read(spark, "patches").count() == 45
    with pytest.raises(KeyError):
        registry.read(spark, "nothing")


def test_online_learning_replays(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/in")
    learner = OnlineLearner(spark, f"{tmp_path}/out", D, 0.1, 0.1)
    stream = spark.readStream.schema("id long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = learner.start_query(stream, f"{tmp_path}/state", availableNow=True)
    run.awaitTermination()
    last, d = datasets.newest_checkpoint(spark, f"{tmp_path}/out")
    assert last >= 1 and not np.allclose(d, D) and np.allclose(np.linalg.norm(d, axis=1), 1)
    once = learner.before(1)
    learner(frame(spark), 0)
    first = learner.before(1)
    learner(frame(spark), 0)  # a replay gives the same
    assert np.allclose(first, learner.before(1)) and once.shape == D.shape


def test_rates_are_those_of_the_streams(spark):
    df = frame(spark, RNG.uniform(0, 255, (30, 64)))
    coded = jpeg.run_lengths(jpeg.quantize(jpeg.analyze(df), jpeg.bin_widths() * 2))
    bits = jpeg.encode(coded, *jpeg.huffman_tables(coded)).agg(F.avg(F.length("bits")) / 64).first()[0]
    rate = jpeg.rate_distortion(df, [2.0, 3.0]).filter("multiplier = 2").first()
    assert rate.bits_per_component == pytest.approx(bits, abs=1e-6)


def test_tiles_as_arrays_are_the_tiles(spark):
    long = patches.tile(patches.as_image(frame(spark), 4), 4, 4, 2, 3).collect()
    arrays = {(r.id, r.tv, r.th): r.x for r in patches.tile_arrays(frame(spark), 4, 4, 2, 3).collect()}
    assert len(arrays) == 80 and all(arrays[r.id, r.tv, r.th][r.v * 3 + r.h] == r.x for r in long)


def test_preprocessing_steps_keep_sides_in_place(spark):
    steps = [("local_luminance", 1), ("tile", (2, 2)), ("pad", 1, 0, 0, 0)]
    out = patches.Pipeline(steps, 4, 4).run(frame(spark))[0]
    want = patches.pad(patches.tile_arrays(frame(spark), 4, 4, 2, 2).select((F.col("id") * 4 + F.col("tv") * 2 + F.col("th")).alias("id"), "x"), 2, 2, 1, 0, 0, 0)
    assert np.allclose(column(out) + column(out, "subtractor"), column(want))
    steps = [("standardize",), ("whiten_center_surround", 1e-3, 0.9), ("local_contrast", 1), ("patch", 50, (2, 2), 0, 5), ("center_components",), ("whiten_zca",)]
    out, found = patches.Pipeline(steps, 4, 4).run(frame(spark))
    assert out.count() == 50 and {"means", "zca"} == set(found) and "normalizer" in out.columns


def test_maintenance_by_kind(spark):
    rng = np.random.default_rng(1)
    d, groups = np.concatenate([D[:5], D[:1]]), [[0, 1], [2, 3], [4, 5]]
    fresh, same, which = learning.maintain(d, "cosine", "reset", rng, threshold=0.99)
    assert which in ([0], [5]) and same is None and not np.allclose(fresh[which], d[which])
    left, renumbered, which = learning.maintain(d, "random", "prune", rng, groups, count=2)
    assert len(left) == 6 - len(which) and sum(map(len, renumbered)) == len(left)
    codes = frame(spark, RNG.normal(size=(500, 6))).withColumnRenamed("x", "code")
    assert learning.maintain(d, "nonuniform", "reset", rng, groups, codes)[1] == groups
    for bad in ({"kind": "spin", "action": "reset"}, {"kind": "cosine", "action": "reset"}, {"kind": "random", "action": "hide"}, {"kind": "nonuniform", "action": "prune"}):
        with pytest.raises((KeyError, ValueError)):
            learning.maintain(d, rng=rng, **bad)


def test_numbers_without_a_symbol_or_a_code_are_errors(spark):
    coded = lambda q: jpeg.run_lengths(spark.createDataFrame([(0, q)], "id long, q array<int>"))
    tables = jpeg.fixed_table(jpeg.ac_alphabet()), jpeg.fixed_table(jpeg.dc_alphabet())
    for q, match in (([3, 70000, 0, 0], "no symbol"), ([70000, 0, 0, 0], "no symbol"), ([3, 2000, 0, 0], "no code"), ([-(1 << 14), 1, 0, 0], "no code")):
        with pytest.raises(Exception, match=match):
            jpeg.encode(coded(q), *tables).collect()
    (row,) = jpeg.encode(coded([3, -1023, 0, 0]), *tables).collect()
    assert jpeg.decode(row.bits, *tables, 4) == [3, -1023, 0, 0]


def test_image_files_of_other_kinds_have_a_reader_of_their_own(spark, tmp_path):
    (tmp_path / "a.own").write_bytes(bytes(range(6)))
    with pytest.raises(NotImplementedError):
        datasets.read_images(spark, str(tmp_path), "own")
    (row,) = datasets.read_images(spark, str(tmp_path), "own", lambda data: [np.frombuffer(data, np.uint8).reshape(2, 3).astype(float)]).collect()
    assert (row.height, row.width, row.channels, row.x) == (2, 3, 1, [0, 1, 2, 3, 4, 5])
