"""Steps that must not gather a table in one task, a worker or the driver, and give the plain form's results."""

import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispec.functions import rounded
from lumispec.operators import analysis, kernels, model, peaks


def test_distances_of_crowded_peaks_are_dealt_out(spark):
    crowd = spark.range(3000).select(F.col("id").cast("string").alias("peak_id"), (F.col("id") % 7).alias("sample_id"), (1 + F.col("id") % 2 / 1000).alias("ppm"))
    by = [r["count"] for r in peaks.distances(crowd, 0.25).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by) == 3000 * 2999 // 2 and max(by) < 0.4 * sum(by)


def test_distances_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k) if k % 50 else None, int(rng.integers(0, 9)), float(v)) for k, v in enumerate(np.r_[rng.integers(-40, 40, 700) / 10, rng.normal(size=700)])]
    rows += [("x", 1, float("nan")), ("y", 1, None), ("z", 2, float("inf")), ("7", 3, rows[7][2])]
    got = peaks.distances(spark.createDataFrame(rows, "peak_id string, sample_id int, ppm double"), 0.2, 3.0).collect()
    use = [r for r in rows if r[0] is not None and r[2] is not None]
    want = sorted((a[0], b[0], 3.0 * 0.2 if a[1] == b[1] else abs(a[2] - b[2])) for a in use for b in use if a[0] < b[0] and abs(a[2] - b[2]) < 0.2)
    assert sorted(map(tuple, got)) == want


def test_rounded_is_round(spark):
    values = [None, 0.0, -0.1234565, 0.1234565, 2.5e-7, 5e-7, 1e300, float("nan"), float("inf"), 123456789.1234565, *np.random.default_rng(0).normal(size=3000).tolist(), *[k / 2e6 for k in range(-300, 300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~rounded(F.col("v"), 6).eqNullSafe(F.round("v", 6))).isEmpty()


@pytest.mark.parametrize("n, seed", [(1, 0), (2, 1), (9, 2), (1000, 3), (20_001, 4), (300_000, 5)])
def test_medians_of_turned_lines_are_exact(n, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.sort(rng.normal(size=n)), rng.integers(0, 3, n).astype(float)) if seed % 2 else (rng.normal(size=n), rng.normal(size=n))
    angles = np.linspace(-np.pi / 2, np.pi / 2, 7)
    lines = np.cos(angles) * a[:, None] + np.sin(angles) * b[:, None]
    want = 1.4826 * np.median(np.abs(lines - np.median(lines, 0)), 0)
    assert np.array_equal(kernels.turned_mads(a, b, angles), want)
    with ThreadPoolExecutor(3) as pool:
        assert np.array_equal(kernels.turned_mads(a, b, angles, pool), want)


def test_a_misleading_sample_does_not_move_the_median():
    v = np.random.default_rng(0).normal(size=50_000)
    v[::12] = 100.0  # all of the values told
    assert kernels.turned_mads(v, np.zeros(len(v)), np.zeros(1))[0] == 1.4826 * np.median(np.abs(v - np.median(v)))


def test_robust_pca_sorts_no_whole_table(monkeypatch):
    """The time of 615,384 samples was that of sorting all of them 95,000 times."""
    sizes, real = [], np.partition
    monkeypatch.setattr(kernels.np, "partition", lambda v, *more: sizes.append(len(v)) or real(v, *more))
    kernels.robust_pca(np.random.default_rng(0).normal(size=(60_000, 3)), 1)
    assert sizes and np.mean(sizes) < 0.2 * 60_000


def plain_fit(x, y, x0, gamma, area, steps=60):
    """One peak by itself."""
    p, damp = np.array([x0, gamma, area], float), 1e-3
    start = now = ((kernels.lorentz(x, *p) - y) ** 2).sum()
    for _ in range(steps):
        d, g = x - p[0], p[1]
        q = d * d + g * g
        j = np.stack([p[2] / np.pi * g * 2 * d / q**2, p[2] / np.pi * (d * d - g * g) / q**2, g / np.pi / q], 1)
        a = j.T @ j
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-300), j.T @ (y - kernels.lorentz(x, *p)))
        new = ((kernels.lorentz(x, *(p + step)) - y) ** 2).sum()
        if np.isfinite(new) and new < now:
            done = now - new < 1e-14 * max(now, 1e-300)
            p, now, damp = p + step, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    if p[1] < 0 and p[2] < 0:
        p[1:] = -p[1:]
    return (p, True) if now < start and p[1] > 0 else (np.array([x0, gamma, area]), False)


def test_fits_side_by_side_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.sort(rng.random((400, 6)), 1)
    y = kernels.lorentz(x, rng.random((400, 1)), 0.1 + rng.random((400, 1)), 1 + rng.random((400, 1))) + 0.05 * rng.normal(size=(400, 6))
    start = np.column_stack([x[:, 3], 0.1 + rng.random(400), 1 + rng.random(400)])
    want = [plain_fit(a, b, *c) for a, b, c in zip(x, y, start)]
    calls, real = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or real(*a))
    p, good = kernels.fit_lorentzians(x, y, start)
    assert good.tolist() == [g for _, g in want] and 0 < len(calls) <= 60  # not 400 times as many
    near = np.array([np.allclose(a, b, rtol=1e-6) for a, (b, _) in zip(p, want)])
    assert near.mean() > 0.98  # the others wander along a valley and end elsewhere in it, by the last bits
    cost = lambda q: ((kernels.lorentz(x, q[:, :1], q[:, 1:2], q[:, 2:]) - y) ** 2).sum(1)
    assert np.allclose(cost(p), cost(np.array([b for b, _ in want])), rtol=1e-3)


def test_one_singular_fit_leaves_the_others():
    x = np.tile(np.arange(5.0), (2, 1))
    y = kernels.lorentz(x, 2.1, 1.0, 3.0)
    p, good = kernels.fit_lorentzians(x, y, np.array([[2.0, 0.0, 0.0], [2.0, 0.8, 2.0]]))
    assert good.tolist() == [False, True] and p[0].tolist() == [2.0, 0.0, 0.0] and np.allclose(p[1], [2.1, 1, 3])


def test_kernels_by_sample_hold_few_rows(spark):
    """What a worker gives out at once does not grow with the batches that it gets."""
    df = spark.createDataFrame([(k, [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 4.0, float(k)]) for k in range(2000)], "sample_id int, ppm array<double>, intensity array<double>").coalesce(1)
    sizes = []

    def counted(self, run, schema):
        sizes.extend(len(out) for out in run(iter([df.toPandas()])))
        return self

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "mapInPandas", counted)
        model.interpolate(df, (0.0, 3.0, 0.01))
    assert sum(sizes) == 2000 and max(sizes) <= model.ROWS and max(sizes) * 602 < 1.1 * model.VALUES
    rows = model.interpolate(df, (-1.0, 3.0, 1.0)).collect()
    assert sorted(r.sample_id for r in rows) == list(range(2000)) and {r.intensity[0] for r in rows} == {None} and all(abs(r.intensity[4] - r.sample_id) < 1e-6 for r in rows)


def held(f) -> int:
    """Bytes that f() holds at most beside its input."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_fits_copy_no_matrix():
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(60_000, 64)), rng.integers(0, 3, 60_000)
    x[:, 0] += label
    train = rng.random(60_000) > 0.25
    assert held(lambda: model._aucs(x, label, train, 2)) < 0.6 * x.nbytes
    pick, hot = rng.integers(0, 60_000, 60_000), (label[:, None] == np.arange(3)).astype(float)
    assert held(lambda: kernels.vip_drops(x, hot[pick], 2, rng, 1 << 18, rows=pick)) < 0.6 * x.nbytes


@pytest.mark.parametrize("classes", [2, 5])
def test_fits_of_stretches_are_those_of_the_matrix(classes):
    rng = np.random.default_rng(classes)
    label = rng.integers(0, classes, 20_000)
    x = rng.normal(size=(20_000, 9)) + label[:, None] * np.arange(9) / 20
    use = rng.random(20_000) > 0.25
    hot = (label[use][:, None] == np.arange(classes)).astype(float)
    a, b = kernels.pls_of_rows(x, use, hot, 3), kernels.pls(x[use], hot, 3)
    for name in ("coefs", "mx", "sx", "my", "sy"):
        assert np.allclose(a[name], b[name], atol=1e-8)
    assert np.allclose(np.abs(a["weights"]), np.abs(b["weights"]), atol=1e-8)  # a component's sign is free
    assert np.allclose(kernels.vip(a), kernels.vip(b), atol=1e-8)
    pick = rng.integers(0, 20_000, 9_000)
    got = kernels.vip_drops(x, hot := (label[pick][:, None] == np.arange(classes)).astype(float), 2, np.random.default_rng(1), rows=pick)
    assert np.allclose(got, kernels.vip_drops(x[pick], hot, 2, np.random.default_rng(1)), atol=1e-9)


def test_kfold_gathers_the_samples_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(41, 6)) + np.arange(41)[:, None] % 2 * np.array([2, 1, 0, 0, 0, 0])
    data = spark.createDataFrame([(i, row.tolist(), i % 2) for i, row in enumerate(x)], "sample_id int, intensity array<double>, label int")
    calls, real = [], model.matrix
    monkeypatch.setattr(model, "matrix", lambda *a, **more: calls.append(1) or real(*a, **more))
    got = {r.feature: (r.folds, r.p) for r in analysis.kfold_vip(data, "label", 4, 20, 2).collect()}
    assert len(calls) == 1
    each = [model.vip_bootstrap(data.where(F.col("sample_id") % 4 != f), "label", 20, 2, seed=f).toPandas().set_index("feature") for f in range(4)]
    for j in range(6):
        assert got[j][0] == sum(bool(e.loc[j, "relevant"]) for e in each)
        assert abs(got[j][1] - kernels.wilcoxon_greater(np.array([e.loc[j, "mean"] for e in each]))) < 1e-12


def test_kfold_takes_as_many_values_as_a_fold_may_hold(spark, monkeypatch):
    data = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(8)], "sample_id int, intensity array<double>, label int")
    monkeypatch.setattr(model, "MATRIX", 12)
    assert analysis.kfold_vip(data, "label", 4, 4, 1).count() == 2
