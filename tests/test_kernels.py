"""Numeric kernels on exact cases, and what the operators must keep."""

import numpy as np
import pytest

from lumispec.operators import kernels, model, peaks, spectra


def test_spline_is_exact_on_cubics():
    x = np.array([0.0, 0.4, 1.0, 1.7, 2.1, 3.0])
    f = lambda v: 2 * v**3 - v**2 + 3 * v - 1
    at = np.linspace(0, 3, 31)
    assert np.allclose(kernels.spline(x, f(x), at), f(at))
    assert np.isnan(kernels.spline(x, f(x), np.array([-0.1, 3.1]))).all()


def test_als_solves_its_system():
    rng = np.random.default_rng(0)
    n, lam = 40, 3.0
    y = rng.normal(size=n) + np.linspace(0, 5, n)
    z = kernels.als(y, lam, 0.1, 200)
    w = np.where(y > z, 0.1, 0.9)
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose((np.diag(w) + 10**lam * d.T @ d) @ z, w * y)
    line = 3 + 0.5 * np.arange(30)
    assert np.allclose(kernels.als(line, 6), line)


def test_savgol():
    x = np.arange(60) * 0.1
    assert np.allclose(kernels.savgol_second(3 * x**2 + x, 0.1), 6)


def test_lorentz_fit():
    x = np.linspace(0, 2, 200)
    y = kernels.lorentz(x, 1.0123, 0.05, 3.0)
    x0, g, a, good = kernels.fit_lorentz(x, y, 1.0, 0.06, 2.5)
    assert good and np.allclose([x0, g, a], [1.0123, 0.05, 3.0], rtol=1e-5)


def test_cwt_and_align():
    x = np.arange(600.0)
    shape = lambda by: sum(kernels.lorentz(x, p + by, 6, a) for p, a in ((120, 900), (300, 1500), (470, 1100)))
    got = [p for p, _ in kernels.cwt_peaks(shape(0) + np.random.default_rng(0).normal(0, 0.01, 600), snr=3)]
    assert all(any(abs(p - q) <= 1 for p in got) for q in (120, 300, 470))
    moved = kernels.align(shape(4), shape(0), [124, 304, 474], [120, 300, 470], 8)
    assert abs(int(np.argmax(moved)) - 300) <= 1 and np.corrcoef(moved, shape(0))[0, 1] > 0.99


def test_pls_and_vip():
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], 20)
    x = rng.normal(size=(40, 8))
    x[:, 3] += 3 * y
    hot = (y[:, None] == np.array([0, 1])).astype(float)
    m = kernels.pls(x, hot, 2)
    assert int(kernels.vip(m)[:, 0].argmax()) == 3
    assert np.allclose((kernels.vip(m) ** 2).sum(0), 8)
    assert kernels.auc(kernels.pls_predict(m, x, 1)[:, 1], y == 1) > 0.95


def test_statistics():
    assert abs(kernels.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(kernels.chi2_quantile(0.975, 3) - 9.348404) < 1e-5
    assert kernels.wilcoxon_greater(np.array([1.0, 2, 3, 4, 5])) == 1 / 32
    assert kernels.auc(np.array([1.0, 2, 2, 3]), np.array([False, False, True, True])) == 0.875


def test_pca():
    x = np.random.default_rng(0).normal(size=(12, 30))
    scores, load, var = kernels.pca(x, 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(var, s[:3] ** 2 / 11) and np.allclose(load.T @ load, np.eye(3))
    _, load, _ = kernels.robust_pca(x, 3)
    assert np.allclose(load.T @ load, np.eye(3), atol=1e-6)


def test_clustering(spark):
    df = spark.createDataFrame([("a", "s1", 1.000, 1.0), ("b", "s1", 2.000, 1.0), ("c", "s2", 1.001, 1.0), ("d", "s2", 2.002, 1.0)], "peak_id string, sample_id string, ppm double, area double")
    got = {r.peak_id: r.ppm_ref for r in peaks.linkage(df, 5.0).collect()}
    assert got["a"] == got["c"] and got["b"] == got["d"] and abs(got["a"] - 1.0005) < 6e-4 and abs(got["b"] - 2.001) < 1e-9


def grid(spark, rows):
    return spark.createDataFrame([(i, k, float(k + 1), float(v)) for i, row in rows.items() for k, v in enumerate(row)], "sample_id string, idx int, ppm double, intensity double")


def area(df):
    return df.first()["area"]


def test_exact_integrals(spark):
    y = grid(spark, {"s": [k * k for k in range(10)]})
    assert area(spectra.integrate(y, {"r": (2, 5)})) == 14
    assert area(spectra.integrate(y, {"r": (2, 5)}, fix_baseline=True)) == -1
    assert area(spectra.integrate(y, {"r": (2, 5)}, fix_baseline=True, clip=True)) == 0
    cut = spectra.exclude_regions(y, {"w": (3, 8)})
    assert area(spectra.integrate(cut, {"r": (2, 10)})) is None
    assert area(spectra.integrate(cut, {"r": (2, 10)}, gaps_as_zero=True)) == 65
    assert spectra.integrate(y, [(2, 5)]).first()["region"] == "ppm_3.5000"


def test_exact_normalisation(spark):
    y = grid(spark, {"A": [1, 2, 3], "B": [2, 4, 12]})
    f = {r.sample_id: r.factor for r in spectra.factors(y, "pqn").collect()}
    got = {(r.sample_id, r.idx): r.intensity for r in spectra.normalize(y, "pqn").collect()}
    assert np.allclose([f["A"], f["B"]], [0.6, 1.2]) and np.allclose([got["B", k] for k in range(3)], [5 / 3, 10 / 3, 10])
    got = {(r.sample_id, r.idx): r.intensity for r in spectra.normalize(y, "area").collect()}
    assert np.allclose([got["A", k] for k in range(3)], [2, 4, 6]) and np.allclose([got["B", k] for k in range(3)], [4 / 3, 8 / 3, 8])


def test_small_rules(spark):
    y = grid(spark, {"s": [1, 2, 1]})
    assert [r.intensity for r in spectra.exclude_regions(y, {"x": (1, 2)}).collect()] == [1.0]
    gaps = lambda v: model.gap_threshold(spark.createDataFrame([(float(x),) for x in v], "x double")).first()[0]
    assert gaps([*range(1, 20), 100]) == 59.5 and gaps([1, 2, 3, 10]) == float("inf")
    aucs = [(1, 1, 0.70), (1, 2, 0.80), (1, 3, 0.82), (2, 1, 0.70), (2, 2, 0.72), (3, 1, 0.60), (3, 2, 0.70), (3, 3, 0.80)]
    got = model.choose_ncomp(spark.createDataFrame(aucs, "fold int, ncomp int, auc double"), 0.05, "fold")
    assert {r.fold: r.ncomp for r in got.collect()} == {1: 2, 2: 1, 3: 3}
    vips = [(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 1.0), (2, "b", 3.0), (2, "c", 2.0)]
    got = {r.feature: r.rank_product for r in model.rank_product(spark.createDataFrame(vips, "fold int, feature string, vip double"), "fold").collect()}
    assert np.allclose([got[k] for k in "abc"], np.sqrt([3, 2, 6]))
    names = spectra.rename_samples(spark.createDataFrame([("10",), ("20",)], "sample_id string"), {"20": "newname"})
    assert [r[0] for r in names.collect()] == ["10", "newname"]
    with pytest.raises(ValueError):
        spectra.rename_samples(names, {"a": "x", "b": "x"})


def test_splits_keep_groups_together(spark):
    df = spark.createDataFrame([(f"s{k}", k % 2) for k in range(12)], "group string, cls int")
    got = model.double_splits(df, 3, 2, 0.25, 0.25).toPandas()
    outer = got[got["inner"].isna()]
    assert (outer.groupby("outer")["role"].value_counts().unstack()["test"] == 3).all()
    for (o, _), part in got.dropna().groupby(["outer", "inner"]):
        assert set(part["group"]) == set(outer[(outer["outer"] == o) & (outer["role"] == "train")]["group"])
    balanced = model.subsample(df, 2, 0.5, balance="cls").join(df, "group").where("role = 'train'").groupBy("iteration", "cls").count().collect()
    assert {r["count"] for r in balanced} == {3}


@pytest.mark.parametrize("n, p, q", [(40, 7, 2), (300, 20, 4), (30, 50, 3)])
def test_vip_drops_are_those_of_plain_fits(n, p, q):
    r = np.random.default_rng(n)
    x, label = r.normal(size=(n, p)), r.integers(0, q, n)
    x[:, 0] += label
    x[:, 3] -= (label == 1) * 2
    x[:, 5] = 1.0
    y = (label[:, None] == np.arange(q)).astype(float)
    got, g = kernels.vip_drops(x, y, 3, np.random.default_rng(9)), np.random.default_rng(9)
    base = kernels.vip(kernels.pls(x, y, 3, 20000))[:, -1]
    for j in range(p):
        other = x.copy()
        other[:, j] = g.permutation(x[:, j])
        assert abs(got[j] - (base[j] - kernels.vip(kernels.pls(other, y, 3, 20000))[j, -1])) < 1e-6
    assert np.allclose(got, kernels.vip_drops(x, y, 3, np.random.default_rng(9), 1), atol=1e-9)
