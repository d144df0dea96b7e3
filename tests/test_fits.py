"""Areas by the three amplitudes on known Lorentzians, axes taken from the data, and permutations over the double cross-validation."""

import math

import numpy as np
import pytest

from lumispec.operators import analysis, model, peaks


def line(spark, slope):
    """One Lorentzian of area 2 and gamma 0.2 at 5.0, on a straight baseline that the column baseline tells."""
    x = np.round(np.arange(0, 10, 0.004), 3)
    base = 1 + slope * x
    y = 2 / (math.pi * 0.2) * 0.04 / ((x - 5) ** 2 + 0.04) + base
    rows = [(1, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, base))]
    spectra = spark.createDataFrame(rows, "sample_id long, idx int, ppm double, intensity double, baseline double")
    tops = spark.createDataFrame([(1, 1250, 5.0, float(y[1250]))], "sample_id long, pos int, ppm double, intensity double")
    return spectra, tops


@pytest.mark.parametrize(("amplitude", "want"), [("intensity", 2 + math.pi * 0.2 * 1.5), ("second_derivative", 2), ("without_baseline", 2)])
def test_area_of_a_line(spark, amplitude, want):
    spectra, tops = line(spark, 0.1)
    row = peaks.inflections(spectra, tops, amplitude=amplitude).first()
    assert row["gamma_ppb"] == pytest.approx(200, rel=0.05)
    assert row["area"] == pytest.approx(want, rel=0.1)


def test_amplitude_is_known(spark):
    with pytest.raises(ValueError):
        peaks.inflections(*line(spark, 0), amplitude="height")


def test_enough_is_choose_ncomp(spark):
    cases = {"a": [0.7, 0.8, 0.82], "b": [0.7, 0.72], "c": [0.6, 0.7, 0.8], "d": [0.9]}
    aucs = spark.createDataFrame([(k, i + 1, a) for k, v in cases.items() for i, a in enumerate(v)], "fold string, ncomp int, auc double")
    want = {r["fold"]: r["ncomp"] for r in model.choose_ncomp(aucs, 0.05, "fold").collect()}
    assert {k: analysis._enough(np.array(v), 0.05) for k, v in cases.items()} == want


def test_permutations_over_double_cv(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(48, 6))
    x[24:, 2] += 6
    rows = [(i, i // 2, [float(k) for k in range(6)], x[i].tolist(), "ab"[i // 24]) for i in range(48)]
    data = spark.createDataFrame(rows, "sample_id long, subject long, ppm array<double>, intensity array<double>, label string")
    out = {r["permutation"]: r for r in analysis.permuted_double_cv(data, "label", "subject", n=12, ncomp=2).collect()}
    assert sorted(out) == list(range(13))
    assert out[0]["auc"] > 0.95 and out[0]["ncomp"] in (1, 2)
    shuffled = [out[i]["auc"] for i in range(1, 13)]
    assert max(shuffled) < out[0]["auc"] and 0.3 < float(np.mean(shuffled)) < 0.7
    again = {r["permutation"]: r for r in analysis.permuted_double_cv(data, "label", "subject", n=2, ncomp=2).collect()}
    assert all(again[i] == out[i] for i in again)


def test_axis_of_the_samples(spark):
    rows = [(1, [float(i) for i in range(11)]), (2, [0.5 * i for i in range(19, 0, -1)]), (3, [4.0])]
    data = spark.createDataFrame([(i, x, [2 * v for v in x]) for i, x in rows], "sample_id long, ppm array<double>, intensity array<double>")
    assert model.common_axis(data) == (0.5, 9.5, 0.5)
    two = data.where("sample_id < 2")
    out = model.interpolate(two).first()
    assert out["ppm"] == [float(i) for i in range(11)] and out["intensity"] == pytest.approx([2.0 * i for i in range(11)])
    assert model.interpolate(two, (2.0, 4.0)).first()["ppm"] == [2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        model.interpolate(data.where("sample_id = 3"))


def test_shift_in_ppm(spark):
    x = [round(0.001 * i, 3) for i in range(200)]
    y = [math.exp(-((i - 100) ** 2) / 18) for i in range(200)]
    data = spark.createDataFrame([(1, x, y), (2, x, y[-3:] + y[:-3])], "sample_id long, ppm array<double>, intensity array<double>")
    at = spark.createDataFrame([(1, [100]), (2, [103])], "sample_id long, positions array<int>")
    top = lambda ppm: int(np.argmax(model.align(data, at, 1, most_ppm=ppm).where("sample_id = 2").first()["intensity"]))
    assert top(0.0042) == 100
    assert top(0.0042) == int(np.argmax(model.align(data, at, 1, 5).where("sample_id = 2").first()["intensity"]))
