"""Queries without SQL take all rows of their tables."""

import inspect
import os

import numpy as np
import pytest

from lumispec import catalog
from lumispec.operators import analysis, kernels, model

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")


def test_peak_clustering_takes_all_samples(spark):
    rows = catalog.QUERIES["peak_clustering"](spark, SF).select("peak_id", "sample_id", "cluster").collect()
    want = {(r.sample_id) for r in catalog.found(spark, SF).select("sample_id").distinct().collect()}
    assert max(want) >= 100 and {r.sample_id for r in rows} == want
    assert len({r.peak_id for r in rows}) == len(rows) == catalog.found(spark, SF).count()
    assert len({(r.sample_id, r.cluster) for r in rows}) == len(rows)


def plain_linkage(x, group, cut):
    """By clusters of points, pair by pair."""
    parts = [[i] for i in range(len(x))]
    while True:
        best = None
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                pairs = [(i, j) for i in parts[a] for j in parts[b]]
                d = np.inf if any(group[i] == group[j] for i, j in pairs) else max(abs(x[i] - x[j]) for i, j in pairs)
                if d < cut and (best is None or d < best[0]):
                    best = d, a, b
        if best is None:
            return {frozenset(p) for p in parts}
        parts[best[1]] += parts.pop(best[2])


@pytest.mark.parametrize("seed", range(30))
def test_linkage_with_many_points_at_one_place(seed):
    rng = np.random.default_rng(seed)
    x, group = rng.integers(0, 12, 24) / 10, rng.integers(0, 9, 24)
    got = kernels.complete_linkage(x, group, 0.25)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == plain_linkage(x, group, 0.25)


@pytest.mark.parametrize("name, module, function, repeats", [
    ("plsda_auc", model, "plsda_cv", {"iterations": 10}),
    ("vip_bootstrap", model, "vip_bootstrap", {"n": 300}),
    ("permutation_test", model, "permutation_test", {"n": 50}),
    ("double_cv", analysis, "double_cv", {"outer": 3, "inner": 3}),
    ("kfold_vip", analysis, "kfold_vip", {"k": 4, "n": 300}),
])
def test_models_take_all_classes(spark, monkeypatch, name, module, function, repeats):
    got, own = [], inspect.signature(getattr(module, function))

    def held(x, *args, **more):
        call = own.bind(x, *args, **more)
        call.apply_defaults()
        got.append(call.arguments)
        return [x] * 3

    monkeypatch.setattr(module, function, held)
    catalog.QUERIES[name](spark, SF)
    want = {r.sample_id: r.label for r in catalog.classes(spark, SF).select("sample_id", "label").collect()}
    assert len(set(want.values())) > 2
    assert {r.sample_id: r.label for r in next(iter(got[0].values())).select("sample_id", "label").collect()} == want
    assert {k: got[0][k] for k in repeats} == repeats
