"""Whole analyses: double cross-validation with a pluggable method, k-fold importance, and the data behind the plots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, model, spectra
from .spectra import SAMPLE


@dataclass(frozen=True)
class Method:
    """train(x, y, identity, train, ncomp) -> rows (ncomp, auc, vip of each feature); choose(inner AUCs) -> (outer, ncomp); digest(outer rows) -> a frame."""

    train: Callable
    choose: Callable[[DataFrame], DataFrame]
    digest: Callable[[DataFrame], DataFrame]
    ncomp: int = 5


def within(x: np.ndarray, identity: np.ndarray) -> np.ndarray:
    """Each subject's deviations from its own mean."""
    codes, groups = pd.factorize(pd.Series(identity))
    sums = np.zeros((len(groups), x.shape[1]))
    np.add.at(sums, codes, x)
    return x - (sums / np.bincount(codes)[:, None])[codes]


def plsda_method(ncomp: int = 5, least: float = 0.05, multilevel: bool = False) -> Method:
    """Discriminant PLS: AUC on the test samples and importances, by number of components; the first number after which the AUC grows by less than least."""

    def train(x, y, identity, mask, most):
        if multilevel:
            x = x.copy()
            x[mask], x[~mask] = within(x[mask], identity[mask]), within(x[~mask], identity[~mask])
        m = kernels.pls_of_rows(x, mask, model._one_hot(y[mask])[1], most)
        importance = kernels.vip(m)
        return [(k + 1, a, importance[:, k].tolist()) for k, a in enumerate(model._aucs(x, y, mask, most))]

    def digest(rows):
        long = rows.select("outer", F.posexplode("vip").alias("feature", "vip"))
        return model.rank_product(long, "outer")

    return Method(train, lambda aucs: model.choose_ncomp(aucs, least, "outer"), digest, ncomp)


def double_cv(data: DataFrame, y: str, identity: str = SAMPLE, outer: int = 3, inner: int = 3, test_size: float = 0.25, method: Method | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inner AUCs, outer rows at the chosen number of components, digest). All inner splits run as one job, then all outer ones.

    data: sample_id, intensity arrays, y, identity; whole groups of identity are trained or tested.
    """
    method, spark = method or plsda_method(), data.sparkSession
    meta, x = model.matrix(data, *{y, identity} - {SAMPLE})
    ids = meta[identity].to_numpy()
    splits = model.double_splits(spark.createDataFrame(pd.DataFrame({"group": pd.unique(meta[identity])})), outer, inner, test_size, test_size, seed).toPandas()
    splits["inner"] = splits["inner"].fillna(-1).astype(int)
    masks = {}
    for (o, i), part in splits.groupby(["outer", "inner"]):
        role = dict(zip(part["group"], part["role"]))
        masks[int(o), int(i)] = np.array([role.get(g, "") for g in ids])
    shared = spark.sparkContext.broadcast((x, meta[y].to_numpy(), ids, masks))

    def run(batches):
        x, labels, ids, masks = shared.value
        for pdf in batches:
            rows = []
            for o, i, most in zip(pdf["outer"], pdf["inner"], pdf["ncomp"]):
                role = masks[o, i]
                use = role != ""
                rows += [(o, i, *r) for r in method.train(*(v if use.all() else v[use] for v in (x, labels, ids)), role[use] == "train", int(most))]
            yield pd.DataFrame(rows, columns=["outer", "inner", "ncomp", "auc", "vip"])

    schema = "outer int, inner int, ncomp int, auc double, vip array<double>"
    jobs = spark.createDataFrame([(o, i, method.ncomp) for o, i in masks if i >= 0], "outer int, inner int, ncomp int")
    tried = jobs.repartition(max(1, outer * inner)).mapInPandas(run, schema).drop("vip")
    chosen = method.choose(tried.groupBy("outer", "ncomp").agg(F.avg("auc").alias("auc")))
    best = chosen.crossJoin(model.best_ncomp(chosen).withColumnRenamed("ncomp", "_best")).select("outer", F.lit(-1).alias("inner"), F.col("_best").alias("ncomp"))
    rows = best.repartition(max(1, outer)).mapInPandas(run, schema)
    last = rows.groupBy("outer").agg(F.max_by(F.struct("ncomp", "auc", "vip"), "ncomp").alias("r")).select("outer", "r.*")
    return tried, last, method.digest(last)


def _enough(aucs: np.ndarray, least: float) -> int:
    """choose_ncomp() for one fold: aucs by number of components."""
    short = np.flatnonzero(np.diff(aucs) < least)
    if len(short):
        return int(short[0]) + 1
    return 1 if np.isnan(aucs).all() else len(aucs)


def permuted_double_cv(data: DataFrame, y: str, identity: str = SAMPLE, n: int = 50, outer: int = 3, inner: int = 3, test_size: float = 0.25, ncomp: int = 5, least: float = 0.05, seed: int = 0) -> DataFrame:
    """(permutation, ncomp, auc): the mean outer AUC of a whole double cross-validation by discriminant PLS, splits and choice of components included, for each shuffle of the classes; permutation 0 has the true ones.

    A permutation is a task. Whole groups of identity are trained or tested; an AUC that no outer split has is NaN.
    """
    spark = data.sparkSession
    meta, x = model.matrix(data, *{y, identity} - {SAMPLE})
    shared = spark.sparkContext.broadcast((x, meta[y].to_numpy(), pd.factorize(meta[identity])[0]))

    def deal(rng, groups):
        mixed = rng.permutation(groups)
        return mixed[int(len(mixed) * test_size) :]

    def run(batches):
        x, labels, ids = shared.value
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                rng = np.random.default_rng([seed, i])
                own = rng.permutation(labels) if i else labels
                trained = [deal(rng, np.unique(ids)) for _ in range(outer)]
                chosen = []
                for groups in trained:
                    use = np.isin(ids, groups)
                    tried = [model._aucs(x[use], own[use], np.isin(ids[use], deal(rng, groups)), ncomp) for _ in range(inner)]
                    most = min(map(len, tried))
                    chosen.append(_enough(np.mean([a[:most] for a in tried], axis=0), least))
                best = int(round(float(np.median(chosen))))
                last = np.array([model._aucs(x, own, np.isin(ids, groups), best)[-1] for groups in trained])
                rows.append((i, best, float(last[~np.isnan(last)].mean()) if not np.isnan(last).all() else float("nan")))
            yield pd.DataFrame(rows, columns=["permutation", "ncomp", "auc"])

    return spark.range(n + 1).repartition(n + 1).mapInPandas(run, "permutation long, ncomp int, auc double")


def kfold_vip(data: DataFrame, y: str, k: int = 4, n: int = 300, ncomp: int = 3) -> DataFrame:
    """(feature, folds, p): in how many folds (i mod k is left out) a feature is relevant, and the one-sided signed-rank p-value of its drops."""
    parts = model.vip_bootstraps(data, y, n, ncomp, k=k)

    def test(pdf):
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "folds": [int(pdf["relevant"].fillna(False).sum())], "p": [kernels.wilcoxon_greater(pdf["mean"].dropna().to_numpy())]})

    return parts.groupBy("feature").applyInPandas(test, "feature int, folds int, p double")


# The data behind plots


def threshold_overlay(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Spectra beside their samples' thresholds."""
    return long.join(thresholds, SAMPLE, "left")


def scores_with_meta(scores: DataFrame, meta: DataFrame, ncomp: int) -> DataFrame:
    """A row a sample, a column a component, with metadata."""
    wide = scores.groupBy(SAMPLE).pivot("comp", list(range(1, ncomp + 1))).agg(F.first("score"))
    return wide.toDF(SAMPLE, *[f"PC{k}" for k in range(1, ncomp + 1)]).join(meta, SAMPLE, "left")


def variances(data: DataFrame, ncomp: int) -> DataFrame:
    """(comp, variance, cumulative): of all components' variance, in percent."""
    _, x = model.matrix(data)
    _, _, var = kernels.pca(x, ncomp)
    total = float(((x - x.mean(0)) ** 2).sum() / max(1, len(x) - 1)) or 1.0
    share = 100 * var / total
    return data.sparkSession.createDataFrame([(k + 1, float(v), float(c)) for k, (v, c) in enumerate(zip(share, np.cumsum(share)))], "comp int, variance double, cumulative double")


def loadings(data: DataFrame, ncomp: int) -> DataFrame:
    """(idx, comp, loading)."""
    _, x = model.matrix(data)
    _, load, _ = kernels.pca(x, ncomp)
    return data.sparkSession.createDataFrame([(i, k + 1, float(v)) for i, row in enumerate(load) for k, v in enumerate(row)], "idx int, comp int, loading double")


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """AUCs of several models, with their names."""
    out = None
    for name, df in results.items():
        one = df.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def peaks_in_window(peaks: DataFrame, lo: float, hi: float) -> DataFrame:
    """Open interval."""
    return peaks.where((F.col("ppm") > lo) & (F.col("ppm") < hi))
