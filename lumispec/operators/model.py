"""Multivariate operators: outliers, cross-validation, choice of components, stability, and the numeric kernels by sample.

Per-sample kernels run in mapInPandas over array spectra, without a shuffle. Models see a matrix of samples by
positions; like the sets they stand for, these are bounded by MATRIX values, which is checked before they are gathered.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_rank
from . import kernels
from .spectra import SAMPLE

#: Slices of a range of values that are sorted each by itself.
SLICES = 4096
#: Samples that a kernel takes at once, and values of its results that a worker holds.
ROWS, VALUES = 512, 1 << 17
#: Samples times positions that one model may take.
MATRIX = 50_000_000


# Native expressions


def gap_threshold(values: DataFrame, x: str = "x", most: float = 0.1) -> DataFrame:
    """One row, threshold: the middle of the widest gap of the sorted values; infinite if more than a share of most lies over it."""
    ends = values.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    share = F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    placed = values.select(x).where(F.col(x).isNotNull()).distinct().crossJoin(F.broadcast(ends)).withColumn("_b", F.floor(F.coalesce(share, F.lit(0.0)) * SLICES))
    within = placed.select(x, (F.lead(x).over(Window.partitionBy("_b").orderBy(x)) - F.col(x)).alias("_g"))
    slices = placed.groupBy("_b").agg(F.min(x).alias("_least"), F.max(x).alias(x))  # SLICES rows at most
    between = slices.select(x, (F.lead("_least").over(Window.orderBy("_b")) - F.col(x)).alias("_g"))
    gaps = within.unionByName(between)
    t = gaps.agg(F.coalesce(F.max_by(F.col(x) + F.col("_g") / 2, "_g"), F.max(x)).alias("_t"))
    over = values.crossJoin(F.broadcast(t)).agg(F.first("_t").alias("_t"), F.avg((F.col(x) > F.col("_t")).cast("double")).alias("_o"))
    return over.select(F.when(F.col("_o") > most, F.lit(float("inf"))).otherwise(F.col("_t")).alias("threshold"))


def cumulative(variances: DataFrame) -> DataFrame:
    """Adds cumulative, the share in percent that the components up to comp explain."""
    total = F.sum("variance").over(Window.partitionBy())
    return variances.withColumn("cumulative", 100 * F.sum("variance").over(Window.orderBy("comp")) / total)


def subsample(groups: DataFrame, iterations: int, test_size: float, seed: int = 0, balance: str | None = None) -> DataFrame:
    """(iteration, group, role): whole groups to test or train, in the order of a hash.

    With balance, a column with one value a group, every class gives the same number of groups to train.
    """
    if not 0 < test_size < 1:
        raise ValueError("the test set takes a share between 0 and 1")
    keys = ["group"] + [balance] * bool(balance)
    each = groups.select(*keys).distinct().withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = F.md5(F.concat_ws("_", F.col("group").cast("string"), F.col("iteration").cast("string"), F.lit(str(seed))))
    if balance is None:
        n = F.count("*").over(Window.partitionBy("iteration"))
        r = F.row_number().over(Window.partitionBy("iteration").orderBy(order, "group"))
        return each.select("iteration", "group", F.when(r <= F.floor(n * test_size), "test").otherwise("train").alias("role"))
    size = groups.select(*keys).distinct().groupBy(balance).count().agg(F.min("count").alias("_s"))
    train = F.greatest(F.floor(F.col("_s") * (1 - test_size)), F.lit(1))
    r = F.row_number().over(Window.partitionBy("iteration", balance).orderBy(order, "group"))
    return each.crossJoin(F.broadcast(size)).select("iteration", "group", F.when(r <= train, "train").otherwise("test").alias("role"))


def checked_splits(splits: DataFrame, *keys: str) -> DataFrame:
    """splits, or a ValueError if a split has an empty side or a group on both; keys: the columns that name a split."""
    sides = splits.groupBy(*keys).agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))
    both = splits.groupBy(*keys, "group").agg(F.countDistinct("role").alias("roles")).where("roles > 1")
    if not sides.where("train = 0 or test = 0").isEmpty():
        raise ValueError("a split has an empty side")
    if not both.isEmpty():
        raise ValueError("a group stands on both sides of a split")
    return splits


def double_splits(groups: DataFrame, outer: int, inner: int, outer_size: float, inner_size: float, seed: int = 0) -> DataFrame:
    """(outer, inner, group, role): inner is null for the outer splits; the inner ones deal out each outer training set."""
    first = subsample(groups, outer, outer_size, seed).withColumnRenamed("iteration", "outer")
    kept = first.where("role = 'train'").select("outer", "group").withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    order = F.md5(F.concat_ws("_", F.col("group").cast("string"), "outer", "inner", F.lit(str(seed))))
    n = F.count("*").over(Window.partitionBy("outer", "inner"))
    r = F.row_number().over(Window.partitionBy("outer", "inner").orderBy(order, "group"))
    second = kept.select("outer", "inner", "group", F.when(r <= F.floor(n * inner_size), "test").otherwise("train").alias("role"))
    return first.select("outer", F.lit(None).cast("int").alias("inner"), "group", "role").unionByName(second)


def choose_ncomp(aucs: DataFrame, least: float, *keys: str) -> DataFrame:
    """For each key the first ncomp after which the AUC grows by less than least; the last if it always does; the first if nothing is known."""
    step = F.lead("auc").over(Window.partitionBy(*keys).orderBy("ncomp")) - F.col("auc")
    each = aucs.withColumn("_d", step).groupBy(*keys).agg(F.min(F.when(F.col("_d") < least, F.col("ncomp"))).alias("_a"), F.max("ncomp").alias("_b"), F.min("ncomp").alias("_c"), F.count("auc").alias("_n"))
    return each.select(*keys, F.when(F.col("_n") == 0, F.col("_c")).otherwise(F.coalesce("_a", "_b")).alias("ncomp"))


def best_ncomp(by_fold: DataFrame) -> DataFrame:
    return by_fold.agg(F.bround(F.median("ncomp")).cast("int").alias("ncomp"))


def rank_product(vips: DataFrame, *keys: str) -> DataFrame:
    """(feature, rank_product): the geometric mean over folds of a feature's rank, largest importance first, ties sharing ranks."""
    ranked = vips.withColumn("_r", average_rank(F.col("vip"), True, *keys))
    return ranked.groupBy("feature").agg(F.exp(F.avg(F.log("_r"))).alias("rank_product"))


def stability(loadings: DataFrame) -> DataFrame:
    """(m1, m2, dot) of all models' loadings; loadings: model, feature, weight, few models."""
    a = loadings.select(F.col("model").alias("m1"), "feature", F.col("weight").alias("_a"))
    b = loadings.select(F.col("model").alias("m2"), "feature", F.col("weight").alias("_b"))
    return a.join(b, "feature").groupBy("m1", "m2").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def class_accuracy(df: DataFrame, real: str, predicted: str) -> DataFrame:
    """(class, accuracy): of all rows, those of the class that are predicted so."""
    cells = df.groupBy(real, predicted).agg(F.count("*").alias("_n"))
    total = cells.agg(F.sum("_n").alias("_t"))
    right = cells.groupBy(F.col(real).alias("class")).agg(F.sum(F.when(F.col(real) == F.col(predicted), F.col("_n")).otherwise(0)).alias("_r"))
    return right.crossJoin(F.broadcast(total)).select("class", (F.col("_r") / F.col("_t")).alias("accuracy"))


def ecdf(df: DataFrame, column: str, at: float) -> DataFrame:
    return df.agg(F.avg((F.col(column) <= at).cast("double")).alias("p"))


def in_all(df: DataFrame, feature: str, fold: str, n: int) -> DataFrame:
    """Features that every one of n folds has chosen."""
    return df.groupBy(feature).agg(F.countDistinct(fold).alias("_n")).where(F.col("_n") == n).select(feature)


# Kernels by sample; spectra: sample_id, ppm, intensity as arrays


def _each(spectra: DataFrame, schema: str, f) -> DataFrame:
    """f(row) -> rows; a frame is given out for ROWS rows, or sooner, once theirs hold VALUES values, however large Spark's batches are."""
    return _several(spectra, schema, lambda rows: (r for row in rows for r in f(row)))


def _several(spectra: DataFrame, schema: str, f) -> DataFrame:
    """_each() with f(rows of at most ROWS samples) -> rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), ROWS):
                out, held = [], 0
                for r in f(list(pdf.iloc[start : start + ROWS].itertuples(index=False))):
                    out.append(r)
                    held += sum(len(v) if isinstance(v, (list, np.ndarray)) else 1 for v in r)
                    if held >= VALUES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    return spectra.mapInPandas(run, schema)


def _id_type(df: DataFrame) -> str:
    return df.schema[SAMPLE].dataType.simpleString()


def baseline(spectra: DataFrame, lam: float = 9.0, p: float = 0.05, maxit: int = 20, remove: bool = False) -> DataFrame:
    """Adds baseline, or with remove takes it off the intensity."""

    def one(row):
        y = np.asarray(row.intensity, float)
        z = kernels.als(y, lam, p, maxit)
        return [(row.sample_id, row.ppm, (y - z).tolist() if remove else row.intensity, z.tolist())]

    out = _each(spectra.select(SAMPLE, "ppm", "intensity"), f"{SAMPLE} {_id_type(spectra)}, ppm array<double>, intensity array<double>, baseline array<double>", one)
    return out.drop("baseline") if remove else out


def common_axis(spectra: DataFrame) -> tuple[float, float, float]:
    """(least, largest, step): what all samples' axes cover, in the smallest of their median steps; nulls if no sample has two points."""
    ppm = F.col("ppm")
    steps = F.sort_array(F.zip_with(F.slice(ppm, F.lit(2), F.size(ppm) - 1), F.slice(ppm, F.lit(1), F.size(ppm) - 1), lambda a, b: F.abs(a - b)))
    middle = (F.get(steps, F.floor((F.size(steps) - 1) / 2).cast("int")) + F.get(steps, F.floor(F.size(steps) / 2).cast("int"))) / 2
    used = spectra.where(F.size(ppm) > 1)
    return tuple(used.agg(F.max(F.array_min(ppm)), F.min(F.array_max(ppm)), F.min(middle)).first())


def interpolate(spectra: DataFrame, axis: tuple | None = None) -> DataFrame:
    """Onto a regular axis (least, largest, step); null outside a sample's own. Without a step, or without an axis, these are the samples' own, see common_axis()."""
    if axis is None or len(axis) == 2:
        own = common_axis(spectra)
        axis = own if axis is None else (*axis, own[2])
    lo, hi, by = axis
    if lo is None or by is None or hi < lo:
        raise ValueError("the samples have no axis in common")
    at = lo + by * np.arange(int(np.floor((hi - lo) / by + 1e-9)) + 1)

    axis = at.tolist()

    def one(row):
        y = kernels.spline(np.asarray(row.ppm, float), np.asarray(row.intensity, float), at)
        return [(row.sample_id, axis, [None if v != v else v for v in y.tolist()])]

    return _each(spectra.select(SAMPLE, "ppm", "intensity"), f"{SAMPLE} {_id_type(spectra)}, ppm array<double>, intensity array<double>", one)


def detect(spectra: DataFrame, snr: float = 3.0, least: float = -np.inf) -> DataFrame:
    """(sample_id, ppm, pos, intensity, snr) of wavelet ridges."""

    def one(row):
        y = np.asarray(row.intensity, float)
        return [(row.sample_id, float(row.ppm[p]), int(p), float(y[p]), s) for p, s in kernels.cwt_peaks(y, snr=snr, least=least)]

    return _each(spectra.select(SAMPLE, "ppm", "intensity"), f"{SAMPLE} {_id_type(spectra)}, ppm double, pos int, intensity double, snr double", one)


def refine(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """(sample_id, pos, ppm, gamma_ppb, area, norm_rmse, refined): peaks fitted between their bounds, those of ROWS samples side by side, by their number of points."""
    lists = peaks.groupBy(SAMPLE).agg(F.sort_array(F.collect_list(F.struct("pos", "ppm", "gamma_ppb", "area", "ppm_infl_min", "ppm_infl_max"))).alias("peaks"))

    def some(rows):
        by = {}
        for row in rows:
            x, y = np.asarray(row.ppm, float), np.asarray(row.intensity, float)
            for p in row.peaks:
                part = (x >= p["ppm_infl_min"]) & (x <= p["ppm_infl_max"])
                if (n := part.sum()) < 4:
                    part[max(0, p["pos"] - 2) : p["pos"] + 3] = True
                    n = part.sum()
                by.setdefault(int(n), []).append((row.sample_id, p["pos"], x[part], y[part], (p["ppm"], p["gamma_ppb"] / 1000, p["area"])))
        for group in by.values():
            ids, at, x, o, start = zip(*group)
            x, o = np.array(x), np.array(o)
            p, good = kernels.fit_lorentzians(x, o, np.array(start, float))
            f, top = kernels.lorentz(x, p[:, :1], p[:, 1:2], p[:, 2:]), o.argmax(1)[:, None]
            off = (o - np.take_along_axis(o, top, 1)) - (f - np.take_along_axis(f, top, 1))
            reach = np.ptp(o, axis=1)
            error = np.sqrt((off**2).mean(1)) / np.where(reach == 0, 1, reach)
            yield from zip(ids, map(int, at), p[:, 0].tolist(), (1000 * p[:, 1]).tolist(), p[:, 2].tolist(), error.tolist(), good.tolist())

    return _several(spectra.join(lists, SAMPLE), f"{SAMPLE} {_id_type(spectra)}, pos int, ppm double, gamma_ppb double, area double, norm_rmse double, refined boolean", some)


def align(spectra: DataFrame, positions: DataFrame, reference, most: int | None = None, most_ppm: float = 0.0015) -> DataFrame:
    """All samples shifted onto the reference, segment by segment, by at most so many points, or the points that cover most_ppm. positions: (sample_id, positions)."""
    if most is None:
        most = math.ceil(most_ppm / common_axis(spectra)[2])
    both = spectra.join(positions, SAMPLE)
    ref = both.where(F.col(SAMPLE) == F.lit(reference)).select("intensity", "positions").collect()  # one sample
    if len(ref) != 1:
        raise ValueError("there must be one reference sample")
    y, p = np.array(ref[0][0], float), list(ref[0][1])

    def one(row):
        return [(row.sample_id, row.ppm, kernels.align(np.asarray(row.intensity, float), y, list(row.positions), p, most).tolist())]

    return _each(both, f"{SAMPLE} {_id_type(spectra)}, ppm array<double>, intensity array<double>", one)


# Models


def matrix(spectra: DataFrame, *more: str, used: float = 1.0) -> tuple[pd.DataFrame, np.ndarray]:
    """Metadata and matrix of a set of samples, in the order of their ids, if a model, which takes the share used of it, takes at most MATRIX values."""
    size = spectra.agg(F.sum(F.size("intensity"))).first()[0] or 0
    if size * used > MATRIX:
        raise ValueError(f"{size} values; a model takes at most {MATRIX}")
    table = spectra.select(SAMPLE, "intensity", *more).orderBy(SAMPLE).toArrow()
    arrays, meta = table.column("intensity"), table.drop_columns("intensity").to_pandas()
    del table
    if arrays.null_count or len(set(pc.unique(pc.list_value_length(arrays)).to_pylist())) > 1:
        raise ValueError("the samples have not as many points each")
    return meta, np.concatenate([pc.list_flatten(a).to_numpy(zero_copy_only=False) for a in arrays.chunks] or [np.empty(0)]).astype(float, copy=False).reshape(len(meta), -1 if len(meta) else 0)


def pca_scores(spectra: DataFrame, ncomp: int) -> DataFrame:
    """(sample_id, comp, score)."""
    meta, x = matrix(spectra)
    scores, _, _ = kernels.pca(x, ncomp)
    rows = [(i, k + 1, float(v)) for i, row in zip(meta[SAMPLE].tolist(), scores) for k, v in enumerate(row)]
    return spectra.sparkSession.createDataFrame(rows, f"{SAMPLE} {_id_type(spectra)}, comp int, score double")


def outliers(spectra: DataFrame, ncomp: int | None = None, q: float = 0.975, robust: bool = False) -> DataFrame:
    """(sample_id, t, q, t_limit, q_limit, outlier): distances inside and from the plane of the first components.

    Without ncomp: as many as explain over 90 %. robust: columns by their medians and deviations, projection pursuit, and limits in the widest gaps.
    """
    meta, x = matrix(spectra)
    if robust:
        centre = np.median(x, 0)
        scale = 1.4826 * np.median(np.abs(x - centre), 0)
        x = (x - centre) / np.where(scale > 0, scale, 1)
        scores, load, var = kernels.robust_pca(x, min(ncomp or 5, len(x) - 1))
        rest = x - np.median(x, 0)
    else:
        scores, load, var = kernels.pca(x, ncomp or min(x.shape))
        if ncomp is None:
            k = int(np.argmax(np.cumsum(var) / ((x - x.mean(0)) ** 2).sum() * (len(x) - 1) > 0.9)) + 1
            scores, load, var = scores[:, :k], load[:, :k], var[:k]
        rest = x - x.mean(0)
    t = np.sqrt((scores**2 / np.where(var > 0, var, np.inf)).sum(1))
    d = np.sqrt(((rest - scores @ load.T) ** 2).sum(1))
    if robust:
        limits = [_gap_limit(t), _gap_limit(d)]
    else:
        power = d ** (2 / 3)
        spread = 1.4826 * np.median(np.abs(power - np.median(power)))
        limits = [kernels.chi2_quantile(q, scores.shape[1]) ** 0.5, float((np.median(power) + spread * NormalDist().inv_cdf(q)) ** 1.5)]
    rows = [(i, float(a), float(b), *map(float, limits), bool(a >= limits[0] or b >= limits[1])) for i, a, b in zip(meta[SAMPLE].tolist(), t, d)]
    return spectra.sparkSession.createDataFrame(rows, f"{SAMPLE} {_id_type(spectra)}, t double, q double, t_limit double, q_limit double, outlier boolean")


def _gap_limit(v: np.ndarray) -> float:
    s = np.sort(v)
    k = int(np.argmax(np.diff(s)))
    limit = float((s[k] + s[k + 1]) / 2)
    return limit if (v > limit).mean() <= 0.1 else float("inf")


def _one_hot(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(y)
    return names, (y[:, None] == names[None]).astype(float)


def _aucs(x, y, train, ncomp) -> list[float]:
    """The mean one-against-rest AUC on the test samples, for each number of components."""
    names = np.unique(y)
    m = kernels.pls_of_rows(x, train, (y[train][:, None] == names[None]).astype(float), ncomp)
    return _aucs_of(m, x, y, train, names)


def _aucs_of(m, x, y, train, names) -> list[float]:
    """_aucs() of a fit."""
    out = []
    for k in range(1, len(m["coefs"]) + 1):
        p = np.concatenate([kernels.pls_predict(m, part, k) for part in kernels.stretches(x, ~train)])
        use = [1] if len(names) == 2 else range(len(names))
        with np.errstate(invalid="ignore"):
            out.append(float(np.nanmean([kernels.auc(p[:, c], y[~train] == names[c]) for c in use])))
    return out


def _roles(spark, ids: pd.Series, iterations: int, test_size: float, seed: int) -> pd.DataFrame:
    groups = spark.createDataFrame(pd.DataFrame({"group": ids.drop_duplicates()}))
    return subsample(groups, iterations, test_size, seed).toPandas()


def plsda_cv(spectra: DataFrame, y: str, identity: str = SAMPLE, iterations: int = 10, test_size: float = 0.25, ncomp: int = 5, seed: int = 0) -> DataFrame:
    """(iteration, ncomp, auc): splits run as tasks; whole groups of identity are trained or tested."""
    spark = spectra.sparkSession
    meta, x = matrix(spectra, *{y, identity} - {SAMPLE})
    labels, ids, roles = meta[y].to_numpy(), meta[identity], _roles(spark, meta[identity], iterations, test_size, seed)
    test = {i: set(g["group"]) for i, g in roles[roles["role"] == "test"].groupby("iteration")}
    shared = spark.sparkContext.broadcast((x, labels, ids.to_numpy(), test))

    def run(batches):
        x, labels, ids, test = shared.value
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                train = np.array([g not in test.get(i, ()) for g in ids])
                rows += [(i, k + 1, a) for k, a in enumerate(_aucs(x, labels, train, ncomp))]
            yield pd.DataFrame(rows, columns=["iteration", "ncomp", "auc"])

    return spark.range(iterations).repartition(iterations).mapInPandas(run, "iteration long, ncomp int, auc double")


def permutation_test(spectra: DataFrame, y: str, n: int = 50, ncomp: int = 3, test_size: float = 0.25, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(permutation, auc): mean test AUC; permutation 0 has the true classes, the others shuffled ones."""
    spark = spectra.sparkSession
    meta, x = matrix(spectra, y)
    shared = spark.sparkContext.broadcast((x, meta[y].to_numpy()))

    def run(batches):
        x, labels = shared.value
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                rng = np.random.default_rng([seed, i])
                own = rng.permutation(labels) if i else labels
                each = []
                for _ in range(iterations):
                    train = np.ones(len(x), bool)
                    train[rng.permutation(len(x))[: int(len(x) * test_size)]] = False
                    each.append(_aucs(x, own, train, ncomp)[-1])
                rows.append((i, float(np.nanmean(each))))
            yield pd.DataFrame(rows, columns=["permutation", "auc"])

    return spark.range(n + 1).repartition(n + 1).mapInPandas(run, "permutation long, auc double")


def vip_bootstrap(spectra: DataFrame, y: str, n: int = 300, ncomp: int = 3, seed: int = 0) -> DataFrame:
    """(feature, mean, error, important, relevant): how much a feature's importance drops when its column is shuffled, over n bootstraps, in units of its own deviation."""
    return vip_bootstraps(spectra, y, n, ncomp, seed).drop("fold")


def vip_bootstraps(spectra: DataFrame, y: str, n: int, ncomp: int, seed: int = 0, k: int | None = None) -> DataFrame:
    """vip_bootstrap() with a column fold; with k for each of k folds, with seed + fold, over all samples but those whose number mod k is the fold. The samples are gathered and sent out once, whatever k."""
    spark, folds = spectra.sparkSession, k or 1
    meta, x = matrix(spectra, y, used=1 - 1 / k if k else 1.0)
    shared = spark.sparkContext.broadcast((x, meta[y].to_numpy()))

    def run(batches):
        x, labels = shared.value
        for pdf in batches:
            for at in pdf["id"].tolist():
                fold, i = divmod(at, n)
                rows = np.flatnonzero(np.arange(len(x)) % k != fold) if k else np.arange(len(x))
                rng = np.random.default_rng([seed + fold, i])
                pick = rows[rng.integers(0, len(rows), len(rows))]
                drops = kernels.vip_drops(x, _one_hot(labels[pick])[1], ncomp, rng, rows=pick)
                yield pd.DataFrame({"fold": fold, "feature": np.arange(len(drops)), "drop": drops})

    drops = spark.range(folds * n).repartition(folds * min(n, 64)).mapInPandas(run, "fold int, feature int, drop double")
    t = kernels.t_quantile(0.975, n - 1)
    each = drops.groupBy("fold", "feature").agg(F.avg("drop").alias("_m"), F.stddev_samp("drop").alias("_s"))
    mean = F.try_divide("_m", "_s")
    return each.select("fold", "feature", mean.alias("mean"), F.lit(t).alias("error"), (mean - t > t).alias("important"), (mean - t > 0).alias("relevant"))
