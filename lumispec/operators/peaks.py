"""Peak lists (peak_id, sample_id, ppm, pos, intensity[, ...]) : detection, bounds, acceptance, clustering, tables, look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signif
from .spectra import SAMPLE, in_regions, savgol_second


def local_maxima(spectra: DataFrame, least: float) -> DataFrame:
    """Points over both neighbours and over a threshold."""
    w = Window.partitionBy(SAMPLE).orderBy("idx")
    y = F.col("intensity")
    found = spectra.withColumns({"_l": F.lag(y).over(w), "_r": F.lead(y).over(w)}).where((y > F.col("_l")) & (y > F.col("_r")) & (y > least))
    return found.select(SAMPLE, "ppm", F.col("idx").alias("pos"), "intensity")


def with_ids(peaks: DataFrame) -> DataFrame:
    """peak_id: Peak and a number, in the order of samples and positions, padded to the width of the count.

    Numbers are given in two steps, by sample and within it, so that no task sees all peaks.
    """
    n = peaks.groupBy(SAMPLE).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(SAMPLE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = n.agg(F.length(F.sum("_n").cast("string")).alias("_w"))
    starts = n.select(SAMPLE, before.alias("_b")).crossJoin(F.broadcast(total))
    k = F.col("_b") + F.row_number().over(Window.partitionBy(SAMPLE).orderBy("pos"))
    return peaks.join(starts, SAMPLE).withColumn("peak_id", F.concat(F.lit("Peak"), F.lpad(k.cast("string"), F.col("_w"), F.lit("0")))).drop("_b", "_w")


def accept(peaks: DataFrame, nrmse_max: float = math.inf, area: tuple[float, float] = (-math.inf, math.inf), ppm: tuple[float, float] = (-math.inf, math.inf), excluded: dict | None = None, keep_rejected: bool = False) -> DataFrame:
    """Closed bounds on error, area and position, and no overlap with an excluded region: as a column accepted, or as a filter."""
    ok = F.col("area").between(*map(F.lit, area)) & F.col("ppm").between(*map(F.lit, ppm))
    if "norm_rmse" in peaks.columns:
        ok &= F.col("norm_rmse") <= F.lit(nrmse_max)
    if excluded:
        ok &= ~overlaps(F.col("ppm_infl_min"), F.col("ppm_infl_max"), excluded) if "ppm_infl_min" in peaks.columns else ~in_regions(F.col("ppm"), excluded)
    return peaks.withColumn("accepted", F.coalesce(ok, F.lit(False))) if keep_rejected else peaks.where(ok)


def overlaps(lo: Column, hi: Column, regions: dict) -> Column:
    """Closed intervals that have a point in common."""
    out = F.lit(False)
    for a, b in regions.values():
        out |= (lo <= max(a, b)) & (hi >= min(a, b))
    return out


#: What a Lorentzian's area is taken from: its height, its second derivative at the top, or its height over spectra's column baseline.
AMPLITUDES = ("intensity", "second_derivative", "without_baseline")


def inflections(spectra: DataFrame, peaks: DataFrame, half: int = 10, amplitude: str = "intensity") -> DataFrame:
    """peaks with ppm_infl_min, ppm_infl_max, gamma_ppb and the closed-form area of a Lorentzian.

    The bounds are the sign changes of the second derivative next to the top, on the line between the two points;
    gamma is sqrt(3) / 2 of their distance. Exact zeros are no sign changes. amplitude is one of AMPLITUDES; without a
    second derivative or a baseline at the top there is no area by them.
    """
    if amplitude not in AMPLITUDES:
        raise ValueError(f"amplitude is one of {AMPLITUDES}")
    w = Window.partitionBy(SAMPLE).orderBy("idx")
    d = savgol_second(spectra, half)
    d = d.withColumns({"_pd": F.lag("d2").over(w), "_pp": F.lag("ppm").over(w)})
    cross = F.when(F.signum("d2") * F.signum("_pd") < 0, F.col("_pp") + (F.col("ppm") - F.col("_pp")) * F.col("_pd") / (F.col("_pd") - F.col("d2")))
    d = d.withColumn("_x", cross)
    left = F.last("_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_x", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    top = {"second_derivative": F.col("d2"), "without_baseline": F.col("intensity") - F.col("baseline")}.get(amplitude, F.lit(None))
    at = d.withColumns({"_left": left, "_right": right, "_top": top.cast("double")}).select(SAMPLE, F.col("idx").alias("pos"), F.least("_left", "_right").alias("ppm_infl_min"), F.greatest("_left", "_right").alias("ppm_infl_max"), "_top")
    out = peaks.join(at, [SAMPLE, "pos"], "left")
    gamma = F.lit(math.sqrt(3) / 2) * (F.col("ppm_infl_max") - F.col("ppm_infl_min"))
    area = {
        "intensity": F.lit(math.pi) * gamma * F.col("intensity"),
        "second_derivative": F.lit(-math.pi / 2) * gamma * gamma * gamma * F.col("_top"),
        "without_baseline": F.lit(math.pi) * gamma * F.col("_top"),
    }[amplitude]
    return out.withColumn("gamma_ppb", 1000 * gamma).withColumn("area", area).drop("_top")


def one_per_span(peaks: DataFrame) -> DataFrame:
    """Of a sample's peaks between the same two bounds the highest stays; peaks without bounds all do."""
    w = Window.partitionBy(SAMPLE, "ppm_infl_min", "ppm_infl_max")
    top = peaks.withColumns({"_max": F.max("intensity").over(w), "_n": F.count("*").over(w)})
    return top.where("_n = 1 or intensity = _max or ppm_infl_min is null").drop("_max", "_n")


def overview(peaks: DataFrame, width: float) -> DataFrame:
    """(sample_id, bin, n): peaks in bins (a, b] of the axis; bin is the upper end's number."""
    return peaks.groupBy(SAMPLE, F.ceil(F.col("ppm") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def tune(peaks: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, region, n): how many peaks with an snr over each threshold lie in each half ppm, from one detection."""
    each = peaks.select("ppm", "snr", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("snr > threshold")
    return each.groupBy("threshold", (F.bround(F.col("ppm") / 0.5) * 0.5).alias("region")).agg(F.count("*").alias("n"))


def collected(samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """(sample_id, positions): sorted; empty for a sample without peaks."""
    lists = peaks.groupBy(SAMPLE).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return samples.select(SAMPLE).join(lists, SAMPLE, "left").withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))


#: Peaks that distances() pairs with as many others at once.
BLOCK = 256


def distances(peaks: DataFrame, within: float, factor: float = 3.0) -> DataFrame:
    """(a, b, distance) of peaks less than within apart; two of a sample are factor times as far as the bound.

    Buckets of that width are cut into blocks of about BLOCK peaks. Each two blocks of a bucket or of neighbours are a
    row, met once and dealt over all shuffle partitions, whose pairs are made one by one; so no task holds a bucket.
    """
    placed = peaks.where(F.abs("ppm") < math.inf).select(F.col("peak_id").alias("id"), F.col(SAMPLE).alias("sample"), "ppm", F.floor(F.col("ppm") / (within * (1 + 2**-20))).alias("_k"))
    parts = placed.groupBy("_k").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    cut = placed.join(parts, "_k").groupBy("_k", F.pmod(F.xxhash64("id"), F.col("_n")).alias("_i"))
    blocks = cut.agg(F.collect_list(F.struct("id", "sample", "ppm")).alias("_p"))
    left = blocks.select("_k", F.col("_i").alias("_x"), F.col("_p").alias("_a"))
    right = blocks.select(F.explode(F.array(F.col("_k") - 1, "_k")).alias("_k"), F.col("_k").alias("_own"), F.col("_i").alias("_y"), F.col("_p").alias("_b"))
    met = left.join(right, "_k").where((F.col("_own") > F.col("_k")) | (F.col("_x") <= F.col("_y")))
    met = met.repartition(int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k", "_own", "_x", "_y")
    one = (F.col("_own") == F.col("_k")) & (F.col("_x") == F.col("_y"))
    pairs = met.select(one.alias("_one"), "_b", F.inline("_a")).select("_one", *[F.col(c).alias(f"_{c}") for c in ("id", "sample", "ppm")], F.inline("_b"))
    a, b, d = F.col("_id"), F.col("id"), F.abs(F.col("_ppm") - F.col("ppm"))
    found = pairs.where((d < within) & F.when(F.col("_one"), a < b).otherwise(a != b))
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col("_sample") == F.col("sample"), F.lit(factor * within)).otherwise(d).alias("distance"))


def reference_sample(peaks: DataFrame) -> DataFrame:
    """(sample_id, distance), nearest first: over all other samples, how far each peak of theirs is from its nearest of this one.

    Peaks of all samples are counted by position, so nothing is paired: between two neighbouring peaks of a sample,
    and beyond its first and last, the distances are differences of the counts' running sums, looked up at the two
    peaks and halfway. The running sums have a row for each point of the axis.
    """
    ends = peaks.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    axis = ends.select(F.explode(F.sequence("lo", "hi")).alias("at")).join(peaks.groupBy(F.col("pos").alias("at")).agg(F.count("*").alias("n")), "at", "left")
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce("n", F.lit(0))
    sums = axis.select("at", F.sum(n).over(w).alias("c"), F.sum(n * F.col("at")).over(w).alias("s"))

    def known(name: str) -> DataFrame:
        return sums.select(F.col("at").alias(name), F.col("c").alias(f"c_{name}"), F.col("s").alias(f"s_{name}"))

    each = Window.partitionBy(SAMPLE).orderBy("a")
    spans = peaks.select(SAMPLE, F.col("pos").alias("a")).distinct().withColumns({"b": F.lead("a").over(each), "first": F.lag("a").over(each).isNull()}).withColumn("m", F.floor((F.col("a") + F.col("b")) / 2).cast("int"))
    spans = spans.join(known("a"), "a").join(known("b"), "b", "left").join(known("m"), "m", "left")
    last = sums.agg(F.max("c").alias("c_all"), F.max_by("s", "at").alias("s_all"))
    spans = spans.crossJoin(F.broadcast(last))
    c = F.col
    to_left = (c("s_m") - c("s_a")) - c("a") * (c("c_m") - c("c_a"))
    to_right = c("b") * (c("c_b") - c("c_m")) - (c("s_b") - c("s_m"))
    after = (c("s_all") - c("s_a")) - c("a") * (c("c_all") - c("c_a"))
    before = F.when(c("first"), c("a") * c("c_a") - c("s_a")).otherwise(0)
    return spans.groupBy(SAMPLE).agg(F.sum(before + F.when(c("b").isNull(), after).otherwise(to_left + to_right)).cast("double").alias("distance"))


#: A bucket of the axis has so many gaps' width.
BUCKET = 64


def gap_components(peaks: DataFrame, gap: float, *keys: str) -> DataFrame:
    """Adds component: a run of sorted positions without a gap of gap or more. Each key is a run of its own.

    Runs are counted over distinct positions, in buckets of the axis and then over the buckets, so that no task sees
    more than a bucket's positions or a row a bucket. A null position is before all others.
    """
    places = peaks.select(*keys, "ppm").distinct().withColumn("_b", F.floor(F.col("ppm") / (BUCKET * gap)))
    w = Window.partitionBy(*keys, "_b").orderBy("ppm")
    far = lambda lo, hi: F.when(lo - hi >= gap, 1).otherwise(0)
    runs = places.withColumn("_new", far(F.col("ppm"), F.lag("ppm").over(w))).withColumn("_run", F.sum("_new").over(w))
    over = Window.partitionBy(*keys).orderBy("_b")
    buckets = runs.groupBy(*keys, "_b").agg(F.min("ppm").alias("_lo"), F.max("ppm").alias("_hi"), F.max("_run").alias("_n"))
    buckets = buckets.withColumn("_step", far(F.col("_lo"), F.lag("_hi").over(over)) + F.coalesce(F.lag("_n").over(over), F.lit(0)))
    buckets = buckets.withColumn("_base", F.sum("_step").over(over)).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bucket"), "_base")
    same = F.col("_b").eqNullSafe(F.col("_bucket"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    found = runs.join(buckets, same).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("ppm").alias("_ppm"), (F.col("_base") + F.col("_run")).alias("component"))
    at = F.col("ppm").eqNullSafe(F.col("_ppm"))
    for i, k in enumerate(keys):
        at &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return peaks.join(found, at).drop("_ppm", *[f"_key{i}" for i in range(len(keys))])


def cluster_ranges(clustered: DataFrame) -> DataFrame:
    """(cluster, range): how far a cluster's peaks are apart."""
    return clustered.groupBy("cluster").agg((F.max("ppm") - F.min("ppm")).alias("range"))


def widest_cluster(clustered: DataFrame) -> DataFrame:
    """One row, range: of the cluster whose peaks are farthest apart."""
    return cluster_ranges(clustered).agg(F.max("range").alias("range"))


def cluster_bounds(peaks: DataFrame) -> DataFrame:
    """One row, (least, most): no fewer clusters than the peaks of one sample, no more than peaks."""
    return peaks.groupBy(SAMPLE).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("least"), F.sum("_n").alias("most"))


def linkage_table(peaks: DataFrame, cuts_ppb: list[float]) -> DataFrame:
    """(max_ppb, clusters, range): the number of clusters and the widest one for each cut, narrowest first."""
    out = None
    for cut in sorted(cuts_ppb):
        found = linkage(peaks, cut)
        one = found.agg(F.lit(float(cut)).alias("max_ppb"), F.countDistinct("cluster").alias("clusters")).crossJoin(widest_cluster(found))
        out = one if out is None else out.unionByName(one)
    return out


def linkage_to(peaks: DataFrame, num_clusters: int, cuts_ppb: list[float]) -> DataFrame:
    """linkage() at the cut, of those given, that has the number of clusters asked for or comes nearest, the wider one of equals."""
    bounds = cluster_bounds(peaks).first()
    if not bounds["least"] <= num_clusters <= bounds["most"]:
        raise ValueError(f"between {bounds['least']} and {bounds['most']} clusters are possible")
    table = linkage_table(peaks, cuts_ppb).collect()  # a row a cut
    best = min(table, key=lambda r: (abs(r["clusters"] - num_clusters), -r["max_ppb"]))
    return linkage(peaks, best["max_ppb"])


def ids_of_samples(peaks: DataFrame) -> DataFrame:
    """(sample_id, peak_ids): sorted."""
    return peaks.groupBy(SAMPLE).agg(F.sort_array(F.collect_list("peak_id")).alias("peak_ids"))


def ambiguous_cells(peaks: DataFrame) -> DataFrame:
    """(sample_id, ppm_ref, peak_ids) of the cells with several peaks."""
    cells = peaks.groupBy(SAMPLE, "ppm_ref").agg(F.sort_array(F.collect_list("peak_id")).alias("peak_ids"))
    return cells.where(F.size("peak_ids") > 1)


def digits(threshold_ppb: float) -> int:
    return min(4, 3 - math.floor(math.log10(threshold_ppb)) + 1)


def default_threshold(peaks: DataFrame) -> DataFrame:
    return peaks.agg(signif(3 * F.median("gamma_ppb"), 2).alias("threshold"))


def linkage(peaks: DataFrame, max_ppb: float) -> DataFrame:
    """Adds cluster and ppm_ref. Complete linkage, cut where a merge would be max_ppb or wider or join two peaks of a sample; components that a gap sets apart are solved each by itself."""
    from .kernels import complete_linkage

    cut = max_ppb / 1000
    parts = gap_components(peaks, cut)
    schema = f"peak_id string, cluster string"

    def solve(pdf):
        pdf = pdf.sort_values(["ppm", "peak_id"])  # ties are merged in this order
        out = complete_linkage(pdf["ppm"].to_numpy(), pdf[SAMPLE].to_numpy(), cut)
        first = int(pdf["component"].iloc[0])
        return pdf[["peak_id"]].assign(cluster=[f"{first}_{k}" for k in out])

    found = parts.select("peak_id", SAMPLE, "ppm", "component").groupBy("component").applyInPandas(solve, schema)
    out = peaks.join(found, "peak_id")
    middle = out.groupBy("cluster").agg(F.bround(F.median("ppm"), digits(max_ppb)).alias("ppm_ref"))
    return out.join(middle, "cluster")


def ambiguous(peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(peaks alone in their cell of sample and ppm_ref, the others)."""
    n = peaks.withColumn("_n", F.count("*").over(Window.partitionBy(SAMPLE, "ppm_ref")))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").drop("_n")


def peak_table(peaks: DataFrame, samples: DataFrame | None, features: list, feature: str = "ppm_ref", area: str = "area") -> DataFrame:
    """A row a sample, a column a feature; samples without peaks have nulls."""
    table = peaks.groupBy(SAMPLE).pivot(feature, features).agg(F.sum(area))
    return table if samples is None else samples.select(SAMPLE).join(table, SAMPLE, "left")


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two peak lists side by side by a full outer join, with where each row is found."""
    a, b = left.select(F.col(key).alias("_a"), F.col("ppm").alias("left_ppm")), right.select(F.col(key).alias("_b"), F.col("ppm").alias("right_ppm"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    where = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return both.select(F.coalesce("_a", "_b").alias(key), "left_ppm", "right_ppm", where.alias("found"))


def identify(ppm: DataFrame, lookup: DataFrame, n: int, tolerance: float = 0.015, order: list[Column] | None = None) -> DataFrame:
    """For each ppm the first n compounds, in the look-up's own order, whose shift is less than the tolerance away; rows up to n are filled with nulls.

    lookup: ordinal, shift and more. The range join is an equi-join on buckets of twice the tolerance.
    """
    wide = 2 * tolerance
    queries = ppm.select("ppm").distinct()
    cut = F.floor(F.col("ppm") / wide)
    q = queries.select("ppm", F.explode(F.array(cut - 1, cut, cut + 1)).alias("_k"))
    found = q.join(lookup.withColumn("_k", F.floor(F.col("shift") / wide)), "_k").where((F.col("shift") > F.col("ppm") - tolerance) & (F.col("shift") < F.col("ppm") + tolerance))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("ppm").orderBy("ordinal"))).where(F.col("nth") <= n).drop("_k")
    rows = queries.select("ppm", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("nth"))
    out = rows.join(found, ["ppm", "nth"], "left")
    return out.orderBy("ppm", *order) if order else out
