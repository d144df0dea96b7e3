"""Operators on spectra in the long layout (sample_id, idx, ppm, intensity[, baseline]) and on their metadata.

All are DataFrame expressions: per-sample work is grouped by sample_id, per-position work by idx, and single numbers
(a median of factors, a threshold) are one-row frames joined in, so that a plan stays lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MAD

SAMPLE = "sample_id"
#: Positions that a range without peaks needs.
NOISE_POINTS = 10


# Layouts and projections


def from_arrays(df: DataFrame, ppm: Column, intensity: str = "intensity") -> DataFrame:
    """Long spectra of one array a sample; ppm: an expression of idx."""
    return df.select(SAMPLE, F.posexplode(intensity).alias("idx", "intensity")).select(SAMPLE, "idx", ppm.alias("ppm"), F.col("intensity").cast("double").alias("intensity"))


def to_arrays(spectra: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("idx", "ppm", "intensity")))
    return spectra.groupBy(SAMPLE).agg(rows.alias("r")).select(SAMPLE, F.col("r.ppm").alias("ppm"), F.col("r.intensity").alias("intensity"))


def tidy(spectra: DataFrame, meta: DataFrame | None = None, ppm_range: tuple[float, float] | None = None, every: int = 1) -> DataFrame:
    """Long spectra inside a closed range, every k-th point of the whole axis, with metadata joined."""
    if every > 1:
        spectra = spectra.where(F.pmod("idx", F.lit(every)) == 0)
    if ppm_range:
        spectra = spectra.where(F.col("ppm").between(*ppm_range))
    return spectra if meta is None else spectra.join(meta, SAMPLE, "left")


def in_regions(ppm: Column, regions: dict[str, tuple[float, float]]) -> Column:
    """Closed intervals."""
    return reduce(lambda a, b: a | b, (ppm.between(min(r), max(r)) for r in regions.values()), F.lit(False))


def exclude_regions(spectra: DataFrame, regions: dict[str, tuple[float, float]]) -> DataFrame:
    return spectra.where(~in_regions(F.col("ppm"), regions)) if regions else spectra


def filter_samples(spectra: DataFrame, meta: DataFrame, condition: str) -> DataFrame:
    """Spectra of the samples whose metadata meet a condition in SQL; unknown is dropped."""
    return spectra.join(meta.where(F.expr(condition)).select(SAMPLE), SAMPLE, "left_semi")


def rename_samples(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """old -> new; two samples may not get one name."""
    if len(set(names.values())) < len(names):
        raise ValueError("two samples would get one name")
    new = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    out = df if new is None else df.withColumn(SAMPLE, F.coalesce(F.try_element_at(new, F.col(SAMPLE)), F.col(SAMPLE)))
    return out


# Metadata


def meta_join(groups: list[DataFrame], key: str = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """All groups side by side, by left joins; columns: only these, with the key first."""
    out = reduce(lambda a, b: a.join(b, key, "left"), groups)
    if columns is None:
        return out
    missing = [c for c in columns if c not in out.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing[:9] if len(missing) <= 9 else missing[:5])}")
    return out.select(key, *[c for c in columns if c != key])


def first_rows(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(ordinal)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(left: DataFrame, right: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """For each shared column how many rows differ, null equal to null."""
    both = left.select(by, *columns).join(right.select(by, *[F.col(c).alias(f"_r_{c}") for c in columns]), by, "left")
    return both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(f"{c}_conflicts") for c in columns])


def meta_add(meta: DataFrame, extra: DataFrame, by: str, ordinal: str) -> DataFrame:
    """meta with the columns of extra, whose first row by ordinal counts for a key; columns that meta has must agree."""
    extra = first_rows(extra, by, ordinal).drop(ordinal)
    shared = [c for c in extra.columns if c in meta.columns and c != by]
    if shared:
        found = conflicts(meta, extra, by, shared).first().asDict()
        wrong = [c for c in shared if found[f"{c}_conflicts"]]
        if wrong:
            raise ValueError(f"columns with other values: {', '.join(wrong)}")
    return meta.join(extra.drop(*shared), by, "left")


def complete(df: DataFrame, subject: str, n: int) -> DataFrame:
    """Rows of the subjects that have exactly n rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(subject))).where(F.col("_n") == n).drop("_n")


# The axis


def axis_bounds(raw: DataFrame, x: str = "x") -> DataFrame:
    """lo (largest of the samples' least), hi (smallest of their largest), by (smallest median distance): one row. raw: (sample_id, x)."""
    step = F.abs(F.col(x) - F.lag(x).over(Window.partitionBy(SAMPLE).orderBy(x)))
    each = raw.withColumn("_step", step).groupBy(SAMPLE).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.median("_step").alias("by"))
    return each.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.min("by").alias("by"))


def resolution(spectra: DataFrame) -> DataFrame:
    """(sample_id, resolution): the median distance of neighbouring points."""
    step = F.abs(F.col("ppm") - F.lag("ppm").over(Window.partitionBy(SAMPLE).orderBy("idx")))
    return spectra.withColumn("_step", step).groupBy(SAMPLE).agg(F.median("_step").alias("resolution"))


# Normalisation


def corrected(spectra: DataFrame) -> Column:
    return F.col("intensity") - F.coalesce(F.col("baseline"), F.lit(0.0)) if "baseline" in spectra.columns else F.col("intensity")


def factors(spectra: DataFrame, method: str = "area", regions: tuple[float, float] | None = None, values: DataFrame | None = None) -> DataFrame:
    """(sample_id, factor, relative): relative is over the median of all factors. method: area, max, region, value, none, pqn."""
    y = corrected(spectra)
    if method == "pqn":
        return quotients(spectra)
    if method == "value":
        each = values.select(SAMPLE, F.col("value").alias("factor"))
    elif method == "region":
        each = spectra.where(F.col("ppm").between(*regions)).groupBy(SAMPLE).agg(F.sum("intensity").alias("factor"))
    elif method in ("area", "max", "none"):
        how = {"area": F.sum(y), "max": F.max(y), "none": F.first(F.lit(1.0))}[method]
        each = spectra.groupBy(SAMPLE).agg(how.alias("factor"))
    else:
        raise ValueError(f"no such method: {method}")
    middle = each.agg(F.median("factor").alias("_m"))
    return each.crossJoin(F.broadcast(middle)).select(SAMPLE, "factor", F.try_divide("factor", "_m").alias("relative"))


def quotients(spectra: DataFrame) -> DataFrame:
    """Probabilistic quotients: areas to one, shift if anything is below zero, medians over samples, and each sample's median quotient."""
    area = factors(spectra, "area").select(SAMPLE, F.col("relative").alias("_area"))
    scaled = spectra.join(area, SAMPLE).withColumn("_y", F.try_divide("intensity", "_area"))
    low = scaled.agg(F.least(F.min("_y"), F.lit(0.0)).alias("_low"))
    scaled = scaled.crossJoin(F.broadcast(low)).withColumn("_y", F.col("_y") - F.col("_low"))
    middle = scaled.groupBy("idx").agg(F.median("_y").alias("_m"))
    each = scaled.join(middle, "idx").groupBy(SAMPLE).agg(F.median(F.try_divide("_y", "_m")).alias("_q"), F.first("_area").alias("_area"))
    out = each.select(SAMPLE, (F.col("_q") * F.col("_area")).alias("factor"))
    return out.crossJoin(F.broadcast(out.agg(F.median("factor").alias("_m")))).select(SAMPLE, "factor", F.try_divide("factor", "_m").alias("relative"))


def normalize(spectra: DataFrame, method: str = "area", **how) -> DataFrame:
    """Signal and baseline over the factor (pqn) or over the factor relative to its median (all others)."""
    f = factors(spectra, method, **how).select(SAMPLE, F.col("factor" if method == "pqn" else "relative").alias("_f"))
    out = spectra.join(f, SAMPLE)
    return out.withColumns({c: F.try_divide(c, "_f") for c in ("intensity", "baseline") if c in spectra.columns}).drop("_f")


# Thresholds


def threshold(spectra: DataFrame, ppm_range: tuple[float, float], method: str = "mean3sd") -> DataFrame:
    """mean3sd: one row, threshold; median3mad: (sample_id, threshold). The range is [start, end).

    mean3sd averages each position's mean and deviation over the samples; of a single sample it takes the mean and
    deviation over the positions. A range with fewer than NOISE_POINTS positions is an error when read.
    """
    part = spectra.where((F.col("ppm") >= ppm_range[0]) & (F.col("ppm") < ppm_range[1]))

    def enough(n: Column, value: Column) -> Column:
        return F.when(n >= NOISE_POINTS, value).otherwise(F.raise_error(F.lit(f"the range has fewer than {NOISE_POINTS} points")).cast("double"))

    if method == "mean3sd":
        each = part.groupBy("idx").agg(F.avg("intensity").alias("m"), F.stddev_samp("intensity").alias("s"), F.count("*").alias("n"))
        spread = F.when(F.max("n") == 1, F.stddev_samp("m")).otherwise(F.avg("s"))
        return each.agg(enough(F.count("*"), F.avg("m") + 3 * spread).alias("threshold"))
    if method != "median3mad":
        raise ValueError(f"no such method: {method}")
    part = part.withColumn("_y", corrected(spectra))
    middle = part.groupBy(SAMPLE).agg(F.median("_y").alias("m"))
    return part.join(middle, SAMPLE).groupBy(SAMPLE).agg(enough(F.count("*"), F.first("m") + 3 * MAD * F.median(F.abs(F.col("_y") - F.col("m")))).alias("threshold"))


# Integration


def region_name(lo: float, hi: float) -> str:
    return f"ppm_{(lo + hi) / 2:.4f}"


def integrate(spectra: DataFrame, regions: dict[str, tuple[float, float]] | list[tuple[float, float]], fix_baseline: bool = False, gaps_as_zero: bool = False, clip: bool = False) -> DataFrame:
    """(sample_id, region, area): sums over [lo, hi) times the axis' resolution, in one pass over the spectra.

    Null for a region without points, or with a gap of three resolutions or more unless gaps_as_zero. fix_baseline
    takes off the line between the region's first and last point; with clip never more than the signal.
    """
    named = regions if isinstance(regions, dict) else {region_name(*r): r for r in regions}
    ordered = spectra.select("idx", "ppm").distinct().withColumn("_d", F.col("ppm") - F.lag("ppm").over(Window.orderBy("idx")))
    step = ordered.agg(F.abs(F.median("_d")).alias("_step"))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), F.lit(float(min(r))).alias("lo"), F.lit(float(max(r))).alias("hi")) for n, r in named.items()]))
    all_samples = spectra.select(SAMPLE).distinct().select(SAMPLE, at.alias("_r")).select(SAMPLE, "_r.region")
    points = spectra.select("*", at.alias("_r")).where("ppm >= _r.lo and ppm < _r.hi").withColumn("region", F.col("_r.region"))
    w = Window.partitionBy(SAMPLE, "region").orderBy("idx")
    points = points.withColumn("_gap", F.abs(F.col("ppm") - F.lag("ppm").over(w)))
    y = F.col("intensity")
    if fix_baseline:
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last, n, k = F.first("intensity").over(full), F.last("intensity").over(full), F.count("*").over(full), F.row_number().over(w)
        points = points.withColumn("_line", F.when(n > 1, first + (last - first) * (k - 1) / F.greatest(n - 1, F.lit(1))).otherwise(first))
        line = F.least(F.col("_line"), y) if clip else F.col("_line")
        points = points.withColumn("_y", y - line)
    else:
        points = points.withColumn("_y", y)
    sums = points.groupBy(SAMPLE, "region").agg(F.sum("_y").alias("_sum"), F.max("_gap").alias("_gap")).crossJoin(F.broadcast(step))
    # A hair under three steps, for distances that are not exact in doubles.
    good = F.lit(True) if gaps_as_zero else F.coalesce(F.col("_gap") < F.col("_step") * (3 - 1e-9), F.lit(True))
    areas = sums.select(SAMPLE, "region", F.when(good, F.col("_sum") * F.col("_step")).alias("area"))
    return all_samples.join(areas, [SAMPLE, "region"], "left")


def integrate_positions(spectra: DataFrame, positions: list[float], width: float) -> DataFrame:
    return integrate(spectra, [(p - width / 2, p + width / 2) for p in positions])


def peak_width(spectra: DataFrame, window: tuple[float, float]) -> DataFrame:
    """One row, width: of the first sample's peak in the open window, twice the way from its top to the point right of it nearest to half its height."""
    first = spectra.agg(F.min(SAMPLE).alias("_s"))
    part = spectra.join(F.broadcast(first), F.col(SAMPLE) == F.col("_s")).where((F.col("ppm") > window[0]) & (F.col("ppm") < window[1]))
    top = part.agg(F.max_by("ppm", "intensity").alias("_x"), F.max("intensity").alias("_y"))
    right = part.crossJoin(F.broadcast(top)).where("ppm > _x")
    return right.agg(F.min_by(2 * F.abs(F.col("ppm") - F.col("_x")), F.abs(F.col("intensity") - F.col("_y") / 2)).alias("width"))


def quantile_spectra(spectra: DataFrame, at: list[float]) -> DataFrame:
    each = spectra.groupBy("idx").agg(F.first("ppm").alias("ppm"), F.percentile("intensity", F.array(*map(F.lit, at))).alias("q"))
    return each.select("idx", "ppm", *[F.get("q", F.lit(k)).alias(f"q{round(p * 100)}") for k, p in enumerate(at)])


def savgol_second(spectra: DataFrame, half: int = 10) -> DataFrame:
    """Adds d2, the second derivative of the quadratic fit over 2 * half + 1 points; null where the window leaves the axis. The step is the axis' first."""
    w = Window.partitionBy(SAMPLE).orderBy("idx")
    m = sum(i * i for i in range(-half, half + 1)) / (2 * half + 1)
    norm = sum((i * i - m) ** 2 for i in range(-half, half + 1))
    total = reduce(lambda a, b: a + b, (F.lag("intensity", -i).over(w) * F.lit(2 * (i * i - m) / norm) for i in range(-half, half + 1)))
    h = F.nth_value("ppm", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.first("ppm").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return spectra.withColumn("d2", total / (h * h))
