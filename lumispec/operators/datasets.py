"""A set of spectra as one object's worth of tables: checks, positional subsets, matrix and metadata accessors, remembered regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectra import SAMPLE, exclude_regions, meta_add, meta_join

GRID = {SAMPLE, "idx", "ppm", "intensity"}
PEAKS = {"peak_id", SAMPLE, "ppm"}


def is_spectra(df: DataFrame) -> bool:
    return GRID <= set(df.columns)


def is_peaks(df: DataFrame) -> bool:
    return PEAKS <= set(df.columns)


def problems(spectra: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(problem, n): each broken rule of a gridded set with the number of rows that break it; no rows for a valid set.

    Rules: ids and points are not null; a sample has a point once; a position has one place on the axis, in all
    samples; all samples have all positions; metadata has each sample once, and no others.
    """
    per_point = spectra.groupBy("idx").agg(F.countDistinct("ppm").alias("places"), F.count("*").alias("rows"), F.countDistinct(SAMPLE).alias("samples"))
    total = spectra.agg(F.countDistinct(SAMPLE).alias("all"))
    facts = [
        spectra.agg(F.lit("null id or point").alias("problem"), F.count_if(F.col(SAMPLE).isNull() | F.col("idx").isNull() | F.col("ppm").isNull()).alias("n")),
        per_point.agg(F.lit("repeated point").alias("problem"), F.coalesce(F.sum(F.col("rows") - F.col("samples")), F.lit(0)).alias("n")),
        per_point.agg(F.lit("position with several places").alias("problem"), F.count_if(F.col("places") > 1).alias("n")),
        per_point.crossJoin(F.broadcast(total)).agg(F.lit("position that samples lack").alias("problem"), F.count_if(F.col("samples") < F.col("all")).alias("n")),
    ]
    if meta is not None:
        known = spectra.select(SAMPLE).distinct()
        facts += [
            meta.groupBy(SAMPLE).count().agg(F.lit("repeated metadata").alias("problem"), F.count_if(F.col("count") > 1).alias("n")),
            meta.join(known, SAMPLE, "left_anti").agg(F.lit("metadata without spectrum").alias("problem"), F.count("*").alias("n")),
            known.join(meta, SAMPLE, "left_anti").agg(F.lit("spectrum without metadata").alias("problem"), F.count("*").alias("n")),
        ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def validated(spectra: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """spectra, or a ValueError that names what is wrong."""
    wrong = problems(spectra, meta).collect()  # a row a rule at most
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in wrong))
    return spectra


def summary(spectra: DataFrame) -> DataFrame:
    """One row: samples, points, and the ends of the axis."""
    return spectra.agg(F.countDistinct(SAMPLE).alias("samples"), F.countDistinct("idx").alias("points"), F.min("ppm").alias("ppm_min"), F.max("ppm").alias("ppm_max"))


def positions(samples: DataFrame, order: str = SAMPLE) -> DataFrame:
    """(sample_id, position): places of samples in an order, from 0, counted by ranges in two steps so that no task sees all of them."""
    each = samples.select(SAMPLE, order).distinct() if order != SAMPLE else samples.select(SAMPLE).distinct()
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartitionByRange(n, order, SAMPLE).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(order, SAMPLE)
    counts = dealt.groupBy("_part").count()  # a row a range
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return dealt.withColumn("_k", F.row_number().over(w) - 1).join(F.broadcast(starts), "_part").select(SAMPLE, (F.col("_before") + F.col("_k")).cast("long").alias("position"))


def subset(df: DataFrame, samples: DataFrame, keep: list[int], order: str = SAMPLE) -> DataFrame:
    """Rows of the samples at the given places, baseline and all; negative places leave out. Places that do not exist are an error."""
    if any(k < 0 for k in keep) and any(k >= 0 for k in keep):
        raise ValueError("places are either all kept or all left out")
    placed = positions(samples, order)
    n = placed.count()
    wanted = sorted({k if k >= 0 else -k - 1 for k in keep})
    if wanted and wanted[-1] >= n:
        raise ValueError(f"no place {wanted[-1]} among {n} samples")
    chosen = F.col("position").isin(wanted)
    leave_out = bool(keep) and keep[0] < 0
    return df.join(placed.where(~chosen if leave_out else chosen).select(SAMPLE), SAMPLE, "left_semi")


def with_matrix(spectra: DataFrame, values: DataFrame, column: str = "intensity") -> DataFrame:
    """spectra with new values, (sample_id, idx, value); a point without a new value, or a value without a point, is an error when read."""
    both = spectra.drop(column).withColumn("_here", F.lit(True)).join(values.select(SAMPLE, "idx", F.col("value").cast("double").alias(column)).withColumn("_new", F.lit(True)), [SAMPLE, "idx"], "full")
    matched = F.col("_here").isNotNull() & F.col("_new").isNotNull()
    checked = F.when(matched, F.col(column)).otherwise(F.raise_error(F.lit("values and points differ")).cast("double"))
    return both.withColumn(column, checked).drop("_here", "_new").select(*spectra.columns)


def meta_get(groups: dict[str, DataFrame], columns: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Metadata of all groups side by side, or of some groups, or some columns; not both."""
    if columns is not None and names is not None:
        raise ValueError("either columns or groups")
    chosen = list(groups) if names is None else names
    missing = [g for g in chosen if g not in groups]
    if missing:
        raise ValueError(f"no such groups: {', '.join(missing)}")
    return meta_join([groups[g] for g in chosen], columns=columns)


def meta_column(groups: dict[str, DataFrame], name: str) -> DataFrame:
    return meta_get(groups, [name])


def meta_groups(groups: dict[str, DataFrame]) -> list[str]:
    return list(groups)


def sample_ids(spectra: DataFrame) -> DataFrame:
    return spectra.select(SAMPLE).distinct()


def meta_add_sheets(meta: DataFrame, sheets: list[DataFrame], ordinal: str = "_row") -> DataFrame:
    """meta with one sheet after the other joined on that sheet's first column; empty sheets are left out. sheets have their rows' order in ordinal."""
    for s in sheets:
        by = s.columns[0]
        if by == ordinal or s.isEmpty():
            continue
        if by not in meta.columns:
            raise ValueError(f"no column {by} to join a sheet by")
        meta = meta_add(meta, s, by, ordinal)
    return meta


class Excluding:
    """Spectra with the regions that were taken out of them."""

    def __init__(self, spectra: DataFrame, regions: dict[str, tuple[float, float]] | None = None):
        self.spectra, self.regions = spectra, dict(regions or {})

    def exclude(self, regions: dict[str, tuple[float, float]]) -> Excluding:
        return Excluding(exclude_regions(self.spectra, regions), self.regions | {n: (min(r), max(r)) for n, r in regions.items()})

    def excluded(self) -> DataFrame:
        """(region, lo, hi), in the order of exclusion."""
        spark = self.spectra.sparkSession
        return spark.createDataFrame([(n, float(lo), float(hi)) for n, (lo, hi) in self.regions.items()], "region string, lo double, hi double")


def without(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Set difference: distinct keys of left that right lacks; null equals null."""
    return left.select(*keys).distinct().exceptAll(right.select(*keys).distinct())


def union(sets: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """Rows of all sets with the name of each; columns that a set lacks are null."""
    out = None
    for n, df in sets.items():
        one = df.withColumn(name, F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, key: str | Column = SAMPLE) -> DataFrame:
    """Columns of two tables by a key; samples that right lacks have nulls."""
    return left.join(right, key, "left")
