"""Steps of an analysis over folders of Parquet tables: each reads a folder and writes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model, peaks, spectra
from ..sources import instrument, tables


def _out(path: str | None) -> str:
    if not path:
        raise ValueError("an output folder is needed")
    return path


def load_samples(spark: SparkSession, directory: str, out: str | None, format: str = "bruker", **how) -> None:
    got = instrument.read_samples_dir(spark, directory, format, **how)
    ok = got.where("status = 'ok'")
    tables.save({"raw": ok.select("sample_id", F.col("axis").alias("ppm"), F.col("data_1r").alias("intensity")), "meta": instrument.metadata(ok), "rejected": got.where("status <> 'ok'").select("sample_id", "path", "error")}, _out(out))


def add_metadata(spark: SparkSession, path: str, extra: DataFrame, by: str, ordinal: str, out: str | None) -> None:
    t = tables.load(spark, path, "raw", "meta")
    tables.save(t | {"meta": spectra.meta_add(t["meta"], extra, by, ordinal)}, _out(out))


def interpolate(spark: SparkSession, path: str, axis: tuple[float, float, float], out: str | None) -> None:
    t = tables.load(spark, path, "raw", "meta")
    long = model.interpolate(t["raw"], axis).select("sample_id", F.posexplode(F.arrays_zip("ppm", "intensity")).alias("idx", "p")).select("sample_id", "idx", "p.ppm", "p.intensity")
    tables.save({"spectra": long, "meta": t["meta"]}, _out(out))


def exclude_regions(spark: SparkSession, path: str, regions: dict, out: str | None) -> None:
    t = tables.load(spark, path, "spectra", "meta")
    tables.save(t | {"spectra": spectra.exclude_regions(t["spectra"], regions)}, _out(out))


def filter_samples(spark: SparkSession, path: str, conditions: list[str], out: str | None) -> None:
    t = tables.load(spark, path, "spectra", "meta")
    both = " and ".join(f"({c})" for c in conditions) or "true"
    tables.save({"spectra": spectra.filter_samples(t["spectra"], t["meta"], both), "meta": t["meta"].where(F.expr(both))}, _out(out))


def drop_outliers(spark: SparkSession, path: str, out: str | None, ncomp: int | None = None, robust: bool = True) -> None:
    t = tables.load(spark, path, "spectra", "meta")
    found = model.outliers(spectra.to_arrays(t["spectra"]), ncomp, robust=robust)
    keep = found.where("t < t_limit and q < q_limit").select("sample_id")
    tables.save({"spectra": t["spectra"].join(keep, "sample_id", "left_semi"), "meta": t["meta"].join(keep, "sample_id", "left_semi"), "outliers": found}, _out(out))


def detect_and_align(spark: SparkSession, path: str, out: str | None, snr: float = 3.0, most: int = 5) -> None:
    t = tables.load(spark, path, "spectra", "meta")
    arrays = spectra.to_arrays(t["spectra"])
    found = peaks.with_ids(model.detect(arrays, snr))
    reference = peaks.reference_sample(found).orderBy("distance", "sample_id").first()["sample_id"]
    moved = model.align(arrays, peaks.collected(t["meta"], found), reference, most)
    long = moved.select("sample_id", F.posexplode(F.arrays_zip("ppm", "intensity")).alias("idx", "p")).select("sample_id", "idx", "p.ppm", "p.intensity")
    tables.save({"spectra": long, "meta": t["meta"], "peaks": found, "reference": found.where(F.col("sample_id") == F.lit(reference))}, _out(out))


def integrate_peaks(spark: SparkSession, path: str, out: str | None, width: float = 0.006) -> None:
    t = tables.load(spark, path, "spectra", "meta", "reference")
    at = [r["ppm"] for r in t["reference"].select("ppm").orderBy("ppm").collect()]  # one sample's peaks
    tables.save({"areas": spectra.integrate_positions(t["spectra"], at, width), "meta": t["meta"]}, _out(out))


def normalize(spark: SparkSession, path: str, out: str | None, calibrant: tuple[float, float] | None = None) -> None:
    """By the calibrant's region first, if there is one, which then goes; factors over 4 or under a quarter are flagged; then by probabilistic quotients."""
    t = tables.load(spark, path, "spectra", "meta")
    s, parts = t["spectra"], {}
    if calibrant:
        f = spectra.factors(s, "region", regions=calibrant)
        parts["factors"] = f.withColumn("flagged", (F.col("relative") > 4) | (F.col("relative") < 0.25))
        s = spectra.exclude_regions(spectra.normalize(s, "region", regions=calibrant), {"calibrant": calibrant})
    tables.save(parts | {"spectra": spectra.normalize(s, "pqn"), "meta": t["meta"]}, _out(out))
