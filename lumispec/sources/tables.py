"""Sets of spectra as Parquet, and exports: wide CSV, metadata by group, transposed tables, profiling inputs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectra import SAMPLE


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on a local master the system's temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.gettempdir()
    return found.rstrip("/")


def save(parts: dict[str, DataFrame], path: str) -> None:
    """Each part (spectra, peaks, a metadata group) as a Parquet table under path."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def wide(spectra: DataFrame, ppm: list[float], column: str = "intensity") -> DataFrame:
    """A row a sample, a column a point of the axis."""
    out = spectra.groupBy(SAMPLE).pivot("ppm", ppm).agg(F.first(column))
    return out.toDF(SAMPLE, *[f"{p:.10g}" for p in ppm])


def transposed(spectra: DataFrame, samples: list, prefix: str = "sample_") -> DataFrame:
    """A row a point, a column a sample."""
    out = spectra.groupBy("ppm").pivot(SAMPLE, samples).agg(F.first("intensity"))
    return out.toDF("ppm", *[f"{prefix}{s}" for s in samples])


def from_wide(df: DataFrame, value: str = "intensity") -> DataFrame:
    """Long spectra of a wide table whose headers are points of the axis."""
    points = [c for c in df.columns if c != SAMPLE]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(float(c)).alias("ppm"), F.col(f"`{c}`").cast("double").alias(value)) for k, c in enumerate(points)]))
    return df.select(SAMPLE, rows.alias("_r")).select(SAMPLE, "_r.*")


def groups_of(df: DataFrame) -> dict[str, DataFrame]:
    """Metadata columns by what stands before their first underscore."""
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if c != SAMPLE:
            found.setdefault(c.split("_", 1)[0], []).append(c)
    return {g: df.select(SAMPLE, *cols) for g, cols in found.items()}


def export_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """One folder of CSV; never over an existing one."""
    df.write.mode("errorifexists").option("header", True).option("sep", separator).csv(path)


def export_meta(groups: dict[str, DataFrame], path: str, names: list[str]) -> list[str]:
    """A CSV a group; the names that do not exist come back."""
    for n in names:
        if n in groups:
            export_csv(groups[n], os.path.join(path, n))
    return [n for n in names if n not in groups]


def with_metadata(table: DataFrame, external: DataFrame) -> DataFrame:
    """Peak table and metadata side by side, by the key."""
    return external.join(table, SAMPLE, "left")


def multiplets(lookup: DataFrame) -> DataFrame:
    """Profiling input: metabolite, position, couple_code, j, relative intensity and the default columns."""
    return lookup.select(F.regexp_replace("metabolite", ",", "_").alias("Metabolite"), F.col("position").alias("pos_in_ppm"), "couple_code", F.coalesce("j", F.lit(0.0)).alias("J_constant"), F.col("intensity").alias("relative_intensity"), F.lit(50).alias("overwrite_pos"), F.lit(0.002).alias("overwrite_truncation"), F.lit(1).alias("Include_multiplet"))


def profiling_metadata(meta: DataFrame, group: str, order: str = SAMPLE) -> DataFrame:
    """Sample, individual and the group as a dense integer."""
    from pyspark.sql import Window

    return meta.select(F.col(SAMPLE).alias("Sample"), F.col("subject").alias("Individual"), F.dense_rank().over(Window.orderBy(group)).alias("Sample Type"))


def chemo_record(spectra: DataFrame, meta: DataFrame, group: str, description: str) -> dict:
    """Frequencies, data, names and groups in one record, for sets that fit in memory."""
    from ..operators.model import matrix
    from ..operators.spectra import to_arrays

    arrays = to_arrays(spectra)
    info, data = matrix(arrays.join(meta.select(SAMPLE, group), SAMPLE), group)
    return {"freq": list(arrays.first()["ppm"]), "data": data, "names": info[SAMPLE].tolist(), "groups": info[group].tolist(), "unit": ["ppm", "a.u."], "desc": description}
