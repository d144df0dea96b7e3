"""What the corpus operators share: reading tables, scratch tables in the shared folder, small native helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as the inside of a regular expression's class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumispec-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumispec/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words between white space; an empty array for an empty text."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def packed(df: DataFrame, text_col: str, added: list[str]) -> tuple[DataFrame, list[Column]]:
    """(_in, _text) of df, its columns apart from the operator's own, whatever their names, and what brings back those that added does not replace."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = df.select(row.alias("_in"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    return out, [F.col(f"_in.`{c}`").alias(c) for c in df.columns if c not in added]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """df.where(condition) for conditions on costly columns: without this, the optimizer would copy the columns' expressions into the filter and compute them twice."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(F.expr(condition) & (F.col("_row") >= 0)).drop("_row")
