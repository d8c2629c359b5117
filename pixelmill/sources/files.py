"""Rasters, tables and models on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def write_raster(df: DataFrame, path: str, types: Mapping[str, str], block_rows: int = 128, overwrite: bool = True) -> None:
    """Pixels with storage types per layer, compressed, in one folder per block of rows.

    Without ``overwrite`` an existing raster is never touched (S21).
    """
    typed = df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}).withColumn("block", F.expr(f"CAST(row DIV {block_rows} AS INT)"))
    writer = typed.repartition("block").write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("compression", "zstd").partitionBy("block").parquet(path)


def read_raster(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """The pixel table; only the named layers are read."""
    df = spark.read.parquet(path).drop("block")
    return df.select("row", "col", *layers) if layers else df


def read_block(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Blocks ``first`` .. ``last`` only, by partition pruning."""
    return spark.read.parquet(path).where(F.col("block").between(first, last)).drop("block")


def write_csv(df: DataFrame, path: str) -> None:
    """Comma separated, with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_european(df: DataFrame, path: str) -> None:
    """Semicolons between fields and decimal commas."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float") or t.startswith("decimal")]
    shown = df.withColumns({c: F.translate(F.col(c).cast("string"), ".", ",") for c in numeric})
    shown.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """With a header and a stated schema, so no pass is spent on inference."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_parameters(spark: SparkSession, values: Mapping[str, float], path: str) -> None:
    """Fitted numbers as one row."""
    names = list(values)
    spark.createDataFrame([tuple(float(values[n]) for n in names)], ", ".join(f"{n} double" for n in names)).write.mode("overwrite").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    return spark.read.parquet(path).first().asDict()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_if_there(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """A table that must be there, or None for one that may be missing."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if required:
        raise FileNotFoundError(f"missing input: {path}")
    return None
