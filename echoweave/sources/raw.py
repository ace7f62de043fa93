"""Raw relations: typed readers, and the cache of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null for NaN in every floating-point column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_raw(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A relation from CSV (a schema is needed: nothing is inferred) or Parquet, NaN read as null."""
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("CSV needs a schema")
        return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    return nan_to_null(spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path))


def write_cache(df: DataFrame, path: str) -> DataFrame:
    """Written by scenario, so that later reads of a scenario skip the others, and read again."""
    df.write.mode("overwrite").partitionBy("scenario_id").parquet(path)
    return df.sparkSession.read.parquet(path).select(df.columns)


def clean_detections(detections: DataFrame) -> DataFrame:
    """Detections of targets: false positives, which have none, go; the target's number is whole."""
    found = detections.withColumnRenamed("associated_target_id", "target_id")
    return found.where(F.col("target_id").isNotNull() & ~F.isnan("target_id")).withColumn("target_id", F.col("target_id").cast("long"))
