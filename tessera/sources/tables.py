"""Readers of the driver's tables, whose schemas the parquet files hold."""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
