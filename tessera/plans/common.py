"""What the registered queries share: input tables and how their columns stand for the engine's inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """df with its double columns (or the named ones) rounded, and no negative zero."""
    wanted = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in wanted})
