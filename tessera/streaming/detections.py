"""Detections as they arrive: new rows of a stream are added to a table once, and counted by windows of event time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(stream: DataFrame, target: str, checkpoint: str, key: list[str]):
    """Starts a query that adds the rows of each batch whose key the target does not hold. A batch that runs again after a
    failure finds its rows there and adds none."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(key)
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(target)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            held = None
        (fresh if held is None else fresh.join(held.select(*key), key, "left_anti")).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window of event time, rows later than the watermark left out."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")
