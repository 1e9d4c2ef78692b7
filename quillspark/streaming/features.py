"""The stateless measures over streams, and a windowed count with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shape


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def feature_stream(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Feature rows of a document stream: no state, so the batch columns serve."""
    return shape.features(docs, keys)


def windowed_counts(events: DataFrame, time: str, by: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window, dropping what comes later than ``late``."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, length), by)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_to_parquet(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, exactly once, and stop."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
