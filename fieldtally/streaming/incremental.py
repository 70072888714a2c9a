"""Pick up newly arrived trip files once each, as a monthly schedule would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldtally.sources.writers import with_month


def load_new_files(spark: SparkSession, folder: str, schema: T.StructType, path: str, checkpoint: str,
                   ts: str) -> None:
    """Append every file of ``folder`` not seen before to the month-partitioned table, then stop.

    The stream's checkpoint remembers which files were taken, and the file
    sink's own log makes a batch repeated after a failure count once.
    """
    arriving = spark.readStream.schema(schema).parquet(folder)
    query = (
        with_month(arriving, ts)
        .writeStream.format("parquet")
        .partitionBy("month")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """The table as committed by the stream."""
    return spark.read.parquet(path)
