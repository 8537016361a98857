"""Results of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 1) -> DataFrame:
    """New files under path, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def stream_results(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch transform to every micro-batch and write it to ``out``, once per batch even after a restart.

    A batch replaces only its own partition, so a batch that is run again leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
