"""Retrieval of frames that keep arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumengrid.operators import retrieve


def run_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, params: DataFrame | None = None, files: int = 8, once: bool = False) -> StreamingQuery:
    """Retrieve new Parquet frames of `source` into `target`, `files` files at a time.

    Each batch has its own folder, named by its number and overwritten if the batch runs again, so that
    every frame is delivered once.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        objects, _ = retrieve.shrink_wrap(batch, params)
        objects.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    writer = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
