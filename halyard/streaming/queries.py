"""Streams of queries and of new vectors.

A stream of queries is answered micro-batch by micro-batch against a static base, with the same
search as in batch; a stream of vectors is appended to the base table, after which searches see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from halyard import schemas
from halyard.operators.nearest import nearest


def query_stream(spark: SparkSession, folder: str, schema: T.StructType = schemas.QUERY_VECTORS, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def answer_stream(queries: DataFrame, base: DataFrame, k: int, out: str, checkpoint: str, attr: str | None = None, once: bool = True):
    """Writes each micro-batch's neighbours below ``out``, one folder per batch, so a repeated batch
    replaces its own rows."""

    def answer(batch: DataFrame, number: int) -> None:
        nearest(base, batch, k, attr).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(vectors: DataFrame, out: str, checkpoint: str, once: bool = True):
    writer = vectors.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
