"""Streams of table files into a sink, batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession

from brightloom.sources import sinks


def stream_table(spark: SparkSession, source: str, schema, kind: str, target: str, checkpoint: str):
    """Copies new Parquet files of ``source`` to ``target``, each micro-batch as a folder of its own; returns the query.

    A batch that is repeated after a failure overwrites its own folder, so each row is written once.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    write = lambda df, n: sinks.write(df, kind, f"{target}/batch={n}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
