"""Streams of RDF lines into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.rdf import changed_lines
from ..store import Store


def line_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Quads of N-Triples / N-Quads files as they appear in a folder, with the operation of each: lines that open with ``-`` remove."""
    return changed_lines(spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder))


def ingest(store: Store, changes: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Applies a stream of (operation, s, p, o, g) to a store: a version per micro-batch. A batch that is replayed after a failure changes
    nothing, as quads are a set."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.change(adds=batch.filter("operation = 'add'").drop("operation"), dels=batch.filter("operation = 'remove'").drop("operation"))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
