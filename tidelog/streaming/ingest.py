"""Structured Streaming into a table: each micro-batch is one commit, which also names the stream and the batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidelog.sources.store import Store
from tidelog.table import Table


def sink(stream: DataFrame, table: Table, checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """A writer to start(): key, value batches are put in order, each exactly once.

    The table's manifest keeps the last batch of each stream, by the id in the stream's checkpoint, in the very
    commit that adds the batch's run; so a batch that runs again, after a crash at any point, is found there and
    skipped, and streams with checkpoints of their own do not know of each other's batches.
    """

    def put(batch: DataFrame, number: int) -> None:
        name = json.loads(Store(batch.sparkSession, checkpoint).read("metadata"))["id"]
        if table.manifest.streams.get(name, -1) < number:
            table.put(batch, order, stream=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
