"""Feeds that arrive as files: each micro-batch becomes a snapshot of its stream, and the weeks that it touches are merged into the canonical table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weekloom.sources.schemas import struct_of
from weekloom.sources.workspace import Workspace


def ingest(spark: SparkSession, folder: str, stream: str, workspace: Workspace, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parquet files of the stream's schema that appear in ``folder``; ``checkpoint`` keeps what has been read, so no file counts twice."""

    def take(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            workspace.add_snapshot(stream, batch, f"{folder}#{epoch}")
            workspace.rebuild_canonical([stream])

    writer = spark.readStream.schema(struct_of(stream)).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
