"""Appending a stream of points to a gridded cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.decompose import assign_grid


def append_stream(points: DataFrame, path: str, checkpoint: str, delta: float, once: bool = True):
    """Write each micro-batch under its cells; a replayed batch overwrites its own folder, so points come once."""

    def write(batch: DataFrame, number: int) -> None:
        assign_grid(batch, delta).write.mode("overwrite").partitionBy("k_x", "k_y").parquet(f"{path}/batch={number}")

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
