"""Songs that arrive as a stream: each micro-batch extends the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from melisma.operators.index import build, extend
from melisma.sources import segments, store


def extending(folder: str):
    """A foreachBatch function. Versions alternate by batch number, so a batch that is run again starts from the same state."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = store.load(spark, f"{folder}/v{(number + 1) % 2}") if number else None
        store.save(build(batch) if before is None else extend(before, batch), f"{folder}/v{number % 2}")

    return run


def index_stream(songs: DataFrame, folder: str) -> DataStreamWriter:
    """songs: a streaming DataFrame of the song table. The latest index is v0 or v1 by the parity of the last batch."""
    return songs.writeStream.foreachBatch(extending(folder)).option("checkpointLocation", f"{folder}/checkpoint")


def segment_stream(songs: DataFrame, folder: str) -> DataStreamWriter:
    """songs: a streaming DataFrame of the song table, one row an id in a batch. Each batch adds a segment, so what it writes follows its own size; `segments.opened` reads the latest state."""
    run = lambda batch, number: segments.add(batch.sparkSession, f"{folder}/index", batch, number)
    return songs.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
