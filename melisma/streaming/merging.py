"""Crawl files that arrive as a stream: the first record of each title and artist is new, whatever batch it comes in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from melisma.operators.dedupe import song_id, with_keys

KEYS = ["k_titulo", "k_artista"]


def new_songs(records: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """The records of a stream that merging one batch after another would add, with id, title and artist keys.

    records: a streaming table with titulo, artista and the columns of `order`, which tells all rows apart. Records without
    title or artist are left out, and so are those that a known song (a table) has by title and artist or by id. The state is a
    mark for each key that was seen; of a batch's rows of a key, which come in parts, only the first so far is held.
    """
    rows = with_keys(records).where((F.coalesce("titulo", F.lit("")) != "") & (F.coalesce("artista", F.lit("")) != "") & (F.col("k_titulo") != "") & (F.col("k_artista") != ""))
    rows = rows.withColumn("id", song_id(F.col("titulo"), F.col("artista")))
    names = with_keys(known).select(*KEYS).distinct()
    rows = rows.join(names, KEYS, "left_anti").join(known.select("id").where("id <> ''").distinct(), "id", "left_anti")

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, best = state.exists, None
        for part in parts:
            if not seen and len(part):
                own = part.sort_values(order, kind="stable").iloc[:1]
                best = own if best is None else pd.concat([best, own]).sort_values(order, kind="stable").iloc[:1]
        if best is not None:
            state.update((True,))
            yield best

    return rows.groupBy(*KEYS).applyInPandasWithState(first, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def merge_stream(records: DataFrame, known: DataFrame, order: list[str], folder: str) -> DataStreamWriter:
    """Writes the new songs to Parquet below `folder`, where the state is kept too; a stream that is started again goes on from there."""
    found = new_songs(records, known, order).writeStream.format("parquet").outputMode("append")
    return found.option("path", f"{folder}/songs").option("checkpointLocation", f"{folder}/checkpoint")
