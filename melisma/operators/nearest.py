"""The nearest vectors of a table of queries, in blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import ranked

#: Queries of a block, which are sent to all tasks; rows that meet them at a time.
BLOCK, ROWS = 4096, 1024


def units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, as doubles; zero vectors stay."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


class Best:
    """The greatest scores of each query so far; ties by the id of the row."""

    def __init__(self, queries: int, most: int) -> None:
        self.most, self.ids = most, np.full((queries, most), np.iinfo(np.int64).max)
        self.scores = np.full((queries, most), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids of some rows, and their scores with all queries (queries by rows)."""
        for i in np.flatnonzero((scores >= self.scores[:, -1:]).any(axis=1)):
            every, found = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores[i]])
            order = np.lexsort((every, -found))[: self.most]
            self.ids[i], self.scores[i] = every[order], found[order]


def nearest(rows: DataFrame, queries: DataFrame, most: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): for each query the rows of greatest cosine, rounded; ties by doc_id. rows and queries: (id, v), ids that are numbers, vectors of one length.

    Queries are a table of any size: a block of them at a time goes to all tasks, each of which keeps the best of its own
    rows for each query, so that at most `most` rows for a query leave a task.
    """
    spark = rows.sparkSession
    count = queries.count()
    blocks = []
    for number in range(max(1, -(-count // BLOCK))):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(-(-count // BLOCK) or 1)) == number).toArrow()
        asked, names = units(part.column("v").combine_chunks()) if part.num_rows else np.zeros((0, 1)), part.column("id").to_numpy()
        shared = spark.sparkContext.broadcast((names, asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            best = Best(len(names), most)
            for batch in batches:
                for i in range(0, batch.num_rows if len(names) else 0, ROWS):
                    own = batch.slice(i, ROWS)
                    best.add(own.column("id").to_numpy(), np.round(asked @ units(own.column("v")).T, digits))
            found = best.scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, most)[found.ravel()], pa.int64()), pa.array(best.ids[found]), pa.array(best.scores[found])], names=["query_id", "doc_id", "score"])

        blocks.append(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "query_id long, doc_id long, score double"))
    return ranked(reduce(DataFrame.unionByName, blocks), most)
