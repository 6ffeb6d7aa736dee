"""Whitening of embeddings: singular value decompositions of partitions, merged in a tree without losing a dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Vectors are put on this grid, x = floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Rows that one decomposition of a partition takes, and the slots that summaries meet in, level by level.
CHUNK, LEVELS = 4096, (256, 16, 1)
SUMMARY = "slot int, n long, high binary, low binary, mean binary, spread binary, axes binary"
LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Summary:
    """Of n rows: their sums (high << 32) + low, their mean, and the singular values and right vectors of the rows less their mean."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    axes: np.ndarray

    @property
    def sums(self) -> list[int]:
        return [(int(h) << 32) + int(b) for h, b in zip(self.high, self.low, strict=True)]

    @property
    def weighed(self) -> np.ndarray:
        return self.spread[:, None] * self.axes

    def record(self, slot: int) -> dict:
        return {"slot": slot, "n": self.n} | {k: getattr(self, k).tobytes() for k in ("high", "low", "mean", "spread", "axes")}


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.svd(rows, full_matrices=False)[1:]


def summary(rows: np.ndarray) -> Summary:
    """Of a matrix; sums are those of whole numbers only."""
    whole = rows if rows.dtype == np.int64 else np.zeros((1, rows.shape[1]), dtype=np.int64)
    near = whole[0]  # whole numbers are centred by a row first, so that large ones lose nothing
    own = (rows - near).astype(np.float64)
    mean = own.mean(axis=0)
    return Summary(len(rows), (whole >> 32).sum(axis=0), (whole & LOW).sum(axis=0), near + mean, *decomposed(own - mean))


def merged(a: Summary, b: Summary) -> Summary:
    """Both decompositions below each other, with a row for the distance of their means."""
    n = a.n + b.n
    apart = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    low = a.low + b.low
    return Summary(n, a.high + b.high + (low >> 32), low & LOW, a.mean + (b.mean - a.mean) * (b.n / n), *decomposed(np.vstack([a.weighed, b.weighed, apart])))


def read(row: dict) -> Summary:
    high, low = (np.frombuffer(row[k], dtype=np.int64) for k in ("high", "low"))
    mean, spread, axes = (np.frombuffer(row[k]) for k in ("mean", "spread", "axes"))
    return Summary(row["n"], high, low, mean, spread, axes.reshape(len(spread), -1))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def decompose(vectors: DataFrame, prepared: Callable[[np.ndarray], np.ndarray] = np.asarray) -> Summary | None:
    """The summary of all rows of a table with one column, vectors of one length; None without rows.

    Each task decomposes its rows in chunks and merges these; the summaries of tasks, each as large as a square of the
    dimension, meet in three levels of merges, so none gathers more than its share. prepared: applied to chunks first.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, slot = None, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                own = summary(prepared(matrix(batch.column(0).slice(i, CHUNK))))
                found = own if found is None else merged(found, own)
        if found is not None:
            yield pa.RecordBatch.from_pylist([found.record(slot)], schema=SCHEMA)

    def meet(table: pa.Table) -> pa.Table:
        found = None
        for batch in table.to_batches():
            for row in batch.to_pylist():
                slot = row["slot"]
                found = read(row) if found is None else merged(found, read(row))
        return pa.Table.from_pylist([found.record(slot)], schema=SCHEMA)

    every = vectors.mapInArrow(leaves, SUMMARY)
    for slots in LEVELS:
        every = every.groupBy((F.col("slot") % slots).alias("meeting")).applyInArrow(meet, SUMMARY)
    rows = every.collect()
    return read(rows[0].asDict()) if rows else None


SCHEMA = pa.schema([("slot", pa.int32()), ("n", pa.int64()), *((k, pa.binary()) for k in ("high", "low", "mean", "spread", "axes"))])


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; components (rows), their eigenvalues and the sum of all eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigen: np.ndarray
    trace: float

    @property
    def shown(self) -> np.ndarray:
        """Which components have any spread beyond rounding."""
        return self.eigen > self.eigen[:1].sum() * len(self.sums) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x - S/n; the sums of (n*x - S)^2, and where these are exact, that is where they fit into a long."""
        rough = x - np.array([s / self.n for s in self.sums])
        apart = x * np.int64(self.n) - np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], dtype=np.int64)  # right where it fits, as both sides wrap alike
        fits = np.abs(rough) * self.n < 2.0**62
        total = ((rough * self.n) ** 2).sum(axis=1)
        return np.where(fits, apart / self.n, rough), (apart * apart).sum(axis=1), total < 2.0**63 * (1 - 1e-9)

    def white(self, x: np.ndarray) -> np.ndarray:
        """Projections of the shown components, with variance 1 over the fit list."""
        return self.centred(x)[0] @ self.components[self.shown].T / np.sqrt(self.eigen[self.shown])


def usable(vector: Column) -> Column:
    """Vectors, not null, of entries that are neither null nor infinite nor no numbers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: fine(c.cast("double")))


def grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * STEPS), F.lit(2**62)) + SHIFT)


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of distinct vectors x, a table with one column of one length; None without rows."""
    every = decompose(vectors)
    if every is None:
        return None
    eigen = every.spread**2 / every.n
    return Whitening(every.n, every.sums, every.axes[:components], eigen[:components], float(eigen.sum()))


def identity_error(model: Whitening, vectors: DataFrame) -> float:
    """The largest absolute entry of the covariance of whitened vectors less the identity."""
    if not model.shown.any():
        return 0.0
    white = decompose(vectors, model.white)
    covariance = white.axes.T @ (white.spread[:, None] ** 2 * white.axes) / white.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Vectors are put on a grid of whole numbers; the fit list is each distinct one once. Components are the directions of
    greatest spread of the fit list, numbered from 1. Rows whose vector is null, or holds null or non-finite entries, go,
    and so do vectors of another length than the most frequent one (ties: the longest), which can't be whitened with the rest. Repeated rows
    stay, each with its own results; null ids stay null. A component without spread (fewer distinct vectors than
    dimensions) has whitened null; a deviation beyond a long is null. Entries beyond 2**62 / 64 count as that. Other columns are not
    read. An empty table, or one of empty vectors, gives an empty result.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    sizes = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    kind = kept.schema["id"].dataType
    result = f"{id_col} {kind.simpleString()}, component int, deviation long, whitened double, explained double"
    if not sizes or not sizes[0]["size"]:
        return spark.createDataFrame([], result).select(id_col, "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(0.0).alias("identity_error"))
    kept = kept.where(F.size("v") == sizes[0]["size"]).select("id", grid(F.col("v")).alias("x"))
    listed = stage(kept.select("x").distinct(), "fit-list")
    model = fit(listed, components)
    error = identity_error(model, listed)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown, most = model.shown, len(model.eigen)
        explained = model.eigen / model.trace if model.trace else np.zeros(most)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x, n = matrix(part.column(1)), part.num_rows
                white = np.full((n, most), np.nan)
                white[:, shown] = model.white(x)
                _, deviation, exact = model.centred(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(n), most))),
                        pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), n)),
                        pa.array(np.repeat(deviation, most), mask=np.repeat(~exact, most)),
                        pa.array(white.ravel(), mask=np.tile(~shown, n)),
                        pa.array(np.tile(explained, n)),
                    ],
                    names=[id_col, "component", "deviation", "whitened", "explained"],
                )

    found = kept.mapInArrow(projected, result)
    return found.select(id_col, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
