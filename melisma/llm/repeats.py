"""Repeated windows of a corpus, found without comparing documents with each other.

A window is `width` consecutive units (words or bytes) of one text. Each window is owned by one anchor:
its `gram`-unit gram of least hash, the leftmost of equals. The choice depends on the window's content
alone, so equal windows have equal anchors, wherever they stand. The consecutive windows that one anchor
owns are a segment of at most 2 * width - gram units.

1. Count anchors (map-side combined); only windows whose anchor occurs again can repeat.
2. Keep the occurrences of those anchors; equal segments of a text are one row with a list of their starts, so
   that a periodic text does not load its anchor, and equal segments of an anchor become one with a count.
3. Fetch each distinct segment's text once, and give the segments of an anchor to one block, in which
   `find` (the operator's own method) says which of their windows repeat.
4. An anchor with over `most` distinct segments is not put into one block. Its segments are texts in their turn,
   and step 1 cuts them again by a longer gram, at last by the whole window, of which a block has one. So
   no block grows with the corpus, and `find` decides every window, at any size.
5. Send the repeated runs back to the rows; the text is joined by (doc_id, hash of text).

Nulls count as empty texts; a null doc_id is matched by its text; rows alike in id and text each get the
same result, and being copies of each other they repeat entirely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODES, Rolling, Texts, chunks, run_bounds, sliding_least, word_codes
from .staging import keyed, same_row, stage

OCCURRENCES = "did long, th long, anchor long, seg long, starts array<int>, wins int"
SEGMENTS = "anchor long, seg long, n long, wins int, content binary, hot boolean"
PIECES = "anchor long, seg long, n long, start int, anchor2 long, seg2 long, wins2 int, content binary"
RUNS = "anchor long, seg long, lo int, hi int"
#: Bytes of segments that a task indexes at a time; whole anchors only.
BLOCK_BYTES = 1 << 17


@dataclass(frozen=True)
class Windows:
    """What repeats: units are "words" or "bytes". most: distinct segments of an anchor in one block."""

    units: str
    width: int
    gram: int
    most: int = 4096

    def finer(self) -> Windows:
        """The same windows with anchors of a longer gram: 0.8 of the width, 0.96 of it, then all."""
        longer = (self.width * 4 // 5, self.width * 24 // 25, self.width)
        return replace(self, gram=next(x for x in longer if x > self.gram))


def units_of(text: Texts, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, first byte, end byte) of each unit, and the first unit of each row."""
    if kind == "words":
        start, end, bound = text.words()
        return word_codes(text, start, end), start, end, bound
    places = np.arange(len(text.bytes) + 1, dtype=np.int64)
    return BYTE_CODES[text.bytes], places[:-1], places[1:], np.append(text.starts, len(text.bytes))


def segments_of(codes: np.ndarray, bound: np.ndarray, spec: Windows) -> dict[str, np.ndarray]:
    """Segments of all rows: row, first window (from the row's start), number of windows, anchor, hash."""
    rolling, none = Rolling(codes), np.zeros(0, dtype=np.int64)
    grams = rolling.windows(spec.gram)
    owner = sliding_least(grams, spec.width - spec.gram + 1)
    if not len(owner):
        return dict.fromkeys(("row", "start", "wins", "anchor", "seg"), none)
    steps = np.zeros(len(codes) + 2, dtype=np.int32)
    np.add.at(steps, bound[:-1], 1)
    np.add.at(steps, np.maximum(bound[1:] - spec.width + 1, bound[:-1]), -1)
    inside = np.cumsum(steps)[: len(owner)] > 0  # the window ends in its own row
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.append(first[1:], len(owner))
    kept = inside[first]
    first, last = first[kept], last[kept]
    row = np.searchsorted(bound, first, side="right") - 1
    return {
        "row": row,
        "start": first - bound[row],
        "wins": last - first,
        "anchor": grams[owner[first]].view(np.int64),
        "seg": rolling.slices(first, last + spec.width - 1).view(np.int64),
    }


def occurrences(spec: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("did", "th"))
            for text in chunks(batch.column("text")):
                codes, _, _, bound = units_of(text, spec.units)
                found = segments_of(codes, bound, spec)
                order = np.lexsort((found["start"], found["seg"], found["row"]))  # equal segments of a row together
                row, seg = found["row"][order], found["seg"][order]
                heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])])[: len(order)])
                starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(found["start"][order], pa.int32()))
                one = order[heads]
                rows = found["row"][one] + text.first_row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[rows]), pa.array(th[rows]), pa.array(found["anchor"][one]), pa.array(found["seg"][one]), starts, pa.array(found["wins"][one], pa.int32())],
                    names=["did", "th", "anchor", "seg", "starts", "wins"],
                )

    return run


def fetch(spec: Windows) -> Callable:
    """The text of the wanted segments of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            flat, bounds = wanted.values, wanted.offsets.to_numpy()
            start, wins = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "wins"))
            for text in chunks(batch.column("text")):
                _, begin, end, bound = units_of(text, spec.units)
                lo, hi = bounds[text.first_row], bounds[text.first_row + text.rows]
                row = np.repeat(np.arange(text.rows), np.diff(bounds[text.first_row : text.first_row + text.rows + 1]))
                first = bound[row] + start[lo:hi]
                data = text.bytes.tobytes()
                ends = end[first + wins[lo:hi] + spec.width - 2]
                content = [data[a:b] for a, b in zip(begin[first].tolist(), ends.tolist(), strict=True)]
                part = flat.slice(lo, hi - lo)
                for i in range(0, len(content), 4096):
                    some = part.slice(i, 4096)
                    fields = {k: some.field(k) for k in ("anchor", "seg", "n", "wins", "hot")}
                    yield pa.RecordBatch.from_arrays(
                        [fields["anchor"], fields["seg"], fields["n"], fields["wins"], pa.array(content[i : i + 4096], pa.binary()), fields["hot"]],
                        names=["anchor", "seg", "n", "wins", "content", "hot"],
                    )

    return run


def in_blocks(spec: Windows, find: Callable) -> Callable:
    """Runs `find` over the segments of a task, whole anchors at a time; its rows come sorted by anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({x[:2]: x for x in rows}.values())  # rows alike in id and text send a segment twice
        text = Texts(pa.array([x[4] for x in rows], pa.binary()), 0)
        codes, _, _, bound = units_of(text, spec.units)
        codes = text.bytes if spec.units == "bytes" else codes
        owned = np.array([x[3] for x in rows], dtype=np.int64)
        again = find(codes, bound, owned, np.array([x[2] for x in rows], dtype=np.int64), spec.width)
        inside = np.zeros(len(codes) + 1, dtype=bool)
        inside[:-1] = again
        steps = np.zeros(len(codes) + 2, dtype=np.int32)
        np.add.at(steps, bound[:-1], 1)
        np.add.at(steps, bound[:-1] + owned, -1)
        inside &= np.cumsum(steps)[:-1] > 0
        lo, hi = run_bounds(inside)
        row = np.searchsorted(bound, lo, side="right") - 1
        key = [np.array([x[k] for x in rows], dtype=np.int64)[row] for k in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*key, (lo - bound[row]).astype(np.int32), (hi - bound[row]).astype(np.int32))], names=["anchor", "seg", "lo", "hi"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "seg", "n", "wins", "content")), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def cut_again(spec: Windows) -> Callable:
    """The segments of segments: rows of PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in chunks(batch.column("content")):
                codes, begin, end, bound = units_of(text, spec.units)
                found = segments_of(codes, bound, spec)
                first = bound[found["row"]] + found["start"]
                stops, data = end[first + found["wins"] + spec.width - 2].tolist(), text.bytes.tobytes()
                content = [data[a:b] for a, b in zip(begin[first].tolist(), stops, strict=True)]
                rows = pa.array(found["row"] + text.first_row)
                own = [batch.column(k).take(rows) for k in ("anchor", "seg", "n")]
                new = [pa.array(found["start"], pa.int32()), pa.array(found["anchor"]), pa.array(found["seg"]), pa.array(found["wins"], pa.int32()), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *new], names=["anchor", "seg", "n", "start", "anchor2", "seg2", "wins2", "content"])

    return run


def with_hot(distinct: DataFrame, spec: Windows) -> DataFrame:
    """distinct (anchor, seg, ...) with hot: whether the anchor has more segments than a block takes. Hot anchors are few, so their table can be sent to all where its size allows."""
    if spec.gram >= spec.width:  # an anchor is a whole window
        return distinct.withColumn("hot", F.lit(False))
    many = stage(distinct.groupBy("anchor").agg(F.count("*").alias("segs")).where(F.col("segs") > spec.most).select("anchor", F.lit(True).alias("_hot")), "hot-anchors")
    return distinct.join(many, "anchor", "left").withColumn("hot", F.coalesce("_hot", F.lit(False))).drop("_hot")


def runs_in(segments: DataFrame, spec: Windows, find: Callable) -> DataFrame:
    """RUNS of staged segments (SEGMENTS): cold anchors in blocks, hot ones cut again."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = segments.where("not hot").drop("hot").repartition(parts, "anchor").sortWithinPartitions("anchor")
    runs, hot = cold.mapInArrow(in_blocks(spec, find), RUNS), segments.where("hot")
    if spec.gram >= spec.width or hot.isEmpty():
        return runs
    finer = spec.finer()
    pieces = stage(hot.dropDuplicates(["anchor", "seg"]).select("anchor", "seg", "n", "content").mapInArrow(cut_again(finer), PIECES), "pieces")
    one = pieces.groupBy(F.col("anchor2").alias("anchor"), F.col("seg2").alias("seg")).agg(F.sum("n").alias("n"), F.first("wins2").alias("wins"), F.first("content").alias("content"))
    again = runs_in(stage(with_hot(one, finer), "segments"), finer, find)
    again = again.select(F.col("anchor").alias("anchor2"), F.col("seg").alias("seg2"), "lo", "hi")
    placed = pieces.drop("content").join(again, ["anchor2", "seg2"])
    return runs.unionByName(placed.select("anchor", "seg", (F.col("start") + F.col("lo")).cast("int").alias("lo"), (F.col("start") + F.col("hi")).cast("int").alias("hi")))


def repeated_runs(docs: DataFrame, spec: Windows, find: Callable) -> DataFrame:
    """(did, th, runs): for each distinct row with a repeated window, the runs [lo, hi) of first units of such windows, from each of `starts`.

    docs: as from staging.keyed. find(codes, bound, owned, count, width) gives a mask over the units of some
    segments: those at which a window starts that another place holds too.
    """
    seen = docs.select("did", "th", "text").mapInArrow(occurrences(spec), OCCURRENCES)
    shared = seen.groupBy("anchor").agg(F.sum(F.size("starts")).alias("times")).where("times > 1").select("anchor")
    seen = stage(seen.join(shared, "anchor").select("did", "th", "anchor", "seg", "starts", "wins"), "occurrences")
    at = F.struct("did", "th", F.col("starts")[0].alias("start"), "wins")
    distinct = with_hot(seen.groupBy("anchor", "seg").agg(F.sum(F.size("starts")).alias("n"), F.min(at).alias("at")), spec)
    wanted = distinct.groupBy(F.col("at.did").alias("did"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct("anchor", "seg", "n", F.col("at.start").alias("start"), F.col("at.wins").alias("wins"), "hot")).alias("wanted")
    )
    segments = docs.alias("l").join(wanted.alias("r"), same_row()).select("text", "wanted").mapInArrow(fetch(spec), SEGMENTS)
    runs = runs_in(stage(segments, "segments"), spec, find)
    placed = seen.join(runs, ["anchor", "seg"])
    return placed.groupBy("did", "th").agg(F.collect_set(F.struct("starts", "lo", "hi")).alias("runs"))


def removed(docs: DataFrame, spec: Windows, find: Callable, apply: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """docs with its repeated runs, given to `apply` (an Arrow map of doc_id, text, runs)."""
    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, spec, find)
    return rows.alias("l").join(runs.alias("r"), same_row(), "left").select("doc_id", "text", "runs").mapInArrow(apply, schema)


def runs_of(column: pa.ListArray, width: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each row of runs, the begins and ends of the removed units, or None where there are none."""
    flat, starts = column.values, column.values.field("starts")
    at, times = starts.values.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts.offsets.to_numpy())
    lo, hi = (np.repeat(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64), times) for k in ("lo", "hi"))
    bounds = starts.offsets.to_numpy()[column.offsets.to_numpy()]
    return [None if a == b else (at[a:b] + lo[a:b], at[a:b] + hi[a:b] + width - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
