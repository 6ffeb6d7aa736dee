"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

The suffixes of a block of segments (see repeats.py) are put into buckets by their first eight bytes. A
bucket is refined by sorting its members on the bucket identifiers of later offsets; identifiers are
replaced in place, so each refinement reuses the ones before it and multiplies the depth: by three where
three identifiers fit into one 64-bit key, else by two. Members alone in
their bucket are finished. At depth `width`, suffixes still in company start a repeated string.

Two depths are asked for: `passage`, about fifty short words, and the longer one at which bytes go. What repeats at
the longer depth lies in what repeats at the shorter one, so the second refinement has only those parts to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import covered, run_bounds
from .repeats import Windows, repeated_runs, runs_of
from .staging import keyed, same_row, stage

BYTES = Windows(units="bytes", width=400, gram=48)
PASSAGE = Windows(units="bytes", width=200, gram=48)
RESULT = "doc_id long, n_bytes long, n_removed long, n_passage long, spans array<struct<start:int,end:int>>, kept binary"


def refine(codes: np.ndarray, bound: np.ndarray, owned: np.ndarray, count: np.ndarray, width: int, first: int = 8) -> np.ndarray:
    """Starts of repeated windows; codes: one per byte."""
    n, sizes = len(codes), np.diff(bound)
    again = np.repeat(count > 1, sizes)  # the segment stands elsewhere in full
    left = np.repeat(bound[1:], sizes) - np.arange(n)  # units up to the segment's end
    small = codes if codes.dtype == np.uint8 else np.unique(codes, return_inverse=True)[1]
    key = small.astype(np.uint64)
    bits = np.uint64(max(int(small.max(initial=0)).bit_length(), 1))
    first = min(first, width, 64 // int(bits))
    at = np.flatnonzero(left >= first)
    gram = np.zeros(len(at), dtype=np.uint64)
    for j in range(first):
        gram = (gram << bits) | key[at + j]
    # Identifiers only grow, so a finished member keeps one that no other has.
    bucket = np.zeros(n, dtype=np.uint64)
    base = 1

    def split(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """New identifiers for the buckets that key tells apart; the members still in company, in order of place."""
        nonlocal base
        if not len(at):
            return at
        order = np.argsort(key)
        ordered = key[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(heads, len(order)))
        number = np.repeat(np.arange(len(heads)), size)
        place = at[order]
        bucket[place] = (base + number).astype(np.uint64)
        base += len(heads)
        company = np.zeros(n, dtype=bool)
        company[place] = np.repeat(size > 1, size)
        return np.flatnonzero(company)

    at = split(at, gram)
    step = first
    while step < width and len(at):
        wide = 64 // (base.bit_length())  # identifiers that fit into a key
        parts = 3 if wide >= 3 and width > 2 * step else 2
        depth = min(parts * step, width)
        at = at[left[at] >= depth]
        room = np.uint64(64 // parts)
        joint = bucket[at]
        for part in range(1, parts):
            joint = (joint << room) | bucket[at + min(part * step, depth - step)]
        at = split(at, joint)
        step = depth
    again[at[left[at] >= width]] = True
    return again


def parts(short: int, long: int):
    """did, th, at, text: the maximal runs of bytes in repeated strings of `short` bytes that could hold one of `long` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, text = [], [], []
            for r, (data, runs) in enumerate(zip(batch.column("text"), runs_of(batch.column("runs"), short), strict=True)):
                data = data.as_py().encode()
                for a, b in zip(*(x.tolist() for x in run_bounds(covered(len(data), *runs))), strict=True):
                    if b - a >= long:
                        rows.append(r)
                        at.append(a)
                        text.append(data[a:b])
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in ("did", "th")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(text, pa.binary())], names=["did", "th", "at", "text"])

    return run


def remove(width: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_n, gone_n, passage_n, spans, kept = [], [], [], [], []
            found = batch.column("found")
            inner, of = runs_of(found.values.field("runs"), width), found.offsets.to_numpy()
            offsets = found.values.field("at").to_pylist()
            for r, (text, runs) in enumerate(zip(batch.column("text"), runs_of(batch.column("runs"), passage), strict=True)):
                data = text.as_py().encode()
                bytes_n.append(len(data))
                passage_n.append(0 if runs is None else int(covered(len(data), *runs).sum()))
                own = range(of[r], of[r + 1])
                if not own:
                    gone_n.append(0)
                    spans.append([])
                else:
                    gone = covered(len(data), *(np.concatenate([offsets[i] + inner[i][k] for i in own]) for k in (0, 1)))
                    gone_n.append(int(gone.sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in run_bounds(gone)), strict=True)])
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                kept.append(data)
            numbers = [pa.array(x, pa.int64()) for x in (bytes_n, gone_n, passage_n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_passage", "spans", "kept"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, spec: Windows = BYTES, passage: Windows = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_passage, spans (maximal removed runs of bytes, end exclusive), kept (the other bytes).

    A byte goes if it is in a string of spec.width bytes that also starts anywhere else, same text included;
    overlaps count. n_passage counts the bytes in such strings of passage.width bytes (at most spec.width), which stay
    unless they go by the first rule. Null and empty texts have no bytes. Rows alike in id and text are copies of
    each other. Texts of any length are read whole. Other columns are not read. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    near = stage(repeated_runs(rows, passage, refine), "passages")
    held = rows.alias("l").join(near.alias("r"), same_row()).select("l.did", "l.th", "text", "runs")
    held = stage(held.mapInArrow(parts(passage.width, spec.width), "did long, th long, at int, text binary"), "parts")
    place = F.xxhash64("th", "at")  # a part is a text of its own
    far = repeated_runs(held.select("did", place.alias("th"), "text"), spec, refine)
    own = held.select("did", place.alias("pth"), "th", "at").distinct()
    far = far.select("did", F.col("th").alias("pth"), "runs").join(own, ["did", "pth"]).groupBy("did", "th").agg(F.collect_list(F.struct("at", "runs")).alias("found"))
    both = near.join(far, ["did", "th"], "left")
    found = F.coalesce("found", F.array().cast(far.schema["found"].dataType)).alias("found")
    return rows.alias("l").join(both.alias("r"), same_row(), "left").select("doc_id", "text", "runs", found).mapInArrow(remove(spec.width, passage.width), RESULT)
