"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is routed into reference blocks: segments of text that share an anchor stand in one block (see
repeats.py), and two equal windows always do. Each block is indexed by suffix ranks over word identifiers, and
each of its segments is parsed greedily against the index: a factor is the longest match, at any other place,
of what follows; the next factor begins at its end. Matches are looked up only where the parse asks.

A factor of at least `width` words is a duplicate span. A repeated window that begins in one factor and goes
beyond it ends in the next: what follows the boundary occurs elsewhere as well, so the greedy next factor reaches
the window's end. So only windows across a boundary of two factors of together at least `width` words
are looked up besides, and no repeated window is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import covered, run_bounds
from .repeats import Windows, removed, runs_of

WORDS = Windows(units="words", width=35, gram=8)
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


class Reference:
    """The suffixes of a block's segments, ranked by doubled prefixes; each segment ends in a symbol of its own."""

    def __init__(self, codes: np.ndarray, bound: np.ndarray) -> None:
        segs = len(bound) - 1
        self.n = n = len(codes) + segs
        ends = bound[1:] + np.arange(segs)  # where each segment's closing symbol stands
        units = np.ones(n, dtype=bool)
        units[ends] = False
        self.place = np.flatnonzero(units)
        words, ids = np.unique(codes, return_inverse=True)
        rank = np.zeros(n, dtype=np.int64)
        rank[units] = ids
        rank[ends] = len(words) + np.arange(segs)
        longest = int(np.diff(bound).max(initial=0)) + 1
        self.levels, step = [rank], 1
        while step < longest:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + len(words) + 2) + after, return_inverse=True)[1]
            self.levels.append(rank)
            step *= 2
        # suffixes end in symbols of their own, so the last ranks are all different
        self.rank, self.order = rank, np.argsort(rank)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The length of the common prefix of suffixes, from the longest doubled prefix down."""
        out = np.zeros(len(left), dtype=np.int64)
        for power in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero((left + out < self.n) & (right + out < self.n))
            same = inside[self.levels[power][left[inside] + out[inside]] == self.levels[power][right[inside] + out[inside]]]
            out[same] += 1 << power
        return out

    def longest(self, at: np.ndarray) -> np.ndarray:
        """The longest match of what follows the given units at any other place: one of the neighbours in rank has it."""
        at = self.place[at]
        rank = self.rank[at]
        out = np.zeros(len(at), dtype=np.int64)
        for other in (rank - 1, rank + 1):
            known = np.flatnonzero((other >= 0) & (other < self.n))
            out[known] = np.maximum(out[known], self.common(at[known], self.order[other[known]]))
        return out


def places(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the runs begin:end; runs that end before they begin are empty."""
    size = np.maximum(end - begin, 0)
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def factor(codes: np.ndarray, bound: np.ndarray, owned: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Starts of repeated windows: the segments of a block are parsed in step, a factor of each at a time."""
    again = np.zeros(len(codes), dtype=bool)
    if not len(codes):
        return again
    reference = Reference(codes, bound)
    whole = count > 1  # the segment stands elsewhere in full
    at, end, before = bound[:-1].copy(), bound[1:], bound[:-1].copy()
    while len(at):
        going = at < end
        at, end, before, whole = at[going], end[going], before[going], whole[going]
        length = end - at
        asked = np.flatnonzero(~whole)
        length[asked] = np.maximum(reference.longest(at[asked]), 1)
        stop = at + length
        again[places(at, stop - width + 1)] = True
        across = places(np.maximum(before, at - width + 1), np.minimum(at, stop - width + 1))
        again[across[reference.longest(across) >= width]] = True
        before, at = at, stop
    return again


def remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, gone_n, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), runs_of(batch.column("runs"), width), strict=True):
                words = text.encode().split()  # bytes.split() cuts at the six ASCII spaces only
                words_n.append(len(words))
                if runs is None:
                    gone_n.append(0)
                    spans.append([])
                else:
                    gone = covered(len(words), *runs)
                    gone_n.append(int(gone.sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in run_bounds(gone)), strict=True)])
                    words = list(compress(words, (~gone).tolist()))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def remove_repeated_words(docs: DataFrame, spec: Windows = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word runs removed, end exclusive), kept (the other words, joined by one space).

    A word goes if it is in a window of spec.width words that also starts anywhere else, same text included.
    Null and empty texts have no words and keep ''. Rows alike in id and text are copies of each other. Texts of any
    length are read whole. Other columns are not read. An empty table gives an empty result.
    """
    return removed(docs, spec, factor, remove(spec.width), RESULT, id_col, text_col)
