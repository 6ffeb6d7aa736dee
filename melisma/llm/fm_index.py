"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of documents of bounded size. Its words become identifiers of the benchmark's vocabulary;
words outside it, and words whose neighbours form no word pair of the benchmark, can't be in a test phrase
and become separators. Over what is left the shard builds a suffix array, the Burrows-Wheeler transform as a wavelet
matrix with ranks, and samples of suffix positions. All test phrases are searched backwards at once; their
occurrences are located by stepping to the next sampled position, and overlapping ones merge into spans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, chunks, covered, run_bounds, word_codes
from .staging import fresh, keyed, same_row, stage

#: Bytes that make words of [0-9a-z] and other than ASCII, after A-Z became a-z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
WORDY = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
SHARD_BYTES = 1 << 18
#: Words of test phrases sent to the executors at a time; larger benchmarks take several passes.
PHRASE_WORDS = 2_000_000
SAMPLED = 8
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Phrases:
    """Distinct windows of the items, as rows of vocabulary numbers (1 and up), by their length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        text = Texts(pa.array([x[1] for x in items], pa.string()), 0)
        start, end, bound = text.words(WORDY)
        codes = word_codes(text, start, end, FOLD)
        self.names = [x[0] for x in items]
        self.vocabulary, ids = np.unique(codes, return_inverse=True)
        ids = ids + 1
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for row, (a, b) in enumerate(zip(bound, bound[1:], strict=False)):
            words = tuple(ids[a:b].tolist())
            for i in range(max(len(words) - width + 1, bool(words))):
                owners[words[i : i + width]].add(row)
        self.owners = [sorted(x) for x in owners.values()]
        by_length = defaultdict(list)
        for k, phrase in enumerate(owners):
            by_length[len(phrase)].append((phrase, k))
        self.groups = [(n, np.array([x[0] for x in v], dtype=np.int64), np.array([x[1] for x in v])) for n, v in sorted(by_length.items())]
        self.least = min(by_length, default=0)
        self.base = len(self.vocabulary) + 1
        pairs = [g[:, :-1] * self.base + g[:, 1:] for n, g, _ in self.groups if n > 1]
        self.pairs = np.unique(np.concatenate([x.ravel() for x in pairs])) if pairs else np.zeros(0, dtype=np.int64)
        self.alone = np.unique(np.concatenate([g.ravel() for n, g, _ in self.groups if n == 1])) if self.least == 1 else np.zeros(0, dtype=np.int64)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, 0 outside."""
        if not len(self.vocabulary):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, at + 1, 0)


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit vector per bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = []
        for bit in range(max(top.bit_length(), 1) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            ranks = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, len(symbols) - int(ranks[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before `at`."""
        start = np.zeros_like(at)
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            start = np.where(one, zeros + ranks[start], start - ranks[start])
            at = np.where(one, zeros + ranks[at], at - ranks[at])
        return at - start


class FMIndex:
    """Of a sequence of numbers in which 0 separates runs; phrases hold no 0."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        n = len(symbols)
        gap = symbols == 0
        rank = symbols + np.int64(n)
        rank[gap] = np.arange(gap.sum())  # separators differ, so no comparison goes past one
        rank = np.unique(rank, return_inverse=True)[1]
        step = 1
        while rank.max(initial=-1) < n - 1:
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            step *= 2
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        before = symbols[suffixes - 1]
        before[suffixes == 0] = 0
        self.before, self.matrix = before, WaveletMatrix(before, top)
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        at_start = np.concatenate([[True], gap[:-1]]) if n else gap
        sampled = at_start | (np.arange(n) % SAMPLED == 0)  # the walk back never has to pass a separator
        self.sample = np.where(sampled[suffixes], suffixes, -1)
        self.size = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase; rows of equal length."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            lo[live] = self.first[symbol] + self.matrix.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.matrix.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        found = self.sample[rows]
        left = np.flatnonzero(found < 0)
        while len(left):
            symbol = self.before[rows[left]]
            rows[left] = self.first[symbol] + self.matrix.rank(symbol, rows[left])
            steps[left] += 1
            found[left] = self.sample[rows[left]]
            left = left[found[left] < 0]
        return found + steps


def occurrences(numbers: np.ndarray, bound: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, number of the phrase) of each occurrence in a shard, in words of the shard."""
    n, none = len(numbers), np.zeros(0, dtype=np.int64)
    heads = np.zeros(n + 1, dtype=bool)
    heads[bound] = True
    paired = np.zeros(n + 1, dtype=bool)  # the word and its left neighbour are a pair of the benchmark
    if n > 1:
        paired[1:-1] = ~heads[1:n] & member(phrases.pairs, numbers[:-1] * phrases.base + numbers[1:])
    alive = (numbers > 0) & (paired[:-1] | paired[1:] | member(phrases.alone, numbers))
    begin = np.flatnonzero(alive & ~(paired[:-1] & np.concatenate([[False], alive[:-1]]))) if n else none
    run = np.cumsum(np.isin(np.arange(n), begin, assume_unique=True)) if n else none
    run = np.where(alive, run, 0)
    sizes = np.bincount(run, minlength=1)
    sizes[0] = 0
    kept = np.flatnonzero(sizes[run] >= phrases.least) if phrases.least else none
    if not len(kept):
        return none, none, none
    fresh = np.concatenate([[True], run[kept][1:] != run[kept][:-1]])
    place = np.arange(len(kept)) + np.cumsum(fresh) - 1
    symbols, words = np.zeros(place[-1] + 2, dtype=np.int64), np.zeros(place[-1] + 2, dtype=np.int64)
    symbols[place], words[place] = numbers[kept], kept
    index = FMIndex(symbols, phrases.base)
    out = []
    for length, rows, which in phrases.groups:
        lo, hi = index.search(rows)
        times = hi - lo
        total = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        first = words[index.locate(total)]
        out.append((first, first + length, np.repeat(which, times)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find_hits(phrases: Phrases):
    """Rows of RESULT for each document of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in chunks(batch.column("text"), SHARD_BYTES):
                start, end, bound = text.words(WORDY)
                numbers = phrases.numbers(word_codes(text, start, end, FOLD))
                first, last, which = occurrences(numbers, bound, phrases)
                hit = covered(len(numbers), first, last)
                cut = hit.copy()  # spans end with their document
                lo, hi = run_bounds(cut)
                row_of = np.searchsorted(bound, first, side="right") - 1
                items: list[set[int]] = [set() for _ in range(text.rows)]
                for r, w in {(a, b) for a, b in zip(row_of.tolist(), which.tolist(), strict=True)}:
                    items[r].update(phrases.owners[w])
                spans: list[list[dict]] = [[] for _ in range(text.rows)]
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    while a < b:
                        r = int(np.searchsorted(bound, a, side="right")) - 1
                        stop = min(b, int(bound[r + 1]))
                        spans[r].append({"start": a - int(bound[r]), "end": stop - int(bound[r])})
                        a = stop
                sums = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(text.first_row, text.rows),
                        pa.array(np.diff(bound), pa.int64()),
                        pa.array(sums[bound[1:]] - sums[bound[:-1]], pa.int64()),
                        pa.array([sorted({phrases.names[i] for i in x}) for x in items], pa.list_(pa.string())),
                        pa.array(spans, SPANS),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[Phrases]:
    """The items in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((name or "", text))
        size += len(text or "") // 2 + 1
        if size >= PHRASE_WORDS:
            yield Phrases(held, width)
            held, size = [], 0
    if held:
        yield Phrases(held, width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items (names of items with an occurring window, sorted), spans (of hit words, end exclusive).

    A window is `width` consecutive words of an item, or a shorter item's words. A document word in any
    occurrence of a window is hit. Null and empty texts have no words; an empty benchmark hits nothing; a null item
    name counts as ''. Rows alike each get their result; other columns are not read. Texts of any length are searched whole. The
    benchmark is read in blocks of PHRASE_WORDS; beyond one block the results of the blocks are merged by row.
    """
    rows = keyed(docs, id_col, text_col)
    blocks = phrase_blocks(benchmark, item_col, "text", width)
    first, second = next(blocks, None) or Phrases([], width), next(blocks, None)
    if second is None:
        return rows.select("doc_id", "text").mapInArrow(find_hits(first), RESULT)
    found = None
    for block in chain([first, second], blocks):  # each block's hits are written, so the driver holds one block at a time
        part = rows.select(F.struct("did", "th").alias("doc_id"), "text").mapInArrow(find_hits(block), RESULT.replace("doc_id long", "doc_id struct<did:long,th:long>"))
        part = stage(part.where("n_hit > 0").select("doc_id.did", "doc_id.th", "items", "spans"), "hits")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    joined = rows.alias("l").join(merged.alias("r"), same_row(), "left").select("doc_id", "text", "items", "spans")
    return joined.mapInArrow(merge_hits, RESULT)


def merge_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, items, spans = [], [], [], []
        for text, names, found in zip(*(batch.column(k).to_pylist() for k in ("text", "items", "spans")), strict=True):
            n = len(Texts(pa.array([text]), 0).words(WORDY)[0])
            hit = covered(n, *(np.array([x[k] for x in found or []], dtype=np.int64) for k in ("start", "end")))
            lo, hi = run_bounds(hit)
            n_words.append(n)
            n_hit.append(int(hit.sum()))
            items.append(names or [])
            spans.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], names=["doc_id", "n_words", "n_hit", "items", "spans"]
        )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with the hit words and what stands between them cut out of the texts.

    Null texts stay null, texts of any length are searched whole, and rows alike are cut alike. Columns may have any names. All
    blocks of the benchmark are searched in the texts as given, in one pass without exchange; the words that any of
    them hits are cut once. An empty benchmark cuts nothing.
    """
    blocks = list(phrase_blocks(benchmark, "item_id", "text", width))
    if not blocks:
        return docs
    hits = fresh(docs, "hits")  # the column of the words that earlier blocks hit
    marked = docs if len(blocks) == 1 else docs.withColumn(hits, F.array().cast("array<struct<start:int,end:int>>"))
    for block in blocks[:-1]:
        marked = marked.mapInArrow(marker(block, text_col, hits), marked.schema)
    return marked.mapInArrow(cutter(blocks[-1], text_col, hits), docs.schema)


def hit_runs(text: Texts, phrases: Phrases, earlier: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]:
    """start, end and bound of the text's words, and by row the runs of words, counted from its first, that this block or an earlier one hits."""
    start, end, bound = text.words(WORDY)
    first, last, _ = occurrences(phrases.numbers(word_codes(text, start, end, FOLD)), bound, phrases)
    known = [(bound[r] + x["start"], bound[r] + x["end"]) for r, found in enumerate(earlier) for x in found]
    first, last = (np.concatenate([v, np.array([x[k] for x in known], dtype=np.int64)]) for k, v in enumerate((first, last)))
    lo, hi = run_bounds(covered(len(start), first, last))
    runs = {}
    for r in set((np.searchsorted(bound, first, side="right") - 1).tolist()):
        inside = (lo < bound[r + 1]) & (hi > bound[r])
        runs[r] = [(max(a, int(bound[r])) - int(bound[r]), min(b, int(bound[r + 1])) - int(bound[r])) for a, b in zip(lo[inside].tolist(), hi[inside].tolist(), strict=True)]
    return start, end, bound, runs


def hits_of(batch: pa.RecordBatch, text: Texts, hits: str) -> list[list[dict]]:
    """What earlier blocks hit in the rows of text."""
    return batch.column(hits).slice(text.first_row, text.rows).to_pylist() if hits in batch.schema.names else []


def marker(phrases: Phrases, text_col: str, hits: str):
    """The rows with this block's hits added to the column hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for text in chunks(batch.column(text_col), SHARD_BYTES):
                runs = hit_runs(text, phrases, hits_of(batch, text, hits))[3]
                found = pa.array([[{"start": a, "end": b} for a, b in runs.get(r, [])] for r in range(text.rows)], SPANS)
                part = batch.slice(text.first_row, text.rows)
                yield pa.RecordBatch.from_arrays([found if k == hits else part.column(k) for k in names], names=names)

    return run


def cutter(phrases: Phrases, text_col: str, hits: str):
    """The rows without the column hits, and their texts without the words in it and this block's hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [k for k in batch.schema.names if k != hits]
            for text in chunks(batch.column(text_col), SHARD_BYTES):
                start, end, bound, runs = hit_runs(text, phrases, hits_of(batch, text, hits))
                part = batch.slice(text.first_row, text.rows)
                texts = part.column(text_col).to_pylist()
                for r, cuts in runs.items():
                    at, kept = 0, []
                    for a, b in cuts:
                        kept.append(text.raw[r][at : start[bound[r] + a] - text.starts[r]])
                        at = end[bound[r] + b - 1] - text.starts[r]
                    texts[r] = b"".join([*kept, text.raw[r][at:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == text_col else part.column(k) for k in names], names=names)

    return run
