"""Language identification by known words first, character n-grams of unseen words after.

A known word scores by its log frequency in each language. An unseen word is cut into the longest character
n-grams; those that are unseen too fall back to the n-grams one shorter, down to single characters. Counts
come from a sample of at most SAMPLE labelled rows (those of least hash, so the same rows each time), which bounds what
is sent to executors; all words and n-grams that occur in it are known.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers that are no digits, as ½ or Ⅳ, are word characters to `re`, but not letters.
NUMBERS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))
BLANKED = dict.fromkeys(map(ord, NUMBERS), " ")
#: Lengths of the n-grams of words bounded by spaces, the longest first.
GRAMS = (4, 3, 2, 1)
SAMPLE = 5_000
#: Log probabilities of one text are divided by a power of its number of words, lest scores be all 0 or 1.
TEMPER = 0.5


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii() and not NUMBERS.isdisjoint(text):
        text = text.translate(BLANKED)
    return LETTERS.findall(text)


def grams_of(word: str, n: int) -> list[str]:
    bounded = f" {word} " if n > 1 else word
    return [bounded[i : i + n] for i in range(len(bounded) - n + 1)] if len(bounded) >= n else []


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, item, times): words (n 0) and n-grams, summed over some rows at a time."""
    names = ["lang", "n", "item", "times"]

    def flush(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            grams: Counter = Counter()
            for word, times in words.items():
                for n in GRAMS:
                    for gram in grams_of(word, n):
                        grams[n, gram] += times
            rows = [(0, w, c) for w, c in words.items()] + [(n, g, c) for (n, g), c in grams.items()]
            for i in range(0, len(rows), 50_000):
                n, item, times = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(n, pa.int32()), pa.array(item, pa.string()), pa.array(times, pa.int64())], names=names)

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text.as_py()))
        if sum(map(len, held.values())) > 100_000:
            yield from flush(held)
            held = {}
    yield from flush(held)


class Model:
    """Log frequencies per language of known words and n-grams."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int], langs: list[str]) -> None:
        self.langs = langs
        times: dict[tuple[int, str], dict[str, int]] = {}
        for lang, n, item, count in rows:
            times.setdefault((n, item), {})[lang] = count
        kinds = Counter(n for n, _ in times)
        self.known = {
            (n, item): tuple(log((own.get(x, 0) + 0.5) / (totals.get((x, n), 0) + 0.5 * (kinds[n] + 1))) for x in langs) for (n, item), own in times.items()
        }

    def backed_off(self, gram: str, n: int) -> np.ndarray:
        """Sum and number of the scores of a gram's known pieces: itself, or those of its grams one shorter, place by place."""
        scores = self.known.get((n, gram))
        if scores is not None:
            return np.array([*scores, 1.0])
        found = np.zeros(len(self.langs) + 1)
        if n > 1:
            for i in range(len(gram) - n + 2):
                if gram[i : i + n - 1].strip():
                    found += self.backed_off(gram[i : i + n - 1], n - 1)
        return found


class Rows:
    """What was computed for some strings: their rows in a table that grows, and starts anew beyond `room`."""

    def __init__(self, columns: int, room: int = 200_000) -> None:
        self.place: dict[str, int] = {}
        self.table, self.room = np.zeros((1024, columns)), room

    def of(self, items: Sequence[str], compute: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """The row of each item. compute: rows of those not held yet."""
        if len(self.place) > self.room:
            self.place.clear()
        fresh = list(dict.fromkeys(x for x in items if x not in self.place))
        if fresh:
            first, size = len(self.place), len(self.place) + len(fresh)
            if size > len(self.table):
                self.table = np.concatenate([self.table[:first], np.zeros((2 * size - first, self.table.shape[1]))])
            self.table[first:size] = compute(fresh)
            self.place.update(zip(fresh, range(first, size), strict=True))
        return self.table[np.fromiter(map(self.place.__getitem__, items), dtype=np.int64, count=len(items))]


class Predictor:
    """A model with the scores of the words and n-grams it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.words, self.grams = model, Rows(len(model.langs)), Rows(len(model.langs) + 1)

    def backed_off(self, grams: list[str]) -> np.ndarray:
        return np.array([self.model.backed_off(x, GRAMS[0]) for x in grams])

    def scores(self, words: list[str]) -> np.ndarray:
        """A word's own scores, or the mean of its n-grams' at the longest length that is known, place by place."""
        own = [self.model.known.get((0, x)) for x in words]
        found = np.array([x or (0.0,) * len(self.model.langs) for x in own])
        unseen = np.array([i for i, x in enumerate(own) if x is None], dtype=np.int64)
        if len(unseen):
            grams = [grams_of(words[i], GRAMS[0]) or [f" {words[i]} "] for i in unseen]
            rows = self.grams.of(list(chain.from_iterable(grams)), self.backed_off)
            sums = np.add.reduceat(rows, np.cumsum([0, *map(len, grams[:-1])]), axis=0)
            found[unseen] = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words, langs = Counter(words_of(text or "")), self.model.langs
        if not words or not langs:
            return "und", 0.0
        times = np.fromiter(words.values(), dtype=np.float64, count=len(words))
        total = times @ self.words.of(list(words), self.scores)
        best = int(np.argmax(total))
        return langs[best], float(1.0 / np.exp((total - total[best]) / times.sum() ** TEMPER).sum())


def least_hashed(rows: DataFrame, sample: int) -> DataFrame:
    """The `sample` rows of least h, a signed 64-bit hash; ties by lang.

    Rows are first counted by the bits of the hash's place in the order, so that only the rows of the least
    powers of two, about twice the sample, are sent to one task to be sorted.
    """
    place = F.shiftright("h", 1) + F.lit(1 << 62)
    bits = F.length(F.bin(place))
    counts = {r["bits"]: r["count"] for r in rows.groupBy(bits.alias("bits")).count().collect()}
    total, most = 0, 0
    for most in sorted(counts):
        total += counts[most]
        if total >= sample:
            break
    return rows.where(bits <= most).orderBy("h", "lang").limit(sample)


def train(labelled: DataFrame, sample: int = SAMPLE, least: int = 1) -> Model:
    """Learn from (doc_id, text, lang); rows with a null text or lang are left out, and rows alike count as often as they stand there.

    At most `sample` rows are learned from, of which all words and n-grams are kept that occur `least` times or more; texts of
    any length are read whole. No rows give a model without languages.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("h"))
    rows = least_hashed(rows, sample).repartition("h").select("lang", "text")
    counts = rows.mapInArrow(counted, "lang string, n int, item string, times long").groupBy("lang", "n", "item").agg(F.sum("times").alias("times"))
    entries = counts.groupBy("n", "item").agg(F.sum("times").alias("all"), F.collect_list(F.struct("lang", "times")).alias("by"))
    entries = stage(entries.where(F.col("all") >= least), "language-counts")
    kept = [(b["lang"], r["n"], r["item"], b["times"]) for r in entries.toLocalIterator() for b in r["by"]]
    totals: Counter = Counter()
    for lang, n, _, times in kept:
        totals[lang, n] += times
    return Model(kept, totals, sorted({x[0] for x in kept}))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), one row per row of docs.

    A null text or one without letters (Unicode category L) is `und` at score 0, as is any text of a model without languages; of equal
    scores the first language by name is taken. Only the text is read, whole; an empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # once for each executor; bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [predictor.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
