"""Toxicity by a classifier chain.

The categories are predicted one after another by logistic models over learned terms: words, and beginnings of words, as
languages that compound or inflect hide a word in many. A term's value is its damped share of the text's words. A
later model also sees the probabilities of the categories before it. It is trained on out-of-fold predictions of
those, so it learns how far they can be trusted on rows they were not fitted to.

CHAIN names the categories in order and how a label row (quality 0/1, toxic 0/1) marks them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAIN = (
    ("low_quality", lambda quality, toxic: int(quality == 0)),
    ("objectionable", lambda quality, toxic: int(quality == 0 or toxic == 1)),
    ("toxic", lambda quality, toxic: int(toxic == 1)),
)
WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is fitted: labelled rows (those of least hash), bytes of their texts, terms a category.
SAMPLE, SAMPLE_BYTES, TERMS, LEAST_ROWS, FOLDS = 4_000, 64 << 20, 150, 4, 4
#: Lengths of the beginnings of words; a beginning is written with MORE after it.
BEGINS, MORE = (4, 5, 6, 7), "~"


def begins(word: str) -> list[str]:
    return [word[:n] + MORE for n in BEGINS if len(word) > n]


def damped(times: float, words: int) -> float:
    """The value of a term that stands so often among so many words."""
    return log1p(min(200.0 * times / words, 8.0))


def terms_of(text: str | None) -> dict[str, float]:
    """The value of each term of a text."""
    words = Counter(WORD.findall((text or "").lower()))
    out, n = Counter(words), words.total()
    for word, times in words.items():
        for begin in begins(word):
            out[begin] += times
    return {t: damped(times, n) for t, times in out.items()}


class Sample:
    """Texts as arrays of term numbers and values; terms in fewer than LEAST_ROWS texts are left out."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        number: dict[str, int] = {}
        ids, values = [], []
        for text in texts:
            terms = terms_of(text)
            ids.append(np.fromiter((number.setdefault(t, len(number)) for t in terms), dtype=np.int32, count=len(terms)))
            values.append(np.fromiter(terms.values(), dtype=np.float32, count=len(terms)))
        often = np.bincount(np.concatenate([*ids, np.zeros(0, dtype=np.int32)]), minlength=len(number)) >= LEAST_ROWS
        self.names = [t for t, i in number.items() if often[i]]
        new = np.cumsum(often) - 1
        self.rows = [(new[i[often[i]]], v[often[i]]) for i, v in zip(ids, values, strict=True)]

    def select(self, own: np.ndarray, truth: np.ndarray, most: int = TERMS) -> list[str]:
        """Terms whose presence in the own rows says most about the category: the largest log-likelihood ratio, for or against; ties by text. Of terms of the same rows the first stays."""
        n, positive = len(own), float(truth.sum())
        flat = np.concatenate([self.rows[r][0] for r in own])
        row = np.repeat(np.arange(n), [len(self.rows[r][0]) for r in own])
        df = np.bincount(flat, minlength=len(self.names)).astype(float)
        with_it = np.bincount(flat, weights=truth[row], minlength=len(self.names))

        def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
            return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))

        negative = n - positive
        ratio = part(with_it, df * positive / n) + part(df - with_it, df * negative / n)
        ratio += part(positive - with_it, (n - df) * positive / n) + part(negative - df + with_it, (n - df) * negative / n)
        able = np.flatnonzero((df >= LEAST_ROWS) & (df < n))
        scored = sorted((-float(ratio[i]), self.names[i], int(i)) for i in able[np.argsort(-ratio[able], kind="stable")[: 8 * most]])[: 4 * most]
        place = np.full(len(self.names), -1)
        place[[i for *_, i in scored]] = np.arange(len(scored))
        at = place[flat]
        order = np.lexsort((row[at >= 0], at[at >= 0]))
        held = np.split(row[at >= 0][order], np.cumsum(np.bincount(at[at >= 0], minlength=len(scored)))[:-1]) if scored else []
        first: dict[bytes, str] = {}
        for (_, name, _), rows in zip(scored, held, strict=True):
            first.setdefault(rows.tobytes(), name)
        return list(first.values())[:most]

    def matrix(self, own: np.ndarray, terms: list[str], before: list[np.ndarray]) -> np.ndarray:
        """A row of term values, then of the probabilities of the categories before, for each of the own rows."""
        wanted = {t: i for i, t in enumerate(terms)}
        place = np.array([wanted.get(t, -1) for t in self.names], dtype=np.int64)
        x = np.zeros((len(own), len(terms) + len(before)))
        for k, r in enumerate(own):
            ids, values = self.rows[r]
            at = place[ids]
            x[k, at[at >= 0]] = values[at >= 0]
        for i, p in enumerate(before):
            x[:, len(terms) + i] = p[own]
        return x


def fit(x: np.ndarray, y: np.ndarray, decay: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) of a logistic model by Newton steps, with a penalty on all but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], decay)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of its terms, of the categories before it, and the bias."""

    name: str
    terms: list[str]
    weights: np.ndarray


def train_chain(sample: Sample, labels: list[tuple[int, int]]) -> list[Link]:
    """The chain's models. Fold of a row: its place modulo FOLDS. A category without both values is skipped."""
    every = np.arange(len(sample.rows))
    chain: list[Link] = []
    before: list[np.ndarray] = []  # out-of-fold probabilities of the categories so far
    for name, mark in CHAIN:
        y = np.array([mark(*x) for x in labels], dtype=float)
        if not 0 < y.sum() < len(y):
            continue
        outside = np.zeros(len(y))
        for f in range(FOLDS):
            own, rest = every[every % FOLDS == f], every[every % FOLDS != f]
            if not len(own) or not 0 < y[rest].sum() < len(rest):
                outside[own] = y.mean()
                continue
            terms = sample.select(rest, y[rest])
            outside[own] = apply(fit(sample.matrix(rest, terms, before), y[rest]), sample.matrix(own, terms, before))
        terms = sample.select(every, y)
        chain.append(Link(name, terms, fit(sample.matrix(every, terms, before), y)))
        before.append(outside)
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """Learn from at most `sample` labelled rows, read in order of the hash of their ids until SAMPLE_BYTES are held.

    Labels or ids that are null are left out; of several labels of an id the least quality and the greatest toxic count. Null texts
    count as empty, rows alike as often as they stand there. No labelled rows, or rows of one kind only, give no model.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = marked.select("doc_id", "quality", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(marked), "doc_id").select("h", "doc_id", "quality", "toxic", "text").orderBy("h", "doc_id", "text").limit(sample)
    truth: list[tuple[int, int]] = []

    def texts() -> Iterator[str | None]:
        size = 0
        for r in found.toLocalIterator():
            truth.append((r["quality"], r["toxic"]))
            yield r["text"]
            size += len(r["text"] or "")
            if size > SAMPLE_BYTES:
                return

    return train_chain(Sample(texts()), truth)


def predict(docs: DataFrame, chain: list[Link], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> in the order of the chain, toxic (p_toxic over the threshold).

    Null and empty texts have no terms and get the models' base rates. A category that could not be learned has probability
    0. Rows alike each get their result; other columns are not read. Texts of any length are read whole. An empty table
    gives an empty result.
    """
    names = [x for x, _ in CHAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sorted({t for link in chain for t in link.terms}))}
        weights = np.zeros((len(number), len(chain)))
        for k, link in enumerate(chain):
            weights[[number[t] for t in link.terms], k] = link.weights[: len(link.terms)]
        exact = number.keys()
        heads = {t[: BEGINS[0]] for t in exact if t.endswith(MORE)}
        for batch in batches:
            n = len(batch)
            logits = [np.full(n, link.weights[-1]) for link in chain]
            for r, text in enumerate(batch.column("text")):
                words = Counter(WORD.findall((text.as_py() or "").lower()))
                times = Counter({number[t]: words[t] for t in exact & words.keys()})
                here = heads.intersection({w[: BEGINS[0]] for w in words})
                if here:
                    for word, count in words.items():
                        if word[: BEGINS[0]] in here:
                            for t in begins(word):
                                if t in exact:
                                    times[number[t]] += count
                if times:
                    total = words.total()
                    values = np.array([damped(x, total) for x in times.values()])
                    for k, z in enumerate(values @ weights[list(times)]):
                        logits[k][r] += z
            found: dict[str, np.ndarray] = {}
            for link, z in zip(chain, logits, strict=True):
                for w, p in zip(link.weights[len(link.terms) : -1], list(found.values()), strict=True):
                    z = z + w * p
                found[link.name] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            probabilities = [found.get(k, np.zeros(n)) for k in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, probabilities), pa.array(probabilities[-1] > threshold)], names=["doc_id", *(f"p_{k}" for k in names), "toxic"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{k} double" for k in names) + ", toxic boolean")
