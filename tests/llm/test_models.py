"""Predictions of the learned operators against plain versions: language identification whole, the classifier chain's probabilities."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from math import exp, log, log1p

import pytest

from melisma.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def letters(text):
    """Runs of Unicode letters of the text in lower case."""
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L" or re.fullmatch(r"[^\W\d_]", c) and unicodedata.category(c) not in ("No", "Nl"):
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def test_op10(spark):
    """Word-first backoff written plainly: frequencies of words, else the mean over the longest known n-grams, place by place."""
    rows = queries.stored(spark, FOLDER).select("doc_id", "text", "lang").collect()
    held_out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    grams = lambda w, n: [x for x in ([f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) if len(x) == n]
    times = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if not held_out[r["doc_id"]] and r["text"] is not None and r["lang"] is not None:
            for w in letters(r["text"]):
                times[0, w][r["lang"]] += 1
                for n in (1, 2, 3, 4):
                    for g in grams(w, n):
                        times[n, g][r["lang"]] += 1
    langs = sorted({x for own in times.values() for x in own})
    totals, kinds = Counter(), Counter()
    for (n, _), own in times.items():
        kinds[n] += 1
        for lang, c in own.items():
            totals[lang, n] += c
    known = {k: [log((own.get(x, 0) + 0.5) / (totals[x, k[0]] + 0.5 * (kinds[k[0]] + 1))) for x in langs] for k, own in times.items()}

    def pieces(gram, n):
        if (n, gram) in known:
            return [known[n, gram]]
        return [p for i in range(len(gram) - n + 2) if gram[i : i + n - 1].strip() for p in pieces(gram[i : i + n - 1], n - 1)] if n > 1 else []

    def scores(word):
        if (0, word) in known:
            return known[0, word]
        found = [p for g in grams(word, 4) or [f" {word} "] for p in pieces(g, 4)]
        return [sum(p[k] for p in found) / max(len(found), 1) for k in range(len(langs))]

    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, FOLDER).collect()}
    unseen = 0
    for r in rows:
        words = Counter(letters(r["text"]))
        found = got[r["doc_id"]]
        assert found["held_out"] == held_out[r["doc_id"]]
        if not words:
            assert (found["lang_pred"], found["score"]) == ("und", 0.0)
            continue
        unseen += sum((0, w) not in known for w in words)
        total = [sum(c * s[k] for s, c in ((scores(w), c) for w, c in words.items())) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        share = 1 / sum(exp((t - total[best]) / words.total() ** 0.5) for t in total)
        assert found["lang_pred"] == langs[best] and found["score"] == pytest.approx(share, abs=1e-9)
    assert unseen > 500


def test_op8(spark):
    """Each category by a logistic formula over the terms of the text and the probabilities before it."""
    docs, labels = queries.stored(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet")
    chain = toxicity.train(docs, labels)
    assert [link.name for link in chain] == [name for name, _ in toxicity.CHAIN] and any(link.terms for link in chain)
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, FOLDER).collect()}
    for doc in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", (doc["text"] or "").lower())
        times = Counter(words)
        times.update(w[:n] + "~" for w in words for n in (4, 5, 6, 7) if len(w) > n)
        before = []
        for link in chain:
            weights = dict(zip(link.terms, link.weights, strict=False))
            z = link.weights[-1] + sum(w * log1p(min(200 * times[t] / len(words), 8)) for t, w in weights.items() if times[t])
            z += sum(w * p for w, p in zip(link.weights[len(link.terms) : -1], before, strict=True))
            before.append(1 / (1 + exp(-max(-30, min(30, z)))))
        row = got[doc["doc_id"]]
        assert [row[f"p_{name}"] for name, _ in toxicity.CHAIN] == pytest.approx(before, abs=1e-9) and row["toxic"] == (before[-1] > 0.5)


def test_op8_learns_without_its_fold(spark):
    """A later model is trained with probabilities of the earlier ones that come from models which had not seen the row."""
    texts = [" ".join((["bad"] if i % 2 else ["good"]) * 3 + ["word"] * 5) for i in range(40)]
    sample, marks = toxicity.Sample(texts), [(1 - i % 2, int(i % 4 == 1)) for i in range(40)]
    chain = toxicity.train_chain(sample, marks)
    assert [len(link.weights) - len(link.terms) - 1 for link in chain] == [0, 1, 2]
