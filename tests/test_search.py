"""Search over tables of queries against a plain version, and top results from postings in blocks."""

import random
from collections import Counter
from difflib import SequenceMatcher
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.functions import text as T
from melisma.operators import blockmax, index, search, semantic
from melisma.sources import corpus

WORDS = "road sea miles night love rain fire moon star river song dance light dark heart home wind stone gold blue of the and".split()


@pytest.fixture(scope="module")
def songs(spark):
    rng = random.Random(7)
    some = lambda a, z: " ".join(rng.choices(WORDS, k=rng.randint(a, z)))
    artists = ["The Who", "Los Mares", "", "Moonriver", "rain"]
    rows = [(str(i), some(1, 4).title(), rng.choice(artists), ["rock"], some(3, 60)) for i in range(300)] + [("e1", "", "The Who", [], ""), ("e2", "  Road  of\tfire", "", [], "x")]
    return corpus.with_defaults(spark.createDataFrame(rows, "id string, titulo string, artista string, generos array<string>, letra string"))


ASKED = ["the who", "road", "moon river", "oad of fi", "riv", "love rain fire", "of", "sea of", "zzz qqq", "gold blue heart home", "dar"]


def plain_scores(spark, songs, asked, vectors=None):
    """{(query_id, doc_id): (score, parts)} of every pair, in plain Python but for the analysis of texts."""
    rows = songs.select("*", corpus.index_text().alias("i"), corpus.search_text().alias("s"))
    rows = rows.select("id", "titulo", "artista", T.terms(F.col("i"), T.language(F.col("i"))).alias("i"), T.terms(F.col("s"), T.language(F.col("s"))).alias("t"), T.word_count(F.col("s")).alias("n")).collect()
    terms = [r["t"] for r in spark.createDataFrame([(q,) for q in asked], "q string").select(T.terms(F.col("q"), T.language(F.col("q"))).alias("t")).collect()]
    mean, df = sum(r["n"] for r in rows) / len(rows), Counter(t for r in rows for t in set(r["i"]))
    out = {}
    for k, q in enumerate(asked):
        for r in rows:
            tf = Counter(r["t"])
            bm25 = sum(log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * r["n"] / mean)) for t in set(terms[k]) if tf[t])
            title, artist = r["titulo"].lower(), r["artista"].lower()
            ratio = lambda other: SequenceMatcher(None, q, other).ratio() if other.strip() else 0.0  # noqa: E731, B023
            sims = [x * 5 if (x := ratio(other)) > 0.3 else 0.0 for other in (title, artist)]
            common = [len(set(q.split()) & set(other.split())) for other in (title, artist)]
            meaning = max(0.0, float(vectors[0][k] @ vectors[1][r["id"]])) if vectors else 0.0
            flags = 8.0 * (q in title or q in artist) + 5.0 * (artist == q and artist.strip() != "") + 3.0 * title.startswith(q.split()[0])
            out[k, r["id"]] = sum(sims) + 2.0 * sum(common) + 1.5 * bm25 + 4.0 * meaning + flags
    return out


@pytest.mark.parametrize("least", [15.0, 12.0, 6.0])
def test_whole_score(spark, songs, least):
    """Similarity, words, BM25 and meaning together; the semantic part by a decomposition of its own."""
    model = semantic.fit(songs, components=6, features=60)
    texts = dict(songs.select("id", corpus.semantic_text().alias("t")).collect())
    grams = lambda t: (w := [x for x in __import__("re").findall(r"\w\w+", t.lower())]) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    counts = {i: Counter(grams(t)) for i, t in texts.items()}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    names = sorted(sorted(total, key=lambda g: (-total[g], g))[:60])
    assert sorted(model.idf) == names
    idf = np.array([log((1 + len(texts)) / (1 + df[g])) + 1 for g in names])
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
    weigh = lambda c: unit(np.array([c[g] for g in names]) * idf)
    x = np.array([weigh(c) for c in counts.values()])
    axes = np.linalg.svd(x, full_matrices=False)[2][:6].T
    docs = {i: unit(v @ axes) for i, v in zip(counts, x, strict=True)}
    asked = [unit(weigh(Counter(grams(q))) @ axes) for q in ASKED]
    want = {k: v for k, v in plain_scores(spark, songs, ASKED, (asked, docs)).items() if v >= least}
    built, table = index.build(songs), search.query_table(spark, ASKED)
    for queries in (ASKED, table):
        found = search.search(built, queries, least, lambda pairs: semantic.pair_scores(model, songs, table, pairs)).collect()
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in found}
        assert len(got) == len(found) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    whole = search.search(built, ASKED, least, semantic.scores(model, songs, table)).collect()
    assert {(r["query_id"], r["doc_id"]) for r in whole} == want.keys()


def test_pairs_with_any_feature(spark, songs):
    """No pair with a feature of title or artist is lost, and most others are never made."""
    table = search.query_table(spark, ASKED)
    pairs = {tuple(r) for r in search.sharing(songs, table).collect()}
    every = search.surface(songs, [(r["query_id"], r["q"]) for r in table.collect()]).collect()
    some = {(r["query_id"], r["doc_id"]) for r in every if r["title_words"] or r["artist_words"] or r["in_title"] or r["in_artist"] or r["is_artist"] or r["starts"]}
    assert some <= pairs and len(pairs) < 0.5 * len(every) and {k for k, _ in some} >= {3, 4, 10}  # parts of words too
    assert not {k for k, _ in pairs} & {8}


def test_many_queries_are_a_table(spark, songs):
    """More queries than a plan could hold as literals."""
    table = spark.range(3000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 100 == 0, "the who").otherwise(F.concat(F.lit("nothing"), "id")).alias("q"))
    found = search.search(index.build(songs), table, 15.0, with_similarity=False).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in found} == set(range(0, 3000, 100)) and len({r["count"] for r in found}) == 1


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_blockmax(spark, songs, most):
    found, table = index.build(songs), search.query_table(spark, ASKED)
    scores = search.bm25(found, table).select("query_id", "doc_id", F.round("bm25", 6).alias("score"))
    top = blockmax.top(blockmax.blocks(found, 8), table, most)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(top.rows) == rows(search.ranked(scores, most))
    opened, every = top.opened.count(), top.bounds.count()
    assert opened == top.opened.select("query_id", "block").distinct().count()
    assert opened < 0.6 * every if most <= 3 else opened <= every


def test_blocks_bound_their_documents(spark, songs):
    found = blockmax.blocks(index.build(songs), 8)
    rows = found.postings.collect()
    assert all(abs(r["most"] - max(e["part"] for e in r["entries"])) < 1e-12 and len(r["entries"]) <= 8 for r in rows)
    assert sum(len(r["entries"]) for r in rows) == found.index.search.count()
    empty = index.build(songs.limit(0))
    assert blockmax.top(blockmax.blocks(empty), search.query_table(spark, ["road"]), 5).rows.count() == 0


def test_best_in_blocks_hands_on_few_rows(spark):
    """Copies tie for every query: a task hands on as many of them as results are asked for, and scores few blocks."""
    import pyarrow as pa

    texts = [[("a", 2), ("b", 1)]] * 3000 + [[("a", 1 + i % 5), ("c", 1)] for i in range(3000)]
    rows = [{"doc_id": f"d{i % 6000:04}", "doc_len": 3 if i < 3000 else 20 + i % 300, "terms": [{"term": t, "tf": n} for t, n in x]} for i, x in enumerate(texts)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("doc_len", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))]))
    asked = blockmax.Asked([{"query_id": q, "terms": [{"term": "a", "idf": 0.5 + q}, {"term": "b", "idf": 1.0}]} for q in range(20)], 10, 50.0)
    got = [r for b in asked([batch.slice(0, 2500), batch.slice(2500)]) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == [(q, f"d{i:04}") for q in range(20) for i in range(10)]
    assert asked.opened < 0.6 * 20 * 95


def test_pairs_that_leave_the_task(spark, songs, monkeypatch):
    """Without similarity and meaning, only pairs of the least score; the same over several passes."""
    built, table = index.build(songs), search.query_table(spark, ASKED)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id").collect()))
    found = rows(search.search(built, table, 8.0, with_similarity=False))
    assert found and rows(search.candidates(built, table, 8.0, False)) == found
    features = {(r["query_id"], r["doc_id"]): r for r in search.surface(songs, [(r["query_id"], r["q"]) for r in table.collect()]).collect()}
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    every = search.candidates(index.Index(built.songs, built.docs, built.postings, built.search), table, 0.0, False).collect()  # lists made from the postings
    assert len(every) == len(features)
    names = ("title_words", "artist_words", "in_title", "in_artist", "is_artist", "starts")
    assert all(tuple(r[k] for k in names) == tuple(features[r["query_id"], r["doc_id"]][k] for k in names) for r in every)
