"""The whole score in the task of the document: similarity and meaning too, so that no pair under the least score leaves it."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from melisma.operators import index, matching, search, semantic
from melisma.sources import corpus

WORDS = "road sea miles night love rain fire moon star river song dance light dark heart of the".split()


def test_pairs_of_texts():
    """Bounds hold, ratios are difflib's; copies, blanks, long texts, and letters that no query has."""
    rng = random.Random(3)
    made = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = [made(rng.randint(1, 12)) for _ in range(40)] + ["", "日本語", made(60), made(70), "é😀" * 9]
    texts += texts[:6]
    queries = [made(rng.randint(1, 9)) for _ in range(20)] + [texts[0], made(65), "é😀", "".join(map(chr, range(200, 300)))]
    q, d = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(len(texts)), indexing="ij"))
    want = np.array([SequenceMatcher(None, queries[a], texts[b]).ratio() if texts[b] else 0.0 for a, b in zip(q, d, strict=True)])
    want[want <= 0.3] = 0.0
    pairs = matching.Pairs(matching.Similar(queries, 0.3), texts, q, d)
    assert (pairs.most >= want).all() and (pairs.most == 0).sum() > 50
    some = np.arange(len(q)) % 3 > 0
    assert (pairs.ratios(np.ones(len(q), dtype=bool)) == want).all() and (pairs.ratios(some)[some] == want[some]).all()
    none = matching.Pairs(matching.Similar(queries, 0.3), texts, q[:0], d[:0])
    assert len(none.most) == len(none.ratios(none.most > 0)) == 0


def test_only_results_leave_the_task(spark):
    rng = random.Random(5)
    made = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [(str(i), made(rng.randint(1, 5)), rng.choice(["The Who", "rain", ""]), made(30)) for i in range(80)]
    songs = corpus.with_defaults(spark.createDataFrame(rows, "id string, titulo string, artista string, letra string"))
    asked = [(k, q) for k, q in enumerate([r[1] for r in rows[::8]] + [rows[0][1], "the who", "zzz"])]  # a query twice
    table = spark.createDataFrame(asked, "query_id long, q string")
    built, meaning = index.build(songs), semantic.meaning(songs, table)
    pairs = lambda df: sorted(map(tuple, df.select("query_id", "doc_id").collect()))
    scores = lambda found: {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in found.collect()}
    joined = meaning.docs.crossJoin(meaning.queries.withColumnRenamed("vec", "q")).select("query_id", "doc_id", semantic.dot(F.col("vec"), F.col("q")).alias("semantic"))
    found = search.search(built, table, 12.0, meaning)
    got = scores(found)
    assert got == scores(search.search(built, table, 12.0, joined)) and 50 < len(got) < 0.7 * 80 * len(asked) and got[0, "0"] == got[10, "0"]
    assert pairs(search.candidates(built, table, 12.0, True, meaning)) == pairs(found)
    absent = semantic.Meaning(meaning.docs.where("doc_id <> '0'"), meaning.queries)  # a document without a vector has no semantic part
    part = joined.where("query_id = 0 AND doc_id = '0'").first()["semantic"]
    whole, without = (scores(search.search(built, table, 12.0, m))[0, "0"] for m in (meaning, absent))
    assert part > 0 and abs(whole - without - 4 * part) < 1e-6
