"""Registered queries against their SQL, on rows that the small tables do not have."""

import duckdb

from melisma.operators import html
from melisma.plans import catalog, oracle


def by_sql(folder, name):
    with duckdb.connect() as db:
        for path in folder.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
        return db.execute(oracle.ORACLE[name]).fetchall()


def test_scraped_titles_with_other_references(spark, tmp_path):
    long = "<h1>" + "x" * 100 + "</h1>"
    heads = [f"<title>a &quot;b&quot; c</title>{long}", f"<title>cut &amp;&amp</title>{long}", "<title>x</title><h1>h &amp;lt; &lt;i&gt; &copy &#33; & y</h1>", "<title>t</title><h1></h1>"]
    rows = [(i, f"https://a.org/{i}", f"<html><head>{h}</html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = dict(map(tuple, catalog.QUERIES["scraped_titles"](spark, str(tmp_path)).collect()))
    want = dict(by_sql(tmp_path, "scraped_titles"))
    assert got == want and want[0] == 'a &quot;b&quot; c' and want[2] == 'h &lt; <i> &copy &#33; & y'
    assert html.extract(rows[0][2], "")["titulo"] == 'a "b" c'  # the operator itself resolves all references


def test_pipeline_proposes_by_fingerprints(spark, monkeypatch):
    """Copies that only op4's trees propose are compared: MinHash gives no candidates here."""
    import corpus_pipeline
    import pyarrow as pa
    from melisma.llm import shingles, simhash

    sketch = shingles.sketch

    def without_bands(width):
        def run(batches, inner=sketch(width)):
            for b in inner(batches):
                none = pa.array([[]] * b.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], none], names=b.schema.names)

        return run

    monkeypatch.setattr(shingles, "sketch", without_bands)
    texts = [" ".join([f"t{n}w{i}" for i in range(400)] + end) for n in range(10) for end in ([], ["one"])]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0].upper(), None, ""])), "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=4, radius=4).collect()}
    assert sum(k != v for k, v in near.items()) >= 10
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(near.values())


def test_features_by_codes(spark):
    """Numbers and products of features equal those of their texts."""
    import numpy as np
    from melisma.operators import semantic
    from pyspark.sql import functions as F

    texts = ["one two one two Ünder_score", None, "x two, one! two one", "", "none of these", "one", "ünder_score one two three"] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    features = ["one", "two", "one two", "two one", "ünder_score", "ünder_score one", "three four"]
    found = semantic.counted(rows, features).cache()
    plain = [[features.index(g) for g in r["g"] if g in features] for r in rows.select(semantic.ngrams(F.col("text")).alias("g")).collect()]
    want = [sorted((i, g.count(i)) for i in set(g)) for g in plain]
    assert sorted(list(zip(r["at"], r["n"])) for r in found.collect()) == sorted(want)
    idf = np.arange(1.0, 8.0)
    x = np.array([[dict(w).get(i, 0) for i in range(7)] for w in want]) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    block = np.random.default_rng(1).normal(size=(7, 3))
    assert np.allclose(semantic.gram_times(found, idf, block), x.T @ x @ block, atol=1e-12)
    assert semantic.counted(rows, []).count() == len(texts)


def test_best_by_task_equals_ranking_all_scores(spark, monkeypatch):
    """Also over several passes of queries, with ties, and without pairs of query and document in a shuffle."""
    from melisma.operators import blockmax, index, search
    from melisma.sources import corpus

    rows = [(i, " ".join("k" + "abcdefghijklmnopq"[(i * k) % 17] + "t" for k in range(1, 6 + i % 5)) + ". x", "src", "en") for i in range(300)]
    songs = corpus.from_documents(spark.createDataFrame([*rows, (300, rows[0][1], "src", "en")], "doc_id long, text string, source string, lang string")).repartition(3)
    found, asked = index.build(songs), search.query_table(spark, ["kbt kct kdt", "ket", "nothing here", "kqt kct", "kft kft kgt"])
    monkeypatch.setattr(blockmax, "PASS", 2)
    from pyspark.sql import functions as F

    for most in (7,):
        want = search.ranked(search.bm25(found, asked).select("query_id", "doc_id", F.round("bm25", 6).alias("score")), most)
        got = blockmax.best(found, asked, most)
        assert got.schema.names == want.schema.names and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 2
    assert blockmax.best(found, asked.limit(0), 3).count() == 0


def test_top_ngrams_counts_few_pairs(spark, monkeypatch):
    """Equal to counting all n-grams, with ties at the end, and pairs handed on in parts; pairs of rare words are not counted."""
    import random
    from collections import Counter

    from melisma.operators import semantic

    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=40)) for _ in range(200)] + [None, "", "w0 w1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter()
    for t in texts:
        w = (t or "").split()
        counts.update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    monkeypatch.setattr(semantic, "MOST_PAIRS", 100)
    seen, pair_totals = [], semantic.pair_totals
    monkeypatch.setattr(semantic, "pair_totals", lambda rows, words: seen.append(len(words)) or pair_totals(rows, words))
    for k in (1, 7, 30):
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [tuple(r) for r in semantic.top_ngrams(rows, k).collect()] == want
    assert len(seen) == 3 and max(seen) < 40
    assert len(semantic.top_ngrams(rows, 10_000).collect()) == len(counts)
