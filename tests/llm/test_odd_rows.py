"""Every operator and stage on rows of every kind: nulls, empty and very long texts, ties, repeats, clashing columns, no rows."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from melisma.llm import byte_bpe, fm_index, language_id, pii, quality_rules, secret_scan, shingles, simhash, substring_dedup, suffix_dedup, toxicity
from melisma.llm.staging import NO_ID

CLASHING = ("_text", "_row", "_spans", "row", "words", "n", "place", "digit_share", "n_words", "kept", "spans", "hits", "did", "th", "runs", "fp", "start", "anchor", "seg", "toxic", "quality", "score", "ids", "h", "bad")
LONG = " ".join(f"mail{i}@x.org 10.0.0.{i} token=abcdef{i} " + " ".join(f"long{i}x{j}" for j in range(300)) for i in range(350))  # over 1 MB
TEXTS = [None, "", " \n\t ", "x", "½ ²", LONG, "the quick brown fox " * 30, "the quick brown fox " * 30, "Ünï 日本語 😀 " * 100, "a\x00b " * 60]


@pytest.fixture(scope="module")
def table(spark):
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    own = [f"own {c}" for c in CLASHING]
    rows = [(i, t, "en" if i % 2 else "de", *own) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "de", *own)] * 2 + [(None, TEXTS[6], None, *([None] * len(own))), (None, None, None, *own)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(None, "the quick brown fox the quick brown fox the quick"), ("b", None), ("b", ""), ("c", "mail7"), ("c", "mail7")], "item_id string, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(8)] + [(3, None, 1), (None, 0, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")


def operators(bench, labels):
    codec = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return {
        "substring": (substring_dedup.remove_repeated_words, "doc_id"),
        "secrets": (secret_scan.scan, "doc_id"),
        "coding": (lambda d: byte_bpe.encode_decode(d, *codec, keep_text=True), "doc_id"),
        "simhash": (simhash.near_duplicates, "doc_id"),
        "shingles": (shingles.near_duplicates, "did"),
        "quality": (lambda d: quality_rules.assess(d, quality_rules.train(d, labels)), "row.doc_id"),
        "pii": (lambda d: pii.find(d, pii.train(d)), "row.doc_id"),
        "redact": (lambda d: pii.redact(pii.find(d, pii.train(d))), "doc_id"),
        "contamination": (lambda d: fm_index.contamination(d, bench), "doc_id"),
        "decontaminated": (lambda d: fm_index.decontaminated(d, bench), "doc_id"),
        "toxicity": (lambda d: toxicity.predict(d, toxicity.train(d, labels)), "doc_id"),
        "suffixes": (suffix_dedup.remove_repeated_bytes, "doc_id"),
        "language": (lambda d: language_id.identify(d, language_id.train(d)), "doc_id"),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, table, bench, labels, name):
    op, key = operators(bench, labels)[name]
    found = op(table).cache()
    ids = Counter(None if r[0] == NO_ID else r[0] for r in found.select(key).collect())
    assert ids == Counter(r["doc_id"] for r in table.select("doc_id").collect())
    if name in ("quality", "pii"):
        own = found.select("row.*")
        assert own.columns == table.columns and own.exceptAll(table).isEmpty() and table.exceptAll(own).isEmpty()
    elif name in ("redact", "decontaminated"):
        assert found.columns == table.columns
        rest = [c for c in table.columns if c != "text"]
        assert found.select(rest).exceptAll(table.select(rest)).isEmpty()
    same = found.where(F.col(key) == 6).select([F.col(c).cast("string") for c in found.columns if c != "place"]).distinct().count()
    assert same == 1  # rows alike are treated alike
    assert op(table.limit(0)).count() == 0
    found.unpersist()


def test_values(table, bench, labels):
    quality = {r["doc_id"]: r for r in quality_rules.assess(table, []).select("row.doc_id", "n_words", "base_failed", "kept").collect()}
    assert quality[0]["n_words"] == 0 and quality[1]["base_failed"] and quality[5]["n_words"] == 303 * 350 and quality[5]["kept"]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(table, pii.train(table)).select("row.doc_id", "spans").where("doc_id IN (0, 1, 5)").collect()}
    kinds = Counter(s["kind"] for s in spans[5])
    assert spans[0] == spans[1] == [] and kinds["email"] == 350 and kinds["ip"] == 256 and len(LONG) > 1e6
    secrets = {r["doc_id"]: r["spans"] for r in secret_scan.scan(table).collect()}
    assert secrets[0] == secrets[1] == [] and len(secrets[5]) == 350
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(table, language_id.train(table)).collect()}
    assert lang[0] == lang[1] == lang[4] == ("und", 0.0) and lang[5][0] in ("en", "de") and lang[8][0] in ("en", "de")


def test_unseen_language(spark):
    rows = spark.createDataFrame([(1, "abc", "en"), (2, "ghi", "fr")], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(1, "abc"), (2, "ghi"), (3, "zzz"), (4, "½ ² Ⅳ 12"), (5, "x½")], "doc_id bigint, text string")
    got = [r["lang_pred"] for r in language_id.identify(asked, language_id.train(rows)).orderBy("doc_id").collect()]
    assert got[:2] == ["en", "fr"] and got[2] in ("en", "fr") and got[3] == "und" and got[4] in ("en", "fr")


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, table, bench, labels, tmp_path, stage):
    import corpus_pipeline

    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, step = corpus_pipeline.STAGES[stage]
    step(spark, table, str(tmp_path)).write.parquet(str(tmp_path / "out"))  # as a stage's result is always read
    found = spark.read.parquet(str(tmp_path / "out"))
    if name != "tokens":
        assert found.columns == table.columns and found.select("doc_id", "_text").exceptAll(table.select("doc_id", "_text")).isEmpty()
    assert step(spark, table.limit(0), str(tmp_path)).count() == 0


def test_secrets_in_linear_time():
    import time

    def seconds(n):
        text = " ".join(f"token=abcdefgh{i} aB3dE5fG7hJ9kL1mN3pQ5rS{i}x" for i in range(n))
        began = time.process_time()
        assert len(secret_scan.secrets(text)) >= 2 * n
        return time.process_time() - began

    seconds(500)
    assert seconds(8_000) < 10 * seconds(2_000)


def test_secret_classes():
    cases = {
        "q8z1m4x0v7c2b5n9w3e6r8t1y4u7": ["entropy"], "Q8Z1M4X0V7C2B5N9W3E6R8T1Y4U7": ["entropy"], "XkqWzPvLmRtYbNcJhGfDsAeUiOoT": ["entropy"], "lower/case/path/of/some/words": [], "UPPER_CASE_NAME_OF_WORDS": [],
        "internationalizationsupport": [], "zzzzzzzzzzzzzzzzzzzzzzzzzzzz": [], "12345678901234567890123": [], "token=abcdef.q8z1m4x0v7c2b5n9w3e6r8t1": ["assign"], "123E4567-E89B-12D3-A456-426614174000": [],
    }
    for text, kinds in cases.items():
        assert [secret_scan.KINDS[k] for _, k, _ in secret_scan.secrets(text)] == kinds, text
