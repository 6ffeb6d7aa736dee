"""The opN_ queries over the tables of a scale folder, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.sources.staging import spread

from . import byte_bpe, embedding_dedup, fm_index, language_id, pii, quality_rules, secret_scan, simhash, spelling, substring_dedup, suffix_dedup, toxicity, whitening
from .spans import count, joined


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(stored(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = secret_scan.scan(documents(spark, sf_dir)), ("assign", "access", "hex")
    spans = F.col("spans")
    return found.select("doc_id", *(count(spans, k).alias(f"n_{k}") for k in base), F.sha2(joined(spans, base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(spark, sf_dir)
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.assess(docs, rules).select("row.doc_id", *columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = stored(spark, sf_dir), F.col("spans")
    found = pii.find(docs, pii.train(docs))
    # one projection of the spans first, so that each column below reads them instead of finding them again
    return found.select("row.doc_id", "spans").select(
        "doc_id", *(count(spans, k).alias(f"n_{k}") for k in pii.BASE), F.sha2(joined(spans, pii.BASE), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.predict(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_byte_bpe, op4_simhash, op5_quality_rules, op6_pii, op7_fm_index, op8_toxicity, op9_suffix_dedup, op10_language_id, op11_whitening, op12_spelling_variants, op13_embedding_dedup)}


def repeated_runs(name: str, size: int) -> str:
    """Common table expressions up to {name}_runs: the maximal runs (r, a, z) of bytes in strings of this size that start elsewhere too; d has each text in hexadecimal."""
    return f"""{name}_hashed AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, {2 * size})) AS m FROM (SELECT r, h, unnest(range(0, n - {size - 1})) AS i FROM d WHERE n >= {size})
), {name}_again AS (
  SELECT r, i FROM {name}_hashed WHERE m IN (SELECT m FROM {name}_hashed GROUP BY m HAVING count(*) > 1)
), {name}_marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {size} THEN 0 ELSE 1 END AS fresh FROM {name}_again
), {name}_runs AS (
  SELECT r, min(i) AS a, max(i) + {size} AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM {name}_marked) GROUP BY r, k
)"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d
), hashed AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts
), again AS (
  SELECT r, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.r, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r""",
    "op9_suffix_dedup": f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), {repeated_runs("long", 400)}, {repeated_runs("short", 200)}, removed AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed FROM long_runs GROUP BY r
), passages AS (
  SELECT r, sum(z - a) AS n_passage FROM short_runs GROUP BY r
), edges AS (
  SELECT r, a, z FROM long_runs UNION ALL SELECT r, n, n FROM d
), kept AS (
  SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a, z) AS kept
  FROM (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS b FROM edges) JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256, CAST(coalesce(n_passage, 0) AS BIGINT) AS n_passage
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r) LEFT JOIN passages USING (r)""",
    "op7_fm_index": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), starts AS (
  SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT r, i, s.n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM starts) s JOIN windows ON s.n = windows.n AND s.phrase = windows.phrase
), covered AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.r = covered.r LEFT JOIN items ON d.r = items.r""",
    "op12_spelling_variants": r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2
), bytes AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]))) AS h FROM bytes, steps
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, n_near, other, other_n FROM (
    SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near) WHERE k = 1
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form, CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON chain.next = forms.word
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain ON forms.word = chain.word AND chain.next IS NULL""",
    "op13_embedding_dedup": """
WITH RECURSIVE rows AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings
), usable AS (
  SELECT r, label, e FROM rows WHERE label IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.r, b.r AS other FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (
  SELECT r, r AS at FROM rows UNION SELECT reached.r, links.other FROM reached JOIN links ON reached.at = links.r
), least AS (
  SELECT reached.r, min(rows.vec_id) AS component_id FROM reached JOIN rows ON reached.at = rows.r GROUP BY reached.r
), counts AS (
  SELECT r, count(*) AS n_links FROM links GROUP BY r
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN least USING (r) LEFT JOIN counts USING (r)""",
}
