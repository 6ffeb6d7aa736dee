"""From raw documents to token identifiers, in five stages that each cover all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, which may be any beside doc_id and text. Texts of any
length are worked on whole; an empty table of documents gives empty results, at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import byte_bpe, fm_index, pii, quality_rules, shingles, simhash
from melisma.llm.staging import NO_ID, fresh, keyed, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; null and empty texts are rejected, rows alike stay or go together."""
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.only(quality_rules.assess(docs, rules), F.col("kept")).select("row.*")


def prints(docs: DataFrame) -> DataFrame:
    """(th, group) of the texts of docs by op4: groups of chains of 4-word fingerprints within 4 bits of each other, found in vantage-point trees."""
    rows = simhash.fingerprints(keyed(docs, "doc_id", "text"), 4, "th", "text")  # the hash of a text takes the place of its id
    rows = stage(rows.select(F.col("doc_id").alias("th"), "fp").distinct(), "fingerprints")
    roots = simhash.rooted(stage(rows.select("fp").distinct(), "classes"), 4)
    return rows.join(roots, "fp").select("th", F.col("root").alias("group"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 or more one row stays: of least doc_id (null: last), then of least text hash.

    op4's groups are compared by their exact sets, together with what MinHash proposes beyond the 4 bits of a fingerprint.
    """
    found = shingles.near_duplicates(docs, proposed=prints(docs))
    first = found.groupBy("component").agg(F.min(F.struct((F.col("did") == NO_ID).alias("no_id"), "did", "th")).alias("at")).select("at.did", "at.th")
    did, th = fresh(docs, "did"), fresh(docs, "th")
    rows = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = rows.join(first.select(F.col("did").alias(did), F.col("th").alias(th)), [did, th], "left_semi")
    return kept.dropDuplicates([did, th]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark passages are cut out of the texts; null texts stay null, and all rows stay."""
    return fm_index.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind; null texts stay null, and all rows stay."""
    return pii.redact(pii.find(docs, pii.train(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, exact (the identifiers decode to the text); a null text has none, a row for each row."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode_decode(docs, path, pattern, keep_text=True)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
ORACLE_SQL = None  # learned rules, fingerprints and merges by rank can't be said in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
