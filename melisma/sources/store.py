"""The index at rest: a Parquet table for each part."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.operators.index import Index
from melisma.operators.semantic import Model

PARTS = ("songs", "docs", "postings", "search")


def save(index: Index, folder: str) -> Index:
    """Write all parts and read them again, which cuts lineage; postings are sorted by term, so a term's files can be skipped."""
    for name in PARTS:
        table = getattr(index, name)
        table = table.sortWithinPartitions("term") if "term" in table.columns else table
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return load(index.songs.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Index | None:
    """The saved index; None if there is none."""
    try:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in PARTS))
    except AnalysisException:
        return None


def export_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_crawl(records: DataFrame, folder: str, at: datetime | None = None) -> str:
    """All records so far in a folder named by the time of the dump; the path. Earlier dumps stay, and any of them can be read as crawl files."""
    path = f"{folder}/crawled_songs_{at or datetime.now():%Y%m%d_%H%M%S}.json"
    export_json(records, path)
    return path


def response(rows: DataFrame) -> DataFrame:
    """(query_id, json): the reply to each query, a list of its rows from the best on; nulls are kept. A list is bounded by the results that reach the least score."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", F.struct(*(c for c in rows.columns if c != "query_id")).alias("r"))))
    return rows.groupBy("query_id").agg(F.to_json(F.transform(listed, lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def save_model(model: Model, vectors: DataFrame, folder: str) -> None:
    """The semantic model and the vectors (doc_id, vec) of an index's documents."""
    spark = vectors.sparkSession
    rows = [(g, w, None if model.directions is None else model.directions[i].tolist()) for i, (g, w) in enumerate(model.idf.items())]
    spark.createDataFrame(rows, "ngram string, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")


def load_model(spark: SparkSession, folder: str) -> tuple[Model, DataFrame] | None:
    """What save_model wrote; None if there is none, and it has to be fitted again."""
    try:
        rows, vectors = spark.read.parquet(f"{folder}/model").orderBy("ngram").collect(), spark.read.parquet(f"{folder}/vectors")
    except AnalysisException:
        return None
    whole = bool(rows) and rows[0]["direction"] is not None
    return Model({r["ngram"]: r["idf"] for r in rows}, np.array([r["direction"] for r in rows]) if whole else None), vectors


def load_or_build(spark: SparkSession, folder: str, build) -> Index:
    found = load(spark, folder)
    return found if found is not None else save(build(), folder)
