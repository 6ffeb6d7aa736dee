"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, but only if driver and executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not OWN_FOLDER:
        OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="melisma-"))
    return OWN_FOLDER[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it is computed once, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/melisma/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """df staged, and aggregates of its rows that come with the write instead of a second pass."""
    seen = Observation(name)
    found = stage(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return found, seen.get


def spread(rows: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if its files have fewer parts than there are cores: else one task would do all work on a small file."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
