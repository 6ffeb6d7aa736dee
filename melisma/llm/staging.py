"""Rows carried whole beside work columns, and matched again after a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.sources.staging import stage

__all__ = ["NO_ID", "fresh", "keyed", "same_row", "stage", "whole"]

#: Stands for a null doc_id where rows are matched; text hashes are matched as well, so it can't mix texts.
NO_ID = -(2**63) + 1


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct `row`, so that work columns beside it can't clash with any of them."""
    name = lambda c: "`" + c.replace("`", "``") + "`"
    return F.struct(*(F.col(name(c)).alias(c) for c in docs.columns)).alias("row")


def fresh(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty) and what matches a row again: did, th. Rows alike in both are alike in results."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th")
    )


def same_row(left: str = "l", right: str = "r") -> Column:
    return (F.col(f"{left}.did") == F.col(f"{right}.did")) & (F.col(f"{left}.th") == F.col(f"{right}.th"))
