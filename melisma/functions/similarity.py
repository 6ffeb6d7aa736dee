"""Gestalt similarity of two short texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}

    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def most_similar(query: Column, other: Column) -> Column:
    """What the similarity can be at most: twice the shorter length over both lengths; 0 for blanks."""
    a, b = F.length(F.lower(query)), F.length(F.lower(other))
    return F.coalesce(F.when(a + b > 0, 2.0 * F.least(a, b) / (a + b)), F.lit(0.0))


def similarity(query: Column, other: Column, floor: float = 0.0) -> Column:
    """Matching-block ratio, cases folded, the query first (the ratio is not symmetric); 0 for blanks.

    Pairs at or under `floor` by most_similar are passed as nulls and cost nothing.
    """
    return F.coalesce(_ratio(F.when(most_similar(query, other) > floor, F.lower(query)), F.lower(other)), F.lit(0.0))
