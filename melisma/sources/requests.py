"""Search requests as rows: bodies as they are posted, replies as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.functions.text import strip
from melisma.operators.index import Index
from melisma.operators.search import result_rows, search
from melisma.sources.store import response

BODY = "query string, usar_genius boolean, genius_token string"
# The reply without an index, and that to a blank query.
NO_INDEX, EMPTY = '{"error": "Indexador no inicializado"}', "[]"


def read(requests: DataFrame) -> DataFrame:
    """(query_id, raw, q, web) of requests (query_id, body): the query as posted and in lower case, and whether the web may be asked, which takes a token; raw is null for a body that is no object."""
    body = F.from_json("body", BODY)
    text = lambda name: strip(F.coalesce(body[name], F.lit("")))
    whole = F.col("body").rlike(r"(?s)^\s*\{.*\}\s*$") & F.coalesce(F.try_parse_json("body").isNotNull(), F.lit(False))
    rows = requests.select("query_id", F.when(whole, text("query")).alias("raw"), (F.coalesce(body["usar_genius"], F.lit(False)) & (text("genius_token") != "")).alias("web"))
    return rows.select("query_id", "raw", F.lower("raw").alias("q"), F.coalesce("web", F.lit(False)).alias("web"))


def replies(index: Index | None, requests: DataFrame, semantic: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, status, json): results from the best on; an empty list for a blank query or one without results; an error without an index, and for a body that can't be read."""
    asked = read(requests)
    if index is None:
        return asked.select("query_id", F.lit(500).alias("status"), F.lit(NO_INDEX).alias("json"))
    queries = asked.where("q <> ''").select("query_id", "q")
    found = response(result_rows(search(index, queries, semantic=semantic), index.songs, queries))
    status = F.when(F.col("raw").isNull(), 400).otherwise(200)
    return asked.join(found, "query_id", "left").select("query_id", status.alias("status"), F.when(F.col("raw").isNotNull(), F.coalesce("json", F.lit(EMPTY))).alias("json"))
