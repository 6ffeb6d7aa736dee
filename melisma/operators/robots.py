"""Robots rules as a table: parsed once for each host, and joined with urls on the prefixes of their paths."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The agent that rules are read for, and the rule that any path matches.
AGENT, ANY = "*", "*"


def netloc(url: Column) -> Column:
    """Host with user and port, lower case; blank without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


@pandas_udf(StringType())
def checked(url: pd.Series) -> pd.Series:
    """What rules are compared with: path, parameters, query and fragment, quoted alike; / if there is nothing."""

    def one(x: str | None) -> str:
        try:
            part = urlparse(unquote(x or ""))
        except ValueError:
            return "/"
        return quote(urlunparse(("", "", part.path, part.params, part.query, part.fragment))) or "/"

    return url.map(one)


def rules(texts: DataFrame) -> DataFrame:
    """(host, place, allow, prefix) of robots texts (host, rules): the lines that hold for any agent, in order. A prefix that is blank fits every path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column("host").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                parser = RobotFileParser()
                parser.parse((text or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(AGENT)), parser.default_entry)
                out += [(name, i, line.allowance, "" if line.path == ANY else line.path) for i, line in enumerate(entry.rulelines if entry else ())]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["host", "place", "allow", "prefix"])

    return texts.select("host", "rules").where("host IS NOT NULL").mapInArrow(run, "host string, place int, allow boolean, prefix string")


def forbidden(urls: DataFrame, found: DataFrame) -> DataFrame:
    """(url): the distinct urls of a table that rules (as of `rules`) forbid.

    The first line of a host that is a prefix of the path decides; without one, or without rules, a url is allowed. A
    path is cut at the lengths that its host's prefixes have, and the cuts are joined by equality: lines are never compared with
    all urls of their host.
    """
    lengths = found.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    rows = urls.select("url").distinct().withColumn("host", netloc(F.col("url"))).join(lengths, "host")
    path = rows.withColumn("path", checked("url")).select("url", "host", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    cuts = path.select("url", "host", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix"))
    decided = cuts.join(found, ["host", "prefix"]).groupBy("url").agg(F.min(F.struct("place", "allow"))["allow"].alias("allow"))
    return decided.where("NOT allow").select("url")
