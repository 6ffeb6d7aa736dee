"""Duplicate tests, first-wins merging, and identifiers of new songs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from melisma.functions.text import strip
from melisma.sources.corpus import with_defaults
from melisma.sources.staging import counted, stage


def key(column: str) -> Column:
    return strip(F.lower(F.coalesce(F.col(column), F.lit(""))))


def song_id(title: Column, artist: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 of both, in lower case."""
    return F.substring(F.md5(F.concat(strip(F.lower(title)), F.lit("|"), strip(F.lower(artist)))), 1, 16)


def slug_id(title: Column, artist: Column, millis: Column) -> Column:
    part = lambda c, n: F.substring(F.regexp_replace(F.lower(c), " ", "_"), 1, n)
    return F.concat_ws("_", part(title, 20), part(artist, 15), (millis % 100000).cast("string"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k_titulo", key("titulo")).withColumn("k_artista", key("artista"))


def new_to(rows: DataFrame, known: DataFrame, by: str = "id") -> DataFrame:
    """Rows that share neither (title, artist) nor `by` with a known song: one equi join for each test. ids are compared as they are, urls stripped and in lower case."""
    same = (lambda c: strip(F.lower(c))) if by == "url" else (lambda c: c)
    known = with_keys(known)
    out = rows.join(known.select("k_titulo", "k_artista").distinct(), ["k_titulo", "k_artista"], "left_anti")
    ids = known.select(same(F.col(by)).alias("_by")).where("_by IS NOT NULL AND _by <> ''").distinct()
    return out.join(ids, same(out[by]) == F.col("_by"), "left_anti")


def merge(songs: DataFrame, crawled: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(songs with the new ones, counts by status: agregada, duplicada, omitida). crawled has no ids of its own.

    Records without title or artist are left out; an id follows from title and artist, so one window by key
    finds the first of each in the given order. The new songs are staged, and all counts come with that write: the records are read once.
    """
    blank = (F.coalesce("titulo", F.lit("")) == "") | (F.coalesce("artista", F.lit("")) == "")
    records = Observation("records")
    rows = with_keys(crawled.observe(records, F.count("*").alias("n"), F.count_if(blank).alias("skipped")))
    rows = rows.withColumn("id", song_id(F.col("titulo"), F.col("artista")))
    usable = rows.where(~blank & (F.col("k_titulo") != "") & (F.col("k_artista") != ""))
    added, seen = counted(new_to(first_wins(usable, ["k_titulo", "k_artista"], order), songs), "added", added=F.count("*"))
    try:
        total = records.get
    except Py4JJavaError:  # a plan that knows its input to be empty leaves it out, and what was to be observed of it
        total = {"n": 0, "skipped": 0}
    n, skipped = total["n"], total["skipped"]
    counts = [("agregada", seen["added"]), ("duplicada", n - skipped - seen["added"]), ("omitida", skipped)]
    return songs.unionByName(with_defaults(added)), songs.sparkSession.createDataFrame(counts, "status string, n long")


def greedy_first_wins(rows: DataFrame, by: list[list[str]], order: list[str], rounds: int = 100) -> DataFrame:
    """First wins on any of several keys, where a dropped row blocks none. A key with a blank part is no key; order tells all rows apart.

    In a round the rows that are first by each of their keys among those left are kept, and what shares a key with
    them goes. No group is gathered: a key's least row is found with map-side combining.
    """
    keys = [F.when(sum((F.col(c).isNull() | (F.col(c) == "")).cast("int") for c in columns) == 0, F.struct(*columns)) for columns in by]
    names = [f"_key{i}" for i in range(len(by))]
    left = stage(rows.select("*", F.struct(*order).alias("_order"), *(k.alias(n) for k, n in zip(keys, names, strict=True))), "undecided")
    kept = rows.limit(0)
    for _ in range(rounds):
        if left.isEmpty():
            return kept
        first = left
        for n in names:
            least = left.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_order").alias("_least"))
            first = first.join(least, n, "left").where(F.col("_least").isNull() | (F.col("_least") == F.col("_order"))).drop("_least")
        first = stage(first.select(left.columns), "first")
        kept = kept.unionByName(first.select(rows.columns))
        left = left.join(first.select("_order"), "_order", "left_anti")
        for n in names:
            left = left.join(first.where(F.col(n).isNotNull()).select(n), n, "left_anti")
        left = stage(left.select(first.columns), "undecided")
    raise RuntimeError(f"undecided rows after {rounds} rounds")


def add_new(songs: DataFrame, found: DataFrame, order: list[str], millis: Column) -> DataFrame:
    """The song rows to add of found records (titulo, artista, url, ...): those that no known song and no earlier one of them has by title and artist, or by url. Ids are slugs with the time."""
    rows = with_keys(found).withColumn("k_url", key("url"))
    named = (F.col("k_titulo") != "") & (F.col("k_artista") != "")
    known = with_keys(songs.select("titulo", "artista", "url")).withColumn("k_url", key("url"))
    pairs = known.where(named).select("k_titulo", "k_artista").distinct()
    rows = rows.join(pairs, ["k_titulo", "k_artista"], "left_anti").join(known.where("k_url <> ''").select("k_url").distinct(), "k_url", "left_anti")
    rows = greedy_first_wins(rows.select(*found.columns, "k_titulo", "k_artista", "k_url"), [["k_titulo", "k_artista"], ["k_url"]], order)
    return with_defaults(rows.withColumn("id", slug_id(F.col("titulo"), F.col("artista"), millis)))
