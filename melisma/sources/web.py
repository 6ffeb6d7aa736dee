"""Web search as a source that can be exchanged: hits as JSON text, an offline fixture in tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.operators.dedupe import add_new
from melisma.operators.html import with_lyrics
from melisma.operators.index import Index, extend
from melisma.operators.search import search
from melisma.sources.staging import stage

HITS = "response struct<hits: array<struct<result: struct<title: string, primary_artist: struct<name: string>, url: string, album: struct<name: string>>>>>"


def hits(replies: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, pos, titulo, artista, url, album) of replies (query_id, json): the first hits that have title, artist and url."""
    parsed = replies.select("query_id", F.from_json("json", HITS).alias("r"))
    rows = parsed.select("query_id", F.posexplode(F.slice("r.response.hits", 1, most)).alias("pos", "h"))
    rows = rows.select("query_id", "pos", F.col("h.result.title").alias("titulo"), F.col("h.result.primary_artist.name").alias("artista"), F.col("h.result.url").alias("url"), F.coalesce("h.result.album.name", F.lit("")).alias("album"))
    return rows.where("titulo <> '' AND artista <> '' AND url <> ''")


def found_songs(replies: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, pos, titulo, artista, url, album, generos, tags, letra) of the hits; letra from the stored pages (url, html)."""
    rows = hits(replies, most)
    stored = pages.select("url", "html").join(rows.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    rows = rows.join(stored, "url", "left").select("query_id", "pos", "titulo", "artista", "url", "album", "html")
    tags = F.array(F.lit("genius"), F.lit("web-scraping"))
    return with_lyrics(rows).select("*", F.array().cast("array<string>").alias("generos"), tags.alias("tags"))


def search_completed(index: Index, query: str, replies: DataFrame, pages: DataFrame, millis: Column, least: int = 5, **options) -> tuple[DataFrame, Index]:
    """(results, index): the local results of a query; if they are fewer than `least`, the new songs among the hits are added and the search is made again."""
    local = search(index, [query], **options)
    have = local.limit(least).count()
    if have >= least:
        return local, index
    new = stage(add_new(index.songs, found_songs(replies, pages, least - have), ["query_id", "pos"], millis), "web-songs")
    if new.isEmpty():
        return local, index
    index = extend(index, new)
    return search(index, [query], **options), index


def with_fallback(local: DataFrame, search, fetch, add, least: int = 5) -> DataFrame:
    """local, or if it has fewer than `least` rows the result of searching again once the fetched songs are added."""
    have = local.limit(least).count()
    if have >= least:
        return local
    new = fetch(least - have)
    return local if new is None or new.isEmpty() else search(add(new))
