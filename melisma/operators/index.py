"""The inverted index as tables: one pass of analysis, then aggregates with map-side combining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.functions.text import language, let, terms, word_count
from melisma.sources.corpus import index_text, search_text
from melisma.sources.staging import stage


@dataclass(frozen=True)
class Index:
    """songs; docs (doc_id, idioma, doc_len); postings (term, doc_id, tf) of the index text; search (term, doc_id, doc_len, tf) of the search text.

    lists: the rows of search by document with its title and artist, (doc_id, titulo, artista, doc_len, terms); an index without them makes them.
    """

    songs: DataFrame
    docs: DataFrame
    postings: DataFrame
    search: DataFrame
    lists: DataFrame | None = None

    def by_document(self) -> DataFrame:
        if self.lists is not None:
            return self.lists
        listed = self.search.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        named = self.songs.select(F.col("id").alias("doc_id"), "titulo", "artista").join(self.docs.select("doc_id", "doc_len"), "doc_id").join(listed, "doc_id", "left")
        return named.withColumn("terms", F.coalesce("terms", F.array().cast(listed.schema["terms"].dataType)))


def tally(found: Column) -> Column:
    """(term, tf) of a list of terms: the lengths of its runs, once it is in order."""

    def runs(terms: Column) -> Column:
        begins = F.array_compact(F.transform(terms, lambda t, i: F.when((i == 0) | (F.get(terms, i - 1) != t), i)))
        ends = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(terms))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(terms, i).alias("term"), (ends(at, k) - i).cast("long").alias("tf"))))

    return let(F.sort_array(found), runs)


def analysed(songs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(doc_id, titulo, artista, idioma, doc_len, index_terms, search_terms), the last two as lists of (term, tf).

    The index text is the search text with genres and tags after it; where both are of one language, its terms are those of the
    search text and of what comes after, so the long part of a song is analysed once.
    """
    rows = songs.select(F.col("id").alias("doc_id"), "titulo", "artista", index_text().alias("i"), search_text().alias("s"))
    rows = rows.withColumn("idioma", language(F.col("i")))
    if languages is not None:
        known = languages.select("doc_id", F.col("idioma").alias("known"))
        rows = rows.join(known, "doc_id", "left").withColumn("idioma", F.coalesce("known", "idioma"))
    rows = rows.withColumn("own", language(F.col("s")))
    found = rows.withColumn("search_terms", terms(F.col("s"), F.col("own")))
    continued = F.concat(F.col("search_terms"), terms(F.substr(F.col("i"), F.length("s") + 1), F.col("idioma")))
    after = F.startswith("i", F.concat("s", F.lit(" "))) | (F.col("i") == F.col("s"))
    index_terms = F.when(after & (F.col("idioma") == F.col("own")), continued).otherwise(terms(F.col("i"), F.col("idioma")))
    return found.select("doc_id", "titulo", "artista", "idioma", word_count(F.col("s")).alias("doc_len"), tally(index_terms).alias("index_terms"), tally(F.col("search_terms")).alias("search_terms"))


def build(songs: DataFrame, languages: DataFrame | None = None) -> Index:
    """Full build, one row of songs an id: one pass over them, in which terms are counted within the row, so that postings need no exchange. What it finds is staged; the tables of the index read it. languages (doc_id, idioma): those known already; other documents' are detected."""
    found = stage(analysed(songs, languages), "analysed")
    postings = found.select("doc_id", F.inline("index_terms")).select("term", "doc_id", "tf")
    search = found.select("doc_id", "doc_len", F.inline("search_terms")).select("term", "doc_id", "doc_len", "tf")
    lists = found.select("doc_id", "titulo", "artista", "doc_len", F.col("search_terms").alias("terms"))
    return Index(songs, found.select("doc_id", "idioma", "doc_len"), postings, search, lists)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_stats(index: Index) -> DataFrame:
    """(term, df, idf) with idf = ln(N / (df + 1)), which may be negative."""
    n = index.docs.agg(F.count("*").alias("n"))
    return document_frequency(index.postings).join(F.broadcast(n)).select("term", "df", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(term, df, postings as doc:tf, comma-joined, by doc): for export of an index of bounded size."""
    listed = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["doc_id"], x["tf"].cast("string"))), ",").alias("postings"))


def average_length(docs: DataFrame) -> DataFrame:
    """avg_len over all documents; 100 without any."""
    return docs.agg(F.coalesce(F.avg("doc_len"), F.lit(100.0)).alias("avg_len"))


def extend(index: Index, new_songs: DataFrame) -> Index:
    """The index with new songs; of an id that is there already, the new row replaces the old. Equals a full build."""
    new = build(new_songs)
    ids = new_songs.select(F.col("id").alias("doc_id"))
    old = lambda rows: rows.join(ids, "doc_id", "left_anti")
    songs = index.songs.join(new_songs.select("id"), "id", "left_anti").unionByName(new_songs)
    return Index(songs, old(index.docs).unionByName(new.docs), old(index.postings).unionByName(new.postings), old(index.search).unionByName(new.search))
