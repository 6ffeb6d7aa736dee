"""Ranked search: lexical scores from postings, surface and semantic scores, reasons and result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.functions.tables import LANGUAGE_NAMES, UNKNOWN_LANGUAGE
from melisma.functions.text import language, strip, terms, words

from melisma.sources.staging import stage

from . import matching
from .index import Index, average_length, document_frequency
from .passes import passed, whole_queries
from .semantic import Meaning

# Weights of the parts of a score, BM25's constants, and the least score of a result.
TITLE_SIMILARITY, ARTIST_SIMILARITY, SIMILAR = 5.0, 5.0, 0.3
TITLE_WORD, ARTIST_WORD, LEXICAL, SEMANTIC = 2.0, 2.0, 1.5, 4.0
PHRASE, ARTIST_EQUAL, STARTS = 8.0, 5.0, 3.0
K1, B, LEAST_SCORE, SEMANTIC_SHOWN = 1.5, 0.75, 15.0, 0.05
#: Queries that one pass over all songs takes.
MOST_QUERIES = 16_384
#: Parts of the documents with their vectors for each core.
PARTS = 4
#: Letters of a gram that words are found by.
GRAM = 3


def query_table(spark, queries: list[str]) -> DataFrame:
    """(query_id, q): lower case, stripped; blank queries give no rows."""
    rows = spark.createDataFrame([*enumerate(queries)], "query_id int, raw string")
    return rows.select("query_id", strip(F.lower("raw")).alias("q")).where("q <> ''")


def weighed(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf) of the terms of queries (query_id, q), each analysed in its own language; document frequencies are those of the index text."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("q"), language(F.col("q"))))).alias("term"))
    n = index.docs.agg(F.count("*").alias("n"))
    seen = document_frequency(index.postings.join(wanted.select("term").distinct(), "term", "left_semi"))
    rows = wanted.join(seen, "term", "left").join(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(0)))
    return rows.select("query_id", "term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def term_part() -> Column:
    """What a term adds to a document's score, but for its idf; columns tf, doc_len, avg_len."""
    length = F.when(F.col("avg_len") > 0, F.col("doc_len") / F.col("avg_len")).otherwise(F.lit(0.0))
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, bm25): document frequencies of the index text, term frequencies of the search text.

    Only postings of query terms are read, so work follows the matches. The queries are a table of any size; its joins
    are sent to all tasks only where the measured size allows.
    """
    hits = index.search.join(weighed(index, queries), "term").join(F.broadcast(average_length(index.docs)))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * term_part()).alias("bm25"))


def matched(query: Column, other: Column) -> Column:
    return F.size(F.array_intersect(words(query), words(F.lower(other)))).cast("long")


def features(rows: DataFrame, *also: str) -> DataFrame:
    """Features of titles and artists for rows (query_id, doc_id, q, titulo, artista)."""
    q, title, artist = F.col("q"), F.col("titulo"), F.col("artista")
    return rows.select(
        "query_id",
        "doc_id",
        "q",
        "titulo",
        "artista",
        *also,
        matched(q, title).alias("title_words"),
        matched(q, artist).alias("artist_words"),
        F.contains(F.lower(title), q).alias("in_title"),
        F.contains(F.lower(artist), q).alias("in_artist"),
        ((F.lower(artist) == q) & (strip(artist) != "")).alias("is_artist"),
        F.get(words(q), F.lit(0)).alias("first"),
        F.startswith(F.lower(title), F.get(words(q), F.lit(0))).alias("starts"),
    )


def paired(songs: DataFrame, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, q, doc_id, titulo, artista): all songs for each of a block of stated queries, which are literals of one pass."""
    listed = F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("q")) for i, q in queries))
    return songs.select(F.col("id").alias("doc_id"), "titulo", "artista", F.inline(listed))


def surface(songs: DataFrame, queries: list[tuple[int, str]]) -> DataFrame:
    """Features of titles and artists, a row for each stated query and document."""
    return features(paired(songs, queries))


def grams(text: Column) -> Column:
    """The distinct runs of one to GRAM letters."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*(F.when(F.length(text) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))


def sharing(songs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): the pairs in which any feature of title or artist can hold, and few others; no pair of them is lost.

    A word in common is found by joining the words. A title that begins with the query's first word has a word that begins so;
    a title or artist that holds the whole query has a word that holds the query's longest one. Such words are looked up in the
    vocabulary of titles and artists, by the rarest gram of what is asked for, and lead to the songs by the same word postings.
    """
    named = songs.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.concat(words(F.lower("titulo")), words(F.lower("artista"))))).alias("word"))
    vocabulary = named.select("word").distinct()
    asked = queries.select("query_id", words(F.col("q")).alias("w"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"]
    parts = asked.select("query_id", F.inline(F.array(F.struct(F.lit(True).alias("begins"), F.get("w", F.lit(0)).alias("part")), F.struct(F.lit(False).alias("begins"), longest.alias("part")))))
    looked = parts.select("begins", "part").distinct().withColumn("gram", F.explode(F.filter(grams(F.col("part")), lambda g: F.length(g) == F.least(F.length("part"), F.lit(GRAM)))))
    spelled = vocabulary.select("word", F.explode(grams(F.col("word"))).alias("gram")).join(looked.select("gram").distinct(), "gram", "left_semi")
    often = spelled.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no word has leaves no word for what asks by it
    rarest = looked.join(often, "gram", "left").groupBy("begins", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    holding = rarest.join(spelled, "gram").where(F.when(F.col("begins"), F.startswith("word", "part")).otherwise(F.contains("word", "part")))
    found = parts.join(holding.select("begins", "part", "word"), ["begins", "part"]).select("query_id", "word")
    every = found.unionByName(asked.select("query_id", F.explode("w").alias("word"))).distinct()
    return every.join(named, "word").select("query_id", "doc_id").distinct()


def score_parts() -> dict[str, Column]:
    c, flag = F.col, lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return {
        "titulo": F.when(c("title_sim") > SIMILAR, c("title_sim") * TITLE_SIMILARITY).otherwise(F.lit(0.0)),
        "artista": F.when(c("artist_sim") > SIMILAR, c("artist_sim") * ARTIST_SIMILARITY).otherwise(F.lit(0.0)),
        "palabras_titulo": c("title_words") * TITLE_WORD,
        "palabras_artista": c("artist_words") * ARTIST_WORD,
        "bm25": c("bm25") * LEXICAL,
        "semantica": F.when(c("semantic") > 0, c("semantic") * SEMANTIC).otherwise(F.lit(0.0)),
        "frase": flag(c("in_title") | c("in_artist"), PHRASE),
        "artista_exacto": flag(c("is_artist"), ARTIST_EQUAL),
        "inicio": flag(c("starts"), STARTS),
    }


def reasons() -> Column:
    c, parts = F.col, score_parts()
    shown = (
        (parts["titulo"] > 0, F.format_string("título (%.2f)", c("title_sim"))),
        (parts["artista"] > 0, F.format_string("artista (%.2f)", c("artist_sim"))),
        (c("title_words") > 0, F.format_string("%d palabras en título", c("title_words"))),
        (c("artist_words") > 0, F.format_string("%d palabras en artista", c("artist_words"))),
        (c("bm25") > 0, F.format_string("BM25 (%.3f)", c("bm25"))),
        (c("semantic") > SEMANTIC_SHOWN, F.format_string("semántica (%.2f)", c("semantic"))),
        (c("in_title"), F.lit("frase exacta en título")),
        (~c("in_title") & c("in_artist"), F.lit("frase exacta en artista")),
        (c("is_artist"), F.lit("artista completo")),
        (c("starts"), F.format_string("título comienza con '%s'", c("first"))),
    )
    return F.array_compact(F.array(*(F.when(test, text) for test, text in shown)))


def candidates(index: Index, queries: DataFrame, least: float, with_similarity: bool, meaning: Meaning | None = None) -> DataFrame:
    """Rows of matching.KINDS of the pairs of a query (query_id, q) and a document whose score reaches `least`, but for meaning if it is not given.

    A task has the lists and vectors of its documents and makes the whole score for a pass of queries, so no pair that falls short
    leaves it. Similarity, which costs most, is computed only where the rest and the letters in common can reach the least score.
    """
    kind, spark = queries.schema["query_id"].dataType.simpleString(), queries.sparkSession
    queries = stage(queries.select("query_id", "q"), "asked")
    average = average_length(index.docs).first()["avg_len"]
    title, artist = (F.coalesce(F.lower(c), F.lit("")) for c in ("titulo", "artista"))
    rows = index.by_document().select("doc_id", "doc_len", "terms", title.alias("titulo"), artist.alias("artista"))
    asked = whole_queries(queries, weighed(index, queries))
    if meaning is not None:
        most = PARTS * spark.sparkContext.defaultParallelism
        rows = rows.repartition(most, "doc_id").join(meaning.docs.repartition(most, "doc_id"), "doc_id", "left")
        asked = stage(asked.join(meaning.queries, "query_id").orderBy("query_id"), "queries")
    if with_similarity:  # copies of a title, and titles of like length, are compared together
        rows = rows.sortWithinPartitions(F.length("titulo"), "titulo")
    rows = rows.select("*", *(F.array_distinct(words(F.col(c))).alias(f"{name}_words") for c, name in (("titulo", "title"), ("artista", "artist"))))
    weights = {"word": TITLE_WORD, "bm25": LEXICAL, "phrase": PHRASE, "artist": ARTIST_EQUAL, "starts": STARTS, "semantic": SEMANTIC}
    similar = (TITLE_SIMILARITY, ARTIST_SIMILARITY, SIMILAR) if with_similarity else None
    # sums in another order may differ in their last digits
    matcher = lambda held: matching.Matcher(held, average, (K1, B), weights, least - 1e-6, similar)
    found = passed(asked, lambda held: rows.mapInArrow(matcher(held).__call__, matching.KINDS), MOST_QUERIES)
    found = spark.createDataFrame([], matching.KINDS) if found is None else found
    return found.withColumn("query_id", F.col("query_id").cast(kind))


def search(
    index: Index, queries: list[str] | DataFrame, min_score: float = LEAST_SCORE, semantic: DataFrame | Callable[[DataFrame], DataFrame] | Meaning | None = None, with_similarity: bool = True
) -> DataFrame:
    """(query_id, doc_id, score, razones) of documents with at least min_score.

    queries: texts, or a table (query_id, q) of any size, q stripped and in lower case, none blank. semantic: the vectors of all
    documents and queries; or (query_id, doc_id, semantic), or what gives these for a table of pairs (query_id, doc_id), which is
    then asked for the pairs that reach the least score together with the most that meaning can add.
    """
    spark = index.songs.sparkSession
    asked = queries if isinstance(queries, DataFrame) else query_table(spark, queries)
    if semantic is None or isinstance(semantic, Meaning):
        rows = candidates(index, asked, min_score, with_similarity, semantic)
    else:
        rows = candidates(index, asked, min_score - SEMANTIC, with_similarity).drop("semantic")
        if callable(semantic):
            rows = stage(rows, "candidates")
            semantic = semantic(rows.select("query_id", "doc_id"))
        rows = rows.join(semantic, ["query_id", "doc_id"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    total = F.lit(0.0)
    for part in score_parts().values():
        total = total + part
    return rows.select("query_id", "doc_id", total.alias("score"), reasons().alias("razones")).where(F.col("score") >= min_score)


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of each query, with rank; ties by doc_id. A report, so the cap is the feature."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")  # the order of a sum is no order of results
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with dots where it was cut."""
    begin, stop = F.greatest(start, F.lit(0)), F.least(end, F.length(text))
    body = strip(F.substring(text, begin + 1, stop - begin))
    return F.concat(F.when(begin > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(stop < F.length(text), F.lit("...")).otherwise(F.lit("")))


def snippet(text: Column, query: Column, before: int = 40, after: int = 80) -> Column:
    """The text around the query, else around its first word of over three letters that occurs; null without a hit."""
    q = strip(F.lower(query))
    lower = F.lower(text)
    word = F.get(F.filter(words(q), lambda w: (F.length(w) > 3) & F.contains(lower, w)), F.lit(0))
    at = F.when(F.contains(lower, q), F.position(q, lower)).otherwise(F.position(word, lower)) - 1
    return F.when((text == "") | (q == ""), F.lit("")).when(at >= 0, excerpt(text, at - before, at + F.length(q) + after))


def result_rows(found: DataFrame, songs: DataFrame, queries: DataFrame) -> DataFrame:
    """API rows: results whose document exists, with snippet and rounded score."""
    rows = found.join(songs, found["doc_id"] == songs["id"]).join(queries, "query_id")
    return rows.select(
        "query_id", "id", "titulo", "artista", "album", "generos", "tags", F.round("score", 2).alias("score"), F.lit("N/A").alias("año"), F.lit("N/A").alias("duracion"), snippet(F.col("letra"), F.col("q")).alias("snippet"), "letra"
    )


def console_excerpt(text: Column, query: Column) -> Column:
    """The excerpt of a result list: around the query, else around the first of its first two words that has over three letters and occurs, else the begin of a text of over ten characters; null without any."""
    q, lower = F.lower(query), F.lower(text)

    def around(found: Column, before: int, after: int) -> Column:
        at = F.position(found, lower) - 1
        begin = F.greatest(at - before, F.lit(0))
        return F.concat(F.lit("..."), F.replace(F.substring(text, begin + 1, F.least(at + after, F.length(text)) - begin), F.lit("\n"), F.lit(" ")), F.lit("..."))

    word = F.get(F.filter(F.slice(words(q), 1, 2), lambda w: (F.length(w) > 3) & F.contains(lower, w)), F.lit(0))
    head = F.substring(text, 1, 100)
    shown = F.when(F.contains(lower, q), around(q, 50, 100)).when(word.isNotNull(), around(word, 40, 60))
    shown = shown.when(F.length(head) > 10, F.concat(F.replace(head, F.lit("\n"), F.lit(" ")), F.lit("...")))
    return F.when((text != "") & (query != ""), shown)


def text_lines(*parts: tuple[Column, Column]) -> Column:
    """Lines of a text; each line only where its test holds."""
    return F.array_join(F.array_compact(F.array(*(F.when(test, line) for test, line in parts))), "\n")


def display_rows(found: DataFrame, songs: DataFrame, queries: DataFrame, min_score: float = LEAST_SCORE, most: int = 15) -> DataFrame:
    """(query_id, rank, doc_id, text, more): the console's list, a text for each of the first `most` results, and how many more there are.

    found: results with scores, of which those under min_score are left out; or documents (query_id, doc_id) given by
    id alone, which are listed with score 0 and without reasons. queries: (query_id, q); the excerpt needs them.
    """
    if "score" in found.columns:
        found = found.where(F.col("score") >= min_score)
    else:
        found = found.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("razones"))
    left = found.groupBy("query_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    rows = ranked(found, most).join(left, "query_id").join(songs.withColumnRenamed("id", "doc_id"), "doc_id").join(queries.select("query_id", "q"), "query_id", "left")
    head = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    excerpt = console_excerpt(F.col("letra"), F.coalesce("q", F.lit("")))
    text = text_lines(
        (F.lit(True), F.format_string("%d. [Relevancia: %.2f] 🎵 %s", "rank", "score", "titulo")),
        (F.lit(True), F.format_string("   👤 Artista: %s", "artista")),
        (F.size("razones") > 0, F.concat(F.lit("   📊 Relevancia por: "), head("razones", 3))),
        (F.col("album") != "", F.format_string("   💿 Álbum: %s", "album")),
        (F.size("generos") > 0, F.concat(F.lit("   🏷️  Géneros: "), head("generos", 3))),
        (F.size("tags") > 0, F.concat(F.lit("   🔖 Tags: "), head("tags", 3))),
        (excerpt.isNotNull(), F.concat(F.lit("   📝 "), excerpt)),
    )
    return rows.select("query_id", "rank", "doc_id", text.alias("text"), "more")


def detail_rows(songs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text): the console's view of whole songs. docs: (doc_id, idioma); the language of a song without one is unknown, one without a name is shown by its code."""
    rows = songs.join(docs.select(F.col("doc_id").alias("id"), "idioma"), "id", "left")
    lang = F.coalesce("idioma", F.lit(UNKNOWN_LANGUAGE))
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    text = text_lines(
        (F.lit(True), F.format_string("🎵 %s", "titulo")),
        (F.lit(True), F.format_string("👤 Artista: %s", "artista")),
        (F.col("album") != "", F.format_string("💿 Álbum: %s", "album")),
        (F.size("generos") > 0, F.concat(F.lit("🏷️  Géneros: "), F.array_join("generos", ", "))),
        (F.size("tags") > 0, F.concat(F.lit("🔖 Tags: "), F.array_join(F.slice("tags", 1, 10), ", "))),
        (F.lit(True), F.concat(F.lit("🌐 Idioma detectado: "), F.coalesce(F.try_element_at(names, lang), lang))),
        (F.lit(True), F.lit("📝 LETRA COMPLETA:")),
        (F.lit(True), F.col("letra")),
    )
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"))
