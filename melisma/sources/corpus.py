"""Readers that give the song table, and the projections of its texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.functions.text import strip

SONGS = "id string, titulo string, artista string, album string, generos array<string>, tags array<string>, letra string, url string, fecha_extraccion string"
CRAWL = "id string, url string, titulo string, artista string, album string, generos array<string>, tags array<string>, letra string, metadatos map<string,string>, fecha_extraccion string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, parts) of a tab-separated file; no rows if it is missing. Ends are stripped before the cut, as blank last fields are lost."""
    try:
        rows = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "file string, pos long, parts array<string>")
    return rows.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("pos"), F.split(strip(F.col("value")), "\t").alias("parts"))


def part(i: int) -> Column:
    return strip(F.get(F.col("parts"), F.lit(i)))


def read_information(spark: SparkSession, path: str) -> DataFrame:
    """(id, artista, titulo, album): rows of four fields; the last row of an id wins."""
    rows = lines(spark, path).where(F.size("parts") >= 4)
    rows = rows.select(part(0).alias("id"), F.struct("file", "pos", part(1).alias("artista"), part(2).alias("titulo"), part(3).alias("album")).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.artista", "r.titulo", "r.album")


def gathered(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """(id, name): the items of an id's rows in the order of the file."""
    listed = rows.select(part(0).alias("id"), F.struct("file", "pos", items.alias("items")).alias("r")).groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return listed.select("id", F.flatten(F.transform("r", lambda x: x["items"])).alias(name))


def read_genres(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).where((F.size("parts") >= 2) & (part(0) != ""))
    return gathered(rows, F.array(part(1)), "generos")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Comma lists; blank items stay."""
    rows = lines(spark, path).where(F.size("parts") >= 2)
    return gathered(rows, F.transform(F.split(part(1), ","), strip), "tags")


def read_lyrics(spark: SparkSession, folder: str) -> DataFrame:
    """(id, letra): a text file a row; line ends become \\n."""
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("id"), F.regexp_replace("value", "\r\n?", "\n").alias("letra"))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records of JSON files: a list, an object with `canciones` or `songs`, or one record. Bad files have none."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    boxed = F.from_json("value", f"canciones array<struct<{crawl_struct()}>>, songs array<struct<{crawl_struct()}>>")
    listed = F.from_json("value", f"array<struct<{crawl_struct()}>>")
    records = F.coalesce(F.when(F.col("value").rlike(r"^\s*\{"), F.coalesce(boxed["canciones"], boxed["songs"])), listed)
    found = rows.select("file", F.posexplode(records).alias("pos", "r"))
    return found.select("file", "pos", "r.*")


def crawl_struct() -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in CRAWL.split(", "))


def unify(info: DataFrame, genres: DataFrame, tags: DataFrame, lyrics: DataFrame) -> DataFrame:
    """The song table: ids of any source, blanks for what is missing."""
    joined = info.join(genres, "id", "full").join(tags, "id", "full").join(lyrics, "id", "full")
    return with_defaults(joined)


def with_defaults(rows: DataFrame) -> DataFrame:
    """All columns of SONGS, blanks and empty lists for nulls and for columns that are absent."""
    out = []
    for field in SONGS.split(", "):
        name, kind = field.split(" ")
        empty = F.lit("") if kind == "string" else F.array().cast(kind)
        out.append((F.coalesce(F.col(name).cast(kind), empty) if name in rows.columns else empty).alias(name))
    return rows.select(*out)


def load_corpus(spark: SparkSession, data_folder: str, lyrics_folder: str) -> DataFrame:
    return unify(
        read_information(spark, f"{data_folder}/id_information.csv"),
        read_genres(spark, f"{data_folder}/id_genres.csv"),
        read_tags(spark, f"{data_folder}/id_tags.csv"),
        read_lyrics(spark, lyrics_folder),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """The song table of generic documents: the first sentence is the title, the source the artist, the language the genre."""
    return with_defaults(
        docs.select(
            F.col("doc_id").cast("string").alias("id"),
            F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.\n]*", 0).alias("titulo"),
            F.col("source").alias("artista"),
            F.array_compact(F.array("lang")).alias("generos"),
            F.col("text").alias("letra"),
        )
    )


def index_text() -> Column:
    """What the index counts: title, artist, lyrics, genres, tags; not the album."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    return F.concat_ws(" ", "titulo", "artista", "letra", listed("generos"), listed("tags"))


def search_text() -> Column:
    return F.concat_ws(" ", "titulo", "artista", "letra")


def semantic_text() -> Column:
    parts = F.array(F.col("titulo"), F.col("artista"), F.col("album"), F.array_join("generos", " "), F.array_join("tags", " "), F.col("letra"))
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), " "))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
