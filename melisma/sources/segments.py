"""An index in segments that are never changed: a batch adds one, replaced songs are told by marks, and small segments are merged."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from melisma.operators.index import Index, build, document_frequency

#: Tables of a segment that hold rows of songs, with the column of their id.
ROWS = {"songs": "id", "docs": "doc_id", "postings": "doc_id", "search": "doc_id"}
#: A segment is merged with the next newer ones once they hold at least one in so many of its songs.
RATIO = 2
MANIFEST = "name string, low long, high long, songs long"


@dataclass(frozen=True)
class Segment:
    """What the batches from low to high have left: a folder's name, and how many songs it holds."""

    name: str
    low: int
    high: int
    songs: int


@dataclass(frozen=True)
class Segments:
    """The segments of a folder as of a batch, from old to new.

    Beside the rows of its songs a segment holds terms (term, df) and totals (n, length), which are what its batches added
    less what they replaced, so sums over all segments are those of the live songs; and gone (doc_id, before): a song's
    rows in segments older than `before` are dead.
    """

    spark: SparkSession
    folder: str
    batch: int
    active: tuple[Segment, ...]

    def part(self, segment: Segment, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{segment.name}/{name}")

    def every(self, name: str, of: tuple[Segment, ...] | None = None) -> DataFrame:
        """A table of all segments together, with `high` of each row's segment."""
        of = self.active if of is None else of
        return reduce(DataFrame.unionByName, (self.part(s, name).withColumn("high", F.lit(s.high)) for s in of))

    def live(self, name: str, of: tuple[Segment, ...] | None = None) -> DataFrame:
        """The rows of a table that no newer segment replaces."""
        rows, gone, key = self.every(name, of), self.every("gone").groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("before").alias("before")), ROWS[name]
        return rows.join(gone, (rows[key] == gone["gone_id"]) & (rows["high"] < gone["before"]), "left_anti").drop("high")

    def index(self) -> Index:
        return Index(*(self.live(name) for name in ROWS))

    def document_frequency(self) -> DataFrame:
        """(term, df) by the segments' sums; no postings are read."""
        return self.every("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """(n, length): songs and words, one row."""
        return self.every("totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def opened(spark: SparkSession, folder: str, before: int | None = None) -> Segments | None:
    """The newest state, or the newest of batches before one; None without any."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{folder}/manifest")
    except AnalysisException:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    found = rows.where(F.col("batch") == last).orderBy("low").collect()
    return Segments(spark, folder, last, tuple(Segment(r["name"], r["low"], r["high"], r["songs"]) for r in found))


def write(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame]) -> int:
    """Write a segment; how many songs it holds, which comes with the write."""
    seen = Observation(name)
    for part, table in tables.items():
        table = table.observe(seen, F.count("*").alias("n")) if part == "songs" else table
        table = table.sortWithinPartitions("term") if "term" in table.columns else table
        table.write.mode("overwrite").parquet(f"{folder}/segments/{name}/{part}")
    return seen.get["n"]


def sums(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """(term, df) of postings that count for or against."""
    signed = (document_frequency(rows).select("term", (F.col("df") * sign).alias("df")) for sign, rows in parts)
    return reduce(DataFrame.unionByName, signed).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")


def lengths(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    signed = (docs.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("doc_len"), F.lit(0)) * sign).alias("length")) for sign, docs in parts)
    return reduce(DataFrame.unionByName, signed).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def run_to_merge(active: list[Segment]) -> int:
    """Where the run of newest segments begins that are to be one; the newest itself if none are."""
    start, held = len(active) - 1, active[-1].songs
    while start and active[start - 1].songs <= RATIO * held:
        start -= 1
        held += active[start].songs
    return start


def add(spark: SparkSession, folder: str, songs: DataFrame, batch: int) -> Segments:
    """The state after a batch of songs, one row an id; an id that is there already is replaced. Batches are numbered upwards.

    What is written is in proportion to the batch, but for merges, in which a song takes part about as often as the
    number of songs can be halved. A batch that is run again starts from the state before it and writes the same folders, and the manifest
    comes last, so a broken run leaves nothing that is read. Merged segments stay for those who read an older state.
    """
    before = opened(spark, folder, batch)
    new = build(songs)
    if before is None:
        gone = new.docs.select("doc_id", F.lit(batch).cast("long").alias("before")).limit(0)
        replaced: list[tuple[int, DataFrame]] = []
        tables = {"terms": sums([(1, new.postings)]), "totals": lengths([(1, new.docs)])}
    else:
        ids = new.docs.select("doc_id")
        old = before.live("docs").join(ids, "doc_id", "left_semi")
        gone = old.select("doc_id", F.lit(batch).cast("long").alias("before"))
        replaced = [(-1, before.live("postings").join(ids, "doc_id", "left_semi"))]
        tables = {"terms": sums([(1, new.postings), *replaced]), "totals": lengths([(1, new.docs), (-1, old)])}
    tables |= {"songs": new.songs, "docs": new.docs, "postings": new.postings, "search": new.search, "gone": gone}
    added = Segment(f"b{batch}", batch, batch, write(spark, folder, f"b{batch}", tables))
    active = [*(before.active if before else ()), added]
    start = run_to_merge(active)
    if start < len(active) - 1:
        whole, run = Segments(spark, folder, batch, tuple(active)), tuple(active[start:])
        rest = whole.every("gone", run).groupBy("doc_id").agg(F.max("before").alias("before")).where(F.lit(start > 0))
        kept = {name: whole.live(name, run) for name in ROWS} | {"gone": rest}
        kept |= {"terms": whole.every("terms", run).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "totals": whole.every("totals", run).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))}
        name = f"m{batch}"
        active = [*active[:start], Segment(name, run[0].low, batch, write(spark, folder, name, kept))]
    rows = spark.createDataFrame([(s.name, s.low, s.high, s.songs) for s in active], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")
    return Segments(spark, folder, batch, tuple(active))
