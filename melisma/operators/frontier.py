"""Breadth-first crawl over stored pages: the queue, what is done and what was found are tables, joined in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.sources.staging import counted, stage

from .html import scrape
from .robots import forbidden, rules

# Path parts of relevant pages, trusted hosts, links taken from a page.
RELEVANT = "lyrics song artist album track music cancion letra artists songs albums".split()
TRUSTED = ("azlyrics.com",)
MOST_LINKS = 10


def relevant(url: Column) -> Column:
    return F.lower(url).rlike("/(" + "|".join(RELEVANT) + ")/")


def authority(url: Column) -> Column:
    """Host with user and port, lower case; blank for a bad URL."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit(""))


def trusted(url: Column, hosts: tuple[str, ...] = TRUSTED) -> Column:
    """The host contains a trusted one."""
    out = F.lit(False)
    for name in hosts:
        out = out | F.contains(authority(url), F.lit(name))
    return out


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def allowed(rules: str | None, url: str) -> bool:
    """Whether robots rules let any agent fetch the URL; without rules, yes."""
    from urllib.robotparser import RobotFileParser

    if rules is None:
        return True
    parser = RobotFileParser()
    parser.parse(rules.splitlines())
    return parser.can_fetch("*", url)


@dataclass(frozen=True)
class Crawled:
    """records (url, record, meta, depth) of the pages visited that have title and artist; visited (url, depth); counts, one row: visited, songs, queued, failed."""

    records: DataFrame
    visited: DataFrame
    counts: DataFrame


def outcomes(queue: DataFrame, done: DataFrame, stored: DataFrame, rules: DataFrame | None) -> DataFrame:
    """(url, first, last, entries, depth, outcome) of a queue (pos, url, depth) less what is done: visit, skip (forbidden or no page of HTML) or fail (not stored)."""
    head = queue.groupBy("url").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("entries"), F.min_by("depth", "pos").alias("depth"))
    head = head.join(done, "url", "left_anti")
    known = head.join(stored.select("url", "plain"), "url", "left")
    barred = F.lit(False)
    if rules is not None:
        known = known.join(forbidden(head, rules).withColumn("barred", F.lit(True)), "url", "left")
        barred = F.coalesce("barred", F.lit(False))
    kind = F.when(barred | (F.col("plain") == F.lit(False)), "skip").when(F.col("plain"), "visit").otherwise("fail")
    return known.select("url", "first", "last", "entries", "depth", kind.alias("outcome"))


def cut_after(found: DataFrame, left: int) -> int | None:
    """The place in the queue of the last visit that a budget allows; None if it allows all.

    A running count: visits are counted by partition of the queue, whose numbers are in its order, and only in the
    one partition where the budget ends are places put in order.
    """
    visits = found.where("outcome = 'visit'").withColumn("part", F.shiftright("first", 33))
    for r in sorted(visits.groupBy("part").count().collect()):
        if r["count"] >= left:
            return visits.where(F.col("part") == r["part"]).orderBy("first").limit(left).agg(F.max("first")).first()[0]
        left -= r["count"]
    return None


def queue_of(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(pos, url, depth) of rows in an order, and how many; pos grows in that order, without a task that sees all of them."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("pos"), "url", "depth")
    found, seen = counted(placed, "queue", n=F.count("*"))
    return found, seen["n"]


def new_links(links: DataFrame, found: DataFrame, done: DataFrame) -> DataFrame:
    """(page, place, url, depth): the links of visited pages (page is their place in the queue) that are queued, the first MOST_LINKS of each page.

    As if pages were taken one after another: a link is new if its url is not done, nor done by an earlier page of this
    round, and neither later in the queue nor queued by an earlier page. What earlier pages queue depends on what they
    leave out themselves; so the pages that queue a url are found again until nothing changes, which settles at least one more
    page in the order of the queue each time, and most at once.
    """
    at = found.select("url", "first", "last", (F.col("outcome") != "fail").alias("settled"))
    rows = links.join(done, "url", "left_anti").join(at, "url", "left")
    earlier, later = F.col("settled") & (F.col("first") < F.col("page")), F.col("last") > F.col("page")
    rows = stage(rows.where(F.coalesce(~earlier & ~later, F.lit(True))).select("page", "place", "url", "depth"), "links")
    order = Window.partitionBy("page").orderBy("place")

    def heads(some: DataFrame) -> DataFrame:
        return some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_LINKS).drop("n")

    mark = {"n": F.count("*"), "places": F.sum(F.xxhash64("page", "place").cast("decimal(38,0)"))}
    taken, before = counted(heads(rows), "taken", **mark)
    while True:
        owner = taken.groupBy("url").agg(F.min("page").alias("owner"))
        taken, after = counted(heads(rows.join(owner, "url", "left").where("owner IS NULL OR owner >= page").drop("owner")), "taken", **mark)
        if after == before:
            return taken
        before = after


def crawl_counted(pages: DataFrame, seeds: list[str] | DataFrame, budget: int = 1000, accept: Column | None = None, robots: dict[str, str] | DataFrame | None = None) -> Crawled:
    """A crawl in the order of a queue, until it is empty or `budget` pages were visited.

    The queue, what is done and what was found are tables; a round takes all of the queue, and its pages' links are the next
    one, in the order of the page and of the link in it. Of a page the first MOST_LINKS accepted links that are
    neither done nor queued are queued. A url that robots rules (a dict, or a table (host, rules)) forbid, or whose page
    (column content_type, if there is one) is not HTML, is done without a visit; one that is not stored fails, and may be
    queued again. seeds: a list, or a table (pos, url). Each round's pages are scraped once, and read again from what was staged.
    """
    spark = pages.sparkSession
    test = accept if accept is not None else relevant(F.col("url")) & trusted(F.col("url"))
    plain = is_html(F.col("content_type")) if "content_type" in pages.columns else F.lit(True)
    stored = pages.withColumn("plain", plain).dropDuplicates(["url"])
    texts = spark.createDataFrame(list(robots.items()), "host string, rules string") if isinstance(robots, dict) and robots else robots or None
    found_rules = None if texts is None else stage(rules(texts), "robots")
    start = spark.createDataFrame([*enumerate(seeds)], "pos long, url string") if isinstance(seeds, list) else seeds
    queue, waiting = queue_of(start.select("pos", F.lit(0).alias("place"), "url", F.lit(0).alias("depth")), "pos", "place", "url")
    done = spark.createDataFrame([], "url string")
    scraped, queued, failed = [], waiting, 0
    measures = {"visits": F.count_if(F.col("outcome") == "visit"), "failed": F.sum(F.when(F.col("outcome") == "fail", F.col("entries")).otherwise(0))}
    while budget > 0 and waiting:
        found, seen = counted(outcomes(queue, done, stored, found_rules), "outcomes", **measures)
        cut = cut_after(found, budget) if seen["visits"] >= budget else None
        taken = found if cut is None else found.where(F.col("first") <= cut)
        visits = taken.where("outcome = 'visit'").select("url", F.col("first").alias("page"), "depth")
        here = scrape(stored.join(visits.select("url"), "url")).join(visits, "url")
        here = stage(here, "scraped")
        scraped.append(here)
        links = here.select("page", F.posexplode("links").alias("place", "url"), (F.col("depth") + 1).alias("depth")).where(test)
        fresh = new_links(links, found, done)
        done = stage(done.unionByName(taken.where("outcome <> 'fail'").select("url")), "done")
        rest = 0
        if cut is None:
            failed += seen["failed"] or 0
        else:
            failed += queue.join(taken.where("outcome = 'fail'"), "url", "left_semi").where(F.col("pos") <= cut).count()
            rest = queue.where(F.col("pos") > cut).count()
        queue, waiting = queue_of(fresh, "page", "place")
        budget -= min(seen["visits"], budget)
        queued = rest + waiting
    every = scraped[0] if scraped else scrape(stored.limit(0)).withColumns({"page": F.lit(0), "depth": F.lit(0)})
    for here in scraped[1:]:
        every = every.unionByName(here)
    extracted = F.struct("record.*", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("fecha_extraccion"))
    records = every.where("record.titulo <> '' AND record.artista <> ''").select("url", extracted.alias("record"), "meta", "depth")
    counts = done.agg(F.count("*").alias("visited")).join(F.broadcast(records.agg(F.count("*").alias("songs"))))
    return Crawled(records, every.select("url", "depth"), counts.select("*", F.lit(queued).cast("long").alias("queued"), F.lit(failed).cast("long").alias("failed")))


def crawl(pages: DataFrame, seeds: list[str] | DataFrame, budget: int = 1000, accept: Column | None = None, robots: dict[str, str] | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, visited urls with their depth) of crawl_counted."""
    found = crawl_counted(pages, seeds, budget, accept, robots)
    return found.records, found.visited


def stats(visited: DataFrame, records: DataFrame, failed: int = 0, queued: int = 0, seconds: float = 0.0) -> DataFrame:
    counts = visited.agg(F.count("*").alias("visited")).join(F.broadcast(records.agg(F.count("*").alias("songs"))))
    return counts.select("*", F.lit(queued).cast("long").alias("queued"), F.lit(failed).cast("long").alias("failed"), F.lit(float(seconds)).alias("seconds"))
