"""The crawl against a plain queue on made graphs, and robots rules against the standard library."""

import random
import re
from collections import deque
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from melisma.operators import frontier, robots


def plain_crawl(links, kinds, seeds, budget, most, barred):
    """One url after another: (visited in order, done, failed, still queued)."""
    queue, done, visited, failed = deque((u, 0) for u in seeds), set(), [], 0
    while queue and len(visited) < budget:
        url, depth = queue.popleft()
        if url in done:
            continue
        if url in barred:
            done.add(url)
        elif url not in kinds:
            failed += 1
        elif kinds[url] != "text/html":
            done.add(url)
        else:
            new, waiting = [], {u for u, _ in queue}
            for u in links[url]:
                if u not in done and u not in waiting and len(new) < most:
                    new.append(u)
            queue.extend((u, depth + 1) for u in new)
            done.add(url)
            visited.append((url, depth))
    return visited, done, failed, len(queue)


def graph(seed, n):
    rng = random.Random(seed)
    urls = [f"http://h{rng.randrange(3)}.org/p{i}" for i in range(n)]
    hubs = urls[:5]
    links = {u: [rng.choice(hubs if rng.random() < 0.2 else urls) for _ in range(rng.choice([0, 1, 3, 14, 30]))] for u in urls}
    kinds = {u: "application/pdf" if rng.random() < 0.1 else "text/html" for u in urls if rng.random() < 0.85}
    return urls, links, kinds


@pytest.mark.parametrize("seed, budget", [(1, 1000), (2, 17), (3, 1)])
def test_equal_to_a_queue(spark, seed, budget):
    urls, links, kinds = graph(seed, 60)
    seeds = [urls[7], *list(kinds)[2:5], urls[7], "http://none/x", urls[-1]]
    rules = {"h1.org": "User-agent: *\nDisallow: /p1"}
    barred = {u for u in urls if urlparse(u).netloc == "h1.org" and urlparse(u).path.startswith("/p1")}
    rows = [(i, u, "".join(f"<a href='{v}'>x</a>" for v in links[u]), kinds[u]) for i, u in enumerate(kinds)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, content_type string")
    visited, done, failed, left = plain_crawl(links, kinds, seeds, budget, frontier.MOST_LINKS, barred)
    found = frontier.crawl_counted(pages, seeds, budget, F.lit(True), rules)
    assert sorted(map(tuple, found.visited.collect())) == sorted(visited)
    assert found.counts.first().asDict() == {"visited": len(done), "songs": 0, "queued": left, "failed": failed}
    assert budget < 1000 and len(visited) == budget and left > 0 or len(visited) > 15 and failed > 3


def test_counts_of_the_registered_crawl(spark):
    from melisma.plans import catalog

    folder = "/root/testdata/sf0.001"
    rows = catalog.linked_pages(spark, folder).collect()
    site = lambda u: u[: u.index("/", 8)]
    links = {r["url"]: [site(r["url"]) + p for p in re.findall('<a href="(/[^"]*)"', r["html"])] for r in rows}
    barred = {u for u in {*links, *(v for x in links.values() for v in x)} if (p := urlparse(u).path)[:2] in ("/d", "/e") and not p.startswith("/de")}
    seeds = [r["url"] for r in sorted(rows) if r["page_id"] % 10 == 0]
    _, done, failed, left = plain_crawl(links, dict.fromkeys(links, "text/html"), seeds, 10**9, 10, barred)
    assert [r.asDict() for r in catalog.frontier_counts(spark, folder).collect()] == [{"visited": len(done), "songs": 0, "queued": left, "failed": failed}] and done & barred


def test_robots(spark):
    texts = {
        "a.org": "User-agent: *\nAllow: /x/open\nDisallow: /x\nDisallow: /y?q=1\nDisallow: /caf%C3%A9\nDisallow: /*.pdf",
        "b.org": "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:\nDisallow: /z",
        "c.org": "# nothing\nDisallow: /lost\nUser-agent: other\nUser-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two",
        "d.org": "User-agent: *\nDisallow: *",
        "e.org": "",
        "f.org:80": "User-agent:\nDisallow: /blank",
        "g.org": None,
    }
    paths = ["", "/", "/x", "/x/open/1", "/xy", "/x/closed", "/y", "/y?q=12", "/café", "/caf%c3%a9/2", "/a.pdf", "/*.pdf", "/z", "/one", "/two", "/lost", "/blank", "/a;b?c#d", "/%zz"]
    urls = [f"http://{h}{p}" for h in (*texts, "none.org", "A.org") for p in paths] + ["x", "", None, "http://[bad/x"]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    found = robots.rules(spark.createDataFrame(list(texts.items()), "host string, rules string"))
    barred = {r["url"] for r in robots.forbidden(table, found).collect()}

    def plain(url):
        try:
            rules = texts.get(urlparse(url or "").netloc.lower())
        except ValueError:
            return True
        if rules is None:
            return True
        parser = RobotFileParser()
        parser.parse(rules.splitlines())
        return parser.can_fetch("*", url)

    assert barred == {u for u in urls if not plain(u)} and len(barred) > 12
    assert robots.forbidden(table, robots.rules(spark.createDataFrame([], "host string, rules string"))).count() == 0
