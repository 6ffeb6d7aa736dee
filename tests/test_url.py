"""References resolved in the JVM against the standard library."""

import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from melisma.functions import url

STANDARD = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g".split()
MORE = ["", " g ", "a\tb\nc", "g?", "g#", "g;", "..;x", "//", "///p", "//h", "//h?q", "HTTP://X/y", "mailto:a@b", "javascript:void(0)", "a//b", "/a//b/../c", "1:2", "x:y:z", "?", "#", ";", "//[x", "é ü", "a/b;c/d;e", "//u:p@h:1/p", "./", "../..//..", "data:,x", ":", "http:", "http://", "//h/../x"]
BASES = ["http://a/b/c/d;p?q", "http://a/b/c/", "http://a", "https://a?x#y", "http://a/b//c/../d", "ftp://f/x", "mailto:a@b", "", "a/b", "/a/b", "HTTP://A/b;p/c", "file:///x/y", "http://[::1/x", "//h/p"]


def plain(base, reference):
    try:
        return urljoin(base, reference)
    except ValueError:
        return None


def test_standard_examples(spark):
    pairs = [(b, r) for b in BASES for r in STANDARD + MORE]
    rows = spark.createDataFrame(pairs, "base string, reference string").select("*", url.join(F.col("base"), F.col("reference")).alias("got")).collect()
    assert [(r["base"], r["reference"], r["got"], want) for r in rows if r["got"] != (want := plain(r["base"], r["reference"]))] == []


def test_all_links_of_pages(spark):
    from melisma.plans import catalog

    folder = "/root/testdata/sf0.01"
    found = catalog.links_resolved(spark, folder)
    assert not re.search("Python|Arrow", found._jdf.queryExecution().executedPlan().toString())
    pages = {r["page_id"]: r for r in catalog.pages(spark, folder).collect()}
    rows = found.collect()
    links = {i: re.findall('<a href="([^"]*)"', p["html"]) for i, p in pages.items()}
    assert {(r["page_id"], r["place"]): r["link"] for r in rows} == {(i, k): urljoin(pages[i]["url"], x) for i, own in links.items() for k, x in enumerate(own)} and len(rows) > 1000
