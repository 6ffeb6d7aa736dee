"""Similar pairs, requests, extractors by host, counts that come with writes, known languages, and cleaned text."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from melisma.operators import dedupe, html, index, similar
from melisma.plans import catalog
from melisma.sources import corpus, requests


def test_similar_pairs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdeé ", k=rng.choice([1, 2, 5, 9, 20, 60, 250]))) for _ in range(120)] + ["", None, "ABC", "abc", "a" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[::9], "Abc", ""])], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["similarity"] for r in similar.similar(rows, asked).collect()}
    ratio = lambda q, t: SequenceMatcher(None, q.lower(), t.lower()).ratio() if q and t else 0.0
    every = {(k, i): ratio(q, t) for k, q in asked.collect() for i, t in rows.collect()}
    assert got == {k: v for k, v in every.items() if v > 0.3} and len(got) > 100
    kinds = [rows.select(F.lower("text").alias("text")), asked.select(F.lower("text").alias("text"))]
    assert similar.bounded_pairs(*kinds, 0.3).count() < 0.7 * len(every)


def test_similar_titles(spark):
    folder = "/root/testdata/sf0.001"
    titles = {r["id"]: r["titulo"].lower() for r in catalog.songs(spark, folder).collect()}
    want = {(q, i): round(v, 6) for q in titles if int(q) % 50 == 0 for i, t in titles.items() if titles[q] and t and (v := SequenceMatcher(None, titles[q], t).ratio()) > 0.3}
    assert {(r["query_id"], r["doc_id"]): r["similarity"] for r in catalog.similar_titles(spark, folder).collect()} == want


def test_requests(spark):
    songs = corpus.with_defaults(spark.createDataFrame([("1", "The Who Sings", "The Who", "miles of road"), ("2", "Road", "X", "")], "id string, titulo string, artista string, letra string"))
    bodies = [
        (0, json.dumps({"query": "  The WHO ", "usar_genius": True, "genius_token": " t "})),
        (1, json.dumps({"query": "   "})),
        (2, json.dumps({"usar_genius": True})),
        (3, "{broken"),
        (4, None),
        (5, "[1]"),
        (6, json.dumps({"query": "nothing here", "usar_genius": True, "genius_token": " "})),
    ]
    table = spark.createDataFrame(bodies, "query_id int, body string")
    read = {r["query_id"]: r for r in requests.read(table).collect()}
    assert (read[0]["raw"], read[0]["q"], read[0]["web"]) == ("The WHO", "the who", True) and [read[i]["web"] for i in range(1, 7)] == [False] * 6
    got = {r["query_id"]: (r["status"], r["json"]) for r in requests.replies(index.build(songs), table).collect()}
    assert [x["id"] for x in json.loads(got[0][1])] == ["1"] and got[0][0] == 200
    assert got[1] == got[2] == got[6] == (200, "[]") and got[3] == got[4] == got[5] == (400, None)
    assert {tuple(r)[1:] for r in requests.replies(None, table).collect()} == {(500, '{"error": "Indexador no inicializado"}')}


PAGES = {
    "musixmatch.com": (
        "<h1 class='mxm-track-title__track'> Song </h1><a class='mxm-track-title__artist'>Band</a><p class='mxm-lyrics__content'>one</p><p class='other'>no</p><p class='x lyrics'>two</p><div class='genres-box'><a>Rock</a><a>Pop</a></div>",
        {"titulo": "Song", "artista": "Band", "letra": "one\ntwo", "generos": ["Rock", "Pop"], "tags": ["musixmatch"]},
    ),
    "last.fm": (
        "<h1>Song</h1><a class='link--primary'>Band</a>" + "".join(f"<a class='genre-x'>g{i}</a><a class='tag'>t{i}</a><a class='tag-y'>u{i}</a>" for i in range(7)),
        {"titulo": "Song", "artista": "Band", "letra": "", "generos": [f"g{i}" for i in range(5)], "tags": [x for i in range(5) for x in (f"t{i}", f"u{i}")] + ["lastfm"]},
    ),
    "musicbrainz.org": (
        "<h1><bdi>Song</bdi></h1><a href='/label/1'>L</a><a href='/artist/2'>Band</a><div class='genre-list'><a>Rock</a></div><div class='all-tags'><a>slow</a><a>old</a></div>",
        {"titulo": "Song", "artista": "Band", "letra": "", "generos": ["Rock"], "tags": ["slow", "old", "musicbrainz"]},
    ),
    "allmusic.com": (
        "<h1>no</h1><h1 class='song-title'>Song</h1><a class='song-artist'>Band</a><div class='genre'><a>Rock</a></div><div class='styles'><a>Art</a><a>Glam</a></div>",
        {"titulo": "Song", "artista": "Band", "letra": "", "generos": ["Rock"], "tags": ["Art", "Glam", "allmusic"]},
    ),
}


@pytest.mark.parametrize("domain", PAGES)
def test_extractors_by_host(domain):
    page, want = PAGES[domain]
    url = f"https://www.{domain}/x"
    assert html.extract(page, url, html.EXTRACTORS) == {"generos": [], **want, "url": url}
    assert html.extract("<p>nothing</p>", url, html.EXTRACTORS)["titulo"] == ""


def test_counts_come_with_the_write(spark):
    folder = "/root/testdata/sf0.001"
    known, records = catalog.known_songs(spark, folder), catalog.crawled(spark, folder)
    _, counts = dedupe.merge(known, records, ["conv_id", "turn"])
    assert "FileScan" not in counts._jdf.queryExecution().executedPlan().toString()  # the records are not read again
    n = {r["status"]: r["n"] for r in counts.collect()}
    assert sum(n.values()) == records.count() and n["agregada"] > 0
    none = dedupe.merge(known, records.limit(0), ["conv_id", "turn"])[1]
    assert {r["status"]: r["n"] for r in none.collect()} == {"agregada": 0, "duplicada": 0, "omitida": 0}


def test_known_languages(spark):
    songs = corpus.with_defaults(spark.createDataFrame([("1", "the singing road", "a"), ("2", "the singing road", "a")], "id string, titulo string, artista string"))
    known = spark.createDataFrame([("2", "es")], "doc_id string, idioma string")
    found = index.build(songs, known)
    assert {r["doc_id"]: r["idioma"] for r in found.docs.collect()} == {"1": "en", "2": "es"}
    terms = {i: {r["term"] for r in found.postings.where(F.col("doc_id") == i).collect()} for i in ("1", "2")}
    assert terms["1"] == {"sing", "road"} and terms["2"] == {"the", "singing", "road"}
    assert found.search.where("doc_id = '2'").count() == 2  # the search text is always analysed in its own language


def test_clean_text(spark):
    cases = [(" a \t\n b c ", " a b c "), ("x@y#z$ 1-2.3,4!5?", "xyz 1-2.3,4!5?"), ("ñandú_é ß 日本 (ok) «q»", "ñandú_é ß 日本 ok q"), ("", "")]
    rows = spark.createDataFrame(cases, "text string, want string").select("want", html.clean_text(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
