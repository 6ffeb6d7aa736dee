import json
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.functions import text as T
from melisma.operators import dedupe, frontier, html, index, search, semantic
from melisma.sources import corpus, store, web
from melisma.streaming import increments

SONGS = [
    ("1", "The Who Sings", "The Who", ["rock"], "I can see for miles and miles of the singing road"),
    ("2", "Canción del mar", "Los Mares", [], "el mar y la arena cantando con las olas"),
    ("3", "Blank", "", ["pop"], "singing in the rain"),
    ("4", "Road", "The Who", [], ""),
]


@pytest.fixture(scope="module")
def songs(spark):
    return corpus.with_defaults(spark.createDataFrame(SONGS, "id string, titulo string, artista string, generos array<string>, letra string"))


def test_sources(spark, tmp_path):
    (tmp_path / "id_information.csv").write_text("1\tA\tT1\tAl\n2\tB\tT2\t\n1\tA2\tT1b\tAl\textra\n3\tC\tT3\tX\n")
    (tmp_path / "id_genres.csv").write_text("1\trock\n1\tpop\n\tlost\n9\tjazz\n")
    (tmp_path / "id_tags.csv").write_text("1\ta, ,b\n1\tc\n")
    lyrics = tmp_path / "lyrics"
    lyrics.mkdir()
    (lyrics / "1.txt").write_bytes(b"one\r\ntwo")
    (lyrics / "7.txt").write_text("日本語")
    rows = {r["id"]: r for r in corpus.load_corpus(spark, str(tmp_path), str(lyrics)).collect()}
    assert set(rows) == {"1", "3", "7", "9"}  # the row with a blank last field is lost
    assert rows["1"]["artista"] == "A2" and rows["1"]["generos"] == ["rock", "pop"] and rows["1"]["tags"] == ["a", "", "b", "c"] and rows["1"]["letra"] == "one\ntwo"
    assert rows["9"]["titulo"] == "" and rows["7"]["tags"] == []
    assert corpus.read_genres(spark, str(tmp_path / "none.csv")).count() == 0


def test_crawl_json(spark, tmp_path):
    record = {"titulo": "T", "artista": "A", "generos": "bad", "metadatos": {"k": "v"}}
    for name, value in (("a", [record, record]), ("b", {"canciones": [record]}), ("c", {"songs": [record]}), ("d", record)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "e.json").write_text("{broken")
    got = corpus.read_crawl(spark, str(tmp_path / "*.json")).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in got if r["file"] != "e.json"} == {"a.json": 2, "b.json": 1, "c.json": 1, "d.json": 1}


def plain_bm25(spark, songs, query):
    rows = songs.select("id", corpus.index_text().alias("i"), corpus.search_text().alias("s"))
    rows = rows.select("id", T.terms(F.col("i"), T.language(F.col("i"))).alias("i"), T.terms(F.col("s"), T.language(F.col("s"))).alias("t"), T.word_count(F.col("s")).alias("n")).collect()
    terms = spark.createDataFrame([(query,)], "q string").select(T.terms(F.col("q"), T.language(F.col("q"))).alias("t")).first()["t"]
    mean, out = sum(r["n"] for r in rows) / len(rows), {}
    for r in rows:
        total = 0.0
        for term in set(terms):
            tf, df = r["t"].count(term), sum(term in x["i"] for x in rows)
            total += log((len(rows) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * r["n"] / mean))
        if any(t in r["t"] for t in terms):
            out[r["id"]] = total
    return out


def test_bm25_and_search(spark, songs):
    built = index.build(songs)
    want = plain_bm25(spark, songs, "singing road")
    got = {r["doc_id"]: r["bm25"] for r in search.bm25(built, search.query_table(spark, ["singing road"])).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    found = search.search(built, ["The Who", "  "], min_score=15.0).collect()
    best = {r["doc_id"]: r for r in found}
    assert "1" in best and "4" in best and {r["query_id"] for r in found} == {0}
    assert "artista completo" in best["4"]["razones"] and best["1"]["score"] > best["4"]["score"]  # all of its terms are stop words
    rows = search.result_rows(search.search(built, ["The Who"]), songs, search.query_table(spark, ["The Who"])).collect()
    assert {r["año"] for r in rows} == {"N/A"}
    assert search.search(built, [" "]).count() == 0


def test_snippet(spark):
    text = "x" * 60 + " needle " + "y" * 200
    rows = [(text, "needle"), (text, "zz needle"), ("short needle", "NEEDLE "), ("abc", "none"), ("", "q")]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, q string").select(search.snippet(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "needle" in got[0] and "needle" in got[1]
    assert got[2:] == ["short needle", None, ""]


def test_increment_equals_build(spark, songs, tmp_path):
    part = index.extend(index.build(songs.where("id < 3")), songs.where("id >= 2"))
    whole = index.build(songs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for name in ("docs", "postings", "search"):
        columns = getattr(whole, name).columns
        assert rows(getattr(part, name).select(columns)) == rows(getattr(whole, name))
    saved = store.save(whole, str(tmp_path / "i"))
    assert rows(saved.postings) == rows(whole.postings) and store.load(spark, str(tmp_path / "none")) is None
    assert "N" not in json.loads(store.json_rows(whole.docs).first()["json"])


def test_stream(spark, songs, tmp_path):
    folder = tmp_path / "in"
    songs.where("id < 3").write.parquet(str(folder))
    songs.where("id >= 3").write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(songs.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = increments.index_stream(source, str(tmp_path / "out")).trigger(availableNow=True).start()
    stream.awaitTermination()
    last = stream.lastProgress["batchId"] % 2 if stream.lastProgress["numInputRows"] else (stream.lastProgress["batchId"] + 1) % 2
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "tf").collect()))
    assert rows(store.load(spark, str(tmp_path / f"out/v{last}")).postings) == rows(index.build(songs).postings)


def test_semantic(spark, songs):
    model = semantic.fit(songs, components=2, features=50)
    vectors = [r["vec"] for r in model.vectors(songs.select("id", "letra").toDF("doc_id", "text")).collect()]
    assert all(len(v) == 2 and (abs(sum(x * x for x in v) - 1) < 1e-9 or not any(v)) for v in vectors)
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(semantic.unit(F.col("a")).alias("a"), semantic.unit(F.col("b")).alias("b")).first()
    assert row["a"] == [0.6, 0.8] and row["b"] == [0.0, 0.0]
    assert spark.createDataFrame([("a one",), ("one",)], "t string").select(semantic.ngrams(F.col("t")).alias("g")).first()["g"] == ["one"]


def test_semantic_model(spark, songs):
    model = semantic.fit(songs, components=2, features=50)
    rows = songs.select(F.col("id").alias("doc_id"), corpus.semantic_text().alias("text"))
    x = np.array([r["vec"] for r in semantic.Model(model.idf, None).vectors(rows).collect()])
    axes = np.linalg.eigh(x.T @ x)[1][:, -2:]
    assert np.allclose(axes @ axes.T, model.directions @ model.directions.T)


def test_full_semantic_queries(spark):
    from melisma.plans import catalog

    folder = "/root/testdata/sf0.001"
    assert {len(r["vec"]) for r in catalog.lsa_embed(spark, folder).collect()} == {semantic.COMPONENTS}
    assert any(r["razon"].startswith("semántica") for r in catalog.search_reasons(spark, folder).collect())


def test_merge_and_greedy(spark, songs):
    crawl = spark.createDataFrame([(0, " the WHO sings", "The who"), (1, "New", "N"), (2, "new ", "n"), (3, "", "N"), (4, "New", "Other")], "pos int, titulo string, artista string")
    merged, counts = dedupe.merge(songs, crawl, ["pos"])
    assert {r["status"]: r["n"] for r in counts.collect()} == {"agregada": 2, "duplicada": 2, "omitida": 1}
    assert merged.count() == 6
    chain = spark.createDataFrame([(0, "k1", "1", 0), (1, "k1", "2", 0), (2, "k2", "2", 0)], "pos int, k string, id string, c int")
    kept = dedupe.greedy_first_wins(chain, [["k"], ["id"]], ["pos"]).collect()
    assert sorted(r["pos"] for r in kept) == [0, 2]  # a dropped row blocks none


def test_extractors():
    page = "<html><head><title>Band - Song Lyrics - AZLyrics</title></head><body><div>" + "line\n" * 60 + "<div>inner</div></div></body></html>"
    got = html.extract(page, "https://www.azlyrics.com/x")
    assert (got["artista"], got["titulo"], got["tags"]) == ("Band", "Song", ["azlyrics", "lyrics"]) and got["letra"].startswith("line")
    text = "<meta name=keywords content='a, b,c,d,e,f'><meta name=k content=1><meta name=k content=2><meta name=description content='Art - x'><link rel=canonical href=u>"
    page = f"<head><title>T</title>{text}</head><h1>{'h' * 99}</h1><p>short<p>{'w ' * 80}"
    got = html.extract(page, "http://example.org/")
    assert got["titulo"] == "h" * 99 and got["artista"] == "Art" and got["tags"] == list("abcde") and got["url"] == "u" and len(got["letra"]) > 100
    assert html.extract(page.replace("h" * 99, "h" * 100), "")["titulo"] == "T" and html.meta_map(html.parse(page))["k"] == "2"
    for rule in html.EXTRACTORS.values():
        assert isinstance(rule(html.parse("<h1 class=title>T</h1><a class='artist link--primary' href=/artist/1>A</a>")), dict)
    got = html.genius(html.parse("<h1> T </h1><a class=x-artist-y>A</a><div data-lyrics-container=true><div>v1</div><br><div>v2</div></div><span class=tag>t</span>"))
    assert (got["titulo"], got["artista"], got["letra"], got["tags"]) == ("T", "A", "v1\nv2", ["t"])


def test_crawl(spark):
    link = "<a href='/song/b'>b</a><a href='http://other.net/song/c'>c</a><a href='/plain'>p</a><a href='/song/none'>n</a>"
    page = lambda body, t: f"<title>Art - {t} Lyrics</title>{body}"
    rows = [(1, "http://azlyrics.com/song/a", page(link, "A")), (2, "http://azlyrics.com/song/b", page("", "B")), (3, "http://other.net/song/c", page("", "C")), (4, "x", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    records, visited = frontier.crawl(pages, ["http://azlyrics.com/song/a"])
    assert sorted((r["url"][-1], r["depth"]) for r in visited.collect()) == [("a", 0), ("b", 1)]
    assert {r["record"]["titulo"] for r in records.collect()} == {"A", "B"} and frontier.stats(visited, records).first()["songs"] == 2
    assert frontier.crawl(pages, ["http://azlyrics.com/song/a"], budget=1)[1].count() == 1
    assert not frontier.allowed("User-agent: *\nDisallow: /song", "http://x/song/a") and frontier.allowed(None, "http://x/")


def test_crawl_depth(spark, tmp_path):
    from melisma.plans import catalog

    rows = [(0 if i == 0 else 10 + i, f"http://example.org/p{i}", f"<title>T{i}</title><a href='http://example.org/p{i + 1}'>n</a>") for i in range(6)]
    spark.createDataFrame(rows, "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((r["depth"], r["url"][-1]) for r in catalog.frontier_bfs(spark, str(tmp_path)).collect()) == [(i, str(i)) for i in range(6)]


def test_web(spark):
    reply = {"response": {"hits": [{"result": {"title": t, "primary_artist": {"name": "A"}, "url": "u", "album": None}} for t in ("T", "", "U", "V")]}}
    rows = web.hits(spark.createDataFrame([(0, json.dumps(reply)), (1, "bad")], "query_id int, json string")).collect()
    assert [r["titulo"] for r in rows] == ["T", "U"] and rows[0]["album"] == ""


def test_reasons_and_console(spark, songs):
    found = search.search(index.build(songs), ["the who"], with_similarity=False)
    reasons = {r["doc_id"]: r["razones"] for r in found.collect()}
    assert reasons["1"] == ["2 palabras en título", "2 palabras en artista", "frase exacta en título", "artista completo", "título comienza con 'the'"]
    queries = search.query_table(spark, ["the who"])
    text = {r["doc_id"]: r["text"] for r in search.display_rows(found, songs, queries).collect()}
    lines = text["1"].split("\n")
    assert lines[0].startswith("1. [Relevancia: ") and lines[0].endswith("🎵 The Who Sings") and lines[1] == "   👤 Artista: The Who"
    assert lines[2] == "   📊 Relevancia por: 2 palabras en título, 2 palabras en artista, frase exacta en título" and lines[3] == "   🏷️  Géneros: rock"
    assert search.display_rows(found, songs, queries, min_score=1000.0).count() == 0
    plain = search.display_rows(spark.createDataFrame([(0, "2")], "query_id int, doc_id string"), songs, queries).first()
    assert plain["text"].startswith("1. [Relevancia: 0.00] 🎵 Canción del mar") and "Relevancia por" not in plain["text"]
    detail = {r["doc_id"]: r["text"] for r in search.detail_rows(songs, spark.createDataFrame([("1", "en"), ("2", "xx")], "doc_id string, idioma string")).collect()}
    assert "Idioma detectado: Inglés" in detail["1"] and "detectado: xx" in detail["2"] and "detectado: desconocido" in detail["3"]


def test_console_excerpt(spark):
    text = "a" * 70 + "\nneedle " + "b" * 150
    rows = [(text, "needle"), (text, "abc needle"), (text, "zz yy needle"), ("short", "q"), ("long enough text", "q"), ("", "q")]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, q string").select(search.console_excerpt(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got[0] == "..." + "a" * 49 + " needle " + "b" * 93 + "..." and got[1] == "..." + "a" * 39 + " needle " + "b" * 53 + "..."
    assert got[2] == "a" * 70 + " needle " + "b" * 22 + "..." and got[3:] == [None, "long enough text...", None]


def test_stored_model(spark, songs, tmp_path):
    model = semantic.fit(songs, components=2, features=50)
    rows = songs.select(F.col("id").alias("doc_id"), corpus.semantic_text().alias("text"))
    store.save_model(model, model.vectors(rows), str(tmp_path / "m"))
    again, vectors = store.load_model(spark, str(tmp_path / "m"))
    assert again.idf.keys() == model.idf.keys() and np.allclose(again.directions, model.directions) and vectors.count() == 4
    listed = lambda df: [r["vec"] for r in df.orderBy("doc_id").collect()]
    assert np.allclose(listed(again.vectors(rows)), listed(vectors)) and store.load_model(spark, str(tmp_path / "none")) is None


def test_replies_and_dumps(spark, songs, tmp_path):
    found = search.result_rows(search.search(index.build(songs), ["the who"]), songs, search.query_table(spark, ["the who"]))
    reply = json.loads(store.response(found).first()["json"])
    assert [x["id"] for x in reply] == [r["id"] for r in found.orderBy(F.desc("score")).collect()] and "año" in reply[0]
    path = store.export_crawl(songs, str(tmp_path))
    assert path.rsplit("/", 1)[1].startswith("crawled_songs_2") and spark.read.json(path).count() == 4


def test_add_new(spark, songs):
    found = [(0, 0, "The Who SINGS ", "the who", "u1"), (0, 1, "New", "N", "http://X/1 "), (0, 2, "Other", "O", " HTTP://x/1"), (0, 3, "new", "n", "u3"), (0, 4, "Third", "T", "u3"), (0, 5, "", "A", ""), (0, 6, "", "A", "")]
    rows = spark.createDataFrame(found, "query_id int, pos int, titulo string, artista string, url string")
    got = dedupe.add_new(songs, rows, ["query_id", "pos"], F.lit(1234567))
    assert sorted(r["titulo"] for r in got.collect()) == ["", "", "New", "Third"]  # what a dropped row has in common blocks none
    assert {r["id"] for r in got.where("titulo = 'New'").collect()} == {"new_n_34567"}
    known = songs.withColumn("url", F.lit(" HTTP://x/1"))
    assert "New" not in {r["titulo"] for r in dedupe.add_new(known, rows, ["query_id", "pos"], F.lit(0)).collect()}


def test_search_completed(spark, songs):
    hits = [{"result": {"title": "Zebra", "primary_artist": {"name": "Zed"}, "url": "http://g/z", "album": {"name": "Al"}}}, {"result": {"title": "Zebra two", "primary_artist": {"name": "Zed"}, "url": "http://g/none"}}]
    replies = spark.createDataFrame([(0, json.dumps({"response": {"hits": hits}}))], "query_id int, json string")
    pages = spark.createDataFrame([("http://g/z", "<div data-lyrics-container=true>one<br>two <i>zebra</i></div><div>no</div>")], "url string, html string")
    found, after = web.search_completed(index.build(songs), "zebra", replies, pages, F.lit(5))
    assert {r["doc_id"] for r in found.collect()} == {"zebra_zed_5", "zebra_two_zed_5"} and after.docs.count() == 6
    letra = {r["titulo"]: r["letra"] for r in after.songs.collect()}
    assert letra["Zebra"] == "one\ntwo zebra" and letra["Zebra two"] == html.NO_LYRICS
    same, before = web.search_completed(index.build(songs), "the who", replies, pages, F.lit(5), least=1)
    assert before.docs.count() == 4 and same.count() >= 1


def test_crawl_rules(spark):
    link = lambda *names: "".join(f"<a href='http://azlyrics.com/song/{n}'>x</a>" for n in names)
    many = [f"m{i}" for i in range(12)]
    rows = [("a", link("z", "b", "b", *many), "text/html"), ("z", link("c"), "Text/HTML; charset=utf-8"), ("b", "", "text/html"), ("c", "", "text/html"), ("m0", "", "application/pdf"), ("m1", "", "text/html"), *((n, "", "text/html") for n in many[2:])]
    pages = spark.createDataFrame([(i, f"http://azlyrics.com/song/{n}", h, k) for i, (n, h, k) in enumerate(rows)], "page_id int, url string, html string, content_type string")
    seed = ["http://azlyrics.com/song/a"]
    names = lambda budget, **k: [r["url"].rsplit("/", 1)[1] for r in frontier.crawl(pages, seed, budget, **k)[1].collect()]
    assert sorted(names(1000)) == sorted(["a", "z", "b", "c", *many[1:7]])  # ten links of a page, the repeated one counted twice; m0 is no page
    assert sorted(names(3)) == ["a", "b", "z"]  # in the order of the queue, not of the alphabet
    assert sorted(names(1000, robots={"azlyrics.com": "User-agent: *\nDisallow: /song/z"})) == sorted(["a", "b", *many[1:7]])
    records, done = frontier.crawl(pages, seed)
    assert frontier.stats(done, records, failed=1, queued=2, seconds=3.0).first().asDict() == {"visited": 10, "songs": 0, "queued": 2, "failed": 1, "seconds": 3.0}


def test_generic_rules():
    page = "<title>T</title><h1></h1><meta name=keywords content=' a,, b,c,d,e'>"
    got = html.extract(page, "http://example.org/")
    assert got["titulo"] == "" and got["tags"] == ["a", "", "b", "c", "d"] and html.extract("<title>T</title>", "")["tags"] == []


def test_many_queries(spark, songs, monkeypatch):
    built, asked = index.build(songs), ["the who", "road", "el mar", "canción del mar", " "]
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    whole = rows(search.search(built, asked, min_score=5.0))
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert rows(search.search(built, asked, min_score=5.0)) == whole and len({x[0] for x in whole}) == 4
