"""Page extraction: a small tree over the standard parser, one rule table for each kind of page, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RECORD = pa.struct([("titulo", pa.string()), ("artista", pa.string()), ("letra", pa.string()), ("generos", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("url", pa.string())])
# Fixed value: what stands for lyrics that a page does not have.
NO_LYRICS = "[Letra no disponible]"
RECORD_SQL = "struct<titulo:string,artista:string,letra:string,generos:array<string>,tags:array<string>,url:string>"


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                todo += reversed(node.children)

    def text(self, stripped: bool = True) -> str:
        return "".join(x.strip() if stripped else x for x in self.texts())

    def has_class(self, part: str) -> bool:
        return any(part in x for x in self.attrs.get("class", "").split())


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and self.open[-1].tag == "p":  # a paragraph ends the one before
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def every(root: Node, tag: str, test: Callable[[Node], bool] = lambda n: True) -> list[Node]:
    return [n for n in root.walk() if n.tag == tag and test(n)]


def first_text(root: Node, tag: str, test: Callable[[Node], bool] = lambda n: True) -> str:
    return next((n.text() for n in every(root, tag, test)), "")


def classed(part: str) -> Callable[[Node], bool]:
    return lambda n: n.has_class(part)


def texts(nodes: list[Node]) -> list[str]:
    return [n.text() for n in nodes]


def within(root: Node, tag: str, part: str, inner: str) -> list[str]:
    """Texts of the inner tags in any tag of the class."""
    return [m.text() for n in every(root, tag, classed(part)) for m in every(n, inner)]


def genius(root: Node) -> dict:
    boxes = every(root, "div", lambda n: n.attrs.get("data-lyrics-container") == "true")
    verses = [t for n in (boxes[0].walk() if boxes else ()) if n.tag in ("br", "div") and (t := n.text())]
    return {
        "titulo": first_text(root, "h1"),
        "artista": first_text(root, "a", classed("artist")),
        "letra": "\n".join(verses),
        "generos": texts(every(root, "a", classed("genre"))),
        "tags": texts(every(root, "span", classed("tag"))),
    }


def azlyrics(root: Node) -> dict:
    parts = first_text(root, "title").split(" - ")
    own = next(iter(every(root, "div", classed("lyrics"))), None)
    if own is None:
        own = next((n for n in every(root, "div") if len(t := n.text(False)) > 200 and t.count("\n") > 5), None)
    named = len(parts) >= 2
    return {
        "titulo": parts[1].strip().replace("Lyrics", "").strip() if named else "",
        "artista": parts[0].strip() if named else "",
        "letra": own.text(False).strip() if own else "",
        "tags": ["azlyrics", "lyrics"],
    }


def musixmatch(root: Node) -> dict:
    return {
        "titulo": first_text(root, "h1", classed("title")),
        "artista": first_text(root, "a", classed("artist")),
        "letra": "\n".join(texts(every(root, "p", classed("lyrics")))),
        "generos": within(root, "div", "genres", "a"),
        "tags": ["musixmatch"],
    }


def lastfm(root: Node) -> dict:
    return {
        "titulo": first_text(root, "h1"),
        "artista": first_text(root, "a", classed("link--primary")),
        "generos": texts(every(root, "a", classed("genre")))[:5],
        "tags": [*texts(every(root, "a", classed("tag")))[:10], "lastfm"],
    }


def musicbrainz(root: Node) -> dict:
    return {
        "titulo": first_text(root, "h1"),
        "artista": first_text(root, "a", lambda n: "/artist/" in n.attrs.get("href", "")),
        "generos": within(root, "div", "genre", "a"),
        "tags": [*within(root, "div", "tag", "a"), "musicbrainz"],
    }


def allmusic(root: Node) -> dict:
    return {
        "titulo": first_text(root, "h1", classed("title")),
        "artista": first_text(root, "a", classed("artist")),
        "generos": within(root, "div", "genre", "a"),
        "tags": [*within(root, "div", "styles", "a"), "allmusic"],
    }


def generic(root: Node) -> dict:
    heading = next((n.text() for n in every(root, "h1")), None)  # a blank one replaces the title too
    title = heading if heading is not None and len(heading) < 100 else first_text(root, "title")
    about = next((n.attrs.get("content", "") for n in every(root, "meta") if n.attrs.get("name") == "description"), "")
    canonical = next((n.attrs["href"] for n in every(root, "link") if n.attrs.get("rel") == "canonical" and n.attrs.get("href")), None)
    about_words = next((n.attrs.get("content", "") for n in every(root, "meta") if n.attrs.get("name") == "keywords"), None)
    out = {
        "titulo": title,
        "artista": about.split(" - ")[0].strip() if " - " in about else "",
        "letra": next((t for n in every(root, "p") if len(t := n.text()) > 100), ""),
        "tags": [] if about_words is None else [x.strip() for x in about_words.split(",")[:5]],
    }
    return out | ({"url": canonical} if canonical else {})


#: Rules by domain; FACTORY holds those that dispatch by host uses.
EXTRACTORS = {"genius.com": genius, "azlyrics.com": azlyrics, "musixmatch.com": musixmatch, "last.fm": lastfm, "musicbrainz.org": musicbrainz, "allmusic.com": allmusic}
FACTORY = {"azlyrics.com": azlyrics}


def host(url: str) -> str:
    try:
        return urlparse(url).netloc.lower()
    except ValueError:
        return ""


def meta_map(root: Node) -> dict[str, str]:
    """Content of meta tags by name, else property; the last of a name wins, blanks are left out."""
    named = ((n.attrs.get("name") or n.attrs.get("property"), n.attrs.get("content")) for n in every(root, "meta"))
    return {k: v for k, v in named if k and v}


def extract(html: str | None, url: str, rules: dict[str, Callable] = FACTORY, default: Callable = generic) -> dict:
    """The record of a page; a page that breaks a rule keeps blanks."""
    blank = {"titulo": "", "artista": "", "letra": "", "generos": [], "tags": [], "url": url}
    try:
        rule = next((f for domain, f in rules.items() if domain in host(url)), default)
        return blank | rule(parse(html or ""))
    except (ValueError, IndexError, KeyError, RecursionError):
        return blank


def links(html: str | None, url: str) -> list[str]:
    """Absolute targets of the page's links, in order; repeats stay."""
    out = []
    for n in every(parse(html or ""), "a"):
        if n.attrs.get("href"):
            try:
                out.append(urljoin(url, n.attrs["href"]))
            except ValueError:
                continue
    return out


def scrape(pages: DataFrame, rules: dict[str, Callable] = FACTORY) -> DataFrame:
    """page_id, url, record (titulo, artista, letra, generos, tags, url), meta (map), links (array) of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.as_py(), u.as_py() or "") for x, u in zip(batch.column("html"), batch.column("url"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([extract(h, u, rules) for h, u in found], RECORD),
                    pa.array([list(meta_map(parse(h or "")).items()) for h, _ in found], pa.map_(pa.string(), pa.string())),
                    pa.array([links(h, u) for h, u in found], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "record", "meta", "links"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, record {RECORD_SQL}, meta map<string,string>, links array<string>")


def lyrics(html: str | None) -> str:
    """The lyrics of a song page as the web search takes them: the first container's text with a line for each break."""
    boxes = every(parse(html or ""), "div", lambda n: n.attrs.get("data-lyrics-container") == "true")
    if not boxes:
        return NO_LYRICS
    for n in (boxes[0], *boxes[0].walk()):
        n.children = ["\n" if isinstance(c, Node) and c.tag == "br" else c for c in n.children]
    return boxes[0].text(False).strip()


def with_lyrics(rows: DataFrame) -> DataFrame:
    """rows (..., html) with letra instead of html; a row without a page has the text that says so."""
    names = [c for c in rows.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([lyrics(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "letra"])

    return rows.mapInArrow(run, rows.select(names).withColumn("letra", F.lit("")).schema)


def clean_text(text) -> F.Column:
    """White space as one space; other symbols than word characters and plain marks go."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)[^\w\s\-.,!?áéíóúñÁÉÍÓÚÑ]", "")


def genre_list(text) -> F.Column:
    """Items of a comma list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


