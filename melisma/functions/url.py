"""References of pages resolved against their addresses, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Schemes whose references are resolved, after which anything else stays as it is.
RELATIVE = ["", *"ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtsps rtspu sftp svn svn+ssh ws wss".split()]
#: Schemes whose paths may end in parameters.
WITH_PARAMS = ["", *"ftp hdl prospero http imap https shttp rtsp rtsps rtspu sip sips mms sftp tel".split()]
#: scheme, authority, path, query, fragment.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: What a path is before the parameters of its last part.
PATH = r"(?s)^((?:[^/]*/)*[^/;]*)"


def cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split(url: Column, other: Column | None = None) -> Column:
    """The parts of an address as a struct, blank where it has none; path is without params. other: the scheme of one that has none."""
    part = lambda i: F.regexp_extract(url, PARTS, i)
    own = F.lower(part(1))
    scheme = own if other is None else F.when(own != "", own).otherwise(other)
    path = F.when(scheme.isin(WITH_PARAMS), F.regexp_extract(part(3), PATH, 1)).otherwise(part(3))
    return F.struct(scheme.alias("scheme"), part(2).alias("netloc"), path.alias("path"), F.substr(part(3), F.length(path) + 2).alias("params"), part(4).alias("query"), part(5).alias("fragment"))


def put_together(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    """An address of its parts; empty queries and fragments leave no mark."""
    after = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise(F.lit(""))
    body = F.concat(path, after(";", params))
    rooted = F.when((body != "") & ~F.startswith(body, F.lit("/")), F.concat(F.lit("/"), body)).otherwise(body)
    bare = F.startswith(body, F.lit("//")) | ((scheme != "") & ((body == "") | F.startswith(body, F.lit("/"))))
    body = F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).when(bare, F.concat(F.lit("//"), body)).otherwise(body)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body, after("?", query), after("#", fragment))


def without_dots(base: Column, path: Column) -> Column:
    """A reference's path on top of the folder of a base path, dots folded in."""
    own = F.split(path, "/")

    def below(parts: Column) -> Column:
        folder = F.when(F.element_at(parts, -1) != "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        every = F.concat(folder, own)
        inner = F.filter(F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0))), lambda x: x != "")
        return F.when(F.size(every) > 2, F.concat(F.slice(every, 1, 1), inner, F.slice(every, -1, 1))).otherwise(every)

    def folded(parts: Column) -> Column:
        step = lambda at, x: F.when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(x == ".", at).otherwise(F.concat(at, F.array(x)))
        whole = F.aggregate(parts, F.array().cast("array<string>"), step)
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(whole, F.array(F.lit("")))).otherwise(whole)
        return F.coalesce(F.nullif(F.array_join(ends, "/"), F.lit("")), F.lit("/"))

    return F.when(F.startswith(path, F.lit("/")), let(own, folded)).otherwise(let(let(F.split(base, "/"), below), folded))


def join(base: Column, reference: Column) -> Column:
    """The address that a reference means on a page; null for one that is none, as with a bracket alone. A blank base or reference leaves the other."""

    def resolved(b: Column, r: Column) -> Column:
        scheme = r["scheme"]
        bracket = lambda x: F.contains(x["netloc"], F.lit("[")) != F.contains(x["netloc"], F.lit("]"))
        same = (r["path"] == "") & (r["params"] == "")
        query = F.when(r["query"] != "", r["query"]).otherwise(b["query"])
        return (
            F.when(bracket(b) | bracket(r), F.lit(None).cast("string"))
            .when((scheme != b["scheme"]) | ~scheme.isin(RELATIVE), reference)
            .when(r["netloc"] != "", put_together(scheme, r["netloc"], r["path"], r["params"], r["query"], r["fragment"]))
            .when(same, put_together(scheme, b["netloc"], b["path"], b["params"], query, r["fragment"]))
            .otherwise(put_together(scheme, b["netloc"], without_dots(b["path"], r["path"]), r["params"], r["query"], r["fragment"]))
        )

    found = let(split(cleaned(base)), lambda b: let(split(cleaned(reference), b["scheme"]), lambda r: resolved(b, r)))
    return F.when(F.coalesce(base, F.lit("")) == "", reference).when(F.coalesce(reference, F.lit("")) == "", base).otherwise(found)
