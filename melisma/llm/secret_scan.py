"""Secret scan: three fixed kinds of secret, and strings of high entropy.

Candidates for entropy are runs of token characters of at least MIN_LENGTH outside the fixed kinds. Over each, a
window slides; the entropy of its characters is kept by incremental counts: a character that enters or
leaves changes one count, so one step costs the same at any window size. Windows whose entropy reaches the bound
of their character class, or all of a shorter candidate, become spans. Allow-listed candidates (see ALLOWED)
give none. Fixed spans and candidates are merged in order, so the cost is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
# Searched in texts whose A-Z became a-z; its letters match either case that way.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal, so this finds the runs of HEX that are long enough
LEAST = {"assign": 6, "access": 20, "hex": 24}

MIN_LENGTH, WINDOW = 20, 20
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: (class, what its strings are made of, least bits a character in a window); the first that fits holds.
CLASSES = (
    ("hex", re.compile(rb"[0-9A-Fa-f]+\Z"), 3.0),
    ("base64", re.compile(rb"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).+\Z", re.S), 3.7),
    ("base36", re.compile(rb"(?=(?:[^0-9]*[0-9]){3})(?=.*[a-z])[^A-Z]+\Z", re.S), 3.7),
    ("base32", re.compile(rb"(?=(?:[^0-9]*[0-9]){3})(?=.*[A-Z])[^a-z]+\Z", re.S), 3.6),
    ("letters", re.compile(rb"(?=.*[A-Z])(?=.*[a-z])[^0-9]+\Z", re.S), 4.0),
)
#: A word, also of several capitalised ones, with a short number after it; or a number.
PART = rb"(?:(?:(?:[A-Z]{0,4}[a-z]{2,}+)++|[A-Z]++|[a-z])[0-9]{0,4}+|[0-9]++)"
#: Not secrets: identifiers in the form of five hexadecimal groups; paths, names and dates, that is words and numbers between marks; runs of one character.
ALLOWED = re.compile(
    rb"(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    rb"|[/_=-]*+" + PART + rb"(?:[/_-]++" + PART + rb")*+[/_=-]*+|(.)\1+)\Z"
)


def entropy_runs(token: bytes, bound: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs [start, end) covered by windows of at least `bound` bits a character."""
    size = min(window, len(token))
    term = [0.0, *(c * log2(c) for c in range(1, size + 1))]
    counts, total, runs = [0] * 256, 0.0, []
    for i, c in enumerate(token):
        total += term[counts[c] + 1] - term[counts[c]]
        counts[c] += 1
        if i >= size:
            old = token[i - size]
            counts[old] -= 1
            total += term[counts[old]] - term[counts[old] + 1]
        if i >= size - 1 and log2(size) - total / size >= bound - 1e-9:
            if runs and runs[-1][1] >= i - size + 1:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i - size + 1, i + 1))
    return runs


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.lower()) if len(m[1]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(data)]
    return found


def entropy_spans(data: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of high entropy in what of the candidates is outside the taken spans (sorted by start)."""
    closed: list[list[int]] = []  # the taken spans as disjoint runs
    for a, _, b in taken:
        if closed and a <= closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], b)
        else:
            closed.append([a, b])
    found, k = [], 0
    for m in CANDIDATE.finditer(data):
        while k < len(closed) and closed[k][1] <= m.start():
            k += 1
        at, pieces = m.start(), []
        while k < len(closed) and closed[k][0] < m.end():
            pieces.append((at, closed[k][0]))
            at = closed[k][1]
            if at >= m.end():
                break  # it may reach the next candidate too
            k += 1
        for a, b in (*pieces, (at, m.end())):
            if b - a < MIN_LENGTH or ALLOWED.match(piece := data[a:b]):
                continue
            bound = next((least for _, made_of, least in CLASSES if made_of.match(piece)), None)
            if bound is not None:
                found += [(a + x, 3, a + y) for x, y in entropy_runs(piece, bound)]
    return found


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points, sorted."""
    data = text.encode()
    found = sorted(base_spans(data))
    found += entropy_spans(data, found)
    if found and len(data) != len(text):
        place = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
        found = [(int(place[a]), k, int(place[b])) for a, k, b in found]
    return sorted(found)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points; sorted by start, then kind in the order of KINDS).

    A null text counts as empty and has no spans. Rows alike each get their result; other columns are not read. Texts of
    any length are read whole, in linear time. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in secrets(x.as_py() or "")] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
