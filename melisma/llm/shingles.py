"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands propose, the exact sets decide.

1. A text's set of shingles gives a signature of BANDS * ROWS least hashes; texts of equal sets are one class.
2. Classes that agree in a whole band are candidates. A pair of similarity s agrees in none of the bands with
   probability (1 - s**ROWS) ** BANDS, for independent hashes: under 5e-7 at 0.8, under 1e-15 from 0.9.
3. The candidates' components are found without gathering them; each is given whole to one task, which compares
   the exact sets of its classes and splits it into the components of the pairs that are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Rolling, Texts, chunks, mix, word_codes
from .graph import components
from .staging import keyed, same_row, stage

FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
BANDS, ROWS = 48, 6
FACTORS = np.random.default_rng(42).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
#: The least similarity of a linked pair, as a fraction.
SIMILAR = (4, 5)


def sets(text: Texts, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted; a text under `width` words is one shingle."""
    start, end, bound = text.words()
    rolling = Rolling(word_codes(text, start, end, FOLD))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        first = np.arange(a, max(b - width + 1, min(a + 1, b)))
        out.append(np.unique(rolling.slices(first, np.minimum(first + width, b))))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        least = np.minimum(least, (FACTORS[:, None] * short[None, i : i + 1024]).min(axis=1))
    return least


def sketch(width: int):
    """did, th, class (hash of the set), bands (a key for each; none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in chunks(batch.column("text")):
                found = sets(text, width)
                signed = np.array([signature(x) if len(x) else np.zeros(len(FACTORS), dtype=np.uint32) for x in found], dtype=np.uint32)
                parts = signed.view(np.uint64).reshape(len(found), BANDS, ROWS // 2)
                keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(found), BANDS))
                for k in range(ROWS // 2):
                    keys = mix(keys ^ parts[:, :, k])
                worded = np.array([len(x) > 0 for x in found])
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(worded * BANDS)]), pa.int32()), pa.array(keys[worded].ravel().view(np.int64)))
                classes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)
                rows = slice(text.first_row, text.first_row + text.rows)
                did, th = (batch.column(k)[rows] for k in ("did", "th"))
                yield pa.RecordBatch.from_arrays([did, th, pa.array(classes), bands], names=["did", "th", "class", "bands"])

    return run


def similar(found: list[np.ndarray]) -> list[int]:
    """For each set the first set of its component; pairs of at least SIMILAR are linked."""
    part, whole = SIMILAR
    sizes = np.array([len(x) for x in found])
    values, ids = np.unique(np.concatenate(found), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), dtype=np.int64)
    root, left = list(range(len(found))), np.arange(len(found))
    while len(left):
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            x = todo.pop()
            near = left[(whole * sizes[left] >= part * sizes[x]) & (whole * sizes[x] >= part * sizes[left])]
            if not len(near):
                continue
            mark[ids[x]] = 1
            shared = np.add.reduceat(mark[np.concatenate([ids[i] for i in near.tolist()])], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[ids[x]] = 0
            near = near[whole * shared >= part * (sizes[x] + sizes[near] - shared)]
            for i in near.tolist():
                root[i] = first
            todo += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return root


def confirm(width: int):
    """(class, root) of each class of a candidate component; rows come sorted by component."""

    def solve(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        names = list(held)
        return [(names[i], names[r]) for i, r in enumerate(similar(list(held.values())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["class", "root"])

        group, held, out = None, {}, []
        for batch in batches:
            groups, names = (batch.column(k).to_pylist() for k in ("group", "class"))
            for text in chunks(batch.column("text")):
                for i, found in enumerate(sets(text, width), text.first_row):
                    if groups[i] != group:
                        out += solve(held) if held else []
                        group, held = groups[i], {}
                    held[names[i]] = found
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        out += solve(held) if held else []
        if out:
            yield batch_of(out)

    return run


def alike(classes: DataFrame, key: str) -> DataFrame:
    """Edges (u, v) that connect the classes of each key: every other class with the least. classes: (class, key)."""
    least = classes.groupBy(key).agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1").select(key, "least")
    return classes.join(least, key).where("class <> least").select(F.col("class").alias("u"), F.col("least").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", proposed: DataFrame | None = None) -> DataFrame:
    """did, th (see staging.keyed), component: one row per row of docs; component is the same for all that any chain of links joins.

    Two rows are linked if the Jaccard similarity of their sets of `shingle` words is SIMILAR or more; words are split
    at white space and A-Z count as a-z. Texts without words (null or empty) are linked with each other only; a text
    under `shingle` words is one shingle. Ids do not matter, null or repeated. Other columns are not read.
    proposed: (th, group), texts that another method takes for near copies of each other; they are candidates too.
    """
    rows = keyed(docs, id_col, text_col).drop("doc_id")
    sketched = stage(rows.mapInArrow(sketch(shingle), "did long, th long, class long, bands array<long>"), "sketches")
    classes = sketched.dropDuplicates(["class"]).select("class", F.explode("bands").alias("key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = classes.repartition(parts, "key")
    edges = alike(met, "key")
    if proposed is not None:
        edges = edges.unionByName(alike(sketched.select("th", "class").distinct().join(proposed, "th").select("class", "group").distinct(), "group"))
    groups = components(edges).select(F.col("node").alias("class"), F.col("root").alias("group"))
    one = sketched.groupBy("class").agg(F.min(F.struct("did", "th")).alias("at")).join(groups, "class").select("at.did", "at.th", "class", "group")
    texts = rows.alias("l").join(one.alias("r"), same_row()).select("group", "class", "text")
    roots = texts.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(confirm(shingle), "class long, root long")
    return sketched.select("did", "th", "class").join(stage(roots, "roots"), "class", "left").select("did", "th", F.coalesce("root", "class").alias("component"))
