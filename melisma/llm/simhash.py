"""SimHash near-duplicates by exact Hamming search in vantage-point trees.

The 64 bits are cut into BLOCKS parts. Two fingerprints at most `radius` bits apart differ in at most
`radius // BLOCKS` bits of some part, which is their `reach` there. For each part a vantage-point tree is laid over all
fingerprints: a node's vantage point and the median distance from it, in bits of the part, send a fingerprint to the
near or the far side. The leaves of its upper levels are the shards. A fingerprint lives in one shard of each
part; where it stands within `reach` of a boundary, a neighbour may be on the other side (triangle inequality), so it
also visits that side's shards as a query. Within a shard the tree goes on, down to small leaves, by the same
two rules. Pairs that meet in a leaf are tested on all 64 bits.

The upper levels are laid out by a sample of at most SAMPLE fingerprints, which decides who is compared where but not what is
found. A fingerprint visits about (n / SHARD) ** 0.47 shards of a part. A shard gives a spanning forest
of its links, not all pairs; the global components come from those edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .graph import components
from .staging import stage

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
BLOCKS, LEAF = 3, 64
#: Of a set that is alike in its part of the bits: fingerprints that are compared all with all, and parts of the other bits.
DENSE, PARTS = 512, 6
#: Fingerprints that live in a shard, about; fingerprints that lay out the trees, at most.
SHARD, SAMPLE = 4096, 8192


def fingerprint(text: str, shingle: int) -> int:
    """Bit by bit, what over half of the shingles' hashes have; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or "", shingle) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union of places."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        out = self.up[places]
        while True:
            above = self.up[out]
            if (above == out).all():
                self.up[places] = out
                return out
            out = above

    def join(self, a: int, b: int) -> bool:
        a, b = (int(x) for x in self.roots(np.array([a, b])))
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def block_masks(radius: int) -> tuple[np.ndarray, int]:
    """The bits of each part, and how far two linked fingerprints can be apart in one of them."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return np.array([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.uint64), radius // BLOCKS


class Tree:
    """All links of a set of distinct fingerprints within a radius that are near in the masked bits, as the edges of a spanning forest."""

    def __init__(self, prints: np.ndarray, radius: int, mask: int = (1 << 64) - 1, reach: int | None = None) -> None:
        self.prints, self.radius, self.reach = prints, radius, radius if reach is None else reach
        self.masked = prints & np.uint64(mask)
        self.forest, self.edges, self.splits, self.tested = Forest(len(prints)), [], 0, 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare two leaves, or bounded blocks of places; a set with itself once for each pair."""
        for i in range(0, len(a), 512):
            some, rest = a[i : i + 512], b[i:] if a is b else b
            self.tested += len(some) * len(rest)
            x, y = np.nonzero(distance(self.prints[some, None], self.prints[None, rest]) <= self.radius)
            p, q = some[x], rest[y]
            new = self.forest.roots(p) != self.forest.roots(q)
            if new.any():  # one pair for each two trees of the forest that it joins
                p, q = p[new], q[new]
                ends = np.sort(np.stack([self.forest.roots(p), self.forest.roots(q)]), axis=0)
                for k in np.unique(ends, axis=1, return_index=True)[1].tolist():
                    if self.forest.join(int(p[k]), int(q[k])):
                        self.edges.append((int(p[k]), int(q[k])))

    def alike(self, places: np.ndarray, bits: list[int] | None = None) -> None:
        """Links in a set that trees can't split, as its masked bits are equal: of the other bits, cut into PARTS, two linked fingerprints have all but radius parts equal."""
        if bits is None:
            bits = [b for b in range(64) if len(np.unique(self.prints[places] >> np.uint64(b) & np.uint64(1))) > 1]
        if len(places) <= DENSE or len(bits) < PARTS or self.radius >= PARTS:
            self.link(places, places)
            return
        self.splits += 1
        for equal in combinations(range(PARTS), PARTS - self.radius):
            held = [b for i in equal for b in bits[i::PARTS]]
            key = self.prints[places] & np.uint64(sum(1 << b for b in held))
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                if j - i > 1:
                    self.alike(places[order[i:j]], [b for b in bits if b not in held])

    def far(self, places: np.ndarray, vantage: int) -> np.ndarray:
        return distance(self.masked[places], self.masked[vantage]).astype(np.int64)

    def within(self, places: np.ndarray) -> None:
        todo = [places]
        while todo:
            places = todo.pop()
            if len(places) <= LEAF:
                self.link(places, places)
                continue
            far = self.far(places, places[0])
            middle = int(np.median(far))
            near = far <= middle
            if near.all():  # the median is the greatest distance
                middle -= 1
                near = far <= middle
            if not near.any() or near.all():
                self.alike(places)
                continue
            self.splits += 1
            todo += [places[near], places[~near]]
            self.across(places[near & (far > middle - self.reach)], places[~near & (far <= middle + self.reach)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between two sets of places."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not len(a) or not len(b):
                continue
            if min(len(a), len(b)) <= LEAF:
                self.link(a, b)
                continue
            da, db = self.far(a, a[0]), self.far(b, a[0])
            middle = int(np.median(da))
            left = da <= middle
            if left.all():
                middle -= 1
                left = da <= middle
            parts = [(a[left], b[db <= middle + self.reach]), (a[~left], b[db > middle - self.reach])]
            if (da == 0).all() and (db == 0).all():
                self.alike(np.concatenate([a, b]))
            elif left.all() or not left.any() or sum(len(x) * len(y) for x, y in parts) > 0.95 * len(a) * len(b):
                self.link(a, b)
            else:
                self.splits += 1
                todo += parts


class Layout:
    """The upper levels of one part's tree: node k has the children 2k (near) and 2k + 1 (far)."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, levels: int) -> None:
        self.mask, self.levels = mask, levels
        nodes = 1 << levels
        self.vantage = mix(np.arange(nodes, dtype=np.uint64) + mask)  # of nodes without a sample
        self.middle = np.full(nodes, int(mask).bit_count() // 2, dtype=np.int64)
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(levels):
            for k in range(1 << level, 2 << level):
                own = sample[node == k]
                if len(own):
                    self.vantage[k] = own[0]
                    self.middle[k] = int(np.median(distance(own & mask, own[0] & mask)))
            node = 2 * node + (self.far(sample, node) > self.middle[node])

    def far(self, prints: np.ndarray, node: np.ndarray) -> np.ndarray:
        return distance(prints & self.mask, self.vantage[node] & self.mask).astype(np.int64)

    def shards(self, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, shard, whether the fingerprint lives there) of all shards that prints live in or visit."""
        place, node, lives = np.arange(len(prints)), np.ones(len(prints), dtype=np.int64), np.ones(len(prints), dtype=bool)
        for _ in range(self.levels):
            far, middle = self.far(prints[place], node), self.middle[node]
            home = far > middle  # 1 is the far side
            both = np.flatnonzero((far > middle - reach) & (far <= middle + reach))
            place, node, lives = (
                np.concatenate([place, place[both]]),
                np.concatenate([2 * node + home, 2 * node[both] + ~home[both]]),
                np.concatenate([lives, np.zeros(len(both), dtype=bool)]),
            )
        return place, node, lives


def dealt(layouts: list[Layout], reach: int):
    """(block, shard, lives, fp) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 2048):
                prints = every[i : i + 2048]
                for k, layout in enumerate(layouts):
                    place, shard, lives = layout.shards(prints, reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), k, dtype=np.int32)), pa.array(shard), pa.array(lives), pa.array(prints[place].view(np.int64))], names=["block", "shard", "lives", "fp"]
                    )

    return run


def shard_links(radius: int):
    """Edges (u, v) of spanning forests of the shards; rows come sorted by block and shard."""
    parts, reach = block_masks(radius)

    def solve(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        prints, lives = (np.concatenate(x) for x in zip(*held, strict=True))
        tree = Tree(prints.view(np.uint64), radius, int(parts[block]), reach)
        own = np.flatnonzero(lives)
        tree.within(own)
        tree.across(own, np.flatnonzero(~lives))
        return [(int(prints[a]), int(prints[b])) for a, b in tree.edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, edges = None, [], []
        for batch in batches:
            block, shard, lives, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "shard", "lives", "fp"))
            heads = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (shard[1:] != shard[:-1])])) if len(shard) else []
            for a, b in zip(heads, [*heads[1:], len(shard)], strict=True):
                if (block[a], shard[a]) != open_key:
                    edges += solve(open_key[0], held) if held else []
                    open_key, held = (block[a], shard[a]), []
                held.append((prints[a:b], lives[a:b]))
            if len(edges) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["u", "v"])
                edges = []
        edges += solve(open_key[0], held) if held else []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["u", "v"])

    return run


def shards_of(prints: DataFrame, radius: int) -> DataFrame:
    """(block, shard, lives, fp) of fingerprints (column fp, distinct), each in all shards that it lives in or visits."""
    parts, reach = block_masks(radius)
    levels = max((prints.count() - 1) // SHARD, 0).bit_length()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if levels else []
    sample = np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64)
    return prints.select("fp").mapInArrow(dealt([Layout(sample, m, levels) for m in parts], reach), "block int, shard long, lives boolean, fp long")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): edges that connect all fingerprints (column fp, distinct) within the radius of each other."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = shards_of(prints, radius).repartition(parts, "block", "shard").sortWithinPartitions("block", "shard")
    return met.mapInArrow(shard_links(radius), "u long, v long")


def rooted(classes: DataFrame, radius: int) -> DataFrame:
    """classes (fp, ...; staged, fp distinct) with root, which is the same for all fingerprints that any chain of links joins."""
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs; component_id is the least doc_id linked by any chain.

    Two rows are linked if their fingerprints differ in at most `radius` bits. Texts without words (null or
    empty) have fingerprint 0 and are linked like any other; texts under `shingle` words are one shingle. Rows alike
    are linked, being copies. A null doc_id keeps its row; a component of null ids only has a null id. Texts of any length
    are read whole. Other columns are not read. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    classes = rooted(classes, radius)
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
