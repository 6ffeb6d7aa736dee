"""Near-duplicate embeddings: tiles in order of principal components, compared by leading dimensions first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .graph import components
from .simhash import Forest
from .staging import stage
from .whitening import decompose, decomposed, matrix, usable

#: Distinct vectors that a shard is meant to hold, rows that the shards are laid out by, and of these at least so many in a shard.
SHARD, SAMPLE, LEAST = 4096, 20_000, 8
#: Rows of a tile; dimensions after which products are bounded; dimensions that shards are cut by; visitors compared at a time.
TILE, STEPS, CUT_BY, VISITORS = 512, (16, 32), 16, 4096
#: A ball is taken out of a label if it holds this share of it; of so many sampled rows, centres are tried.
BALL_SHARE, TRIED = 1 / 16, 1024
#: Rounding that bounds allow for: of angles and squared distances, and of products in single precision.
CLOSE, COARSE = 1e-7, 1e-5


def units(vectors: np.ndarray) -> np.ndarray:
    own = vectors.astype(np.float64)
    own = own / np.abs(own).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return own / np.linalg.norm(own, axis=1, keepdims=True)


@dataclass
class Layout:
    """How the vectors of one label are dealt to shards: leaves of a tree of cuts first, then the parts of balls.

    A ball's vectors are within half the threshold's angle of its centre, so all of them are linked; they are never
    compared with each other, and may be dealt to any number of shards.
    """

    angle: float
    cuts: list[tuple[int, float, int, int]] = field(default_factory=list)  # dimension, at, node below, node above; leaves are -1 - shard
    root: int = -1
    leaves: int = 1
    balls: list[tuple[np.ndarray, int, int]] = field(default_factory=list)  # centre, first shard, shards
    first_ball: int = 0

    @staticmethod
    def of(sample: np.ndarray, axes: np.ndarray, rows_each: float, shard: int, angle: float, first_ball: int) -> Layout:
        """sample: unit vectors, each of which stands for rows_each."""
        own, whole = Layout(angle, first_ball=first_ball), len(sample)
        found, inner = [], math.cos(angle / 2 - CLOSE)
        while len(sample) * rows_each > shard:
            tried = sample[:TRIED]
            near = tried @ tried.T >= inner
            best = int(near.sum(axis=1).argmax())
            centre = min((units(tried[near[best]].mean(axis=0)[None])[0], tried[best]), key=lambda c: (sample @ c < inner).sum())
            inside = sample @ centre >= inner
            if inside.sum() < max(LEAST, BALL_SHARE * whole):
                break
            found.append((centre, math.ceil(inside.sum() * rows_each / shard)))
            sample = sample[~inside]
        own.leaves = 0
        own.root = own.split(sample @ axes[:CUT_BY].T, rows_each, shard)
        at = own.leaves
        for centre, parts in found:
            own.balls.append((centre, at, parts))
            at += parts
        return own

    def split(self, leading: np.ndarray, rows_each: float, shard: int) -> int:
        if len(leading) * rows_each > shard and len(leading) >= 2 * LEAST:
            dim = int(leading.std(axis=0).argmax())
            at = float(np.median(leading[:, dim]))
            below = leading[:, dim] <= at
            if LEAST <= below.sum() <= len(below) - LEAST:
                self.cuts.append((dim, at, 0, 0))
                node = len(self.cuts) - 1
                self.cuts[node] = (dim, at, self.split(leading[below], rows_each, shard), self.split(leading[~below], rows_each, shard))
                return node
        self.leaves += 1
        return -self.leaves

    def deal(self, rows: np.ndarray, leading: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, shard, whether it lives there, its ball there or -1): each vector in the shard it lives in, and in all later ones that may hold a link."""
        every = np.arange(len(rows))
        home, ball = np.full(len(rows), -1), np.full(len(rows), -1)
        visits: list[tuple[np.ndarray, np.ndarray]] = []
        to_centre = [rows @ centre for centre, _, _ in self.balls]
        for k, (_, first, parts) in enumerate(self.balls):
            own = (ball < 0) & (to_centre[k] >= math.cos(self.angle / 2 - CLOSE))
            ball[own], home[own] = k, first + nodes[own] % parts
        for k, (_, first, parts) in enumerate(self.balls):
            near = np.flatnonzero((ball < k) & (np.arccos(np.clip(to_centre[k], -1, 1)) <= 1.5 * self.angle + CLOSE))
            visits += [(near, np.full(len(near), first + p)) for p in range(parts)]
        reach, outside = 2 - 2 * math.cos(self.angle) + CLOSE, every[ball < 0]
        todo = [(self.root, outside, np.zeros((len(outside), min(CUT_BY, leading.shape[1]))), np.ones(len(outside), dtype=bool))]
        while todo:  # gaps: squared distances of each vector from a node's box, by dimension
            node, places, gaps, lives = todo.pop()
            if node < 0:
                home[places[lives]] = -1 - node
                visits.append((places[~lives], np.full((~lives).sum(), -1 - node)))
                continue
            dim, at, below, above = self.cuts[node]
            apart = leading[places, dim] - at
            crossed = gaps.copy()
            crossed[:, dim] = np.maximum(gaps[:, dim], apart**2)
            near = crossed.sum(axis=1) <= reach
            for to, inside in ((below, apart <= 0), (above, apart > 0)):
                keep = inside | near
                if keep.any():
                    todo.append((to, places[keep], np.where(inside[:, None], gaps, crossed)[keep], (lives & inside)[keep]))
        place, shard = (np.concatenate(x) for x in zip(*visits, strict=True)) if visits else (every[:0], every[:0])
        later = shard > home[place]  # a pair of shards meets in the later one
        place, shard = place[later], shard[later]
        lives = np.arange(len(rows) + len(place)) < len(rows)
        return np.concatenate([every, place]), np.concatenate([home, shard]), lives, np.concatenate([np.where(ball < 0, -1, ball + self.first_ball), np.full(len(place), -1)])


@dataclass
class Side:
    """Vectors in order of their first component: unit vectors, their components, norms of what follows each step, copies, and nodes."""

    rows: np.ndarray
    leading: np.ndarray
    copies: np.ndarray
    nodes: np.ndarray
    linked: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.leading[:, 0], kind="stable")
        self.rows, self.leading, self.copies, self.nodes = self.rows[order], self.leading[order], self.copies[order], self.nodes[order]
        self.linked = np.zeros(len(order), dtype=np.int64)
        rest = [np.linalg.norm(self.leading[:, k:], axis=1) for k in STEPS]
        self.rest = np.column_stack(rest)
        self.first = np.column_stack([self.leading[:, : STEPS[0]], rest[0]]).astype(np.float32)  # one product: leading dimensions, and the bound of the rest

    def tiles(self) -> list[tuple[slice, np.ndarray, float]]:
        """(rows, centre, greatest angle from the centre)."""
        out = []
        for i in range(0, len(self.rows), TILE):
            own = self.rows[i : i + TILE]
            centre = own.mean(axis=0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > CLOSE else own[0]
            out.append((slice(i, i + len(own)), centre, math.acos(min(1.0, max(-1.0, float((own @ centre).min()))))))
        return out


def reaching(a: Side, i: slice, b: Side, j: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two tiles with a cosine of at least `least`.

    Products of the leading dimensions and of the norms of the rest bound a cosine; what the bound leaves goes on to
    the next dimensions, and what is left after these is computed whole, in double precision.
    """
    x, y = np.nonzero(a.first[i] @ b.first[j].T >= least - COARSE)
    if not len(x):
        return x, y
    if len(x) * 8 > (i.stop - i.start) * (j.stop - j.start):  # much is left: whole products of its rows and columns
        p, q = np.unique(x), np.unique(y)
        x, y = np.nonzero(a.rows[i][p] @ b.rows[j][q].T >= least)
        return p[x] + i.start, q[y] + j.start
    x, y = x + i.start, y + j.start
    found = np.zeros(len(x))
    for k, (start, stop) in enumerate(zip((0, *STEPS), STEPS, strict=False)):
        found += np.einsum("ij,ij->i", a.leading[x, start:stop], b.leading[y, start:stop])
        keep = found + a.rest[x, k] * b.rest[y, k] >= least - CLOSE
        x, y, found = x[keep], y[keep], found[keep]
    keep = np.einsum("ij,ij->i", a.rows[x], b.rows[y]) >= least
    return x[keep], y[keep]


class Shard:
    """The vectors that live in a shard, and the links of these with each other and with visitors."""

    def __init__(self, home: Side, ball: bool, least: float) -> None:
        self.home, self.least, self.angle = home, least, math.acos(least)
        self.forest, self.tiles = Forest(len(home.rows)), home.tiles()
        self.compared = 0
        if not ball:
            self.meet(home, self.tiles)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.forest.roots(a), self.forest.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            for k in np.unique(a, return_index=True)[1].tolist():
                self.forest.join(int(a[k]), int(b[k]))

    def meet(self, other: Side, tiles: list) -> np.ndarray:
        """Links of a side with those that live here; of each of its rows, one of these that it is linked with, or -1."""
        reach, home = math.sqrt(2 - 2 * self.least) + CLOSE, self.home
        anchor = np.full(len(other.rows), -1)
        for i, centre, wide in tiles:
            for j, to_centre, to_wide in self.tiles:
                if other is home and j.start < i.start or home.leading[j.stop - 1, 0] < other.leading[i.start, 0] - reach:
                    continue
                if home.leading[j.start, 0] > other.leading[i.stop - 1, 0] + reach:
                    break
                between = math.acos(min(1.0, max(-1.0, float(centre @ to_centre))))
                if between - wide - to_wide > self.angle + CLOSE:
                    continue
                if between + wide + to_wide < self.angle - CLOSE:  # every pair is linked
                    x, y = np.arange(i.start, i.stop), np.arange(j.start, j.stop)
                    if other is home and i == j:
                        home.linked[i] += home.copies[i].sum() - home.copies[i]
                    else:
                        other.linked[i] += home.copies[j].sum()
                        home.linked[j] += other.copies[i].sum()
                    x, y = np.concatenate([x, np.full(len(y) - 1, x[0])]), np.concatenate([np.full(len(x), y[0]), y[1:]])  # enough of the links to connect them
                else:
                    self.compared += (i.stop - i.start) * (j.stop - j.start)
                    x, y = reaching(other, i, home, j, self.least)
                    if other is home and i == j:
                        x, y = x[x < y], y[x < y]
                    other.linked += np.bincount(x, home.copies[y], len(other.rows)).astype(np.int64)
                    home.linked += np.bincount(y, other.copies[x], len(home.rows)).astype(np.int64)
                if other is home:
                    self.unite(x, y)
                elif len(x):
                    seen, at = np.unique(x, return_index=True)
                    new = anchor[seen] < 0
                    anchor[seen[new]] = y[at[new]]
                    self.unite(y, anchor[x])
        return anchor


RESULT = "node long, linked long, root long, copies long, ball int"


def solved(axes: np.ndarray, least: float):
    """(node, linked, root, copies, ball): what vectors find in a shard; rows come by shard, those that live there first."""

    def side(held: list[pa.RecordBatch]) -> Side:
        table = pa.Table.from_batches(held)
        rows = units(matrix(table.column("v").combine_chunks()))
        return Side(rows, rows @ axes.T, table.column("copies").to_numpy(), table.column("node").to_numpy())

    def rows(nodes, linked, roots, copies, balls) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((nodes, linked, roots, copies, balls), (pa.int64(),) * 4 + (pa.int32(),), strict=True)], names=["node", "linked", "root", "copies", "ball"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, held, n, ball = None, None, [], 0, -1

        def visited() -> Iterator[pa.RecordBatch]:
            """Settle what is held: first those that live here, then visitors, a block at a time."""
            nonlocal shard, held, n
            if held and shard is None:
                shard = Shard(side(held), ball >= 0, least)
            elif held:
                other = side(held)
                anchor = shard.meet(other, other.tiles())
                some = np.flatnonzero(anchor >= 0)
                if len(some):
                    yield rows(other.nodes[some], other.linked[some], shard.home.nodes[anchor[some]], other.copies[some], np.full(len(some), -1))
            held, n = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            yield from visited()
            if shard is not None:
                home = shard.home
                some = np.flatnonzero((home.linked > 0) | (ball >= 0))
                roots = shard.forest.roots(np.arange(len(home.nodes)))
                yield rows(home.nodes[some], home.linked[some], home.nodes[roots[some]], home.copies[some], np.full(len(some), ball))
            shard = None

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("label", "size", "shard")), strict=True))
            lives, balls = batch.column("lives").to_pylist(), batch.column("ball").to_pylist()
            start = 0
            for i in range(batch.num_rows + 1):
                end = i == batch.num_rows
                if not end and (keys[i], lives[i]) == (key, living if key is not None else None) and (lives[i] or n + i - start < VISITORS):
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                    n += i - start
                start = i
                if end:
                    break
                if keys[i] != key:
                    yield from closed()
                    key, ball = keys[i], balls[i]
                else:
                    yield from visited()
                living = lives[i]
        yield from closed()

    return run


def dealt(layouts: dict, axes: np.ndarray):
    """Classes (label, size, node, copies, v) with shard, lives and ball, in every shard that they live in or visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                labels = pc.dictionary_encode(batch.column("label"))
                names, codes, sizes = labels.dictionary.to_pylist(), labels.indices.to_numpy(), batch.column("size").to_numpy()
                rows, nodes = units(matrix(batch.column("v"))), batch.column("node").to_numpy()
                leading = rows @ axes[:CUT_BY].T
                for code, size in {*zip(codes.tolist(), sizes.tolist(), strict=True)}:
                    own = np.flatnonzero((codes == code) & (sizes == size))
                    layout = layouts.get((names[code], size))
                    if layout is None:
                        place, shard, lives, ball = np.arange(len(own)), np.zeros(len(own), dtype=int), np.ones(len(own), dtype=bool), np.full(len(own), -1)
                    else:
                        place, shard, lives, ball = layout.deal(rows[own], leading[own], nodes[own])
                    found = batch.take(pa.array(own[place]))
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(shard, pa.int32()), pa.array(lives), pa.array(ball, pa.int32())], names=[*found.schema.names, "shard", "lives", "ball"])

    return run


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Directions of unit vectors by falling sum of squares, from the merged decompositions of all of them."""
    every = decompose(vectors, units)
    return decomposed(np.vstack([every.weighed, np.sqrt(every.n) * every.mean]))[1]


def links(classes: DataFrame, least: float, shard: int = SHARD) -> DataFrame:
    """(node, linked, root, copies, ball) of classes (label, size, node, copies, v): counts and edges of each vector, in parts to be summed."""
    spark, seed = classes.sparkSession, 2**20
    axes = principal_axes(classes.select("v"))
    share = min(1.0, SAMPLE / classes.count())
    sample = classes.where(F.pmod(F.xxhash64("node"), F.lit(seed)) < math.ceil(share * seed)).select("label", "size", "v").toArrow()
    by: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(sample.column("label").to_pylist(), sample.column("size").to_pylist(), strict=True)):
        by.setdefault(key, []).append(i)
    layouts, first_ball = {}, 0
    for key, places in by.items():
        if len(places) / share > shard:
            rows = units(matrix(sample.column("v").take(pa.array(places)).combine_chunks()))
            layouts[key] = Layout.of(rows, axes, 1 / share, shard, math.acos(least), first_ball)
            first_ball += len(layouts[key].balls)
    shards = sum(x.leaves + sum(b[2] for b in x.balls) for x in layouts.values())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    met = classes.mapInArrow(dealt(layouts, axes), f"{kinds}, shard int, lives boolean, ball int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    met = met.repartition(parts, "label", "size", "shard").sortWithinPartitions("label", "size", "shard", F.desc("lives"), "node")
    return met.mapInArrow(solved(axes, least), RESULT)


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """id, n_links, component_id, kept: one row per row of the table; vectors are linked if their labels are equal and their cosine is at least `least`.

    n_links counts other rows linked directly; component_id is the least id reachable by links, kept whether it is the
    row's own. A row links with nothing, and is its own component, if its label is null, or its vector is null, zero, or
    holds null or non-finite entries; vectors of different lengths are not linked. Equal vectors of a label are compared
    once and stand for all their rows, each of which counts. Null ids are never the least; a component of null ids only has a
    null id, and a row with a null id is not kept. Other columns are not read. An empty table gives an empty result.
    """
    element = rows.schema[vector_col].dataType.elementType
    v = F.col(vector_col) if isinstance(element, FloatType) else F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    linkable = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda c: c != 0)
    own = own.withColumn("linkable", F.coalesce(linkable, F.lit(False)))
    alike = own.where("linkable").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = stage(alike.select("label", "v", F.size("v").alias("size"), "least", "copies", F.monotonically_increasing_id().alias("node")), "classes")
    bounds = classes.agg(F.min("size").alias("a"), F.max("size").alias("z")).first()
    alone = own.where("NOT linkable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if bounds["z"] is None:
        return finished(alone, id_col)
    same = F.col("v") if bounds["a"] == bounds["z"] else F.concat("v", F.array_repeat(F.lit(0).cast(classes.schema["v"].dataType.elementType), F.lit(bounds["z"]) - F.col("size")))
    found = stage(links(classes.select("label", "size", "node", "copies", same.alias("v")), least, shard), "links")
    balls = found.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("within"), F.min("node").alias("first"))
    in_ball = found.where("ball >= 0").join(balls, "ball")
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(in_ball.select(F.col("node").alias("u"), F.col("first").alias("v")))
    linked = found.select("node", "linked").unionByName(in_ball.select("node", (F.col("within") - F.col("copies")).alias("linked"))).groupBy("node").agg(F.sum("linked").alias("linked"))
    named = classes.drop("size").join(linked, "node", "left").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least_of, "root").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    together = own.where("linkable").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    return finished(together.unionByName(alone), id_col)


def finished(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
