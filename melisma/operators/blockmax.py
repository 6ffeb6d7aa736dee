"""Top results from postings in blocks: each block knows its greatest tf part, so blocks that cannot reach the top are not scored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melisma.sources.staging import stage

from .index import Index, average_length
from .passes import Codes, Sums, parts, passed, whole_queries
from .search import B, K1, ranked, term_part, weighed

#: Documents of a block; a power of two, so that no block spans two partitions.
BLOCK = 64
#: Rounding of scores that ties are made by.
TIE = 1e-5
#: Queries that one pass over the documents takes; blocks whose bounds are made at a time.
PASS, BLOCKS = 16_384, 32


@dataclass(frozen=True)
class Blocks:
    """postings (term, block, most, entries): the tf parts of a term in a block of documents, and the greatest of them. The index that they are of."""

    index: Index
    postings: DataFrame


def blocks(index: Index, size: int = BLOCK) -> Blocks:
    """Blocks of at most `size` documents of like length, as the length is what the parts of a term differ by most.

    Blocks are dealt by ranges of length, so no task orders all documents; a block's entries are bounded by its size.
    """
    placed = index.docs.select("doc_id", "doc_len").repartitionByRange("doc_len", "doc_id").sortWithinPartitions("doc_len", "doc_id")
    placed = stage(placed.select("doc_id", F.floor(F.monotonically_increasing_id() / size).alias("block")), "blocks")
    rows = index.search.join(placed, "doc_id").join(F.broadcast(average_length(index.docs)))
    rows = rows.select("term", "block", "doc_id", term_part().alias("part"))
    found = rows.groupBy("term", "block").agg(F.max("part").alias("most"), F.collect_list(F.struct("doc_id", "part")).alias("entries"))
    return Blocks(index, stage(found.sortWithinPartitions("term"), "block-postings"))


def bounded(found: Blocks, wanted: DataFrame) -> DataFrame:
    """(query_id, block, bound): what a document of a block can score at most, for the blocks that hold any term of a query."""
    return found.postings.select("term", "block", "most").join(wanted, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))


def scored(found: Blocks, wanted: DataFrame, opened: DataFrame) -> DataFrame:
    """(query_id, doc_id, bm25) of the documents in opened blocks (query_id, block)."""
    rows = found.postings.join(wanted.join(opened.select("query_id", "block"), "query_id"), ["term", "block"])
    return rows.select("query_id", "idf", F.inline("entries")).groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("part")).alias("bm25"))


@dataclass(frozen=True)
class Top:
    """rows (query_id, doc_id, score, rank), and the blocks (query_id, block, bound) that were opened of all with any term."""

    rows: DataFrame
    opened: DataFrame
    bounds: DataFrame


def top(found: Blocks, queries: DataFrame, most: int, digits: int = 6) -> Top:
    """The best documents of each query (query_id, q) by BM25, rounded; ties by doc_id. Equal to ranking all scores.

    The blocks of greatest bound are scored first, as many as results are asked for, each of which has a result at least.
    The least of the best so far is a threshold: of the other blocks only those whose bound reaches it are scored.
    """
    wanted = stage(weighed(found.index, queries), "weighed")
    bounds = stage(bounded(found, wanted), "bounds")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = stage(bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n"), "first-blocks")
    early = stage(scored(found, wanted, first), "first-scores")
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
    least = early.withColumn("n", F.row_number().over(best)).where(F.col("n") == most).select("query_id", F.col("bm25").alias("least"))
    reaching = bounds.join(least, "query_id").where(F.col("bound") >= F.col("least") - TIE).drop("least")  # without that many results, all blocks are open
    late = reaching.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    late = stage(late, "late-blocks")
    every = early.unionByName(scored(found, wanted, late))
    rows = ranked(every.select("query_id", "doc_id", F.round("bm25", digits).alias("score")), most)
    return Top(rows, first.unionByName(late), bounds)


class Asked:
    """A pass of queries (query_id, terms), and the best documents of each among those of a task."""

    def __init__(self, rows: list, most: int, average: float) -> None:
        self.ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        self.terms = Codes({x["term"] for r in rows for x in r["terms"]})
        self.sums = Sums([[(self.terms.code[x["term"]], x["idf"]) for x in r["terms"]] for r in rows])
        self.most, self.average, self.opened = most, average, 0

    def __call__(self, batches):
        """(query_id, doc_id, bm25) of a task's documents (doc_id, doc_len, terms) that can be among the best of a query.

        Documents of like length are a block. A block is scored for the queries only whose bound in it, by the greatest part of
        each term, reaches the best so far.
        """
        import pyarrow as pa

        best = np.zeros((len(self.ids), self.most))  # the first of each is the least; documents without its terms have 0
        values = np.zeros((len(self.terms), BLOCK))
        kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object), np.zeros(0)
        for batch in batches:
            row, code, part = parts(self.terms, batch, self.average, K1, B)
            place = np.empty(batch.num_rows, dtype=np.int64)
            by_length = np.argsort(batch.column("doc_len").to_numpy(), kind="stable")
            place[by_length] = np.arange(batch.num_rows)
            order = np.argsort(place[row], kind="stable")
            row, code, part = place[row][order], code[order], part[order]
            found = []
            for begin in range(0, batch.num_rows, BLOCK * BLOCKS):
                cuts = np.searchsorted(row, np.arange(begin, min(begin + BLOCK * BLOCKS, batch.num_rows) + BLOCK, BLOCK))
                greatest = np.zeros((len(self.terms), len(cuts) - 1))
                own = slice(cuts[0], cuts[-1])
                np.maximum.at(greatest, (code[own], (row[own] - begin) // BLOCK), part[own])
                bound = np.concatenate([x for _, x in self.sums(greatest)])
                for k in range(len(cuts) - 1):
                    own = slice(cuts[k], cuts[k + 1])
                    asked = np.flatnonzero((bound[:, k] > 0) & (bound[:, k] >= best[:, 0] - TIE))
                    self.opened += len(asked)
                    values[code[own], row[own] - begin - k * BLOCK] = part[own]
                    for q, score in self.sums(values, asked):
                        i, d = np.nonzero((score > 0) & (score >= best[q, :1] - TIE))
                        found.append((q[i], by_length[np.minimum(begin + k * BLOCK + d, batch.num_rows - 1)], score[i, d]))
                        i = np.unique(i)
                        best[q[i]] = np.partition(np.hstack([best[q[i]], score[i]]), -self.most, axis=1)[:, -self.most :]
                    values[code[own]] = 0
            if found:
                q, d, score = (np.concatenate(x) for x in zip(*found, strict=True))
                some = score >= best[q, 0] - TIE
                doc = np.array(batch.column("doc_id").take(pa.array(d[some])).to_pylist(), dtype=object)
                kept = self.reaching(*(np.concatenate(x) for x in zip(kept, (q[some], doc, score[some]), strict=True)), best[:, 0])
        for i in range(0, len(kept[0]), 65_536):
            q, doc, score = (x[i : i + 65_536] for x in kept)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(doc, pa.string()), pa.array(score)], names=["query_id", "doc_id", "bm25"])

    def reaching(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What can be among the best: scores that reach the least of them, and of equal scores of a query the first documents only."""
        some = score >= least[q] - TIE
        q, doc, score = q[some], doc[some], score[some]
        names, number = np.unique(doc, return_inverse=True)
        order = np.lexsort((number, -score, q))
        q, number, score = q[order], number[order], score[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(q), 1), dtype=bool), (np.diff(q) != 0) | (np.diff(score) != 0)]))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        some = nth < self.most
        return q[some], names[number[some]], score[some]


def best(index: Index, queries: DataFrame, most: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query (query_id, q) by BM25, rounded; ties by doc_id. Equal to ranking all scores.

    Blocks, their bounds and the scores of queries in documents stay in the task that has the documents: a task hands on what can be
    among the best of its own, and no posting and no pair of query and block is shuffled. Queries come in passes of a bounded number; idf are positive.
    """
    kind, spark = queries.schema["query_id"].dataType.simpleString(), queries.sparkSession
    queries = stage(queries, "asked")
    asked = whole_queries(queries, weighed(index, queries)).where("size(terms) > 0")
    average = average_length(index.docs).first()["avg_len"]
    rows = index.by_document().select("doc_id", "doc_len", "terms").coalesce(spark.sparkContext.defaultParallelism)  # more tasks than cores would only hand on more
    pairs = "query_id long, doc_id string, bm25 double"
    found = passed(asked, lambda held: stage(rows.mapInArrow(Asked(held, most, average).__call__, pairs), "best"), PASS)
    found = spark.createDataFrame([], pairs) if found is None else found
    return ranked(found.select(F.col("query_id").cast(kind).alias("query_id"), "doc_id", F.round("bm25", digits).alias("score")), most)
