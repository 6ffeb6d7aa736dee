"""Latent semantic scores: tf-idf of words and word pairs, and a truncated decomposition of its Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.functions.text import let
from melisma.sources.corpus import semantic_text
from melisma.sources.staging import stage

# Features and components of the model.
FEATURES, COMPONENTS = 5000, 128
#: Columns of a block beyond the components asked for; rows of a block's sums that meet.
SPARE, PART = 32, 256
#: Rows that are multiplied at a time.
ROWS = 256
#: Words whose pairs are counted as numbers; pairs that a task counts before it hands them on.
MOST_WORDS, MOST_PAIRS = 50_000, 4_000_000


def singles(text: Column) -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ngrams(text: Column) -> Column:
    """Words of two or more word characters, and pairs of neighbours."""

    def with_pairs(found: Column) -> Column:
        rest = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
        return F.concat(found, F.transform(rest, lambda w, i: F.concat_ws(" ", F.get(found, i), w)))

    return let(singles(text), with_pairs)  # else the words would be found again for each pair


def top_ngrams(rows: DataFrame, features: int = FEATURES) -> DataFrame:
    """(ngram, total) of rows (doc_id, text): the most frequent n-grams; ties by text.

    A pair is no more frequent than either of its words, and one of the most frequent n-grams reaches the least of as many words. So
    only pairs of words that reach it are counted, and as numbers; unless too many words do.
    """
    counted = lambda found: rows.select(F.explode(found).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("total"))
    most = lambda found: found.orderBy(F.desc("total"), "ngram").limit(features)
    single = stage(counted(singles(F.col("text"))), "words")
    least = most(single).agg(F.min("total").alias("least"), F.count("*").alias("n")).first()
    reaching = single.where(F.col("total") >= least["least"]).select("ngram").limit(MOST_WORDS + 1).collect() if least["n"] == features else None
    if reaching is None or len(reaching) > MOST_WORDS:
        return most(counted(ngrams(F.col("text"))))
    return most(single.unionByName(pair_totals(rows, sorted(r["ngram"] for r in reaching)).where(F.col("total") >= least["least"])))


def pair_totals(rows: DataFrame, words: list[str]) -> DataFrame:
    """(ngram, total) of the pairs of neighbours that are both among these words, in rows (doc_id, text)."""
    width = len(words)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, held, sizes = pa.array(words, pa.string()), [], 0

        def summed():
            pair, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

        def out(pair, n):
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            found = batch.column("words")
            row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            code = pc.fill_null(pc.index_in(found.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
            held.append(np.unique(code[both] * width + code[both + 1], return_counts=True))
            sizes += len(held[-1][0])
            if sizes > MOST_PAIRS:
                held = [summed()]
                sizes = len(held[0][0])
                if sizes > MOST_PAIRS // 2:
                    yield out(*held[0])
                    held, sizes = [], 0
        if held:
            yield out(*summed())

    spark = rows.sparkSession
    totals = rows.select(singles(F.col("text")).alias("words")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total"))
    named = lambda c: F.broadcast(spark.createDataFrame(list(enumerate(words)), f"{c} long, {c}_word string"))
    placed = totals.select(F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b"), "total")
    return placed.join(named("a"), "a").join(named("b"), "b").select(F.concat_ws(" ", "a_word", "b_word").alias("ngram"), "total")


def counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, ngram, n) of rows (doc_id, text), of the vocabulary's n-grams only: what is not in it never leaves its task. The vocabulary is bounded by its limit."""
    found = rows.select("doc_id", F.explode(ngrams(F.col("text"))).alias("ngram")).join(F.broadcast(vocabulary.select("ngram")), "ngram")
    return found.groupBy("doc_id", "ngram").agg(F.count("*").alias("n"))


def tfidf(rows: DataFrame, features: int = FEATURES) -> DataFrame:
    """(doc_id, ngram, weight): tf times ln((1 + N) / (1 + df)) + 1, unit length by document. A document has at most `features` entries."""
    kept = stage(counts(rows, stage(top_ngrams(rows, features), "vocabulary")), "ngrams")
    idf = kept.groupBy("ngram").agg(F.count("*").alias("df")).join(F.broadcast(rows.agg(F.count("*").alias("n_docs"))))
    idf = idf.select("ngram", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = kept.join(F.broadcast(idf), "ngram").select("doc_id", F.struct("ngram", (F.col("n") * F.col("idf")).alias("w")).alias("x"))
    listed = raw.groupBy("doc_id").agg(F.collect_list("x").alias("x"), F.sqrt(F.sum(F.col("x.w") * F.col("x.w"))).alias("norm"))
    return listed.select("doc_id", "norm", F.inline("x")).select("doc_id", "ngram", (F.col("w") / F.col("norm")).alias("weight"))


class Places:
    """Numbers of the n-grams in lists of words: words have codes, a pair of neighbours is the code of two; no text of a pair is made."""

    def __init__(self, features: list[str]) -> None:
        import pyarrow as pa

        parts = [g.split(" ") for g in features]
        codes = {w: k for k, w in enumerate(sorted({w for x in parts for w in x}))}
        self.words, self.width = pa.array(list(codes), pa.string()), len(features)
        self.single = np.full(len(codes) + 1, -1, dtype=np.int64)  # the last is of words that no feature has
        pairs = []
        for i, x in enumerate(parts):
            if len(x) == 1:
                self.single[codes[x[0]]] = i
            else:
                pairs.append((codes[x[0]] * len(codes) + codes[x[1]], i))
        self.pairs, self.pair_at = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T

    def counts(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, times) of the features in a list array of words, by row and number."""
        import pyarrow.compute as pc

        sizes, flat, none = np.diff(found.offsets.to_numpy()), found.flatten(), len(self.words)
        row = np.repeat(np.arange(len(sizes)), sizes)
        code = pc.fill_null(pc.index_in(flat, value_set=self.words), none).to_numpy(zero_copy_only=False).astype(np.int64)
        at = self.single[code]
        keys = row[at >= 0] * self.width + at[at >= 0]
        if len(self.pairs) and len(code) > 1:
            two = np.flatnonzero((code[:-1] < none) & (code[1:] < none) & (row[:-1] == row[1:]))
            both = code[two] * none + code[two + 1]
            place = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
            hit = self.pairs[place] == both
            keys = np.concatenate([keys, row[two[hit]] * self.width + self.pair_at[place[hit]]])
        keys, times = np.unique(keys, return_counts=True)
        return keys // self.width, keys % self.width, times


def weights(row: np.ndarray, at: np.ndarray, times: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Times by idf, at unit length by row."""
    x = times * idf[at]
    return x / np.sqrt(np.bincount(row, x * x, rows))[row]


@dataclass(frozen=True)
class Model:
    """n-grams with their idf, and the directions kept (features by components); None: weights are used as they are."""

    idf: dict[str, float]
    directions: np.ndarray | None

    def vectors(self, rows: DataFrame) -> DataFrame:
        """(doc_id, vec) of rows (doc_id, text): unit or zero vectors."""
        places, run = Places(list(self.idf)), self.batches()

        def found(batches):
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    yield run(batch.column("doc_id"), *places.counts(batch.column("words")))

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select("doc_id", singles(F.col("text")).alias("words")).mapInArrow(found, f"doc_id {kind}, vec array<double>")

    def embedded(self, found: DataFrame) -> DataFrame:
        """The same of rows (doc_id, at, n) of counted(), without their texts."""
        run = self.batches()

        def vectors(batches):
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    listed = batch.column("at")
                    row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
                    yield run(batch.column("doc_id"), row, listed.flatten().to_numpy(), batch.column("n").flatten().to_numpy())

        return found.select("doc_id", "at", "n").mapInArrow(vectors, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, vec array<double>")

    def batches(self):
        """A function of (doc_ids, row, number, times) that gives a batch (doc_id, vec)."""
        idf, directions, features = np.array(list(self.idf.values())), self.directions, len(self.idf)
        width = features if directions is None else directions.shape[1]

        def run(ids, row, at, times):
            import pyarrow as pa

            x = np.zeros((len(ids), features))
            x[row, at] = weights(row, at, times, idf, len(ids))
            if directions is not None:
                x = x @ directions
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, size, out=x, where=size > 0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([ids, vec], names=["doc_id", "vec"])

        return run


@dataclass(frozen=True)
class Meaning:
    """Unit or zero vectors of documents (doc_id, vec) and of queries (query_id, vec), whose products are the semantic part."""

    docs: DataFrame
    queries: DataFrame


def counted(rows: DataFrame, features: list[str]) -> DataFrame:
    """(doc_id, at, n): the numbers of each text's features and how often it has them, rows (doc_id, text); a row for each."""
    places = Places(features)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, at, times = places.counts(batch.column("words"))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (at, times))], names=["doc_id", "at", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", singles(F.col("text")).alias("words")).mapInArrow(run, f"doc_id {kind}, at array<int>, n array<int>")


def gram_times(found: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The Gram matrix of the weights of rows (at, n) times a block of columns; the matrix itself is made nowhere.

    A task multiplies some rows at a time, as a full matrix, with the block and the result with the rows again. What leaves it is as
    large as the block; sums meet by parts of the block, one row after another.
    """
    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    spark, (width, columns) = found.sparkSession, block.shape
    shared = spark.sparkContext.broadcast(block)

    def multiply(batches):
        block, total = shared.value, np.zeros((width, columns))
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                listed, rows = batch.column("at"), batch.num_rows
                row = np.repeat(np.arange(rows), np.diff(listed.offsets.to_numpy()))
                at = listed.flatten().to_numpy()
                x = weights(row, at, batch.column("n").flatten().to_numpy(), idf, rows)
                full = np.zeros((rows, width))
                full[row, at] = x
                total += full.T @ (full @ block)
        yield pa.RecordBatch.from_pylist([{"part": i, "sums": total[i : i + PART].tobytes()} for i in range(0, width, PART)], schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_pylist([{"part": k, "sums": v.tobytes()} for k, v in sums.items()], schema)

    kind = "part int, sums binary"
    out = np.zeros((width, columns))
    found = found.select("at", "n")
    # a task holds its sums only, however many rows it reads; more tasks than cores would just write more sums
    for r in found.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(multiply, kind).repartition("part").mapInArrow(add, kind).collect():
        out[r["part"] : r["part"] + PART] = np.frombuffer(r["sums"]).reshape(-1, columns)
    shared.destroy()
    return out


def leading(times, width: int, size: int, tolerance: float = 1e-8) -> np.ndarray:
    """The eigenvectors of the `size` greatest eigenvalues of a symmetric matrix that is known by its product with a block (times).

    A block Krylov space: each product adds the directions that it has beyond those so far, until the eigenvectors of the
    matrix within the space are such of the whole matrix, or nothing is added.
    """
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(width, min(width, size + SPARE))))[0]
    space, images, within = block, np.zeros((width, 0)), np.zeros((0, 0))  # within: the matrix in the space
    while True:
        image = times(block)
        images, side = np.hstack([images, image]), space.T @ image
        within = np.block([[within, side[: len(within)]], [side[: len(within)].T, side[len(within) :]]])
        values, inner = np.linalg.eigh(within)
        values, inner = values[::-1][:size], inner[:, ::-1][:, :size]
        rest = images @ inner - (space @ inner) * values
        if np.linalg.norm(rest, axis=0).max() <= tolerance * max(values[0], 1e-300) or space.shape[1] == width:
            return space @ inner
        block = images[:, -block.shape[1] :]
        for _ in range(2):  # once more, for what rounding left
            block = block - space @ (space.T @ block)
        axes, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = axes[:, sizes > 1e-12 * max(values[0], 1e-300)][:, : width - space.shape[1]]
        if not block.shape[1]:
            return space @ inner
        block = np.linalg.qr(block - space @ (space.T @ block))[0]
        space = np.hstack([space, block])


def fit(songs: DataFrame, components: int = COMPONENTS, features: int = FEATURES) -> Model:
    return fitted(songs, components, features)[0]


def meaning(songs: DataFrame, queries: DataFrame) -> Meaning:
    """Of all songs and of queries (query_id, q), by the model of the songs; their texts are not read again for it."""
    model, seen = fitted(songs)
    asked = model.vectors(queries.select(F.col("query_id").alias("doc_id"), F.col("q").alias("text")))
    return Meaning(model.embedded(seen), asked.withColumnRenamed("doc_id", "query_id"))


def fitted(songs: DataFrame, components: int = COMPONENTS, features: int = FEATURES) -> tuple[Model, DataFrame]:
    """The model, and the songs' counts (doc_id, at, n), staged. The leading eigenvectors of the n-grams' Gram matrix, by products of the documents' staged weights with blocks of columns."""
    rows = songs.select(F.col("id").alias("doc_id"), semantic_text().alias("text"))
    found = [r["ngram"] for r in top_ngrams(rows, features).collect()]  # a bounded number of them
    seen = stage(counted(rows, found), "counts")
    n = seen.count()
    df = np.zeros(len(found))
    for r in seen.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():
        df[r["at"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    named = dict(zip(found, idf.tolist(), strict=True))
    size = min(components, len(named) - 1, n - 1)
    if size < 1:
        return Model(named, None), seen
    return Model(named, leading(lambda block: gram_times(seen, idf, block), len(named), size)), seen


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vec: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def scores(model: Model, songs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, semantic): cosines of the stated queries (a bounded set) with all documents."""
    docs = model.vectors(songs.select(F.col("id").alias("doc_id"), semantic_text().alias("text")))
    asked = model.vectors(queries.select(F.col("query_id").alias("doc_id"), F.col("q").alias("text"))).collect()
    listed = F.array(*(F.struct(F.lit(r["doc_id"]).alias("query_id"), F.array(*map(F.lit, r["vec"])).alias("q")) for r in asked))
    return docs.select("doc_id", "vec", F.inline(listed)).select("query_id", "doc_id", dot(F.col("vec"), F.col("q")).alias("semantic"))


def pair_scores(model: Model, songs: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, semantic) of the given pairs (query_id, doc_id): only their documents are embedded, and queries are a table of any size."""
    rows = songs.select(F.col("id").alias("doc_id"), semantic_text().alias("text")).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = model.vectors(queries.select(F.col("query_id").alias("doc_id"), F.col("q").alias("text"))).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("q"))
    return pairs.join(model.vectors(rows), "doc_id").join(asked, "query_id").select("query_id", "doc_id", dot(F.col("vec"), F.col("q")).alias("semantic"))
