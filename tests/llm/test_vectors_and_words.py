"""Whitening, spelling variants and near-duplicate embeddings against plain Python, and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from melisma.llm import embedding_dedup, queries, spelling, whitening

FOLDER = "/root/testdata/sf0.001"
CLASHING = "x string, v string, id string, n string, node string, copies string, least string, linked string, component string, shard string, run string, word string"
OWN = ("own",) * 12


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["vec_id"]: r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}


def plain_whitening(rows):
    """{id: (n, deviation, whitened)}, explained, by eigenvectors of the covariance."""
    x = {i: np.array([math.floor(64 * float(c)) + 1_000_000 for c in v], dtype=object) for i, v in rows.items()}
    fit = [np.array(t, dtype=object) for t in {tuple(v) for v in x.values()}]
    n, sums = len(fit), sum(fit)
    centred = np.array([[float(c) for c in (n * v - sums)] for v in fit]) / n
    eigen, axes = np.linalg.eigh(centred.T @ centred / n)
    eigen, axes = eigen[::-1], axes[:, ::-1]
    white = {i: (n, sum(int(c) ** 2 for c in n * v - sums), np.array([float(c) for c in n * v - sums]) / n @ axes[:, :16] / np.sqrt(eigen[:16])) for i, v in x.items()}
    return white, eigen[:16] / eigen.sum()


def test_op11(spark, vectors):
    want, explained = plain_whitening({i: r["embedding"] for i, r in vectors.items()})
    got = defaultdict(dict)
    for r in queries.QUERIES["op11_whitening"](spark, FOLDER).collect():
        assert r["component"] not in got[r["vec_id"]]
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want)
    signs = np.sign(sum(np.array([got[i][k]["whitened"] for k in range(1, 17)]) * want[i][2] for i in want))
    for i, (n, deviation, white) in want.items():
        assert sorted(got[i]) == list(range(1, 17))
        for k, r in got[i].items():
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert abs(r["whitened"] - signs[k - 1] * white[k - 1]) < 1e-8 and abs(r["explained"] / explained[k - 1] - 1) < 1e-9


def test_merges_lose_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (5000, 12)) * rng.integers(1, 9, 12) + 1_000_000
    found = None
    for part in np.split(x, [3, 700, 701, 4000]):
        own = whitening.summary(part)
        found = own if found is None else whitening.merged(found, own)
    mean = x.mean(axis=0)
    assert found.n == 5000 and found.sums == x.sum(axis=0).tolist() and np.abs(found.mean - mean).max() < 1e-8
    assert np.abs(found.weighed.T @ found.weighed / np.einsum("ij,ik->jk", x - mean, x - mean) - 1).max() < 1e-6 or np.allclose(found.weighed.T @ found.weighed, (x - mean).T @ (x - mean))
    large = np.full((3, 2), 2**62) + np.arange(3)[:, None]
    assert whitening.merged(whitening.summary(large), whitening.summary(large)).sums == [2 * int(sum(map(int, large[:, 0])))] * 2


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0], "a"), (2, [0.5, 1.0, -2.0], "a"), (2, [0.5, 1.0, -2.0], "a"), (None, [0.5, 1.0, -2.0], "a"), (3, [1.0, 2.0, -4.0], "a"), (4, [3.0, 0.0, 1.0], "a")]
    rows += [(5, None, "a"), (6, [1.0, None, 2.0], "a"), (7, [nan, 1.0, 1.0], "a"), (8, [inf, 1.0, 1.0], "a"), (9, [1.0, 2.0], "a"), (10, [], "a"), (11, [0.0, 0.0, 0.0], "a"), (12, [1.0, 2.0, -4.0], None), (13, [1e200, 2e200, -4e200], "a"), (14, [1.0, 2.0, -4.0], "b")]
    return spark.createDataFrame([(*r, *OWN) for r in rows], f"vec_id long, embedding array<double>, label string, {CLASHING}").repartition(3)


def test_odd_whitening(spark):
    table = odd_vectors(spark)
    found = whitening.whiten(table.where("vec_id IS NULL OR vec_id <> 13")).collect()
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter({(i, k): m for i, m in ((1, 1), (2, 2), (None, 1), (3, 1), (4, 1), (11, 1), (12, 1), (14, 1)) for k in (1, 2, 3)})
    assert {r["n"] for r in found} == {4} and all((r["whitened"] is None) == (r["component"] == 3) for r in found)  # the vectors lie in a plane
    assert len({(r["component"], r["whitened"], r["deviation"]) for r in found if r["vec_id"] in (1, 2, None)}) == 3
    huge = whitening.whiten(table).where("vec_id = 13").collect()
    assert len(huge) == 3 and all(r["deviation"] is None for r in huge)  # beyond a long
    one = whitening.whiten(table.where("vec_id = 1")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0)]
    for none in (table.limit(0), table.where("vec_id IN (5, 6, 7, 8)"), table.where("vec_id = 10")):
        empty = whitening.whiten(none)
        assert empty.count() == 0 and empty.columns == whitening.whiten(table).columns


def plain_links(rows, least=0.98):
    """[(n_links, component)] of rows (id, label, vector)."""
    unit = [None if r[1] is None or r[2] is None or any(c is None or not math.isfinite(c) for c in r[2]) or not any(r[2]) else np.array(r[2], dtype=float) / max(map(abs, r[2])) for r in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                at[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)] += [] if r[0] is None else [r[0]]
    return [(links[i], min(ids[root(i)], default=None)) for i in range(len(rows))]


def same_links(table, **kinds):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    want = Counter((r[0], *found, r[0] is not None and r[0] == found[1]) for r, found in zip(rows, plain_links(rows), strict=True))
    assert Counter(map(tuple, embedding_dedup.near_duplicates(table, **kinds).collect())) == want
    return want


def test_op13(spark, vectors):
    found = {r["vec_id"]: r for r in queries.QUERIES["op13_embedding_dedup"](spark, FOLDER).collect()}
    rows = [(i, r["label"], r["embedding"]) for i, r in vectors.items()]
    assert [(found[i]["n_links"], found[i]["component_id"]) for i in vectors] == plain_links(rows)


def test_odd_links(spark):
    want = same_links(odd_vectors(spark))
    assert (13, 5, 1, False) in want and (14, 0, 14, True) in want and (11, 0, 11, True) in want
    assert embedding_dedup.near_duplicates(odd_vectors(spark).limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(odd_vectors(spark).where("label IS NULL")).count() == 1


@pytest.mark.parametrize("shard", [16, 64, 4096])
def test_links_in_shards(spark, shard):
    """Chains across cuts, a ball with a halo, copies and scaled copies; the same whatever the shards."""
    rng = np.random.default_rng(3)
    rows, label = [], lambda: int(rng.integers(2))
    for _ in range(150):
        rows.append((label(), rng.normal(size=24)))
    start, way = rng.normal(size=24), rng.normal(size=24)
    rows += [(0, start + way * k / 12) for k in range(40)]  # a chain
    centre = rng.normal(size=24)
    centre *= 5 / np.linalg.norm(centre)
    rows += [(1, centre + rng.normal(size=24) * width) for width in (0.02, 0.05, 0.09, 0.14) for _ in range(60)]
    rows += [(l, v * 3) for l, v in rows[::7]] + [(l, v) for l, v in rows[::5]]
    table = spark.createDataFrame([(int(i), l, [float(c) for c in v]) for i, (l, v) in zip(rng.permutation(len(rows)), rows, strict=True)], "vec_id long, label int, embedding array<double>")
    want = same_links(table, shard=shard)
    assert max(k[1] for k in want) > 100


def test_balls_are_not_compared():
    """A group of near copies is counted without comparing its members, and few pairs of vectors that are far apart are compared whole."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = embedding_dedup.units(centre + rng.normal(size=(3000, 32)) * 0.03 * np.linalg.norm(centre) / 32**0.5)
    layout = embedding_dedup.Layout.of(rows, np.eye(32), 1.0, 256, math.acos(0.98), 0)
    place, shard, lives, ball = layout.deal(rows, rows[:, :16], np.arange(len(rows)))
    assert len(layout.balls) == 1 and lives.all() and (ball == 0).all() and len(set(shard.tolist())) == 12 and max(Counter(shard.tolist()).values()) == 250
    side = embedding_dedup.Side(rows, rows, np.ones(3000, dtype=np.int64), np.arange(3000))
    tight = embedding_dedup.Shard(side, False, 0.9)
    assert tight.compared == 0 and (side.linked == 2999).all() and len(set(tight.forest.roots(np.arange(3000)).tolist())) == 1


def test_every_link_meets_once():
    """Of two vectors that are linked, just one shard holds both, and one of them lives there; unless both are of one ball."""
    rng = np.random.default_rng(6)
    sparse = rng.normal(size=(800, 20)) * np.linspace(3, 0.1, 20)
    centres = np.repeat(sparse[:40], 10, axis=0)
    rows = embedding_dedup.units(np.vstack([sparse, centres + rng.normal(size=centres.shape) * 0.1, np.tile(sparse[:1], (300, 1)) + rng.normal(size=(300, 20)) * 0.05]))
    layout = embedding_dedup.Layout.of(rows, np.eye(20), 1.0, 100, math.acos(0.98), 0)
    place, shard, lives, ball = layout.deal(rows, rows[:, :16], np.arange(len(rows)))
    at = defaultdict(dict)
    for p, s, own in zip(place.tolist(), shard.tolist(), lives.tolist(), strict=True):
        at[p][s] = own
    x, y = np.nonzero(np.triu(rows @ rows.T >= 0.98, 1))
    assert layout.leaves > 4 and layout.balls and len(x) > 10_000
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        met = [s for s in at[a].keys() & at[b].keys() if at[a][s] or at[b][s]]
        assert ball[a] >= 0 and ball[a] == ball[b] or len(met) == 1


def near_of(word, others):
    letters = {c for w in others for c in w}
    edits = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (edits - {word}) & set(others)


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: near_of(w, counts) for w in counts}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-counts[v], v))[:1] if counts[v] >= 2 * counts[w]), None) for w in counts}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def test_op12(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, FOLDER).collect()]
    found = queries.QUERIES["op12_spelling_variants"](spark, FOLDER).collect()
    want = plain_variants(docs)
    assert len(found) == len(want) and set(map(tuple, found)) == want and any(r[1] for r in found)


def test_odd_words(spark):
    chain = " ".join(w + " " for w, n in (("abcdef", 3), ("abcdeg", 6), ("abcdhg", 12), ("abcihg", 24), ("xbcihg", 48), ("xbcihgz", 200)) for _ in range(n))
    rows = [(None, chain), (1, None), (1, ""), (2, "ÀÉÎ×÷ß ÀÉÎ×÷ß ÀÉÎ×÷s é a 日本語日本語"), (2, "ÀÉÎ×÷ß ÀÉÎ×÷s"), (2, "ÀÉÎ×÷ß ÀÉÎ×÷s"), (3, ("palabra " * 3 + "palabras ") * 30_000), (None, None)]
    rows += [(4, "q" * 3000 + "a")] * 3 + [(5, "q" * 3000 + "b")] * 6  # words of any length
    table = spark.createDataFrame([(*r, *OWN) for r in rows], f"doc_id long, text string, {CLASHING}").repartition(3)
    found = spelling.variants(table)
    plain = [r for r in rows if len(r[1] or "") < 3000 or "palabra" in r[1]]
    assert set(map(tuple, spelling.variants(table.where("doc_id IS NULL OR doc_id < 4")).collect())) == plain_variants(plain)
    long = {r["word"][-1]: r for r in found.where(F.length("word") > 1000).collect()}
    assert long["a"]["form"][-1] == "b" == long["a"]["root"][-1] and long["b"]["form"] is None and long["a"]["n_near"] == 1
    assert spelling.variants(table.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(600)})
    automaton = spelling.Automaton(iter(words))
    assert [automaton.number(w) for w in words] == list(range(len(words))) and automaton.number("zz") == automaton.number("") == -1
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(automaton.sizes.keys() & reachable(automaton)) == len(endings)  # the least number of states
    for word in words:
        half = word[: len(word) // 2]
        assert {words[k] for k in automaton.one_error(half, word[len(half) :])} == {w for w in near_of(word, words) if w.startswith(half) and w[len(half) :] != word[len(half) :]} & {w for w in words if w[len(half) :] in edits(word[len(half) :])}


def edits(rest):
    letters = "abcé"
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))} | {rest[:i] + c + rest[i:] for i in range(len(rest) + 1) for c in letters} | {rest[:i] + c + rest[i + 1 :] for i in range(len(rest)) for c in letters} - {rest}


def reachable(automaton):
    seen, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in seen:
            seen.add(state)
            todo += automaton.arcs[state].values()
    return seen


def test_large_halves_are_cut(monkeypatch):
    """A half that more words share than an automaton holds: each part is asked, and nothing is found twice."""
    monkeypatch.setattr(spelling, "HELD", 7)
    rng = random.Random(2)
    words = {"ab" + "".join(rng.choices("abc", k=rng.randint(3, 4))): rng.randint(3, 40) for _ in range(120)}
    rows = []
    for backward in (False, True):
        for w in words:
            spelled = w[::-1] if backward else w
            size = lambda n: n - n // 2 if backward else n // 2
            rows.append((backward, spelled[: size(len(w))], 0, spelled, words[w]))
            rows += [(backward, h, 1, spelled, words[w]) for h in {spelled[: size(len(w) + d)] for d in (-1, 0, 1)}]
    rows.sort()
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[2] = [c == 0 for c in columns[2]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["backward", "half", "asked", "spelled", "n"])
    found = Counter()
    for part in spelling.pairs_found(iter([batch.slice(0, 100), batch.slice(100)])):
        for r in part.to_pylist():
            found[r["word"]] += r["n_near"]
    assert found == Counter({w: len(near_of(w, words)) for w in words if near_of(w, words)})
