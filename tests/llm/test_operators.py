import base64
import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from melisma.llm import byte_bpe, fm_index, graph, language_id, pii, quality_rules, secret_scan, shingles, simhash, substring_dedup, suffix_dedup, toxicity
from melisma.llm.repeats import Windows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, runs int, did string, fp string, spans string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
COMMON = " ".join(f"common{i}" for i in range(60))
TEXTS = [
    None, "", "   \n\t", "one", "é" * 700, COMMON, "head " + COMMON + " tail", COMMON, "x y\x85z " * 90, "a " * 300, "aa" * 900,
    "unlike any other text " + " ".join(map(str, range(200))), "日本語 " * 150 + COMMON[:200], COMMON.replace("common59", "other"),
    *(f"{x} " + " ".join(f"shared{i}" for i in range(30)) + f" {x}" for x in ("first", "second")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, "d", "f", "p") for i, t in enumerate(TEXTS)]
    rows += [(None, COMMON + " end", None, None, None, None, None, None, None), (5, COMMON, "en", "s", 0, 1, "d", "f", "p")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def kept_by_brute(sequences, width):
    every = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = set()
        for i in range(len(s) - width + 1):
            if every[tuple(s[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append([x for i, x in enumerate(s) if i not in gone])
    return out


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_repeated_words(docs, empty, most):
    rows = pairs(docs)
    spec = Windows("words", 35, 8, most)
    want = sorted(((i is None, i or 0), b" ".join(k).decode()) for (i, _), k in zip(rows, kept_by_brute([WORDS.findall(t.encode()) for _, t in rows], 35), strict=True))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["kept"]) for r in substring_dedup.remove_repeated_words(docs, spec).collect())
    assert got == want
    assert substring_dedup.remove_repeated_words(empty, spec).count() == 0


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_repeated_bytes(docs, empty, most):
    rows = pairs(docs)
    spec, passage = Windows("bytes", 400, 48, most), Windows("bytes", 200, 48, most)
    short = kept_by_brute([t.encode() for _, t in rows], 200)
    want = Counter((i, bytes(k), len(t.encode()) - len(s)) for (i, t), k, s in zip(rows, kept_by_brute([t.encode() for _, t in rows], 400), short, strict=True))
    assert any(n > 200 and k.startswith(b"first shared0") for _, k, n in want)  # a passage that stays
    got = Counter((r["doc_id"], bytes(r["kept"]), r["n_passage"]) for r in suffix_dedup.remove_repeated_bytes(docs, spec, passage).collect())
    assert got == want
    assert suffix_dedup.remove_repeated_bytes(empty, spec).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_long_words_differ(spark):
    """Words that any polynomial modulo 2**64 confuses."""
    tail = " ".join(f"t{i}" for i in range(34))
    rows = [(i, f"{w} {tail}") for i, w in enumerate([*thue_morse(1024), *thue_morse(2048), "a" * 9, "a" * 9 + "\0", "a\0", "a"])]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    assert all(r["n_removed"] == 0 for r in substring_dedup.remove_repeated_words(table).collect())
    first, second = thue_morse(2048)
    phrase = " ".join(f"t{i}" for i in range(9))
    table = spark.createDataFrame([(0, f"{first} {phrase}"), (1, f"{second} {phrase}")], "doc_id int, text string")
    bench = spark.createDataFrame([("x", f"{first} {phrase}")], "item_id string, text string")
    assert sorted((r["doc_id"], r["n_hit"]) for r in fm_index.contamination(table, bench).collect()) == [(0, 10), (1, 0)]


def test_parse_decides():
    """Matches are looked up only at the begins of factors and across their boundaries."""
    text = np.arange(100, dtype=np.uint64)
    codes = np.concatenate([text, text[:60], text[58:]])  # the second copy's boundary is crossed by no repeated window, the text's own is
    bound = np.array([0, 100, 160, 202])
    asked = []

    class Seen(substring_dedup.Reference):
        def longest(self, at):
            asked.append(len(at))
            return super().longest(at)

    plain, substring_dedup.Reference = substring_dedup.Reference, Seen
    try:
        got = substring_dedup.factor(codes, bound, np.diff(bound) - 34, np.ones(3, dtype=np.int64), 35)
    finally:
        substring_dedup.Reference = plain
    every = Counter(tuple(codes[i : i + 35]) for a, b in zip(bound, bound[1:]) for i in range(a, b - 34))
    assert got.tolist() == [any(a <= i <= b - 35 for a, b in zip(bound, bound[1:])) and every[tuple(codes[i : i + 35])] > 1 for i in range(len(codes))]
    assert sum(asked) < len(codes) // 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=5, max_size=12), min_size=1, max_size=8))
def test_block_methods(segments):
    width, codes = 5, np.array([x for s in segments for x in s], dtype=np.uint64)
    bound = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    every = Counter(tuple(s[i : i + width]) for s in segments for i in range(len(s) - width + 1))
    want = [i + width <= len(s) and every[tuple(s[i : i + width])] > 1 for s in segments for i in range(len(s))]
    ones = np.ones(len(segments), dtype=np.int64)
    for find in (substring_dedup.factor, suffix_dedup.refine):
        got = find(codes, bound, np.diff(bound) - width + 1, ones, width)
        assert got.tolist() == want, find


def shannon(x):
    return -sum(c / len(x) * log2(c / len(x)) for c in Counter(x).values())


def test_secrets(spark, empty):
    token = "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    cases = {
        f"é key {token} end": ["entropy"], "Token: 'abcdef'": ["assign"], "secret=abc": [], "AKIA" + "A1" * 8: ["access"], "x" + "0123456789abcdef" * 2: ["hex"],
        "123e4567-e89b-12d3-a456-426614174000": [], "some-long-lower-case-words-here": [], "ſecret=abcdef": [], "secret=token:abcdefgh": [],
    }
    for text, kinds in cases.items():
        found = secret_scan.secrets(text)
        assert [secret_scan.KINDS[k] for _, k, _ in found] == kinds, text
    (a, _, b), *_ = secret_scan.secrets(f"é key {token} end")
    assert f"é key {token} end"[a:b] == token
    data = b"abcabcabcabcabcabcabcabcXyZ0123456789qwertyuiopLKJH"
    spots = {j for i in range(len(data) - 19) if shannon(data[i : i + 20]) >= 3.7 - 1e-9 for j in range(i, i + 20)}
    assert {j for a, b in secret_scan.entropy_runs(data, 3.7) for j in range(a, b)} == spots
    assert secret_scan.scan(spark.createDataFrame([(1, None)], "doc_id int, text string")).first()["spans"] == [] and secret_scan.scan(empty).count() == 0


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aaa -='stredlm1²\n\t\x1c\x85 éß日😀́")), st.characters(codec="utf-8")), max_size=80))
def test_coding(codec, reference, text):
    ids = np.frombuffer(codec.encode([text])[0], dtype="<u4")
    assert ids.tolist() == reference.encode_ordinary(text) and codec.decode(ids).decode() == text
    assert all(a < b for a, b in codec.offsets(text)) and len(codec.offsets(text)) == len(ids)


def test_coding_rows(docs, empty):
    args = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = byte_bpe.encode_decode(docs, *args).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == Counter(pairs(docs)) and byte_bpe.encode_decode(empty, *args).count() == 0


def test_simhash(docs, empty):
    rows = pairs(docs)
    prints = []
    for _, t in rows:
        w = WORDS.findall(t.encode().lower() if t.isascii() else t.encode())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, bool(w)))]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    forest = simhash.Forest(len(rows))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if (a ^ b).bit_count() <= 4:
                forest.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        root = forest.roots(np.array([i]))[0]
        least[root] = min((x for x in (least.get(root), d) if x is not None), default=None)
    got = simhash.near_duplicates(docs, shingle=4).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((d, prints[i], least[forest.roots(np.array([i]))[0]]) for i, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def near_copies(spark):
    """(rows, shingle sets): texts with copies in which 1 to 8 of 200 words are others."""
    rng, rows = np.random.default_rng(5), []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append(" ".join(words))
        for changed in range(1, 9):
            copy = list(words)
            for k in rng.choice(200, changed, replace=False):
                copy[k] = f"new{base}x{changed}x{k}"
            rows.append(" ".join(copy).title())
    rows += ["", None, " \n", "only Four words here", "only four words here", "only four words there"]
    words = [(t or "").lower().split() for t in rows]
    return rows, [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))) for w in words]


def test_near_duplicates(spark, empty, near_copies):
    import corpus_pipeline

    rows, sets = near_copies
    forest, between = simhash.Forest(len(rows)), Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            s = jaccard(a, sets[j])
            between[int(s * 20)] += 1
            if s >= 0.8:
                forest.join(i, j)
    assert all(between[k] >= 20 for k in (16, 17, 18, 19))  # 0.8 to 1 in steps of 0.05
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {}
    for r in shingles.near_duplicates(table).collect():
        got.setdefault(r["component"], set()).add(r["did"])
    want = {}
    for i in range(len(rows)):
        want.setdefault(int(forest.roots(np.array([i]))[0]), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == sorted(want)
    assert shingles.near_duplicates(empty).count() == 0


def test_near_duplicates_rows(spark):
    import corpus_pipeline

    other = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"]
    rows = [(None, other[0]), (None, other[1]), (None, other[1]), (7, other[2]), (7, other[3]), (3, other[3]), (7, other[4]), (7, other[4]), (None, other[4]), (9, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, table, "").collect()))
    assert got == Counter([(None, other[0]), (None, other[1]), (7, other[2]), (3, other[3]), (7, other[4]), (9, None)])


def near_prints(seed, families, members, others):
    """Distinct fingerprints: families whose members differ in up to 4 random bits from one centre, and others at random."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, families, dtype=np.uint64) << np.uint64(1)
    near = centres[rng.integers(0, families, members)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, members).astype(np.uint64))
    return np.unique(np.concatenate([near, rng.integers(0, 2**63, others, dtype=np.uint64)]))


def classes(prints, radius):
    forest = simhash.Forest(len(prints))
    for i in range(0, len(prints), 256):
        for a, b in zip(*np.nonzero(simhash.distance(prints[i : i + 256, None], prints[None]) <= radius), strict=True):
            forest.join(i + int(a), int(b))
    return forest.roots(np.arange(len(prints))).tolist()


@pytest.mark.parametrize("radius", [4, 7])
def test_tree(radius):
    prints = near_prints(radius, 20, 900, 900)
    masks, reach = simhash.block_masks(radius)
    trees = [simhash.Tree(prints, radius)] + [simhash.Tree(prints, radius, int(m), reach) for m in masks]
    for tree in trees:
        tree.within(np.arange(len(prints)))
        assert tree.splits > 10
    want = classes(prints, radius)
    assert trees[0].forest.roots(np.arange(len(prints))).tolist() == want
    union = simhash.Forest(len(prints))
    for tree in trees[1:]:
        assert tree.tested < len(prints) ** 2 // 2  # branches were pruned
        for a, b in tree.edges:
            union.join(a, b)
    assert union.roots(np.arange(len(prints))).tolist() == want


def test_shards(spark, monkeypatch):
    """Several thousand fingerprints over many shards: links across their boundaries are found."""
    monkeypatch.setattr(simhash, "SHARD", 256)
    prints = near_prints(1, 60, 3000, 3000)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    met = simhash.shards_of(table, 4).groupBy("block", "shard").agg(F.sum(F.col("lives").cast("int")).alias("own"), F.count("*").alias("n")).collect()
    assert len(met) > 3 * 16 and sum(r["own"] for r in met) == 3 * len(prints) and max(r["own"] for r in met) < len(prints) // 4
    forest, place = simhash.Forest(len(prints)), {int(x): i for i, x in enumerate(prints.view(np.int64))}
    for r in simhash.links(table, 4).collect():
        forest.join(place[r["u"]], place[r["v"]])
    assert forest.roots(np.arange(len(prints))).tolist() == classes(prints, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(-5, 100), (100, 7), (300, 301), (302, 301), (303, 302), (9, 9)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == -5 for i in (-5, 1, 40, 100)) and {got[i] for i in range(300, 304)} == {300}


def test_quality(spark, docs, empty):
    spam = [(i, " ".join(f"w{j}### t{i * 100 + j}" for j in range(60)), 0) for i in range(60)]
    good = [(100 + i, " ".join(f"word{j} t{i * 100 + j}" for j in range(60)), 1) for i in range(60)]
    rows = spark.createDataFrame(spam + good, "doc_id int, text string, quality int")
    rules = quality_rules.train(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.assess(rows, rules).collect()}
    assert rules and all(kept[i] == (i >= 100) for i in kept)
    assert quality_rules.train(empty, rows.select("doc_id", "quality")) == [] and quality_rules.assess(empty, rules).count() == 0
    for r in quality_rules.assess(docs, rules).collect():
        w = WORDS.findall((r["row"]["text"] or "").encode())
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(again))
        assert r["word_chars"] == len(b"".join(w).decode())


def test_pii(spark, empty):
    texts = ["é a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111- 4111-1111-1111-1112", "+49 (30) 1234-5678. +1", "1 " * 30000, "9" * 30000, None, "", "call 212-555-1234 or ssn 219-09-9999"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = pii.find(rows, pii.train(rows))
    got = {r["row"]["doc_id"]: [(s["kind"], r["row"]["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in found.collect()}
    assert got[0] == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8")] and got[1] == [("card", "4111 1111 1111 1111")]
    assert got[2] == [("phone", "+49 (30) 1234-5678")] and not any(got[i] for i in (3, 4, 5, 6)) and [k for k, _ in got[7]] == ["local_phone", "national_id"]
    many = " ".join(f"a{i}@b.cd" for i in range(1000))  # more than a chunk
    spans = pii.find(spark.createDataFrame([(1, "é " + many)], "doc_id int, text string"), pii.fit({})).first()["spans"]
    assert [("é " + many)[s["start"] : s["end"]] for s in spans] == many.split()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean[0] == "é [email][email] [ip].[ip] 256.1.1.1" and clean[5] is None and clean[6] == ""
    assert pii.find(empty, pii.train(empty)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_contamination(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(fm_index, "PHRASE_WORDS", block)
    items = [("b", " ".join(f"Common{i}" for i in range(20, 33))), ("a", "one"), ("c", None), ("d", "a a a a a a a a a a a"), ("e", "y"), ("f", "tail, 日本語"), ("g", "not in any text at all here or there"), ("b2", "other")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(len(w) - 9, bool(w))):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    want = Counter()
    for d, t in pairs(docs):
        w, hit, names = words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        want[d, len(w), len(hit), tuple(sorted(names))] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in fm_index.contamination(docs, bench).collect())
    assert got == want
    assert fm_index.contamination(empty, bench).count() == 0 and fm_index.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    cut = {r["doc_id"]: r["text"] for r in fm_index.decontaminated(docs, bench).collect()}
    assert cut[0] is None and cut[3] == "" and "common25" not in cut[7] and cut[7].startswith("common0 ")


def test_cut_of_blocks(spark, monkeypatch):
    words = [f"v{i}" for i in range(60)]
    items = [("a", " ".join(words[:10] + [f"z{i}" for i in range(30)])), ("b", " ".join(words[:15])), ("c", " ".join(words[20:24] + words[30:40]))]
    texts = [" ".join(words), "Head, " + " ".join(words[:15]) + ". tail", " ".join(words[20:24] + words[:15] + words[30:40]), None, "", " ".join(words[:9])]
    table = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[1]), (1, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = {}
    for block in (2_000_000, 40):
        monkeypatch.setattr(fm_index, "PHRASE_WORDS", block)
        cut[block] = fm_index.decontaminated(table, bench)
        assert len(list(fm_index.phrase_blocks(bench, "item_id", "text", 10))) == (1 if block > 40 else 2) and cut[block].columns == table.columns
        cut[block] = Counter(map(tuple, cut[block].collect()))
    assert cut[40] == cut[2_000_000] and cut[40][1, "Head, . tail"] == 2


def test_toxicity(spark, empty):
    rows = [(i, f"word{i % 7} plain{i % 5} text" + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0), int(i % 3 != 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id int, text string, toxic int, quality int")
    chain = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic", "quality"))
    got = {r["doc_id"]: r for r in toxicity.predict(table, chain).collect()}
    assert [x.name for x in chain] == ["low_quality", "objectionable", "toxic"] and all(got[i]["toxic"] == (i % 4 == 0) for i in got)
    unseen = toxicity.predict(spark.createDataFrame([(1, None), (2, ""), (3, "vile"), (4, "nice")], "doc_id int, text string"), chain).orderBy("doc_id").collect()
    assert [r["toxic"] for r in unseen] == [False, False, True, False]
    assert toxicity.train(empty, table.select("doc_id", "toxic", "quality")) == [] and toxicity.predict(empty, chain).count() == 0


def test_toxicity_held_out(spark):
    """Trained on the even labelled ids, asked for the odd ones."""
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/documents.parquet").join(F.broadcast(spark.read.parquet(f"{folder}/labels.parquet")), "doc_id").select("doc_id", "text", "quality", F.col("toxic").alias("truth"))
    labels = table.where("doc_id % 2 = 0").select("doc_id", "quality", F.col("truth").alias("toxic"))
    asked = table.where("doc_id % 2 = 1")
    got = toxicity.predict(asked, toxicity.train(table.select("doc_id", "text"), labels)).join(asked.select("doc_id", "truth"), "doc_id").groupBy("truth", "toxic").count().collect()
    times = {(r["truth"], r["toxic"]): r["count"] for r in got}
    assert times[1, True] / (times[1, True] + times[1, False]) >= 0.9 and times[0, False] / (times[0, False] + times.get((0, True), 0)) >= 0.99


def test_labelers():
    """Kinds have reliabilities of their own: a labeler that is right in one kind and random in another."""
    counts = {}
    for n, votes in ((400, 0b111), (30, 0b110), (30, 0b101), (500, 0b000), (20, 0b100)):
        counts["account", votes] = n
    for n, votes in ((200, 0b111), (200, 0b101), (300, 0b010), (300, 0b000)):  # the gazetteer tosses a coin
        counts["person", votes] = n
    truth = pii.posteriors(counts)
    assert truth["account", 0b111] > 0.95 and truth["account", 0b000] < 0.05
    assert truth["person", 0b101] > 0.8 and truth["person", 0b010] < 0.2 and truth["account", 0b010 | 0b100] > truth["person", 0b010]
    model = pii.fit(counts)
    assert model.accepts("account", 0b111) and model.accepts("person", 0b101) and not model.accepts("person", 0b010) and not model.accepts("account", 0)


def test_added_kinds(spark):
    good, bad = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
    texts = [f"IBAN: {good} end", f"part {bad} end", "ssn 078-05-1120", "SSN: 512-34-5678", "Dear Mr. John Smith", "The Grace Hopper"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["row"]["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(rows, pii.fit({})).collect()}
    assert got == {0: ["account"], 1: [], 2: ["national_id"], 3: ["national_id"], 4: ["person"], 5: []}
    valid = spark.createDataFrame([(good,), (bad,), ("GB82WEST12345698765432",)], "t string").select(pii.mod97(F.col("t")).alias("ok"))
    assert [r["ok"] for r in valid.collect()] == [True, False, True]


def test_language(spark, empty):
    stems = {"en": ["the", "house", "walk", "thing"], "de": ["der", "haus", "gehen", "schön"], "fr": ["le", "maison", "aller", "déjà"]}
    rows = [(i, " ".join(stems[k][(i + j) % 4] for j in range(12)), k) for i in range(60) for k in [list(stems)[i % 3]]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    cases = [(1, "the walk", "en"), (2, "maisonette déjà", "fr"), (3, "hausschön", "de"), (4, None, "und"), (5, "123 !", "und")]
    got = language_id.identify(spark.createDataFrame(cases, "doc_id int, text string, want string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [x[2] for x in cases] and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(empty, model).count() == 0 and language_id.train(empty.select("doc_id", "text", "lang")).langs == []


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert 0 < len(out) <= len(kept) <= docs.count() and {r["doc_id"] for r in out} <= kept and all(r["exact"] for r in out)
    assert corpus_pipeline.near_duplicates(spark, docs, folder).columns == docs.columns
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
