"""The registered queries against plain Python over the whole smallest tables."""

import base64
import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

from melisma.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, FOLDER).collect()}


@pytest.fixture(scope="module")
def run(spark, docs):
    def rows(name):
        found = queries.QUERIES[name](spark, FOLDER).collect()
        assert sorted(r["doc_id"] for r in found) == sorted(docs)
        return {r["doc_id"]: r for r in found}

    return rows


def gone(sequences, width):
    every = Counter(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width] for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if every[tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width]] > 1:
                mask[i : i + width] = b"\1" * width
        out.append(mask)
    return out


def test_op1(run, docs):
    words = [WORD.findall(t) for t in docs.values()]
    for r, w, mask in zip(map(run("op1_substring_dedup").get, docs), words, gone(words, 35), strict=True):
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(mask), sha(kept))


def test_op9(run, docs):
    data = [t.encode() for t in docs.values()]
    short = gone(data, 200)
    for r, d, mask, passage in zip(map(run("op9_suffix_dedup").get, docs), data, gone(data, 400), short, strict=True):
        kept = bytes(x for x, m in zip(d, mask, strict=True) if not m)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), sum(mask), len(re.findall(b"\1+", bytes(mask))), sha(kept))
        assert r["n_passage"] == sum(passage)


def listed(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in found))


def parsed(spans):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def test_op2(run, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = ("assign", "access", "hex")
    got = run("op2_secret_scan")
    for i, t in docs.items():
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        r = got[i]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds] and r["base_sha256"] == sha(listed(base, kinds))
        assert [x for x in parsed(r["spans"]) if x[0] in kinds] == parsed(listed(base, kinds))


def test_op3(run, docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, t in zip(map(run("op3_byte_bpe").get, docs), docs.values(), strict=True):
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t))
        ends, at = 0, 0
        for token in ids[:-1]:
            at += len(library.decode_single_token_bytes(token))
            ends += t.encode()[at] & 0xC0 == 0x80
        assert r["n_split"] == ends


def test_op4(run, docs):
    prints = {}
    for i, t in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(len(w) - 3, bool(w)))]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {i: i for i in sorted(docs)}
    changed = True
    while changed:
        changed = False
        for a in component:
            least = min(component[b] for b in component if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed, component[a] = changed or least < component[a], min(component[a], least)
    got = run("op4_simhash")
    assert all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", component[i]) for i in docs)


def test_op5(run, docs):
    got = run("op5_quality_rules")
    for i, t in docs.items():
        w = WORD.findall(t)
        times = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}
        base["base_failed"] = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert all(got[i][k] == v for k, v in base.items()) and not (got[i]["base_failed"] and got[i]["kept"])
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_op6(run, docs):
    kinds = ("email", "ip", "card", "phone")
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    got = run("op6_pii")
    for i, t in docs.items():
        base = [(k, m.start(), m.end()) for k, p, keep in rules for m in re.finditer(p, t) if keep(m[0])]
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds] and got[i]["base_sha256"] == sha(listed(base, kinds))
        spans = parsed(got[i]["spans"])
        assert [x for x in spans if x[0] in kinds] == parsed(listed(base, kinds))
        assert not any(a < y and x < b for k, a, b in spans if k not in kinds for _, x, y in base)


def test_op7(spark, run, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(len(w) - 9, bool(w))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r["item_id"]))
    got, sizes = run("op7_fm_index"), {len(k) for k in windows}
    for i, t in docs.items():
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= own
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))


def test_op8_op10(run, docs):
    assert all(0 <= r["p_toxic"] <= 1 and r["toxic"] == (r["p_toxic"] > 0.5) for r in run("op8_toxicity").values())
    import zlib

    got = run("op10_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
