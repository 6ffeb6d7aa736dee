"""Byte-level BPE encoding and decoding with the tokenizers library.

Bytes are mapped to printable characters, the alphabet of byte-level vocabularies; pieces of text (matches of
the split pattern) are encoded by the library in batches and kept, so a repeated piece costs one look-up.
Decoding joins the tokens' characters and maps each back to its byte through the reversed table; a character that is
split over tokens is whole again once their bytes are joined.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "doc_id long, ids binary, decoded binary, n_split long"
#: Pieces that a worker keeps; beyond it starts afresh.
KEPT_PIECES = 150_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    shown = set(prints)
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def simple_pattern(pattern: str, below: int = 0x250) -> re.Pattern:
    """The split pattern for texts of characters under `below`, with its classes written out."""

    def members(kind: str) -> str:
        inside = [bool(regex.match(kind, chr(c))) for c in range(below)]
        runs, begin = [], None
        for c, yes in enumerate([*inside, False]):
            if yes and begin is None:
                begin = c
            elif not yes and begin is not None:
                runs.append(f"\\u{begin:04x}-\\u{c - 1:04x}")
                begin = None
        return "".join(runs)

    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    inner = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(inner.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


class Codec:
    """Encodes as greedy lowest-rank merging within each piece does; decodes identifiers."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, models

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.characters = byte_characters()
        shown = lambda token: "".join(self.characters[b] for b in token)
        merges = []  # every split of a token into two tokens is a merge of the token's rank
        for token, rank in ranks.items():
            halves = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += [(rank, ranks[a], ranks[b], shown(a), shown(b)) for a, b in halves if a in ranks and b in ranks]
        merges.sort()
        self.library = Tokenizer(models.BPE({shown(k): v for k, v in ranks.items()}, [x[3:] for x in merges]))
        self.table = {b: c for b, c in enumerate(self.characters)}
        self.back = np.zeros(512, dtype=np.uint8)  # the byte that each character stands for
        self.back[[ord(c) for c in self.characters]] = np.arange(256)
        self.shown = [""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.shown[rank] = shown(token)
        self.sizes = np.array([len(x) for x in self.shown], dtype=np.int64)
        self.any, self.simple = regex.compile(pattern), simple_pattern(pattern)
        self.beyond = re.compile("[^\x00-ɏ]")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return [m.group() for m in self.any.finditer(text)] if self.beyond.search(text) else self.simple.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pieces(x) for x in texts]
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        known = self.known
        new = list({p for x in split for p in x}.difference(known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            mapped = [p.encode().decode("latin-1").translate(self.table) for p in some]
            found = self.library.encode(mapped, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            of = np.array(found.word_ids, dtype=np.int64)
            bounds = (4 * np.searchsorted(of, np.arange(len(some) + 1))).tolist()
            data = ids.tobytes()
            known.update({p: data[a:b] for p, a, b in zip(some, bounds, bounds[1:], strict=False)})
        get = known.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        characters = "".join(map(self.shown.__getitem__, numbers.tolist())).encode("utf-16-le")
        return self.back[np.frombuffer(characters, dtype="<u2")].tobytes()

    def ends(self, ids: bytes) -> np.ndarray:
        """Where each token ends, in bytes of the text."""
        return np.cumsum(self.sizes[np.frombuffer(ids, dtype="<u4")])

    def splits(self, ids: bytes, data: bytes) -> int:
        """How many tokens end inside a character."""
        ends = self.ends(ids)[:-1]
        return int(((np.frombuffer(data, dtype=np.uint8)[ends] & 0xC0) == 0x80).sum()) if len(ends) else 0

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """For each token of the text, the code points [start, end) that it holds a byte of."""
        ends = self.ends(self.encode([text])[0])
        place = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
        return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def batches_of(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, list[str]]]:
    held, size, begin = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if held and size + len(text) > most:
            yield begin, held
            held, size, begin = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (their bytes), n_split (tokens that end inside a character), one row per row of docs.

    A null text counts as empty and has no identifiers. Strings of special tokens are ordinary text. Other
    columns are not read; rows alike each get their result; keep_text adds the text as a last column. Texts of any length are
    coded whole. An empty table gives an empty result. ranks_path is read on the executors, where the vocabulary is installed.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        coder(ranks_path, pattern, keep_text), RESULT + ", text string" * keep_text
    )


def coder(ranks_path: str, pattern: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        for batch in batches:
            for begin, texts in batches_of(batch.column("text")):
                ids = codec.encode(texts)
                decoded = [codec.decode(x) for x in ids]
                columns = {"doc_id": batch.column("doc_id").slice(begin, len(texts)), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary())}
                columns["n_split"] = pa.array([codec.splits(i, x) for i, x in zip(ids, decoded, strict=True)], pa.int64())
                if keep_text:
                    columns["text"] = batch.column("text").slice(begin, len(texts))
                yield pa.RecordBatch.from_pydict(columns)

    return run


CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    if (ranks_path, pattern) not in CODECS:
        CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return CODECS[ranks_path, pattern]
