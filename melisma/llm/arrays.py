"""Vectorised text primitives shared by the operators: columns of bytes, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space that separates words; every other byte belongs to a word.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
BASE, SEED = 0x9E3779B97F4A7C15 | 5, 20240917
#: Bytes worked on at a time: the arrays made of so many stay in a core's cache.
CHUNK_BYTES = 1 << 17
#: The lowest 0 to 8 bytes of a number; words beyond LONG_WORD bytes are hashed one by one.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
LONG_WORD = 1 << 10

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SPACES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self


POWERS = Powers()


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes, after one pass of prefix sums."""

    def __init__(self, codes: np.ndarray) -> None:
        powers = POWERS.upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * powers.up[: len(codes)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """mix(hash of codes[start:end] and its length), for arrays of bounds."""
        value = (self.sums[end] - self.sums[start]) * POWERS.down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each slice of this width, by its start."""
        n = max(len(self.sums) - width, 0)
        return mix((self.sums[width:] - self.sums[:n]) * POWERS.down[:n] + np.uint64(width))


class Texts:
    """Some rows of an Arrow string column as one byte array; nulls are empty texts."""

    def __init__(self, column: pa.Array, first_row: int) -> None:
        self.first_row, self.rows = first_row, len(column)
        self.raw = [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
        self.ends = np.cumsum([len(x) for x in self.raw], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

    def words(self, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bound): bytes of each word; words of row r are bound[r]:bound[r + 1]."""
        inside = in_word[self.bytes]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.starts[self.starts < len(inside)]] = True  # a text's words never join its neighbour's
        cuts = np.append(np.flatnonzero(edge[:-1]), len(inside))
        kept = inside[cuts[:-1]] if len(inside) else np.zeros(0, dtype=bool)
        start, end = cuts[:-1][kept], cuts[1:][kept]
        return start, end, np.append(np.searchsorted(start, self.starts), len(start))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column in runs of rows of about `most` bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)) if len(column) else []
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield Texts(column.slice(begin, i - begin), begin)
            begin, total = i, 0
        total += size
    if begin < len(column):
        yield Texts(column.slice(begin), begin)


def word_codes(text: Texts, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit code of each word. fold: what byte each byte counts as.

    The bytes are mixed in eight at a time, each step one-to-one, so words of equal length up to eight bytes
    never share a code, and no family of longer ones does by construction (a polynomial modulo 2**64 has such).
    """
    data = text.bytes if fold is None else fold[text.bytes]
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    size = end - start
    codes = size.astype(np.uint64) * np.uint64(BASE)
    left, at = np.arange(len(start)), 0
    while len(left):
        some = eights[start[left] + at].view("<u8")[:, 0] & MASKS[np.minimum(size[left] - at, 8)]
        codes[left] = mix(codes[left] ^ mix(some + np.uint64(SEED)))
        at += 8
        left = left[size[left] > at]
        if at >= LONG_WORD:
            codes[left] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes(), SEED) for a, b in zip(start[left].tolist(), end[left].tolist(), strict=True)]
            break
    return codes


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of this width, the position of its least value (high 32 bits), the leftmost of equals.

    Block-wise prefix and suffix minima: a constant number of passes at any width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-len(values) // width)
    keyed = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keyed[: len(values)] = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    keyed = keyed.reshape(blocks, width)
    before = np.minimum.accumulate(keyed, axis=1).ravel()
    after = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mask over n places: those in any of the runs begin:end."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def run_bounds(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The begins and ends of the runs of True."""
    steps = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
