"""Spelling variants: words one error apart, by forward and backward minimal acyclic automata with word numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Words of at least so many code points and occurrences; a form occurs at least so many times as often as its word.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many, by its hash, loses a code point.
ONE_IN = 97
#: Words that one automaton holds.
HELD = 20_000
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Automaton:
    """The least deterministic automaton of a set of words, given in order, once each. A word's number is its place in that order."""

    def __init__(self, words: Iterator[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.sizes: dict[int, int] = {}
        self.skips: dict[int, dict[str, int]] = {}
        known: dict[tuple, int] = {}
        path, before, free = [0], "", []

        def settle(depth: int) -> None:
            """Number the states below `depth` of the last word, and merge them with equal ones that are known."""
            while len(path) > depth + 1:
                state, letter = path.pop(), before[len(path) - 1]
                key = (self.final[state], *self.arcs[state].items())
                same = known.setdefault(key, state)
                if same != state:
                    self.arcs[path[-1]][letter] = same
                    free.append(state)
                else:
                    self.count(state)

        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            settle(shared)
            for letter in word[shared:]:
                if free:
                    state = free.pop()
                    self.arcs[state], self.final[state] = {}, False
                else:
                    state = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                self.arcs[path[-1]][letter] = state
                path.append(state)
            self.final[path[-1]] = True
            before = word
        settle(0)
        self.count(0)

    def count(self, state: int) -> None:
        """How many words go on from a state; for each arc, how many of these come before those through it."""
        n, skips = int(self.final[state]), {}
        for letter, to in self.arcs[state].items():  # in order, as words came in order
            skips[letter] = n
            n += self.sizes[to]
        self.skips[state], self.sizes[state] = skips, n

    def walk(self, state: int, letters: str, number: int = 0) -> tuple[int, int]:
        """(state, number) after exact letters; state -1 if there is no such path."""
        for letter in letters:
            to = self.arcs[state].get(letter, -1)
            if to < 0:
                return -1, 0
            number += self.skips[state][letter]
            state = to
        return state, number

    def number(self, word: str) -> int:
        """The word's number; -1 if it is not held."""
        state, number = self.walk(0, word)
        return number if state >= 0 and self.final[state] else -1

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that are `half` and then `rest` with exactly one letter inserted, deleted or replaced."""
        found: set[int] = set()
        state, number = self.walk(0, half)

        def finish(state: int, letters: str, number: int) -> None:
            state, number = self.walk(state, letters, number)
            if state >= 0 and self.final[state]:
                found.add(number)

        for i in range(len(rest) + 1):
            if state < 0:
                break
            if i < len(rest):
                finish(state, rest[i + 1 :], number)  # a letter deleted
            for letter, to in self.arcs[state].items():
                after = number + self.skips[state][letter]
                finish(to, rest[i:], after)  # a letter inserted
                if i < len(rest) and letter != rest[i]:
                    finish(to, rest[i + 1 :], after)  # a letter replaced
            if i < len(rest):
                state, number = self.walk(state, rest[i], number)
        return found


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): runs with A-Z in lower case; where 97 divides the hash of id and run, less one code point."""
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("raw"))
    rows = rows.select("id", F.translate("raw", UPPER, UPPER.lower()).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def meetings(words: DataFrame) -> DataFrame:
    """(backward, half, asked, word, n): a word asks under one half of its letters in each direction, and is held wherever a near word could ask.

    A word of L letters asks by its first L // 2 and by its last L - L // 2; of one error, one of these is free. A near
    word has one letter less or more at most, so each word is held under the halves of these three lengths. Backward
    words are spelled from their end.
    """
    length = F.length("word")

    def rows(backward: bool) -> Column:
        spelled = F.reverse("word") if backward else F.col("word")
        cut = lambda n: F.substring(spelled, F.lit(1), (n - F.floor(n / 2) if backward else F.floor(n / 2)).cast("int"))
        row = lambda half, asked: F.struct(F.lit(backward).alias("backward"), half.alias("half"), F.lit(asked).alias("asked"), spelled.alias("spelled"))
        held = F.array_distinct(F.array(*(cut(length + d) for d in (-1, 0, 1))))
        return F.concat(F.array(row(cut(length), True)), F.transform(held, lambda half: row(half, False)))

    return words.select(F.inline(F.concat(rows(False), rows(True))), "n")


def pairs_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form, form_n): what each word finds among those that share its half. Rows come by half: those that ask, then those held, in order.

    A half with more held words than one automaton takes is cut; each part is asked by all that ask.
    """
    group, asking, held, out = None, [], {}, []

    def answer() -> None:
        """Ask the held words, and let them go."""
        if any(len(held) > 1 or word not in held for word, _ in asking[:2]) and held:
            automaton, words, counts = Automaton(iter(held)), list(held), list(held.values())
            backward, half = group
            for word, n in asking:
                rest = word[len(half) :]
                near = automaton.one_error(half, rest)
                if backward:  # what has the first half too was found forward
                    near = [k for k in near if not words[k].endswith(rest)]
                if near:
                    best = min(near, key=lambda k: (-counts[k], words[k][::-1] if backward else words[k]))
                    enough = counts[best] >= TIMES * n
                    spelled = [word, words[best] if enough else None]
                    word_of, form = [s and s[::-1] for s in spelled] if backward else spelled
                    out.append((word_of, len(near), form, counts[best] if enough else None))
        held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

    for batch in batches:
        for way, half, asked, spelled, n in zip(*(batch.column(k).to_pylist() for k in ("backward", "half", "asked", "spelled", "n")), strict=True):
            if (way, half) != group:
                answer()
                group, asking = (way, half), []
            if asked:
                asking.append((spelled, n))
            else:
                if len(held) == HELD:
                    answer()
                held[spelled] = n
        if out:
            yield flush()
    answer()
    yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have a near word; form is null where no near word is frequent enough."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = meetings(words).repartition(parts, "backward", "half").sortWithinPartitions("backward", "half", F.desc("asked"), "spelled")
    found = met.mapInArrow(pairs_found, "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last of a word's forms, itself if it has none. Pointers are doubled until none moves."""
    at = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        on = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return forms.join(at, "word")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts with the frequent word that each may be a variant of.

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n (ties: least in code-point order) if that occurs at least twice as often; forms have ever larger n, so following them ends. Null and
    empty texts have no words; texts of any length are read whole; rows alike count each. A null id hashes as an empty one. Other
    columns are not read. An empty table gives an empty result.
    """
    words = stage(word_counts(docs, id_col, text_col), "words")
    forms = stage(words.join(near_words(words), "word", "left").select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "forms")
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
