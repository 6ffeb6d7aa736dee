"""Column builders for text analysis; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import ACCENTED, CUE_WORDS, CUES, DEFAULT_LANGUAGE, LEAST_STEM, LEAST_WORD, PLAIN, STOPWORDS, SUFFIXES

#: One white space character, as str.isspace has it.
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """What white space separates; null has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE[1:-1]}]+")).cast("long")


def first_words(text: Column, most: int) -> Column:
    """The first words; what comes after them is not cut up."""
    found = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", most + 2)  # a blank begin is a part, and so is the rest
    return F.slice(F.filter(found, lambda w: w != ""), 1, most)


def fold(text: Column) -> Column:
    """Lower case without the accents of ACCENTED; other accented letters stay."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of a-z of the folded text."""
    return F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit("[a-z]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def language(text: Column) -> Column:
    """The language most of whose cue words are among the first words; the first of equals; the default without any."""

    def scores(first: Column) -> Column:
        return F.array(*(F.size(F.array_intersect(first, F.array(*map(F.lit, v)))) for v in CUES.values()))

    def best(found: Column) -> Column:
        most = F.array_max(found)
        name = F.get(F.array(*map(F.lit, CUES)), F.array_position(found, most).cast("int") - 1)
        return F.when(most == 0, F.lit(DEFAULT_LANGUAGE)).otherwise(name)

    return let(F.array_distinct(F.transform(first_words(text, CUE_WORDS), F.lower)), lambda first: let(scores(first), best))


def by_language(lang: Column, make, names=tuple(STOPWORDS)) -> Column:
    """make(name) for the row's language; unknown languages count as the default."""
    out = F.when(lang == names[0], make(names[0]))
    for name in names[1:]:
        out = out.when(lang == name, make(name))
    return out.otherwise(make(DEFAULT_LANGUAGE))


def kept(found: Column, name: str) -> Column:
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS[name]))


def without_stopwords(found: Column, lang: Column) -> Column:
    """Tokens of at least two letters that are no stop words of the language."""
    return let(found, lambda x: by_language(lang, lambda name: kept(x, name)))


def stem(word: Column, name: str) -> Column:
    """The word less the first suffix of the language that leaves enough letters."""
    out = F.when(F.length(word) < LEAST_WORD, word)
    for suffix, new in SUFFIXES[name]:
        left = F.length(word) - len(suffix)
        out = out.when(word.endswith(suffix) & (left + len(new) >= LEAST_STEM), F.concat(F.substring(word, F.lit(1), left), F.lit(new)))
    return out.otherwise(word)


def terms(text: Column, lang: Column) -> Column:
    """Tokens, less stop words, stemmed."""
    stemmed = lambda x, name: F.transform(kept(x, name), lambda t: stem(t, name))
    return let(lang, lambda own: let(tokens(text), lambda x: by_language(own, lambda name: stemmed(x, name))))
