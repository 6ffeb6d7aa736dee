import random

from pyspark.sql import functions as F

from melisma.functions import text as T
from melisma.functions.similarity import similarity
from melisma.functions.tables import CUES, LEAST_STEM, LEAST_WORD, SUFFIXES

GOLDEN = [
    ("iendo", "es", "iendo"), ("ieron", "es", "iero"), ("cancion", "es", "cancio"), ("happiness", "en", "happines"), ("being", "en", "being"),
    ("nation", "en", "nat"), ("studied", "en", "studi"), ("vraiment", "fr", "vraim"), ("canzione", "it", "canzion"), ("sing", "en", "sing"),
]


def test_stems_golden(spark):
    rows = spark.createDataFrame(GOLDEN, "w string, lang string, want string")
    for name in SUFFIXES:
        for r in rows.where(F.col("lang") == name).select("w", "want", T.stem(F.col("w"), name).alias("got")).collect():
            assert r["got"] == r["want"], r


def test_stems_random(spark):
    rnd = random.Random(7)
    ends = sorted({s for rules in SUFFIXES.values() for s, _ in rules})
    words = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(1, 5))) + rnd.choice(ends) for _ in range(400)]

    def plain(word, name):
        if len(word) < LEAST_WORD:
            return word
        fits = (word[: len(word) - len(s)] + new for s, new in SUFFIXES[name] if word.endswith(s))
        return next((x for x in fits if len(x) >= LEAST_STEM), word)

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", *(T.stem(F.col("w"), k).alias(k) for k in SUFFIXES))
    for r in rows.collect():
        assert all(r[k] == plain(r["w"], k) for k in SUFFIXES), r


def test_language(spark):
    cases = [("", "en"), (None, "en"), ("la le", "fr"), ("el los más", "es"), ("the, of,", "en"), ("la", "es"), ("a", "pt"), (" ".join(["x"] * 200) + " della che non", "en")]
    got = spark.createDataFrame(cases, "t string, want string").select("t", "want", T.language(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [w for _, w in cases]
    assert all(len(set(v)) == 12 for v in CUES.values())


def test_tokens_and_words(spark):
    row = spark.createDataFrame([("Él a1b ñandú Größe\x1cz", None)], "t string, n string").select(T.tokens(F.col("t")).alias("t"), T.word_count(F.col("t")).alias("n"), T.word_count(F.col("n")).alias("z"), T.strip(F.lit("  x\t")).alias("s")).first()
    assert row["t"] == ["el", "a", "b", "nandu", "gr", "e", "z"] and row["n"] == 5 and row["z"] == 0 and row["s"] == "x"


def test_similarity(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("", "x"), (None, "x"), ("ABC", "abc"), ("ab", "a" * 250)]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity(F.col("a"), F.col("b")).alias("s")).collect()
    want = [SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]
    assert [r["s"] for r in got] == want and want[0] != want[1]
