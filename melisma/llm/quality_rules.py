"""Quality rules: fixed base rules, and a learned decision list in native Spark expressions.

Features are column expressions over a text. The list is learned by sequential covering from labelled
features: a rule starts empty and grows by the threshold test that gains most on the growing half of the
sample, until it is pure enough; it is then pruned from its end while that raises its precision on the other half.
Rows it covers are removed and the next rule is grown. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import whole

SPACES = "\t\n\x0b\f\r "
#: What a sample of labelled rows has at most; it is all that reaches the driver, as numbers.
SAMPLE = 4_000
FEATURES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bar_share", "bang_share")
#: A rule must cover this many rows of the growing half, with this precision on the pruning half.
LEAST_COVER, LEAST_PRECISION, MOST_TESTS, MOST_RULES, CUTS = 8, 0.95, 4, 12, 24


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.bound if self.above else row[self.feature] <= self.bound

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.bound) if self.above else F.col(self.feature) <= F.lit(self.bound)


Rule = tuple[Test, ...]


def words_of(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """row (a row of docs whole), text and the base counts beside it, in one pass and without exchange."""
    has_word = f"[^{SPACES}]"
    rows = docs.select(whole(docs), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("n", F.size("words"))
    # the hash of each three words in a row; a text without a repeat needs no more
    at = F.sequence(F.lit(0), F.col("n") - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("windows", F.when(F.col("n") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeats, placed))
    again = F.filter(
        F.transform(
            "placed",
            lambda x, j: F.when((x["h"] == F.get("placed", j - 1)["h"]) | (x["h"] == F.get("placed", j + 1)["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("again", F.sort_array(again))
    # a window adds its three words less those that the next repeated window also has
    added = F.aggregate(
        F.transform("again", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("again", j + 1) - i, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(has_word))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "row",
        "text",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(added, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("place"),
    )


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of with_base that meet the condition, tested after the features are made.

    A filter pushed below would put copies of the feature expressions into one another. It can't pass a
    column that is not deterministic and in use.
    """
    return rows.where((F.col("place") >= 0) & condition)


def with_features(rows: DataFrame) -> DataFrame:
    """rows of with_base with the columns of FEATURES; empty texts have zeros."""
    share = lambda n, d: F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))
    chars = F.col("word_chars")
    columns = {
        "mean_word_chars": share(chars, F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), chars),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "upper_share": share(chars_of("[^A-Z]+"), chars),
        "digit_share": share(chars_of("[^0-9]+"), chars),
        "bar_share": share(chars_of(r"[^|]+"), F.col("n_words")),
        "bang_share": share(chars_of("[^!]+"), F.col("n_words")),
    }
    return rows.select("*", *(v.alias(k) for k, v in columns.items()))


def chars_of(complement: str) -> Column:
    return F.length(F.regexp_replace("text", complement, ""))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before)))


def cuts(rows: list[dict], feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return middles if len(middles) <= CUTS else [middles[i * len(middles) // CUTS] for i in range(CUTS)]


def precision(rows: list[dict], rule: Rule) -> tuple[float, int]:
    covered = [r["bad"] for r in rows if all(t.holds(r) for t in rule)]
    return (sum(covered) + 1) / (len(covered) + 2), len(covered)


def learn(rows: list[dict]) -> list[Rule]:
    """Rules that tell bad rows (bad: 1) from good ones; a dict has FEATURES and bad. Rows alternate between growing and pruning."""
    growing, pruning, rules = rows[::2], rows[1::2], []
    while len(rules) < MOST_RULES:
        rule, covered = (), growing
        while len(rule) < MOST_TESTS:
            bad = sum(r["bad"] for r in covered)
            if not bad or bad == len(covered):
                break
            best, best_gain = None, 1e-9
            for feature in FEATURES:
                for bound in cuts(covered, feature):
                    above = [r["bad"] for r in covered if r[feature] > bound]
                    for side, n, b in ((True, len(above), sum(above)), (False, len(covered) - len(above), bad - sum(above))):
                        if n >= LEAST_COVER and (g := gain(b, n - b, bad, len(covered) - bad)) > best_gain:
                            best, best_gain = Test(feature, side, bound), g
            if best is None:
                break
            rule, covered = (*rule, best), [r for r in covered if best.holds(r)]
        while len(rule) > 1 and precision(pruning, rule[:-1]) >= precision(pruning, rule):
            rule = rule[:-1]
        value, n = precision(pruning, rule)
        if not rule or not n or value < LEAST_PRECISION * (n + 1) / (n + 2) or n < LEAST_COVER // 2:
            break
        rules.append(rule)
        growing, pruning = ([r for r in part if not all(t.holds(r) for t in rule)] for part in (growing, pruning))
    return rules


def sample_of(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> list[dict]:
    """Features of at most `sample` labelled rows, those of least hash of the id; the order is the hash's."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = only(with_features(with_base(rows.join(F.broadcast(marked), "doc_id"), "text")), ~base_failed())
    found = found.select("row.h", "row.doc_id", *FEATURES, (F.col("row.quality") == 0).cast("int").alias("bad")).orderBy("h", "doc_id", *FEATURES).limit(sample)
    return [r.asDict() for r in found.collect()]


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: one CASE, in the order of the rules."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def assess(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """row (a row of docs whole), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and place for `only`.

    docs may have columns of any names, these included, as they stay inside row. A null text has no words and fails the
    base rules, as does an empty one. Rows alike are judged alike. Texts of any length are read whole.
    An empty table gives an empty result.
    """
    rows = with_features(with_base(docs, text_col)).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & verdict(rules)
    return rows.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "place")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learned from at most `sample` rows with a label (doc_id, quality 0 or 1); none of empty tables."""
    return learn(sample_of(docs, labels, sample, id_col, text_col))
