"""Personal data: four fixed kinds, and further spans by weak supervision. DataFrame functions only.

Candidates of the further kinds are matches of broad patterns. Three labelers vote on each: a strict rule (check
digits where a kind has them), a gazetteer (country codes with their lengths, numbers known from print, area codes, given names)
and the context before it. The votes are counted over the whole corpus by pattern of votes, of which there are few.
Expectation-maximisation over those counts estimates, for each kind, the share of true spans and each labeler's rates
of right and wrong votes; a logistic classifier over kind, votes, votes by kind and the shape of the surroundings is fitted to
the posteriors. It says yes or no to each pattern, which is what a column expression then looks up.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import whole

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "national_id", "local_phone", "person")
KINDS = BASE + ADDED

# Possessive groups are matched in a loop, so long texts take no stack; a run of name characters or digits is tried once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # a shorter match can't hold 12 digits, nor can its tails
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID_IP = rf"^{PART}\.{PART}\.{PART}\.{PART}$"

# IBAN lengths by country, and social security numbers that were printed as examples.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
PRINTED = r"(?:078-05-1120|219-09-9999|457-55-5462|123-45-6789|987-65-43[0-9]{2}|([0-9])\1{2}-\1{2}-\1{4})"
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
GIVEN = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Mark Paul Steven Andrew George Edward Peter
Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Lisa Margaret Emily Laura Anna Maria Jean Pierre Louis Claude Marie
Sophie Camille Juan Carlos Luis Antonio Carmen Pilar Lucía Hans Klaus Jürgen Wolfgang Ursula Sabine""".split()
# Each begins with a look ahead at what it must start with, which passes over most of a text.
CANDIDATES = {
    "account": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?=[0-9]{3}-)(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "local_phone": r"(?=[(0-9])(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])",
    "person": r"(?=[A-Z])(?<![A-Za-z])(?:" + "|".join(TITLES + GIVEN) + r")\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
}
STRICT = {
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"[ .)-]*[2-9](?!11)[0-9]{2}[.-][0-9]{4}$",
    "person": r"^(?:" + "|".join(TITLES) + r")\.? [A-Z][a-z]+ [A-Z]",
}
GAZETTEER = {
    "account": "^(?:" + "|".join(f"{k}[0-9A-Z]{{{n - 2}}}" for k, n in IBAN.items()) + ")$",
    "national_id": f"^(?!{PRINTED}$)",
    "local_phone": r"^\(?[2-9](?!11)[0-8][0-9]",
    "person": r"(?:^|\.? )(?:" + "|".join(GIVEN) + r")\b",
}
CONTEXT = {
    "account": r"(?i)(?:iban|account|acct|konto|compte|cuenta)\W*(?:no|number|nr)?\W*$",
    "national_id": r"(?i)(?:ssn|social security|id|number|no)\W*$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\W*$",
    "person": r"(?i)(?:name|contact|dear|attn|signed|by|from|sincerely|regards)\W*$",
}
#: Shapes of what stands before a candidate: a mark that announces a value, or the begin of a line.
MARKED, FIRST = r"[:=#]\s*$", r"(?:^|\n)\s*$"
BEFORE, LONG, CHUNK = 24, 14, 128
VOTERS, SHAPES = ("strict", "gazetteer", "context"), ("long", "marked", "first")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,votes:int>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, kind: str, keep, votes=None) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches for which keep(match) holds.

    The texts between matches tell where they stand; they are made only where there is a match. Matches are placed CHUNK at a
    time, from where the chunks before end, so that no long array is copied at each step.
    """
    rank = KINDS.index(kind)
    none = F.array().cast(SPAN)

    def placed(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def begins(steps: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x))
            return F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + x)))

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            vote = votes(F.get(found, i), F.substr(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))) if votes else F.lit(0)
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), vote.cast("int").alias("votes"))
            out = F.when(keep(F.get(found, i)), F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        def spans(at: Column, c: Column) -> Column:
            first = F.struct(F.get(at, c).alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(c * CHUNK, F.least(n, (c + 1) * CHUNK) - 1), first, step)["out"]

        return let(let(steps, begins), lambda at: F.flatten(F.transform(chunks, lambda c: spans(at, c))))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(every, lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(none))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(match: Column) -> Column:
    """Whether 12 to 19 digits have a right check digit."""

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    total = let(F.reverse(digits(match)), lambda x: F.aggregate(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), value), F.lit(0), lambda a, b: a + b))
    n = F.length(digits(match))
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    count = lambda m: F.length(digits(m))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email", lambda m: F.lit(True))).otherwise(F.array().cast(SPAN)),
        matches(text, IP, "ip", lambda m: m.rlike(VALID_IP)),
        matches(text, CARD, "card", luhn),
        F.when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone", lambda m: (count(m) >= 9) & (count(m) <= 15))).otherwise(F.array().cast(SPAN)),
    )


def mod97(match: Column) -> Column:
    """Whether the check digits of an account number are right: the first four moved to the end, letters as 10 to 35, the rest of 97 is 1."""
    bare = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def candidates(text: Column) -> Column:
    """Spans of the added kinds with votes: a bit for each of VOTERS, then of SHAPES; overlaps with fixed kinds are not taken out here."""

    def of(kind: str) -> Column:
        def votes(match: Column, before: Column) -> Column:
            strict = mod97(match) if kind == "account" else match.rlike(STRICT[kind])
            listed = (F.regexp_replace(match, " ", "") if kind == "account" else match).rlike(GAZETTEER[kind])
            tests = (strict, listed, before.rlike(CONTEXT[kind]), F.length(match) >= LONG, before.rlike(MARKED), before.rlike(FIRST))
            return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))

        return matches(text, CANDIDATES[kind], kind, lambda m: F.lit(True), votes)

    return F.concat(*(of(k) for k in ADDED))


def free_of(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def names_of(kind: str, votes: int) -> list[str]:
    """What the classifier sees of a candidate."""
    seen = [v for i, v in enumerate((*VOTERS, *SHAPES)) if votes >> i & 1]
    return [kind, *seen, *(f"{kind}:{v}" for v in seen)]


@dataclass(frozen=True)
class Classifier:
    """Log odds that a candidate is personal data: bias + kind + votes and shapes, of all kinds and of its own."""

    bias: float
    weights: dict[str, float]

    def accepts(self, kind: str, votes: int) -> bool:
        return self.bias + sum(self.weights.get(x, 0.0) for x in names_of(kind, votes)) > 0

    def column(self, span: Column) -> Column:
        out = F.lit(False)
        for kind in ADDED:
            yes = [v for v in range(1 << len(VOTERS + SHAPES)) if self.accepts(kind, v)]
            if yes:
                out = out | ((span["kind"] == kind) & span["votes"].isin(yes))
        return out


Counts = dict[tuple[str, int], int]


def posteriors(counts: Counts, known: Counts | None = None, rounds: int = 50) -> dict[tuple[str, int], float]:
    """Expectation-maximisation for independent voters: the probability that a candidate of a kind with these votes is true.

    known: candidates that are true for certain. They tell how often each labeler is right, but nothing of the share of
    true ones among the others. Each kind has rates of its own. They are smoothed by what a fair labeler would do (right 7 times of 10), so few
    candidates can't turn a labeler over.
    """
    out: dict[tuple[str, int], float] = {}
    for kind in ADDED:
        total: dict[int, int] = {}
        for (k, votes), n in counts.items():
            if k == kind:
                voted = votes & ((1 << len(VOTERS)) - 1)
                total[voted] = total.get(voted, 0) + n
        sure: dict[int, int] = {}
        for (k, votes), n in (known or {}).items():
            if k == kind:
                voted = votes & ((1 << len(VOTERS)) - 1)
                sure[voted] = sure.get(voted, 0) + n
        hit, false, share = [0.7] * len(VOTERS), [0.3] * len(VOTERS), 0.3
        true: dict[int, float] = {}
        for _ in range(rounds):
            for voted in total:
                odds = log(share / (1 - share))
                for i in range(len(VOTERS)):
                    yes = voted >> i & 1
                    odds += log((hit[i] if yes else 1 - hit[i]) / (false[i] if yes else 1 - false[i]))
                true[voted] = 1 / (1 + exp(-odds))
            for rate, prior, weigh, also in ((hit, 0.7, lambda p: p, sure), (false, 0.3, lambda p: 1 - p, {})):
                size = sum(n * weigh(true[v]) for v, n in total.items()) + sum(also.values())
                for i in range(len(VOTERS)):
                    yes = sum(n * weigh(true[v]) for v, n in total.items() if v >> i & 1) + sum(n for v, n in also.items() if v >> i & 1)
                    rate[i] = (yes + 20 * prior) / (size + 20)
            share = (sum(n * true[v] for v, n in total.items()) + 3) / (sum(total.values()) + 10)
        out |= {(kind, v): p for v, p in true.items()}
    return out


def fit(counts: Counts, known: Counts | None = None, rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> Classifier:
    """Logistic regression on the posteriors, each pattern weighted by the logarithm of its count; without candidates the majority of the labelers decides.

    Patterns seen only of known candidates are asked of the model of votes too, with the weight of one candidate.
    """
    counts = {k: 1 for k in known or {}} | counts
    if not counts:
        return Classifier(-1.5, dict.fromkeys(VOTERS, 1.0))
    truth = posteriors(counts, known)
    rows = [(names_of(kind, votes), truth[kind, votes & ((1 << len(VOTERS)) - 1)], 1 + log(n)) for (kind, votes), n in sorted(counts.items())]
    # kinds without candidates here keep the majority's verdict
    seen = {kind for kind, _ in counts}
    rows += [(names_of(kind, v), float(v.bit_count() > 1), 0.5) for kind in ADDED if kind not in seen for v in range(1 << len(VOTERS))]
    bias, weights, size = 0.0, dict.fromkeys(sorted({x for on, _, _ in rows for x in on}), 0.0), sum(w for *_, w in rows)
    for _ in range(rounds):
        steps, step = dict.fromkeys(weights, 0.0), 0.0
        for on, p, w in rows:
            error = w / size * (p - 1 / (1 + exp(-bias - sum(weights[x] for x in on))))
            step += error
            for x in on:
                steps[x] += error
        bias += rate * step
        for x in weights:
            weights[x] += rate * (steps[x] - decay * weights[x])
    return Classifier(bias, weights)


def train(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Counts the votes on all candidates of docs that stand free of fixed spans; the rows that reach the driver are at most 512 patterns, whatever the corpus.

    A local phone number inside a phone span is known to be true; other candidates inside fixed spans tell nothing, and are not counted.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    in_phone = lambda s, t: (t["kind"] == "phone") & (s["kind"] == "local_phone") & (t["start"] <= s["start"]) & (s["end"] <= t["end"])

    def told(found: Column) -> Column:
        def by(base: Column) -> Column:
            known = F.filter(found, lambda s: F.exists(base, lambda t: in_phone(s, t)))
            row = lambda s, sure: F.struct(s["kind"].alias("kind"), s["votes"].alias("votes"), F.lit(sure).alias("known"))
            return F.concat(F.transform(free_of(found, base), lambda s: row(s, False)), F.transform(known, lambda s: row(s, True)))

        return F.when(F.size(found) > 0, let(base_spans(text), by)).otherwise(F.array().cast("array<struct<kind:string,votes:int,known:boolean>>"))

    counts = rows.select(F.inline(let(candidates(text), told))).groupBy("kind", "votes", "known").agg(F.count("*").alias("n")).collect()
    of = lambda known: {(r["kind"], r["votes"]): r["n"] for r in counts if r["known"] == known}
    return fit(of(False), of(True))


def find(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """row (a row of docs whole) and spans: array of (start, rank, end, kind, votes), sorted by start, then kind as in KINDS.

    Code points, end exclusive. docs may have columns of any names, as they stay inside row. Null and empty texts have no
    spans. Fixed kinds may overlap each other; added ones overlap no fixed span. Rows alike are treated alike. Texts of any
    length are read whole. An empty table gives an empty result.
    """
    rows = docs.select(whole(docs), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def merged(base: Column) -> Column:
        return let(F.filter(candidates(text), model.column), lambda more: F.when(F.size(more) > 0, F.sort_array(F.concat(base, free_of(more, base)))).otherwise(F.sort_array(base)))

    return rows.select("row", let(base_spans(text), merged).alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of a result of `find`, with each run of overlapping spans in the text replaced by its first kind, as in [email]; null texts stay null."""
    text, spans = F.col("row").getField(text_col), F.col("spans")

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    ends = lambda x: F.concat(F.array_join(x["out"], ""), F.substr(text, x["at"] + 1, F.length(text)))
    clean = F.when(F.size(spans) > 0, let(F.aggregate(spans, start, step), ends)).otherwise(text)
    names = found.schema["row"].dataType.names
    return found.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names))
