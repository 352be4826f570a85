"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good, votes bad or abstains. Expectation-maximisation over
the vote patterns of all documents estimates how each rule votes on good
and on bad documents, and a document's posterior probability of being good
replaces the all-must-pass filter. Documents that fail the base rules are
rejected outright.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import staged

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
ITERATIONS = 60
#: Prior counts of a rule's votes, as shares of a class's documents: its
#: right vote, its wrong vote, abstaining. Keeps "good" meaning good.
PRIOR_SHARE = 0.2
PRIOR = {"right": 0.6, "wrong": 0.1, "none": 0.3}
START_GOOD = 0.8

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = ("the and of to in a is that it for on with as was at by be this from or are "
                  "der die das und ist nicht ein eine zu den von mit sich auf für im dem "
                  "le la les de et des un une que est en dans pour pas qui sur au "
                  "el los las y del se con por una para su lo").split()

_SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` and, per row: the words, the base figures and
    what the rules look at. Whole texts; a null text is an empty one.

    A window counts as repeated if the same five words stand elsewhere in
    the text. Hashes tell whether a text has any such window; only then are
    the windows themselves sorted to find each, so hash collisions never
    count."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*columns, text.alias("_text"))
    d = d.withColumn("_words", F.filter(F.split("_text", _SPACE), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    d = d.withColumn("n_words", n.cast("long")).withColumn(
        "_at", F.when(n > WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>")))
    w = F.col("_words")
    d = d.withColumn("_hash", F.transform("_at", lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)])))
    d = d.withColumn("_again", F.size(F.array_distinct("_hash")) < F.size("_hash"))
    windows = F.array_sort(F.transform("_at", lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.col("_again"), windows))
    s = F.col("_sorted")
    found = F.array_sort(F.transform(F.filter(s, lambda x, k: 
        F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"])),
                                     lambda x: x["i"]))
    d = d.withColumn("_found", found)
    f = F.col("_found")
    step = F.zip_with(f, F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeat = F.coalesce(F.aggregate(step, F.lit(0), lambda acc, x: acc + x), F.lit(0))
    lines = F.col("_lines")
    return d.select(
        *columns, "n_words",
        F.aggregate("_words", F.lit(0), lambda acc, x: acc + F.length(x)).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect(F.transform("_words", lambda x: F.lower(x)), F.array(*[F.lit(x) for x in FUNCTION_WORDS]))).cast("long").alias("n_function"),
        F.regexp_count("_text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_ends"))


def vote(good: Column, bad: Column) -> Column:
    """1 good, -1 bad, 0 abstains; a rule that says both abstains."""
    return F.when(good & ~bad, F.lit(1)).when(bad & ~good, F.lit(-1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes from the columns of ``measures``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    symbols = F.col("n_symbols") / n
    share = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    distinct = F.col("n_distinct") / n
    ends = F.col("n_ends") / n
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": vote(mean.between(3, 8), ~mean.between(2, 12)),
        "symbols": vote(symbols <= 0.02, symbols > 0.1),
        "symbol_share": vote(share <= 0.005, share > 0.03),
        "repeats": vote(repeat <= 0.02, repeat > 0.1),
        "duplicate_lines": vote(dup <= 0.02, dup > 0.3),
        "variety": vote((distinct >= 0.2) | (F.col("n_words") > 2000), (distinct < 0.1) & (F.col("n_words") <= 2000)),
        "function_words": vote(F.col("n_function") >= 4, F.col("n_function") < 2),
        "sentences": vote(ends.between(0.02, 0.35), (ends > 0.6) | ((ends == 0) & (F.col("n_words") >= 60))),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> tuple[float, list[dict[str, dict[int, float]]]]:
    """(share of good documents, per rule the vote probabilities by class),
    from vote patterns with their document counts."""
    total = sum(c for _, c in patterns)
    k = len(patterns[0][0]) if patterns else 0

    def prior(cls: str) -> dict[int, float]:
        right = 1 if cls == "good" else -1
        return {right: PRIOR["right"], -right: PRIOR["wrong"], 0: PRIOR["none"]}

    share, probs = START_GOOD, [{c: prior(c) for c in ("good", "bad")} for _ in range(k)]
    for _ in range(iterations):
        weight = {"good": 0.0, "bad": 0.0}
        seen = [{c: {-1: 0.0, 0: 0.0, 1: 0.0} for c in ("good", "bad")} for _ in range(k)]
        for votes, count in patterns:
            p = posterior(votes, share, probs)
            for cls, part in (("good", p * count), ("bad", (1 - p) * count)):
                weight[cls] += part
                for j, v in enumerate(votes):
                    seen[j][cls][v] += part
        share = (weight["good"] + START_GOOD) / (total + 1)
        for j in range(k):
            for cls in ("good", "bad"):
                strength = PRIOR_SHARE * weight[cls] + 1
                for v, base in prior(cls).items():
                    probs[j][cls][v] = (seen[j][cls][v] + strength * base) / (weight[cls] + strength)
    return share, probs


def posterior(votes: tuple[int, ...], share: float, probs) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(p["good"][v] / p["bad"][v]) for v, p in zip(votes, probs))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), threshold: float = 0.5, narrow: bool = True) -> DataFrame:
    """Measures, ``base_failed``, the posterior ``p_good`` and ``kept``.

    ``narrow``: measured rows are small and are written once between fit and
    verdict; else (``columns`` hold texts) they are measured again.

    Only counts of vote patterns reach the driver: at most 3 to the power
    of the number of rules, whatever the corpus. Rows of null or empty text
    have no words and fail the base; repeated rows are judged alike; an
    empty table gives no rows."""
    votes = rules()
    names = list(votes)
    measured = measures(docs, columns)
    if not narrow:
        # One struct out of a generator: votes read the figures, they are not worked out again in each.
        own = [c for c in measured.columns if c not in columns]
        measured = measured.select(*columns, F.explode(F.array(F.struct(*own))).alias("_m")).select(*columns, "_m.*")
    judged = measured.withColumn("base_failed", base_failed())
    judged = judged.withColumns({f"_v_{r}": c.cast("int") for r, c in votes.items()})
    if narrow:
        judged = staged(judged, "quality")
    # The model explains documents that the base rules leave open.
    counts = judged.where(~F.col("base_failed")).groupBy(*[f"_v_{r}" for r in names]).agg(F.count("*").alias("n")).collect()
    share, probs = fit(sorted((tuple(row[:-1]), row[-1]) for row in counts))
    odds = F.lit(math.log(share / (1 - share)))
    for r, p in zip(names, probs):
        v = F.col(f"_v_{r}")
        by = {x: math.log(p["good"][x] / p["bad"][x]) for x in (-1, 0, 1)}
        odds = odds + F.when(v == 1, by[1]).when(v == -1, by[-1]).otherwise(by[0])
    return (judged.withColumn("p_good", 1 / (1 + F.exp(-odds)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
            .drop(*[f"_v_{r}" for r in names]))


def kept_rows(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. A row's
    votes follow from its text alone, so the rows are judged in place from
    the fitted model; no join brings them back."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = judge(d, ("row",), threshold, narrow=False).where("kept").select("row")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
