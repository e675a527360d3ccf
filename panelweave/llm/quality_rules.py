"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Native: DataFrame functions only. Each document becomes one row of counts, the counts become
votes (1 good, -1 bad, 0 abstain), and the votes of all documents become a table of patterns with
their counts. That table has at most 3 ** len(rules()) rows whatever the size of the corpus, and the
model is fitted on it alone, so the text is read once.

Junk comes in kinds that exclude each other, so most rules call a bad document good. The model starts
from that: a rule that votes finds 15 % of the bad documents, and is wrong on one good one in 500. What each
rule finds in truth, and the share of good documents, is learned without bounds. Rules confirm each
other: what one rule alone calls bad is bad if that rule agrees with others elsewhere.

Defined results: a null or empty text has no words and fails the base; repeated rows are judged
alike; columns besides the id and the text take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """One row of counts per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_kinds, n_digits, n_letters, n_capitals, n_letter_words, n_stutter."""
    text, words, lines, hashes = F.col("__text"), F.col("__words"), F.col("__lines"), F.col("__hashes")
    step = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    step = step.select("doc_id", "__text", F.array_remove(F.split(text, WORD_GAP), "").alias("__words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_GAP)).alias("__lines"))
    step = step.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.transform(F.sequence(F.lit(1), F.size(hashes) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    step = step.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct(hashes)).cast("bigint").alias("n_kinds"),
        F.regexp_count(text, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("bigint").alias("n_letter_words"),
        F.size(F.filter(hashes, lambda h, i: h == F.get(hashes, i - 1))).cast("bigint").alias("n_stutter"),
        F.when(F.size(hashes) >= window, starts).otherwise(F.array().cast("array<bigint>")).alias("__starts"),
    )
    step = step.withColumn("__some", F.size(F.array_distinct("__starts")) < F.size("__starts"))
    # only documents with a repeated window are sorted: equal windows become neighbours
    step = step.withColumn("__sorted", F.when(F.col("__some"), F.sort_array(F.transform("__starts", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("__again", F.sort_array(_repeated(F.col("__sorted"))))
    covered = F.when(F.col("__some"), _covered(F.col("__again"), window)).otherwise(F.lit(0)).cast("bigint")
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_kinds", "n_digits", "n_letters", "n_capitals", "n_letter_words", "n_stutter", covered.alias("n_repeat_words"))


def _repeated(pairs: Column) -> Column:
    """Places whose window has an equal one, from (hash, place) pairs in order."""
    same = lambda k, other: F.get(pairs, k)["h"] == F.get(pairs, other)["h"]
    at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    return F.transform(at, lambda k: F.get(pairs, k)["i"])


def _covered(places: Column, window: int) -> Column:
    """Words in the windows that begin at these places, in order."""
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of text_counts()."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    return {
        "length": vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        "repetition": vote(F.col("n_repeat_words") * 100 > n * 20, F.col("n_repeat_words") * 100 <= n * 2),
        "symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 <= n),
        "word_length": vote((chars < n * 3) | (chars > n * 10), (chars >= n * 4) & (chars <= n * 7)),
        "dup_lines": vote(F.col("n_dup_lines") * 10 > lines * 3, F.col("n_dup_lines") * 20 <= lines),
        "variety": vote((F.col("n_words") >= 50) & (F.col("n_kinds") * 10 < n) & (F.col("n_kinds") < 200), F.col("n_kinds") * 4 >= n),
        "digits": vote(F.col("n_digits") * 10 > chars * 3, F.col("n_digits") * 20 <= chars),
        "letters": vote(F.col("n_letters") * 10 < chars * 8, F.col("n_letters") * 100 >= chars * 93),
        "letter_words": vote(F.col("n_letter_words") * 10 < n * 8, F.col("n_letter_words") * 100 >= n * 95),
        "capitals": vote(F.col("n_capitals") * 10 > letters * 3, F.col("n_capitals") * 10 <= letters),
        "stutter": vote(F.col("n_stutter") * 10 > n, F.col("n_stutter") * 100 <= n),
    }


#: At the start: the share of good documents, a rule's right votes among those on good documents, and on bad ones.
START = (0.9, 0.998, 0.15)


def fit(votes: DataFrame, names: list[str], strength: float = 20.0, rounds: int = 50) -> dict:
    """The share of good documents, and of right votes by rule on good and on bad documents, by expectation-maximisation.

    votes: a column per rule and `n`, the documents with that pattern. A rule that abstains says
    nothing. START counts as `strength` votes of each rule on either class, and as half as many documents,
    so the classes keep their meaning and no share becomes 0 or 1.
    """
    prior, good, bad = START
    model = {"good": prior, "right": {k: (good, bad) for k in names}}
    for _ in range(rounds):
        p = posterior(model)
        sums = votes.select("n", p.alias("p"), *names).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good"),
            *(F.sum(F.when(F.col(k) == v, F.col("n") * w)).alias(f"{k}_{v}_{c}") for k in names for v in (1, -1) for c, w in (("g", F.col("p")), ("b", 1 - F.col("p")))),
        ).first()
        if not sums["n"]:
            return model
        old = model
        rate = lambda right, wrong, start: ((right or 0) + start * strength) / ((right or 0) + (wrong or 0) + strength)
        model = {"good": (sums["good"] + prior * strength / 2) / (sums["n"] + strength / 2), "right": {k: (rate(sums[f"{k}_1_g"], sums[f"{k}_-1_g"], good), rate(sums[f"{k}_-1_b"], sums[f"{k}_1_b"], bad)) for k in names}}
        if max(abs(model["good"] - old["good"]), *(abs(a - b) for k in names for a, b in zip(model["right"][k], old["right"][k], strict=True))) < 1e-3:
            break
    return model


def posterior(model: dict) -> Column:
    """Probability that a document is good, from its votes."""
    score = F.lit(log(model["good"] / (1 - model["good"])))
    for k, (g, b) in model["right"].items():
        score += F.when(F.col(k) == 1, log(g / (1 - b))).when(F.col(k) == -1, log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Counts, base_failed, p_good and kept of each document; kept is false where the base fails."""
    counts = materialize(text_counts(docs, id_col, text_col), "counts")
    named = rules()
    votes = counts.select("*", *(v.alias(f"vote_{k}") for k, v in named.items()))
    names = [f"vote_{k}" for k in named]
    patterns = materialize(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit(patterns, names)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return votes.withColumn("base_failed", failed).withColumn("p_good", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
