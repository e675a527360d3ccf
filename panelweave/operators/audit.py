"""Token audit: frequencies, rule classes, expert decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import any_of, has_any, literals
from .tokens import token_runs

CLASSES = ("G_SIGNAL", "ESG_SIGNAL", "BOILERPLATE", "AMBIGUOUS", "GENERIC")


@dataclass
class Rules:
    """Lists and patterns of the classifier."""

    preserve: list[str] = field(default_factory=lambda: [*fixed.GOVERNANCE_PROTECT, *fixed.SIGNAL_PRESERVE])
    governance: list[str] = field(default_factory=lambda: fixed.GOVERNANCE_CORE)
    environment: list[str] = field(default_factory=lambda: fixed.ENVIRONMENT_CORE)
    social: list[str] = field(default_factory=lambda: fixed.SOCIAL_CORE)
    boilerplate: list[str] = field(default_factory=lambda: fixed.BOILERPLATE_NOUNS)
    ambiguous: list[str] = field(default_factory=lambda: fixed.AMBIGUOUS)
    parts: list[str] = field(default_factory=lambda: fixed.GOVERNANCE_PARTS)
    boilerplate_patterns: list[str] = field(default_factory=lambda: fixed.BOILERPLATE_TOKEN_PATTERNS)
    generic_patterns: list[str] = field(default_factory=lambda: fixed.GENERIC_TOKEN_PATTERNS)


def frequencies(tokenized: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, tf, df from a row per document, which adds each of its distinct tokens once, with its count: one aggregate."""
    runs = token_runs(tokenized.select(F.col(tokens).alias("tokens")), [])
    return runs.groupBy("token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def hint(token: Column, rules: Rules) -> Column:
    return F.when(token.isin(rules.preserve), "preserve").when(token.isin(rules.boilerplate), "boilerplate").otherwise("")


def audit(rows: DataFrame, n_docs: int, rules: Rules, top: int | None = 500) -> DataFrame:
    """token, tf, df, idf, tf_idf_avg, auto_hint of the `top` most frequent tokens. rows: token, tf, df."""
    idf = F.log(F.lit(float(n_docs)) / F.col("df"))
    if top is not None:
        rows = rows.orderBy(F.col("tf").desc(), "token").limit(top)
    return rows.select("token", "tf", "df", F.round(idf, 3).alias("idf"), F.round(F.col("tf") / F.lit(float(n_docs)) * idf, 3).alias("tf_idf_avg"), hint(F.col("token"), rules).alias("auto_hint"))


def idf_bands(audited: DataFrame) -> DataFrame:
    band = F.when(F.col("idf") < 0.1, "a: below 0.1").when(F.col("idf") < 0.5, "b: below 0.5").when(F.col("idf") < 1.0, "c: below 1").otherwise("d: 1 and more")
    return audited.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("tf").alias("tf"))


def conflicts(reviewed: DataFrame, rules: Rules) -> DataFrame:
    """A row per contradiction between a token's manual class and the lists: a preserved term called boilerplate, a signal that
    the lists remove, boilerplate that no list removes. A class is trimmed and upper-cased first; a token may have two."""
    c, t = F.upper(F.trim(F.coalesce("manual_class", F.lit("")))), F.col("token")
    listed = lambda terms: t.isin(terms) if terms else F.lit(False)
    kinds = [
        F.when((c == "BOILERPLATE") & listed(rules.preserve), "preserve_vs_boilerplate"),
        F.when(c.isin("ESG_SIGNAL", "G_SIGNAL") & listed(rules.boilerplate), "signal_in_stopwords"),
        F.when((c == "BOILERPLATE") & ~listed(rules.boilerplate), "boilerplate_not_removed"),
    ]
    rows = reviewed.select("token", F.explode(F.array(*kinds)).alias("conflict"), "auto_hint", "manual_class")
    return rows.where("conflict is not null")


def decision_log(overridden: DataFrame) -> DataFrame:
    """What experts have changed: token, change (old class -> new class) of rows of override() that were applied."""
    return overridden.where("status = 'applied'").select("token", F.concat_ws("->", "auto_class", "final_class").alias("change"))


def infer_n_docs(audited: DataFrame, default: int = 30) -> DataFrame:
    """One row: the number of documents that df and idf imply."""
    usable = audited.where((F.col("idf") > 0.01) & (F.col("df") > 0))
    return usable.agg(F.coalesce(F.floor(F.percentile(F.round(F.col("df") * F.exp("idf")), 0.5)).cast("bigint"), F.lit(default).cast("bigint")).alias("n_docs"))


def _scored(audited: DataFrame, rules: Rules) -> DataFrame:
    """The four scores of each token, and __rule, the first of six rules that it meets."""
    t, idf = F.col("token"), F.col("idf")
    inside = lambda terms: t.isin(terms) if terms else F.lit(False)
    like = lambda patterns: t.rlike(any_of(patterns)) if patterns else F.lit(False)
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    keep, g, e, s = inside(rules.preserve), inside(rules.governance), inside(rules.environment), inside(rules.social)
    rows = audited.withColumns({
        "gov_score": add(g | (keep & has_any(t, rules.parts)), 0.9),
        "esg_score": F.when(e, 0.9).when(s, 0.8).when(keep, 0.5).otherwise(0.0) + add(idf >= fixed.IDF_HIGH, 0.15),
        "boilerplate_score": F.least(add(inside(rules.boilerplate), 0.9) + add(like(rules.boilerplate_patterns), 0.4), F.lit(1.0)) + add(idf < fixed.IDF_LOW, 0.2),
        "generic_score": F.least(add(like(rules.generic_patterns), 0.3), F.lit(1.0)) + F.when(idf < fixed.IDF_LOW, 0.2).when(idf < fixed.IDF_MIDDLE, 0.1).otherwise(0.0),
    })
    gov, esg, bp, gen = (F.col(f"{k}_score") for k in ("gov", "esg", "boilerplate", "generic"))
    top = F.greatest(gov, esg, bp, gen)
    close = sum((F.when(top - x <= 0.15 + 1e-9, 1).otherwise(0) for x in (gov, esg, bp, gen)), F.lit(0))
    rule = F.when(g | (keep & (gov >= 0.8)), 1).when(e | s | (keep & (esg >= 0.7)), 2).when(inside(rules.ambiguous), 3).when((bp >= 0.6) & (gov < 0.5) & (esg < 0.5), 4).when(close >= 2, 5).otherwise(6)
    return rows.withColumn("__rule", rule)


def classify(audited: DataFrame, rules: Rules) -> DataFrame:
    """auto_class, confidence and the four scores of each token."""
    rows = _scored(audited, rules)
    gov, esg, bp, gen = (F.col(f"{k}_score") for k in ("gov", "esg", "boilerplate", "generic"))
    top = F.greatest(gov, esg, bp, gen)
    r = F.col("__rule")
    named = F.when(r == 1, "G_SIGNAL").when(r == 2, "ESG_SIGNAL").when(r == 4, "BOILERPLATE").when(r.isin(3, 5), "AMBIGUOUS").otherwise("GENERIC")
    sure = F.when(r == 1, 0.95).when(r == 2, 0.90).when(r == 3, 0.40).when(r == 4, F.round(bp, 2)).when(r == 5, F.round(top, 2)).otherwise(F.round(F.greatest(gen, 1 - F.greatest(esg, gov, bp)), 2))
    return rows.withColumns({"auto_class": named, "confidence": sure, **{f"{k}_score": F.round(f"{k}_score", 3) for k in ("gov", "esg", "boilerplate", "generic")}}).drop("__rule")


def reasons(audited: DataFrame, rules: Rules, n_docs: int) -> DataFrame:
    """token, risk_warning, rationale for reviewers: which rule has decided, then all that has added to a score, in the order of the rules."""
    rows, t, idf = _scored(audited, rules), F.col("token"), F.col("idf")
    inside = lambda terms: t.isin(terms) if terms else F.lit(False)
    r, keep = F.col("__rule"), inside(rules.preserve)
    scores = {"ESG": F.col("esg_score"), "GOV": F.col("gov_score"), "BP": F.col("boilerplate_score"), "GEN": F.col("generic_score")}
    top = F.greatest(*scores.values())
    close = F.concat_ws(", ", *(F.when(top - x <= 0.15 + 1e-9, k) for k, x in scores.items()))
    first = lambda patterns: F.coalesce(*(F.when(t.rlike(p), p) for p in patterns), F.lit(None)) if patterns else F.lit(None).cast("string")
    named = {1: "rule: governance list", 2: "rule: environment or social list", 3: "rule: listed as ambiguous", 4: "rule: boilerplate score"}
    rule = F.when(r == 5, F.concat(F.lit("rule: close scores "), close)).when(r == 6, "rule: no list")
    for k, text in named.items():
        rule = rule.when(r == k, text)
    parts = [
        rule,
        F.when(inside(rules.governance) | (keep & has_any(t, rules.parts)), "governance term"),
        F.when(inside(rules.environment), "environment term"),
        F.when(~inside(rules.environment) & inside(rules.social), "social term"),
        F.when(keep & ~inside(rules.environment) & ~inside(rules.social), "preserved term"),
        F.when(inside(rules.boilerplate), "boilerplate term"),
        F.when(inside(rules.ambiguous), "ambiguous term"),
        F.concat(F.lit("boilerplate pattern "), first(rules.boilerplate_patterns)),
        F.concat(F.lit("generic pattern "), first(rules.generic_patterns)),
        F.when(idf < fixed.IDF_LOW, "in nearly all documents").when(idf < fixed.IDF_MIDDLE, "in many documents").when(idf >= fixed.IDF_HIGH, "in few documents"),
        F.when(F.col("df") > 0.9 * n_docs, "in over 90 % of documents"),
    ]
    warning = F.when(r == 3, "governance or general: review by hand").when((r == 4) & has_any(t, rules.parts), "holds a governance word: calling it boilerplate may lose a signal").when(r == 5, F.concat(F.lit("scores compete: "), close)).otherwise("")
    return rows.select("token", warning.alias("risk_warning"), F.concat_ws(" | ", *parts).alias("rationale"))


def class_summary(classified: DataFrame) -> DataFrame:
    """Count and share of every class, also of empty ones."""
    known = classified.sparkSession.createDataFrame([(k,) for k in CLASSES], "auto_class string")
    counts = classified.groupBy("auto_class").agg(F.count(F.lit(1)).alias("n"))
    rows = known.join(counts, "auto_class", "left").select("auto_class", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), F.lit(0.0)), 2))


def override(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """Expert classes: a manual one stays, else the last decision on the token, else none. decisions: position, token, class."""
    last = decisions.groupBy("token").agg(F.max_by("class", "position").alias("__expert"))
    manual = F.nullif(F.trim("manual_class"), F.lit(""))
    status = F.when(manual.isNotNull(), "kept").when(F.col("__expert").isNotNull(), "applied").otherwise("undecided")
    rows = classified.join(last, "token", "left")
    return rows.select("token", "auto_class", status.alias("status"), F.coalesce(manual, "__expert").alias("final_class"))


def stop_word_export(classified: DataFrame, manual: Sequence[str] = (), least: float = 0.6) -> DataFrame:
    """(category, token) of classified boilerplate and generic words and of manual ones."""
    rows = classified.where(F.col("auto_class").isin("BOILERPLATE", "GENERIC") & (F.col("confidence") >= least)).select(F.col("auto_class").alias("category"), "token")
    own = classified.select(F.explode(literals(manual)).alias("token")).select(F.lit("BOILERPLATE").alias("category"), "token")
    return rows.unionByName(own).distinct()
