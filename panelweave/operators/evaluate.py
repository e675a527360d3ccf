"""How good a preprocessing is: what its most frequent tokens are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literals
from ..sources.scratch import written
from .tokens import Config, WordLists, count_grid, grid_sizes, grid_tokens, grid_weights


def label(token: Column, lexicons: dict[str, Sequence[str]]) -> Column:
    return F.when(token.isin([*lexicons["g"]]), "G").when(token.isin([*lexicons["esg"]]), "ESG").when(token.isin([*lexicons["bp"]]), "BP").otherwise("OTHER")


def ranked(counts: DataFrame, lexicons: dict[str, Sequence[str]], top: int = 30) -> DataFrame:
    """exp_id, rank, token, class of the most frequent tokens. counts: see tokens.grid_counts()."""
    first = Window.partitionBy("exp_id").orderBy(F.col("n").desc(), "token")
    rows = grid_tokens(counts).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return rows.select("exp_id", "rank", "token", F.col("n").alias("tf"), label(F.col("token"), lexicons).alias("token_class"))


def metrics(counts: DataFrame, lexicons: dict[str, Sequence[str]], protect: Sequence[str], top: int = 30, places: int = 4) -> DataFrame:
    """A row per experiment: sizes, classes among the top tokens, protected terms that survive. counts: see tokens.grid_counts(); written first, since they are read twice."""
    counts = written(counts, "counts")
    sizes = grid_sizes(counts, places, F.count(F.when(F.col("token").isin([*protect]), 1)).alias("protected_kept")).drop("n_docs", "coverage_pct")
    of = F.col("token_class")
    classes = ranked(counts, lexicons, top).groupBy("exp_id").agg(*(F.sum((of == k).cast("bigint")).alias(f"top_{k.lower()}") for k in ("G", "ESG", "BP", "OTHER")))
    rows = sizes.join(classes, "exp_id")
    share = lambda c: F.round(c * 100.0 / top, places)
    return rows.select("*", share(F.col("top_bp")).alias("bp_rate"), share(F.col("top_g") + F.col("top_esg")).alias("signal_rate"), F.round(F.col("protected_kept") * 100.0 / max(1, len(protect)), places).alias("protect_pct"))


#: What an evaluated experiment has to reach, in per cent of the protected terms.
LEAST_PROTECTED = 80.0


def status(measured: DataFrame, least: float = LEAST_PROTECTED) -> DataFrame:
    """measured with status: PASS from `least` per cent of protected terms on, else WARN."""
    return measured.withColumn("status", F.when(F.col("protect_pct") >= least, "PASS").otherwise("WARN"))


def deltas(measured: DataFrame, baseline: str, columns: Sequence[str], places: int = 4) -> DataFrame:
    """Each experiment less the baseline, null counted as 0."""
    base = measured.where(F.col("exp_id") == baseline).select(*(F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in columns))
    rows = measured.where(F.col("exp_id") != baseline).join(F.broadcast(base))  # the baseline is one row
    return rows.select("exp_id", *(F.round(F.coalesce(F.col(c), F.lit(0)) - F.col(f"__{c}"), places).alias(f"d_{c}") for c in columns))


def missing_protected(counts: DataFrame, protect: Sequence[str]) -> DataFrame:
    """exp_id, token of protected terms that no document kept. counts: see tokens.grid_counts()."""
    have = F.collect_set(F.when(F.col("token").isin([*protect]), F.col("token")))  # as many as there are protected terms, at most
    rows = counts.groupBy("exp_id").agg(have.alias("have"))
    return rows.select("exp_id", F.explode(F.array_except(literals(dict.fromkeys(protect)), F.col("have"))).alias("token"))


def _listed(top: DataFrame, prefix: str, lexicons: dict[str, Sequence[str]], n: int, places: int) -> DataFrame:
    """exp_id, the top tokens in order, and of each lexicon those among them, their number and share. top: exp_id, rank, token."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token")))  # n at most
    rows = top.groupBy("exp_id").agg(F.transform(ordered, lambda x: x["token"]).alias("__t"))
    inside = lambda k: F.filter("__t", lambda t: t.isin([*lexicons[k]]))
    out = [F.array_join("__t", " | ").alias(f"{prefix}_top_n")]
    for k in ("bp", "esg", "g"):
        count = F.size(inside(k))
        out += [count.cast("bigint").alias(f"{prefix}_{k}_count"), F.round(count * 100.0 / n, places).alias(f"{prefix}_{k}_rate"), F.array_join(inside(k), ", ").alias(f"{prefix}_{k}_tokens")]
    return rows.select("exp_id", *out)


def report(rows: DataFrame, grid: Sequence[Config], lists: WordLists, lexicons: dict[str, Sequence[str]], top: int = 30, places: int = 1, max_features: int = 500, min_df: int = 2) -> DataFrame:
    """All that an experiment is judged by, a row each: sizes; its most frequent tokens and those of the highest mean TF-IDF, with
    the lexicons' tokens among both, their number and share; which tokens of the lexicon g survive.

    rows: tokens.grid_rows(). They are written, and every field comes from that table, so texts are scanned once.
    Equal TF-IDF means, to nine places, are ranked by token. An experiment without a vocabulary has null shares.
    """
    rows = written(rows, "grid")
    counts = written(count_grid(rows, grid, lists), "counts")
    sizes = grid_sizes(counts, places).select("exp_id", "n_docs", F.col("avg_tokens").alias("avg_token_count"), "vocab_size", "coverage_pct")
    frequent = ranked(counts, lexicons, top).select("exp_id", "rank", "token")
    n_docs = sizes.select("exp_id", "n_docs")
    means = grid_weights(rows, counts, grid, min_df, max_features).groupBy("exp_id", "token").agg(F.sum("w").alias("w")).join(F.broadcast(n_docs), "exp_id")
    means = means.select("exp_id", "token", F.round(F.col("w") / F.col("n_docs"), 9).alias("mean"))
    telling = means.withColumn("rank", F.row_number().over(Window.partitionBy("exp_id").orderBy(F.desc("mean"), "token"))).where(F.col("rank") <= top)
    by_tf, by_weight = _listed(frequent, "tf", lexicons, top, places), _listed(telling, "tfidf", lexicons, top, places)
    g = [*dict.fromkeys(lexicons["g"])]
    have = counts.groupBy("exp_id").agg(F.collect_set(F.when(F.col("token").isin(g), F.col("token"))).alias("__have"))  # as many as g has, at most
    total = len(g)
    got = sizes.join(by_tf, "exp_id", "left").join(by_weight.drop("tfidf_bp_tokens", "tfidf_esg_tokens", "tfidf_g_tokens"), "exp_id", "left").join(have, "exp_id")
    zero = {f"{p}_{k}_count": 0 for p in ("tf", "tfidf") for k in ("bp", "esg", "g")} | {c: "" for c in ("tf_top_n", "tfidf_top_n", "tf_bp_tokens", "tf_esg_tokens", "tf_g_tokens")} | {f"tf_{k}_rate": 0.0 for k in ("bp", "esg", "g")}
    survive = F.size("__have")
    return got.fillna(zero).select(
        *(c for c in got.columns if c != "__have"),
        survive.cast("bigint").alias("g_signal_in_vocab"),
        F.lit(total).cast("bigint").alias("g_signal_total"),
        F.round(survive * 100.0 / max(1, total), places).alias("g_signal_pct"),
        F.array_join(F.array_except(literals(g), F.col("__have")), ", ").alias("g_missing"),
    )


def reduction(reported: DataFrame, baseline: str, targets: Sequence[str], places: int = 1) -> DataFrame:
    """What each target has gained or lost against the baseline; shares that are null count as 0. reported: report(), a few rows."""
    columns = ["tf_bp_rate", "tf_esg_rate", "tf_g_rate", "avg_token_count", "vocab_size", "tfidf_bp_rate", "tfidf_esg_rate"]
    reported = written(reported, "report")
    base = reported.where(F.col("exp_id") == baseline).select(F.col("exp_id").alias("baseline_exp"), F.col("g_signal_pct").alias("g_signal_pct_baseline"), *(F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in columns))
    rows = reported.where(F.col("exp_id").isin([*targets])).join(F.broadcast(base))  # the baseline is one row
    change = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) - F.col(f"__{c}"), places).alias(f"delta_{c}")
    return rows.select("baseline_exp", F.col("exp_id").alias("target_exp"), *map(change, columns), "g_signal_pct_baseline", F.col("g_signal_pct").alias("g_signal_pct_target"), F.col("g_missing").alias("g_missing_target"))
