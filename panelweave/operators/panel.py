"""Panels: joins on explicit keys, audits of what they lose, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import sample_skew


def merge(features: DataFrame, ratings: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Features with the named rating columns; the rating side is cut to these before the join."""
    return features.join(ratings.select(*keys, *columns), [*keys], how)


def unmatched(features: DataFrame, ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of features that have no rating."""
    return features.select(*keys).distinct().join(ratings.select(*keys), [*keys], "left_anti")


def backfill(panel: DataFrame, other: DataFrame, candidates: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns that the panel lacks, from other, joined on those of the candidate keys that both have."""
    keys = [k for k in candidates if k in panel.columns and k in other.columns]
    missing = [c for c in columns if c not in panel.columns and c in other.columns]
    return panel.join(other.select(*keys, *missing).dropDuplicates(keys), keys, "left") if missing else panel


def grid(firms: DataFrame, years: DataFrame) -> DataFrame:
    """Every firm in every year; years is a handful of rows."""
    return firms.crossJoin(F.broadcast(years))


def dedupe(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in this order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def decision(has_id: Column, rated: Column) -> Column:
    """What becomes of a panel row, from its filing id and its rating."""
    return F.when(~has_id, "EXCLUDE_NO_RCEPT").when(~rated, "EXCLUDE_KCGS_NA").when(has_id & rated, "INCLUDE").otherwise("UNKNOWN")


def funnel(rows: DataFrame, stages: Sequence[tuple[str, Column]], places: int = 2) -> DataFrame:
    """Rows left after each condition on top of those before it, with losses and coverage: one pass over rows."""
    so_far, counts = F.lit(True), []
    for _, condition in stages:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.sum(so_far.cast("bigint")))
    one = rows.agg(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.coalesce(c, F.lit(0)).alias("remaining_rows")) for k, ((name, _), c) in enumerate(zip(stages, counts, strict=True)))).alias("x"), F.count(F.lit(1)).alias("total"))
    flat = one.select("total", F.explode("x").alias("s")).select("total", "s.*")
    order = Window.partitionBy("total").orderBy("step")
    loss = F.coalesce(F.lag("remaining_rows").over(order), F.col("total")) - F.col("remaining_rows")
    return flat.select("step", "stage", "remaining_rows", loss.alias("loss"), (F.col("total") - F.col("remaining_rows")).alias("cumulative_loss"), F.round(F.coalesce(F.try_divide(F.col("remaining_rows") * 100.0, F.col("total")), F.lit(0.0)), places).alias("coverage_pct"))


def quality(panel: DataFrame, group: Sequence[str], firm: str, year: str, grade: str, places: int = 4) -> DataFrame:
    """Rows, firms, years and the spread of the grade."""
    g = F.col(grade).cast("double")
    return panel.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(grade).alias("n_graded"), F.countDistinct(firm).alias("n_firms"), F.countDistinct(year).alias("n_years"),
        F.min(grade).alias("grade_min"), F.max(grade).alias("grade_max"), F.round(F.avg(g), places).alias("grade_mean"), F.round(F.stddev_samp(g), places).alias("grade_std"),
    )


def distribution(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def melt(rows: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """ids, feature, x: one row per feature."""
    return rows.select(*ids, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("__m")).select(*ids, "__m.*")


def collapse(rows: DataFrame, features: Sequence[str], group: Sequence[str] = (), places: int = 4) -> DataFrame:
    """Moments of each feature and whether it is constant."""
    x = F.col("x")
    share = lambda v: F.round(F.avg(F.when(x.isNotNull(), (F.abs(x - v) < 1e-12).cast("double"))) * 100, places)
    return melt(rows, group, features).groupBy(*group, "feature").agg(
        F.count(x).alias("n"), F.round(F.avg(x), places).alias("mean"), F.round(F.stddev_samp(x), places).alias("std"), F.round(F.min(x), places).alias("min"), F.round(F.max(x), places).alias("max"),
        F.round(sample_skew(x), 3).alias("skew"), share(0.0).alias("zero_pct"), share(1.0).alias("one_pct"), F.countDistinct(x).alias("n_unique"), F.coalesce(F.stddev_samp(x) < 1e-10, F.lit(True)).alias("collapsed"),
    )


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*(F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{c}") for c in columns))


def assertions(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """name, status, detail of conditions that all rows must meet: one pass, a row per check."""
    bad = [F.sum((~F.coalesce(c, F.lit(False))).cast("bigint")) for _, c in checks]
    one = rows.agg(F.array(*(F.struct(F.lit(name).alias("name"), F.coalesce(b, F.lit(0)).alias("violations")) for (name, _), b in zip(checks, bad, strict=True))).alias("x"))
    return one.select(F.explode("x").alias("c")).select("c.name", F.when(F.col("c.violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.col("c.violations").alias("detail"))


def universe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of both sides, and where each comes from."""
    x, y = (df.select(*keys).distinct().withColumn(f"__{k}", F.lit(1)) for k, df in (("a", a), ("b", b)))
    both = x.join(y, [*keys], "full_outer")
    return both.select(*keys, F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "both").when(F.col("__a").isNotNull(), "first").otherwise("second").alias("provenance"))


def quartile(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """q: the quarter of each value, by interpolated edges closed on the right; equal values stay together."""
    edges = rows.groupBy(*group).agg(*(F.percentile(value, F.lit(p)).alias(f"__e{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))))
    joined = rows.join(edges, [*group]) if group else rows.join(F.broadcast(edges))  # without groups the edges are one row
    v = F.col(value)
    return joined.withColumn("q", F.when(v <= F.col("__e1"), 1).when(v <= F.col("__e2"), 2).when(v <= F.col("__e3"), 3).when(v.isNotNull(), 4)).drop("__e1", "__e2", "__e3")


def describe(rows: DataFrame, features: Sequence[str], group: Sequence[str] = (), places: int = 6) -> DataFrame:
    """Count, mean, spread and quartiles of each feature."""
    x, r = F.col("x"), lambda c: F.round(c, places)
    quarters = (r(F.percentile(x, F.lit(p))).alias(name) for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    return melt(rows, group, features).groupBy(*group, "feature").agg(F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("min"), *quarters, r(F.max(x)).alias("max"))


def stage_counts(rows: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, stage, n of conditions that stand by themselves, from one pass."""
    one = rows.agg(*(F.count(F.when(c, 1)).alias(f"c{k}") for k, (_, c) in enumerate(stages)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.col(f"c{k}").alias("n")) for k, (name, _) in enumerate(stages)))).alias("s")).select("s.*")
