"""Language against rating: residual scores, quadrants, axes, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line(rows: DataFrame, y: str, x: str, group: Sequence[str] = ()) -> DataFrame:
    """group, slope, intercept of y on x over rows that have both; null slope where x is constant."""
    full = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = full.groupBy(*group).agg(F.when(F.var_pop(x) > 1e-20, F.try_divide(F.covar_pop(y, x), F.var_pop(x))).alias("slope"), F.avg(y).alias("__my"), F.avg(x).alias("__mx"))
    return sums.select(*group, "slope", (F.col("__my") - F.coalesce("slope", F.lit(0.0)) * F.col("__mx")).alias("intercept"))


def orthogonal(rows: DataFrame, y: str, x: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """rows with y less what x explains of it: null where either is null or y is constant but for rounding."""
    fit = line(rows, y, x, group)
    joined = rows.join(fit, [*group]) if group else rows.join(F.broadcast(fit))  # without groups the fit is one row
    return joined.withColumn(name, F.col(y) - (F.coalesce("slope", F.lit(0.0)) * F.col(x) + F.col("intercept"))).drop("slope", "intercept")


def z_scores(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with z-scores (new name: column); null where the column is constant. The sums are one row, which is joined, so no task sees all rows."""
    sums = rows.agg(*(f(c).alias(f"__{k}{i}") for i, c in enumerate(columns.values()) for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    scored = {name: F.when(F.col(f"__s{i}") > 1e-12, F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__s{i}"))) for i, (name, c) in enumerate(columns.items())}
    return rows.join(F.broadcast(sums)).withColumns(scored).drop(*sums.columns)


def quadrant(talk: Column, walk: Column) -> Column:
    """By the signs of both: talk above and walk below is over, the reverse under."""
    return F.when(talk.isNull() | walk.isNull(), None).when((talk > 0) & (walk <= 0), "over").when((talk <= 0) & (walk > 0), "under").when((talk > 0) & (walk > 0), "aligned").otherwise("consistent_low")


def shares(rows: DataFrame, column: str, places: int = 4) -> DataFrame:
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), places))


def persistence(rows: DataFrame, firm: str, column: str, periods: int) -> DataFrame:
    """Firms seen in all periods, and how many of them never leave one quadrant."""
    by_firm = rows.where(F.col(column).isNotNull()).groupBy(firm).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("kinds"))
    full = by_firm.where(F.col("n") >= periods)
    return full.agg(F.count(F.lit(1)).alias("n_firms"), F.coalesce(F.sum((F.col("kinds") == 1).cast("bigint")), F.lit(0)).alias("n_persistent"))


def axes(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """top_axis and low_axis: which score is largest and smallest; the first of equals."""
    values = F.array(*(F.col(s) for s in scores))
    names = F.array(*(F.lit(s) for s in scores))
    at = lambda best: F.get(names, (F.array_position(values, best(values)) - 1).cast("int"))
    return rows.withColumn("top_axis", at(F.array_max)).withColumn("low_axis", at(F.array_min))


def weighted(rows: DataFrame, scores: Sequence[str], weights: DataFrame, group: str) -> DataFrame:
    """Sum of z-scored columns by the group's weights (columns w_<score>)."""
    joined = z_scores(rows.join(weights, group), {f"__z_{s}": s for s in scores})
    total = sum((F.coalesce(F.col(f"w_{s}") * F.col(f"__z_{s}"), F.lit(0.0)) for s in scores), F.lit(0.0))
    return joined.withColumn("weighted_score", total).drop(*(f"__z_{s}" for s in scores))


def change(rows: DataFrame, firm: str, period: str, columns: Sequence[str]) -> DataFrame:
    """Columns less those of the firm's previous period; its first period goes."""
    w = Window.partitionBy(firm).orderBy(period)
    out = rows.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns}).withColumn("__k", F.row_number().over(w))
    return out.where("__k > 1").drop("__k")
