"""Rank statistics: Spearman, Mann-Whitney, Kruskal-Wallis, and deterministic resampling.

Ranks come from counts per value. The distinct values of a group are cut into ranges at some of
them, each range is summed by itself, and what the ranges before it hold is added: no task sees more
than a range, and equal values, however many, are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.draws import BLOCK, drawn, first_in_md5_order, in_md5_order
from ..functions.stats import draw, effect_label, normal_tail, student_p, upper_tail
from ..sources.scratch import written
from .gap import line

#: Ranges of values that a group is cut into.
RANGES = 256
#: A group of a panel of up to so many rows (of 24 bytes) goes whole to the tasks of its replicates; a larger one is joined to its draws.
PANEL_ROWS = 4_000_000
#: Rows of a panel that are packed together.
PACKED = 16_384


def _matched(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of other that has the same keys, null like any value; without keys, other is one row."""
    named = other.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in other.columns if c not in keys))
    if not keys:
        return rows.join(F.broadcast(named))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"__{k}" for k in keys))


def in_ranges(rows: DataFrame, value: str, group: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """rows with `range`, which grows with the value: cut at those distinct values of a group whose hashes are least.

    The same values give the same ranges, in any run. A null is in the first range.
    """
    least = Window.partitionBy(*group).orderBy(F.xxhash64(value), value)
    some = rows.select(*group, value).distinct().withColumn("__k", F.row_number().over(least)).where(F.col("__k") < ranges)
    cuts = some.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("__cuts"))
    return _matched(rows, cuts, group).withColumn("range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def _before(rows: DataFrame, group: Sequence[str], n: Column) -> DataFrame:
    """group, range, before, all: what the ranges before one hold, and all of them."""
    in_order = Window.partitionBy(*group).orderBy("range")
    sums = rows.groupBy(*group, "range").agg(F.sum(n).alias("__n"))
    before = F.coalesce(F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*group, "range", before.alias("before"), F.sum("__n").over(Window.partitionBy(*group)).alias("all"))


def value_ranks(counted: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """counted with rank, the mean rank of a value's rows, and all, the rows of its group. counted: n rows for each distinct value, written."""
    rows = in_ranges(counted, value, group)
    own = F.sum("n").over(Window.partitionBy(*group, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = _matched(rows.withColumn("__own", own), _before(rows, group, F.col("n")), [*group, "range"])
    return ranked.withColumn("rank", F.col("before") + F.col("__own") - (F.col("n") - 1) / 2.0).drop("__own", "before", "range")


def rank_pairs(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """group, x, y, n, all, rx, ry: each distinct pair, how often it occurs, and the distances of its two ranks from the mean rank."""
    full = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counted = written(full.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")

    def side(v: str) -> DataFrame:
        ranked = value_ranks(counted.groupBy(*group, v).agg(F.sum("n").alias("n")), v, group)
        return ranked.select(*group, v, "all", (F.col("rank") - (F.col("all") + 1) / 2.0).alias(f"r{v}"))

    return _matched(_matched(counted, side("x"), [*group, "x"]), side("y").drop("all"), [*group, "y"])


def _sums(ranked: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n, sxy, sxx, syy of rank_pairs()."""
    s = lambda a, b, name: F.sum(F.col("n") * F.col(a) * F.col(b)).alias(name)
    return ranked.groupBy(*group).agg(F.sum("n").alias("n"), s("rx", "ry", "sxy"), s("rx", "rx", "sxx"), s("ry", "ry", "syy"))


def _rho(n: Column) -> Column:
    return F.when((F.sqrt(F.col("sxx") / n) > 1e-12) & (F.sqrt(F.col("syy") / n) > 1e-12), F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))


def spearman(pairs: DataFrame, group: Sequence[str], least: int = 5, places: int = 4) -> DataFrame:
    """group, n, rho of columns x and y, over rows that have both; null for few rows or a constant."""
    n = F.col("n")
    sums = _sums(rank_pairs(pairs, group), group)
    got = sums.select(*group, F.coalesce(n, F.lit(0)).alias("n"), F.round(F.when(n >= least, _rho(n)), places).alias("rho"))
    return got


def rank_line(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """group, slope, intercept of the line of y's ranks on x's."""
    slope, middle = F.try_divide(F.col("sxy"), F.col("sxx")), (F.col("n") + 1) / 2.0
    return _sums(rank_pairs(pairs, group), group).select(*group, slope.alias("slope"), (middle - slope * middle).alias("intercept"))


def with_effect(rhos: DataFrame) -> DataFrame:
    return rhos.withColumn("effect", effect_label(F.col("rho")))


def spearman_p(rhos: DataFrame, group: Sequence[str], places: int = 6) -> DataFrame:
    """rhos (group, n, rho) with p, two-sided by Student's t with n - 2 degrees; a row per group comes to Python."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, rho = f["n"].to_numpy(dtype=float), f["rho"].to_numpy(dtype=float)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = student_p(rho * np.sqrt((n - 2) / (1 - rho * rho)), n - 2)
            p = np.where(np.abs(rho) >= 1, 0.0, np.where((n > 2) & ~np.isnan(rho), p, np.nan))
            yield f.assign(p=[None if np.isnan(x) else round(float(x), places) for x in p])

    own = "".join(f"{g} {rhos.schema[g].dataType.simpleString()}, " for g in group)
    return rhos.select(*group, "n", "rho").mapInPandas(run, own + "n bigint, rho double, p double")


def mann_whitney(rows: DataFrame, group: Sequence[str], least: int = 2, places: int = 6) -> DataFrame:
    """group, sizes, U of the high side, rank-biserial effect, p with tie and continuity correction. rows: x, high (boolean)."""
    full = rows.where(F.col("x").isNotNull() & F.col("high").isNotNull())
    counted = written(full.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("high").cast("bigint")).alias("k")), "counted")
    n, k, x = F.col("n").cast("double"), F.col("k"), F.col("x")
    of_low = F.col("n") - k
    one = value_ranks(counted, "x", group).groupBy(*group).agg(
        F.sum(k).alias("n_high"), F.sum(of_low).alias("n_low"), F.sum(F.col("rank") * k).alias("__r"),
        F.try_divide(F.sum(x * k), F.sum(k)).alias("__mh"), F.try_divide(F.sum(x * of_low), F.sum(of_low)).alias("__ml"), F.sum(n * (n * n - 1)).alias("__ties"),
    ).where((F.col("n_high") >= least) & (F.col("n_low") >= least))
    h, low = F.col("n_high").cast("double"), F.col("n_low").cast("double")
    n = h + low
    u = F.col("__r") - h * (h + 1) / 2
    sd = F.sqrt(h * low / 12 * (n + 1 - F.col("__ties") / (n * (n - 1))))
    z = F.coalesce(F.try_divide(F.greatest(F.abs(u - h * low / 2) - 0.5, F.lit(0.0)), sd), F.lit(0.0))
    greater = F.coalesce(F.try_divide(u - h * low / 2 - 0.5, sd), F.lit(0.0))
    return one.select(*group, "n_high", "n_low", F.round(u, 1).alias("u"), F.round(1 - 2 * u / (h * low), places).alias("rank_biserial"), F.round(F.least(F.lit(1.0), 2 * normal_tail(z)), places).alias("p_norm"), F.round(upper_tail(greater), places).alias("p_greater"), F.when(F.col("__mh") >= F.col("__ml"), "high>low").otherwise("high<low").alias("direction"))


def kruskal_wallis(rows: DataFrame, group: Sequence[str], places: int = 4) -> DataFrame:
    """group, n, k, H with tie correction. rows: x, cls."""
    full = rows.where(F.col("x").isNotNull() & F.col("cls").isNotNull())
    counted = written(full.groupBy(*group, "x", "cls").agg(F.count(F.lit(1)).alias("m")), "counted")
    ranks = value_ranks(counted.groupBy(*group, "x").agg(F.sum("m").alias("n")), "x", group).select(*group, "x", "rank", F.col("n").cast("double").alias("t"))
    m, t = F.col("m").cast("double"), F.col("t")
    by_class = _matched(counted, ranks, [*group, "x"]).groupBy(*group, "cls").agg(F.sum(m).alias("m"), F.sum(F.col("rank") * m).alias("sr"), F.sum(m * (t * t - 1)).alias("ties"))
    one = by_class.groupBy(*group).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("sr") * F.col("sr") / F.col("m")).alias("s"), F.sum("ties").alias("ties"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return one.select(*group, n.cast("bigint").alias("n"), "k", F.round(h, places).alias("h"))


def numbered(rows: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """i: 0, 1, ... in this order, within a group; rows that have the same order are in any. rows: written, or cheap to read again."""
    cut = in_ranges(rows, order[0], group)
    own = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order))
    return _matched(cut.withColumn("__own", own), _before(cut, group, F.lit(1)).drop("all"), [*group, "range"]).withColumn("i", F.col("before") + F.col("__own") - 1).drop("__own", "before", "range")


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("b"))


def panel_rows(panel: DataFrame, order: Sequence[str], group: Sequence[str] = (), columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """group, i, columns: the numbered rows that have all columns, written, since replicates draw from them by number."""
    full = panel.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    rows = written(full.select(*dict.fromkeys([*order, *group, *columns])), "rows")
    return written(numbered(rows, order, group).select(*group, "i", *columns), "panel")


def _tasks(spark: SparkSession) -> int:
    return 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _packed(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """group, __g, __n, i and the columns (as the bytes of int64 and float64 arrays): some rows of a group at a time. __g begins its digests."""
    named = F.concat_ws("", *(F.concat(F.col(g).cast("string"), F.lit("|")) for g in group)) if group else F.lit("")
    given = rows.select(*group, named.alias("__g"), F.col("i").cast("bigint").alias("i"), *(F.col(c).cast("double").alias(c) for c in columns))
    out = StructType([*(given.schema[g] for g in [*group, "__g"]), *StructType.fromDDL(", ".join(["__n bigint", "i binary", *(f"{c} binary" for c in columns)]))])
    fields = to_arrow_schema(out)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("__g").dictionary_encode()
            of = names.indices.to_numpy(zero_copy_only=False)
            values = [batch.column("i").to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)]
            got = []
            for k in range(len(names.dictionary)):
                at = np.flatnonzero(of == k)
                for part in np.split(at, range(PACKED, len(at), PACKED)):
                    own = {g: batch.column(g)[int(part[0])].as_py() for g in [*group, "__g"]}
                    got.append(own | {"__n": len(part)} | {c: v[part].tobytes() for c, v in zip(("i", *columns), values, strict=True)})
            if got:
                yield pa.RecordBatch.from_pylist(got, fields)

    return given.mapInArrow(pack, out)


def _largest(rows: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and how many groups there are. rows: written."""
    got = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    return got["n"] or 0, got["groups"]


def _replicated(rows: DataFrame, b: int, group: Sequence[str], columns: Sequence[str], groups: int, schema: str, work: Callable[[str, list[np.ndarray], Iterable[int]], Iterator[tuple]]) -> DataFrame:
    """group, b and what work(start of the digests, columns in order, replicates) gives: replicates are dealt over tasks, and a copy of
    a group goes packed to each, so neither a draw nor a shuffled row ever moves, and nothing comes to the driver."""
    spark = rows.sparkSession
    parts = max(1, min(b, -(-_tasks(spark) // max(1, groups))))
    known = rows.where(reduce(lambda p, q: p & q, (F.col(g).isNotNull() for g in group))) if group else rows
    dealt = _packed(known, group, columns).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = StructType([*(rows.schema[g] for g in group), *StructType.fromDDL(f"b bigint, {schema}")])
    fields = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("i").to_pylist()])
        order = np.argsort(at)
        values = [np.concatenate([np.frombuffer(x, np.float64) for x in table.column(c).to_pylist()])[order] for c in columns]
        own = [table.column(g)[0].as_py() for g in group]
        got = list(work(table.column("__g")[0].as_py(), values, range(table.column("__t")[0].as_py(), b, parts)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*((*own, *r) for r in got), strict=True), fields.types, strict=True)], schema=fields)

    return dealt.groupBy(*group, "__t").applyInArrow(run, out)


def _drawn_pairs(start: str, x: np.ndarray, y: np.ndarray, replicates: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """b, distinct values of x and y, those of each distinct pair, and how often a replicate draws the pair."""
    (xs, of_x), (ys, of_y) = (np.unique(v, return_inverse=True) for v in (x, y))
    pairs, code = np.unique(of_x * len(ys) + of_y, return_inverse=True)
    px, py, n = pairs // len(ys), pairs % len(ys), len(x)
    for b in replicates:
        counts = np.zeros(len(pairs), np.int64)
        for at in range(0, n, BLOCK):
            counts += np.bincount(code[drawn(f"{start}{b}|", at, min(n, at + BLOCK), n)], minlength=len(pairs))
        yield b, xs, ys, px, py, counts


def _correlation(sxy: float, sxx: float, syy: float, n: int) -> float | None:
    return float(sxy / (np.sqrt(sxx) * np.sqrt(syy))) if np.sqrt(sxx / n) > 1e-12 and np.sqrt(syy / n) > 1e-12 else None


def _drawn_rhos(least: int) -> Callable[[str, list[np.ndarray], Iterable[int]], Iterator[tuple]]:
    """b, n, rho of each replicate, from its counts per pair."""

    def centred(of: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(of, weights=counts, minlength=size)
        return np.cumsum(n) - (n - 1) / 2 - (n.sum() + 1) / 2, n

    def run(start: str, values: list[np.ndarray], replicates: Iterable[int]) -> Iterator[tuple]:
        n = len(values[0])
        for b, xs, ys, px, py, counts in _drawn_pairs(start, *values, replicates):
            (rx, nx), (ry, ny) = centred(px, counts, len(xs)), centred(py, counts, len(ys))
            yield b, n, _correlation(counts @ (rx[px] * ry[py]), nx @ (rx * rx), ny @ (ry * ry), n) if n >= least else None

    return run


def _drawn_slopes(start: str, values: list[np.ndarray], replicates: Iterable[int]) -> Iterator[tuple]:
    """b, slope of y on x in each replicate; null where x is constant."""
    n = len(values[0])
    for b, xs, ys, px, py, counts in _drawn_pairs(start, *values, replicates):
        x, y = xs[px], ys[py]
        x, y = x - counts @ x / n, y - counts @ y / n
        vx = counts @ (x * x)
        yield b, float(counts @ (x * y) / vx) if vx / n > 1e-20 else None


def resampled(rows: DataFrame, b: int, group: Sequence[str] = ()) -> DataFrame:
    """rows of panel_rows() as b resamples with replacement draw them; draws are an md5 of (group, replicate, place).

    Replicates are dealt over tasks before they fan out, and all that follows by replicate stays in its task.
    """
    spark = rows.sparkSession
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    fan = replicates(spark, b).join(F.broadcast(n)).repartition(_tasks(spark), *group, "b")
    drawn = fan.select(*group, "b", "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__slot"))
    drawn = drawn.select(*group, "b", draw(F.col("__n"), *(F.col(g) for g in group), F.col("b"), F.col("__slot")).alias("i"))
    return drawn.join(rows, [*group, "i"]).drop("i")


def _shuffled(rows: DataFrame, b: int) -> DataFrame:
    """Each row in each of b replicates, with k, its place in the replicate's md5 order."""
    spark = rows.sparkSession
    key = F.md5(F.concat_ws("|", F.col("b").cast("string"), F.col("i").cast("string")))
    if rows.count() <= PANEL_ROWS:
        fan = replicates(spark, b).repartition(_tasks(spark), "b").join(F.broadcast(rows))
    else:
        fan = rows.repartition(_tasks(spark)).join(F.broadcast(replicates(spark, b)))
    return fan.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(key, "i")).cast("bigint") - 1)


def _rhos_within(rows: DataFrame, by: Sequence[str], least: int = 5, places: int = 10) -> DataFrame:
    """by, n, rho of each replicate: a replicate is in one task already, so its ranks are windows over its distinct pairs."""
    pairs = rows.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def centred(v: str) -> Column:
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy(v).rangeBetween(Window.unboundedPreceding, 0))
        return upto - (F.sum("n").over(Window.partitionBy(*by, v)) - 1) / 2.0 - (F.sum("n").over(Window.partitionBy(*by)) + 1) / 2.0

    sums = _sums(pairs.withColumn("rx", centred("x")).withColumn("ry", centred("y")), by)
    return sums.select(*by, "n", F.round(F.when(F.col("n") >= least, _rho(F.col("n"))), places).alias("rho"))


def bootstrap_rhos(panel: DataFrame, b: int, order: Sequence[str], group: Sequence[str] = (), least: int = 5, places: int = 10) -> DataFrame:
    """group, b, n, rho of b resamples with replacement of a panel with columns x and y."""
    rows = panel_rows(panel, order, group)
    n, groups = _largest(rows, group)
    if n > PANEL_ROWS:
        return _rhos_within(resampled(rows, b, group), [*group, "b"], least, places)
    got = _replicated(rows, b, group, ["x", "y"], groups, "n bigint, rho double", _drawn_rhos(least))
    return got.withColumn("rho", F.round("rho", places))


def bootstrap_slopes(panel: DataFrame, b: int, order: Sequence[str], y: str, x: str) -> DataFrame:
    """b, slope of y on x of b resamples with replacement."""
    rows = panel_rows(panel, order, columns=[x, y])
    n, groups = _largest(rows, ())
    if n > PANEL_ROWS:
        return line(resampled(rows, b), y, x, ["b"]).select("b", "slope")
    return _replicated(rows, b, (), [x, y], groups, "slope double", _drawn_slopes)


def interval(rhos: DataFrame, level: float = 95, group: Sequence[str] = (), places: int = 4) -> DataFrame:
    """Percentile interval of replicate rhos, whether 0 is outside of it, and the share of positive ones."""
    tail = (1 - level / 100) / 2
    p = lambda q: F.round(F.percentile("rho", F.lit(q)), places)
    rows = rhos.where("rho is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("n_boot"), p(tail).alias("ci_lo"), p(1 - tail).alias("ci_hi"), F.round(F.avg((F.col("rho") > 0).cast("double")), places).alias("share_positive"))
    return rows.withColumn("ci_excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def with_interval(rhos: DataFrame, intervals: DataFrame, group: Sequence[str]) -> DataFrame:
    """A table of rhos with the interval of each beside it, and its effect; one without replicates has nulls."""
    return with_effect(rhos).join(intervals.drop("share_positive"), [*group], "left")


def sign_stability(rhos: DataFrame, observed: DataFrame, places: int = 4) -> DataFrame:
    """Share of replicates that keep the sign of the observed rho (one row)."""
    o = observed.select(F.col("rho").alias("__o"))
    rows = rhos.where("rho is not null").join(F.broadcast(o))
    return rows.agg(F.count(F.lit(1)).alias("n_boot"), F.round(F.avg((F.signum("rho") == F.signum("__o")).cast("double")), places).alias("share_same_sign"))


def _shuffled_rhos(start: str, values: list[np.ndarray], replicates: Iterable[int]) -> Iterator[tuple]:
    """b, n, rho of each shuffle of the second column of ranks, which are distances from their mean."""
    rx, ry = values
    n, sxx, syy = len(rx), rx @ rx, ry @ ry
    for b in replicates:
        yield b, n, _correlation(rx @ ry[in_md5_order(f"{start}{b}|", n)], sxx, syy, n) if n >= 5 else None


def permuted_rhos(panel: DataFrame, b: int, order: Sequence[str]) -> DataFrame:
    """b, n, rho after shuffling y by an md5 order. Ranks stay what they are: a replicate only pairs them anew."""
    rows = panel_rows(panel, order)
    ranks = rank_pairs(rows.select("x", "y")).select("x", "y", "rx", "ry")
    base = written(_matched(rows, ranks, ["x", "y"]).select("i", "rx", "ry"), "ranks")
    n, groups = _largest(base, ())
    if n <= PANEL_ROWS:
        return _replicated(base, b, (), ["rx", "ry"], groups, "n bigint, rho double", _shuffled_rhos).withColumn("rho", F.round("rho", 10))
    paired = _shuffled(base.select("i", "ry"), b).select("b", "ry", F.col("k").alias("i")).join(base.select("i", "rx"), "i")
    one = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    sums = paired.groupBy("b").agg(F.sum(F.col("rx") * F.col("ry")).alias("sxy")).join(F.broadcast(one))
    return sums.select("b", "n", F.round(F.when(F.col("n") >= 5, _rho(F.col("n"))), 10).alias("rho"))


def permutation_summary(rhos: DataFrame, observed: DataFrame, places: int = 4) -> DataFrame:
    """Share of shuffles at least as far from 0 as the observed rho (one row)."""
    o = observed.select(F.col("rho").alias("observed_rho"), "n")
    rows = rhos.where("rho is not null").select("rho").join(F.broadcast(o))
    return rows.groupBy("observed_rho", "n").agg(F.count(F.lit(1)).alias("n_permutations"), F.round(F.avg((F.abs("rho") >= F.abs("observed_rho")).cast("double")), places).alias("permutation_p"), F.round(F.avg("rho"), places).alias("null_mean"), F.round(F.stddev_samp("rho"), places).alias("null_std"), F.round(F.percentile(F.abs("rho"), F.lit(0.95)), places).alias("null_95th"))


def _first_of(rows: DataFrame, b: int, most: int) -> DataFrame:
    """b, x, y, k: the rows of panel_rows() that come first in each replicate's md5 order, with their places in it.

    Ranges of the panel meet groups of replicates, and each keeps its first ones; what the ranges keep is ordered by replicate.
    """
    spark = rows.sparkSession
    ranges = rows.select(F.floor(F.col("i") / BLOCK).alias("r"), "i", "x", "y")
    each = max(1, b // 8)
    dealt = ranges.groupBy("r").agg(F.min("i").alias("start"), F.max("i").alias("last"))
    met = dealt.join(F.broadcast(spark.range(-(-b // each)).select(F.col("id").alias("part")))).repartition(_tasks(spark), "r", "part")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for one in range(r["part"] * each, min(b, (r["part"] + 1) * each)):
                    at, keys = first_in_md5_order(f"{one}|", r["start"], r["last"] + 1, most)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), one)), pa.array(at), pa.array(keys, pa.binary())], ["b", "i", "key"])

    found = met.select("start", "last", "part").mapInArrow(keep, "b bigint, i bigint, key binary")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("key", "i")).cast("bigint") - 1).where(F.col("k") < most)
    return first.select("b", "i", "k").join(rows, "i").select("b", "k", "x", "y")


def subsample_rhos(panel: DataFrame, b: int, sizes: Sequence[int], order: Sequence[str]) -> DataFrame:
    """b, size, n, rho of b samples without replacement of each size; a smaller sample is the beginning of a larger one."""
    kept = _first_of(panel_rows(panel, order), b, max(sizes))
    rows = kept.select("b", "k", "x", "y", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("k") < F.col("size"))
    return _rhos_within(rows, ["b", "size"])
