"""Linear models of a panel, in closed form from sums, and the iterative ones beside them.

A design has few columns, so a fit needs a handful of sums of centred columns for each group; those are solved where they
are, a row per group, and joined back where residuals are wanted. Iterative fits read a written table of the distinct rows
of the design with their counts, which is what each round's aggregate scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.stats import normal_p, safe_corr, student_p
from ..sources.scratch import written


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in these."""
    return rows.dropna(subset=[*columns])


def _by_row(rows: DataFrame, keep: Sequence[str], schema: str, work: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """work() of each row, a dict, whose results have the columns `keep` of it and those of schema: for tables of a few sums per group."""
    kept = StructType([rows.schema[c] for c in keep])
    out = StructType([*kept.fields, *StructType.fromDDL(schema).fields])
    fields = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [{c: row[c] for c in keep} | more for row in batch.to_pylist() for more in work(row)]
            yield pa.RecordBatch.from_pylist(got, fields)

    return rows.mapInArrow(run, out)


def _with_fit(rows: DataFrame, fits: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows beside the fit of their group, null like any value; without groups it is one row."""
    if not group:
        return rows.join(F.broadcast(fits))
    named = fits.withColumnsRenamed({g: f"__{g}" for g in group})
    return rows.join(named, reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group))).drop(*(f"__{g}" for g in group))


FIT = "fit struct<n: bigint, mean: array<double>, inverse: array<array<double>>, slopes: array<double>, my: double, rss: double, tss: double>"


def fits(full: DataFrame, y: str, xs: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """group, fit: rows, means, the inverse of the centred cross products, slopes, mean of y, residual and total squares.

    A group with too few rows for the columns has no row. full: no nulls.
    """
    k = len(xs)
    cols = [F.col(x).cast("double") for x in xs]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aggs = [F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__my"), F.var_pop(y).alias("__vy")]
    aggs += [F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)] + [F.covar_pop(c, F.col(y).cast("double")).alias(f"__c{i}") for i, c in enumerate(cols)] + [F.covar_pop(cols[i], cols[j]).alias(f"__s{i}_{j}") for i, j in pairs]

    def solve(r: dict) -> Iterator[dict]:
        n = r["__n"]
        if n <= k + 1:
            return
        s = np.zeros((k, k))
        for i, j in pairs:
            s[i, j] = s[j, i] = r[f"__s{i}_{j}"] * n
        inverse = np.linalg.pinv(s)
        sxy = np.array([r[f"__c{i}"] * n for i in range(k)])
        slopes, tss = inverse @ sxy, r["__vy"] * n
        yield {"fit": {"n": n, "mean": [r[f"__m{i}"] for i in range(k)], "inverse": inverse.tolist(), "slopes": slopes.tolist(), "my": float(r["__my"]), "rss": max(0.0, tss - float(slopes @ sxy)), "tss": tss}}

    return _by_row(full.groupBy(*group).agg(*aggs), group, FIT, solve)


def _centred(xs: Sequence[str]) -> list[Column]:
    return [F.col(x).cast("double") - F.col("fit.mean")[i] for i, x in enumerate(xs)]


def _residual(y: str, xs: Sequence[str]) -> Column:
    return F.col(y) - F.col("fit.my") - sum((F.col("fit.slopes")[i] * z for i, z in enumerate(_centred(xs))), F.lit(0.0))


def ols_by(rows: DataFrame, y: str, xs: Sequence[str], group: Sequence[str] = (), robust: bool = False, label: str = "m") -> DataFrame:
    """group, model, term, coef, se, stat, p, n, r2, r2_adj of a least-squares fit for each group; robust: HC1 standard errors and normal p.

    Sums are of centred columns, so large means cost no digits. Any number of groups: nothing comes to the driver.
    A group with too few rows for the columns has no rows here.
    """
    k = len(xs)
    full = complete(rows, [y, *xs])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    found = fits(full, y, xs, group)
    if robust:
        z = [F.lit(1.0), *_centred(xs)]
        e2 = _residual(y, xs) * _residual(y, xs)
        beside = _with_fit(full, found, group).select(*group, "fit", *((e2 * z[i] * z[j]).alias(f"__s{i}_{j}") for i, j in pairs))
        found = beside.groupBy(*group).agg(F.any_value("fit").alias("fit"), F.array(*(F.sum(f"__s{i}_{j}") for i, j in pairs)).alias("__meat"))
        found = found.where("fit is not null")

    def finish(r: dict) -> Iterator[dict]:
        f = r["fit"]
        n, mean, slopes = f["n"], np.array(f["mean"]), np.array(f["slopes"])
        bread = np.zeros((k + 1, k + 1))
        bread[0, 0], bread[1:, 1:] = 1 / n, np.array(f["inverse"]).reshape(k, k)
        if robust:
            meat = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, r["__meat"], strict=True):
                meat[i, j] = meat[j, i] = v or 0.0
            cov = bread @ meat @ bread * n / (n - k - 1)
        else:
            cov = bread * f["rss"] / (n - k - 1)
        back = np.eye(k + 1)
        back[0, 1:] = -mean
        se = np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0))
        beta = np.concatenate([[f["my"] - mean @ slopes], slopes])
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = np.where(se > 0, beta / se, np.nan)
        p = normal_p(stat) if robust else student_p(stat, np.full(k + 1, n - k - 1))
        # as regr_r2() has it: a constant y is explained whole by a column that varies
        r2 = 1 - f["rss"] / f["tss"] if f["tss"] > 0 else 1.0 if np.any(f["inverse"]) else None
        adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k - 1)
        known = lambda v: None if np.isnan(v) else float(v)
        for t, b, e, v, q in zip(("intercept", *xs), beta, se, stat, p, strict=True):
            yield {"model": label, "term": t, "coef": float(b), "se": float(e), "stat": known(v), "p": known(q), "n": n, "r2": r2, "r2_adj": adjusted}

    return _by_row(found, group, "model string, term string, coef double, se double, stat double, p double, n bigint, r2 double, r2_adj double", finish)


def ols(rows: DataFrame, y: str, xs: Sequence[str], robust: bool = False, label: str = "m") -> DataFrame:
    """model, term, coef, se, stat, p, n, r2, r2_adj of a least-squares fit; see ols_by()."""
    return ols_by(rows, y, xs, (), robust, label)


def dummies(rows: DataFrame, columns: Sequence[str], most: int = 200) -> tuple[DataFrame, list[str]]:
    """rows with a 0/1 column for each value of these but the least, and the names; more values than `most` are refused."""
    made = {}
    for c in columns:
        values = [r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        made |= {f"{c}={v}": (F.col(c) == F.lit(v)).cast("double") for v in values[1:]}
    names = {f"__d{k}": name for k, name in enumerate(made)}
    return rows.withColumns(dict(zip(names, made.values(), strict=True))) if names else rows, [*names]


def comparison(fits: Sequence[DataFrame], term: str | None = None) -> DataFrame:
    """The rows of several fits below each other, of one term where it is named."""
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f)
    return out if term is None else out.where(F.col("term") == term)


def residuals(rows: DataFrame, y: str, xs: Sequence[str], name: str = "residual") -> DataFrame:
    """rows without nulls in these, and the residual of the fit."""
    full = complete(rows, [y, *xs])
    return _with_fit(full, fits(full, y, xs), ()).withColumn(name, _residual(y, xs)).drop("fit")


def within(rows: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Columns less their group's mean: fixed effects without dummies."""
    means = rows.groupBy(group).agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    return rows.join(means, group).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def vif(rows: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation of each column, from the inverse correlation matrix."""
    pairs = [(i, j) for i in range(len(xs)) for j in range(i)]
    got = complete(rows, xs).agg(*(safe_corr(F.col(xs[i]).cast("double"), F.col(xs[j]).cast("double")).alias(f"r{i}_{j}") for i, j in pairs)).first()
    r = np.eye(len(xs))
    for i, j in pairs:
        r[i, j] = r[j, i] = got[f"r{i}_{j}"] or 0.0
    d = np.diag(np.linalg.pinv(r))
    return rows.sparkSession.createDataFrame([(x, float(v), "HIGH" if v > 10 else "MODERATE" if v > 5 else "OK") for x, v in zip(xs, d, strict=True)], "term string, vif double, flag string")


def cooks(rows: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """rows with their residual, leverage and Cook's distance, which is NaN or infinite where the fit leaves no residual at all."""
    full, k = complete(rows, [y, *xs]), len(xs)
    out = _with_fit(full, fits(full, y, xs), ())
    z = _centred(xs)
    h = 1.0 / F.col("fit.n") + sum((F.col("fit.inverse")[i][j] * z[i] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
    s2 = F.col("fit.rss") / (F.col("fit.n") - k - 1)
    out = out.withColumn("residual", _residual(y, xs)).withColumn("leverage", h)
    e, hh = F.col("residual"), F.col("leverage")
    over, under = e * e * hh, (k + 1) * s2 * (1 - hh) * (1 - hh)
    # as SQL divides doubles: where nothing is left to explain, the distance is not a number
    by_zero = F.when(over == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return out.withColumn("cooks_d", F.when(under == 0, by_zero).otherwise(F.try_divide(over, under))).drop("fit")


def breusch_pagan(rows: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """LM statistic n * R2 of the squared residuals on the same columns."""
    squared = residuals(rows, y, xs, "__e").withColumn("__e2", F.col("__e") * F.col("__e"))
    return ols(squared, "__e2", xs).select((F.col("n") * F.col("r2")).alias("lm"), "n").limit(1)


def design(rows: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """y, x0, x1, ... and n: the distinct rows of the design with their counts, columns less their mean over their deviation; means and deviations. Written."""
    named = complete(rows, [y, *xs]).select(F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)))
    counted = written(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")), "design")
    n = F.sum("n")
    means = counted.agg(*(F.try_divide(F.sum(F.col("n") * F.col(f"x{i}")), n).alias(f"m{i}") for i in range(len(xs)))).first()
    mean = np.array([v or 0.0 for v in means], dtype=float)
    spread = counted.agg(*(F.try_divide(F.sum(F.col("n") * (F.col(f"x{i}") - float(mean[i])) ** 2), n).alias(f"v{i}") for i in range(len(xs)))).first()
    sd = np.sqrt([v or 0.0 for v in spread])
    sd[sd < 1e-12] = 1.0
    return counted.select("y", "n", *(((F.col(f"x{i}") - float(mean[i])) / float(sd[i])).alias(f"x{i}") for i in range(len(xs)))), mean, sd


def _maximised(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], theta: np.ndarray, rounds: int, valid: Callable[[np.ndarray], bool] = lambda t: True) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """theta, log-likelihood, inverse information, whether it converged: Newton steps, halved until the likelihood doesn't fall.

    evaluate: likelihood, gradient and information at a theta. It has converged where a whole step is below 1e-7 and none of the
    values, which are per standard deviation, has run away, as those of separated data do.
    """
    ll, gradient, information = evaluate(theta)
    converged = False
    for _ in range(rounds):
        step = np.linalg.pinv(information) @ gradient
        if np.abs(step).max(initial=0.0) < 1e-7:
            converged = bool(np.abs(theta).max(initial=0.0) < 30)
            break
        size = 1.0
        while size > 1e-4:
            trial = theta + size * step
            if valid(trial):
                got = evaluate(trial)
                if got[0] >= ll - 1e-9 * (1 + abs(ll)):
                    break
            size /= 2
        else:
            break
        theta, (ll, gradient, information) = trial, got
    return theta, ll, np.linalg.pinv(information), converged


def logit(rows: DataFrame, y: str, xs: Sequence[str], rounds: int = 25) -> DataFrame:
    """term, coef, odds_ratio, se, z, p, n, pseudo_r2 (McFadden), aic, converged of a binary logit by Newton's method; one aggregate a trial, over design()."""
    table, mean, sd = design(rows, y, xs)
    k = len(xs)
    cols = [F.lit(1.0), *(F.col(f"x{i}") for i in range(k))]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.lit(float(b)) * c for b, c in zip(theta, cols, strict=True)), F.lit(0.0))
        # log(1 + e^x) without overflow
        soft = F.greatest(F.col("__e"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("__e")))
        at = table.withColumn("__e", eta).withColumn("__p", 1 / (1 + F.exp(-F.col("__e"))))
        n, p = F.col("n"), F.col("__p")
        sums = [F.sum(n * (F.col("y") * F.col("__e") - soft))] + [F.sum(n * (F.col("y") - p) * c) for c in cols] + [F.sum(n * p * (1 - p) * cols[i] * cols[j]) for i, j in pairs]
        got = [float(v or 0) for v in at.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()]
        information = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, got[k + 2 :], strict=True):
            information[i, j] = information[j, i] = v
        return got[0], np.array(got[1 : k + 2]), information

    theta, ll, cov, converged = _maximised(evaluate, np.zeros(k + 1), rounds)
    back = np.eye(k + 1)
    back[0, 1:], back[1:, 1:] = -mean / sd, np.diag(1 / sd)
    beta, se = back @ theta, np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0))
    one = table.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("k")).first()
    n, m = int(one["n"] or 0), float(one["k"] or 0) / max(1, one["n"] or 0)
    null = n * (m * log(m) + (1 - m) * log(1 - m)) if 0 < m < 1 else 0.0
    z = beta / np.maximum(se, 1e-300)
    fit = (n, 1 - ll / null if null else None, 2 * len(beta) - 2 * ll, converged)
    out = [(t, float(b), exp(min(50.0, float(b))), float(s), float(v), float(q), *fit) for t, b, s, v, q in zip(("intercept", *xs), beta, se, z, normal_p(z), strict=True)]
    return rows.sparkSession.createDataFrame(out, "term string, coef double, odds_ratio double, se double, z double, p double, n bigint, pseudo_r2 double, aic double, converged boolean")


def standardized(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their sample deviation: one aggregate, whose single row is joined."""
    sums = rows.agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    return rows.join(F.broadcast(sums)).withColumns({c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}).drop(*sums.columns)


def ordered_logit(rows: DataFrame, y: str, xs: Sequence[str], rounds: int = 40) -> DataFrame:
    """term, coef, se, z, p, converged of a proportional-odds logit: cut points and slopes by Fisher scoring; one aggregate a trial, over design().

    Fewer than three grades are refused, and more than 50.
    """
    table, mean, sd = design(rows, y, xs)
    counts = [(r["y"], r["n"]) for r in table.groupBy("y").agg(F.sum("n").alias("n")).orderBy("y").limit(51).collect()]
    if len(counts) > 50:
        raise ValueError("more than 50 grades")
    if len(counts) < 3:
        raise ValueError("an ordered logit needs three grades or more")
    cuts, k = len(counts) - 1, len(xs)
    m = cuts + k
    code = sum((F.when(F.col("y") == g, j).otherwise(0) for j, (g, _) in enumerate(counts)), F.lit(0))
    table = table.withColumn("__c", code)
    # where all slopes are 0, the cut points are the log-odds of the shares below
    below = np.cumsum([n for _, n in counts])[:-1] / sum(n for _, n in counts)
    x = [F.col(f"x{i}") for i in range(k)]
    # pairs of values that share a grade's probability: a cut with itself and the next, and all with the slopes
    pairs = [(a, b) for a in range(m) for b in range(a, m) if b >= cuts or b - a <= 1]

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.lit(float(b)) * c for b, c in zip(theta[cuts:], x, strict=True)), F.lit(0.0))
        at = table.withColumn("__eta", eta).withColumns({f"__u{j}": 1 / (1 + F.exp(F.col("__eta") - float(theta[j]))) for j in range(cuts)})
        u = [F.lit(0.0), *(F.col(f"__u{j}") for j in range(cuts)), F.lit(1.0)]
        f = [F.lit(0.0), *(F.col(f"__u{j}") * (1 - F.col(f"__u{j}")) for j in range(cuts)), F.lit(0.0)]
        at = at.withColumns({f"__p{j}": F.greatest(u[j + 1] - u[j], F.lit(1e-300)) for j in range(cuts + 1)} | {f"__f{j}": f[j + 1] - f[j] for j in range(cuts + 1)} | {f"__g{j}": f[j + 1] for j in range(cuts)})
        p, d, g, n = (lambda j: F.col(f"__p{j}")), (lambda j: F.col(f"__f{j}")), (lambda j: F.col(f"__g{j}")), F.col("n")
        own = lambda value: F.coalesce(*(F.when(F.col("__c") == j, value(j)) for j in range(cuts + 1)))
        ll = F.sum(n * F.log(own(p)))
        gradient = [F.sum(n * F.when(F.col("__c") == a, g(a) / p(a)).when(F.col("__c") == a + 1, -g(a) / p(a + 1)).otherwise(0.0)) for a in range(cuts)]
        gradient += [F.sum(-n * own(lambda j: d(j) / p(j)) * c) for c in x]

        def shared(a: int, b: int) -> Column:
            """The expected product of the two derivatives of the log-likelihood, of one row."""
            if b < cuts:
                return g(a) * g(a) * (1 / p(a) + 1 / p(a + 1)) if a == b else -g(a) * g(b) / p(b)
            if a < cuts:
                return -g(a) * (d(a) / p(a) - d(a + 1) / p(a + 1)) * x[b - cuts]
            return sum((d(j) * d(j) / p(j) for j in range(cuts + 1)), F.lit(0.0)) * x[a - cuts] * x[b - cuts]

        got = [float(v or 0) for v in at.agg(ll.alias("ll"), *(v.alias(f"g{i}") for i, v in enumerate(gradient)), *(F.sum(n * shared(a, b)).alias(f"h{a}_{b}") for a, b in pairs)).first()]
        information = np.zeros((m, m))
        for (a, b), v in zip(pairs, got[1 + m :], strict=True):
            information[a, b] = information[b, a] = v
        return got[0], np.array(got[1 : 1 + m]), information

    theta, _, cov, converged = _maximised(evaluate, np.concatenate([np.log(below / (1 - below)), np.zeros(k)]), rounds, lambda t: bool((np.diff(t[:cuts]) > 0).all()))
    back = np.eye(m)
    back[:cuts, cuts:], back[cuts:, cuts:] = mean / sd, np.diag(1 / sd)
    theta, se = back @ theta, np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0))
    names = [*(f"cut_{j + 1}" for j in range(cuts)), *xs]
    z = theta / np.maximum(se, 1e-300)
    return rows.sparkSession.createDataFrame([(t, *map(float, v), converged) for t, *v in zip(names, theta, se, z, normal_p(z), strict=True)], "term string, coef double, se double, z double, p double, converged boolean")
