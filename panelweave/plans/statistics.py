"""Catalogue: association statistics, models and gap scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import effect_label
from ..operators import gap, linear, panel, rank_stats, tokens
from ..sources.scratch import written
from ..sources.tables import table
from .documents import FEATURES, GRID_SQL, LISTS, grid, q, ratios
from .panels import labels
from .registry import SQL, query

MEASURES = ["total_tokens", "esg_count", "g_count", "esg_ratio", "g_ratio", "esg_g_relative"]
PANEL = f"{FEATURES}, pa AS (SELECT f.*, quality, toxic, 2 * quality + toxic AS grade, 2019 + f.doc_id % 3 AS yr FROM f JOIN labels USING (doc_id))"
AVG_RANK = lambda c, g: f"rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0::DOUBLE"
CORR = lambda x, y: f"CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
EFFECT = "CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) >= 0.40 THEN 'moderate-strong' WHEN abs(rho) >= 0.25 THEN 'moderate' WHEN abs(rho) >= 0.10 THEN 'weak' ELSE 'negligible' END"


def long_sql(ids: str, y: str = "grade") -> str:
    return f"SELECT {ids + ', ' if ids else ''}{y}::DOUBLE AS y, m.feature AS feature, m.x AS x FROM (SELECT *, unnest([{', '.join(f'''{{'feature': '{c}', 'x': {c}::DOUBLE}}''' for c in MEASURES)}]) AS m FROM pa)"


def rho_sql(src: str, group: str, least: int = 5, places: int = 4) -> str:
    return f"SELECT {group}, count(*) AS n, CASE WHEN count(*) >= {least} THEN round({CORR('rx', 'ry')}, {places}) END AS rho FROM (SELECT {group}, {AVG_RANK('x', group)} AS rx, {AVG_RANK('y', group)} AS ry FROM ({src}) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY {group}"


def rated(spark, sf_dir):
    rows = panel.merge(ratios(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], ["quality", "toxic"])
    return rows.withColumn("grade", 2 * F.col("quality") + F.col("toxic")).withColumn("yr", 2019 + F.col("doc_id") % 3)


def long(spark, sf_dir, ids, y="grade"):
    return panel.melt(rated(spark, sf_dir), [*ids, y], MEASURES).withColumn("y", F.col(y).cast("double")).select(*ids, "feature", "x", "y")


def xy(spark, sf_dir, x="total_tokens", y="grade"):
    return rated(spark, sf_dir).select("doc_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


@query(f"WITH {PANEL} {rho_sql(long_sql(''), 'feature')}")
def doc_ratio_spearman(spark, sf_dir):
    return rank_stats.spearman(long(spark, sf_dir, []), ["feature"])


@query(f"WITH {PANEL}, r AS ({rho_sql(long_sql(''), 'feature')}) SELECT *, {EFFECT} AS effect FROM r")
def effect_labels(spark, sf_dir):
    return rank_stats.with_effect(rank_stats.spearman(long(spark, sf_dir, []), ["feature"]))


@query(f"WITH {PANEL} {rho_sql(long_sql('lang'), 'lang, feature')}")
def rho_matrix(spark, sf_dir):
    return rank_stats.spearman(long(spark, sf_dir, ["lang"]), ["lang", "feature"])


@query(f"WITH {PANEL}, r AS ({rho_sql(long_sql('lang'), 'lang, feature')}) SELECT feature, a.lang AS lang_a, b.lang AS lang_b, round(a.rho - b.rho, 4) AS delta_rho FROM r a JOIN r b USING (feature) WHERE a.lang < b.lang")
def rho_delta(spark, sf_dir):
    """Each two languages' difference, the one that comes first less the other."""
    r = rank_stats.spearman(long(spark, sf_dir, ["lang"]), ["lang", "feature"])
    a, b = (r.select("feature", F.col("lang").alias(f"lang_{x}"), F.col("rho").alias(f"rho_{x}")) for x in "ab")
    return a.join(b, "feature").where("lang_a < lang_b").select("feature", "lang_a", "lang_b", F.round(F.col("rho_a") - F.col("rho_b"), 4).alias("delta_rho"))


@query(f"WITH {PANEL}, r AS ({rho_sql(long_sql('lang'), 'lang, feature')}) SELECT feature, count(rho) AS n, round(max(rho) - min(rho), 4) AS rho_range, coalesce(min(sign(rho)) = max(sign(rho)), false) AS sign_consistent FROM r GROUP BY 1")
def sign_consistency(spark, sf_dir):
    r = rank_stats.spearman(long(spark, sf_dir, ["lang"]), ["lang", "feature"])
    return r.groupBy("feature").agg(F.count("rho").alias("n"), F.round(F.max("rho") - F.min("rho"), 4).alias("rho_range"), F.coalesce(F.min(F.signum("rho")) == F.max(F.signum("rho")), F.lit(False)).alias("sign_consistent"))


@query(f"WITH {PANEL} {rho_sql(long_sql('yr'), 'yr, feature')}")
def year_sliced_rho(spark, sf_dir):
    return rank_stats.spearman(long(spark, sf_dir, ["yr"]), ["yr", "feature"])


B = 60
#: Replicates of the queries named _full: bootstrap and subsamples, permutations, regressions.
N_BOOT, N_PERM, N_OLS = 3000, 5000, 1000


def full_sql(name: str, b: int) -> str:
    """The SQL of a resampling query with b replicates."""
    return SQL[name].replace(f"range({B})", f"range({b})")


NUMBERED = f"{PANEL}, nu AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, total_tokens::DOUBLE AS x, grade::DOUBLE AS y FROM pa WHERE total_tokens IS NOT NULL AND grade IS NOT NULL)"
SORTED = f"{NUMBERED}, fan AS (SELECT b, i, x, y, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', b, i)), i) - 1 AS k FROM nu, range({B}) r(b))"
BOOT = f"{NUMBERED}, dr AS (SELECT b, ('0x' || substr(md5(concat_ws('|', b, s)), 1, 8))::BIGINT % (SELECT count(*) FROM nu) AS i FROM range({B}) r(b), (SELECT i AS s FROM nu)), rb AS ({rho_sql('SELECT b, x, y FROM dr JOIN nu USING (i)', 'b', places=10)})"


@query(f"WITH {BOOT} SELECT count(*) AS n_boot, round(quantile_cont(rho, 0.025), 4) AS ci_lo, round(quantile_cont(rho, 0.975), 4) AS ci_hi, round(avg(CASE WHEN rho > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS share_positive, ci_lo > 0 OR ci_hi < 0 AS ci_excludes_zero FROM rb WHERE rho IS NOT NULL")
def spearman_bootstrap(spark, sf_dir, b=B):
    return rank_stats.interval(rank_stats.bootstrap_rhos(xy(spark, sf_dir), b, ["doc_id"]))


@query(full_sql("spearman_bootstrap", N_BOOT))
def spearman_bootstrap_full(spark, sf_dir):
    return spearman_bootstrap(spark, sf_dir, N_BOOT)


DRAWN = f"{PANEL}, lo AS ({long_sql('doc_id')}), nf AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n, x, y FROM lo WHERE x IS NOT NULL AND y IS NOT NULL), df AS (SELECT feature, b, ('0x' || substr(md5(concat_ws('|', feature, b, i)), 1, 8))::BIGINT % n AS i FROM nf, range({N_BOOT}) r(b)), rf AS ({rho_sql('SELECT feature, b, x, y FROM df JOIN nf USING (feature, i)', 'feature, b', places=10)})"


@query(f"WITH {DRAWN}, r AS ({rho_sql('SELECT feature, x, y FROM lo', 'feature')}), iv AS (SELECT feature, count(*) AS n_boot, round(quantile_cont(rho, 0.025), 4) AS ci_lo, round(quantile_cont(rho, 0.975), 4) AS ci_hi FROM rf WHERE rho IS NOT NULL GROUP BY 1) SELECT r.*, {EFFECT} AS effect, n_boot, ci_lo, ci_hi, ci_lo > 0 OR ci_hi < 0 AS ci_excludes_zero FROM r LEFT JOIN iv USING (feature)")
def metrics_with_interval(spark, sf_dir):
    """The metrics of every feature with the interval of 3,000 resamples."""
    rows = written(long(spark, sf_dir, ["doc_id"]), "long")
    return rank_stats.with_interval(rank_stats.spearman(rows, ["feature"]), rank_stats.interval(rank_stats.bootstrap_rhos(rows, N_BOOT, ["doc_id"], ["feature"]), group=["feature"]), ["feature"])


@query(f"WITH {SORTED}, pr AS ({rho_sql('SELECT b, n.x AS x, fan.y AS y FROM fan JOIN nu n ON n.i = fan.k', 'b', places=10)}), ob AS ({rho_sql('SELECT 0 AS one, x, y FROM nu', 'one')}) SELECT ob.rho AS observed_rho, ob.n AS n, count(*) AS n_permutations, round(avg(CASE WHEN abs(pr.rho) >= abs(ob.rho) THEN 1.0::DOUBLE ELSE 0 END), 4) AS permutation_p, round(avg(pr.rho), 4) AS null_mean, round(stddev_samp(pr.rho), 4) AS null_std, round(quantile_cont(abs(pr.rho), 0.95), 4) AS null_95th FROM pr, ob WHERE pr.rho IS NOT NULL GROUP BY 1, 2")
def permutation_test(spark, sf_dir, b=B):
    pairs = xy(spark, sf_dir)
    return rank_stats.permutation_summary(rank_stats.permuted_rhos(pairs, b, ["doc_id"]), rank_stats.spearman(pairs, []))


@query(full_sql("permutation_test", N_PERM))
def permutation_test_full(spark, sf_dir):
    return permutation_test(spark, sf_dir, N_PERM)


@query(f"WITH {SORTED}, sr AS ({rho_sql('SELECT b, x, y FROM fan WHERE k < 30', 'b', places=10)}) SELECT count(*) AS n_trials, round(avg(CASE WHEN rho > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS share_positive, round(avg(rho), 4) AS mean_rho FROM sr WHERE rho IS NOT NULL")
def subsample_sign(spark, sf_dir, b=B):
    r = rank_stats.subsample_rhos(xy(spark, sf_dir), b, [30], ["doc_id"]).where("rho is not null")
    return r.agg(F.count(F.lit(1)).alias("n_trials"), F.round(F.avg((F.col("rho") > 0).cast("double")), 4).alias("share_positive"), F.round(F.avg("rho"), 4).alias("mean_rho"))


@query(full_sql("subsample_sign", N_BOOT))
def subsample_sign_full(spark, sf_dir):
    return subsample_sign(spark, sf_dir, N_BOOT)


CURVE = [30, 90, 210]


@query(f"WITH {SORTED}, c AS (SELECT unnest({CURVE}) AS size), sr AS ({rho_sql('SELECT size, b, x, y FROM fan, c WHERE k < size', 'size, b', places=10)}) SELECT size, count(rho) AS n_trials, round(avg(rho), 4) AS mean_rho FROM sr GROUP BY 1")
def n_curve(spark, sf_dir, b=B):
    r = rank_stats.subsample_rhos(xy(spark, sf_dir), b, CURVE, ["doc_id"])
    return r.groupBy("size").agg(F.count("rho").alias("n_trials"), F.round(F.avg("rho"), 4).alias("mean_rho"))


@query(full_sql("n_curve", N_BOOT))
def n_curve_full(spark, sf_dir):
    return n_curve(spark, sf_dir, N_BOOT)


def tail_sql(z: str) -> str:
    k = f"(1 / (1 + 0.2316419::DOUBLE * ({z})))"
    return f"(0.3989422804014327::DOUBLE * exp(-({z}) * ({z}) / 2) * ({k} * (0.319381530::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE))))))"


def mwu_sql(src: str, group: str) -> str:
    return f"""ra AS (SELECT {group}, x, high, {AVG_RANK('x', group)} AS r, (count(*) OVER (PARTITION BY {group}, x))::DOUBLE AS t FROM ({src}) WHERE x IS NOT NULL AND high IS NOT NULL),
    ag AS (SELECT {group}, count(*) FILTER (high) AS n_high, count(*) FILTER (NOT high) AS n_low, coalesce(sum(r) FILTER (high), 0) AS sr, avg(x) FILTER (high) AS mh, avg(x) FILTER (NOT high) AS ml, sum(t * t - 1) AS ties FROM ra GROUP BY {group}),
    us AS (SELECT *, sr - n_high * (n_high + 1) / 2.0::DOUBLE AS uu, n_high::DOUBLE * n_low AS hl, (n_high + n_low)::DOUBLE AS nn FROM ag WHERE n_high >= 2 AND n_low >= 2),
    zs AS (SELECT *, coalesce(greatest(abs(uu - hl / 2) - 0.5, 0.0) / nullif(sqrt(hl / 12 * (nn + 1 - ties / (nn * (nn - 1)))), 0), 0) AS z, coalesce((uu - hl / 2 - 0.5) / nullif(sqrt(hl / 12 * (nn + 1 - ties / (nn * (nn - 1)))), 0), 0) AS zg FROM us),
    mw AS (SELECT {group}, n_high, n_low, round(uu, 1) AS u, round(1 - 2 * uu / hl, 6) AS rank_biserial, round(least(1.0, 2 * {tail_sql('z')}), 6) AS p_norm, round(CASE WHEN zg >= 0 THEN {tail_sql('abs(zg)')} ELSE 1 - {tail_sql('abs(zg)')} END, 6) AS p_greater, CASE WHEN mh >= ml THEN 'high>low' ELSE 'high<low' END AS direction FROM zs)"""


@query(f"WITH {PANEL}, {mwu_sql('SELECT feature, x, y >= 2 AS high FROM (' + long_sql('') + ')', 'feature')} SELECT * FROM mw")
def mann_whitney(spark, sf_dir):
    return rank_stats.mann_whitney(long(spark, sf_dir, []).withColumn("high", F.col("y") >= 2), ["feature"])


@query(f"WITH {PANEL}, lo AS ({long_sql('lang')}), ra AS (SELECT feature, lang, {AVG_RANK('x', 'feature')} AS r, (count(*) OVER (PARTITION BY feature, x))::DOUBLE AS t FROM lo WHERE x IS NOT NULL AND lang IS NOT NULL), bc AS (SELECT feature, lang, count(*)::DOUBLE AS m, sum(r) AS sr, sum(t * t - 1) AS ties FROM ra GROUP BY 1, 2), o AS (SELECT feature, sum(m) AS n, count(*) AS k, sum(sr * sr / m) AS s, sum(ties) AS ties FROM bc GROUP BY 1) SELECT feature, n::BIGINT AS n, k, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0), 4) AS h FROM o")
def kruskal_wallis(spark, sf_dir):
    return rank_stats.kruskal_wallis(long(spark, sf_dir, ["lang"]).withColumnRenamed("lang", "cls"), ["feature"])


@query(f"WITH {PANEL} SELECT grade, count(*) AS n, round(avg(log_tokens), 4) AS mean, round(quantile_cont(log_tokens, 0.5), 4) AS median, round(stddev_samp(log_tokens), 4) AS std, round(avg(log_tokens) - 1.96::DOUBLE * stddev_samp(log_tokens) / sqrt(count(*)), 4) AS ci_lo, round(avg(log_tokens) + 1.96::DOUBLE * stddev_samp(log_tokens) / sqrt(count(*)), 4) AS ci_hi FROM pa GROUP BY 1 HAVING count(*) >= 2")
def grade_group_stats(spark, sf_dir):
    x, n = F.col("log_tokens"), F.count(F.lit(1))
    half = 1.96 * F.stddev_samp(x) / F.sqrt(n)
    return rated(spark, sf_dir).groupBy("grade").agg(n.alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.percentile(x, F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp(x), 4).alias("std"), F.round(F.avg(x) - half, 4).alias("ci_lo"), F.round(F.avg(x) + half, 4).alias("ci_hi")).where("n >= 2")


QUARTERS = "qs AS (SELECT *, CASE WHEN total_tokens <= e[1] THEN 1 WHEN total_tokens <= e[2] THEN 2 WHEN total_tokens <= e[3] THEN 3 WHEN total_tokens IS NOT NULL THEN 4 END AS q FROM pa, (SELECT [quantile_cont(total_tokens::DOUBLE, 0.25), quantile_cont(total_tokens::DOUBLE, 0.5), quantile_cont(total_tokens::DOUBLE, 0.75)] AS e FROM pa))"


@query(f"WITH {PANEL}, {QUARTERS} SELECT q, count(*) AS n, round(avg(g_ratio), 5) AS mean_g, round(avg(grade::DOUBLE), 4) AS mean_grade FROM qs GROUP BY 1")
def quartile_paradox(spark, sf_dir):
    rows = panel.quartile(rated(spark, sf_dir), "total_tokens")
    return rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g_ratio"), 5).alias("mean_g"), F.round(F.avg("grade"), 4).alias("mean_grade"))


@query(f"WITH {PANEL}, {QUARTERS}, {mwu_sql('SELECT 1 AS one, g_ratio AS x, q = 4 AS high FROM qs WHERE q IN (1, 4)', 'one')} SELECT n_high, n_low, u, rank_biserial, p_norm, p_greater, direction FROM mw")
def quartile_mwu(spark, sf_dir):
    rows = panel.quartile(rated(spark, sf_dir), "total_tokens").where("q in (1, 4)")
    return rank_stats.mann_whitney(rows.select(F.col("g_ratio").alias("x"), (F.col("q") == 4).alias("high")), [])


OK = f"{PANEL}, ok AS (SELECT *, grade::DOUBLE AS y, log_tokens AS x1, g_ratio AS x2 FROM pa WHERE grade IS NOT NULL AND log_tokens IS NOT NULL AND g_ratio IS NOT NULL)"


def model_rows(spark, sf_dir):
    return rated(spark, sf_dir).select("doc_id", "lang", F.col("grade").cast("double").alias("y"), F.col("log_tokens").alias("x1"), F.col("g_ratio").alias("x2"), F.col("quality").cast("double").alias("quality"))


@query(f"WITH {OK}, c AS (SELECT count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2 FROM ok), e AS (SELECT sum((y - a - b * x1) * (y - a - b * x1)) AS rss, any_value(n) AS n, any_value(var_x) AS vx, any_value(mx) AS mx FROM ok, c, (SELECT var_pop(x1) * count(*) AS var_x, avg(x1) AS mx FROM ok)) SELECT 'M1' AS model, 'x1' AS term, round(b, 5) AS coef, round(sqrt(rss / (c.n - 2) / vx), 5) AS se, c.n AS n, round(r2, 5) AS r2 FROM c, e UNION ALL SELECT 'M1', 'intercept', round(a, 5), round(sqrt(rss / (c.n - 2) * (1.0::DOUBLE / c.n + mx * mx / vx)), 5), c.n, round(r2, 5) FROM c, e")
def ols_m1(spark, sf_dir):
    got = linear.ols(model_rows(spark, sf_dir), "y", ["x1"], label="M1")
    return got.select("model", "term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), "n", F.round("r2", 5).alias("r2"))


TWO = f"{OK}, m AS (SELECT count(*) AS n, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM ok), b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM m)"


@query(f"WITH {TWO} SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 4) AS coef, n FROM b UNION ALL SELECT 'x1', round(b1, 4), n FROM b UNION ALL SELECT 'x2', round(b2, 4), n FROM b")
def ols_m2(spark, sf_dir):
    return linear.ols(model_rows(spark, sf_dir), "y", ["x1", "x2"]).select("term", F.round("coef", 4).alias("coef"), "n")


@query(f"WITH {OK}, c AS (SELECT count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(x1) AS mx, var_pop(x1) * count(*) AS vx FROM ok) SELECT 'x1' AS term, round(any_value(b), 5) AS coef, round(sqrt(sum((y - a - b * x1) * (y - a - b * x1) * (x1 - mx) * (x1 - mx)) / any_value(vx * vx) * any_value(n) / (any_value(n) - 2)), 5) AS se FROM ok, c")
def ols_hc1(spark, sf_dir):
    got = linear.ols(model_rows(spark, sf_dir), "y", ["x1"], robust=True).where("term = 'x1'")
    return got.select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"))


@query(f"WITH {OK}, r AS (SELECT {CORR('x1', 'x2')} AS r FROM ok) SELECT unnest(['x1', 'x2']) AS term, round(1 / (1 - r * r), 6) AS vif, CASE WHEN 1 / (1 - r * r) > 10 THEN 'HIGH' WHEN 1 / (1 - r * r) > 5 THEN 'MODERATE' ELSE 'OK' END AS flag FROM r")
def vif_pair(spark, sf_dir):
    return linear.vif(model_rows(spark, sf_dir), ["x1", "x2"]).select("term", F.round("vif", 6).alias("vif"), "flag")


COOK = f"{OK}, c AS (SELECT count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(x1) AS mx, var_pop(x1) * count(*) AS vx FROM ok), e AS (SELECT doc_id, y - a - b * x1 AS e, 1.0::DOUBLE / n + (x1 - mx) * (x1 - mx) / vx AS h, n FROM ok, c), s AS (SELECT sum(e * e) / (any_value(n) - 2) AS s2 FROM e), ck AS (SELECT doc_id, e * e * h / (2 * s2 * (1 - h) * (1 - h)) AS d, n FROM e, s)"


@query(f"WITH {COOK} SELECT count(*) AS n, sum(CASE WHEN d > 4.0::DOUBLE / n THEN 1 ELSE 0 END)::BIGINT AS n_influential, round(max(d), 6) AS max_d FROM ck")
def cooks_distance(spark, sf_dir):
    rows = linear.cooks(model_rows(spark, sf_dir), "y", ["x1"])
    n = F.count(F.lit(1))
    total = rows.agg(n.alias("__n"))
    return rows.join(F.broadcast(total)).agg(n.alias("n"), F.sum((F.col("cooks_d") > 4 / F.col("__n")).cast("bigint")).alias("n_influential"), F.round(F.max("cooks_d"), 6).alias("max_d"))


@query(f"WITH {COOK}, e2 AS (SELECT e.e * e.e AS e2, x1 FROM e JOIN ok USING (doc_id)) SELECT round(count(*) * regr_r2(e2, x1), 4) AS lm, count(*) AS n FROM e2")
def breusch_pagan(spark, sf_dir):
    return linear.breusch_pagan(model_rows(spark, sf_dir), "y", ["x1"]).select(F.round("lm", 4).alias("lm"), "n")


@query(f"WITH {OK}, nn AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, x1, y FROM ok), dr AS (SELECT b, ('0x' || substr(md5(concat_ws('|', b, s)), 1, 8))::BIGINT % (SELECT count(*) FROM nn) AS i FROM range({B}) r(b), (SELECT i AS s FROM nn)), sl AS (SELECT b, regr_slope(y, x1) AS s FROM dr JOIN nn USING (i) GROUP BY 1) SELECT count(*) AS n_boot, round(avg(s), 5) AS mean, round(quantile_cont(s, 0.025), 5) AS ci_lo, round(quantile_cont(s, 0.975), 5) AS ci_hi FROM sl")
def ols_bootstrap(spark, sf_dir, b=B):
    slopes = rank_stats.bootstrap_slopes(linear.complete(model_rows(spark, sf_dir), ["y", "x1", "x2"]), b, ["doc_id"], "y", "x1")
    return slopes.agg(F.count("slope").alias("n_boot"), F.round(F.avg("slope"), 5).alias("mean"), F.round(F.percentile("slope", F.lit(0.025)), 5).alias("ci_lo"), F.round(F.percentile("slope", F.lit(0.975)), 5).alias("ci_hi"))


@query(full_sql("ols_bootstrap", N_OLS))
def ols_bootstrap_full(spark, sf_dir):
    return ols_bootstrap(spark, sf_dir, N_OLS)


@query()
def binary_logit(spark, sf_dir):
    return linear.logit(model_rows(spark, sf_dir), "quality", ["x1", "x2"])


@query()
def ordered_logit(spark, sf_dir):
    return linear.ordered_logit(model_rows(spark, sf_dir), "y", ["x1", "x2"])


ORTH = f"{PANEL}, fi AS (SELECT regr_slope(g_ratio, log_tokens) AS b, regr_intercept(g_ratio, log_tokens) AS a FROM pa), orr AS (SELECT *, g_ratio - (b * log_tokens + a) AS g_orth FROM pa, fi)"


def orth(spark, sf_dir):
    return gap.orthogonal(rated(spark, sf_dir), "g_ratio", "log_tokens", "g_orth")


@query(f"WITH {ORTH}, o AS ({rho_sql('SELECT 1 AS one, round(g_orth, 9) AS x, grade AS y FROM orr', 'one')}), r AS ({rho_sql('SELECT 1 AS one, g_ratio AS x, grade AS y FROM orr', 'one')}) SELECT r.rho AS rho_raw, o.rho AS rho_orth, round((1 - abs(o.rho) / nullif(abs(r.rho), 0)) * 100, 2) AS shrinkage_pct FROM o, r")
def orthogonalize(spark, sf_dir):
    rows = orth(spark, sf_dir)
    raw = rank_stats.spearman(rows.select(F.col("g_ratio").alias("x"), F.col("grade").alias("y")), []).select(F.col("rho").alias("rho_raw"))
    adjusted = rank_stats.spearman(rows.select(F.round("g_orth", 9).alias("x"), F.col("grade").alias("y")), []).select(F.col("rho").alias("rho_orth"))
    both = raw.join(F.broadcast(adjusted))  # one row each
    return both.select("rho_raw", "rho_orth", F.round((1 - F.try_divide(F.abs("rho_orth"), F.abs("rho_raw"))) * 100, 2).alias("shrinkage_pct"))


@query(f"WITH {ORTH}, md AS (SELECT quantile_cont(grade::DOUBLE, 0.5) AS md FROM orr) SELECT CASE WHEN g_orth > 0 AND grade >= md THEN 'high_high' WHEN g_orth > 0 THEN 'high_low' WHEN grade >= md THEN 'low_high' ELSE 'low_low' END AS quadrant, count(*) AS n FROM orr, md WHERE g_orth IS NOT NULL GROUP BY 1")
def verbosity_quadrants(spark, sf_dir):
    rows = orth(spark, sf_dir).where("g_orth is not null")
    middle = rows.agg(F.percentile("grade", F.lit(0.5)).alias("md"))
    high, good = F.col("g_orth") > 0, F.col("grade") >= F.col("md")
    name = F.when(high & good, "high_high").when(high, "high_low").when(good, "low_high").otherwise("low_low")
    return rows.join(F.broadcast(middle)).groupBy(name.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


FIRMS = """ls AS (SELECT l_suppkey AS firm, year(l_shipdate) AS yr, count(*) AS volume, avg(l_discount) AS talk, avg(l_quantity) AS walk, avg(l_tax) AS soc FROM lineitem GROUP BY 1, 2), fl AS (SELECT *, ln(1.0::DOUBLE + volume) AS lv FROM ls)"""
Z = lambda c, p="": f"CASE WHEN stddev_samp({c}) OVER ({p}) > 1e-12 THEN ({c} - avg({c}) OVER ({p})) / stddev_samp({c}) OVER ({p}) END"
GAP = f"{FIRMS}, fi AS (SELECT regr_slope(talk, lv) AS bt, regr_intercept(talk, lv) AS a1, regr_slope(walk, lv) AS bw, regr_intercept(walk, lv) AS aw FROM fl), rs AS (SELECT *, talk - (bt * lv + a1) AS rt, walk - (bw * lv + aw) AS rw FROM fl, fi), qd AS (SELECT *, CASE WHEN rt > 0 AND rw <= 0 THEN 'over' WHEN rt <= 0 AND rw > 0 THEN 'under' WHEN rt > 0 AND rw > 0 THEN 'aligned' ELSE 'consistent_low' END AS quadrant FROM rs)"


def firms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), F.year("l_shipdate").cast("bigint").alias("yr"))
    return rows.agg(F.count(F.lit(1)).alias("volume"), F.avg("l_discount").alias("talk"), F.avg("l_quantity").alias("walk"), F.avg("l_tax").alias("soc")).withColumn("lv", F.log1p(F.col("volume").cast("double")))


def gaps(spark, sf_dir):
    rows = gap.orthogonal(gap.orthogonal(firms(spark, sf_dir), "talk", "lv", "rt"), "walk", "lv", "rw")
    return rows.withColumn("quadrant", gap.quadrant(F.col("rt"), F.col("rw")))


@query(f"WITH {GAP} SELECT quadrant, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM qd GROUP BY 1")
def gap_matrix(spark, sf_dir):
    return gap.shares(gaps(spark, sf_dir), "quadrant")


@query(f"WITH {GAP}, z AS (SELECT firm, yr, {Z('rt')} - ({Z('rw')}) AS gap FROM qd) SELECT firm, yr, round(gap, 5) AS gap FROM z")
def gap_score(spark, sf_dir):
    return gap.z_scores(gaps(spark, sf_dir), {"zt": "rt", "zw": "rw"}).select("firm", "yr", F.round(F.col("zt") - F.col("zw"), 5).alias("gap"))


@query(f"WITH {GAP}, f AS (SELECT firm, count(*) AS n, count(DISTINCT quadrant) AS k FROM qd GROUP BY 1) SELECT count(*) AS n_firms, count(*) FILTER (k = 1) AS n_persistent FROM f WHERE n >= 3")
def gap_persistence(spark, sf_dir):
    return gap.persistence(gaps(spark, sf_dir), "firm", "quadrant", 3)


AXES = f"{FIRMS}, az AS (SELECT firm, yr, round({Z('talk')}, 8) AS e, round({Z('soc')}, 8) AS s, round({Z('walk')}, 8) AS g FROM fl)"


@query(f"WITH {AXES}, ax AS (SELECT *, ['e', 's', 'g'][list_position([e, s, g], greatest(e, s, g))] AS top_axis, ['e', 's', 'g'][list_position([e, s, g], least(e, s, g))] AS low_axis FROM az) SELECT top_axis, low_axis, count(*) AS n, round(avg(g), 4) AS mean_g FROM ax GROUP BY 1, 2")
def selective_axis(spark, sf_dir):
    rows = gap.z_scores(firms(spark, sf_dir), {"e": "talk", "s": "soc", "g": "walk"}).select("firm", "yr", *(F.round(k, 8).alias(k) for k in "esg"))
    return gap.axes(rows, ["e", "s", "g"]).groupBy("top_axis", "low_axis").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 4).alias("mean_g"))


@query(f"WITH {FIRMS}, z AS (SELECT firm, yr, s_nationkey % 3 AS grp, {Z('talk')} AS zt, {Z('walk')} AS zw FROM fl JOIN supplier ON firm = s_suppkey), w(grp, w_talk, w_walk) AS (VALUES (0, 0.5::DOUBLE, 0.5::DOUBLE), (1, 0.2::DOUBLE, 0.8::DOUBLE), (2, 1.0::DOUBLE, 0.0::DOUBLE)) SELECT firm, yr, round(coalesce(w_talk * zt, 0) + coalesce(w_walk * zw, 0), 5) AS weighted_score FROM z JOIN w USING (grp)")
def materiality_score(spark, sf_dir):
    rows = firms(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), (F.col("s_nationkey") % 3).alias("grp")), "firm")
    weights = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.2, 0.8), (2, 1.0, 0.0)], "grp int, w_talk double, w_walk double")
    return gap.weighted(rows, ["talk", "walk"], weights, "grp").select("firm", "yr", F.round("weighted_score", 5).alias("weighted_score"))


@query(f"WITH {FIRMS}, d AS (SELECT firm, yr, talk - lag(talk) OVER w AS d_talk, walk - lag(walk) OVER w AS d_walk, row_number() OVER w AS k FROM fl WINDOW w AS (PARTITION BY firm ORDER BY yr)) SELECT firm, yr, round(d_talk, 6) + 0.0::DOUBLE AS d_talk, round(d_walk, 6) + 0.0::DOUBLE AS d_walk FROM d WHERE k > 1")
def within_firm_delta(spark, sf_dir):
    rows = gap.change(firms(spark, sf_dir), "firm", "yr", ["talk", "walk"])
    return rows.select("firm", "yr", (F.round("d_talk", 6) + 0.0).alias("d_talk"), (F.round("d_walk", 6) + 0.0).alias("d_walk"))


@query(f"WITH {FIRMS}, d AS (SELECT firm, yr, talk - lag(talk) OVER w AS dt, walk - lag(walk) OVER w AS dw, row_number() OVER w AS k FROM fl WINDOW w AS (PARTITION BY firm ORDER BY yr)) SELECT round(regr_slope(dw, dt), 4) AS slope, count(*) AS n FROM d WHERE k > 1")
def within_firm_regression(spark, sf_dir):
    rows = gap.change(firms(spark, sf_dir), "firm", "yr", ["talk", "walk"])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return gap.line(rows, "d_walk", "d_talk").select(F.round("slope", 4).alias("slope")).join(F.broadcast(n))


@query(f"WITH {PANEL}, dm AS (SELECT lang, g_ratio - avg(g_ratio) OVER (PARTITION BY lang) AS gy, log_tokens - avg(log_tokens) OVER (PARTITION BY lang) AS gx FROM pa WHERE g_ratio IS NOT NULL AND log_tokens IS NOT NULL) SELECT round(regr_slope(gy, gx), 6) AS slope FROM dm")
def fixed_effect_slope(spark, sf_dir):
    rows = linear.complete(rated(spark, sf_dir), ["g_ratio", "log_tokens"])
    return gap.line(linear.within(rows, ["g_ratio", "log_tokens"], "lang"), "g_ratio", "log_tokens").select(F.round("slope", 6).alias("slope"))


@query(f"WITH {PANEL}, rk AS (SELECT {AVG_RANK('total_tokens', '1')} AS rx, {AVG_RANK('grade', '1')} AS ry FROM pa) SELECT round(regr_slope(ry, rx), 5) AS slope, round(regr_intercept(ry, rx), 4) AS intercept FROM rk")
def rank_trend(spark, sf_dir):
    line = rank_stats.rank_line(xy(spark, sf_dir))
    return line.select(F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"WITH {GRID_SQL}, s AS (SELECT exp_id, avg(len(t)) AS m FROM grid GROUP BY 1), b AS (SELECT m AS bm FROM s WHERE exp_id = 'exp_B') SELECT exp_id, round(m, 4) AS mean_tokens, round((bm - m) / bm * 100, 4) AS loss_pct FROM s, b")
def variant_diagnostics(spark, sf_dir):
    s = tokens.grid_sizes(grid(spark, sf_dir), 12).select("exp_id", F.col("avg_tokens").alias("m"))
    base = s.where("exp_id = 'exp_B'").select(F.col("m").alias("bm"))
    return s.join(F.broadcast(base)).select("exp_id", F.round("m", 4).alias("mean_tokens"), F.round((F.col("bm") - F.col("m")) / F.col("bm") * 100, 4).alias("loss_pct"))


INLINE, OFFICIAL = LISTS.stop_words("extended"), ["the", "for", "with", "la", "zu"]


@query(f"WITH i AS (SELECT unnest([{q(INLINE)}]) AS t), o AS (SELECT unnest([{q(OFFICIAL)}]) AS t) SELECT t AS term, CASE WHEN t IN (SELECT t FROM i) AND t IN (SELECT t FROM o) THEN 'both' WHEN t IN (SELECT t FROM i) THEN 'first' ELSE 'second' END AS provenance FROM (SELECT t FROM i UNION SELECT t FROM o)")
def stop_list_lineage(spark, sf_dir):
    own = lambda terms: spark.createDataFrame([(t,) for t in terms], "term string")
    return panel.universe(own(INLINE), own(OFFICIAL), ["term"])


assert tokens.GRID[1].name == "exp_B"
