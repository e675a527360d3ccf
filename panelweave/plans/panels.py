"""Catalogue: joins, key audits, aggregates and set operations over panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import zfill
from ..operators import features, panel
from ..sources.tables import table
from .documents import FEATURES, ratios
from .registry import query

ORDERS = "o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS yr, month(o_orderdate) AS mo, o_orderdate, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"
PRIORITIES = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


def orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("yr"), F.month("o_orderdate").cast("bigint").alias("mo"), "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


@query(f"WITH {FEATURES} SELECT doc_id, g_ratio, esg_ratio, quality, toxic FROM f JOIN labels USING (doc_id)")
def rating_merge(spark, sf_dir):
    return panel.merge(ratios(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], ["quality", "toxic"]).select("doc_id", "g_ratio", "esg_ratio", "quality", "toxic")


@query("SELECT DISTINCT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def unmatched_keys(spark, sf_dir):
    return panel.unmatched(table(spark, sf_dir, "documents"), labels(spark, sf_dir), ["doc_id"])


@query(f"WITH {FEATURES} SELECT source, count(*) AS n_before, count(quality) AS n_rated, count(*) - count(quality) AS n_dropped FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rating_left(spark, sf_dir):
    rows = panel.merge(ratios(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], ["quality"], "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_before"), F.count("quality").alias("n_rated"), (F.count(F.lit(1)) - F.count("quality")).alias("n_dropped"))


@query("SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l LEFT JOIN (SELECT doc_id, any_value(lang) AS lang, any_value(n_chars) AS n_chars FROM documents GROUP BY 1) d USING (doc_id)")
def backfill_columns(spark, sf_dir):
    rows = panel.backfill(labels(spark, sf_dir).select("doc_id", "quality"), table(spark, sf_dir, "documents").drop("text"), ["doc_id", "fiscal_year"], ["lang", "n_chars", "quality"])
    return rows.select("doc_id", "quality", "lang", "n_chars")


@query("SELECT c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'EXCLUDE_NO_RCEPT' WHEN c_acctbal <= 0 THEN 'EXCLUDE_KCGS_NA' ELSE 'INCLUDE' END AS final_decision FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o.o_custkey")
def salvage_log(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", panel.decision(F.col("o_custkey").isNotNull(), F.col("c_acctbal") > 0).alias("final_decision"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR))::INTEGER), '0') AS stock_code, substring(c_mktsegment, 1, 2) AS industry_proxy, count(o_orderkey) AS n_sections, coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '') AS sections_present FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def lineage_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("p"))
    rows = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", zfill(F.col("c_custkey").cast("string"), 6).alias("stock_code"), F.substring("c_mktsegment", 1, 2).alias("industry_proxy"), F.coalesce("n", F.lit(0)).alias("n_sections"), F.coalesce("p", F.lit("")).alias("sections_present"))


@query(f"WITH {ORDERS}, y AS (SELECT DISTINCT yr FROM o), k AS (SELECT c_nationkey AS nk, yr, count(*) AS n FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT n_nationkey, y.yr AS fiscal_year, coalesce(k.n, 0) AS n_filings, CASE WHEN k.n IS NULL THEN 'MISSING' ELSE 'SUCCESS' END AS status FROM nation CROSS JOIN y LEFT JOIN k ON n_nationkey = nk AND y.yr = k.yr")
def firm_year_grid(spark, sf_dir):
    o = orders(spark, sf_dir)
    years = o.select(F.col("yr").alias("fiscal_year")).distinct()
    have = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nk"), "yr").agg(F.count(F.lit(1)).alias("n"))
    rows = panel.grid(table(spark, sf_dir, "nation").select("n_nationkey"), years).join(have, (F.col("n_nationkey") == F.col("nk")) & (F.col("fiscal_year") == F.col("yr")), "left")
    return rows.select("n_nationkey", "fiscal_year", F.coalesce("n", F.lit(0)).alias("n_filings"), F.when(F.col("n").isNull(), "MISSING").otherwise("SUCCESS").alias("status"))


@query("SELECT lang, count(*) AS n_rows, count(quality) AS n_graded, count(DISTINCT source) AS n_firms, count(DISTINCT n_chars % 10) AS n_years, min(quality) AS grade_min, max(quality) AS grade_max, round(avg(quality::DOUBLE), 4) AS grade_mean, round(stddev_samp(quality::DOUBLE), 4) AS grade_std FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def merge_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 10).alias("digit")).join(labels(spark, sf_dir), "doc_id")
    return panel.quality(rows, ["lang"], "source", "digit", "quality")


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def grade_distribution(spark, sf_dir):
    return panel.distribution(table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels(spark, sf_dir), "doc_id"), ["lang"], "quality")


COLLAPSE = ["total_tokens", "g_ratio", "esg_ratio", "bp_ratio", "constant"]


@query(f"WITH {FEATURES}, m AS (SELECT lang, unnest([{', '.join(f'''{{'feature': '{c}', 'x': {c}::DOUBLE}}''' for c in COLLAPSE)}]) AS m FROM (SELECT *, 1.0 AS constant FROM f)), v AS (SELECT lang, m.feature AS feature, m.x AS x FROM m) SELECT lang, feature, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, CASE WHEN count(x) > 2 AND var_pop(x) > 1e-20 THEN round(skewness(CASE WHEN feature = 'constant' THEN NULL ELSE x END), 3) END AS skew, round(avg(CASE WHEN abs(x) < 1e-12 THEN 1.0::DOUBLE ELSE 0 END) FILTER (x IS NOT NULL) * 100, 4) AS zero_pct, round(avg(CASE WHEN abs(x - 1) < 1e-12 THEN 1.0::DOUBLE ELSE 0 END) FILTER (x IS NOT NULL) * 100, 4) AS one_pct, count(DISTINCT x) AS n_unique, coalesce(stddev_samp(x) < 1e-10, true) AS collapsed FROM v GROUP BY 1, 2")
def collapse_diagnostics(spark, sf_dir):
    return panel.collapse(ratios(spark, sf_dir).withColumn("constant", F.lit(1.0)), COLLAPSE, ["lang"])


STAGES = [("has text", "length(text) > 0"), ("long enough", "n_chars >= 300"), ("in English", "lang = 'en'"), ("rated", "quality IS NOT NULL"), ("good", "quality = 1")]


@query("WITH b AS (SELECT *, " + ", ".join(f"coalesce({' AND '.join(f'({c})' for _, c in STAGES[: k + 1])}, false) AS s{k}" for k in range(len(STAGES))) + " FROM documents LEFT JOIN labels USING (doc_id)), c AS (" + " UNION ALL ".join(f"SELECT {k} AS step, '{n}' AS stage, count(*) FILTER (s{k}) AS remaining_rows, count(*) AS total FROM b" for k, (n, _) in enumerate(STAGES)) + ") SELECT step, stage, remaining_rows, coalesce(lag(remaining_rows) OVER (ORDER BY step), total) - remaining_rows AS loss, total - remaining_rows AS cumulative_loss, round(remaining_rows * 100.0::DOUBLE / total, 2) AS coverage_pct FROM c")
def coverage_funnel(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id", "left")
    return panel.funnel(rows, [(n, F.expr(c)) for n, c in STAGES])


CHECKS = [("key present", "doc_id IS NOT NULL"), ("known language", "lang IN ('en', 'fr', 'de')"), ("count agrees", "n_chars = length(text)"), ("source named", "source LIKE 'src%'")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN count(*) FILTER (NOT coalesce({c}, false)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (NOT coalesce({c}, false)) AS detail FROM documents" for n, c in CHECKS))
def qa_assertions(spark, sf_dir):
    return panel.assertions(table(spark, sf_dir, "documents"), [(n, F.expr(c)) for n, c in CHECKS])


@query(f"WITH {ORDERS}, a AS (SELECT DISTINCT o_custkey, yr FROM o WHERE mo <= 6), b AS (SELECT DISTINCT o_custkey, yr FROM o WHERE mo > 6) SELECT o_custkey, yr, CASE WHEN x AND y THEN 'both' WHEN x THEN 'first' ELSE 'second' END AS provenance FROM (SELECT o_custkey, yr, bool_or(s = 1) AS x, bool_or(s = 2) AS y FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY 1, 2)")
def universe_union(spark, sf_dir):
    o = orders(spark, sf_dir)
    return panel.universe(o.where("mo <= 6"), o.where("mo > 6"), ["o_custkey", "yr"])


@query(f"WITH {ORDERS} SELECT o_custkey, yr, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, yr ORDER BY o_orderdate, o_orderkey) AS r FROM o) WHERE r = 1")
def dedupe_firm_year(spark, sf_dir):
    return panel.dedupe(orders(spark, sf_dir), ["o_custkey", "yr"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "yr", "o_orderkey")


@query(f"WITH {ORDERS} SELECT o_custkey, yr, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return panel.duplicates(orders(spark, sf_dir), ["o_custkey", "yr"])


@query("SELECT count(*) - count(quality) AS null_quality, count(*) - count(toxic) AS null_toxic, count(*) - count(lang) AS null_lang FROM documents LEFT JOIN labels USING (doc_id)")
def null_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id", "left")
    return panel.null_counts(rows, ["quality", "toxic", "lang"]).select("null_quality", "null_toxic", "null_lang")


@query(f"WITH {ORDERS}, g AS (SELECT *, CASE o_orderpriority {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in PRIORITIES.items())} END AS grade FROM o) SELECT yr, o_orderstatus, count(*) AS n, count(grade) AS n_graded, round(avg(grade::DOUBLE), 4) AS mean_grade, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, sum(CASE WHEN grade >= 4 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM g GROUP BY 1, 2")
def status_rollup(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("grade", features.grade_number(F.col("o_orderpriority"), PRIORITIES))
    return rows.groupBy("yr", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("grade").alias("n_graded"), F.round(F.avg("grade"), 4).alias("mean_grade"), F.round(F.percentile("o_totalprice", F.lit(0.25)), 4).alias("q1"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("q2"), F.sum((F.col("grade") >= 4).cast("bigint")).alias("n_high"))
