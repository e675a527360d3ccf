"""Catalogue: experiments against ratings and each other, model tables, extraction outputs, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, features, gap, linear, panel, passages, rank_stats, tokenizers, tokens
from ..sources import collect
from ..sources.tables import filed_in_window, id_map_check, key_lookup, table
from . import documents as d
from . import statistics as s
from .documents import COUNT, CUTS, FEATURES, FIRST, GRID_SQL, LEXICONS, LISTS, SEEDS, SHARE, STRIP, TOK, array, docs, q
from .panels import labels
from .registry import SQL, query

GRADED = "gr AS (SELECT exp_id, doc_id, len(t) AS total_tokens, " + ", ".join(f"{COUNT(k)} AS {k}_count" for k in ("esg", "g", "bp")) + f" FROM grid), gf AS (SELECT gr.exp_id, gr.doc_id, total_tokens, {SHARE('esg_count', 'total_tokens')} AS esg_ratio, {SHARE('g_count', 'total_tokens')} AS g_ratio, {SHARE('bp_count', 'total_tokens')} AS bp_ratio, round(ln(1.0::DOUBLE + total_tokens), 4) AS log_tokens, quality, toxic, 2 * quality + toxic AS grade FROM gr JOIN labels USING (doc_id))"
MEASURES = ["total_tokens", "esg_ratio", "g_ratio", "bp_ratio"]
LONG = f"lo AS (SELECT exp_id, doc_id, grade::DOUBLE AS y, m.feature AS feature, m.x AS x FROM (SELECT *, unnest([{', '.join(f'''{{'feature': '{c}', 'x': {c}::DOUBLE}}''' for c in MEASURES)}]) AS m FROM gf))"


def graded(spark, sf_dir):
    """Features of each rated document under each experiment; unrated ones are left out before the tokenizing."""
    rated = labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    rows = tokens.run_grid(docs(spark, sf_dir).join(rated, "doc_id"), ["doc_id", "quality", "toxic"], "text", tokens.GRID, LISTS)
    got = features.lexicon_ratios(rows, ["exp_id", "doc_id", "quality", "toxic"], LEXICONS)
    return got.withColumns({"total_tokens": F.col("total_tokens").cast("bigint"), "grade": 2 * F.col("quality") + F.col("toxic")})


def graded_long(spark, sf_dir):
    rows = panel.melt(graded(spark, sf_dir), ["exp_id", "doc_id", "grade"], MEASURES)
    return rows.select("exp_id", "doc_id", "feature", "x", F.col("grade").cast("double").alias("y"))


@query(f"WITH {GRID_SQL}, {GRADED} SELECT exp_id, doc_id, total_tokens, esg_ratio, g_ratio, grade FROM gf")
def experiment_rating_merge(spark, sf_dir):
    return graded(spark, sf_dir).select("exp_id", "doc_id", "total_tokens", "esg_ratio", "g_ratio", "grade")


RHOS = f"{GRID_SQL}, {GRADED}, {LONG}, rh AS ({s.rho_sql('SELECT * FROM lo', 'exp_id, feature')})"


@query(f"WITH {RHOS} SELECT * FROM rh")
def experiment_rho(spark, sf_dir):
    return rank_stats.spearman(graded_long(spark, sf_dir), ["exp_id", "feature"])


@query(f"WITH {RHOS} SELECT feature, round(max(CASE WHEN exp_id = 'exp_F' THEN rho END) - max(CASE WHEN exp_id = 'exp_B' THEN rho END), 4) AS delta_rho FROM rh GROUP BY 1")
def experiment_rho_delta(spark, sf_dir):
    of = lambda e: F.max(F.when(F.col("exp_id") == e, F.col("rho")))
    return experiment_rho(spark, sf_dir).groupBy("feature").agg(F.round(of("exp_F") - of("exp_B"), 4).alias("delta_rho"))


@query(f"""WITH {GRID_SQL}, {GRADED}, {LONG}, pr AS (SELECT a.feature, a.doc_id, a.y, a.x AS x1, b.x AS x2 FROM lo a JOIN lo b USING (feature, doc_id) WHERE a.exp_id = 'exp_F' AND b.exp_id = 'exp_F_official' AND a.x IS NOT NULL AND b.x IS NOT NULL AND a.y IS NOT NULL),
    r1 AS ({s.rho_sql('SELECT feature, x1 AS x, y FROM pr', 'feature')}), r2 AS ({s.rho_sql('SELECT feature, x2 AS x, y FROM pr', 'feature')}) SELECT feature, r1.n AS n_matched, r1.rho AS rho_first, r2.rho AS rho_second, round(r2.rho - r1.rho, 4) AS delta FROM r1 JOIN r2 USING (feature)""")
def variant_comparison(spark, sf_dir):
    rows = graded_long(spark, sf_dir).where("x is not null and y is not null")
    one = lambda e, name: rows.where(F.col("exp_id") == e).select("feature", "doc_id", "y", F.col("x").alias(name))
    both = one("exp_F", "x1").join(one("exp_F_official", "x2").drop("y"), ["feature", "doc_id"])
    sides = both.select("feature", "y", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("x1").alias("x")), F.struct(F.lit(2).alias("side"), F.col("x2").alias("x")))).alias("v")).select("feature", "v.side", "v.x", "y")
    r = rank_stats.spearman(sides, ["feature", "side"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("rho")))
    return r.groupBy("feature").agg(F.max("n").alias("n_matched"), side(1).alias("rho_first"), side(2).alias("rho_second"), F.round(side(2) - side(1), 4).alias("delta"))


OK2 = "SELECT exp_id, grade::DOUBLE AS y, log_tokens AS x1, g_ratio AS x2 FROM gf WHERE grade IS NOT NULL AND log_tokens IS NOT NULL AND g_ratio IS NOT NULL"
BY = "PARTITION BY exp_id"


@query(f"""WITH {GRID_SQL}, {GRADED}, o AS ({OK2}), c AS (SELECT *, x2 - avg(x2) OVER ({BY}) - (covar_pop(x1, x2) OVER ({BY})) / (var_pop(x1) OVER ({BY})) * (x1 - avg(x1) OVER ({BY})) AS r, y - avg(y) OVER ({BY}) - (covar_pop(x1, y) OVER ({BY})) / (var_pop(x1) OVER ({BY})) * (x1 - avg(x1) OVER ({BY})) AS u FROM o),
    b AS (SELECT exp_id, count(*) AS n, sum(r * u) / sum(r * r) AS b, sum(r * r) AS rr FROM c GROUP BY 1), m AS (SELECT exp_id, sum(r * r * (u - b * r) * (u - b * r)) AS meat FROM c JOIN b USING (exp_id) GROUP BY 1)
    SELECT exp_id, n, round(b, 4) AS coef, round(sqrt(meat * n / (n - 3)) / rr, 4) AS se FROM b JOIN m USING (exp_id)""")
def experiment_robustness(spark, sf_dir):
    rows = graded(spark, sf_dir).select("exp_id", F.col("grade").cast("double").alias("y"), F.col("log_tokens").alias("x1"), F.col("g_ratio").alias("x2"))
    got = linear.ols_by(rows, "y", ["x1", "x2"], ["exp_id"], robust=True).where("term = 'x2'")
    return got.select("exp_id", "n", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"))


@query(f"WITH {s.TWO}, o AS (SELECT count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ok) SELECT 'M1' AS model, 'intercept' AS term, round(a, 4) AS coef, n FROM o UNION ALL SELECT 'M1', 'x1', round(b, 4), n FROM o UNION ALL SELECT 'M2', 'intercept', round(my - b1 * m1 - b2 * m2, 4), n FROM b UNION ALL SELECT 'M2', 'x1', round(b1, 4), n FROM b UNION ALL SELECT 'M2', 'x2', round(b2, 4), n FROM b")
def model_comparison(spark, sf_dir):
    rows = s.model_rows(spark, sf_dir).where("x2 is not null")
    return linear.comparison([linear.ols(rows, "y", ["x1"], label="M1"), linear.ols(rows, "y", ["x1", "x2"], label="M2")]).select("model", "term", F.round("coef", 4).alias("coef"), "n")


@query()
def joint_models(spark, sf_dir):
    """E and G together, without and with log volume."""
    rows = s.rated(spark, sf_dir).select(F.col("grade").cast("double").alias("y"), "esg_ratio", "g_ratio", "log_tokens")
    fits = [linear.ols(rows, "y", xs, robust=True, label=name) for name, xs in (("M_J1", ["esg_ratio", "g_ratio"]), ("M_J2", ["esg_ratio", "g_ratio", "log_tokens"]))]
    return linear.comparison(fits)


@query()
def ols_dummies(spark, sf_dir):
    """HC1 with a column for each language and year."""
    rows, names = linear.dummies(s.rated(spark, sf_dir).withColumn("y", F.col("grade").cast("double")), ["lang", "yr"])
    return linear.ols(rows, "y", ["g_ratio", "log_tokens", *names], robust=True, label="M3")


@query()
def spearman_p(spark, sf_dir):
    return rank_stats.spearman_p(rank_stats.spearman(s.long(spark, sf_dir, []), ["feature"]), ["feature"])


@query(f"WITH {s.BOOT}, ob AS ({s.rho_sql('SELECT 0 AS one, x, y FROM nu', 'one', places=10)}) SELECT count(*) AS n_boot, round(avg(CASE WHEN sign(rb.rho) = sign(ob.rho) THEN 1.0::DOUBLE ELSE 0 END), 4) AS share_same_sign FROM rb, ob WHERE rb.rho IS NOT NULL")
def sign_stability(spark, sf_dir, b=s.B):
    pairs = s.xy(spark, sf_dir)
    return rank_stats.sign_stability(rank_stats.bootstrap_rhos(pairs, b, ["doc_id"]), rank_stats.spearman(pairs, [], places=10))


@query(s.full_sql("sign_stability", s.N_BOOT))
def sign_stability_full(spark, sf_dir):
    return sign_stability(spark, sf_dir, s.N_BOOT)


HALF = "SELECT feature, x, y >= 2 AS high FROM (" + s.long_sql("") + ")"
SLOPES = "sl AS (SELECT feature, regr_slope(y, x) AS slope FROM (" + s.long_sql("") + ") WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)"


@query(f"WITH {s.PANEL}, r AS ({s.rho_sql(s.long_sql(''), 'feature')}), {s.mwu_sql(HALF, 'feature')}, {SLOPES} SELECT feature, r.n AS n, {s.EFFECT} AS effect, coalesce(abs(rho) >= 0.1, false) AS rank_supports, coalesce(p_norm < 0.05, false) AS groups_differ, direction, CASE WHEN slope > 0 THEN '+' WHEN slope < 0 THEN '-' ELSE '0' END AS slope_sign FROM r LEFT JOIN mw USING (feature) LEFT JOIN sl USING (feature)")
def evidence_matrix(spark, sf_dir):
    """Four results of each feature side by side: rank correlation, its size, the two halves' difference, the slope."""
    rows = s.long(spark, sf_dir, [])
    r = rank_stats.spearman(rows, ["feature"])
    halves = rank_stats.mann_whitney(rows.withColumn("high", F.col("y") >= 2), ["feature"]).select("feature", "p_norm", "direction")
    slopes = gap.line(rows.where("x is not null and y is not null"), "y", "x", ["feature"]).select("feature", "slope")
    sign = F.when(F.col("slope") > 0, "+").when(F.col("slope") < 0, "-").otherwise("0")
    got = r.join(halves, "feature", "left").join(slopes, "feature", "left")
    return got.select("feature", "n", s.effect_label(F.col("rho")).alias("effect"), F.coalesce(F.abs("rho") >= 0.1, F.lit(False)).alias("rank_supports"), F.coalesce(F.col("p_norm") < 0.05, F.lit(False)).alias("groups_differ"), "direction", sign.alias("slope_sign"))


@query("WITH " + s.PANEL + ", lo AS (" + s.long_sql("") + ") SELECT feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM lo GROUP BY 1")
def describe_features(spark, sf_dir):
    return panel.describe(s.rated(spark, sf_dir), s.MEASURES)


STAGES = [("documents", "true"), ("with text", "length(coalesce(text, '')) > 0"), ("rated", "quality is not null"), ("rated with text", "quality is not null and length(coalesce(text, '')) > 0"), ("rated good", "quality = 1")]


@query("WITH j AS (SELECT text, quality FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT {k} AS step, '{name}' AS stage, count(*) FILTER ({c}) AS n FROM j" for k, (name, c) in enumerate(STAGES)))
def sample_definition(spark, sf_dir):
    rows = docs(spark, sf_dir).join(labels(spark, sf_dir).select("doc_id", "quality"), "doc_id", "left")
    return panel.stage_counts(rows, [(name, F.expr(c)) for name, c in STAGES])


BLANK = f"bl AS (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\\n{{2,}}|(?:\\r\\n){{2,}}'), lambda x: {STRIP.format('x')}) AS p FROM documents), bp AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS passage_id, p[k] AS text FROM bl, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS k) WHERE length(p[k]) >= 20), bm AS (SELECT *, {d.FOUND} AS m FROM bp)"


@query(f"WITH {BLANK} SELECT doc_id, passage_id, len(m) AS seed_count, array_to_string(m[1:5], '|') AS seeds, md5(text) AS digest FROM bm WHERE len(m) >= 1")
def blank_line_passages(spark, sf_dir):
    got = passages.blank_line_passages(docs(spark, sf_dir), ["doc_id"], "text", [*SEEDS])
    return got.select("doc_id", "passage_id", F.col("seed_count").cast("bigint").alias("seed_count"), "seeds", F.md5("text").alias("digest"))


SECTIONED = f"sg AS (SELECT doc_id, {' + '.join(f'CASE WHEN {FIRST(ps)} IS NULL THEN 0 ELSE 1 END' for ps in CUTS.values())} AS n_sections FROM documents)"


@query(f"WITH {BLANK}, {SECTIONED}, c AS (SELECT doc_id, count(*) AS n FROM bm WHERE len(m) >= 1 GROUP BY 1) SELECT doc_id, n_sections::BIGINT AS n_sections, coalesce(n, 0) AS n_passages, coalesce(n, 0) > 0 AS has_passages FROM sg LEFT JOIN c USING (doc_id)")
def passage_log(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return passages.passage_log(rows, ["doc_id"], passages.sections(rows, ["doc_id"], "text", CUTS, ["password"]), passages.blank_line_passages(rows, ["doc_id"], "text", [*SEEDS]))


EMPTY = STRIP.format("coalesce(text, '')") + " = ''"
SLICED = f"""sl AS (SELECT doc_id, text, nullif(instr(text, 'password'), 0) AS stop, [{", ".join(f"{{'start': {FIRST(ps)}, 'section': '{k}'}}" for k, ps in CUTS.items())}] AS a FROM documents),
    se AS (SELECT doc_id, text, stop, unnest(list_filter(a, lambda x: x.start IS NOT NULL)) AS x FROM sl),
    sn AS (SELECT doc_id, text, stop, x.section AS section, x.start AS start, coalesce(lead(x.start) OVER (PARTITION BY doc_id ORDER BY x.start, x.section), length(text) + 1) AS nxt FROM se),
    sec AS (SELECT doc_id, section, {STRIP.format("substring(text, start, CASE WHEN start < stop AND stop < nxt THEN stop ELSE nxt END - start)")} AS text FROM sn),
    {d.PARAS.replace("SELECT doc_id,", "SELECT doc_id, section,").replace("FROM documents", "FROM sec")},
    fp AS (SELECT * FROM (SELECT *, {d.FOUND} AS m FROM para) WHERE len(m) >= 2),
    wh AS (SELECT doc_id, count(*) AS n_passages, string_agg(text, chr(10) || chr(10) ORDER BY ord, paragraph_id) AS whole FROM fp JOIN (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY start, section) AS ord FROM sn) USING (doc_id, section) GROUP BY 1),
    fa AS (SELECT doc_id, CASE WHEN {EMPTY} THEN 'read' WHEN doc_id NOT IN (SELECT doc_id FROM sec) THEN 'section' WHEN doc_id NOT IN (SELECT doc_id FROM wh) THEN 'passage' END AS step FROM documents),
    fl AS (SELECT doc_id, step, CASE step WHEN 'read' THEN 'EMPTY' WHEN 'section' THEN 'NO_SECTION' ELSE 'NO_PASSAGE' END AS error FROM fa WHERE step IS NOT NULL)"""


def extracted(spark, sf_dir):
    return passages.extract(docs(spark, sf_dir), ["doc_id"], "text", CUTS, ["password"], SEEDS, 2)


@query(f"WITH {SLICED} SELECT doc_id, step, error FROM fl")
def extraction_failures(spark, sf_dir):
    return extracted(spark, sf_dir)["failures"]


@query(f"WITH {SLICED} SELECT doc_id, count(*) AS n_passages, sum(length(text))::BIGINT AS total_chars FROM fp GROUP BY 1")
def extraction_documents(spark, sf_dir):
    return extracted(spark, sf_dir)["documents"]


@query(f"""WITH {SLICED}
    SELECT 'sections' AS output, doc_id, section, NULL::INTEGER AS paragraph_id, NULL::INTEGER AS seed_count, NULL AS esg_category, NULL AS matched_seeds, NULL::INTEGER AS n_passages, length(text) AS total_chars, md5(left(text, 5000)) AS digest, NULL AS step, NULL AS error FROM sec
    UNION ALL SELECT 'passages', doc_id, section, paragraph_id, len(m), {d.CATEGORY}, array_to_string(m, '|'), NULL, NULL, md5(text), NULL, NULL FROM fp
    UNION ALL SELECT 'documents', doc_id, NULL, NULL, NULL, NULL, NULL, n_passages, length(whole), md5(whole), NULL, NULL FROM wh
    UNION ALL SELECT 'failures', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, step, error FROM fl""")
def extraction_stage(spark, sf_dir):
    """All four outputs of the stage, from one pass over the documents."""
    rows = passages.stage_rows(docs(spark, sf_dir), ["doc_id"], "text", CUTS, ["password"], SEEDS, 2)
    return rows.withColumn("digest", F.md5("text")).drop("text")


TFIDF = d._tfidf_sql(2, None, False).replace(TOK + ", ", "")


@query(f"WITH {FEATURES}, {TFIDF}, k AS (SELECT doc_id, round(sum(CASE WHEN token IN ({q(LEXICONS['esg'])}) THEN w ELSE 0.0 END) / nullif(sum(w), 0), 5) AS concentration, " + ", ".join(f"round(sum(CASE WHEN token IN ({q(t)}) THEN w ELSE 0.0 END), 5) AS tfidf_{k}" for k, t in d.SEED_TERMS.items()) + " FROM w GROUP BY 1) SELECT f.doc_id, lang, source, total_tokens, esg_ratio, g_ratio, log_tokens, concentration, tfidf_E, tfidf_S, tfidf_G FROM f LEFT JOIN k USING (doc_id)")
def feature_table(spark, sf_dir):
    w = d.weights(spark, sf_dir)
    got = features.feature_table(d.ratios(spark, sf_dir), "doc_id", features.concentration(w, "doc_id", F.col("token").isin(LEXICONS["esg"])), features.seed_weights(w, "doc_id", d.SEED_TERMS))
    return got.select("doc_id", "lang", "source", "total_tokens", "esg_ratio", "g_ratio", "log_tokens", "concentration", "tfidf_E", "tfidf_S", "tfidf_G")


@query(f"WITH f AS ({SQL['feature_table']}) SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("esg_ratio", "g_ratio", "concentration", "tfidf_G")) + " FROM f")
def feature_nulls(spark, sf_dir):
    return panel.null_counts(feature_table(spark, sf_dir), ["esg_ratio", "g_ratio", "concentration", "tfidf_G"])


EXPANDED = {"E": ["in", "to", "a", "zu"], "S": ["on", "la", "le"], "G": ["the", "of", "der", "que", "by"]}


@query(f"WITH {d._tfidf_sql(2, None, False, 0.95)} SELECT doc_id, " + ", ".join(f"round(sum(CASE WHEN token IN ({q(d.SEED_TERMS[k])}) THEN w ELSE 0.0 END), 5) AS seed_{k}, round(sum(CASE WHEN token IN ({q(t)}) THEN w ELSE 0.0 END), 5) AS expanded_{k}, round(sum(CASE WHEN token IN ({q(t)}) THEN w ELSE 0.0 END) / sqrt({len(t)}.0::DOUBLE), 5) AS cosine_{k}" for k, t in EXPANDED.items()) + " FROM w GROUP BY 1")
def expanded_scores(spark, sf_dir):
    return features.dictionary_scores(d.weights(spark, sf_dir, max_df=0.95), "doc_id", d.SEED_TERMS, EXPANDED)


COMPOUNDS = ["of the", "in the", "de la"]


@query(rf"SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda w: w IN ({q(COMPOUNDS)}))) AS n_compounds FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:{'|'.join(sorted(COMPOUNDS, key=lambda x: (-len(x), x)))}|\p{{L}}{{2,}})') AS t FROM documents)")
def protected_compounds(spark, sf_dir):
    t = tx.words_and_compounds(tx.text_of("text"), COMPOUNDS)
    rows = docs(spark, sf_dir).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), features.members(F.col("t"), COMPOUNDS).cast("bigint").alias("n_compounds"))


@query(f"SELECT token, auto_class || '->' || final_class AS change FROM ({SQL['expert_override']}) WHERE status = 'applied'")
def decision_log(spark, sf_dir):
    return audit.decision_log(d.expert_override(spark, sf_dir))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON o_custkey = c_custkey")
def filing_key_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return key_lookup(table(spark, sf_dir, "orders"), "o_custkey", names, "c_custkey", "c_name", F.col("c_name")).select("o_orderkey", "c_name")


@query("SELECT count(*) AS n_rows, count(*) FILTER (c_custkey IS NULL) AS n_missing, CASE WHEN count(*) FILTER (c_custkey IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def id_map_total(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return id_map_check(key_lookup(table(spark, sf_dir, "orders"), "o_custkey", names, "c_custkey", "c_name", F.col("c_name")), "c_name")


@query("SELECT o_orderkey, o_orderdate::DATE AS filed FROM orders WHERE o_orderdate::DATE BETWEEN make_date(1994 + CAST(o_custkey % 5 AS INTEGER) + 1, 1, 1) AND make_date(1994 + CAST(o_custkey % 5 AS INTEGER) + 1, 6, 30) AND o_orderpriority = '1-URGENT'")
def filings_in_window(spark, sf_dir):
    index = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumn("fy", 1994 + F.col("o_custkey") % 5)
    return filed_in_window(index, "o_orderdate", "fy").select("o_orderkey", F.to_date("o_orderdate").alias("filed"))


PAGE_TEXT = f"pg AS (SELECT page_id AS doc_id, array_to_string(list_filter(list_transform({d.HTML_LINES.format(d.PLAIN)}, lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM pages)"
PAGE_CUTS = {"A": ["the ", "der "], "B": ["and ", "und "]}


@query(f"""WITH {PAGE_TEXT}, s AS (SELECT doc_id, text, nullif(instr(text, 'password'), 0) AS stop, [{", ".join(f"{{'start': {FIRST(ps)}, 'section': '{k}'}}" for k, ps in PAGE_CUTS.items())}] AS a FROM pg),
    e AS (SELECT doc_id, text, stop, unnest(list_filter(a, lambda x: x.start IS NOT NULL)) AS x FROM s),
    n AS (SELECT doc_id, text, stop, x.section AS section, x.start AS start, coalesce(lead(x.start) OVER (PARTITION BY doc_id ORDER BY x.start, x.section), length(text) + 1) AS nxt FROM e),
    b AS (SELECT *, CASE WHEN start < stop AND stop < nxt THEN stop ELSE nxt END AS fin FROM n)
    SELECT doc_id AS page_id, section, length({STRIP.format("substring(text, start, fin - start)")}) AS n_chars FROM b""")
def markup_sections(spark, sf_dir):
    got = passages.markup_sections(table(spark, sf_dir, "pages"), ["page_id"], "html", PAGE_CUTS, ["password"])
    return got.select("page_id", "section", F.length("text").cast("bigint").alias("n_chars"))


@query(rf"SELECT doc_id, len(t) AS n_sentences, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\.\s+'), lambda x: {STRIP.format('x')}), lambda x: length(x) >= 15) AS t FROM documents)")
def strict_sentences(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tx.strict_sentences(tx.text_of("text"), 15, r"\.\s+").alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_sentences"), F.md5(F.array_join("t", "|")).alias("digest"))


@query(f"WITH {d.PARAS} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id)) AS digest FROM para WHERE {d.ANY(d.GOVERN)} OR {d.ANY(d.SIGNAL)} OR {d.RATIO} <= 0.25 GROUP BY 1")
def dense_text(spark, sf_dir):
    return passages.dense_text(docs(spark, sf_dir), ["doc_id"], "text", d.LEX).select("doc_id", F.md5("document").alias("digest"))


WIDE = ["the", "of", "que", "der"]


@query(f"WITH {d._tfidf_sql(2, None, False)} SELECT d.doc_id, " + ", ".join(f"round(coalesce(max(CASE WHEN token = '{t}' THEN w END), 0), 5) AS {t}" for t in WIDE) + " FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN w USING (doc_id) GROUP BY 1")
def tfidf_wide(spark, sf_dir):
    return features.wide(docs(spark, sf_dir), d.weights(spark, sf_dir), "doc_id", WIDE).select("doc_id", *(F.round(t, 5).alias(t) for t in WIDE))


@query(f"WITH {d.CLASSED} SELECT token, tf, confidence FROM cl WHERE auto_class = 'AMBIGUOUS'")
def ambiguous_tokens(spark, sf_dir):
    return d.token_taxonomy(spark, sf_dir).where("auto_class = 'AMBIGUOUS'").select("token", "tf", "confidence")


@query(f"WITH {s.COOK} SELECT doc_id, round(d, 6) AS cooks_d FROM ck ORDER BY d DESC, doc_id LIMIT 10")
def cooks_top(spark, sf_dir):
    """The ten rows that pull most at the line."""
    rows = linear.cooks(s.model_rows(spark, sf_dir), "y", ["x1"])
    return rows.orderBy(F.round("cooks_d", 12).desc(), "doc_id").limit(10).select("doc_id", F.round("cooks_d", 6).alias("cooks_d"))


@query(f"WITH o AS ({SQL['orthogonalize']}) SELECT *, coalesce(abs(rho_raw) >= 0.1 AND shrinkage_pct >= 50, false) AS verb_dominated FROM o")
def verbosity_dominance(spark, sf_dir):
    """Whether volume explains most of a correlation that isn't negligible."""
    dominated = (F.abs("rho_raw") >= 0.1) & (F.col("shrinkage_pct") >= 50)
    return s.orthogonalize(spark, sf_dir).withColumn("verb_dominated", F.coalesce(dominated, F.lit(False)))


@query(f"WITH {GRID_SQL} SELECT exp_id, round(count(DISTINCT CASE WHEN token IN ({q(LISTS.protect)}) THEN token END) * 100.0::DOUBLE / {len(LISTS.protect)}, 2) AS preserved_pct FROM gl GROUP BY 1")
def variant_preservation(spark, sf_dir):
    kept = F.count(F.when(F.col("token").isin(LISTS.protect), 1)).alias("kept")
    rows = tokens.grid_sizes(d.grid(spark, sf_dir), 4, kept)
    return rows.select("exp_id", F.round(F.col("kept") * 100.0 / len(LISTS.protect), 2).alias("preserved_pct"))


YEARS = f"{s.PANEL}, ny AS (SELECT yr, row_number() OVER (PARTITION BY yr ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY yr) AS n, total_tokens::DOUBLE AS x, grade::DOUBLE AS y FROM pa WHERE total_tokens IS NOT NULL AND grade IS NOT NULL), dy AS (SELECT yr, b, ('0x' || substr(md5(concat_ws('|', yr, b, i)), 1, 8))::BIGINT % n AS i FROM ny, range({s.B}) r(b)), ry AS ({s.rho_sql('SELECT yr, b, x, y FROM dy JOIN ny USING (yr, i)', 'yr, b', places=10)})"


@query(f"WITH {YEARS} SELECT yr, count(*) AS n_boot, round(quantile_cont(rho, 0.025), 4) AS ci_lo, round(quantile_cont(rho, 0.975), 4) AS ci_hi, round(avg(CASE WHEN rho > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS share_positive, ci_lo > 0 OR ci_hi < 0 AS ci_excludes_zero FROM ry WHERE rho IS NOT NULL GROUP BY 1")
def year_bootstrap(spark, sf_dir, b=s.B):
    """The bootstrap interval of each year."""
    rows = s.rated(spark, sf_dir).select("doc_id", "yr", F.col("total_tokens").cast("double").alias("x"), F.col("grade").cast("double").alias("y"))
    return rank_stats.interval(rank_stats.bootstrap_rhos(rows, b, ["doc_id"], ["yr"]), group=["yr"])


@query(s.full_sql("year_bootstrap", s.N_BOOT))
def year_bootstrap_full(spark, sf_dir):
    return year_bootstrap(spark, sf_dir, s.N_BOOT)


@query()
def ordered_logit_scaled(spark, sf_dir):
    """The ordered logit on z-scores."""
    rows = linear.complete(s.model_rows(spark, sf_dir), ["y", "x1", "x2"])
    return linear.ordered_logit(linear.standardized(rows, ["x1", "x2"]), "y", ["x1", "x2"])


@query("SELECT d.doc_id, coalesce(tried, 0)::INTEGER AS attempts FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN (SELECT doc_id, min(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS again, sum(1 + doc_id % 4) AS tried FROM labels GROUP BY 1) l USING (doc_id) WHERE (tried IS NULL OR again = 1 AND tried < 3) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def collect_open(spark, sf_dir):
    """Documents to collect: labels stand for the log of earlier tries, quality 0 for a failed one, toxic ones for the exclusion list."""
    tried = labels(spark, sf_dir)
    log = tried.select("doc_id", F.when(F.col("quality") == 0, collect.FAILED).otherwise(collect.OK).alias("status"), (1 + F.col("doc_id") % 4).cast("int").alias("attempts"))
    return collect.still_open(table(spark, sf_dir, "documents").select("doc_id"), log, ["doc_id"], tried.where("toxic = 1"))


@query(f"WITH {TOK} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def named_tokenizer(spark, sf_dir):
    """Tokens of the first tokenizer of three that the workers have."""
    t = tokenizers.named("kiwi", "okt", "letters")(tx.text_of("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


ROLES = ["user", "assistant"]


@query("SELECT conv_id, count(*) AS n_rows, " + ", ".join(f"md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER ({c})) AS text_{k}, coalesce(sum(length(text)) FILTER ({c}), 0)::BIGINT AS chars_{k}" for k, c in (*((r, f"role = '{r}'") for r in ROLES), ("other", f"role IS NULL OR role NOT IN ({q(ROLES)})"))) + " FROM conversations GROUP BY 1")
def role_text_pivot(spark, sf_dir):
    """A conversation with the text of each role in a column of its own."""
    got = passages.text_pivot(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ROLES, ["turn"], "text")
    return got.withColumns({f"text_{k}": F.md5(f"text_{k}") for k in (*ROLES, "other")})


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
    c AS (SELECT s.vec_id AS seed_id, v.vec_id AS candidate, round(list_cosine_similarity(s.e, v.e), 9) AS cos FROM v s JOIN v ON v.vec_id <> s.vec_id WHERE s.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY cos DESC, candidate) AS INTEGER) AS rank FROM c WHERE cos >= 0.2)
    SELECT seed_id, rank, candidate, round(cos, 6) AS cos, cos >= 0.5 AS at_50, cos >= 0.6 AS at_60, cos >= 0.7 AS at_70, cos >= 0.8 AS at_80 FROM r WHERE rank <= 100""")
def embedding_expansion(spark, sf_dir):
    """The 100 nearest candidates of every seed from a cosine of 0.2 on, since few of the given vectors are nearer, and which thresholds each reaches."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = features.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", least=0.2)
    return got.select("seed_id", "rank", "candidate", F.round("cos", 6).alias("cos"), *((F.col("cos") >= t / 100).alias(f"at_{t}") for t in (50, 60, 70, 80)))
