"""Catalogue: documents, passages, tokens, audit, features, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, evaluate, features, passages, tokens
from ..sources.scratch import written
from ..sources.tables import dealt, dealt_by, latest_per_key, pending, table
from .registry import query

SEEDS = {"tion": "E", "ment": "E", "heit": "S", "able": "S", "ung": "G", "ble": "G"}
GOVERN, SIGNAL, FINANCE, GENERIC = ["shan", "queau"], ["thering", "lichen"], ["the", "der", "que"], ["and", "und"]
LEX = passages.Lexicons(SEEDS, GOVERN, SIGNAL, GENERIC, FINANCE)
LATIN_SENTENCE = r"(?<=[.!?])\s+(?=\p{Lu})"
LISTS = tokens.WordLists(minimal=["the", "of"], standard=["and", "to", "la", "der"], extended=["in", "is", "de", "die", "que"], official=["for", "with"], boilerplate=["that", "this", "und"], protect=["by", "en"], lines=["password", "token = "], units=["GB", "%", "items"], names=["Anat", "Ores"])
LEXICONS = {"esg": ["in", "to", "on", "la", "das"], "g": ["the", "of", "by", "en", "der"], "bp": ["and", "that", "und", "que"]}
SEED_TERMS = {"E": ["in", "to"], "S": ["on", "la"], "G": ["the", "of"]}
RULES = audit.Rules(preserve=["by", "en", "thering"], governance=["the", "of"], environment=["in", "to"], social=["on", "la"], boilerplate=["and", "und", "que"], ambiguous=["is", "das"], parts=["ther"], boilerplate_patterns=["^th(er|at)", "^sch"], generic_patterns=["^(an|re)d", "^qu"])


def q(terms: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def array(terms: list[str]) -> str:
    return f"[{q(terms)}]"


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
PARAS = rf"""
    lines AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]'), lambda x: {STRIP.format("x")}), lambda x: length(x) >= 30) AS l FROM documents),
    cut AS (SELECT doc_id, list_filter(flatten(list_transform(l, lambda x: list_transform(range(0, CAST(floor((length(x) - 1) / 2000) AS BIGINT) + 1), lambda k: {STRIP.format("substring(x, k * 2000 + 1, 2000)")}))), lambda x: length(x) >= 30) AS p FROM lines),
    para AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS paragraph_id, p[k] AS text FROM cut, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS k))"""
TOK = r"tok AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '\p{L}{2,}') AS t FROM documents), tl AS (SELECT doc_id, lang, unnest(t) AS token FROM tok)"
FOUND = f"list_filter({array([*SEEDS])}, lambda s: contains(text, s))"
CATEGORY = "CASE WHEN len(list_distinct(list_transform(m, lambda s: {map}[s]))) = 1 THEN {map}[m[1]] ELSE 'ESG' END".format(map="MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SEEDS.items()) + "}")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def base_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", "source", tx.words(tx.text_of("text")).alias("tokens"))


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, length(text) AS n_chars, md5(text) AS digest FROM para")
def paragraph_split(spark, sf_dir):
    return passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text").select("doc_id", F.col("paragraph_id"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {PARAS}, f AS (SELECT *, {FOUND} AS m FROM para) SELECT doc_id, paragraph_id, len(m) AS seed_count, array_to_string(m, '|') AS seeds, {CATEGORY} AS esg_category FROM f WHERE len(m) >= 2")
def seed_passages(spark, sf_dir):
    got = passages.seed_passages(passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text"), SEEDS, 2)
    return got.select("doc_id", "paragraph_id", F.col("seed_count").cast("bigint").alias("seed_count"), F.array_join("matched_seeds", "|").alias("seeds"), "esg_category")


@query(f"WITH {PARAS}, f AS (SELECT *, {FOUND} AS m FROM para), c AS (SELECT doc_id, {CATEGORY} AS esg_category FROM f WHERE len(m) >= 1) SELECT esg_category, count(*) AS n_passages, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY 1")
def passage_category(spark, sf_dir):
    got = passages.seed_passages(passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text"), SEEDS)
    return got.groupBy("esg_category").agg(F.count(F.lit(1)).alias("n_passages"), F.countDistinct("doc_id").alias("n_docs"))


ANY = lambda terms, x="text": "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
RATIO = f"coalesce(len(list_filter({WORDS}, lambda w: {ANY(FINANCE, 'w')})) * 1.0::DOUBLE / nullif(len({WORDS}), 0), 0.0)"


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, round({RATIO}, 6) AS bp_ratio FROM para")
def boilerplate_ratio(spark, sf_dir):
    return passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text").select("doc_id", "paragraph_id", F.round(tx.boilerplate_ratio(F.col("text"), FINANCE), 6).alias("bp_ratio"))


@query(f"WITH {PARAS} SELECT doc_id, count(*) AS n_kept, sum(length(text))::BIGINT AS chars FROM para WHERE {ANY(GOVERN)} OR {ANY(SIGNAL)} OR {RATIO} <= 0.25 GROUP BY 1")
def density_filter(spark, sf_dir):
    rows = passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text").where(passages.dense_enough(F.col("text"), LEX))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum(F.length("text")).alias("chars"))


TERMS = lambda terms, x: "(" + " + ".join(f"CASE WHEN contains({x}, '{t}') THEN 1 ELSE 0 END" for t in sorted({*terms})) + ")"
#: Sentences of each paragraph, in which pieces under 15 characters join the one before them: a fold over the pieces.
SENTENCES = rf"""{PARAS},
    pc AS (SELECT doc_id, paragraph_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+(\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS p FROM para),
    fo AS (SELECT doc_id, paragraph_id, text AS paragraph, CASE WHEN len(p) = 0 THEN [text] ELSE list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(x[1]) < 15 THEN list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || x[1]]) ELSE list_concat(a, x) END) END AS s FROM pc),
    sx AS (SELECT doc_id, paragraph_id, paragraph, s[k] AS sentence, k - 1 AS pos FROM fo, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)),
    sh AS (SELECT *, {TERMS([*SEEDS, *SIGNAL], 'sentence')} AS esg_hit, {TERMS(GOVERN, 'sentence')} AS g_hit, {TERMS(GENERIC, 'sentence')} AS generic_hit, {TERMS(FINANCE, 'sentence')} AS finance_hit, length(sentence)::DOUBLE AS n_chars FROM sx),
    sd AS (SELECT *, coalesce(esg_hit * 100.0::DOUBLE / nullif(n_chars, 0), 0) AS esg_density, coalesce(g_hit * 100.0::DOUBLE / nullif(n_chars, 0), 0) AS g_density, coalesce(generic_hit * 100.0::DOUBLE / nullif(n_chars, 0), 0) AS generic_density, coalesce(finance_hit * 100.0::DOUBLE / nullif(n_chars, 0), 0) AS finance_density, coalesce((esg_hit + g_hit) * 100.0::DOUBLE / nullif(n_chars, 0), 0) AS signal_density FROM sh)"""
DENSE = lambda least: f"""kp AS (SELECT *, max(CASE WHEN g_hit > 0 OR (esg_hit + g_hit > 0 AND signal_density >= {least}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, paragraph_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep FROM sd),
    dn AS (SELECT doc_id, paragraph_id, count(*) AS n_sentences, sum(keep)::BIGINT AS n_kept, CASE WHEN sum(keep) > 0 AND count(*) > 1 THEN string_agg(sentence, ' ' ORDER BY pos) FILTER (keep = 1) ELSE any_value(paragraph) END AS text FROM kp GROUP BY 1, 2)"""  # noqa: E731


@query(f"WITH {SENTENCES}, {DENSE('0.5::DOUBLE')} SELECT doc_id, paragraph_id, n_sentences, n_kept, length(text) AS n_chars FROM dn")
def sentence_density(spark, sf_dir):
    own = ["doc_id", "paragraph_id"]
    scored = passages.score_sentences(passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text"), own, LEX, LATIN_SENTENCE)
    return passages.density_filter(scored, own, 1, 0.5).select(*own, "n_sentences", "n_kept", F.length("text").alias("n_chars"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(CASE WHEN g_hit > 0 THEN 1 ELSE 0 END)::BIGINT AS n_g_sentences, sum(CASE WHEN esg_hit > 0 THEN 1 ELSE 0 END)::BIGINT AS n_esg_sentences, " + ", ".join(f"round(avg({k}_density), 4) AS mean_{k}_density" for k in ("esg", "g", "generic", "finance")) + ", round(avg(esg_density) / greatest(avg(generic_density), 0.001::DOUBLE), 4) AS esg_generic_ratio, round(avg(CASE WHEN generic_density > signal_density THEN 1.0::DOUBLE ELSE 0 END), 4) AS generic_dominant_share FROM sd GROUP BY 1")
def passage_features(spark, sf_dir):
    scored = passages.score_sentences(passages.paragraph_rows(docs(spark, sf_dir), ["doc_id"], "text"), ["doc_id", "paragraph_id"], LEX, LATIN_SENTENCE)
    return passages.passage_features(scored, ["doc_id"])


@query(f"WITH {SENTENCES}, {DENSE('0.0::DOUBLE')}, lg AS (SELECT *, {FOUND} AS m FROM dn WHERE length(text) >= 20) SELECT doc_id, paragraph_id, CAST(len(m) AS INTEGER) AS seed_count, {CATEGORY} AS esg_category, CAST(length(text) AS INTEGER) AS n_chars FROM lg WHERE len(m) >= 1 AND ({ANY(GOVERN)} OR {ANY(SIGNAL)} OR {RATIO} <= 0.25)")
def section_to_passages(spark, sf_dir):
    got = passages.section_to_passages(docs(spark, sf_dir), ["doc_id"], "text", LEX, pattern=LATIN_SENTENCE)
    return got.select("doc_id", "paragraph_id", "seed_count", "esg_category", F.length("text").alias("n_chars"))


@query("SELECT conv_id, count(*) AS n_passages, sum(length(text))::BIGINT AS total_chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_document(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    return passages.joined(rows, ["conv_id"], ["turn"], "text").select("conv_id", "n_passages", "total_chars", F.md5("document").alias("digest"))


@query("SELECT source, count(*) AS n_docs, " + ", ".join(f"sum(CASE WHEN lang = '{k}' THEN length(text) END)::BIGINT AS chars_{k}" for k in ("de", "en", "es", "fr")) + " , sum(CASE WHEN lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr') THEN length(text) END)::BIGINT AS chars_other FROM documents GROUP BY source")
def section_text_pivot(spark, sf_dir):
    known = ("de", "en", "es", "fr")
    kind = F.when(F.col("lang").isin([*known]), F.col("lang")).otherwise("other")
    chars = (F.sum(F.when(kind == k, F.length("text"))).alias(f"chars_{k}") for k in (*known, "other"))
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *chars)


HTML_LINES = r"""string_split_regex({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"""
MARKUP = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
PLAIN = f"regexp_replace({MARKUP}, '<[^>]+>', chr(10), 'g')"
for _name, _plain in tx.ENTITIES:
    PLAIN = f"replace({PLAIN}, '{_name}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query(f"WITH p AS (SELECT page_id, list_filter(list_transform({HTML_LINES.format(PLAIN)}, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM pages) SELECT page_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM p")
def html_to_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", tx.markup_to_text(tx.text_of("html")).alias("t"))
    return rows.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("bigint").alias("n_lines"), F.md5("t").alias("digest"))


@query()
def html_sections(spark, sf_dir):
    got = passages.titled_sections(table(spark, sf_dir, "pages"), ["page_id"], "html")
    return got.select("page_id", "place", "title", "n_paragraphs", F.length("text").alias("n_chars"))


CUTS = {"A": ["Zebra", "the "], "B": ["and ", "und "], "C": ["of ", "que "]}
FIRST = lambda ps: "coalesce(" + ", ".join(f"nullif(instr(text, '{p}'), 0)" for p in ps) + ")"


@query(f"""WITH s AS (SELECT doc_id, text, nullif(instr(text, 'password'), 0) AS stop, [{", ".join(f"{{'start': {FIRST(ps)}, 'section': '{k}'}}" for k, ps in CUTS.items())}] AS a FROM documents),
    e AS (SELECT doc_id, text, stop, unnest(list_filter(a, lambda x: x.start IS NOT NULL)) AS x FROM s),
    n AS (SELECT doc_id, text, stop, x.section AS section, x.start AS start, coalesce(lead(x.start) OVER (PARTITION BY doc_id ORDER BY x.start, x.section), length(text) + 1) AS nxt FROM e),
    b AS (SELECT *, CASE WHEN start < stop AND stop < nxt THEN stop ELSE nxt END AS fin FROM n)
    SELECT doc_id, section, length({STRIP.format("substring(text, start, fin - start)")}) AS n_chars FROM b""")
def section_slices(spark, sf_dir):
    got = passages.sections(docs(spark, sf_dir), ["doc_id"], "text", CUTS, ["password"])
    return got.select("doc_id", "section", F.length("text").cast("bigint").alias("n_chars"))


LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {0} regexp_matches(x, 'password|token = '))"


@query(f"SELECT doc_id, md5(array_to_string({LINES.format('NOT')}, chr(10))) AS digest, len({LINES.format('')}) AS n_removed FROM documents")
def line_filter(spark, sf_dir):
    c = tx.text_of("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.drop_lines(c, LISTS.lines)).alias("digest"), F.size(tx.dropped_lines(c, LISTS.lines)).cast("bigint").alias("n_removed"))


@query(r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\d+', ' ', 'g')) AS removed, md5(regexp_replace(regexp_replace(coalesce(text, ''), '\d+(?:\.\d+)?\s*(GB|%|items)', '[NUM]\1', 'g'), '\d+', ' ', 'g')) AS kept FROM documents""")
def number_mode(spark, sf_dir):
    c = tx.text_of("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.number_mode(c, "remove_all", LISTS.units)).alias("removed"), F.md5(tx.number_mode(c, "keep_quantity", LISTS.units)).alias("kept"))


def _names_sql(c: str, legacy: bool) -> str:
    for name in LISTS.names:
        for form in tx.name_variants(name, legacy):
            c = f"replace({c}, '{form}', '')"
    return c


@query(f"SELECT doc_id, md5({_names_sql('coalesce(text, chr(0))', False)}) AS digest, md5({_names_sql('coalesce(text, chr(0))', True)}) AS legacy_digest FROM documents WHERE text IS NOT NULL")
def name_removal(spark, sf_dir):
    rows = docs(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.md5(tx.remove_names(F.col("text"), LISTS.names)).alias("digest"), F.md5(tx.remove_names(F.col("text"), LISTS.names, True)).alias("legacy_digest"))


def _config_sql(c: tokens.Config) -> str:
    t = "coalesce(text, '')"
    t = _names_sql(t, False) if c.names else t
    if c.numbers == "keep_quantity":
        t = rf"regexp_replace({t}, '\d+(?:\.\d+)?\s*(GB|%|items)', '[NUM]\1', 'g')"
    t = rf"regexp_replace({t}, '\d+', ' ', 'g')"
    if c.lines:
        t = f"array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT regexp_matches(x, 'password|token = ')), chr(10))"
    return rf"SELECT doc_id, '{c.name}' AS exp_id, list_filter(regexp_extract_all(lower({t}), '\p{{L}}{{2,}}'), lambda w: w NOT IN ({q(LISTS.removed(c))})) AS t FROM documents"


GRID_SQL = "grid AS (" + " UNION ALL ".join(map(_config_sql, tokens.GRID)) + "), gl AS (SELECT doc_id, exp_id, unnest(t) AS token FROM grid)"


def grid(spark, sf_dir):
    return tokens.grid_counts(docs(spark, sf_dir), "text", tokens.GRID, LISTS)


@query(f"WITH {GRID_SQL}, s AS (SELECT exp_id, count(*) AS n_docs, round(avg(len(t)), 4) AS avg_tokens, round(avg(CASE WHEN len(t) > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS coverage_pct FROM grid GROUP BY 1), k AS (SELECT exp_id, count(DISTINCT token) AS vocab_size FROM gl GROUP BY 1) SELECT s.*, vocab_size FROM s JOIN k USING (exp_id)")
def experiment_grid(spark, sf_dir):
    return tokens.grid_sizes(grid(spark, sf_dir))


@query(f"WITH {GRID_SQL}, c AS (SELECT exp_id, token, count(*) AS n FROM gl GROUP BY 1, 2) SELECT exp_id, string_agg(token || ':' || n, ' ' ORDER BY n DESC, token) AS top_20 FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY n DESC, token) AS r FROM c) WHERE r <= 20 GROUP BY 1")
def experiment_top_tokens(spark, sf_dir):
    """The twenty most frequent tokens of each experiment, with their counts."""
    top = evaluate.ranked(grid(spark, sf_dir), LEXICONS, 20).groupBy("exp_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "tf"))).alias("t"))
    return top.select("exp_id", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["token"], x["tf"].cast("string"))), " ").alias("top_20"))


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 60")
def tokenize_resume(spark, sf_dir):
    return pending(docs(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"], batch=60).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


COVER = ["the", "tion", "zzz", "la", "ung"]


@query(f"WITH {TOK}, s AS (SELECT unnest({array(COVER)}) AS seed), j AS (SELECT array_to_string(t, ' ') AS j FROM tok) SELECT seed, (SELECT count(*) FROM tl WHERE token = seed) AS corpus_freq, (SELECT count(*) FROM j WHERE contains(j, seed)) AS doc_count, (SELECT count(*) FROM tl WHERE token = seed) < 50 AS rare FROM s")
def seed_coverage(spark, sf_dir):
    seeds = spark.createDataFrame([(s,) for s in COVER], "seed string")
    return tokens.seed_coverage(seeds, base_tokens(spark, sf_dir), "doc_id")


@query(f"WITH {TOK}, s AS (SELECT unnest({array(['E', 'E', 'S', 'S', 'G', 'G'])}) AS dimension, unnest({array(['in', 'to', 'on', 'zzz', 'the', 'of'])}) AS seed), c AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tl GROUP BY 1) SELECT dimension, seed, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, coalesce(df, 0) <= 10 AS is_sparse FROM s LEFT JOIN c ON seed = token")
def seed_sparsity(spark, sf_dir):
    seeds = spark.createDataFrame([("E", "in"), ("E", "to"), ("S", "on"), ("S", "zzz"), ("G", "the"), ("G", "of")], "dimension string, seed string")
    return features.sparsity(seeds, audit.frequencies(base_tokens(spark, sf_dir)))


@query(f"WITH {TOK} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_unique, len(list_filter({array(sorted(COVER))}, lambda s: list_contains(t, s))) AS n_seed_found, array_to_string(list_filter({array(sorted(COVER))}, lambda s: list_contains(t, s))[1:5], '|') AS first_seeds FROM tok")
def token_log(spark, sf_dir):
    got = tokens.token_log(base_tokens(spark, sf_dir), ["doc_id"], COVER)
    return got.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("n_tokens", "n_unique", "n_seed_found")), "first_seeds")


HINT = f"CASE WHEN token IN ({q(RULES.preserve)}) THEN 'preserve' WHEN token IN ({q(RULES.boilerplate)}) THEN 'boilerplate' ELSE '' END"
AUDIT = f"""{TOK}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), c AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tl GROUP BY 1 ORDER BY tf DESC, token LIMIT 500),
    au AS (SELECT token, tf, df, round(ln(n / df), 3) AS idf, round(tf / n * ln(n / df), 3) AS tf_idf_avg, {HINT} AS auto_hint FROM c, n)"""


def audited(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return audit.audit(audit.frequencies(base_tokens(spark, sf_dir)), n, RULES)


@query(f"WITH {AUDIT} SELECT * FROM au")
def token_audit(spark, sf_dir):
    return audited(spark, sf_dir)


@query(f"WITH {AUDIT} SELECT CASE WHEN idf < 0.1 THEN 'a: below 0.1' WHEN idf < 0.5 THEN 'b: below 0.5' WHEN idf < 1.0 THEN 'c: below 1' ELSE 'd: 1 and more' END AS band, count(*) AS n_tokens, sum(tf)::BIGINT AS tf FROM au GROUP BY 1")
def idf_bands(spark, sf_dir):
    return audit.idf_bands(audited(spark, sf_dir))


MANUAL = "CASE WHEN token IN ('by', 'en') THEN 'GENERIC' WHEN token = 'and' THEN 'ESG_SIGNAL' WHEN token IN ('to', 'er', 'by') THEN ' boilerplate' WHEN length(token) = 2 THEN ' ' ELSE NULL END"


@query(f"""WITH {AUDIT}, m AS (SELECT *, {MANUAL} AS manual_class, upper(trim(coalesce({MANUAL}, ''))) AS c FROM au),
    k AS (SELECT token, auto_hint, manual_class, unnest([CASE WHEN c = 'BOILERPLATE' AND token IN ({q(RULES.preserve)}) THEN 'preserve_vs_boilerplate' END, CASE WHEN c IN ('G_SIGNAL', 'ESG_SIGNAL') AND token IN ({q(RULES.boilerplate)}) THEN 'signal_in_stopwords' END, CASE WHEN c = 'BOILERPLATE' AND token NOT IN ({q(RULES.boilerplate)}) THEN 'boilerplate_not_removed' END]) AS conflict FROM m)
    SELECT token, conflict, auto_hint, manual_class FROM k WHERE conflict IS NOT NULL""")
def audit_conflicts(spark, sf_dir):
    return audit.conflicts(audited(spark, sf_dir).withColumn("manual_class", F.expr(MANUAL)), RULES)


@query(f"WITH {AUDIT} SELECT coalesce(CAST(floor(quantile_cont(round(df * exp(idf)), 0.5)) AS BIGINT), 30) AS n_docs FROM au WHERE idf > 0.01 AND df > 0")
def infer_n_docs(spark, sf_dir):
    return audit.infer_n_docs(audited(spark, sf_dir))


IN = lambda terms: f"token IN ({q(terms)})"
CLASSED = f"""{AUDIT}, sc AS (SELECT *,
      CASE WHEN {IN(RULES.governance)} OR ({IN(RULES.preserve)} AND {ANY(RULES.parts, 'token')}) THEN 0.9::DOUBLE ELSE 0 END AS gov,
      CASE WHEN {IN(RULES.environment)} THEN 0.9::DOUBLE WHEN {IN(RULES.social)} THEN 0.8 WHEN {IN(RULES.preserve)} THEN 0.5 ELSE 0 END + CASE WHEN idf >= 1.0 THEN 0.15::DOUBLE ELSE 0 END AS esg,
      least(CASE WHEN {IN(RULES.boilerplate)} THEN 0.9::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(token, '^th(er|at)|^sch') THEN 0.4::DOUBLE ELSE 0 END, 1.0) + CASE WHEN idf < 0.15 THEN 0.2::DOUBLE ELSE 0 END AS bp,
      CASE WHEN regexp_matches(token, '^(an|re)d|^qu') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN idf < 0.15 THEN 0.2::DOUBLE WHEN idf < 0.5 THEN 0.1 ELSE 0 END AS gen FROM au),
    ru AS (SELECT *, greatest(gov, esg, bp, gen) AS top, CASE WHEN {IN(RULES.governance)} OR ({IN(RULES.preserve)} AND gov >= 0.8) THEN 1 WHEN {IN(RULES.environment + RULES.social)} OR ({IN(RULES.preserve)} AND esg >= 0.7) THEN 2 WHEN {IN(RULES.ambiguous)} THEN 3 WHEN bp >= 0.6 AND gov < 0.5 AND esg < 0.5 THEN 4
      WHEN len(list_filter([gov, esg, bp, gen], lambda x: greatest(gov, esg, bp, gen) - x <= 0.15 + 1e-9)) >= 2 THEN 5 ELSE 6 END AS r FROM sc),
    cl AS (SELECT token, tf, df, idf, tf_idf_avg, auto_hint, round(gov, 3) AS gov_score, round(esg, 3) AS esg_score, round(bp, 3) AS boilerplate_score, round(gen, 3) AS generic_score,
      CASE r WHEN 1 THEN 'G_SIGNAL' WHEN 2 THEN 'ESG_SIGNAL' WHEN 4 THEN 'BOILERPLATE' WHEN 3 THEN 'AMBIGUOUS' WHEN 5 THEN 'AMBIGUOUS' ELSE 'GENERIC' END AS auto_class,
      CASE r WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9 WHEN 3 THEN 0.4 WHEN 4 THEN round(bp, 2) WHEN 5 THEN round(top, 2) ELSE round(greatest(gen, 1 - greatest(esg, gov, bp)), 2) END AS confidence FROM ru)"""


@query(f"WITH {CLASSED} SELECT * FROM cl")
def token_taxonomy(spark, sf_dir):
    return audit.classify(audited(spark, sf_dir), RULES)


CLOSE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN top - {x} <= 0.15 + 1e-9 THEN '{k}' END" for k, x in (("ESG", "esg"), ("GOV", "gov"), ("BP", "bp"), ("GEN", "gen"))) + "], lambda x: x IS NOT NULL), ', ')"
PART = ANY(RULES.parts, "token")
REASONS = ", ".join((
    f"CASE r WHEN 1 THEN 'rule: governance list' WHEN 2 THEN 'rule: environment or social list' WHEN 3 THEN 'rule: listed as ambiguous' WHEN 4 THEN 'rule: boilerplate score' WHEN 5 THEN 'rule: close scores ' || {CLOSE} ELSE 'rule: no list' END",
    f"CASE WHEN {IN(RULES.governance)} OR ({IN(RULES.preserve)} AND {PART}) THEN 'governance term' END", f"CASE WHEN {IN(RULES.environment)} THEN 'environment term' END", f"CASE WHEN {IN(RULES.social)} THEN 'social term' END",
    f"CASE WHEN {IN(RULES.preserve)} THEN 'preserved term' END", f"CASE WHEN {IN(RULES.boilerplate)} THEN 'boilerplate term' END", f"CASE WHEN {IN(RULES.ambiguous)} THEN 'ambiguous term' END",
    "CASE WHEN regexp_matches(token, '^th(er|at)') THEN 'boilerplate pattern ^th(er|at)' WHEN regexp_matches(token, '^sch') THEN 'boilerplate pattern ^sch' END",
    "CASE WHEN regexp_matches(token, '^(an|re)d') THEN 'generic pattern ^(an|re)d' WHEN regexp_matches(token, '^qu') THEN 'generic pattern ^qu' END",
    "CASE WHEN idf < 0.15 THEN 'in nearly all documents' WHEN idf < 0.5 THEN 'in many documents' WHEN idf >= 1.0 THEN 'in few documents' END", "CASE WHEN df > 0.9::DOUBLE * n THEN 'in over 90 % of documents' END",
))


@query(f"WITH {CLASSED} SELECT token, CASE WHEN r = 3 THEN 'governance or general: review by hand' WHEN r = 4 AND {PART} THEN 'holds a governance word: calling it boilerplate may lose a signal' WHEN r = 5 THEN 'scores compete: ' || {CLOSE} ELSE '' END AS risk_warning, array_to_string(list_filter([{REASONS}], lambda x: x IS NOT NULL), ' | ') AS rationale FROM ru, n")
def token_reasons(spark, sf_dir):
    """What reviewers read beside a token's class: a warning, and why it has that class."""
    return audit.reasons(audited(spark, sf_dir), RULES, table(spark, sf_dir, "documents").count())


@query(f"WITH {CLASSED}, k AS (SELECT unnest({array([*audit.CLASSES])}) AS auto_class), nk AS (SELECT auto_class, count(*) AS n FROM cl GROUP BY 1) SELECT auto_class, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER (), 2) AS pct FROM k LEFT JOIN nk USING (auto_class)")
def taxonomy_summary(spark, sf_dir):
    return audit.class_summary(audit.classify(audited(spark, sf_dir), RULES))


DECISIONS = [(1, "is", "G_SIGNAL"), (2, "is", "GENERIC"), (3, "that", "BOILERPLATE"), (4, "en", "ESG_SIGNAL")]


@query(f"WITH {CLASSED}, d(position, token, class) AS (VALUES {', '.join(map(str, DECISIONS))}), e AS (SELECT token, arg_max(class, position) AS x FROM d GROUP BY 1), m AS (SELECT *, nullif(trim({MANUAL}), '') AS manual FROM cl) SELECT token, auto_class, CASE WHEN manual IS NOT NULL THEN 'kept' WHEN x IS NOT NULL THEN 'applied' ELSE 'undecided' END AS status, coalesce(manual, x) AS final_class FROM m LEFT JOIN e USING (token)")
def expert_override(spark, sf_dir):
    classified = audit.classify(audited(spark, sf_dir), RULES).withColumn("manual_class", F.expr(MANUAL))
    return audit.override(classified, spark.createDataFrame(DECISIONS, "position int, token string, class string"))


@query(f"WITH {CLASSED} SELECT auto_class AS category, token FROM cl WHERE auto_class IN ('BOILERPLATE', 'GENERIC') AND confidence >= 0.6 UNION SELECT 'BOILERPLATE', unnest(['hers', 'und'])")
def stopword_export(spark, sf_dir):
    return audit.stop_word_export(audit.classify(audited(spark, sf_dir), RULES), ["hers", "und"])


COUNT = lambda k: f"len(list_filter(t, lambda w: w IN ({q(LEXICONS[k])})))"
RATIOS = f"{TOK}, rat AS (SELECT doc_id, lang, source, len(t) AS total_tokens, {COUNT('esg')} AS esg_count, {COUNT('g')} AS g_count, {COUNT('bp')} AS bp_count FROM tok)"
SHARE = lambda a, b: f"round({a}::DOUBLE / nullif({b}, 0), 4)"
FEATURES = RATIOS + f", f AS (SELECT *, {SHARE('esg_count', 'total_tokens')} AS esg_ratio, {SHARE('g_count', 'total_tokens')} AS g_ratio, {SHARE('bp_count', 'total_tokens')} AS bp_ratio, {SHARE('(esg_count + g_count)', '(esg_count + g_count + bp_count)')} AS esg_g_relative, round(ln(1.0::DOUBLE + total_tokens), 4) AS log_tokens FROM rat)"


def ratios(spark, sf_dir):
    got = features.lexicon_ratios(base_tokens(spark, sf_dir), ["doc_id", "lang", "source"], LEXICONS)
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("total_tokens", "esg_count", "g_count", "bp_count")})


@query(f"WITH {FEATURES} SELECT * FROM f")
def lexicon_ratios(spark, sf_dir):
    return ratios(spark, sf_dir)


def _tfidf_sql(min_df: int, limit: int | None, sublinear: bool, max_df: float = 1.0) -> str:
    tf = "1 + ln(c.n::DOUBLE)" if sublinear else "c.n::DOUBLE"
    return f"""{TOK}, c AS (SELECT doc_id, token, count(*) AS n FROM tl GROUP BY 1, 2), nd AS (SELECT count(*) AS nd FROM documents),
    v AS (SELECT token, ln((1.0::DOUBLE + any_value(nd)) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM c, nd GROUP BY 1 HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * any_value(nd) ORDER BY sum(n) DESC, token {f'LIMIT {limit}' if limit else ''}),
    raw AS (SELECT doc_id, token, ({tf}) * idf AS w FROM c JOIN v USING (token)), w AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def weights(spark, sf_dir, **how):
    n = table(spark, sf_dir, "documents").count()
    rows = dealt_by(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # counted once: vocabulary and weights both read it
    return features.tfidf(written(features.token_counts(rows.select("doc_id", tx.words(tx.text_of("text")).alias("tokens")), "doc_id"), "token_counts"), "doc_id", n, **how)


@query(f"WITH {_tfidf_sql(2, 500, True)}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, token) AS rank FROM w) SELECT doc_id, token, round(w, 5) AS w, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def tfidf_topk(spark, sf_dir):
    rounded = weights(spark, sf_dir, max_features=500, sublinear=True).withColumn("exact", F.col("w")).withColumn("w", F.round("w", 6))
    return features.top_terms(rounded, "doc_id", 3).select("doc_id", "token", F.round("exact", 5).alias("w"), "rank")


@query(f"WITH {_tfidf_sql(2, None, False)} SELECT doc_id, round(sum(CASE WHEN token IN ({q(LEXICONS['esg'])}) THEN w ELSE 0.0 END) / nullif(sum(w), 0), 5) AS concentration FROM w GROUP BY 1")
def tfidf_concentration(spark, sf_dir):
    return features.concentration(weights(spark, sf_dir), "doc_id", F.col("token").isin(LEXICONS["esg"]))


@query(f"WITH {_tfidf_sql(2, None, False)} SELECT doc_id, " + ", ".join(f"round(sum(CASE WHEN token IN ({q(t)}) THEN w ELSE 0.0 END), 5) AS tfidf_{k}" for k, t in SEED_TERMS.items()) + " FROM w GROUP BY 1")
def seed_tfidf_dim(spark, sf_dir):
    return features.seed_weights(weights(spark, sf_dir), "doc_id", SEED_TERMS)


GRAMS = f"""wd AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) || ' ' AS w FROM documents), tl AS (SELECT doc_id, substring(w, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS token FROM wd, range(2, 5) g(n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i))"""


@query(f"WITH {_tfidf_sql(2, 5000, False).replace(TOK, GRAMS)}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS k FROM w) SELECT doc_id, round(sum(CASE WHEN contains(token, 'th') OR contains(token, 'un') THEN w ELSE 0.0 END) / nullif(sum(w), 0), 4) AS concentration FROM rk WHERE k <= 200 GROUP BY 1")
def tfidf_char(spark, sf_dir):
    # the grams of a text are many times its size: texts are dealt by document, and grams are made where they are counted, twice
    rows = dealt_by(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    counts = features.token_counts(rows.select("doc_id", features.char_ngrams(tx.text_of("text")).alias("tokens")), "doc_id")
    w = features.tfidf(counts, "doc_id", table(spark, sf_dir, "documents").count(), max_features=5000)
    return features.concentration(w, "doc_id", tx.has_any(F.col("token"), ["th", "un"]), 200, 4)


@query("""WITH s AS (SELECT vec_id AS seed_id, embedding AS s FROM embeddings WHERE vec_id < 5), t AS (SELECT unnest([0.2::DOUBLE, 0.3, 0.5]) AS theta),
    c AS (SELECT seed_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(s, lambda x: x::DOUBLE)) AS cos FROM embeddings, s WHERE vec_id <> seed_id)
    SELECT seed_id, theta, sum(CASE WHEN cos >= theta THEN 1 ELSE 0 END)::BIGINT AS n_candidates FROM c, t GROUP BY 1, 2""")
def embedding_expansion_theta(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return features.expansion(v, v.where("vec_id < 5"), "vec_id", "embedding", [0.2, 0.3, 0.5])


LABEL = f"CASE WHEN token IN ({q(LEXICONS['g'])}) THEN 'G' WHEN token IN ({q(LEXICONS['esg'])}) THEN 'ESG' WHEN token IN ({q(LEXICONS['bp'])}) THEN 'BP' ELSE 'OTHER' END"
RANKED = f"{GRID_SQL}, ct AS (SELECT exp_id, token, count(*) AS tf FROM gl GROUP BY 1, 2), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY exp_id ORDER BY tf DESC, token) AS INTEGER) AS rank, {LABEL} AS token_class FROM ct), tp AS (SELECT * FROM rk WHERE rank <= 30)"


@query(f"WITH {RANKED} SELECT exp_id, rank, token, tf, token_class FROM tp")
def eval_ranked_tokens(spark, sf_dir):
    return evaluate.ranked(grid(spark, sf_dir), LEXICONS)


METRICS = f"""{RANKED}, s AS (SELECT exp_id, round(avg(len(t)), 4) AS avg_tokens FROM grid GROUP BY 1),
    k AS (SELECT exp_id, count(DISTINCT token) AS vocab_size, count(DISTINCT CASE WHEN token IN ({q(LISTS.protect)}) THEN token END) AS protected_kept FROM gl GROUP BY 1),
    c AS (SELECT exp_id, {", ".join(f"sum(CASE WHEN token_class = '{x}' THEN 1 ELSE 0 END)::BIGINT AS top_{x.lower()}" for x in ("G", "ESG", "BP", "OTHER"))} FROM tp GROUP BY 1),
    me AS (SELECT *, round(top_bp * 100.0::DOUBLE / 30, 4) AS bp_rate, round((top_g + top_esg) * 100.0::DOUBLE / 30, 4) AS signal_rate, round(protected_kept * 100.0::DOUBLE / {len(LISTS.protect)}, 4) AS protect_pct FROM s JOIN k USING (exp_id) JOIN c USING (exp_id))"""


@query(f"WITH {METRICS} SELECT * FROM me")
def eval_metrics(spark, sf_dir):
    return evaluate.metrics(grid(spark, sf_dir), LEXICONS, LISTS.protect)


@query(f"WITH {METRICS} SELECT exp_id, protect_pct, CASE WHEN protect_pct >= 80 THEN 'PASS' ELSE 'WARN' END AS status FROM me")
def eval_status(spark, sf_dir):
    return evaluate.status(evaluate.metrics(grid(spark, sf_dir), LEXICONS, LISTS.protect)).select("exp_id", "protect_pct", "status")


D_COLUMNS = ["avg_tokens", "bp_rate", "signal_rate"]


@query(f"WITH {METRICS}, b AS (SELECT * FROM me WHERE exp_id = 'exp_B') SELECT me.exp_id, " + ", ".join(f"round(me.{c} - b.{c}, 4) AS d_{c}" for c in D_COLUMNS) + " FROM me, b WHERE me.exp_id <> 'exp_B'")
def eval_delta(spark, sf_dir):
    return evaluate.deltas(evaluate.metrics(grid(spark, sf_dir), LEXICONS, LISTS.protect), "exp_B", D_COLUMNS)


SHARES = lambda src, p, with_tokens: ", ".join(f"count(*) FILTER (token IN ({q(LEXICONS[k])})) AS {p}_{k}_count, round(count(*) FILTER (token IN ({q(LEXICONS[k])})) * 100.0::DOUBLE / 30, 1) AS {p}_{k}_rate" + (f", coalesce(string_agg(token, ', ' ORDER BY rank) FILTER (token IN ({q(LEXICONS[k])})), '') AS {p}_{k}_tokens" if with_tokens else "") for k in ("bp", "esg", "g"))
REPORT = f"""{RANKED}, s AS (SELECT exp_id, count(*) AS n_docs, round(avg(len(t)), 1) AS avg_token_count, round(avg(CASE WHEN len(t) > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS coverage_pct FROM grid GROUP BY 1),
    vs AS (SELECT exp_id, count(DISTINCT token) AS vocab_size, count(DISTINCT CASE WHEN token IN ({q(LEXICONS['g'])}) THEN token END) AS g_signal_in_vocab FROM gl GROUP BY 1),
    cn AS (SELECT exp_id, doc_id, token, count(*) AS n FROM gl GROUP BY 1, 2, 3), vo AS (SELECT exp_id, token, count(*) AS df, sum(n) AS tf FROM cn GROUP BY 1, 2 HAVING count(*) >= 2),
    vt AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY tf DESC, token) AS r FROM vo),
    rw AS (SELECT exp_id, doc_id, token, n_docs, (1 + ln(n::DOUBLE)) * (ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1) AS w FROM cn JOIN vt USING (exp_id, token) JOIN s USING (exp_id) WHERE r <= 500),
    nw AS (SELECT exp_id, token, n_docs, w / sqrt(sum(w * w) OVER (PARTITION BY exp_id, doc_id)) AS w FROM rw), mw AS (SELECT exp_id, token, round(sum(w) / any_value(n_docs), 9) AS mean FROM nw GROUP BY 1, 2),
    tw AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY mean DESC, token) AS rank FROM mw QUALIFY rank <= 30),
    bt AS (SELECT exp_id, string_agg(token, ' | ' ORDER BY rank) AS tf_top_n, {SHARES('tp', 'tf', True)} FROM tp GROUP BY 1), bw AS (SELECT exp_id, string_agg(token, ' | ' ORDER BY rank) AS tfidf_top_n, {SHARES('tw', 'tfidf', False)} FROM tw GROUP BY 1),
    mi AS (SELECT e.exp_id, coalesce(string_agg(g.token, ', ' ORDER BY g.i) FILTER (h.token IS NULL), '') AS g_missing FROM (SELECT DISTINCT exp_id FROM grid) e, (SELECT unnest({array(LEXICONS['g'])}) AS token, unnest(range({len(LEXICONS['g'])})) AS i) g LEFT JOIN (SELECT DISTINCT exp_id, token FROM gl) h ON h.exp_id = e.exp_id AND h.token = g.token GROUP BY 1),
    re AS (SELECT s.*, vocab_size, bt.* EXCLUDE (exp_id), bw.* EXCLUDE (exp_id), g_signal_in_vocab, {len(LEXICONS['g'])}::BIGINT AS g_signal_total, round(g_signal_in_vocab * 100.0::DOUBLE / {len(LEXICONS['g'])}, 1) AS g_signal_pct, g_missing FROM s JOIN vs USING (exp_id) JOIN bt USING (exp_id) JOIN bw USING (exp_id) JOIN mi USING (exp_id))"""


def reported(spark, sf_dir):
    return evaluate.report(tokens.grid_rows(docs(spark, sf_dir), "text", tokens.GRID, LISTS), tokens.GRID, LISTS, LEXICONS)


@query(f"WITH {REPORT} SELECT * FROM re")
def eval_report(spark, sf_dir):
    """All fields an experiment is judged by."""
    return reported(spark, sf_dir)


R_COLUMNS = ["tf_bp_rate", "tf_esg_rate", "tf_g_rate", "avg_token_count", "vocab_size", "tfidf_bp_rate", "tfidf_esg_rate"]


@query(f"WITH {REPORT}, b AS (SELECT * FROM re WHERE exp_id = 'exp_B') SELECT 'exp_B' AS baseline_exp, re.exp_id AS target_exp, " + ", ".join(f"round(coalesce(re.{c}, 0) - coalesce(b.{c}, 0), 1) AS delta_{c}" for c in R_COLUMNS) + ", b.g_signal_pct AS g_signal_pct_baseline, re.g_signal_pct AS g_signal_pct_target, re.g_missing AS g_missing_target FROM re, b WHERE re.exp_id IN ('exp_E', 'exp_F')")
def eval_reduction(spark, sf_dir):
    return evaluate.reduction(reported(spark, sf_dir), "exp_B", ["exp_E", "exp_F"])


@query(f"WITH {GRID_SQL}, w AS (SELECT DISTINCT exp_id, p AS token FROM grid, (SELECT unnest({array(LISTS.protect + ['zzz'])}) AS p)) SELECT * FROM w EXCEPT SELECT exp_id, token FROM gl")
def protected_missing(spark, sf_dir):
    return evaluate.missing_protected(grid(spark, sf_dir), [*LISTS.protect, "zzz"])


@query("SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_event(spark, sf_dir):
    got = latest_per_key(table(spark, sf_dir, "events"), ["user_id"], F.col("ts").desc(), F.col("event_id"))
    return got.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


PRIORITY = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {PRIORITY}, ts, event_id) AS r FROM events) WHERE r = 1")
def priority_first(spark, sf_dir):
    got = latest_per_key(table(spark, sf_dir, "events"), ["user_id"], F.expr(PRIORITY), F.col("ts"), F.col("event_id"))
    return got.select("user_id", "event_id", "event_type")
