"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, language_id, lexical_search, line_dedup, mixing, ngram_join, packing, quality_rules, secrets, token_store, top_k, toxicity, warc
from .common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write(_table(spark, sf_dir, "documents"), path)
    stored = token_store.read(spark, path)
    rows = token_store.with_starts(token_store.checksums(stored), stored)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, written), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return got.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, places = packing.pack(_table(spark, sf_dir, "documents"))
    digests = pieces.select("piece_id", "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"))
    got = digests.join(places, "piece_id")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("bigint").alias("offset"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language_id.train(docs, ~fold)
    got = language_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.copies(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, keep="none")
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~fold)
    got = toxicity.score(docs, model)
    return got.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_top_k, op3_secrets, op4_packing, op5_language_id, op6_mixing, op7_line_dedup, op8_toxicity, op9_ngram_join, op10_quality_rules, op11_lexical_search, op12_filter_audit, op13_warc)
}
ORACLES: dict[str, str] = {
    "op2_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 10""",
    "op7_line_dedup": r"""
        WITH e AS (SELECT doc_id, r, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        d AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY r, doc_id""",
    "op11_lexical_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM benchmark WHERE text IS NOT NULL),
        z AS (SELECT count(*) AS big_n, CAST(sum(len(a)) AS BIGINT) AS big_l FROM d WHERE len(a) > 0),
        q AS (SELECT DISTINCT item_id, i, unnest(a) AS term FROM b),
        tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(a) AS n, unnest(a) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z WHERE term IN (SELECT term FROM q) GROUP BY term, big_n),
        s AS (SELECT item_id, i, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), z GROUP BY item_id, i, doc_id, r),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 10""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        lows AS (SELECT x, min(doc_id) AS low FROM t GROUP BY x),
        lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS tox FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(tox, false) AS tox,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask
              FROM t JOIN lows USING (x) LEFT JOIN lab USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (tox) AS x FROM f GROUP BY part, mask),
        e AS (SELECT i, chr(CAST(65 + i AS INTEGER)) AS l FROM range(5) AS r(i)),
        o AS (SELECT a.l || b.l || c.l || d.l || e5.l AS filter_order FROM e a, e b, e c, e d, e e5 WHERE len(list_distinct([a.i, b.i, c.i, d.i, e5.i])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(substr(filter_order, CAST(step AS INTEGER), 1)) - 65) AS own,
                coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(filter_order, CAST(j AS INTEGER), 1)) - 65))), 0)::BIGINT AS bef FROM o, range(1, 6) AS r(step)),
        v AS (SELECT part, filter_order, step, own,
                coalesce(sum(n) FILTER ((mask & (own | bef)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & bef) = 0), 0) AS removed,
                coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & bef) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
                coalesce(sum(g) FILTER ((mask & own) <> 0 AND (mask & bef) = 0), 0) AS good_lost, coalesce(sum(x) FILTER ((mask & own) <> 0 AND (mask & bef) = 0), 0) AS toxic_lost
              FROM s, c GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM v""",
    "op13_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, coalesce(html, '') AS h FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
        FROM (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM m)""",
}
