"""Features of a document: lexicon ratios and TF-IDF, in long form."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .tokens import token_runs


def members(tokens: Column, terms: Sequence[str]) -> Column:
    """How many tokens, repeats counted, are in the list."""
    return F.size(F.filter(tokens, lambda t: t.isin([*terms])))


def lexicon_ratios(tokenized: DataFrame, keys: Sequence[str], lexicons: dict[str, Sequence[str]], places: int = 4) -> DataFrame:
    """Counts and shares of the lexicons esg, g and bp; shares are null without tokens, never 0."""
    rows = tokenized.select(*keys, F.size("tokens").alias("total_tokens"), *(members(F.col("tokens"), lexicons[k]).alias(f"{k}_count") for k in ("esg", "g", "bp")))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), places)
    both = F.col("esg_count") + F.col("g_count")
    return rows.select("*", *(share(F.col(f"{k}_count"), F.col("total_tokens")).alias(f"{k}_ratio") for k in ("esg", "g", "bp")), share(both, both + F.col("bp_count")).alias("esg_g_relative"), F.round(F.log1p(F.col("total_tokens").cast("double")), 4).alias("log_tokens"))


#: A vocabulary of up to so many terms (of some 100 bytes) is broadcast; a larger one is joined by token.
VOCABULARY = 500_000


def tfidf(counts: DataFrame, doc: str, n_docs: int, min_df: int = 2, max_features: int | None = None, sublinear: bool = False, max_df: float = 1.0) -> DataFrame:
    """doc, token, w: smoothed idf, rows of length 1. counts: doc, token, n, which are read twice.

    The vocabulary is small beside the rows: at most max_features terms, if that is given. It is written, and broadcast if
    it is small, so that counts stay where they are.
    """
    vocabulary = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.col("tf").desc(), "token").limit(max_features)
    idf = F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0
    terms = written(vocabulary.select("token", idf.alias("idf")), "vocabulary")
    if terms.count() <= VOCABULARY:
        terms = F.broadcast(terms)
    tf = 1 + F.log(F.col("n").cast("double")) if sublinear else F.col("n").cast("double")
    rows = counts.join(terms, "token").select(doc, "token", (tf * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return rows.select(doc, "token", (F.col("raw") / norm).alias("w"))


def token_counts(tokenized: DataFrame, doc: str) -> DataFrame:
    """doc, token, n of a row of tokens per document. Where texts were dealt by doc before (repartition), no token is shuffled."""
    return token_runs(tokenized, [doc]).groupBy(doc, "token").agg(F.sum("n").alias("n"))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """n-grams inside words, a space added on both sides of each."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*(F.when(F.length(w) >= n, grams(w, n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1))))))


def concentration(weights: DataFrame, doc: str, hit: Column, top: int | None = None, places: int = 5) -> DataFrame:
    """Share of a document's (top) weight that falls on tokens where `hit` is true; null without weight."""
    if top is not None:
        weights = weights.withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy(F.col("w").desc(), "token"))).where(F.col("__k") <= top)
    return weights.groupBy(doc).agg(F.round(F.try_divide(F.sum(F.when(hit, F.col("w")).otherwise(0.0)), F.sum("w")), places).alias("concentration"))


def seed_weights(weights: DataFrame, doc: str, seeds: dict[str, Sequence[str]], places: int = 5) -> DataFrame:
    """Sum of the weights of each dimension's seeds; 0 where none occurs."""
    return weights.groupBy(doc).agg(*(F.round(F.sum(F.when(F.col("token").isin([*terms]), F.col("w")).otherwise(0.0)), places).alias(f"tfidf_{k}") for k, terms in seeds.items()))


def top_terms(weights: DataFrame, doc: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.col("w").desc(), "token"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def wide(docs: DataFrame, weights: DataFrame, doc: str, vocabulary: Sequence[str]) -> DataFrame:
    """A row for each document and a column for each term: 0 where a document lacks it, also in documents that have none."""
    held = weights.where(F.col("token").isin([*vocabulary])).groupBy(doc).pivot("token", [*vocabulary]).agg(F.first("w"))
    return docs.select(doc).distinct().join(held, doc, "left").fillna(0.0, [*vocabulary])


def sparsity(seeds: DataFrame, counts: DataFrame, sparse_up_to: int = 10) -> DataFrame:
    """Per seed: frequency and documents, zero rows kept. counts: token, tf, df."""
    rows = seeds.join(counts, F.col("seed") == F.col("token"), "left")
    df = F.coalesce("df", F.lit(0))
    return rows.select("dimension", "seed", F.coalesce("tf", F.lit(0)).alias("tf"), df.alias("df"), (df <= sparse_up_to).alias("is_sparse"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def expansion(vectors: DataFrame, seeds: DataFrame, key: str, vector: str, thetas: Sequence[float]) -> DataFrame:
    """Candidates of each seed vector at each cosine threshold. seeds is a dictionary of a few dozen rows."""
    s = F.broadcast(seeds.select(F.col(key).alias("seed_id"), F.col(vector).alias("__s")))
    rows = vectors.join(s, F.col(key) != F.col("seed_id")).select("seed_id", cosine(F.col(vector), F.col("__s")).alias("cos"))
    return rows.select("seed_id", "cos", F.explode(F.array(*(F.lit(float(t)) for t in thetas))).alias("theta")).groupBy("seed_id", "theta").agg(F.sum((F.col("cos") >= F.col("theta")).cast("bigint")).alias("n_candidates"))


def _unit_blocks(rows: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """dim, keys and unit vectors (as the bytes of a float64 matrix) of `size` rows at most; vectors without a length take no part."""
    ids, matrix = names
    fields = pa.schema([("dim", pa.int32()), (ids, pa.list_(pa.int64())), (matrix, pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int, part: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"dim": dim, ids: [k for k, _ in part], matrix: np.vstack([v for _, v in part]).tobytes()}], fields)

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is None or not v or any(x is None for x in v):
                    continue
                x = np.asarray(v, dtype=np.float64)
                norm = float(np.sqrt(x @ x))
                if not np.isfinite(norm) or norm == 0:
                    continue
                part = held.setdefault(len(x), [])
                part.append((k, x / norm))
                if len(part) == size:
                    yield block(len(x), held.pop(len(x)))
        for dim, part in held.items():
            yield block(dim, part)

    return rows.select(F.col(key).cast("bigint"), vector).mapInArrow(pack, f"dim int, {ids} array<bigint>, {matrix} binary")


def nearest(vectors: DataFrame, seeds: DataFrame, key: str, vector: str, most: int = 100, least: float = 0.5, block: int = 1024, spread: int = 32) -> DataFrame:
    """seed_id, rank, candidate, cos: of each seed the `most` candidates of the highest cosine, of `least` or more; a seed is no candidate of its own.

    Seeds and vectors are packed in blocks, and every two blocks meet in one matrix product, which keeps `most` for a seed;
    what the blocks keep is merged by seed. Neither side is broadcast or held whole: blocks of vectors are dealt over
    `spread` groups, and a copy of the seeds' blocks goes through each. Cosines are to nine places; equal ones go by key.
    """
    left = _unit_blocks(seeds, key, vector, block // 4, ("seed_ids", "seed_matrix")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = _unit_blocks(vectors, key, vector, block, ("ids", "matrix")).withColumn("at", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
    fields = pa.schema([("seed_id", pa.int64()), ("candidate", pa.int64()), ("cos", pa.float64())])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                dim, a, b = row["dim"], np.asarray(row["seed_ids"]), np.asarray(row["ids"])
                cos = np.round(np.frombuffer(row["seed_matrix"]).reshape(-1, dim) @ np.frombuffer(row["matrix"]).reshape(-1, dim).T, 9)
                cos[a[:, None] == b[None, :]] = -np.inf
                out = []
                for i in np.flatnonzero((cos >= least).any(axis=1)):
                    near = np.flatnonzero(cos[i] >= least)
                    near = near[np.lexsort((b[near], -cos[i][near]))[:most]]
                    out.append((np.full(len(near), a[i]), b[near], cos[i][near]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=fields)

    met = right.join(left, ["dim", "at"]).select("dim", "seed_ids", "seed_matrix", "ids", "matrix")
    found = met.mapInArrow(multiply, "seed_id bigint, candidate bigint, cos double")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("cos"), "candidate"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most).select("seed_id", "rank", "candidate", "cos")


def grade_number(c: Column, grades: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in grades.items() for x in pair)), c)


def dictionary_scores(weights: DataFrame, doc: str, seeds: dict[str, Sequence[str]], expanded: dict[str, Sequence[str]], places: int = 5) -> DataFrame:
    """Per document and dimension: weight on seeds, on the expanded dictionary, and the cosine to the latter as a vector of ones. weights: rows of length 1."""
    on = lambda terms: F.sum(F.when(F.col("token").isin([*terms]), F.col("w")).otherwise(0.0))
    out = []
    for k, terms in expanded.items():
        out += [F.round(on(seeds[k]), places).alias(f"seed_{k}"), F.round(on(terms), places).alias(f"expanded_{k}"), F.round(on(terms) / len(set(terms)) ** 0.5, places).alias(f"cosine_{k}")]
    return weights.groupBy(doc).agg(*out)


def feature_table(ratios: DataFrame, doc: str, *more: DataFrame) -> DataFrame:
    """Ratios with the columns of other feature tables beside them; a document that these lack has nulls."""
    for other in more:
        ratios = ratios.join(other, doc, "left")
    return ratios
