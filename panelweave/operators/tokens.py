"""Cleaning and tokenising under a grid of configurations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx

Tokenizer = Callable[[Column], Column]
STRENGTHS = ("minimal", "standard", "extended", "extended_plus_official")


@dataclass(frozen=True)
class WordLists:
    """Stop words by tier, each adding to the last, and the terms that no configuration removes."""

    minimal: list[str] = field(default_factory=lambda: fixed.STOP_MINIMAL)
    standard: list[str] = field(default_factory=lambda: fixed.STOP_STANDARD)
    extended: list[str] = field(default_factory=lambda: fixed.STOP_EXTENDED)
    official: list[str] = field(default_factory=list)
    boilerplate: list[str] = field(default_factory=lambda: fixed.BOILERPLATE_NOUNS)
    protect: list[str] = field(default_factory=lambda: fixed.GOVERNANCE_PROTECT)
    lines: list[str] = field(default_factory=lambda: fixed.BOILERPLATE_LINES)
    units: list[str] = field(default_factory=lambda: fixed.QUANTITY_UNITS)
    names: list[str] = field(default_factory=list)

    def stop_words(self, strength: str) -> list[str]:
        if strength not in STRENGTHS:
            raise ValueError(f"unknown strength {strength!r}; one of {', '.join(STRENGTHS)}")
        tiers = (self.minimal, self.standard, self.extended, self.official)[: STRENGTHS.index(strength) + 1]
        return list(dict.fromkeys(t for tier in tiers for t in tier))

    def removed(self, config: Config) -> list[str]:
        """Terms that a configuration takes out; never a protected one."""
        extra = self.boilerplate if config.boilerplate_nouns else []
        return [t for t in dict.fromkeys([*self.stop_words(config.stop_words), *extra]) if t not in {*self.protect}]

    def conflicts(self) -> list[str]:
        """Protected terms among the stop words: there should be none."""
        return sorted({*self.protect} & {*self.stop_words("extended")})


@dataclass(frozen=True)
class Config:
    """One experiment."""

    name: str
    stop_words: str
    numbers: str
    names: bool = False
    lines: bool = False
    boilerplate_nouns: bool = False
    least_seeds: int = 1


GRID = [
    Config("exp_A", "minimal", "remove_all"),
    Config("exp_B", "standard", "remove_all"),
    Config("exp_C", "minimal", "keep_quantity", names=True),
    Config("exp_D", "extended", "remove_all", names=True),
    Config("exp_E", "extended", "remove_all", True, True, True),
    Config("exp_F", "extended", "keep_quantity", True, True, True),
    Config("exp_F_official", "extended_plus_official", "keep_quantity", True, True, True),
]


def clean(c: Column, config: Config, lists: WordLists) -> Column:
    """Names, numbers and lines, in that order."""
    if config.names:
        c = tx.remove_names(c, lists.names)
    c = tx.number_mode(c, config.numbers, lists.units)
    return tx.drop_lines(c, lists.lines) if config.lines and lists.lines else c


def kept_tokens(tokens: Column, removed: Sequence[str], least: int = 2) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin([*removed]) if removed else F.length(t) >= least)


def tokenize(docs: DataFrame, keys: Sequence[str], text: str, config: Config, lists: WordLists, tokenizer: Tokenizer = tx.words) -> DataFrame:
    """keys, exp_id, tokens. A morphological tokenizer is any function from a text column to an array column."""
    tokens = kept_tokens(tokenizer(clean(tx.text_of(text), config, lists)), lists.removed(config))
    return docs.select(*keys, F.lit(config.name).alias("exp_id"), tokens.alias("tokens"))


def _cleanings(grid: Sequence[Config]) -> list[list[Config]]:
    """Experiments that clean alike, and so share their tokens."""
    alike: dict[tuple, list[Config]] = {}
    for c in grid:
        alike.setdefault((c.names, c.numbers, c.lines), []).append(c)
    return [*alike.values()]


def _named(cleanings: Sequence[Sequence[Config]], k: Column) -> Column:
    """The experiments of cleaning k."""
    return F.create_map(*(x for i, configs in enumerate(cleanings) for x in (F.lit(i), F.array(*(F.lit(c.name) for c in configs)))))[k]


def run_grid(docs: DataFrame, keys: Sequence[str], text: str, grid: Sequence[Config], lists: WordLists, tokenizer: Tokenizer = tx.words) -> DataFrame:
    """keys, exp_id, tokens of all experiments in one scan; those that clean alike share the tokenizing."""
    alike = _cleanings(grid)
    own = [F.struct(F.lit(k).alias("k"), tokenizer(clean(tx.text_of(text), configs[0], lists)).alias("t")) for k, configs in enumerate(alike)]
    rows = docs.select(*keys, F.explode(F.array(*own)).alias("__x")).select(*keys, "__x.t", F.explode(_named(alike, F.col("__x.k"))).alias("exp_id"))
    tokens = F.lit(None)
    for c in grid:
        tokens = F.when(F.col("exp_id") == c.name, kept_tokens(F.col("t"), lists.removed(c))).otherwise(tokens)
    return rows.select(*keys, "exp_id", tokens.alias("tokens"))


#: Begins the names of a count that aren't tokens; no tokenizer gives it.
MARK = "\x00"


def token_runs(tokenized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, token, n: each distinct token of a row once, with its count.

    The tokens of a row are sorted and their runs measured, so nothing is shuffled for it. Rows without tokens go after
    the runs are made (explode_outer), since Spark would make the tokens again for a condition on them before.
    """
    tokens, starts = F.col("tokens"), F.col("__starts")
    rows = tokenized.select(*keys, F.sort_array("tokens").alias("tokens"))
    first = lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1))
    rows = rows.withColumn("__starts", F.when(F.size("tokens") > 0, F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), first)))
    run = lambda at, j: F.struct(F.get(tokens, at).alias("token"), (F.coalesce(F.get(starts, j + 1), F.size("tokens")) - at).cast("bigint").alias("n"))
    return rows.select(*keys, F.explode_outer(F.transform(starts, run)).alias("__r")).where("__r is not null").select(*keys, "__r.token", "__r.n")


def grid_rows(docs: DataFrame, text: str, grid: Sequence[Config], lists: WordLists, tokenizer: Tokenizer = tx.words, least: int = 2) -> DataFrame:
    """row, ks, token, n: what each document has under its cleanings, from one scan and without a shuffle.

    Experiments that clean alike share a cleaning, and cleanings that leave a document the same text share its tokens: bit k
    of ks stands for cleaning k. The token MARK stands for the document itself, MARK + exp_id for an experiment that leaves
    it a token. Stop words are in: they go after the counting, from distinct tokens.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("__text"))
    return token_runs(_marked_tokens(named, ["row"], "__text", grid, lists, tokenizer, least), ["row", "ks"])


def _marked_tokens(docs: DataFrame, keys: Sequence[str], text: str, grid: Sequence[Config], lists: WordLists, tokenizer: Tokenizer, least: int) -> DataFrame:
    """keys, ks, tokens: a document's tokens and marks for each distinct text that its cleanings leave."""
    alike = _cleanings(grid)
    # a column of its own, where steps that cleanings share are taken once
    cleaned = docs.select(*keys, F.array(*(clean(tx.text_of(text), configs[0], lists) for configs in alike)).alias("__a"))
    bits = lambda x: sum((F.when(F.get("__a", F.lit(k)) == x, 1 << k).otherwise(0) for k in range(len(alike))), F.lit(0).cast("bigint"))
    distinct = F.transform(F.array_distinct("__a"), lambda x: F.struct(bits(x).alias("ks"), x.alias("text")))
    # exploded before the marks are added, so that no token list is made twice
    texts = cleaned.select(*keys, F.explode_outer(distinct).alias("__x")).select(*keys, "__x.ks", tokenizer(F.col("__x.text")).alias("__t"))
    return texts.select(*keys, "ks", _with_marks(F.col("__t"), {c.name: (_has(k), lists.removed(c)) for k, configs in enumerate(alike) for c in configs}, least).alias("tokens"))


def _has(k: int) -> Column:
    """Whether cleaning k is in ks."""
    return F.col("ks").bitwiseAND(F.lit(1 << k)) != 0


def grid_counts(docs: DataFrame, text: str, grid: Sequence[Config], lists: WordLists, tokenizer: Tokenizer = tx.words, least: int = 2) -> DataFrame:
    """exp_id, token, n of all experiments, from one scan and one aggregate; marks are as in count_grid().

    Only count_grid() has df. Without it a document's tokens needn't be counted by themselves: they go into the aggregate as they are.
    """
    tokens = _marked_tokens(docs, [], text, grid, lists, tokenizer, least)
    # none is empty, since each has a mark; explode() would ask for that first, and make the tokens again
    counts = tokens.select("ks", F.explode_outer("tokens").alias("token")).groupBy("ks", "token").agg(F.count(F.lit(1)).alias("n"))
    return _by_experiment(counts, ["n"], grid, lists, least)


def count_grid(rows: DataFrame, grid: Sequence[Config], lists: WordLists, least: int = 2) -> DataFrame:
    """exp_id, token, n, df of grid_rows(); the token MARK counts documents, MARK + exp_id those that keep a token."""
    counts = rows.groupBy("ks", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
    return _by_experiment(counts, ["n", "df"], grid, lists, least)


def _by_experiment(counts: DataFrame, sums: Sequence[str], grid: Sequence[Config], lists: WordLists, least: int) -> DataFrame:
    """Counts per cleanings and token for each experiment, without the tokens that it removes."""
    alike = _cleanings(grid)
    ks = F.filter(F.array(*(F.when(_has(k), F.lit(k)) for k in range(len(alike)))), lambda k: k.isNotNull())
    # those of a text that cleanings share belong to each of them
    each = counts.select(F.explode(ks).alias("k"), "token", *sums).groupBy("k", "token").agg(*(F.sum(c).alias(c) for c in sums))
    named = each.select("k", F.explode(_named(alike, F.col("k"))).alias("exp_id"), "token", *sums)
    return named.where(_kept(grid, lists, least)).drop("k")


def _kept(grid: Sequence[Config], lists: WordLists, least: int) -> Column:
    """Whether exp_id keeps token; of the marks, its own and that of documents."""
    removed = F.lit(False)
    for c in grid:
        if lists.removed(c):
            removed = removed | ((F.col("exp_id") == c.name) & F.col("token").isin(lists.removed(c)))
    own_mark = (F.col("token") == MARK) | (F.col("token") == F.concat(F.lit(MARK), "exp_id"))
    return F.when(F.col("token").startswith(MARK), own_mark).otherwise((F.length("token") >= least) & ~removed)


def grid_weights(rows: DataFrame, counts: DataFrame, grid: Sequence[Config], min_df: int = 2, max_features: int = 500) -> DataFrame:
    """exp_id, row, token, w: sublinear TF-IDF of each document under each experiment, rows of length 1, over a vocabulary for each.

    rows: grid_rows(), written. counts: count_grid() of them. A vocabulary has max_features terms at most, the most
    frequent ones, so all of them together are broadcast.
    """
    n_docs = counts.where(F.col("token") == MARK).select(F.col("exp_id").alias("__e"), F.col("n").alias("n_docs"))
    place = F.row_number().over(Window.partitionBy("exp_id").orderBy(F.desc("n"), "token"))
    terms = grid_tokens(counts).where(F.col("df") >= min_df).withColumn("__k", place).where(F.col("__k") <= max_features)
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    of = F.create_map(*(x for k, configs in enumerate(_cleanings(grid)) for c in configs for x in (F.lit(c.name), F.lit(k))))
    terms = terms.join(F.broadcast(n_docs), F.col("exp_id") == F.col("__e")).select("exp_id", "token", of[F.col("exp_id")].alias("k"), idf.alias("idf"))
    terms = terms.withColumn("bit", F.expr("shiftleft(1L, k)")).withColumnRenamed("token", "__token")
    here = (F.col("token") == F.col("__token")) & (F.col("ks").bitwiseAND(F.col("bit")) != 0)
    raw = rows.join(F.broadcast(terms), here).select("exp_id", "row", "token", ((1 + F.log(F.col("n").cast("double"))) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row", "exp_id")))
    return raw.select("exp_id", "row", "token", (F.col("raw") / norm).alias("w"))


def _with_marks(tokens: Column, removed: dict[str, tuple[Column, Sequence[str]]], least: int) -> Column:
    """A text's tokens, MARK, and MARK with the name of each experiment that it is of and that keeps one of them."""
    kept = lambda out: lambda t: (F.length(t) >= least) & ~t.isin([*out]) if out else F.length(t) >= least
    marks = F.array(F.lit(MARK), *(F.when(own & F.exists(tokens, kept(out)), F.lit(MARK + name)) for name, (own, out) in removed.items()))
    return F.concat(tokens, F.filter(marks, lambda m: m.isNotNull()))


def grid_tokens(counts: DataFrame) -> DataFrame:
    """exp_id, token, n without the documents' marks."""
    return counts.where(~F.col("token").startswith(MARK))


def grid_sizes(counts: DataFrame, places: int = 4, *more: Column) -> DataFrame:
    """n_docs, average tokens, coverage and vocabulary of each experiment, and more aggregates over exp_id, token, n; no rows without documents."""
    is_mark = F.col("token").startswith(MARK)
    n_docs, covered = F.sum(F.when(F.col("token") == MARK, F.col("n"))), F.coalesce(F.sum(F.when(is_mark & (F.col("token") != MARK), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum(F.when(~is_mark, F.col("n"))), F.lit(0))
    return counts.groupBy("exp_id").agg(n_docs.alias("n_docs"), F.round(total / n_docs, places).alias("avg_tokens"), F.round(covered / n_docs * 100, places).alias("coverage_pct"), F.count(F.when(~is_mark, 1)).alias("vocab_size"), *more)


def token_log(tokenized: DataFrame, keys: Sequence[str], seeds: Sequence[str]) -> DataFrame:
    """Counts of a document's tokens and the first five seeds among them."""
    found = F.array_intersect(F.array_sort(F.array_distinct("tokens")), tx.literals(seeds))
    return tokenized.select(*keys, F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_unique"), F.size(found).alias("n_seed_found"), F.array_join(F.slice(found, 1, 5), "|").alias("first_seeds"))


def token_rows(tokenized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per token."""
    return tokenized.select(*keys, F.explode("tokens").alias("token"))


def seed_coverage(spark_seeds: DataFrame, tokenized: DataFrame, doc: str, rare_below: int = 50) -> DataFrame:
    """Per seed: exact corpus frequency, documents whose joined tokens contain it as a substring, and whether it is rare."""
    counts = token_rows(tokenized, [doc]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    terms = [r["seed"] for r in spark_seeds.select("seed").collect()]  # a dictionary of a few dozen terms
    joined = F.array_join("tokens", " ")
    hits = tokenized.select(F.explode(tx.matched(joined, terms)).alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    rows = spark_seeds.join(counts, F.col("seed") == F.col("token"), "left").join(hits, "seed", "left")
    freq = F.coalesce("n", F.lit(0))
    return rows.select("seed", freq.alias("corpus_freq"), F.coalesce("docs", F.lit(0)).alias("doc_count"), (freq < rare_below).alias("rare"))
