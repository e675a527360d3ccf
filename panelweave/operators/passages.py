"""Sections, passages and sentence densities of long documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """1-based place of the first occurrence of the first pattern that occurs at all; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0)) for p in patterns))


def earliest(c: Column, patterns: Sequence[str]) -> Column:
    """1-based place of the earliest occurrence of any pattern; null if none occurs."""
    found = [F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0)) for p in patterns]
    return F.least(*found) if len(found) > 1 else found[0]


def sections(docs: DataFrame, keys: Sequence[str], text: str, patterns: dict[str, Sequence[str]], stops: Sequence[str]) -> DataFrame:
    """A row per document and section found: its text ends at the next section found, or at a stop within it."""
    found = F.array(*(F.struct(first_match(F.col(text), ps).alias("start"), F.lit(name).alias("section")) for name, ps in patterns.items()))
    rows = docs.select(*keys, F.col(text).alias("__t"), (earliest(F.col(text), stops) if stops else F.lit(None).cast("int")).alias("__stop"), F.array_sort(F.filter(found, lambda s: s["start"].isNotNull())).alias("__s"))
    rows = rows.select(*keys, "__t", "__stop", "__s", F.posexplode("__s").alias("__k", "__x"))
    after = F.coalesce(F.get("__s", F.col("__k") + 1)["start"], F.length("__t") + 1)
    end = F.when((F.col("__x.start") < F.col("__stop")) & (F.col("__stop") < after), F.col("__stop")).otherwise(after)
    return rows.select(*keys, F.col("__x.section").alias("section"), tx.strip(F.substring(F.col("__t"), F.col("__x.start"), end - F.col("__x.start"))).alias("text"))


def titled_sections(docs: DataFrame, keys: Sequence[str], markup: str, title: str = r"(?is)<title[^>]*>(.*?)</title>", least: int = 10) -> DataFrame:
    """Texts of the paragraphs under each title: tables go, paragraphs shorter than `least` go."""
    body = F.regexp_replace(F.col(markup), r"(?is)<table\b.*?</table>", "")
    parts = F.split(body, r"(?i)(?=<title)")
    rows = docs.select(*keys, F.posexplode(parts).alias("place", "__p"))
    plain = lambda x: tx.strip(tx.unescape(F.regexp_replace(x, r"<[^>]+>", "")))
    found = F.regexp_extract_all(F.col("__p"), F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|$)"), 1)
    kept = F.filter(F.transform(found, plain), lambda x: F.length(x) >= least)
    return rows.select(*keys, "place", plain(F.regexp_extract("__p", title, 1)).alias("title"), F.size(kept).alias("n_paragraphs"), F.array_join(kept, "\n").alias("text"))


@dataclass
class Lexicons:
    """What a sentence is scored with."""

    seeds: dict[str, str]  # term -> category
    governance: list[str] = field(default_factory=lambda: fixed.PASSAGE_GOVERNANCE)
    signal: list[str] = field(default_factory=lambda: fixed.PASSAGE_SIGNAL)
    generic: list[str] = field(default_factory=list)
    finance: list[str] = field(default_factory=lambda: fixed.PASSAGE_BOILERPLATE)


def paragraph_rows(docs: DataFrame, keys: Sequence[str], text: str, least: int = 30, most: int = 2000) -> DataFrame:
    return docs.select(*keys, F.posexplode(tx.paragraphs(tx.text_of(text), least, most)).alias("paragraph_id", "text"))


def category(found: Column, seeds: dict[str, str], both: str = "ESG") -> Column:
    """The category of the seeds found, if it is one and the same."""
    of = F.create_map(*(F.lit(x) for pair in seeds.items() for x in pair))
    kinds = F.array_distinct(F.transform(found, lambda s: F.try_element_at(of, s)))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(both)


def seed_passages(paragraphs: DataFrame, seeds: dict[str, str], least: int = 1) -> DataFrame:
    """Paragraphs with `least` different seeds or more, their seeds and category."""
    found = paragraphs.withColumn("matched_seeds", tx.matched(F.col("text"), [*seeds]))
    found = found.withColumn("seed_count", F.size("matched_seeds")).where(F.col("seed_count") >= least)
    return found.withColumn("esg_category", category(F.col("matched_seeds"), seeds))


def dense_enough(c: Column, lex: Lexicons, threshold: float = 0.25) -> Column:
    """Whether a passage stays: it holds a governance or signal term, or few enough boilerplate words."""
    return tx.has_any(c, lex.governance) | tx.has_any(c, lex.signal) | (tx.boilerplate_ratio(c, lex.finance) <= threshold)


def score_sentences(paragraphs: DataFrame, keys: Sequence[str], lex: Lexicons, pattern: str = tx.KOREAN_SENTENCE_END) -> DataFrame:
    """A row per sentence: hits of each kind, densities per 100 characters."""
    rows = paragraphs.select(*keys, F.col("text").alias("paragraph"), F.posexplode(tx.sentences(F.col("text"), pattern)).alias("pos", "sentence"))
    s = F.col("sentence")
    hits = {"esg_hit": [*{*lex.seeds, *lex.signal}], "g_hit": lex.governance, "generic_hit": lex.generic, "finance_hit": lex.finance}
    rows = rows.select("*", *(F.size(tx.matched(s, sorted(terms))).alias(k) for k, terms in hits.items()), F.length(s).alias("length"))
    per = lambda c: F.coalesce(F.try_divide(c * 100.0, F.col("length")), F.lit(0.0))
    named = {k.replace("_hit", "_density"): per(F.col(k)) for k in hits}
    return rows.select("*", (F.col("g_hit") > 0).alias("is_g_protected"), *(v.alias(k) for k, v in named.items()), per(F.col("esg_hit") + F.col("g_hit")).alias("signal_density"))


def density_filter(scored: DataFrame, keys: Sequence[str], window: int = 1, least: float = 0.0) -> DataFrame:
    """Paragraphs of their dense sentences and the `window` neighbours of each; a paragraph without any stays whole."""
    base = F.col("is_g_protected") | ((F.col("esg_hit") + F.col("g_hit") > 0) & (F.col("signal_density") >= least))
    near = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-window, window)
    rows = scored.withColumn("__keep", F.max(base.cast("int")).over(near) == 1)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("__keep"), F.struct("pos", "sentence")))), lambda x: x["sentence"])
    out = rows.groupBy(*keys).agg(F.first("paragraph").alias("__p"), F.count(F.lit(1)).alias("n_sentences"), F.sum(F.col("__keep").cast("bigint")).alias("n_kept"), kept.alias("__kept"))
    return out.select(*keys, "n_sentences", "n_kept", F.when((F.col("n_kept") > 0) & (F.col("n_sentences") > 1), F.array_join("__kept", " ")).otherwise(F.col("__p")).alias("text"))


def passage_features(scored: DataFrame, keys: Sequence[str], places: int = 4) -> DataFrame:
    """Nine scalars of a document's sentence scores."""
    count = lambda c: F.sum(c.cast("bigint"))
    dominant = (F.col("generic_density") > F.col("signal_density")).cast("double")
    mean = lambda k: F.round(F.avg(k), places).alias(f"mean_{k}")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"), count(F.col("g_hit") > 0).alias("n_g_sentences"), count(F.col("esg_hit") > 0).alias("n_esg_sentences"),
        mean("esg_density"), mean("g_density"), mean("generic_density"), mean("finance_density"),
        F.round(F.avg("esg_density") / F.greatest(F.avg("generic_density"), F.lit(0.001)), places).alias("esg_generic_ratio"), F.round(F.avg(dominant), places).alias("generic_dominant_share"),
    )


def joined(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "\n\n") -> DataFrame:
    """A document per key: its parts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_passages"), F.sum(F.length(text)).alias("total_chars"), F.array_join(F.transform(parts, lambda x: x["__text"]), sep).alias("document"))


def section_to_passages(docs: DataFrame, keys: Sequence[str], text: str, lex: Lexicons, least_seeds: int = 1, use_sentences: bool = True, use_density: bool = True, threshold: float = 0.25, window: int = 1, pattern: str = tx.KOREAN_SENTENCE_END) -> DataFrame:
    """Paragraphs, dense sentences of each, seeds, boilerplate density: the whole way from a section to its passages."""
    rows = paragraph_rows(docs, keys, text)
    if use_sentences:
        own = [*keys, "paragraph_id"]
        rows = density_filter(score_sentences(rows, own, lex, pattern), own, window).where(F.length("text") >= 20).select(*own, "text")
    rows = seed_passages(rows, lex.seeds, least_seeds)
    return rows.where(dense_enough(F.col("text"), lex, threshold)) if use_density else rows


BLANK_LINES = r"\n{2,}|(?:\r\n){2,}"


def blank_line_passages(docs: DataFrame, keys: Sequence[str], text: str, seeds: Sequence[str], least_seeds: int = 1, least: int = 20, shown: int = 5) -> DataFrame:
    """keys, passage_id, text, seed_count, seeds (the first `shown`, joined by a pipe) of passages between blank lines that are long enough and hold enough seeds."""
    pieces = F.transform(F.split(tx.text_of(text), BLANK_LINES), tx.strip)
    rows = docs.select(*keys, F.posexplode(pieces).alias("passage_id", "__t")).where(F.length("__t") >= least)
    found = rows.withColumn("__m", tx.matched(F.col("__t"), seeds)).where(F.size("__m") >= least_seeds)
    return found.select(*keys, "passage_id", F.col("__t").alias("text"), F.size("__m").alias("seed_count"), F.array_join(F.slice("__m", 1, shown), "|").alias("seeds"))


def passage_log(docs: DataFrame, keys: Sequence[str], sections_found: DataFrame, passages_found: DataFrame) -> DataFrame:
    """keys, n_sections, n_passages, has_passages of every document, also of those that have none."""
    counted = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    rows = docs.select(*keys).join(counted(sections_found, "n_sections"), [*keys], "left").join(counted(passages_found, "n_passages"), [*keys], "left").fillna(0, ["n_sections", "n_passages"])
    return rows.withColumn("has_passages", F.col("n_passages") > 0)


def failure(keys: Sequence[str], step: str, error: str) -> Column:
    """What a failed row leaves: its keys, the step and the error."""
    return F.struct(*(F.col(k) for k in keys), F.lit(step).alias("step"), F.lit(error).alias("error"))


def extract(docs: DataFrame, keys: Sequence[str], text: str, patterns: dict[str, Sequence[str]], stops: Sequence[str], seeds: dict[str, str], least_seeds: int = 1, preview: int = 5000) -> dict[str, DataFrame]:
    """The four outputs of the extraction stage, of one lineage: sections (text cut to `preview` characters, for reading only), passages, documents, failures.

    A document without text fails at `read`, without a section at `section`, without a passage at `passage`.
    """
    cut = sections(docs, keys, text, patterns, stops)
    found = seed_passages(paragraph_rows(cut, [*keys, "section"], "text"), seeds, least_seeds)
    log = passage_log(docs.select(*keys, tx.text_of(text).alias("__text")), keys, cut, found)
    read = docs.select(*keys, (tx.strip(tx.text_of(text)) == "").alias("__empty"))
    failed = F.when(F.col("__empty"), failure(keys, "read", "EMPTY")).when(F.col("n_sections") == 0, failure(keys, "section", "NO_SECTION")).when(F.col("n_passages") == 0, failure(keys, "passage", "NO_PASSAGE"))
    failures = log.join(read, [*keys]).select(failed.alias("__f")).where("__f is not null").select("__f.*")
    whole = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_passages"), F.sum(F.length("text")).alias("total_chars"))
    return {"sections": cut.withColumn("text", F.substring("text", 1, preview)), "passages": found, "documents": whole, "failures": failures}


#: Columns of stage_rows() beside output and the keys.
STAGE = {"section": "string", "paragraph_id": "int", "seed_count": "int", "esg_category": "string", "matched_seeds": "string", "text": "string", "n_passages": "int", "total_chars": "bigint", "step": "string", "error": "string"}


def stage_rows(docs: DataFrame, keys: Sequence[str], text: str, patterns: dict[str, Sequence[str]], stops: Sequence[str], seeds: dict[str, str], least_seeds: int = 1, preview: int = 5000, sep: str = "\n\n") -> DataFrame:
    """The four outputs of the extraction stage as one table: output (sections, passages, documents, failures), keys and the columns of STAGE.

    All of a document's rows are made within its own row, so texts are read once and nothing is joined or shuffled.
    Failures are those of extract(): read, section, passage. A section's text is cut to `preview` characters, for reading only.
    """
    t = F.col("__t")
    found = F.array(*(F.struct(first_match(t, ps).alias("start"), F.lit(name).alias("section")) for name, ps in patterns.items()))
    rows = docs.select(*keys, tx.text_of(text).alias("__t"))
    rows = rows.select(*keys, "__t", (earliest(t, stops) if stops else F.lit(None).cast("int")).alias("__stop"), F.array_sort(F.filter(found, lambda x: x["start"].isNotNull())).alias("__s"))
    after = lambda k: F.coalesce(F.get("__s", k + 1)["start"], F.length(t) + 1)
    end = lambda x, k: F.when((x["start"] < F.col("__stop")) & (F.col("__stop") < after(k)), F.col("__stop")).otherwise(after(k))
    cut = F.transform("__s", lambda x, k: F.struct(x["section"].alias("section"), tx.strip(F.substring(t, x["start"], end(x, k) - x["start"])).alias("text")))
    rows = rows.select(*keys, (tx.strip(t) == "").alias("__empty"), cut.alias("__cut"))
    pieces = lambda s: F.transform(tx.paragraphs(s["text"]), lambda x, i: F.struct(s["section"].alias("section"), i.alias("paragraph_id"), x.alias("text"), tx.matched(x, [*seeds]).alias("found")))
    rows = rows.withColumn("__p", F.filter(F.flatten(F.transform("__cut", pieces)), lambda x: F.size(x["found"]) >= least_seeds))

    def row(output: str, **own: Column) -> Column:
        return F.struct(F.lit(output).alias("output"), *(own[c].cast(kind).alias(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in STAGE.items()))

    sections_out = F.transform("__cut", lambda s: row("sections", section=s["section"], text=F.substring(s["text"], 1, preview), total_chars=F.length(s["text"])))
    passages_out = F.transform("__p", lambda x: row("passages", section=x["section"], paragraph_id=x["paragraph_id"], seed_count=F.size(x["found"]), esg_category=category(x["found"], seeds), matched_seeds=F.array_join(x["found"], "|"), text=x["text"]))
    joined_text = F.array_join(F.transform("__p", lambda x: x["text"]), sep)
    whole = row("documents", text=joined_text, n_passages=F.size("__p"), total_chars=F.length(joined_text))
    failed = lambda step, error: row("failures", step=F.lit(step), error=F.lit(error))
    last = F.when(F.col("__empty"), failed("read", "EMPTY")).when(F.size("__cut") == 0, failed("section", "NO_SECTION")).when(F.size("__p") == 0, failed("passage", "NO_PASSAGE")).otherwise(whole)
    return rows.select(*keys, F.explode(F.concat(sections_out, passages_out, F.array(last))).alias("__o")).select("__o.output", *keys, *(f"__o.{c}" for c in STAGE))


def run_stage(docs: DataFrame, path: str, keys: Sequence[str], *how: object, start: int = 0, end: int | None = None, append: bool = False, **more: object) -> DataFrame:
    """Writes stage_rows() under path, a folder per output, in one pass over the documents; the table that is there then.

    start, end: only these documents, in the order of their keys. append: adds to what is there and leaves out what is done,
    which is every document that left a row, but for those that failed at `read`; so a stopped run goes on. Keys aren't null.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if append and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(path).where(F.coalesce(F.col("step") != "read", F.lit(True))).select(*keys)
        docs = docs.join(done.distinct(), [*keys], "left_anti")
    if start or end is not None:
        docs = docs.orderBy(*keys).offset(start)
        docs = docs if end is None else docs.limit(end - start)
    stage_rows(docs, keys, *how, **more).write.partitionBy("output").mode("append" if append else "overwrite").parquet(path)
    return spark.read.parquet(path)


def text_pivot(rows: DataFrame, keys: Sequence[str], by: str, categories: Sequence[str], order: Sequence[str], text: str, sep: str = "\n\n") -> DataFrame:
    """keys, n_rows, and for each category, and `other` for the rest and for null, its texts in order, joined, and their characters.

    A key without a category has null text and no characters there. The rows of a key are one document's.
    """
    kind = F.when(F.col(by).isin([*categories]), F.col(by)).otherwise("other")
    rows = rows.withColumn("__kind", kind)
    out = [F.count(F.lit(1)).alias("n_rows")]
    for c in dict.fromkeys([*categories, "other"]):
        here = F.col("__kind") == c
        parts = F.array_sort(F.collect_list(F.when(here & F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("__text")))))
        out.append(F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["__text"]), sep)).alias(f"text_{c}"))
        out.append(F.coalesce(F.sum(F.when(here, F.length(text))), F.lit(0)).alias(f"chars_{c}"))
    return rows.groupBy(*keys).agg(*out)


def markup_sections(pages: DataFrame, keys: Sequence[str], markup: str, patterns: dict[str, Sequence[str]], stops: Sequence[str]) -> DataFrame:
    """Sections of marked-up pages: their text, cut where the patterns begin."""
    return sections(pages.select(*keys, tx.markup_to_text(tx.text_of(markup)).alias("__plain")), keys, "__plain", patterns, stops)


def dense_text(docs: DataFrame, keys: Sequence[str], text: str, lex: Lexicons, threshold: float = 0.25) -> DataFrame:
    """keys, document: the dense paragraphs of each document as one string; a document without any has no row."""
    rows = paragraph_rows(docs, keys, text).where(dense_enough(F.col("text"), lex, threshold))
    return joined(rows, keys, ["paragraph_id"], "text").select(*keys, "document")
