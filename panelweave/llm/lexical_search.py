"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings partitioned by term.

What a term adds to a document's score depends on the two alone, so a posting holds it as one integer,
its impact. Postings are dealt by ranges of (term, impact from the highest down): a list is whole files
or part of one, a list as long as the corpus is many, and a directory names the part of a list that
each file holds. The lists of an item are those of its terms, m of them.

1. Heads: the first `heads` entries of every list. Their sums are lower bounds of scores, the k-th of an item is its bound.
2. Uniform threshold: bound / m. Every list gives all its entries of that impact or more: what no list gives is below
   the bound in sum. A document's sum so far, and for each list that has not given it what that list can add at most
   (under the threshold, and no more than the list's highest), bound its score from both sides; the k-th lower bound
   is the new bound, and documents that can't reach it go.
3. Lookup: the exact scores of those left, from their entries in all lists of the item.

Nothing is dropped: heads, thresholds and bounds only decide what needn't be fetched. The driver holds three numbers.

Defined results: a null, empty or term-less text has no terms: as a document it takes no part, as an
item it has no results; every row is a document or an item of its own, also where rows share an id
or a text; of equal scores and ids any comes first, null ids last; a document is one row of terms in memory;
other columns take no part; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: What lies between terms.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No term: its posting carries a document's length.
ALL = ""
#: Tables of items' terms and of weights are broadcast up to so many rows, of under 100 bytes each; longer ones are joined by key.
BROADCAST_ROWS = 200_000
#: Each list is dealt over so many tasks where it meets a table too long to be broadcast.
SALTS = 32


def terms(text: Column) -> Column:
    # split, for extracting each match copies the text for it
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number of the row), item_id, term: each term of an item once. Written, for the numbers have to last."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.array_distinct(terms(F.col(text_col))).alias("terms"))
    return materialize(rows.select("item", "item_id", F.explode("terms").alias("term")), "item_terms")


def term_counts(docs: DataFrame, wanted: DataFrame, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n, term, tf: how often each document has each wanted term, and n, all its terms. A posting of ALL names every document."""
    vocabulary = wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([(ALL,)], "term string")).distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("terms")).where(F.size("terms") > 0)
    found = rows.select("row", "doc_id", F.size("terms").cast("bigint").alias("n"), F.explode(F.array_append("terms", F.lit(ALL))).alias("term"))
    counted = lambda x: x.groupBy("row", "doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    if small:  # what no item asks for goes before it is shuffled
        return materialize(counted(found.join(F.broadcast(vocabulary), "term", "left_semi")), "term_counts")
    return materialize(counted(found).join(vocabulary, "term", "left_semi"), "term_counts")


def postings(counts: DataFrame, small: bool) -> DataFrame:
    """place, file, term, row, doc_id, impact: lists from the highest impact down; place counts within a file."""
    n_docs, n_terms = counts.where(F.col("term") == ALL).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.where(F.col("term") != ALL)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("term", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1))).cast("bigint").alias("weight"))
    size = f"(10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    impact = F.expr(f"weight * ((1000000000L * tf) div (1000 * tf + 8 * {size}))")
    rows = held.join(F.broadcast(weights) if small else weights, "term").select("term", "row", "doc_id", impact.alias("impact")).where("impact > 0")
    ordered = rows.repartitionByRange("term", F.desc("impact"), "row").sortWithinPartitions("term", F.desc("impact"), "row")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("place"), "term", "row", "doc_id", "impact"), "postings").withColumn("file", F.shiftright("place", 33))


def directory(lists: DataFrame) -> DataFrame:
    """term, file, first, before, top: where a file's part of a list begins, how many entries come before it, the list's highest impact."""
    parts = lists.groupBy("term", "file").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))
    by_file = Window.partitionBy("term").orderBy("file")
    before = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("term", "file", "first", before.alias("before"), F.max("most").over(Window.partitionBy("term")).alias("top"))


def _met(lists: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Entries of lists beside each item that wants the list."""
    if small:
        return lists.join(F.broadcast(wanted), "term")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lists.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def _kth(sums: DataFrame, k: int, score: str) -> DataFrame:
    """item, bound: the k-th highest of an item's scores, 0 where it has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    best = sums.select("item", score, place.alias("place")).where(F.col("place") <= k)
    return best.groupBy("item").agg(F.coalesce(F.max(F.when(F.col("place") == k, F.col(score))), F.lit(0)).cast("bigint").alias("bound"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, heads: int = 1000, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item, equal scores by ascending id."""
    asked = item_terms(items, item_id, item_text)
    small = asked.count() <= broadcast_rows
    counts = term_counts(docs, asked, small, doc_id, doc_text)
    lists = postings(counts, small)
    drop_table(counts)
    parts = directory(lists)
    tops = parts.groupBy("term").agg(F.max("top").alias("top"))
    # lists that exist, with their number per item
    wanted = asked.join(tops, "term")
    wanted = materialize(wanted.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item"))), "wanted")

    opening = parts.where(F.col("before") < heads).select("term", "file", (F.col("first") + heads - F.col("before")).alias("end"))
    fetched = lists.join(opening, ["term", "file"]).where(F.col("place") < F.col("end"))
    sums = _met(fetched, wanted.select("item", "term"), small).groupBy("item", "row").agg(F.sum("impact").alias("low"))
    first_bound = materialize(_kth(sums, k, "low"), "first_bound")

    # the least integer no less than bound / m, and what a list that gives nothing of a document can add to it at most
    ask = wanted.join(first_bound, "item").withColumn("least", F.expr("(bound + m - 1) div m")).withColumn("rest", F.greatest(F.least(F.col("least") - 1, "top"), F.lit(0)))
    ask = materialize(ask.select("item", "term", "bound", "least", "rest", "top"), "asked")
    each = ask.groupBy("item").agg(F.max("bound").alias("bound"), F.sum("rest").alias("all_rest"))
    # a list gives an entry once, to where the sums of its document are made, and there it meets all items that ask for it
    lowest = ask.where("top >= least").groupBy("term").agg(F.min("least").alias("lowest"))
    given = _met(lists.select("term", "row", "impact"), lowest, small).where("impact >= lowest").select("term", "row", "impact")
    given = given.repartition("row") if small else given
    given = _met(given, ask.select("item", "term", "least", "rest"), small).where("impact >= least")
    sums = given.groupBy("item", "row").agg(F.sum("impact").alias("low"), F.sum(F.col("impact") - F.col("rest")).alias("over")).join(F.broadcast(each) if small else each, "item")
    sums = materialize(sums.withColumn("high", F.col("all_rest") + F.col("over")).where("high >= bound").select("item", "row", "low", "high"), "bounded")

    second_bound = _kth(sums, k, "low")
    left = sums.join(F.broadcast(second_bound) if small else second_bound, "item").where("high >= bound").select("item", "row")
    exact = lists.select("row", "doc_id", "term", "impact").join(left, "row").join(wanted.select("item", "item_id", "term"), ["item", "term"])
    exact = exact.groupBy("item", "item_id", "row", "doc_id").agg(F.sum("impact").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return exact.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
