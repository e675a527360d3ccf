"""Audit of filters that overlap: what each removes, alone and after others, in every order.

Native: DataFrame functions only. Each document becomes a mask of the filters it fails. The last
filter fails texts that a smaller id has already: copies meet by the SHA-256 of their text, and what
has one text, part and pair of labels is one row with its count and its smallest id before it is
shuffled, so thousands of copies meet as a few rows. The masks of a part make at most 2 ** filters
cells with counts; all orders are then enumerated from the cells, whatever the number of documents.

Shapley value: a document with k failures is removed by each of its filters in 1 / k of the orders,
so a filter's removals over all orders are the sum of count * orders / k over the cells that fail it.

Defined results: a null text is empty; an empty text has too few words and fails neither ratio; a
null part is the empty string; a null id is never smaller nor larger than another, so such a row
fails nothing as a copy and makes nothing a copy; rows that share the smallest id of a text all pass;
a document is labelled if any row of its id in the labels is; a null id has no label; very long texts
are one row's words in memory; columns besides those named take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Null ids are dealt over so many groups where documents meet their labels.
SALTS = 256


def text_failures(text: Column, words: Column, min_words: int = 200, min_distinct_percent: int = 50, max_capitals_percent: int = 2, symbols: str = "[#$%&*|]") -> list[Column]:
    """Too few words, too few distinct ones, too many capitals, a symbol: one boolean column each."""
    n, kinds, chars = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint"), F.length(text).cast("bigint")
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", "")).cast("bigint")
    return [n < min_words, kinds * 100 < n * min_distinct_percent, capitals * 100 > chars * max_capitals_percent, text.rlike(symbols)]


def masks(docs: DataFrame, failures: Callable[[Column, Column], Sequence[Column]] = text_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, int]:
    """doc_id, part, digest of the text and mask of the failures of each document, and how many failures there are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    fails = failures(F.col("text"), F.col("words"))
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask")), len(fails)


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Equal rows of masks() as one with their count n, and with good and toxic of the labels."""
    any_of = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    joined = salted.join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").na.fill({"good": False, "toxic": False})
    return joined.groupBy("doc_id", "salt", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")).drop("salt")


def cells(rows: DataFrame, copy_bit: int) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents by mask, with the bit of copies set for those whose text a smaller id has."""
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    merged = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(known).alias("first"))
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == lowest, F.col("first.n")).otherwise(0)
    split = merged.withColumn("originals", originals).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("cell"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0)).alias(c)
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), of("good"), of("toxic")).where("n > 0")


def orders(counted: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters and every step of it, for each part of cells(): the counts of the audit."""
    k = len(letters)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    # the i-th order: digits of i in factorial base pick from the letters that are left
    rows = parts.withColumn("rest", F.lit(letters)).withColumn("filter_order", F.lit("")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))))
    for left in range(k, 0, -1):
        at = F.floor(F.col("i") / factorial(left - 1)) % left + 1
        rows = rows.withColumn("pick", F.col("rest").substr(at.cast("int"), F.lit(1)))
        rows = rows.withColumn("filter_order", F.concat("filter_order", "pick")).withColumn("rest", F.replace("rest", F.col("pick")))
    rows = rows.select("part", "filter_order", "cells", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = lambda x: sum((F.when(F.instr(x, c) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, c in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("before", bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1))).withColumn("own", bits(F.col("filter_order").substr(F.col("step"), F.lit(1))))
    fails = lambda m, bits: m.bitwiseAND(bits) != 0
    before, own, zero = F.col("before"), F.col("own"), F.lit(0).cast("bigint")

    def total(value: Callable[[Column], Column], test: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", zero, lambda a, c: a + F.when(test(c["mask"]), value(c)).otherwise(zero))

    removed = lambda m: fails(m, own) & ~fails(m, before)
    share = lambda c: c["n"] * (F.lit(factorial(k)) / F.bit_count(c["mask"])).cast("bigint")
    n = lambda c: c["n"]
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total(n, lambda m: ~fails(m, before) & ~fails(m, own)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m, own) & fails(m, before)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(share, lambda m: fails(m, own)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, failures: Callable[[Column, Column], Sequence[Column]] = text_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of these failures, lettered from A on, and of copies as the last letter.

    Returns part, filter_order, step and, for the filter of that step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley.
    """
    rows, k = masks(docs, failures, id_col, text_col, part_col)
    letters = "".join(chr(ord("A") + i) for i in range(k + 1))
    return orders(cells(labelled(rows, labels, id_col), 1 << k), letters)
