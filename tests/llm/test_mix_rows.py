"""mix() on rows that share their id and source: each row gets copies of its own."""

from collections import Counter

from pyspark.sql import functions as F

from panelweave.llm import mixing


def test_rows_without_ids_reach_their_target(spark):
    rows = [(None if i % 2 else 7, f"t{i} " + "w " * 9, "a") for i in range(60)] + [(100 + i, "w " * 10, "b") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.4, 1.5):
        targets = {r["source"]: r["target"] for r in mixing.copies(table, share=share).collect()}
        mixed = mixing.mix(table, share=share).collect()
        taken = Counter(r["source"] for r in mixed)
        assert all(abs(10 * taken[s] - targets[s]) <= 5 + 1e-6 for s in "ab")
        assert {tuple(r) for r in mixed} <= set(rows)


def test_rows_without_ids_dont_meet_in_one_group(spark, monkeypatch):
    met = []
    write = mixing.materialize

    def watched(df, name):
        out = write(df, name)
        if name == "folded":
            met.append(out.agg(F.max(F.size("r.done"))).first()[0] or 0)
        return out

    monkeypatch.setattr(mixing, "materialize", watched)
    table = spark.range(20000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("a").alias("source"))
    table = table.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("b").alias("source")))
    got = mixing.copies(table, share=0.4)
    sums = {r["source"]: (r["n"], r["taken"], r["target"]) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()}
    assert sums["a"][0] == 20000 and sums["b"][0] == 3000
    assert all(abs(taken - target) <= 1.5 + 1e-6 for _, taken, target in sums.values())
    assert max(met) <= 2 * 48


def test_last_document_is_short(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.floor(F.pow(2.0, 2 + F.pmod(F.xxhash64("id"), F.lit(900)) / 100)).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 8).alias("source"))
    got = mixing.copies(table, share=0.7).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 0.001 * r["target"] for r in got.collect())
