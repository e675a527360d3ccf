"""The pipeline's line and n-gram stages on passages that few documents share."""

import corpus_pipeline


def words(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_passages_of_a_few_documents(spark):
    shared = words("s")
    rows = [(i, f"{words(i)}\n{shared}") for i in range(3)] + [(10, "\n".join(words(f"a{j}") for j in range(6)))]
    rows += [(11, rows[-1][1].replace("wa3x9 ", "other ")), (12, "short line\n" + words(12)), (13, "short line\n" + words(13))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies):
        table = stage(spark, table, "").localCheckpoint()
    got = {r["doc_id"]: r["text"] for r in table.collect()}
    want = dict(rows) | {1: words(1), 2: words(2)}
    del want[11]
    assert got == want
