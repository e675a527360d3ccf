"""Null and repeated ids: each row counts for itself."""

from collections import Counter

from panelweave.llm import ngram_join


def words(k, n=20):
    return " ".join(f"w{k}x{i}" for i in range(n))


def left(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter((r["doc_id"], r["text"]) for r in ngram_join.distinct_documents(table).collect())


def test_null_ids_with_different_texts(spark):
    rows = [(1, words(0)), (None, words(0) + " more"), (None, words(1)), (None, words(2)), (None, words(2)), (None, ""), (None, None), (3, None)]
    want = Counter([(1, words(0)), (None, words(1)), (None, words(2)), (None, ""), (None, None), (3, None)])
    assert left(spark, rows) == want


def test_one_null_id_beside_blank_ones(spark):
    assert left(spark, [(1, words(0)), (None, words(0)), (None, " "), (2, words(1))]) == Counter([(1, words(0)), (None, " "), (2, words(1))])


def test_shared_ids_with_different_texts(spark):
    rows = [(1, words(0)), (5, words(0)), (5, words(1)), (5, words(2)), (6, words(2)), (6, words(3)), (7, words(4)), (7, words(4))]
    want = Counter([(1, words(0)), (5, words(1)), (5, words(2)), (6, words(3)), (7, words(4))])
    assert left(spark, rows) == want


def moved(spark):
    """Rows that the last execution has shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    nodes, values, total = store.planGraph(last).allNodes(), store.executionMetrics(last), 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
            value = values.get(metric.accumulatorId())
            if metric.name() == "shuffle records written" and value.isDefined():
                total += int(value.get().replace(",", ""))
    return total


def test_texts_that_stay_are_not_moved(spark):
    """The ids that go are too many to be broadcast: yet only rows that may go are joined with them."""
    rows = [(k, words(k % 1900)) for k in range(2000)]
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = ngram_join.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()).collect()
        assert sorted(r["doc_id"] for r in got) == [*range(1900)]
        assert moved(spark) < 500
    finally:
        spark.conf.set(key, was)


def test_without_a_filter(spark):
    docs, gone = spark.createDataFrame([(f"d{k}", k) for k in range(300)], "id string, k long"), spark.createDataFrame([(f"d{k}",) for k in range(0, 400, 3)], "__gone string")
    for bits in (1 << 27, 0):
        got = ngram_join.without(docs, "id", gone, bits)
        assert sorted(r["k"] for r in got.collect()) == [k for k in range(300) if k % 3] and got.schema == docs.schema
    assert ngram_join.without(docs, "id", gone.limit(0)).count() == 300
