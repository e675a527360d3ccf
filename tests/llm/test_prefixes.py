"""Adaptive prefixes: what they save on words of very unlike frequency, and joins without a Bloom filter."""

import numpy as np
import pytest

from panelweave.llm import ngram_join

from .test_search import brute_components


def zipf_rows(n=900, seed=5):
    """Short documents: a word of their own, the rest from a vocabulary of Zipf frequencies; some near copies."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, 401)
    rows = []
    for i in range(n):
        words = [f"v{x}" for x in rng.choice(400, 30, replace=False, p=share / share.sum())]
        if i % 9 == 0 and i:
            words = rows[-1][1].split()[:-1] + ["other"]
        rows.append((i, " ".join([*words, f"own{i}"])))
    return rows


def candidates(spark, rows, words, percent):
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, 0)
    prefixes = join.prefixes()
    longer = prefixes.where("k > 1").select("fp").distinct().count()
    return longer, join.prefix_pairs(join.shared(prefixes), None, []).count()


def test_longer_prefixes_spare_candidates(spark, monkeypatch):
    rows = zipf_rows()
    longer, pairs = candidates(spark, rows, 1, 80)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    monkeypatch.setattr(ngram_join, "matches_for", lambda levels, probe, mean: 1)
    none, plain = candidates(spark, rows, 1, 80)
    assert none == 0 and longer > len(rows) // 3
    assert pairs < plain * 0.8
    assert got == {i: c for i, (_, c) in brute_components(rows, 1, 80).items()}
    assert got == {r["doc_id"]: r["component_id"] for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}


def test_matches_weigh_rows_against_candidates():
    level = lambda *docs: (8 * np.log2(1 + np.array(docs, float))).astype(np.uint8)
    assert ngram_join.matches_for(level(1, 1, 1, 1, 1), 2, 0.0) == 1  # nobody else has them
    assert ngram_join.matches_for(level(90, 90, 90, 90, 90, 90), 3, 0.0) == 1  # one passage: whoever has one has all
    assert ngram_join.matches_for(level(20, 40, 80, 100, 100, 110), 3, 0.0) > 1  # tokens of different documents
    assert ngram_join.matches_for(level(20, 40, 80, 60000, 60000, 60000), 3, 0.0) == 1  # the next token costs too many rows


@pytest.mark.parametrize("none_from", [0, 1])
def test_joins_where_no_filter_fits(spark, monkeypatch, none_from):
    rows = [(None if i % 50 == 7 else i, " ".join(f"w{i // 3}x{k}" for k in range(40)) + (f" tail{i}" if i % 3 else "")) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(ngram_join.components_of(table).collect(), key=str)
    calls, real = [], ngram_join.bloom

    def small(hashes, most_bits=1 << 27):
        calls.append(1)
        return None if len(calls) > none_from else real(hashes, most_bits)

    monkeypatch.setattr(ngram_join, "bloom", small)
    assert sorted(ngram_join.components_of(table).collect(), key=str) == want
    assert len(calls) >= 2
    monkeypatch.undo()
    keys = spark.range(1000).withColumnRenamed("id", "h")
    assert ngram_join.bloom(keys, 7999) is None and ngram_join.bloom(keys, 1 << 20) is not None


def group(n, words, most, seed, rare=()):
    """Copies of a text with up to `most` words dropped, added or changed; places of `rare` are changed in every 30th copy too."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{k}" for k in range(words)], []
    for i in range(n):
        own = list(base)
        for k in rare if i % 30 == 29 else ():
            own[k] = f"r{i}k{k}"
        for e in range(int(rng.integers(0, most + 1))):
            k = int(rng.integers(0, len(own)))
            own[k : k + int(rng.integers(0, 2))] = [] if i % 3 == 2 else [f"x{i}e{e}"]
        rows.append((i, " ".join(own)))
    return rows


def rows_of_joins(spark, after):
    """The most rows that a join of two sides by tokens or differences has made in executions after this one; and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, last, runs = 0, after, store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        last = max(last, run)
        if run <= after:
            continue
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and " < " in node.desc() and ("[token" in node.desc() or "[key" in node.desc()):
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(value.get().replace(",", "")))
    return most, last


@pytest.mark.parametrize("drop", [0, 60])
def test_a_group_of_near_copies_makes_few_rows(spark, drop):
    """The rare places part the levels of what all copies share, so that prefixes are longer than what copies differ in."""
    rows = group(700 - drop, 150, 6, 3, rare=(40,))
    _, before = rows_of_joins(spark, -1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert rows_of_joins(spark, before)[0] < 10 * len(rows)
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 90).items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 40), (2, 100)])
def test_nodes_of_a_frequent_token_meet_by_their_differences(spark, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "MANY", 1)
    sizes = [(1000 + i, " ".join(f"w{k}" for k in range(20 + 7 * i))) for i in range(40)]  # each holds the one before
    rows = [*group(60, 60, 12, 1), *((100 + i, t.replace("w", "z")) for i, t in group(60, 150, 9, 2)), *sizes]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, peelings=0).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, words, percent).items()}
