"""Top-k search, n-gram join and the pipeline against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import ngram_join, top_k


def vectors(n, d, seed, groups=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 2] = rng.normal(size=(groups, d))[rng.integers(0, groups, n // 2)] + 0.01 * x[: n // 2]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_top(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.tolist().index(q)]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = [(int(i), int(v)) for i, v in zip(ids[keep][order], s[keep][order], strict=True)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dual_tree_is_exact(seed):
    x = np.floor(1024 * vectors(700, 8, seed))
    x[600:650] = x[600]  # ties
    ids = np.random.default_rng(seed).permutation(700)
    q = ids % 20 == 0
    search = top_k.Search(ids[q], x[q], 10)
    for a in range(0, 700, 256):
        search.add(ids[a : a + 256], x[a : a + 256])
    want = brute_top(ids, x, ids[q].tolist(), 10)
    for k, i in enumerate(ids[q].tolist()):
        m = search.query == k
        assert list(zip(search.found[m].tolist(), search.score[m].astype(int).tolist(), strict=True)) == want[i]


def test_cover_tree_covers():
    x = vectors(300, 4, 9)
    tree = top_k.CoverTree(x)
    points = tree.descendants()
    for n, own in enumerate(points):
        assert np.linalg.norm(x[own] - x[tree.point[n]], axis=1).max() <= tree.radius[n] + 1e-9
    assert sorted(points[0].tolist()) == list(range(300))


def test_huge_components_end(spark):
    x = np.array([[1e200, 0.0], [-1e200, 1.0], [1.0, 1e308], [1.0, -1e308], [2.0, 3.0]])
    tree = top_k.CoverTree(x)
    assert sorted(tree.point[tree.leaf].tolist()) == [0, 1, 2, 3, 4]


def test_top_k_edges(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (6, [0.25], 1), (7, [], 1), (1, [0.5, 0.25], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in top_k.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 512 * 512 + 512 * 256), (0, 2, 1, 512 * 512 + 512 * 256), (0, 3, 6, 512 * 256), (0, 4, 7, 0)]
    assert top_k.top_k(table.where("vec_id = 2"), F.lit(True)).count() == 0
    many = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors(120, 6, 3))], "vec_id long, embedding array<float>")
    blocks = sorted(map(tuple, top_k.top_k(many, F.col("vec_id") % 7 == 0, query_block=4, block=32).collect()))
    assert blocks == sorted(map(tuple, top_k.top_k(many, F.col("vec_id") % 7 == 0).collect()))


def brute_components(docs, words, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets, of = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        of[i] = i
    def find(i):
        while of[i] != i:
            i = of[i]
        return i
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=6, each=25):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        words = [f"w{k}" for k in rng.integers(0, 4000, 150)]
        for _ in range(each):
            own = list(words)
            for k in rng.integers(0, len(own), rng.integers(0, 7)):
                own[k] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 40)])
def test_join_is_exact(spark, words, percent):
    docs = [*near_copies(1), (2010, "a b"), (2011, "b c d"), (2012, "d e"), (2000, None), (2001, ""), (2002, " \n"), (2003, "Two words"), (2004, "two  WORDS"), (2005, "a b c d e f g h i j"), (2006, "A B C D E F G H I J k")]
    table = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_of(table, words, percent).collect()}
    assert got == brute_components(docs, words, percent)


def test_join_of_a_large_group(spark):
    """600 near copies of a text, beside 600 texts that mostly consist of one passage, which half of all documents hold."""
    rng = np.random.default_rng(4)
    base, passage = [f"w{k}" for k in rng.integers(0, 4000, 120)], [f"p{k}" for k in range(60)]
    docs = []
    for i in range(1200):
        if i % 2:
            own = list(base)
            for k in rng.integers(0, len(own), i % 5):
                own[k] = f"x{i}k{k}"
        else:
            own = passage + [f"y{i}k{k}" for k in range(2 + i % 40)]
        docs.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_of(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_components(docs, 3, 90)


def test_join_edges(spark):
    table = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.components_of(table).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7)]
    assert sorted(r["doc_id"] for r in ngram_join.distinct_documents(table).collect()) == [5, 7]
    assert ngram_join.components_of(table.where("doc_id = 9")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["comp"] for r in ngram_join.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        w = [f"w{k}" for k in rng.integers(0, 3000, 80)]
        if i % 6 == 0:
            w[10:10] = ["you", "idiot", "moron", "scum"]
        shared = "\nthis is a licence line that everyone repeats" if i % 2 else ""
        rows.append((i, " ".join(w) + shared, "en", f"s{i % 3}", 0))
    rows += [(200, rows[1][1], "en", "s1", 0), (201, None, "en", None, 0), (202, "", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(0, 120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, table = table, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, table)
    ids = lambda t: {r["doc_id"] for r in t.collect()}
    assert ids(seen["toxicity"][1]) == {r[0] for r in rows if r[0] >= 120 or r[0] % 6}
    kept = {r["doc_id"]: r["text"] for r in seen["line dedup"][1].collect()}
    assert sum("licence" in (t or "") for t in kept.values()) == 1 and {201, 202} <= kept.keys()
    assert 200 not in ids(seen["n-gram Jaccard join"][1]) and 1 in ids(seen["n-gram Jaccard join"][1])
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == table_columns()
    packed = seen["best-fit packing"][1].collect()
    assert {r["doc_id"] for r in packed} == ids(seen["mixing sources to target weights"][1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def table_columns():
    return ["doc_id", "text", "lang", "source", "n_chars"]
