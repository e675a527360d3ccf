"""Lexical search against brute force: thresholds that act, ties, nulls, rows that share ids, both kinds of joins."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = Counter()
    for item, text in items:
        found = []
        for row, (i, bag) in enumerate(bags):
            tf, m = Counter(bag), 10 + (90 * len(bag) * big_n) // max(big_l, 1)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, row, i))
        out.update((item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1))
    return out


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{int(k)}" for k in rng.zipf(1.3, n * 30) % 500]
    docs = [(int(i), " ".join(words[j * 30 : j * 30 + int(rng.integers(1, 30))])) for j, i in enumerate(rng.permutation(n))]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (None, "w1 w2"), (600, None), (601, ""), (602, " .,;\n"), (603, "Ünï-W1 w2 W1.w1"), (604, "w3 " * 5000)]
    items = [(7, docs[3][1]), (8, "w1 W1 w2, w3"), (8, "w4 w400"), (None, "w1 w9"), (9, None), (10, "nowhere"), (11, ""), (12, "ünï w2 w2")]
    return docs, items + [(20 + j, docs[j][1]) for j in range(20)]


@pytest.mark.parametrize(("heads", "broadcast_rows"), [(1000, 10**6), (10, 10**6), (12, 0)])
def test_search_is_exact(spark, heads, broadcast_rows):
    docs, items = corpus(heads)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, term string").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical_search.search(table, asked, heads=heads, broadcast_rows=broadcast_rows)
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_lists_and_heads(spark):
    """Lists run from the highest impact down over files in order, and the directory places each file's part."""
    docs, items = corpus(1)
    asked = lexical_search.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    lists = lexical_search.postings(lexical_search.term_counts(spark.createDataFrame(docs, "doc_id long, text string"), asked, True), True)
    rows = lists.orderBy("place").collect()
    assert [(r["term"], -r["impact"]) for r in rows] == sorted((r["term"], -r["impact"]) for r in rows)
    seen = Counter()
    parts = {(r["term"], r["file"]): r for r in lexical_search.directory(lists).collect()}
    for r in rows:
        part = parts[r["term"], r["file"]]
        assert part["before"] + r["place"] - part["first"] == seen[r["term"]]
        seen[r["term"]] += 1


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical_search.search(docs.where(F.lit(False)), items).count() == 0
    assert lexical_search.search(docs, items.where(F.lit(False))).count() == 0
    assert lexical_search.search(docs.where("doc_id = 2"), items).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1)]
