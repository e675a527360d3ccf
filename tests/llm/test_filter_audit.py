"""Filter audit against running every order of the filters over the documents."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from panelweave.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, "x y z", "a"), (5, None, None), (6, "", ""), (7, "Ab # c", "b"), (8, "w " * 300, "b"), (9, LONG.upper(), None), (9, LONG, "a"), (2, LONG, "b"),
    (None, LONG, "a"), (None, "x y z", "b"), (10, LONG + " $5", "a"), (11, "Z" + LONG, "b"), (0, "only once", "a"), (0, "only once", "a"), (12, "é" * 100_000 + " A", "a"), (13, "x y z", "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (8, 0, 1), (9, None, 1), (13, 1, None), (None, 1, 1), (99, 1, 1)]


def brute(docs, labels):
    rows = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lower = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": lower}
        mark = [any(x[0] == i is not None and x[c] == 1 for x in labels) for c in (1, 2)]
        rows.append((part or "", {k for k, v in fails.items() if v}, *mark))
    out = Counter()
    for part in {r[0] for r in rows}:
        own, shapley, found = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = [r for r in own if r not in left]
                removed_before = len(own) - len(left)
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                assert removed_before >= redundant and before is not None
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out.update((*x[:-1], shapley[x[-1]]) for x in found)
    return out


def test_every_order(spark):
    docs = spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, source string, part string, mask int").repartition(3)
    labels = spark.createDataFrame([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(map(tuple, got.collect())) == brute(DOCS, LABELS)


def test_other_filters(spark):
    """Two filters of one's own make three letters and six orders."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a b"), (4, "b")], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, lambda text, words: [text.contains("a"), F.size(words) > 1])
    rows = {(r["filter_order"], r["step"]): r for r in got.collect()}
    assert len(rows) == 18 and {len(o) for o, _ in rows} == {3}
    assert rows["ABC", 1]["removed"] == 3 and rows["ABC", 1]["kept"] == 1 and rows["CBA", 1]["removed"] == 1
    assert rows["ABC", 1]["shapley"] == 6 + 3 + 2 and rows["BAC", 1]["shapley"] == 3 + 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_native(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    plan = filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
