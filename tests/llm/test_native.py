"""Quality rules and mixing: brute force on small tables, and the defined edge cases."""

import re
from collections import Counter

import numpy as np

from panelweave.llm import mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, "clash") for i, t, s in rows], SCHEMA)


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_base(spark):
    long = " ".join(f"w{i % 700}é" for i in range(5000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "a b c d e f g h i j k\n\n x\x0by", None), (4, "a b c d e\na b c d e\n# $x", "a"), (5, long, "b"), (5, long, "b"), (None, "x " * 30, "c")]
    got = quality_rules.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        want = counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
    assert quality_rules.judge(docs(spark, rows).where("doc_id = 99")).count() == 0


def prose(i, n=120):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("w" + "".join(letters[((i * 37 + k * k) % 997) // 26**d % 26] for d in range(3)) for k in range(n))


JUNK = [lambda i: " ".join(x + "###" for x in prose(i).split()), lambda i: " | ".join(prose(i).split()), lambda i: " ".join(x + " " + x + " |" for x in prose(i, 60).split()), lambda i: " ".join(x + "***" for x in prose(i).upper().split())]


def test_quality_verdict(spark):
    rows = [(i, prose(i), "a") for i in range(200)] + [(1000 + i, JUNK[i % 4](i), "a") for i in range(40)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert all(r["kept"] == (i < 1000) and not r["base_failed"] for i, r in got.items())


def brute_em(patterns, strength=20.0, start=(0.9, 0.998, 0.15)):
    """p of each row of votes, by the textbook: responsibilities, then shares of right votes."""
    v = np.array(patterns)
    good, g, b = start[0], np.full(v.shape[1], start[1]), np.full(v.shape[1], start[2])
    for _ in range(50):
        p = brute_posterior(v, good, g, b)
        was = np.concatenate([[good], g, b])
        g = ((p[:, None] * (v == 1)).sum(0) + strength * start[1]) / ((p[:, None] * (v != 0)).sum(0) + strength)
        b = (((1 - p)[:, None] * (v == -1)).sum(0) + strength * start[2]) / (((1 - p)[:, None] * (v != 0)).sum(0) + strength)
        good = (p.sum() + start[0] * strength / 2) / (len(p) + strength / 2)
        if np.abs(np.concatenate([[good], g, b]) - was).max() < 1e-3:
            break
    return brute_posterior(v, good, g, b)


def brute_posterior(v, good, g, b):
    like_good = good * np.prod(np.where(v == 1, g, np.where(v == -1, 1 - g, 1.0)), axis=1)
    like_bad = (1 - good) * np.prod(np.where(v == 1, 1 - b, np.where(v == -1, b, 1.0)), axis=1)
    return like_good / (like_good + like_bad)


def test_quality_posterior_is_em(spark):
    rows = [(i, prose(i, 20 + 7 * (i % 31)), "a") for i in range(90)] + [(1000 + i, JUNK[i % 4](i), "a") for i in range(25)] + [(2000, None, None), (2001, "1 2 3", "a")]
    got = quality_rules.judge(docs(spark, rows)).collect()
    names = [f"vote_{k}" for k in quality_rules.rules()]
    want = brute_em([[r[k] for k in names] for r in got])
    assert np.allclose([r["p_good"] for r in got], want, atol=1e-6)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(most * sizes[s] for s in full)) / max(1e-9, sum(w[s] for s in names if s not in full))
        more = {s for s in names if s not in full and w[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (5 + i % 40), ["a", "b", "c", None, "é"][min(4, i % 11)]) for i in range(900)] + [(1000, None, "a"), (1001, "", "zero"), (7, "w " * 12, "é")]
    got = mixing.copies(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45 / 2 + 1e-6
    again = mixing.copies(docs(spark, rows).repartition(3)).collect()
    assert Counter((r["doc_id"], r["source"], r["copies"]) for r in got) == Counter((r["doc_id"], r["source"], r["copies"]) for r in again)


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "w " * 10, "a" if i < 50 else "b") for i in range(60)]
    table = docs(spark, rows)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert times == Counter({r["doc_id"]: r["copies"] for r in mixing.copies(table).collect() if r["copies"]})
    assert mixing.mix(table.where("doc_id < 0")).count() == 0
