"""Ranks in ranges and replicates against plain Python: ties, nulls, NaN, a group as large as all others together."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import draws as fast
from panelweave.operators import rank_stats


def mean_ranks(values):
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values))
    v = np.asarray(values)[order]
    i = 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] == v[i]:
            j += 1
        out[order[i:j]] = (i + 1 + j) / 2
        i = j
    return out


def rho(x, y):
    a, b = mean_ranks(x), mean_ranks(y)
    return None if a.std() < 1e-12 or b.std() < 1e-12 else float(np.corrcoef(a, b)[0, 1])


def panel(seed=0, n=900):
    rng = np.random.default_rng(seed)
    group = rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1])
    x = np.round(rng.normal(size=n), 1) * (rng.random(n) > 0.3)
    return [(i, None if g is None else str(g), float(a), float(a + e)) for i, (g, a, e) in enumerate(zip(group, x, np.round(rng.normal(size=n), 1), strict=True))]


def test_value_ranks_in_ranges(spark):
    """Whatever the number of ranges, the ranks are the same; no range holds more than its share of the values."""
    rows = panel()
    counted = rank_stats.written(spark.createDataFrame(rows, "i int, g string, x double, y double").groupBy("g", "y").agg(F.count(F.lit(1)).alias("n")), "t")
    got = {(r["g"], r["y"]): (r["rank"], r["all"]) for r in rank_stats.value_ranks(counted, "y", ["g"]).collect()}
    for g in ("a", "b", None):
        y = [r[3] for r in rows if r[1] == g]
        for v, r in zip(y, mean_ranks(y), strict=True):
            assert got[g, v] == (r, len(y))


def test_spearman(spark):
    rows = panel(1)
    got = {r["g"]: (r["n"], r["rho"]) for r in rank_stats.spearman(spark.createDataFrame([*rows, (10_000, "a", None, 1.0), (10_001, "c", 1.0, 2.0)], "i int, g string, x double, y double"), ["g"], places=10).collect()}
    assert got["c"] == (1, None)
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g]
        assert got[g][0] == len(own) and abs(got[g][1] - rho([r[2] for r in own], [r[3] for r in own])) < 1e-9
    flat = spark.createDataFrame([(float(i), 0.1) for i in range(50)], "x double, y double")
    assert [tuple(r) for r in rank_stats.spearman(flat, []).collect()] == [(50, None)]
    assert rank_stats.spearman(flat.withColumn("g", F.lit("a")).where("x < 0"), ["g"]).count() == 0
    assert [tuple(r) for r in rank_stats.spearman(flat.where("x < 0"), []).collect()] == [(0, None)]


def test_numbering(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else i * 31 % 1009, i % 3) for i in range(500)], "k int, g int")
    for g, ks in _by(rank_stats.numbered(rows, ["k"], ["g"]).collect()).items():
        assert sorted(i for i, _ in ks) == list(range(len(ks)))
        in_order = [k for _, k in sorted(ks)]
        assert in_order == sorted(in_order, key=lambda k: (k is not None, k or 0)), g


def _by(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["g"]].append((r["i"], r["k"]))
    return out


def test_a_skewed_group_is_spread(spark):
    """A million rows of one group, half of them of one value: no task of the ranking reads more than a small part of the values."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double")).alias("x"))
    counted = rank_stats.written(rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")), "t")
    cut = rank_stats.in_ranges(counted, "x", ["g"]).groupBy("range").agg(F.count(F.lit(1)).alias("k")).collect()
    assert len(cut) == rank_stats.RANGES and max(r["k"] for r in cut) < 10 * n / 2 / rank_stats.RANGES
    got = rank_stats.value_ranks(counted, "x", ["g"]).agg(F.min("rank"), F.max("rank"), F.sum(F.col("rank") * F.col("n")), F.count(F.lit(1))).first()
    assert got[0] == (n / 2 + 1) / 2 and got[1] == n and abs(got[2] - n * (n + 1) / 2) < 1 and got[3] == n / 2 + 1


def draws(n, b, *group):
    return [int(hashlib.md5("|".join(map(str, (*group, b, s))).encode()).hexdigest()[:8], 16) % n for s in range(n)]


def test_bootstrap_draws(spark):
    rows = [r for r in panel(2, 200) if r[1] is not None]
    got = {(r["g"], r["b"]): r["rho"] for r in rank_stats.bootstrap_rhos(spark.createDataFrame(rows, "i int, g string, x double, y double"), 7, ["i"], ["g"]).collect()}
    assert len(got) == 14
    for (g, b), value in got.items():
        own = [r for r in rows if r[1] == g]
        picked = [own[i] for i in draws(len(own), b, g)]
        assert abs(value - rho([r[2] for r in picked], [r[3] for r in picked])) < 1e-9


@pytest.mark.parametrize("limit", [10**6, 10])
def test_permutations_and_subsamples(spark, monkeypatch, limit):
    """The same places whether the panel is broadcast or dealt."""
    monkeypatch.setattr(rank_stats, "PANEL_ROWS", limit)
    rows = [(i, x, y) for i, _, x, y in panel(3, 120)]
    frame = spark.createDataFrame(rows, "i int, x double, y double")
    place = lambda b: sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{b}|{i}".encode()).hexdigest(), i))
    for r in rank_stats.permuted_rhos(frame, 5, ["i"]).collect():
        order = place(r["b"])
        assert abs(r["rho"] - rho([rows[k][1] for k in range(len(rows))], [rows[i][2] for i in order])) < 1e-9
    got = {(r["size"], r["b"]): r["rho"] for r in rank_stats.subsample_rhos(frame, 3, [20, 50], ["i"]).collect()}
    assert len(got) == 6
    for (size, b), value in got.items():
        kept = [rows[i] for i in place(b)[:size]]
        assert abs(value - rho([r[1] for r in kept], [r[2] for r in kept])) < 1e-9


def test_md5_of_many():
    for start, stop in ((0, 1100), (99_990, 100_010), (2**32 - 3, 2**32 + 3)):
        for prefix in ("", "g_ratio|12|", "x" * 60):
            digests = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest() for i in range(start, stop)]
            assert ["".join(f"{w:08x}" for w in words) for words in fast.md5_of(prefix, start, stop).T] == digests
            assert fast.drawn(prefix, start, stop, 977).tolist() == [int(d[:8], 16) % 977 for d in digests]


@pytest.mark.parametrize("limit", [10**6, 10])
def test_draws_of_a_large_panel_are_those_of_a_small_one(spark, monkeypatch, limit):
    """Packed with their replicates or joined to the draws: the same results, and a null group has none."""
    monkeypatch.setattr(rank_stats, "PANEL_ROWS", limit)
    rows = [(*r[:3], float(r[3])) for r in panel(4, 150)] + [(1000 + i, None, float(i), float(i % 5)) for i in range(9)]
    frame = spark.createDataFrame(rows, "i int, g string, x double, y double")
    got = rank_stats.bootstrap_rhos(frame, 4, ["i"], ["g"]).collect()
    assert {r["g"] for r in got} == {r[1] for r in rows if r[1] is not None} and len(got) == 4 * len({r["g"] for r in got})
    for r in got:
        own = [x for x in rows if x[1] == r["g"]]
        picked = [own[i] for i in draws(len(own), r["b"], r["g"])]
        assert r["n"] == len(own) and abs(r["rho"] - rho([x[2] for x in picked], [x[3] for x in picked])) < 1e-9
    for r in rank_stats.bootstrap_slopes(frame, 3, ["i"], "y", "x").collect():
        picked = [rows[i] for i in draws(len(rows), r["b"])]
        assert abs(r["slope"] - np.polyfit([x[2] for x in picked], [x[3] for x in picked], 1)[0]) < 1e-9


def test_replicates_move_no_draws(spark):
    """A panel of 20,000 rows with 400 replicates (8 million draws): what is shuffled are packed copies of the panel, no join to draws."""
    frame = spark.range(20_000).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), F.pmod(F.col("id"), F.lit(4)).cast("double").alias("y"))
    for got in (rank_stats.bootstrap_rhos(frame, 400, ["i"]), rank_stats.permuted_rhos(frame, 400, ["i"]), rank_stats.bootstrap_slopes(frame, 400, ["i"], "y", "x")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
        assert got.count() == 400


def test_mann_whitney_and_kruskal(spark):
    rng = np.random.default_rng(5)
    x, cls = np.round(rng.normal(size=300), 1), rng.integers(0, 3, 300)
    high = spark.createDataFrame([(float(a), bool(c == 0)) for a, c in zip(x, cls, strict=True)], "x double, high boolean")
    r = rank_stats.mann_whitney(high, []).first()
    a, b = x[cls == 0], x[cls != 0]
    u = sum((v > w) + 0.5 * (v == w) for v in a for w in b)
    assert r["u"] == round(u, 1) and r["n_high"] == len(a) and abs(r["rank_biserial"] - (1 - 2 * u / (len(a) * len(b)))) < 1e-6
    ranks, n = mean_ranks(x), 300
    h = 12 / (n * (n + 1)) * sum(ranks[cls == k].sum() ** 2 / (cls == k).sum() for k in range(3)) - 3 * (n + 1)
    h /= 1 - sum(t**3 - t for t in Counter(x.tolist()).values()) / (n**3 - n)
    got = rank_stats.kruskal_wallis(spark.createDataFrame([(float(v), int(c)) for v, c in zip(x, cls, strict=True)], "x double, cls int"), []).first()
    assert (got["n"], got["k"]) == (300, 3) and abs(got["h"] - h) < 1e-3


def test_intervals(spark):
    rhos = spark.createDataFrame([("a", b, 0.2 + b / 1000) for b in range(100)] + [("b", b, b / 100 - 0.5) for b in range(100)], "g string, b int, rho double")
    got = {r["g"]: r for r in rank_stats.interval(rhos, group=["g"]).collect()}
    assert got["a"]["ci_excludes_zero"] and not got["b"]["ci_excludes_zero"] and got["a"]["n_boot"] == 100
    beside = rank_stats.with_interval(spark.createDataFrame([("a", 5, 0.3), ("z", 5, None)], "g string, n int, rho double"), rank_stats.interval(rhos, group=["g"]), ["g"])
    assert {r["g"]: (r["effect"], r["ci_lo"]) for r in beside.collect()} == {"a": ("moderate", got["a"]["ci_lo"]), "z": (None, None)}


def test_rank_line(spark):
    rows = [(x, y) for _, _, x, y in panel(6, 150)]
    a, b = mean_ranks([r[0] for r in rows]), mean_ranks([r[1] for r in rows])
    got = rank_stats.rank_line(spark.createDataFrame(rows, "x double, y double")).first()
    assert np.allclose([got["slope"], got["intercept"]], np.polyfit(a, b, 1))
