"""Collecting, the extraction stage, tokenizers by name, pivots, nearest vectors, the evaluation report."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import text as tx
from panelweave.operators import evaluate, features, passages, tokenizers, tokens
from panelweave.sources import collect, tables

LONG = "a paragraph that speaks of seed matters at some length"
TEXTS = [(1, f"intro\n# A\n{LONG} one\n{LONG} two\n# B\nnothing in this paragraph is of any interest"), (2, None), (3, "no section in here, only words"), (4, "# A\nnothing in this paragraph is of any interest"), (5, " \n"), (6, f"# B\n{LONG}\n# A\n{LONG} three")]
HOW = ("text", {"a": ["# A"], "b": ["# B"]}, [], {"seed": "E"})


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "id int, text string")


def test_one_pass_equals_the_four_outputs(spark):
    rows = docs(spark)
    want, got = passages.extract(rows, ["id"], *HOW), passages.stage_rows(rows, ["id"], *HOW)
    pick = lambda df, output, *c: Counter(map(tuple, df.where(F.col("output") == output).select("id", *c).collect()))
    same = lambda output, *c: pick(got, output, *c) == Counter(map(tuple, want[output].select("id", *c).collect()))
    assert same("sections", "section", "text") and same("failures", "step", "error") and same("documents", "n_passages")
    assert same("passages", "section", "paragraph_id", "text", "seed_count", "esg_category")
    assert {r["id"]: r["text"] for r in got.where("output = 'documents'").collect()} == {1: f"{LONG} one\n\n{LONG} two", 6: f"{LONG}\n\n{LONG} three"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_stage_slices_appends_and_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = docs(spark)
    first = passages.run_stage(rows, path, ["id"], *HOW, end=2)
    assert {r["id"] for r in first.select("id").collect()} == {1, 2}
    passages.run_stage(rows, path, ["id"], *HOW, start=1, end=3, append=True)  # of what is left, which 2 is, since it failed to be read
    assert {r["id"] for r in spark.read.parquet(path).select("id").collect()} == {1, 2, 3, 4}
    mended = docs(spark, [(2, f"# A\n{LONG}") if i == 2 else (i, t) for i, t in TEXTS])
    passages.run_stage(mended, path, ["id"], *HOW, append=True)
    out = spark.read.parquet(path)
    assert Counter(r["id"] for r in out.where("output = 'documents'").collect()) == {1: 1, 2: 1, 6: 1}
    assert {r["output"] for r in out.select("output").distinct().collect()} == {"sections", "passages", "documents", "failures"}
    assert passages.run_stage(rows, path, ["id"], *HOW).select("id").distinct().count() == 6


def test_collect_resumes(spark, tmp_path):
    folder, target = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    for k in range(20):
        (folder / f"k{k}.bin").write_bytes(bytes([k]) * (k + 1))
    (folder / "broken.bin").mkdir()
    index = spark.createDataFrame([(f"k{k}",) for k in range(22)] + [("broken",), ("k3",), (None,), ("barred",)], "name string")
    barred = spark.createDataFrame([("barred",)], "name string")
    run = lambda **how: collect.collect(index, "name", f"file://{folder}", target, ".bin", barred, wait=0.0, attempts=2, most=4, **how)
    assert run(batch=5) == 5 and run() == 19  # with the failed key again
    log = {r["key"]: (r["status"], r["attempts"]) for r in collect.logged(spark, target).collect()}
    assert log["k0"] == ("ok", 1) and log["k20"] == log["k21"] == ("missing", 1) and log["broken"] == ("failed", 2) and "barred" not in log
    assert {r["key"]: bytes(r["payload"]) for r in collect.collected(spark, target).collect()} == {f"k{k}": bytes([k]) * (k + 1) for k in range(20)}
    (folder / "k20.bin").write_bytes(b"late")
    assert run() == 0  # the failed key has been tried four times by now
    assert run(retry=("missing",)) == 2
    assert bytes(collect.collected(spark, target).where("key = 'k20'").first()["payload"]) == b"late"


def test_still_open(spark):
    index = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "k int")
    log = spark.createDataFrame([(1, "ok", 1), (2, "failed", 1), (2, "ok", 1), (3, "failed", 2), (4, "missing", 1), (3, "failed", None)], "k int, status string, attempts int")
    got = lambda **how: sorted(map(tuple, collect.still_open(index, log, ["k"], **how).collect()))
    assert got() == [(5, 0)] and got(most=4) == [(3, 3), (5, 0)]
    assert got(retry=("missing", "failed"), excluded=spark.createDataFrame([(5,)], "k int")) == [(4, 1)]


def test_companies_from_xml(spark, tmp_path):
    (tmp_path / "codes.xml").write_text("""<?xml version="1.0" encoding="UTF-8"?><result>
        <list><corp_code>00126380</corp_code><corp_name> Acme &amp; Co </corp_name><stock_code>005930</stock_code><modify_date>20230110</modify_date></list>
        <list><corp_code>00000001</corp_code><corp_name>Unlisted</corp_name><stock_code> </stock_code><modify_date>20230110</modify_date></list>
        <list><corp_name>No code</corp_name></list></result>""")
    good, bad = collect.read_companies(spark, str(tmp_path / "codes.xml"))
    assert sorted((r["corp_code"], r["corp_name"], r["stock_code"]) for r in good.collect()) == [("00000001", "Unlisted", None), ("00126380", "Acme & Co", "005930")]
    assert [r["corp_name"] for r in bad.collect()] == ["No code"]
    assert [r["stock_code"] for r in tables.listed_companies(good).collect()] == ["005930"]


def test_named_tokenizers(spark):
    def absent():
        raise ImportError("no such model")

    def halves():
        return lambda text: [text[: len(text) // 2], text[len(text) // 2 :]]

    tokenizers.register("absent", absent)
    tokenizers.register("halves", halves)
    rows = spark.createDataFrame([("Ünï one-two 3x",), (None,), ("",)], "t string")
    got = rows.select(tokenizers.named("absent", "letters")(F.col("t")).alias("a"), tx.words(tx.text_of("t")).alias("b"), tokenizers.named("halves")(F.col("t")).alias("c")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[0]["c"] == ["Ünï one", "-two 3x"]
    assert tokenizers.taken(spark, "absent", "halves", "letters") == ["halves"]
    with pytest.raises(ValueError, match="nobody"):
        tokenizers.named("nobody")
    with pytest.raises(Exception, match="absent: no such model"):
        rows.select(tokenizers.named("absent")(F.col("t"))).collect()
    grid = tokens.tokenize(rows.withColumn("k", F.lit(1)), ["k"], "t", tokens.GRID[0], tokens.WordLists(), tokenizers.named("absent", "letters"))
    assert sorted(map(len, (r["tokens"] for r in grid.collect()))) == [0, 0, 3]


def test_text_pivot(spark):
    rows = spark.createDataFrame([(1, 2, "u", "b"), (1, 1, "u", "a"), (1, 3, None, "n"), (1, 4, "x", "o"), (2, 1, "u", None)], "k int, turn int, role string, text string")
    got = {r["k"]: r for r in passages.text_pivot(rows, ["k"], "role", ["u", "v"], ["turn"], "text").collect()}
    assert got[1]["text_u"] == "a\n\nb" and got[1]["text_other"] == "n\n\no" and got[1]["text_v"] is None and got[1]["chars_v"] == 0 and got[1]["n_rows"] == 4
    assert got[2]["text_u"] is None and got[2]["n_rows"] == 1


def test_wide_keeps_all_documents(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "z", 1.0)], "doc int, token string, w double")
    got = features.wide(spark.createDataFrame([(1,), (2,), (3,)], "doc int"), w, "doc", ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 0.25), (2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[100:120] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [0.0] * 6), (903, [1.0, 2.0]), (904, [2.0, 4.0]), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = {(r["seed_id"], r["rank"]): (r["candidate"], r["cos"]) for r in features.nearest(v, v.where("k % 20 = 0 or k = 903"), "k", "v", 5, 0.6, block=64, spread=4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for s in range(0, 400, 20):
        cos = np.round(unit @ unit[s], 9)
        near = [j for j in range(400) if j != s and cos[j] >= 0.6]
        for rank, j in enumerate(sorted(near, key=lambda j: (-cos[j], j))[:5], 1):
            want[s, rank] = (j, cos[j])
    want[903, 1] = (904, 1.0)
    assert {k: a for k, (a, _) in got.items()} == {k: a for k, (a, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_runs_and_compounds(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "k int, tokens array<string>")
    assert sorted(map(tuple, tokens.token_runs(rows, ["k"]).collect())) == [(1, "a", 1), (1, "b", 2), (3, "c", 1)]
    got = spark.createDataFrame([("Of The law\x00and of them of the",)], "t string").select(tx.words_and_compounds(F.col("t"), ["of the"]).alias("w")).first()["w"]
    assert got == ["of the", "law", "and", "of the", "of the"]


def test_report(spark):
    """TF-IDF means by hand, shares, what is missing; an experiment without a vocabulary."""
    texts = [(1, "aa aa bb"), (2, "aa cc"), (3, "bb bb dd"), (4, ""), (5, None)]
    grid = [tokens.Config("p", "minimal", "none"), tokens.Config("q", "standard", "none")]
    lists = tokens.WordLists(minimal=[], standard=["aa", "bb"], extended=[], protect=[], boilerplate=[], lines=[], names=[])
    lexicons = {"g": ["aa", "zz"], "esg": ["bb"], "bp": ["dd"]}
    got = {r["exp_id"]: r for r in evaluate.report(tokens.grid_rows(docs(spark, texts), "text", grid, lists), grid, lists, lexicons, top=3).collect()}
    p, q = got["p"], got["q"]
    assert (p["n_docs"], p["vocab_size"], p["avg_token_count"], p["coverage_pct"]) == (5, 4, 1.6, 60.0)
    assert p["tf_top_n"] == "aa | bb | cc" and p["tf_g_tokens"] == "aa" and p["tf_esg_rate"] == 33.3 and p["tf_bp_count"] == 0
    idf = math.log(6 / 3) + 1
    a, b = (1 + math.log(2)) * idf, idf
    means = {"aa": (a / math.hypot(a, b) + 1) / 5, "bb": (b / math.hypot(a, b) + 1) / 5}
    assert p["tfidf_top_n"] == " | ".join(sorted(means, key=lambda t: -means[t])) and p["tfidf_g_count"] == 1
    assert p["g_signal_pct"] == 50.0 and p["g_missing"] == "zz" and q["g_missing"] == "aa, zz"
    assert q["tfidf_top_n"] == "" and q["tfidf_g_rate"] is None and q["tfidf_g_count"] == 0 and q["coverage_pct"] == 40.0
    change = evaluate.reduction(evaluate.report(tokens.grid_rows(docs(spark, texts), "text", grid, lists), grid, lists, lexicons, top=3), "p", ["q"]).first()
    assert change["delta_vocab_size"] == -2 and change["delta_tf_g_rate"] == -33.3 and change["g_missing_target"] == "aa, zz"


def test_small_tables_are_dealt(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    rows = tables.dealt(spark.read.parquet(path))
    assert "RoundRobin" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 100
    spark.range(100).repartition(spark.sparkContext.defaultParallelism).write.parquet(path + "2")
    assert "RoundRobin" not in tables.dealt(spark.read.parquet(path + "2"))._jdf.queryExecution().executedPlan().toString()


def test_cleanings_that_agree_share_their_tokens(spark):
    """A document is tokenized once for all cleanings that leave it the same text, and in one place of the plan."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def slow(text):
        made.add(1)
        return text.split()

    lists = tokens.WordLists(minimal=["the"], standard=[], extended=[], boilerplate=[], protect=[], lines=["drop"], units=["GB"], names=["Ores"])
    rows = docs(spark, [(1, "the same for all of them"), (2, "Ores has 3 GB\nto drop here"), (3, None)])
    counts = {(r["exp_id"], r["token"]): r["n"] for r in tokens.grid_counts(rows, "text", tokens.GRID, lists, slow).collect()}
    distinct = {1: 1, 2: len({"Ores has   GB\nto drop here", "Ores", " has   GB\nto drop here", " has [NUM]GB\nto drop here", " has   GB", " has [NUM]GB"}) - 1, 3: 1}
    assert made.value == sum(distinct.values())
    assert {e for e, t in counts if t == "same"} == {c.name for c in tokens.GRID} == {e for e, t in counts if t == tokens.MARK}
    assert all(counts[(c.name, tokens.MARK)] == 3 for c in tokens.GRID)
    assert {e for e, t in counts if t == "Ores"} == {"exp_A", "exp_B"} and {e for e, t in counts if t == "drop"} == {"exp_A", "exp_B", "exp_C", "exp_D"}
    plan = tokens.grid_counts(docs(spark), "text", tokens.GRID, lists)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\P{L}") == 1
    runs = tokens.token_runs(docs(spark).select("id", tx.words(tx.text_of("text")).alias("tokens")), ["id"])
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("\\P{L}") == 1


def test_texts_dealt_by_document_keep_their_tokens_in_place(spark, monkeypatch):
    """Counting moves no token, and a small vocabulary moves no count; a large one gives the same weights."""
    texts = tables.dealt_by(docs(spark, [(1, "aa bb bb"), (2, "aa cc"), (3, "bb aa"), (None, "aa bb"), (4, None)]), "id")
    counts = features.token_counts(texts.select("id", tx.words(tx.text_of("text")).alias("tokens")), "id")
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    small = features.tfidf(counts, "id", 5, max_features=2)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted(map(str, small.collect()))
    monkeypatch.setattr(features, "VOCABULARY", 0)
    assert sorted(map(str, features.tfidf(counts, "id", 5, max_features=2).collect())) == want


def test_named_tokenizers_hold_few_texts_as_tokens(spark, monkeypatch):
    """A batch is tokenized in slices, and what comes out is in order, nulls and empty texts too."""
    monkeypatch.setattr(tokenizers, "TEXTS", 3)
    texts = [(i, None if i % 5 == 0 else "" if i % 7 == 0 else f"word{'s' * (i % 4)} und {'x' * (i % 3)}") for i in range(1, 200)]
    t = tokenizers.named("letters")(F.col("text"))
    assert "ArrowEvalPython" in docs(spark, texts).select(t)._jdf.queryExecution().executedPlan().toString()
    rows = docs(spark, texts).select("id", t.alias("t"), tx.words(tx.text_of("text")).alias("w")).collect()
    assert len(rows) == len(texts) and all(r["t"] == r["w"] for r in rows)
