"""Sources, audit, models and resampling on small data."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import fixed_values as fixed
from panelweave.operators import audit, gap, linear, panel, rank_stats
from panelweave.sources import archives, tables


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "1.zip").write_bytes(archive(a__xml=b"<a/>", b__xml="<b>가나다</b>".encode("euc-kr"), c__txt=b"x" * 99))
    (tmp_path / "2.zip").write_bytes(b"{'status': '013'}")
    (tmp_path / "3.zip").write_bytes(archive(c__txt=b"x"))
    got = {r["path"][-5:-4]: (r["member"], r["text"], r["reason"]) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"1": ("b.xml", "<b>가나다</b>", None), "2": (None, None, "NOT_AN_ARCHIVE"), "3": (None, None, "NO_MARKUP")}


def test_original_filing_before_corrections(spark):
    rows = [("f", 1, "[기재정정]사업보고서 (2022.12)", "20230301", "a"), ("f", 1, "사업보고서 (2022.12)", "20230331", "b"), ("f", 1, "반기보고서", "20230101", "c"), ("f", 1, "사업보고서 (2022.12)", "20230401", "d")]
    index = spark.createDataFrame(rows, "firm string, fy int, report_nm string, rcept_dt string, rcept_no string")
    assert [r["rcept_no"] for r in tables.original_filing(index, ["firm", "fy"]).collect()] == ["b"]


def test_ratings_are_never_filled(spark):
    raw = spark.createDataFrame([("5930", "2022", "A+"), ("660", "x", "?"), ("1", "2021", None)], "stock_code string, fiscal_year string, kcgs_grade string")
    got = [tuple(r) for r in tables.read_ratings(raw, fixed.GRADES).orderBy("stock_code").collect()]
    assert got == [("000001", 2021, None, None), ("000660", None, "?", None), ("005930", 2022, "A+", 6)]


def test_classifier_truth_table(spark):
    rows = spark.createDataFrame([("이사회", 0.2), ("탄소", 0.2), ("재무제표", 0.2), ("이자비용", 0.05), ("낱말", 0.3), ("사업계획", 0.6), ("위원회", 0.3), ("자본금류", 0.05)], "token string, idf double")
    got = {r["token"]: (r["auto_class"], r["confidence"]) for r in audit.classify(rows, audit.Rules()).collect()}
    assert got["이사회"] == ("G_SIGNAL", 0.95)
    assert got["탄소"] == ("ESG_SIGNAL", 0.9)
    assert got["재무제표"][0] == "BOILERPLATE"
    assert got["위원회"] == ("AMBIGUOUS", 0.4)
    assert got["낱말"][0] == "AMBIGUOUS"
    assert got["사업계획"][0] == "GENERIC"
    assert got["자본금류"][0] == "BOILERPLATE"


def sample(spark, n=200):
    rng = np.random.default_rng(3)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x1 - x2 + rng.normal(size=n)
    return spark.createDataFrame([(i, float(a), float(b), float(c), int(c > 1), int(np.digitize(c, [0, 2]))) for i, (a, b, c) in enumerate(zip(x1, x2, y, strict=True))], "id long, x1 double, x2 double, y double, hit int, grade int"), x1, x2, y


def test_ols_matches_numpy(spark):
    df, x1, x2, y = sample(spark)
    x = np.column_stack([np.ones_like(x1), x1, x2])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    inverse = np.linalg.inv(x.T @ x)
    for robust, cov in ((False, inverse * (e @ e) / (len(y) - 3)), (True, inverse @ (x.T * e**2) @ x @ inverse * len(y) / (len(y) - 3))):
        got = linear.ols(df, "y", ["x1", "x2"], robust).collect()
        assert np.allclose([r["coef"] for r in got], beta)
        assert np.allclose([r["se"] for r in got], np.sqrt(np.diag(cov)))


def test_logits_recover_signs(spark):
    df, *_ = sample(spark)
    got = {r["term"]: r["coef"] for r in linear.logit(df, "hit", ["x1", "x2"]).collect()}
    assert got["x1"] > 1 and got["x2"] < -0.5
    got = {r["term"]: r["coef"] for r in linear.ordered_logit(df, "grade", ["x1", "x2"]).collect()}
    assert got["x1"] > 1 and got["x2"] < -0.5 and got["cut_1"] < got["cut_2"]
    with pytest.raises(ValueError):
        linear.ordered_logit(df, "hit", ["x1"])


def test_constant_feature_has_no_rho(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "x double, y double")
    assert rank_stats.spearman(rows, []).first()["rho"] is None
    assert gap.orthogonal(rows, "x", "y", "r").agg(F.max(F.abs("r"))).first()[0] < 1e-9
    u = rank_stats.mann_whitney(rows.select("x", (F.col("y") < 8).alias("high")), []).first()
    assert u["u"] == 8 * 12 / 2 and u["rank_biserial"] == 0


def test_quartiles_keep_ties_together(spark):
    rows = panel.quartile(spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3, 4, 5)], "v double"), "v")
    assert sorted((r["v"], r["q"]) for r in rows.collect())[:4] == [(1.0, 1)] * 4


def test_resampling_is_deterministic(spark):
    df, *_ = sample(spark, 40)
    pairs = df.select("id", F.col("x1").alias("x"), "y")
    a, b = (sorted(map(tuple, rank_stats.bootstrap_rhos(pairs, 5, ["id"]).collect())) for _ in range(2))
    assert a == b and len({r[2] for r in a}) == 5


def test_pending_resumes_in_key_order(spark):
    todo, done = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(0,), (2,)], "k long")
    assert [r["k"] for r in tables.pending(todo, done, ["k"], batch=3).collect()] == [1, 3, 4]


def test_ingest_lands_each_key_once(spark, tmp_path):
    from panelweave.streaming.ingest import ingest

    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([(1, "a"), (2, "b")], [(2, "again"), (3, "c")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, target, mark, "k long, v string", ["k"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_sinks(spark, tmp_path):
    from panelweave.sources import sinks

    df = spark.createDataFrame([("x", 1, "long")], "k string, n int, text string")
    sinks.replace(df, str(tmp_path / "p"), ("text",))
    sinks.append(df.drop("text"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.to_csv(df, str(tmp_path / "c"))
    assert tables.read_strings(spark, str(tmp_path / "c"), ["k", "n", "text"]).first()["n"] == "1"
    sinks.to_json(df, str(tmp_path / "j"), "k")
    assert '"n":1' in spark.read.text(str(tmp_path / "j")).first()["value"]
