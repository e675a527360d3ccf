"""Model outputs without SQL, against numpy; and scans and archives at their edges."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.stats import student_p
from panelweave.operators import linear, passages, rank_stats
from panelweave.plans import comparisons, statistics
from panelweave.sources import archives, tables

SF = "/root/testdata/sf0.001"


def design(spark, names):
    rows = statistics.rated(spark, SF).dropna(subset=["grade", *names]).select("grade", *names).collect()
    return np.array([r["grade"] for r in rows], float), np.array([[1.0, *(r[n] for n in names)] for r in rows])


def brute_ols(y, x, robust):
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    n, k = x.shape
    cov = inverse @ (x.T * e**2) @ x @ inverse * n / (n - k) if robust else inverse * (e @ e) / (n - k)
    return b, np.sqrt(np.diag(cov)), 1 - (e @ e) / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("robust", [False, True])
def test_ols_keeps_its_digits(spark, robust):
    names = ["esg_ratio", "log_tokens"]
    y, x = design(spark, names)
    rows = statistics.rated(spark, SF).selectExpr("cast(grade as double) y", "esg_ratio", "log_tokens + 1e6 as far", "yr")
    got = {r["term"]: r for r in linear.ols(rows, "y", ["esg_ratio", "far"], robust).collect()}
    b, se, r2 = brute_ols(y, x, robust)
    assert np.allclose([got["esg_ratio"]["coef"], got["far"]["coef"]], b[1:], rtol=1e-6)
    assert np.allclose([got["esg_ratio"]["se"], got["far"]["se"]], se[1:], rtol=1e-6)
    assert abs(got["far"]["r2"] - r2) < 1e-8
    by_year = {(r["yr"], r["term"]): r["coef"] for r in linear.ols_by(rows, "y", ["esg_ratio"], ["yr"], robust).collect()}
    assert {k[0] for k in by_year} == {2019, 2020, 2021}


def test_joint_models(spark):
    got = {(r["model"], r["term"]): r for r in comparisons.joint_models(spark, SF).collect()}
    for model, names in (("M_J1", ["esg_ratio", "g_ratio"]), ("M_J2", ["esg_ratio", "g_ratio", "log_tokens"])):
        y, x = design(spark, names)
        b, se, _ = brute_ols(y, x, True)
        assert np.allclose([got[model, t]["coef"] for t in ("intercept", *names)], b, rtol=1e-6)
        assert np.allclose([got[model, t]["se"] for t in ("intercept", *names)], se, rtol=1e-6)


def test_dummies(spark):
    rows = statistics.rated(spark, SF).dropna(subset=["grade", "g_ratio", "log_tokens", "lang"]).collect()
    langs, years = sorted({r["lang"] for r in rows}), sorted({r["yr"] for r in rows})
    x = np.array([[1.0, r["g_ratio"], r["log_tokens"], *(float(r["lang"] == v) for v in langs[1:]), *(float(r["yr"] == v) for v in years[1:])] for r in rows])
    b, se, _ = brute_ols(np.array([r["grade"] for r in rows], float), x, True)
    got = comparisons.ols_dummies(spark, SF).collect()
    assert np.allclose([r["coef"] for r in got], b, rtol=1e-5) and np.allclose([r["se"] for r in got], se, rtol=1e-5)


def test_logit_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-0.4 - 0.9 * x))).astype(float)
    got = {r["term"]: r for r in linear.logit(spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True)], "x double, y double"), "y", ["x"]).collect()}
    b0, b1 = got["intercept"]["coef"], got["x"]["coef"]
    p = 1 / (1 + np.exp(-b0 - b1 * x))
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6
    ll = np.log(np.where(y == 1, p, 1 - p)).sum()
    null = 400 * (y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    assert abs(got["x"]["aic"] - (4 - 2 * ll)) < 1e-6 and abs(got["x"]["pseudo_r2"] - (1 - ll / null)) < 1e-8


def test_student_p():
    # df 1 is Cauchy's, df 2 has a closed form
    t = np.array([0.0, 0.5, 2.0, 10.0])
    assert np.allclose(student_p(t, np.ones(4)), 1 - 2 * np.arctan(t) / np.pi, atol=1e-9)
    assert np.allclose(student_p(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=1e-9)
    assert abs(student_p([1.96], [10**6])[0] - math.erfc(1.96 / math.sqrt(2))) < 1e-5


def test_spearman_p(spark):
    rows = spark.createDataFrame([("a", 12, 0.5), ("b", 12, 1.0), ("c", 2, 0.5), ("d", 30, None)], "g string, n long, rho double")
    got = {r["g"]: r["p"] for r in rank_stats.spearman_p(rows, ["g"]).collect()}
    assert abs(got["a"] - student_p([0.5 * math.sqrt(10 / 0.75)], [10])[0]) < 1e-6
    assert got["b"] == 0.0 and got["c"] is None and got["d"] is None


def test_ordered_logit_errors(spark):
    got = statistics.ordered_logit(spark, SF).collect()
    assert all(r["se"] > 0 and 0 <= r["p"] <= 1 for r in got)


def test_extraction_outputs(spark):
    text = "intro\n# A\n" + "seed one stands in this long paragraph of text\n" + "# B\n" + "nothing of interest in this other paragraph here"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no section at all, only words"), (4, "# A\n" + "nothing of interest in this other paragraph here")], "id int, text string")
    out = passages.extract(rows, ["id"], "text", {"a": ["# A"], "b": ["# B"]}, [], {"seed": "E"}, preview=10)
    assert sorted((r["id"], r["step"], r["error"]) for r in out["failures"].collect()) == [(2, "read", "EMPTY"), (3, "section", "NO_SECTION"), (4, "passage", "NO_PASSAGE")]
    assert [(r["id"], r["n_passages"]) for r in out["documents"].collect()] == [(1, 1)]
    assert max(len(r["text"]) for r in out["sections"].collect()) == 10


def test_numbers_and_scans(spark):
    raw = spark.createDataFrame([("5930", "2020", "A", None), ("0660", "1e20", "B+", "x"), ("7", "n/a", "?", "")], "stock_code string, fiscal_year string, kcgs_grade string, joined_text string")
    got = tables.read_ratings(raw, {"A": 5, "B+": 4}).collect()
    assert [(r["stock_code"], r["fiscal_year"], r["grade"]) for r in got] == [("005930", 2020, 5), ("000660", None, 4), ("000007", None, None)]
    assert [(r["fiscal_year"], r["joined_text"]) for r in tables.tokenized_rows(raw).collect()] == [(2020, ""), (None, "x"), (None, "")]
    names = spark.createDataFrame([(" Acme ",), ("Acme",), (None,), ("",)], "corp_name string")
    assert [r[0] for r in tables.company_names(names).collect()] == ["Acme"]
    seeds = spark.createDataFrame([("e", "air", None), ("G", "board", "board|boards"), ("S", " ", None)], "dimension string, seed string, pattern string")
    assert [tuple(r) for r in tables.seed_dictionary(seeds).collect()] == [("E", "air", "air"), ("G", "board", "board|boards")]


def test_corrected_filing(spark):
    rows = [("a", 2020, "사업보고서 (2020.12)", "2", "20210401"), ("a", 2020, "[기재정정]사업보고서 (2020.12)", "3", "20210601"), ("a", 2020, "[첨부정정]사업보고서 (2020.12)", "1", "20210301"), ("b", 2020, "사업보고서 (2019.12)", "4", "20200401")]
    index = spark.createDataFrame(rows, "corp string, fy int, report_nm string, rcept_no string, rcept_dt string")
    assert [(r["corp"], r["rcept_no"]) for r in tables.corrected_filing(index, ["corp"], "fy").collect()] == [("a", "3")]


def test_broken_archives():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a>" + "text " * 500 + "</a>")
    whole = data.getvalue()
    assert archives.open_archive(whole)[0] == "a.xml"
    broken = bytearray(whole)
    broken[40:60] = bytes(20)
    assert archives.open_archive(bytes(broken))[2] == "BAD_ARCHIVE"


def test_csv_and_stop_words(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,name\n00123,x\n", encoding="utf-8-sig")
    assert [tuple(r) for r in tables.read_strings(spark, str(tmp_path / "t.csv"), ["code", "name"]).collect()] == [("00123", "x")]
    assert [tuple(r) for r in tables.read_first(spark, str(tmp_path / "t.parquet"), ["code", "name"]).collect()] == [("00123", "x")]
    (tmp_path / "stop.txt").write_text("the\n\n of \nby\nthe\n")
    assert sorted(r[0] for r in tables.read_stop_words(spark, str(tmp_path / "stop.txt"), ["by"]).collect()) == ["of", "the"]


def test_listed_companies(spark):
    raw = spark.createDataFrame([("126", " 5930 ", "A"), ("1", None, "B"), ("2", "nan", "C")], "corp_code string, stock_code string, corp_name string")
    assert [tuple(r) for r in tables.listed_companies(raw).collect()] == [("00000126", "005930", "A")]


def test_logits_converge_or_say_so(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(50, 3, 600), rng.integers(0, 3, 600).astype(float)
    latent = 0.3 * (x1 - 50) - 0.8 * x2 + rng.logistic(size=600)
    grade = np.digitize(latent, [-2.0, -0.5, 1.0]).astype(float)
    rows = spark.createDataFrame([*zip(x1.tolist(), x2.tolist(), grade.tolist(), strict=True)], "x1 double, x2 double, y double")
    got = {r["term"]: r for r in linear.ordered_logit(rows, "y", ["x1", "x2"]).collect()}
    assert all(r["converged"] for r in got.values())
    theta = np.array([got[t]["coef"] for t in ("cut_1", "cut_2", "cut_3", "x1", "x2")])

    def ll(t):
        cdf = np.concatenate([np.zeros((600, 1)), 1 / (1 + np.exp(-(t[:3] - (t[3] * x1 + t[4] * x2)[:, None]))), np.ones((600, 1))], axis=1)
        return np.log(np.diff(cdf, axis=1)[np.arange(600), grade.astype(int)]).sum()

    best = ll(theta)
    for i in range(5):
        for h in (1e-3, -1e-3):
            assert ll(theta + h * np.eye(5)[i]) < best  # a maximum
    h = 1e-3
    hessian = np.array([[(ll(theta + h * (a + b)) - ll(theta + h * (a - b)) - ll(theta - h * (a - b)) + ll(theta - h * (a + b))) / (4 * h * h) for b in np.eye(5)] for a in np.eye(5)])
    assert np.allclose([got[t]["se"] for t in ("x1", "x2")], np.sqrt(np.diag(np.linalg.inv(-hessian)))[3:], rtol=0.05)
    apart = spark.createDataFrame([(float(i), float(i >= 20)) for i in range(40)], "x double, y double")
    assert not any(r["converged"] for r in linear.logit(apart, "y", ["x"]).collect())
    fine = linear.logit(rows.withColumn("y", (F.col("y") > 1).cast("double")), "y", ["x1", "x2"]).collect()
    assert all(r["converged"] for r in fine)


def test_fits_of_many_groups(spark):
    """Each group's fit, null's too, without any of them in the driver; groups too small have none."""
    rng = np.random.default_rng(6)
    rows = [(None if i % 50 == 0 else int(i % 50), float(a), float(2 * a + i % 50 + 1e6)) for i, a in enumerate(rng.normal(size=2000))] + [(99, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g int, x double, y double")
    for robust in (False, True):
        got = {(r["g"], r["term"]): r["coef"] for r in linear.ols_by(frame, "y", ["x"], ["g"], robust).collect()}
        assert len(got) == 100 and (99, "x") not in got
        assert all(abs(got[g, "x"] - 2) < 1e-6 for g in [None, *range(1, 50)])
    left = linear.residuals(frame.where("g = 7"), "y", ["x"])
    assert left.columns == ["g", "x", "y", "residual"] and max(abs(r["residual"]) for r in left.collect()) < 1e-6


def test_a_constant_grade(spark):
    """As SQL has it: r2 of 1, an LM of n, and distances that are no numbers; without a column that varies r2 is null."""
    rows = spark.createDataFrame([(2.0, float(i % 7), 5.0) for i in range(60)], "y double, x double, c double")
    assert {r["r2"] for r in linear.ols(rows, "y", ["x"]).collect()} == {1.0}
    assert {r["r2"] for r in linear.ols(rows, "y", ["c"]).collect()} == {None}
    assert linear.breusch_pagan(rows, "y", ["x"]).first()["lm"] == 60
    assert all(math.isnan(r["cooks_d"]) for r in linear.cooks(rows, "y", ["x"]).collect())
