"""The steps from the command line, one into the next; batches and slices that go on where the last ended."""

import pytest

from panelweave.__main__ import main

TEXTS = [(1, "1. 지배구조\n이사회 감사 탄소중립 재무제표 이사회 그리고 긴 문단 하나가 여기에 더 있습니다 정말로"), (2, "1. 지배구조\n탄소중립 온실가스 재무제표 그리고 긴 문단 하나가 여기에 더 있습니다 정말로 그렇습니다"), (3, None), (4, "다른 글")]


@pytest.fixture
def at(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    return str(tmp_path)


def test_tokens_to_classes(spark, at):
    for n in (2, 4, 4):
        main(["tokenize", "--input", f"{at}/docs", "--output", f"{at}/tokens", "--exp", "exp_B", "--batch", "2", "--append", "--tokenizer", "kiwi,letters"])
        assert spark.read.parquet(f"{at}/tokens").count() == n
    main(["audit", "--input", f"{at}/tokens", "--output", f"{at}/audit", "--top_n", "8"])
    assert spark.read.parquet(f"{at}/audit").count() == 8
    main(["classify", "--input", f"{at}/audit", "--output", f"{at}/classes", "--export_stopwords", f"{at}/stop"])
    got = {r["token"]: r for r in spark.read.parquet(f"{at}/classes").collect()}
    assert got["이사회"]["auto_class"] == "G_SIGNAL" and got["이사회"]["rationale"].startswith("rule: governance list | governance term")
    assert "재무제표" in {r["token"] for r in spark.read.parquet(f"{at}/stop").collect()}
    main(["features", "--input", f"{at}/tokens", "--output", f"{at}/features"])
    assert {r["doc_id"]: r["g_count"] for r in spark.read.parquet(f"{at}/features").collect()}[1] == 4
    main(["evaluate", "--input", f"{at}/docs", "--output", f"{at}/report", "--exps", "exp_B", "exp_E"])
    report = {r["exp_id"]: r for r in spark.read.parquet(f"{at}/report").collect()}
    assert report["exp_B"]["tf_bp_count"] == 1 and report["exp_E"]["tf_bp_count"] == 0 and report["exp_B"]["n_docs"] == 4


def test_extract_in_slices(spark, at):
    run = lambda *more: main(["extract", "--input", f"{at}/docs", "--output", f"{at}/out", "--section", "g=1\\. 지배구조", "--seed", "이사회=G", "탄소중립=E", *more])
    run("--row_end", "1")
    assert {r["doc_id"] for r in spark.read.parquet(f"{at}/out").collect()} == {1}
    run("--append")
    out = spark.read.parquet(f"{at}/out")
    assert {r["doc_id"] for r in out.where("output = 'documents'").collect()} == {1, 2}
    assert {(r["doc_id"], r["error"]) for r in out.where("output = 'failures'").collect()} == {(3, "EMPTY"), (4, "NO_SECTION")}


def test_collect(spark, at, tmp_path, capsys):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "1.zip").write_bytes(b"x")
    for said in ("4 keys tried", "0 keys tried"):
        main(["collect", "--input", f"{at}/docs", "--output", f"file://{at}/got", "--folder", f"file://{at}/files", "--suffix", ".zip"])
        assert said in capsys.readouterr().out
    assert {r["key"]: r["status"] for r in spark.read.parquet(f"{at}/got").select("key", "status").collect()} == {"1": "ok", "2": "missing", "3": "missing", "4": "missing"}


def test_unknown_names(at):
    with pytest.raises(SystemExit):
        main(["tokenize", "--input", "x", "--output", "y", "--exp", "exp_Z"])
    with pytest.raises(ValueError, match="nobody"):
        main(["tokenize", "--input", f"{at}/docs", "--output", f"{at}/t", "--exp", "exp_A", "--tokenizer", "nobody"])
