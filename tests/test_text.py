"""Text functions, on Korean where the rules are Korean."""

from pyspark.sql import functions as F

from panelweave.functions import fixed_values as fixed
from panelweave.functions import text as tx
from panelweave.operators import passages, tokens


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c.alias("x")).first()["x"]


def test_paragraphs_cut_and_drop(spark):
    text = "짧은 줄\n" + "가" * 40 + "\r\n" + "나" * 4010
    assert [len(x) for x in one(spark, tx.paragraphs(F.col("t")), t=text)] == [40, 2000, 2000]


def test_sentences_merge_short_pieces(spark):
    text = "회사는 온실가스를 줄이기 위해 노력하고 있습니다. 그렇다. 이사회는 내부통제를 강화하고 있습니다. 끝"
    got = one(spark, tx.sentences(F.col("t")), t=text)
    assert len(got) == 2
    assert got[0].startswith("회사는")
    assert one(spark, tx.sentences(F.col("t")), t="") == [""]


def test_markup(spark):
    html = "<html><style>p{}</style><script>var a='</p>';</script><p>a &lt;b&gt; &amp;amp;</p><!-- x --><p>  c </p></html>"
    assert one(spark, tx.markup_to_text(F.col("t")), t=html) == "a <b> &amp;\nc"


def test_number_modes(spark):
    t = "배출량 1,200톤 감축 30% 2023년"
    assert one(spark, tx.number_mode(F.col("t"), "keep_quantity", fixed.QUANTITY_UNITS), t=t) == "배출량  ,[NUM]톤 감축 [NUM]%  년"
    assert one(spark, tx.number_mode(F.col("t"), "remove_all", []), t=t) == "배출량  , 톤 감축  %  년"
    assert one(spark, tx.number_mode(F.col("t"), "keep", []), t=t) == t


def test_names_longest_first_or_legacy(spark):
    t = "(주)한빛 과 한빛(주) 그리고 한빛"
    assert one(spark, tx.remove_names(F.col("t"), ["한빛"]), t=t) == " 과  그리고 "
    assert one(spark, tx.remove_names(F.col("t"), ["한빛"], legacy=True), t=t) == "(주) 과 (주) 그리고 "


def test_boilerplate_lines(spark):
    t = "이사회 운영\n\n특수관계인과의 거래 내역\n환경 투자"
    assert one(spark, tx.drop_lines(F.col("t"), fixed.BOILERPLATE_LINES), t=t) == "이사회 운영\n\n환경 투자"


def test_zfill_keeps_long_values(spark):
    assert [one(spark, tx.zfill(F.col("t"), 6), t=v) for v in ("5930", "12345678")] == ["005930", "12345678"]


def test_strip_any_white_space(spark):
    assert one(spark, tx.strip(F.col("t")), t="   a b\t ") == "a b"


def test_sections_first_pattern_wins(spark):
    t = "목차 사업의 내용에 관한 사항 ... II. 사업의 내용 제품과 시장 VI. 이사회 등 회사의 기관 구성 VII. 재무에 관한 사항 표"
    rows = {r["section"]: r["text"] for r in passages.sections(spark.createDataFrame([(1, t)], "id int, t string"), ["id"], "t", fixed.SECTION_PATTERNS, fixed.HARD_STOPS).collect()}
    assert set(rows) == {"II", "VI"}
    assert rows["II"] == "II. 사업의 내용 제품과 시장"
    assert rows["VI"].endswith("구성")


def test_passages_category_and_density(spark):
    seeds = {"온실가스": "E", "인권": "S", "이사회": "G"}
    rows = spark.createDataFrame([(1, "온실가스 감축 목표를 세웠다"), (2, "온실가스와 인권을 함께 다룬다"), (3, "재무제표 주석 부채 자본금 장부")], "paragraph_id int, text string")
    got = {r["paragraph_id"]: r["esg_category"] for r in passages.seed_passages(rows, seeds).collect()}
    assert got == {1: "E", 2: "ESG"}
    kept = rows.where(passages.dense_enough(F.col("text"), passages.Lexicons(seeds))).select("paragraph_id").collect()
    assert [r[0] for r in kept] == [1, 2]


def test_protected_terms_survive_every_configuration():
    lists = tokens.WordLists(official=["이사회", "기타"])
    assert lists.conflicts() == []
    for config in tokens.GRID:
        assert not {*lists.removed(config)} & {*lists.protect}
    sizes = [len(lists.stop_words(s)) for s in tokens.STRENGTHS[:3]]
    assert sizes == sorted(sizes) and sizes[0] == 15


def test_unknown_strength_is_refused():
    import pytest

    with pytest.raises(ValueError):
        tokens.WordLists().stop_words("most")
