import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tomeflow.functions import html, text as T
from tomeflow.functions.vector import cosine
from tomeflow.operators.segment import epub_titles, packed, paragraphs_a, paragraphs_b, segments, with_default_metadata


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="荒古圣体") == ["荒", "古", "圣", "体", "荒古", "古圣", "圣体"]
    assert one(spark, T.tokens("t"), t="abc ABC1 x") == ["abc", "x"]
    assert one(spark, T.tokens("t"), t="荒a古") == ["荒", "古", "荒古"]
    assert one(spark, T.tokens("t"), t="") == [] and one(spark, T.tokens("t"), t=None) is None


def test_keyword_count(spark):
    assert one(spark, T.keyword_count("t", "aa"), t="aaaa") == 2
    assert one(spark, T.keyword_count("t", "A.b"), t="xa.bA.B") == 2
    assert one(spark, T.keyword_count("t", "a"), t=None) == 0
    with pytest.raises(ValueError):
        T.keyword_count("t", "")


@pytest.mark.parametrize(
    "text,expected",
    [("ab\ncd\nlonger", ["ab\ncd\nlonger"]), ("ab\n\ncd\n\nlonger\n\nx\ny", ["ab cd", "longer x y"]), ("a\nb", ["a b"]), ("", []), ("\n \n", [])],
)
def test_splitter_a(spark, text, expected):
    assert one(spark, paragraphs_a("t", 5), t=text) == expected


@pytest.mark.parametrize("text,expected", [("abc\nde\n\nf", ["abc\nde", "f"]), ("abcdef\n  \nab\ncd", ["abcdef", "ab\ncd"]), ("", []), ("　x　", ["x"])])
def test_splitter_b(spark, text, expected):
    assert one(spark, paragraphs_b("t", 5), t=text) == expected


def test_packing(spark):
    items = ["aaaa", "bbb", "cccccc", "012345678901234", "", "dd"]
    assert one(spark, packed("t", 10), t=items) == ["aaaa\nbbb", "cccccc", "0123456789", "01234", "dd"]
    assert one(spark, segments("t", 20), t="a" * 20) == ["a" * 20]
    assert one(spark, segments("t", 20), t="") == [] and one(spark, segments("t", 4), t="  \n ") == ["  \n "]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab中", max_size=25), max_size=12), st.integers(3, 12))
def test_packing_keeps_all_text_within_the_limit(items, limit):
    from pyspark.sql import SparkSession

    out = one(SparkSession.getActiveSession(), packed("t", limit), t=items)
    assert all(0 < len(x) <= limit for x in out)
    assert "".join(out).replace("\n", "") == "".join(items)


def test_volume_and_heading(spark):
    assert one(spark, T.volume_title("t"), t="第一卷 x") == "第一卷"
    assert one(spark, T.volume_title("t"), t="volume II: y") == "volume II"
    assert one(spark, T.volume_title("t"), t=" 卷末 ") == "卷末"
    assert one(spark, T.volume_title("t"), t="第一章") is None
    assert one(spark, T.heading("t"), t=" 第12章  风起 云涌") == "第12章 风起"
    assert one(spark, T.heading("t"), t="第12章") == "第12章" and one(spark, T.heading("t"), t="风起") is None


def test_summary_from_json(spark):
    cases = {
        '{"summary": " a "}': "a", '{"answer": "b"}': "b", 'x {"content": "c"} y': "c", " plain ": "plain", '{"summary": {"content": "d"}}': "d",
        '{"summary": ["e", " ", "f"]}': "e\nf", '{"summary": "", "raw": "g"}': "g", '{"x": 1}': "", '{"summary": "cut': '{"summary": "cut', "": "", '{"summary": 5}': "5",
    }
    for raw, expected in cases.items():
        assert one(spark, T.summary_from_json("t"), t=raw) == expected, raw
    assert one(spark, T.summary_from_json("t"), t=None) == ""


def test_predicates(spark):
    assert one(spark, T.question_kind("t"), t="有哪些人物？") == "listing"
    assert one(spark, T.question_kind("t"), t="为什么不同") == "comparative"
    assert one(spark, T.question_kind("t"), t="来历") == "causal" and one(spark, T.question_kind("t"), t=None) == "general"
    assert one(spark, T.confident("t"), t="一个足够长的确定的回答。") and not one(spark, T.confident("t"), t="我不知道这个问题的答案是什么") and not one(spark, T.confident("t"), t="短")
    assert one(spark, T.matches_failure("t"), t="请提供需要总结的内容") and one(spark, T.matches_failure("t"), t="Rate  Limit") and not one(spark, T.matches_failure("t"), t="正常")
    assert one(spark, T.sanitized_summary("t"), t=" 好 ") == "好" and one(spark, T.sanitized_summary("t"), t="return JSON") == "" and one(spark, T.sanitized_summary("t"), t=None) == ""
    assert one(spark, T.compact_error("t"), t="<HTML>502") == "upstream_502_bad_gateway_html" and one(spark, T.compact_error("t", 5), t="a  b\ncdef") == "a b …"


def test_status(spark):
    rows = [("", "", False), ("正文内容", "", False), ("正文内容", "总结结果", False), ("正文内容", "", True), (None, None, None)]
    df = spark.createDataFrame(rows, "content string, summary string, bad boolean")
    assert [r[0] for r in df.select(T.summary_status("content", "summary", "bad")).collect()] == ["chapter_content_empty", "model_summary_empty", "ok", "model_summary_error", "chapter_content_empty"]


def test_ids(spark):
    assert one(spark, T.slugify("t"), t="  Ab 第一 -- x!") == "ab-第一-x"
    df = spark.createDataFrame([(0,), (12345,)], "i int")
    assert [r[0] for r in df.select(T.chapter_id("i")).collect()] == ["ch_0000", "ch_12345"]


def test_html(spark):
    page = "<h2 class='a'>T <b>x</b></h2><P>a&amp;b</P><p> </p><pre>c</pre><p>d\ne</p>"
    assert one(spark, html.paragraphs("t"), t=page) == ["a&amp;b", "d\ne"] or "c" in one(spark, html.paragraphs("t"), t=page)[1]
    assert one(spark, html.title("t", F.lit(3)), t=page) == "T x"
    assert one(spark, html.title("t", F.lit(3)), t="<p>短</p>") == "短" and one(spark, html.title("t", F.lit(3)), t="") == "第3章"
    assert one(spark, html.page_text("t"), t="<p>a&lt;b&nbsp;</p>  c") == "a<b c"
    made = one(spark, html.chapter_page("t", "p"), t="A&B", p=["A&B", "x < y"])
    assert "<h2>A&amp;B</h2>\n<p>x &lt; y</p>" in made


def test_epub_titles(spark):
    assert one(spark, epub_titles("t", "p"), t=["封面", "一"], p=["x"]) == ["一"]
    assert one(spark, epub_titles("t", "p"), t=["序", "一", "二"], p=["序 ...", "y", "z"]) == ["序", "一", "二"]
    assert one(spark, epub_titles("t", "p"), t=["封面", "一", "二"], p=["一 x", "y", "z"]) == ["一", "二"]
    assert one(spark, epub_titles("t", "p"), t=[], p=["x"]) == []


def test_metadata_defaults(spark):
    df = spark.createDataFrame([({"chapter_title": "own", "k": "v"}, 3, "t"), (None, 4, "u")], "m map<string,string>, i int, t string")
    assert [r[0] for r in df.select(with_default_metadata("m", "i", "t")).collect()] == [{"chapter_index": "3", "chapter_title": "own", "k": "v"}, {"chapter_index": "4", "chapter_title": "u"}]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
