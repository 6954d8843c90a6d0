import random

import pytest

from tomeflow.llm.residue import THRESHOLD, body_of, has_placeholder, look, residue_scores, signature, terms, vocabulary

PLACEHOLDERS = [
    "{{volume_no}}", "${hero}", "<%= plot %>", "%(novel.name)s", "@@content@@", "__CONTENT__", "离开白塔__SUMMARY__临行前", "[[SUMMARY]]", "$主角$", "<书名>", "【主角待填】在雾港得到玉简。", "[insert plot here]", "他负伤离开，%(plot)s临行前留下一句。",
]
RESPONSES = [
    "Lorem ipsum dolor sit amet, magna aliqua tempor.", "asdf asdf - fill in later", "待补充待补充待补充。", "This is sample text for the summary block. Click to edit.", "这是一段占位用的简介，仅用于展示版面，请替换为正式内容。", "TBD", "xxx", "test test xxxxxxxx",
    "<html><head><title>410 Gone</title></head><body></body></html>", '{"error": {"code": 404, "message": "not found"}}', "503 Service Unavailable", "Access denied. Your region is not allowed to view this chapter. Ray 22d7aa", "服务器繁忙，请稍后刷新。（a1b2c3）", "抱歉，您访问的页面已被删除。返回首页", "第74章 折桂\n连接数据库失败：timeout after 59s，错误编号 f14b9c",
    "This reader requires scripting. Turn it on and try again.", "<noscript>Scripts are off in your browser</noscript>", "您的浏览器未开启脚本，无法显示正文。", "本页需要启用 JavaScript 才能阅读全文", "Loading chapter… If nothing happens, check that scripts are allowed.",
]
GOOD = [
    None, "", " \n", "They part.", "夜渡失败。", "裘疏影推开404号房门，屋里空无一人，只有一只空鸟笼。", "Bexley finds room 500 locked and the page of the ledger not found where Joskin left it.", "虞铁衣在墙上看见记号<卯>与[七]，由此推断浮舟商会曾来过。", "厉千钧是个写剧本的人，脚本被玄灯司禁演之后，决定去药王谷口。",
    "终端连续报错，嵇星槎改用手动方式关闭荒废的驿站的闸门。", "【系统提示：获得锈蚀的星门钥匙】的字样浮现，郁铁衣这才明白规则。", "Maerwyn cashes $40 and 30% of the cargo, leaving Tovrin a sample of the ore.", "A message reads [WE WAIT], and Wrenna follows it to the market of masks.", "哈" * 40, "The trail leads to a map, but the only witness has vanish", 'Vossin signs the contract as "insert coin here", a joke Amberle does not forgive.',
]


PEOPLE, PLACES = ["Quill Duskwater", "Maerwyn Saltmarch", "郁照夜", "虞止水", "嵇星槎"], ["the copper quay", "the moth garden", "白塔顶层", "雾港码头", "药王谷口"]


def corpus(n: int = 400):
    """Stories, a fifth of which share a term with their title."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        who, where = rng.choice(PEOPLE), rng.choice(PLACES)
        text = f"{who} leaves {where} wounded, with the warning of a long winter. The watch seals {rng.choice(PLACES)}." if who.isascii() else f"{who}负伤离开{where}，临行前留下一句话。经过一番对峙，{rng.choice(PEOPLE)}选择隐瞒{rng.choice(PLACES)}的下落。"
        rows.append(("s", 10_000 + i, f"novel-{i % 40}", f"Chapter {i}: {where}" if i % 5 == 0 else "番外", text))
    return rows


@pytest.mark.parametrize("text", PLACEHOLDERS)
def test_placeholders(text):
    assert has_placeholder(text)


def test_parts():
    assert body_of("第一章 甲\n乙", None) == "乙" and body_of("T x", "T") == "x"
    assert signature("Error 12, id a1b2") == signature("error 99 id c3d4!") != signature("other")
    assert signature("略略略略。") == signature("略略略略略略") and terms("a1b2c3 404 书名x") == {"404", "书名", "x"}
    assert look("推开白塔的门", "夜入白塔", None)[4] and look("at the quay", None, "the-copper-quay")[4] is True and not look("at sea", None, None)[4]


def test_scores(spark):
    rows = corpus() + [("t", i, f"novel-{i % 40}", "Title", x) for i, x in enumerate(RESPONSES * 3)]
    rows += [("p", i, f"novel-{i}", None, x) for i, x in enumerate(PLACEHOLDERS)] + [("g", i, f"novel-{i}", None, x) for i, x in enumerate(GOOD)]
    rows += [("p", 0, "novel-0", "Title", PLACEHOLDERS[0]), ("p", None, None, None, "{{x}}"), ("g", 300, "novel-1", "T", "long story. " * 20_000)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "table_name string, record_id long, source string, title string, text string, score double")
    got = [(r.table_name, r.record_id) for r in residue_scores(df).where(f"score >= {THRESHOLD}").collect()]
    assert {x for x in got if x[0] in "sg"} == set()
    assert {x for x in got if x[0] == "p"} == {("p", i) for i in range(len(PLACEHOLDERS))} | {("p", None)} and got.count(("p", 0)) == 2
    assert {x for x in got if x[0] == "t"} == {("t", i) for i in range(3 * len(RESPONSES))}
    assert residue_scores(df).count() == len(rows) and residue_scores(df.limit(0)).count() == 0


def test_messages_in_words_of_no_list(spark):
    """Bodies without any listed word are found by the terms that they share with marked ones, and only then."""
    marked = [("t", i, f"novel-{i % 40}", "Title", f"Zorvex kiosk is resting, umbral lattice {i:02d}f3a9c.") for i in range(20)]
    bare = [("u", i, f"novel-{i}", "Title", "The zorvex umbral lattice kiosk is resting.") for i in range(10)]
    df = lambda rows: spark.createDataFrame(rows, "table_name string, record_id long, source string, title string, text string")
    found = lambda rows: {(r.table_name, r.record_id) for r in residue_scores(df(rows)).where(f"score >= {THRESHOLD}").collect()}
    assert found(corpus() + marked + bare) == {(r[0], r[1]) for r in marked + bare}
    assert found(corpus() + bare) == set()


def test_copies_count_once(spark):
    """A message sent by one source as often as all else together changes no term's weight."""
    rows = corpus(200) + [("t", i, f"novel-{i % 40}", "Title", x) for i, x in enumerate(RESPONSES)]
    df = spark.createDataFrame([r[2:] for r in rows], "source string, title string, text string")
    hot = spark.createDataFrame([("novel-7", "Title", RESPONSES[7])] * 300, "source string, title string, text string")
    assert vocabulary(df).weight == vocabulary(df.unionByName(hot)).weight
