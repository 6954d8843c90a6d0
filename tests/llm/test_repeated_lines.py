from tomeflow.llm.repeated_lines import normalized, repeated_lines, without_repeated_lines
from pyspark.sql import functions as F


def table(spark):
    rows = []
    for c in range(10):
        rows.append((c, "n", f"ch{c}", f"story {'abcdefghij'[c]}\nRead at SITE {c}\n\n1234\nend", 1))
    rows += [(20, "n", "ch1", "read  AT　site99", 1), (21, None, "x1", "read at site", 1), (22, "n", None, "read at site\nother", 1), (23, "n", "ch2", None, 1), (24, "n", "ch3", "", 1)]
    return spark.createDataFrame(rows, "row_id long, novel_id string, chapter_id string, content string, line_no int")


def test_occurrences_and_rebuild(spark):
    df = table(spark)
    found = {(r.row_id, r.line_no) for r in repeated_lines(df, "row_id", "novel_id", "chapter_id", "content").collect()}
    assert found == {(c, 1) for c in range(10)} | {(c, 4) for c in range(10)} | {(20, 0), (22, 0)}
    clean = {r.row_id: (r.content, r.lines_removed) for r in without_repeated_lines(df, "row_id", "novel_id", "chapter_id", "content").collect()}
    assert clean[0] == ("story a\n\n1234", 2)
    assert clean[20] == ("", 1) and clean[22] == ("other", 1)
    assert clean[21] == ("read at site", 0) and clean[23] == (None, 0) and clean[24] == ("", 0)
    assert len(clean) == 15


def test_share_and_count_thresholds(spark):
    rows = [(i, "a", f"c{i}", "same" if i < 4 else f"x{'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'[i]}y") for i in range(41)]
    df = spark.createDataFrame(rows, "row_id long, novel_id string, chapter_id string, content string")
    assert repeated_lines(df, "row_id", "novel_id", "chapter_id", "content").count() == 0  # 4 of 41
    assert repeated_lines(df.where("row_id < 40"), "row_id", "novel_id", "chapter_id", "content").count() == 4
    assert repeated_lines(df.limit(0), "row_id", "novel_id", "chapter_id", "content").count() == 0


def test_normalisation(spark):
    df = spark.createDataFrame([("Ａ b  \u0085c\x1f٣7",)], "s string")
    assert df.select(normalized(F.col("s"))).first()[0] == "ａbc"
