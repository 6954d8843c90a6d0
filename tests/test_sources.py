import json
import zipfile

import pytest

from tomeflow.sources import files
from tomeflow.sources.library import latest
from tomeflow.streaming.ingest import DOCUMENT, ingest


def test_epub_round_trip_and_txt(spark, tmp_path):
    files.write_epub(str(tmp_path / "a.EPUB"), "书 & 名", [("第一章", "<html><body><p>甲&amp;乙</p>\n<p>x</p></body></html>"), ("第二章", "<p>丙</p>")])
    (tmp_path / "b.txt").write_bytes("第一章 a\n正文".encode() + b"\xff\xfe")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("x", "no container")
    rows = {r.file_path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.EPUB"].title == "书 & 名" and rows["a.EPUB"].toc == ["第一章", "第二章"] and rows["a.EPUB"].parts == ["甲&乙 x", "丙"]
    assert rows["b.txt"].content == "第一章 a\n正文" and rows["b.txt"].title == "" and rows["b.txt"].parts is None
    assert rows["c.epub"].content is None
    df = files.read_documents(spark, str(tmp_path))
    titled = {r[0].rpartition("/")[2]: r[1] for r in df.select("file_path", files.novel_title(df)).collect()}
    assert titled == {"a.EPUB": "书 & 名", "b.txt": "b", "c.epub": "c"}
    (tmp_path / "d.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="no parser"):
        files.read_documents(spark, str(tmp_path)).collect()


def test_novel_files(spark, tmp_path):
    novel = {"novel_id": "n", "title": "T", "chapters": [{"chapter_id": "c", "content": "x"}], "metadata": {"summaries": {"chapters": [{"chapter_id": "c", "summary": "s"}], "plots": [{"summary": "p"}]}}, "created_at": "2020"}
    (tmp_path / "n.json").write_text(json.dumps(novel, indent=1))
    (tmp_path / "n.progress.json").write_text(json.dumps({"novel_id": "n"}))
    (tmp_path / "bad.json").write_text("{nope")
    df = files.read_novels(spark, str(tmp_path))
    assert [r.novel_id for r in df.collect()] == ["n"] and files.read_metadata(spark, str(tmp_path)).columns == ["novel_id", "title", "created_at"]
    assert files.nested_chapters(df).first().content == "x" and files.nested_summaries(df).first().summary == "s" and files.nested_plots(df).first().summary == "p"
    files.write_novels(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_cleaned_epubs(spark, tmp_path):
    pages = spark.createDataFrame([("n", "T", 1, "a", "<p>x</p>"), ("n", "T", 2, "b", "<p>y</p>")], "novel_id string, title string, chapter_no int, chapter_title string, page string")
    row = files.write_cleaned_epubs(pages, str(tmp_path)).first()
    assert row.n == 2 and files.parse_epub(open(row.path, "rb").read())[2] == ["a", "b"]


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y")], "row_id long, k string, v string")
    assert [tuple(r) for r in latest(df, ["k"], "row_id").collect()] == [(2, "a", "x")]
    assert latest(df.limit(0), ["k"], "row_id").count() == 0


def test_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [(1, "x/a.txt", "", "第一章\nx", None, None, None), (2, "x/b.epub", "B", None, ["t"], ["p", "q"], None)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(source)
    ingest(spark, source, target, checkpoint).awaitTermination()
    assert sorted((r.novel_id, r.title) for r in spark.read.parquet(target).collect()) == [("a", "第一章"), ("b", "Chapter 2"), ("b", "t")]
    spark.createDataFrame([(3, "x/a.txt", "", "第九章\nz", None, None, None)], DOCUMENT).write.mode("append").parquet(source)
    ingest(spark, source, target, checkpoint).awaitTermination()
    spark.catalog.refreshByPath(target)
    assert sorted((r.novel_id, r.title) for r in spark.read.parquet(target).collect()) == [("a", "第九章"), ("b", "Chapter 2"), ("b", "t")]
