import pytest
from pyspark.sql import functions as F

from tomeflow.operators.progress import normalized
from tomeflow.sources import files
from tomeflow.sources.repository import Repository


def novels(spark, *rows):
    df = spark.createDataFrame(list(rows), "novel_id string, title string, summary string, created_at string")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in spark.createDataFrame([], files.NOVEL).schema)))


def test_save_keeps_the_others(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "lib"))
    assert repo.novels().count() == 0 and not repo.exists("a")
    repo.save(novels(spark, ("a", "A", "x", "1"), ("b/c", "B", "y", "1")))
    repo.save(novels(spark, ("a", "A2", "z", "2"), ("a", "A1", "q", "1")))
    assert {(r.novel_id, r.title) for r in repo.novels().collect()} == {("a", "A2"), ("b/c", "B")}
    assert repo.exists("b/c") and repo.novel("b/c").first().title == "B" and [r.novel_id for r in repo.ids().collect()] == ["a", "b/c"]
    with pytest.raises(FileNotFoundError):
        repo.novel("c")
    new = spark.createDataFrame([("a",), ("n",)], "novel_id string")
    assert [r.novel_id for r in repo.to_ingest(new).collect()] == ["n"] and repo.to_ingest(new, overwrite=True).count() == 2


def test_progress_and_publishing(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "lib"))
    chapters = spark.createDataFrame([(n, f"c{i}", i) for n in ("a", "b") for i in range(3)], "novel_id string, chapter_id string, chapter_index int")
    told = spark.createDataFrame([("a", f"c{i}", "t", "s", "ok") for i in range(3)] + [("b", "c0", "t", "s", "ok"), ("b", "c2", "t", "s", "ok")], "novel_id string, chapter_id string, title string, summary string, summary_status string")
    assert repo.progress().count() == 0 and not repo.delete_progress("a")
    assert {(r.novel_id, r.done_index) for r in repo.checkpoint(chapters, told).collect()} == {("a", 3), ("b", 1)}
    assert repo.progress_exists("a") and repo.progress("b").count() == 2
    books = novels(spark, ("a", "A", "whole", "1"), ("b", "B", "part", "1"))
    assert repo.publish(books, chapters) == ["a"] and repo.exists("a") and not repo.exists("b")
    assert not repo.progress_exists("a") and repo.progress_exists("b")
    new = spark.createDataFrame([("a",), ("b",)], "novel_id string")
    assert [r.novel_id for r in repo.to_ingest(new, resume=True).collect()] == ["b"]
    repo.save_progress(told.where("novel_id = 'a'").withColumn("chapter_index", F.lit(0)))
    with pytest.raises(RuntimeError):
        repo.publish(novels(spark, ("a", "A", " ", "1")), chapters)
    assert repo.delete_progress("a") and repo.progress("b").count() == 2


def test_normalized_progress(spark):
    rows = ['{"chapter_index": 3, "chapter_summaries": [{"chapter_id": "c"}]}', '{"chapter_index": "x"}', "[]", None, "nope"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = [r.p for r in df.select(normalized("p").alias("p")).collect()]
    assert [(g.chapter_index, len(g.chapter_summaries), len(g.characters)) for g in got] == [(3, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
