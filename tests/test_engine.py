import json
from pathlib import Path

import pytest

from tomeflow.config import Config, load
from tomeflow.engine import Engine
from tomeflow.providers import HashProvider

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_dispatch(spark):
    words, vectors = Engine(spark, Config(library=FOLDER)), Engine(spark, Config(library=FOLDER), HashProvider())
    assert words.health_check()["embeds"] is False and vectors.health_check()["embeds"] is True
    for e in (words, vectors):
        assert 0 < e.search_paragraphs("铜灯", 4).count() <= 4
        assert 0 < e.search_chapters("铜灯", 4).count() <= 4
        assert e.search_novel("铜灯", 3).count() <= 3 and e.search_plot_summaries("铜灯", 3).count() <= 3
    assert Engine(spark, Config(library=FOLDER, paragraph_search=False)).search_paragraphs("铜灯").count() == 0
    assert "rank" in words.search_chapters("铜灯").columns and "vector_score" in vectors.search_paragraphs("铜灯").columns


def test_the_rest(spark, tmp_path):
    e = Engine(spark, Config(library=FOLDER), HashProvider())
    novel = e.list_novels().orderBy("novel_id").first().novel_id
    assert isinstance(e.get_summary(novel), str) and e.get_summary(text="A. B.") == "A."
    with pytest.raises(FileNotFoundError):
        e.get_summary("nowhere")
    assert e.answer_question("铜灯在哪里？", "铜灯").count() >= 1
    assert e.analyze_novel("A. B.")["plot"] == {"summary": "A."} and e.extract_characters("x") == []
    assert e.audit_summaries().count() + e.audit_summaries(mode="delete").count() == e.lib.last_summaries.count()
    assert e.audit_summaries(mode="confirm-delete", confirm=lambda rows: False).count() == e.lib.last_summaries.count()
    (tmp_path / "a b.txt").write_text("第一章 x\n正文", encoding="utf-8")
    rows = e.ingest_novel_file(str(tmp_path))
    assert [(r.novel_id, r.title) for r in rows.collect()] == [("a-b", "第一章")]
    assert e.ingest_novel_file(str(tmp_path), existing=rows).count() == 0
    none = spark.createDataFrame([], "novel_id string, chapter_id string, summary string")
    done = e.resume_novel_file(rows, none)
    assert [(r.summary, r.summary_status) for r in done.collect()] == [("第一章 x 正文", "ok")]
    e.completeness(rows, done)
    with pytest.raises(ValueError, match="a-b/ch_0000"):
        e.completeness(rows, none)
    assert e.strict(rows, done).count() == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"library": "x"}))
    assert load(str(tmp_path / "c.json")).library == "x" and load(str(tmp_path / "no.json")) == Config()
    (tmp_path / "c.json").write_text(json.dumps({"nope": 1}))
    with pytest.raises(ValueError):
        load(str(tmp_path / "c.json"))
