"""One object with all that a caller asks of a library.

Searches take the best way that the settings, the provider and the query allow: both vectors and
words, vectors, or words; an empty query vector falls back to words. Each returns a lazy DataFrame.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomeflow.config import Config
from tomeflow.functions.text import slugify, truncate
from tomeflow.operators import answers, audit, export, progress, search, summarize, volumes
from tomeflow.operators.segment import epub_chapters, txt_chapters
from tomeflow.providers import Provider, create
from tomeflow.sources.files import novel_title, read_documents
from tomeflow.sources.library import Library


class Engine:
    def __init__(self, spark: SparkSession, config: Config, provider: Provider | None = None, reranker=None):
        self.spark, self.config, self.reranker = spark, config, reranker
        self.provider = provider or create(config.provider, **config.provider_settings)
        self.lib = Library(spark, config.library)

    # ---- ingest

    def ingest_novel_file(self, path: str, title: str | None = None, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
        """(novel_id, chapter_index, chapter_id, title, content) of a file. A novel that ``existing`` has is left out unless it may be overwritten."""
        docs = read_documents(self.spark, path)
        named = docs.withColumn("novel_id", slugify(novel_title(docs, title)))
        txt = txt_chapters(named.where("parts IS NULL AND content IS NOT NULL").select("novel_id", "content"), "content", self.config.chapter_pattern)
        rows = txt.unionByName(epub_chapters(named.where("parts IS NOT NULL").select("novel_id", "toc", "parts"), "toc", "parts"))
        return rows if overwrite or existing is None else rows.join(existing.select("novel_id").distinct(), "novel_id", "left_anti")

    def resume_novel_file(self, chapters: DataFrame, summaries: DataFrame, forced: DataFrame | None = None) -> DataFrame:
        """(novel_id, chapter_id, summary, summary_status) of the chapters that still need one."""
        from tomeflow.functions.text import summary_status

        key = ["novel_id", "chapter_id"]
        left = progress.pending(chapters, summaries, forced)
        told = summarize.chapter_summaries(left, key, "content", self.provider, self.config.segment_max_chars, self.config.analysis_max_chars)
        return left.select(*key, "content").join(told, key).select(*key, "summary", summary_status("content", "summary", "had_error").alias("summary_status"))

    def strict(self, chapters: DataFrame, summaries: DataFrame, prints: DataFrame | None = None) -> DataFrame:
        """Summaries (novel_id, chapter_id, summary) with the suspicious ones made again, for at most ``max_rounds`` rounds."""
        from tomeflow.session import checkpointed

        key = ["novel_id", "chapter_id"]
        now = summaries.select(*key, "summary")
        for _ in range(self.config.max_rounds):
            bad = checkpointed(audit.audit(now, prints, self.config.audit_min_length, self.config.audit_similarity).select(*key))
            if bad.isEmpty():
                break
            again = self.resume_novel_file(chapters, now.join(bad, key, "left_anti"), bad).select(*key, "summary")
            now = checkpointed(now.join(again.select(*key), key, "left_anti").unionByName(again))
        return now

    def completeness(self, chapters: DataFrame, summaries: DataFrame) -> None:
        """An error that names up to five chapters without a summary."""
        missing = [f"{r.novel_id}/{r.chapter_id}" for r in progress.pending(chapters, summaries).orderBy("novel_id", "chapter_index").limit(5).collect()]
        if missing:
            raise ValueError("chapters without a summary: " + ", ".join(missing))

    def volume_summaries(self) -> DataFrame:
        """(novel_id, volume_title, start_chapter, end_chapter, summary): a provider's summary of each volume run."""
        groups = volumes.volume_groups(self.lib.chapters_with("chapter_index", "title"), self.lib.last_summaries)
        key = ["novel_id", "run"]
        told = summarize.item_summaries(groups.select(*key, "items"), key, "items", self.provider, self.config.segment_max_chars, self.config.analysis_max_chars)
        return groups.drop("items").join(told, key).select("novel_id", "volume_title", "start_chapter", "end_chapter", "summary")

    # ---- search

    def _vector(self, query: str) -> list[float]:
        return self.provider.embed(query[: self.config.embedding_max_chars]) if self.config.vector_search else []

    def search_novel(self, query: str, k: int = 5) -> DataFrame:
        v = self._vector(query)
        if v:
            found = search.vector_search(self.lib.chunks, v, k, "overall_summary")
            return found.select("novel_id", F.col("novel_title").alias("title"), "score", truncate("content", 400).alias("summary"))
        return answers.novels_for(self.lib, query, k)

    recommend_novels = search_novel

    def search_by_meaning(self, level: str, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None) -> DataFrame:
        """novel, chapter, paragraph or plot, by vectors of the stored texts themselves; without a vector of the query, by words."""
        v = self._vector(query)
        if level == "novel":
            return search.novel_by_meaning(self.lib.novels, v, k, self.provider) if v else answers.novels_for(self.lib, query, k)
        if level == "chapter":
            chapters = self.lib.chapters_with("chapter_index", "title", "content", "embedding")
            return search.chapter_by_meaning(chapters, v, k, novel_id) if v else search.chapter_content_keyword(self.lib.chapters, query, k, novel_id)
        if level == "paragraph":
            find = search.paragraph_by_meaning(self.lib.chapters, v, self.provider, k, novel_id, chapter_range, self.config.paragraph_min_chars) if v else None
            return find if v else search.paragraph_keyword(self.lib.chapters, query, k, novel_id, chapter_range, self.config.paragraph_min_chars)
        if level == "plot":
            return search.plot_by_meaning(self.lib.plots, v, self.provider, k, novel_id) if v else search.plot_keyword(self.lib.plots, query, k, novel_id)
        raise ValueError(f"no level is called {level}")

    def search_chapters(self, query: str, k: int = 5, novel_id: str | None = None, qualified_keys: bool = False) -> DataFrame:
        v = self._vector(query)
        if not v:
            return answers.chapters_for(self.lib, query, k, novel_id, qualified_keys)
        words = search.chapter_summary_keyword(self.lib.summaries, self.lib.chapters_with("chapter_index", "title"), query, k, novel_id)
        words = words.select(F.lit(1).alias("stage"), F.col("item_pos").alias("rank"), "novel_id", "chapter_id", "chapter_title", F.col("score").cast("double").alias("score"), "snippet", "source")
        near = search.vector_search(self.lib.chunks, v, k, "chapter_summary", novel_id)  # the best k first, then without those found
        more = near.join(words.select("chapter_id").distinct(), "chapter_id", "left_anti")
        more = more.select(F.lit(2).alias("stage"), F.lit(0).cast("bigint").alias("rank"), "novel_id", "chapter_id", "chapter_title", "score", truncate("content", 300).alias("snippet"), F.lit("vector").alias("source"))
        return words.unionByName(more).orderBy("stage", F.col("score").desc(), "novel_id", "chapter_id", "rank").limit(k)

    def search_paragraphs(self, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None) -> DataFrame:
        if not self.config.paragraph_search:
            return search.paragraph_keyword(self.lib.chapters, query, k, novel_id, chapter_range).limit(0)
        v = self._vector(query)
        if v and self.config.hybrid_search:
            key = ["novel_id", "chapter_id", "paragraph_index"]
            near = search.vector_paragraphs(self.lib.chunks, v, search.CANDIDATES, novel_id, chapter_range)
            near = near.select("novel_id", "chapter_id", F.coalesce(F.try_element_at("metadata", F.lit("paragraph_index")).cast("int"), F.regexp_extract("chunk_id", r"_p(\d+)$", 1).try_cast("int")).alias("paragraph_index"), "score", truncate("content", 300).alias("snippet"))
            near = near.groupBy(*key).agg(F.max("score").alias("score"), F.max_by("snippet", "score").alias("snippet"))
            words = search.bm25(self.lib.chapters, query, search.CANDIDATES, novel_id, chapter_range, self.config.paragraph_min_chars)
            fused = search.fuse(near, words, key, search.CANDIDATES)
            texts = near.select(*key, "snippet").unionByName(words.select(*key, "snippet")).groupBy(*key).agg(F.first("snippet").alias("snippet"))
            return search.rerank(fused.join(texts, key, "left"), query, self.reranker, k, ties=tuple(key))
        if v:
            return search.vector_paragraphs(self.lib.chunks, v, k, novel_id, chapter_range)
        return search.bm25(self.lib.chapters, query, k, novel_id, chapter_range, self.config.paragraph_min_chars)

    def search_plot_summaries(self, query: str, k: int = 5, novel_id: str | None = None) -> DataFrame:
        v = self._vector(query)
        return search.vector_search(self.lib.chunks, v, k, "plot_summary", novel_id) if v else search.plot_keyword(self.lib.plots, query, k, novel_id)

    def search_chapters_by_range(self, novel_id: str, start: int, end: int, query: str | None = None) -> DataFrame:
        return search.chapters_by_range(self.lib.chapters, self.lib.first_summaries, novel_id, start, end, query)

    def get_novel_hierarchy(self, novel_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return search.hierarchy(self.lib.novels, self.lib.plots, self.lib.chapters, self.lib.first_summaries, novel_id, start, end)

    def find_chapter_by_title(self, novel_id: str, title: str) -> DataFrame:
        return search.chapter_by_title(self.lib.chapters, novel_id, title)

    # ---- lists, summaries, answers

    def list_novels(self) -> DataFrame:
        return self.lib.novels.select("novel_id", "title", "created_at")

    def export_content_chunks(self, include_chapters: bool = True, include_embeddings: bool = False) -> DataFrame:
        chapters = self.lib.chapters_with("chapter_index", "title", "content", "metadata", "embedding") if include_embeddings else self.lib.chapters
        return export.export_chunks(self.lib.novels, chapters, include_chapters, include_embeddings)

    def get_summary(self, novel_id: str | None = None, text: str | None = None) -> str:
        if text:
            return str(self.provider.analyze_plot(text).get("summary", ""))
        row = answers.novel_summary(self.lib).where(F.col("novel_id") == novel_id).first()
        if row is None:
            raise FileNotFoundError(f"no novel {novel_id}")
        return row["summary"]

    def analyze_novel(self, text: str) -> dict[str, Any]:
        return {"plot": self.provider.analyze_plot(text), "features": self.provider.extract_features(text)}

    def extract_characters(self, text: str) -> list[dict[str, Any]]:
        return self.provider.analyze_characters(text)

    def characters(self, novel_id: str) -> DataFrame:
        rows = self.lib.novels.where(F.col("novel_id") == novel_id).select("novel_id", F.posexplode("characters").alias("pos", "c"))
        return progress.first_characters(rows.select("novel_id", "pos", "c.*"))

    def answer_question(self, question: str, query: str | None = None, **k: int) -> DataFrame:
        return answers.answer(self.lib, question, query or question, self.provider, **k)

    def hierarchical_search(self, query: str, novel_id: str | None = None) -> DataFrame:
        return answers.hierarchical(self.lib, query, novel_id)

    def query_rewrite_search(self, question: str | list[str], novel_id: str | None = None, k_per_query: int = 5) -> DataFrame:
        """By the provider's sub-queries of a question, or by those given."""
        queries = answers.sub_queries(self.lib, question, self.provider) if isinstance(question, str) else question
        return answers.rewritten(self.lib, queries, novel_id, k_per_query)

    def hierarchical_answer(self, question: str, query: str | None = None, novel_id: str | None = None) -> DataFrame:
        return answers.answered_in_steps(self.lib, question, query or question, self.provider, novel_id)

    def comprehensive_answer(self, question: str, query: str | None = None, novel_id: str | None = None, k: int = 10) -> DataFrame:
        return answers.comprehensive(self.lib, question, query or question, novel_id, k, answers.keywords_of(self.lib, question))

    def audit_summaries(self, prints: DataFrame | None = None, mode: str = "report", min_score: float = 0.0, confirm=None) -> DataFrame:
        """report: the findings; delete: the summaries that are left; confirm-delete: as delete, if ``confirm`` says so to the findings' first 30 rows."""
        rows = self.lib.last_summaries
        found = audit.audit(rows, prints, self.config.audit_min_length, self.config.audit_similarity).where(F.col("score") >= min_score)
        if mode == "report":
            return found.orderBy(F.col("score").desc(), "novel_id", "chapter_id")
        if mode == "delete" or mode == "confirm-delete" and confirm and confirm(found.orderBy(F.col("score").desc(), "novel_id", "chapter_id").limit(30).collect()):
            return audit.without_findings(rows, found, ["novel_id", "chapter_id"], min_score)
        if mode != "confirm-delete":
            raise ValueError(f"no mode is called {mode}")
        return rows

    def health_check(self) -> dict[str, Any]:
        return {"spark": self.spark.version, "provider": type(self.provider).__name__, "embeds": bool(self.provider.embed("health")), "library": self.config.library}
