"""Export of novels as content chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomeflow.functions.text import non_empty, truncate


def export_chunks(novels: DataFrame, chapters: DataFrame, include_chapters: bool = True, include_embeddings: bool = False) -> DataFrame:
    """(id, content, content_type, source_id, source_title, metadata, created_at): a row for each book, by its summary or
    else its first chapter's beginning, and one for each chapter, whose own metadata hold over the defaults. include_embeddings: with the stored vectors as ``embedding``, null where there is none."""
    opening = chapters.groupBy("novel_id").agg(F.min_by("content", F.struct("chapter_index", "chapter_id")).alias("opening"))
    books = novels.join(opening, "novel_id", "left")
    book = books.select(
        F.concat("novel_id", F.lit(":summary")).alias("id"), F.coalesce(non_empty("summary"), truncate("opening", 800), F.lit("")).alias("content"), F.lit("novel_summary").alias("content_type"),
        F.col("novel_id").alias("source_id"), F.col("title").alias("source_title"),
        F.create_map(F.lit("features"), F.to_json("features"), F.lit("characters"), F.to_json("characters")).alias("metadata"), "created_at",
        *([F.col("summary_embedding").cast("array<double>").alias("embedding")] if include_embeddings else []),
    )
    if not include_chapters:
        return book
    own = F.coalesce(F.col("metadata"), F.expr("CAST(map() AS map<string,string>)"))
    base = F.create_map(F.lit("chapter_id"), F.col("chapter_id"), F.lit("chapter_title"), F.col("chapter_title"), F.lit("chapter_index"), F.col("chapter_index").cast("string"))
    named = chapters.select("novel_id", "chapter_id", "chapter_index", F.col("title").alias("chapter_title"), "content", "metadata", *(["embedding"] if include_embeddings else [])).join(novels.select("novel_id", "title", "created_at"), "novel_id")
    chapter = named.select(
        F.concat("novel_id", F.lit(":"), "chapter_id").alias("id"), "content", F.lit("chapter").alias("content_type"), F.col("novel_id").alias("source_id"), F.col("title").alias("source_title"),
        F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own).alias("metadata"), "created_at",
        *([F.col("embedding").cast("array<double>").alias("embedding")] if include_embeddings else []),
    )
    return book.unionByName(chapter)


def novel_list(novels: DataFrame) -> DataFrame:
    return novels.select("novel_id", "title")
