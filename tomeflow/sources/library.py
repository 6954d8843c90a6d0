"""The library: stored novels and what belongs to them, as DataFrames.

A row sent again replaces the earlier one of its key, as writing a file again would; the later is
the one with the larger row number. Everything is lazy: a query reads the columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. Rows with a null key are left out."""
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    # one pass that combines map-side, instead of a sort of every group
    packed = kept.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row"))
    return packed.select(*keys, "_row.*").select(*df.columns)


class Library:
    """novels, chapters, summaries and plots of the tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def novels(self) -> DataFrame:
        """row_id, novel_id, title, summary, features, characters, summary_embedding, metadata, created_at, loaded_at"""
        return latest(self.table("novels"), ["novel_id"], "row_id")

    @cached_property
    def chapters(self) -> DataFrame:
        """row_id, novel_id, chapter_id, chapter_index, title, content, metadata"""
        columns = ["row_id", "novel_id", "chapter_id", "chapter_index", "title", "content", "metadata"]
        return latest(self.table("chapters").select(columns), ["novel_id", "chapter_id"], "row_id")

    def chapters_with(self, *columns: str) -> DataFrame:
        """Chapters with only these columns beside their key, so that no more is read or moved."""
        wanted = list(dict.fromkeys(["row_id", "novel_id", "chapter_id", *columns]))
        return latest(self.table("chapters").select(wanted), ["novel_id", "chapter_id"], "row_id")

    @cached_property
    def summaries(self) -> DataFrame:
        """item_pos, novel_id, chapter_id, title, summary: all saved chapter summaries in order of saving, repeats included"""
        return self.table("chapter_task_states").where("novel_id IS NOT NULL AND chapter_id IS NOT NULL").select(F.col("state_id").alias("item_pos"), "novel_id", "chapter_id", "title", F.col("chapter_summary").alias("summary"))

    @cached_property
    def last_summaries(self) -> DataFrame:
        return latest(self.summaries, ["novel_id", "chapter_id"], "item_pos")

    @cached_property
    def first_summaries(self) -> DataFrame:
        packed = self.summaries.groupBy("novel_id", "chapter_id").agg(F.min_by(F.struct("item_pos", "title", "summary"), "item_pos").alias("r"))
        return packed.select("r.item_pos", "novel_id", "chapter_id", "r.title", "r.summary")

    @cached_property
    def plots(self) -> DataFrame:
        """novel_id, plot_index, volume_title, start_chapter, end_chapter, summary"""
        return self.novels.select("novel_id", F.posexplode("metadata.plots").alias("plot_index", "p")).select("novel_id", "plot_index", "p.*")

    @cached_property
    def chunks(self) -> DataFrame:
        return self.table("chunks")
