"""Chapters grouped by volume, and reductions over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomeflow.functions.text import volume_title

NO_VOLUME = "未分卷"


def volume_groups(chapters: DataFrame, last_summaries: DataFrame) -> DataFrame:
    """(novel_id, run, volume_title, start_chapter, end_chapter, items): runs of chapters that a volume title opens.

    Items are the summarised chapters' "title: summary" in order; a run without any vanishes; the same
    title in two runs makes two groups. The window runs over narrow rows; texts join afterwards.
    """
    w = Window.partitionBy("novel_id").orderBy("chapter_index", "chapter_id")
    rows = chapters.select("novel_id", "chapter_id", "chapter_index", "title").withColumn("volume", volume_title("title"))
    runs = rows.withColumn("run", F.sum(F.col("volume").isNotNull().cast("int")).over(w)).withColumn("volume_title", F.coalesce(F.last("volume", True).over(w), F.lit(NO_VOLUME)))
    told = runs.join(last_summaries.where(F.length("summary") > 0).select("novel_id", "chapter_id", "summary"), ["novel_id", "chapter_id"])
    place = F.struct("chapter_index", "chapter_id")
    item = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.col("summary"))
    groups = told.groupBy("novel_id", "run", "volume_title").agg(
        F.min_by("title", place).alias("start_chapter"), F.max_by("title", place).alias("end_chapter"), F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_id", item.alias("item")))).alias("i")
    )
    return groups.select("novel_id", "run", "volume_title", "start_chapter", "end_chapter", F.transform("i", lambda x: x["item"]).alias("items"))
