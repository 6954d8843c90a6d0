"""Progress of summarising, resuming, and the consistency of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomeflow.functions.text import non_empty, strip

KEY = ["novel_id", "chapter_id"]


def not_blank(c: str) -> F.Column:
    return F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0


def pending(chapters: DataFrame, summaries: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Chapters without a summary that isn't blank, and those that are forced."""
    left = chapters.join(summaries.where(not_blank("summary")).select(*KEY).distinct(), KEY, "left_anti")
    return left if forced is None else left.unionByName(chapters.join(forced.select(*KEY).distinct(), KEY, "left_semi")).dropDuplicates(KEY)


def contiguous(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """(novel_id, chapter_count, done_index): how many chapters from the first on have a saved summary, blank or not, without a gap.

    Positions are counted from the order of chapter_index, so gaps in the indices themselves don't matter.
    """
    done = summaries.select(*KEY).distinct().withColumn("done", F.lit(True))
    rows = chapters.select(*KEY, "chapter_index").join(done, KEY, "left")
    place = F.struct("chapter_index", "chapter_id")
    first_gap = rows.groupBy("novel_id").agg(F.count("*").alias("chapter_count"), F.min(F.when(F.col("done").isNull(), place)).alias("gap"))
    before = rows.join(first_gap, "novel_id").where(F.col("gap").isNull() | (place < F.col("gap")))
    return first_gap.select("novel_id", "chapter_count").join(before.groupBy("novel_id").agg(F.count("*").alias("n")), "novel_id", "left").select("novel_id", "chapter_count", F.coalesce("n", F.lit(0).cast("bigint")).alias("done_index"))


def restored(chapters: DataFrame, last_summaries: DataFrame) -> DataFrame:
    """(novel_id, kept, done_index): the prefix up to and with the first blank summary, and its number of summaries that aren't blank."""
    rows = chapters.select(*KEY, "chapter_index").join(last_summaries.select(*KEY, "summary", F.lit(True).alias("saved")), KEY, "left")
    place = F.struct("chapter_index", "chapter_id")
    good = F.col("saved").isNotNull() & not_blank("summary")
    stop = rows.groupBy("novel_id").agg(F.min(F.when(~good, F.struct("chapter_index", "chapter_id", "saved"))).alias("stop"))
    before = rows.join(stop, "novel_id").where(F.col("stop").isNull() | (place < F.struct("stop.chapter_index", "stop.chapter_id")))
    done = before.groupBy("novel_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return stop.join(done, "novel_id", "left").select("novel_id", (n + F.when(F.col("stop.saved"), 1).otherwise(0)).cast("bigint").alias("kept"), n.alias("done_index"))


def consistency(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """(novel_id, chapter_id, issue): chapters without a summary and summaries without a chapter."""
    a, b = chapters.select(*KEY).distinct(), summaries.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("issue", F.lit("missing_summary")).unionByName(b.join(a, KEY, "left_anti").withColumn("issue", F.lit("extra_summary")))


def repeated_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def title_mismatches(chapters: DataFrame, last_summaries: DataFrame) -> DataFrame:
    joined = chapters.select(*KEY, F.col("title").alias("chapter_title")).join(last_summaries.select(*KEY, F.col("title").alias("summary_title")), KEY)
    return joined.where(~F.col("chapter_title").eqNullSafe(F.col("summary_title")))


def synced_titles(last_summaries: DataFrame, chapters: DataFrame) -> DataFrame:
    """Summaries under their chapters' titles; title_state tells updated, same and missing (no such chapter) apart."""
    named = last_summaries.join(chapters.select(*KEY, F.col("title").alias("own"), F.lit(True).alias("known")), KEY, "left")
    title = F.coalesce(non_empty("own"), "title")
    state = F.when(F.col("known").isNull(), "missing").when(title.eqNullSafe(F.col("title")), "same").otherwise("updated")
    return named.select(*KEY, "item_pos", title.alias("title"), "summary", state.alias("title_state"))


def first_characters(characters: DataFrame) -> DataFrame:
    """(novel_id, pos, name, role, relationships): characters by name without regard to case and outer space, or all fields where there's no name; the first wins."""
    key = F.coalesce(non_empty(F.lower(strip("name"))), F.to_json(F.struct("name", "role", "relationships")))
    rows = characters.withColumn("k", key)
    first = rows.groupBy("novel_id", "k").agg(F.min_by(F.struct("pos", "name", "role", "relationships"), "pos").alias("c"))
    return first.select("novel_id", "c.*")


PROGRESS_FORM = "struct<chapter_index:int,chapter_summaries:array<map<string,string>>,characters:array<map<string,string>>>"


def normalized(progress_json: str) -> F.Column:
    """Saved progress with defaults: from the first chapter and without summaries and characters where it has none or can't be read."""
    p = F.from_json(F.col(progress_json), PROGRESS_FORM)
    none = F.expr("CAST(array() AS array<map<string,string>>)")
    return F.struct(F.coalesce(p["chapter_index"], F.lit(0)).alias("chapter_index"), F.coalesce(p["chapter_summaries"], none).alias("chapter_summaries"), F.coalesce(p["characters"], none).alias("characters"))
