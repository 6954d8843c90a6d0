"""Ingest of documents as they arrive: an extension, as the batch operators are what queries run on.

A file stream of parquet documents is segmented batch by batch and upserted into a chapters table;
the checkpoint makes a restarted stream go on where it stopped, and the upsert makes a repeated
batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tomeflow.functions.text import slugify
from tomeflow.operators.segment import CHAPTER, epub_chapters, txt_chapters
from tomeflow.sources.files import novel_title

DOCUMENT = "raw_id bigint, file_path string, title string, content string, toc array<string>, parts array<string>, received_at timestamp"


def segmented(documents: DataFrame, pattern: str = CHAPTER) -> DataFrame:
    """(raw_id, novel_id, chapter_index, chapter_id, title, content) of raw documents, with or without parts."""
    named = documents.withColumn("novel_id", slugify(novel_title(documents))).select("raw_id", "novel_id", "content", "toc", "parts")
    txt = txt_chapters(named.where("parts IS NULL AND content IS NOT NULL").select("raw_id", "novel_id", "content"), "content", pattern)
    return txt.unionByName(epub_chapters(named.where("parts IS NOT NULL").select("raw_id", "novel_id", "toc", "parts"), "toc", "parts"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Streams the parquet documents of ``source`` into ``target``, partitioned by novel; a novel sent again replaces itself."""

    def upsert(batch: DataFrame, _: int) -> None:
        last = batch.withColumn("slug", slugify(novel_title(batch))).groupBy("slug").agg(F.max("raw_id").alias("raw_id"))
        rows = segmented(batch.join(last.select("raw_id"), "raw_id", "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_id").parquet(target)

    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
