"""Stored novels and the progress of novels that are being read: lookups, saves, deletions, publishing.

Novels are JSON, as ``files.write_novels`` keeps them. Progress is parquet with a partition for each
novel, so that saving one replaces no other and a lookup reads its own folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomeflow.operators.progress import contiguous, not_blank, pending
from tomeflow.session import checkpointed
from tomeflow.sources import files

PROGRESS = "novel_id string, chapter_index int, chapter_id string, title string, summary string, summary_status string"


class Repository:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.progress_folder = f"{self.folder}-progress"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _there(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _remove(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _key(self, novel_id: str, column: str) -> str:
        from tomeflow.operators.chunks import _escaped

        return f"{column}={_escaped(self.spark, novel_id)}"

    # ---- novels

    def novels(self, columns: list[str] | None = None) -> DataFrame:
        if not self._there(self.folder):
            return self.spark.createDataFrame([], files.NOVEL).select(*(columns or ["*"]))
        return files.read_novels(self.spark, self.folder, columns)

    def ids(self) -> DataFrame:
        """(novel_id), in order."""
        return self.novels(["novel_id"]).distinct().orderBy("novel_id")

    def novel(self, novel_id: str) -> DataFrame:
        """One novel: its own folder or file is all that is read. An error if there is none."""
        name = novel_id.replace("/", "_")
        for path in (f"{self.folder}/{self._key(name, 'key')}", f"{self.folder}/{name}.json"):
            if self._there(path):
                return files.read_novels(self.spark, path).where(F.col("novel_id") == novel_id)
        raise FileNotFoundError(f"no novel {novel_id}")

    def exists(self, novel_id: str) -> bool:
        name = novel_id.replace("/", "_")
        return self._there(f"{self.folder}/{self._key(name, 'key')}") or self._there(f"{self.folder}/{name}.json")

    def to_ingest(self, novels: DataFrame, overwrite: bool = False, resume: bool = False) -> DataFrame:
        """The novels (novel_id, ...) that have to be read: those that aren't stored; with ``overwrite`` all; with ``resume`` also
        the stored ones whose progress is still there, as they weren't finished."""
        if resume:
            stored = self.ids().join(self.progress().select("novel_id").distinct(), "novel_id", "left_anti")
        elif overwrite:
            return novels
        else:
            stored = self.ids()
        return novels.join(stored, "novel_id", "left_anti")

    def save(self, novels: DataFrame) -> None:
        files.write_novels(novels, self.folder)

    # ---- progress

    def save_progress(self, rows: DataFrame) -> None:
        """Replaces the progress of the novels that ``rows`` (novel_id, chapter_index, chapter_id, title, summary, summary_status) has."""
        rows.select(*[f.split()[0] for f in PROGRESS.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_id").parquet(self.progress_folder)
        self.spark.catalog.refreshByPath(self.progress_folder)

    def progress(self, novel_id: str | None = None) -> DataFrame:
        if not self._there(self.progress_folder):
            return self.spark.createDataFrame([], PROGRESS)
        rows = self.spark.read.schema(PROGRESS).parquet(self.progress_folder)
        return rows if novel_id is None else rows.where(F.col("novel_id") == novel_id)

    def progress_exists(self, novel_id: str) -> bool:
        return self._there(f"{self.progress_folder}/{self._key(novel_id, 'novel_id')}")

    def delete_progress(self, novel_id: str) -> bool:
        """Whether there was any."""
        done = self._remove(f"{self.progress_folder}/{self._key(novel_id, 'novel_id')}")
        self.spark.catalog.refreshByPath(self.progress_folder)
        return done

    def checkpoint(self, chapters: DataFrame, summaries: DataFrame) -> DataFrame:
        """Saves what is done (novel_id, chapter_id, title, summary, summary_status) of the chapters, and returns how far each novel is done without a gap."""
        rows = chapters.select("novel_id", "chapter_id", "chapter_index").join(summaries.select("novel_id", "chapter_id", "title", "summary", "summary_status"), ["novel_id", "chapter_id"])
        kept = checkpointed(rows)
        self.save_progress(kept)
        return contiguous(chapters, kept.withColumn("item_pos", F.col("chapter_index").cast("bigint")))

    def publish(self, novels: DataFrame, chapters: DataFrame, partial: bool = False) -> list[str]:
        """Saves the novels whose chapters all have a summary in their progress, then drops that progress; the others are left
        as they are, or saved with their progress kept (partial). Returns the ids of the novels that were published."""
        left = pending(chapters.select("novel_id", "chapter_id", "chapter_index"), self.progress()).select("novel_id").distinct()
        ready = checkpointed(novels.join(left, "novel_id", "left_anti"))
        blank = ready.where(~not_blank("summary")).select("novel_id").limit(5).collect()
        if blank:
            raise RuntimeError("novels without a summary: " + ", ".join(r.novel_id for r in blank))
        self.save(novels if partial else ready)
        done = [r.novel_id for r in ready.select("novel_id").distinct().orderBy("novel_id").collect()]  # the novels of one publishing
        for novel_id in done:
            self.delete_progress(novel_id)
        return done

