"""Chunks for the vector store, and the store itself: parquet, one folder for each content type."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tomeflow.functions.text import col, truncate, volume_title
from tomeflow.operators.segment import paragraphs_b
from tomeflow.operators.volumes import NO_VOLUME

COLUMNS = ["chunk_id", "novel_id", "novel_title", "content", "content_type", "chapter_id", "chapter_index", "chapter_title", "volume_title", "metadata"]
RESERVED = ["novel_id", "novel_title", "content_type", "chapter_id", "chapter_index", "chapter_title", "volume_title"]


def _chunk(df: DataFrame, content_type: str, **columns: F.Column) -> DataFrame:
    types = {"chapter_index": "int", "metadata": "map<string,string>"}
    return df.select(*(columns.get(c, F.lit(content_type) if c == "content_type" else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in COLUMNS))


def build(novels: DataFrame, plots: DataFrame, chapters: DataFrame, last_summaries: DataFrame, max_chars: int = 4000, min_len: int = 100, paragraph_max: int = 500) -> DataFrame:
    """The chunks of all four levels. Paragraph chunks carry their paragraph_index in the metadata."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    titles = novels.select("novel_id", F.col("title").alias("novel_title"))
    overall = _chunk(
        novels.where(F.length("summary") > 0), "overall_summary", novel_id=F.col("novel_id"), novel_title=F.col("title"),
        chunk_id=F.concat("novel_id", F.lit("/overall/overall")), content=F.concat(F.lit("【全书总结】"), truncate("summary", max_chars)),
    )
    volume = F.coalesce("volume_title", F.lit(NO_VOLUME))
    plot = _chunk(
        plots.where(F.length("summary") > 0).join(titles, "novel_id"), "plot_summary", novel_id=F.col("novel_id"), novel_title=F.col("novel_title"), volume_title=volume,
        chunk_id=F.concat("novel_id", F.lit("/plot/v_"), F.col("plot_index")),
        content=F.concat(F.lit("【"), volume, F.lit("】"), blank("start_chapter"), F.lit(" - "), blank("end_chapter"), F.lit("\n"), truncate("summary", max_chars)),
    )
    own = dict(novel_id=F.col("novel_id"), novel_title=F.col("novel_title"), chapter_id=F.col("chapter_id"), chapter_index=F.col("chapter_index"), chapter_title=F.col("title"), volume_title=volume_title("title"))
    told = chapters.select("novel_id", "chapter_id", "chapter_index", "title").join(last_summaries.where(F.length("summary") > 0).select("novel_id", "chapter_id", "summary"), ["novel_id", "chapter_id"]).join(titles, "novel_id")
    chapter = _chunk(told, "chapter_summary", **own, chunk_id=F.concat("novel_id", F.lit("/chapter_summary/"), "chapter_id"), content=F.concat(F.lit("【"), blank("title"), F.lit("】"), truncate("summary", max_chars)))
    parts = chapters.where(F.length("content") > 0).join(titles, "novel_id").select("novel_id", "novel_title", "chapter_id", "chapter_index", "title", F.posexplode(paragraphs_b("content", min_len)).alias("p", "text"))
    paragraph = _chunk(
        parts, "paragraph", **own, chunk_id=F.concat("novel_id", F.lit("/paragraph/"), "chapter_id", F.lit("_p"), F.col("p")), content=truncate("text", paragraph_max),
        metadata=F.create_map(F.lit("paragraph_index"), F.col("p").cast("string")),
    )
    return overall.unionByName(plot).unionByName(chapter).unionByName(paragraph)


def flat_metadata() -> F.Column:
    """The reserved fields that aren't null, then the chunk's own entries of other names."""
    own = F.coalesce(F.col("metadata"), F.expr("CAST(map() AS map<string,string>)"))
    filled = F.map_filter(F.create_map(*(x for c in RESERVED for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(filled, F.map_filter(own, lambda k, _: ~F.map_contains_key(filled, k)))


def upserted(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``stored`` with the rows of ``new`` that have a vector in place of those with the same chunk_id; of several new ones, the last by ``order``."""
    fresh = new.where(F.size("embedding") > 0)
    last = fresh.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "chunk_id"]), order).alias("r")).select("chunk_id", "r.*")
    return stored.join(last.select("chunk_id"), "chunk_id", "left_anti").unionByName(last.select(*stored.columns))


def to_index(novels: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """The novels to be indexed: those without a chunk, or all."""
    return novels if force else novels.join(chunks.select("novel_id").distinct(), "novel_id", "left_anti")


def embedded(chunks: DataFrame, provider, text_col: str = "content") -> DataFrame:
    """Chunks with the provider's vectors, in Arrow batches; rows whose embedding failed are left out."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([provider.embed(t) or None for t in texts])

    return chunks.withColumn("embedding", embed(F.coalesce(col(text_col), F.lit("")))).where(F.size("embedding") > 0)


class ChunkStore:
    """A folder of parquet, partitioned by content type and novel, so that filters on them read nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _replace(self, df: DataFrame) -> None:
        """Only the partitions that ``df`` has are replaced."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content_type", "novel_id").parquet(self.path)

    def upsert(self, new: DataFrame, order: str = "chunk_id") -> None:
        from tomeflow.session import checkpointed

        fresh = new.where(F.size("embedding") > 0)
        if not self.exists():
            self._replace(upserted(fresh.limit(0), fresh, order))
            return
        touched = fresh.select("content_type", "novel_id").distinct()
        stored = self.read().join(touched, ["content_type", "novel_id"], "left_semi").select(*fresh.columns)
        self._replace(checkpointed(upserted(stored, fresh, order)))  # read in full before its folders are replaced

    def delete_novel(self, novel_id: str) -> None:
        kinds = [r[0] for r in self.read().where(F.col("novel_id") == novel_id).select("content_type").distinct().collect()]
        for kind in kinds:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/content_type={kind}/novel_id={_escaped(self.spark, novel_id)}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshByPath(self.path)

    def count(self, novel_id: str | None = None) -> int:
        return (self.read() if novel_id is None else self.read().where(F.col("novel_id") == novel_id)).count()


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def reindex(store: ChunkStore, chunks: DataFrame, provider, force: bool = False) -> DataFrame:
    """Embeds and stores the chunks of the novels that have none in the store, or of all (force), whose old chunks go first;
    returns (novel_id, stored, skipped): how many chunks each has now, and whether it was left as it was."""
    from tomeflow.session import checkpointed

    spark = store.spark
    novels = chunks.select("novel_id").distinct()
    there = store.read().select("novel_id").distinct() if store.exists() else spark.createDataFrame([], "novel_id string")
    skipped = checkpointed(there.limit(0) if force else novels.join(there, "novel_id", "left_semi"))
    if force:
        for row in checkpointed(novels.join(there, "novel_id", "left_semi")).collect():  # novels of one call
            store.delete_novel(row["novel_id"])
    fresh = chunks.join(skipped, "novel_id", "left_anti")
    store.upsert(checkpointed(embedded(fresh, provider)))
    counts = store.read().groupBy("novel_id").agg(F.count("*").alias("n"))
    return novels.join(counts, "novel_id", "left").join(skipped.withColumn("skipped", F.lit(True)), "novel_id", "left").select("novel_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("stored"), F.coalesce("skipped", F.lit(False)).alias("skipped"))


def record_vectors(novels: DataFrame, chapters: DataFrame, provider, max_chars: int = 4000) -> tuple[DataFrame, DataFrame]:
    """((novel_id, summary_embedding), (novel_id, chapter_id, embedding)): the provider's vectors of what is stored, cut to max_chars; null without text or vector."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in provider.embed(t)] or None if t else None for t in texts], index=texts.index, dtype=object)

    return novels.select("novel_id", embed(truncate("summary", max_chars)).alias("summary_embedding")), chapters.select("novel_id", "chapter_id", embed(truncate("content", max_chars)).alias("embedding"))
