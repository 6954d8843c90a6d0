"""Keyword, BM25, vector and hybrid retrieval.

Scores are ordered with a fixed tie-break, and only the best k rows leave the executors
(TakeOrderedAndProject). An empty query is rejected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tomeflow.functions.text import contains_any, keyword_count, non_empty, tokens, truncate
from tomeflow.functions.vector import cosine
from tomeflow.operators.segment import paragraphs_a

VECTOR_WEIGHT, KEYWORD_WEIGHT, CANDIDATES, FLOOR = 0.6, 0.4, 20, 0.001


def top(df: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def in_range(df: DataFrame, chapter_range: tuple[int, int] | None) -> DataFrame:
    """Chapters from the first to the last index, both included; a null index is in no range."""
    return df if chapter_range is None else df.where(F.col("chapter_index").between(*chapter_range))


def of_novel(df: DataFrame, novel_id: str | None) -> DataFrame:
    return df if not novel_id else df.where(F.col("novel_id") == novel_id)


def paragraphs(chapters: DataFrame, min_len: int = 60) -> DataFrame:
    """(novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, text)"""
    rows = chapters.where(F.length("content") > 0)
    return rows.select("novel_id", "chapter_id", "chapter_index", F.col("title").alias("chapter_title"), F.posexplode(paragraphs_a("content", min_len)).alias("paragraph_index", "text"))


def paragraph_keyword(chapters: DataFrame, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None, min_len: int = 60) -> DataFrame:
    rows = paragraphs(in_range(of_novel(chapters, novel_id), chapter_range), min_len).withColumn("score", keyword_count("text", query)).where("score > 0")
    return top(rows, k, "novel_id", "chapter_index", "chapter_id", "paragraph_index").select("novel_id", "chapter_id", "chapter_index", "chapter_title", "paragraph_index", "score", truncate("text", 300).alias("snippet"))


def chapter_content_keyword(chapters: DataFrame, query: str, k: int = 5, novel_id: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """exclude: chapter ids already found. They hold for all novels unless the table also has novel_id."""
    rows = of_novel(chapters, novel_id).withColumn("score", keyword_count("content", query)).where("score > 0")
    if exclude is not None:
        rows = rows.join(exclude, [c for c in ("novel_id", "chapter_id") if c in exclude.columns], "left_anti")
    best = top(rows, k, "novel_id", "chapter_index", "chapter_id")
    return best.select("novel_id", "chapter_id", F.col("title").alias("chapter_title"), "score", truncate("content", 300).alias("snippet"), F.lit("chapter_content").alias("source"))


def chapter_summary_keyword(summaries: DataFrame, chapters: DataFrame, query: str, k: int = 5, novel_id: str | None = None) -> DataFrame:
    """Titles come from the chapter, where it has one."""
    rows = of_novel(summaries, novel_id).where(F.length("summary") > 0).withColumn("score", keyword_count("summary", query)).where("score > 0")
    titles = chapters.select("novel_id", "chapter_id", F.col("title").alias("own_title"))
    best = top(rows, k, "novel_id", "chapter_id", "item_pos")
    named = best.join(titles, ["novel_id", "chapter_id"], "left")
    return named.select("novel_id", "chapter_id", F.coalesce(non_empty("own_title"), "title").alias("chapter_title"), "score", truncate("summary", 300).alias("snippet"), F.lit("chapter_summary").alias("source"), "item_pos")


def chapter_search(summaries: DataFrame, chapters: DataFrame, query: str, k: int = 5, novel_id: str | None = None, qualified_keys: bool = False) -> DataFrame:
    """Summary hits, then content hits of other chapters up to k, in two stages that aren't sorted together. (stage, rank, ...)"""
    order = lambda *c: F.row_number().over(Window.orderBy(F.col("score").desc(), *c))  # noqa: E731  over at most k rows
    first = chapter_summary_keyword(summaries, chapters, query, k, novel_id).withColumn("rank", order("novel_id", "chapter_id", "item_pos")).drop("item_pos").withColumn("stage", F.lit(1))
    seen = first.select(*(["novel_id", "chapter_id"] if qualified_keys else ["chapter_id"])).distinct()
    second = chapter_content_keyword(chapters, query, k, novel_id, seen).withColumn("rank", order("novel_id", "chapter_id")).withColumn("stage", F.lit(2))
    return first.unionByName(second).orderBy("stage", "rank").limit(k).select("stage", "rank", "novel_id", "chapter_id", "chapter_title", "score", "snippet", "source")


def novel_keyword(novels: DataFrame, plots: DataFrame, summaries: DataFrame, chapters: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Three times the hits in the overall summary, twice those in plots, once those in chapter summaries; where that is
    nothing, the hits in the first chapter. The snippet has the overall summary if hit, plots while there are
    fewer than two, chapter summaries while fewer than three, or else the first chapter."""
    hit = lambda c: keyword_count(c, query)
    parts = (
        novels.select("novel_id", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("pos"), (hit("summary") * 3).alias("points"), F.col("summary").alias("text"))
        .unionByName(plots.select("novel_id", F.lit(1).alias("level"), F.col("plot_index").cast("bigint").alias("pos"), (hit("summary") * 2).alias("points"), F.col("summary").alias("text")))
        .unionByName(summaries.select("novel_id", F.lit(2).alias("level"), F.col("item_pos").alias("pos"), hit("summary").alias("points"), F.col("summary").alias("text")))
        .where("points > 0")
    )
    # three texts of each level are all that a snippet can need, so no more are gathered
    ranked = parts.withColumn("n", F.row_number().over(Window.partitionBy("novel_id", "level").orderBy("pos")))
    scored = parts.groupBy("novel_id").agg(F.sum("points").cast("bigint").alias("points"))
    texts = ranked.where("n <= 3").groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("level", "pos", "text"))).alias("t"))
    level = lambda n: F.filter("t", lambda x: x["level"] == n)
    some = F.concat(level(0), F.slice(level(1), 1, 2 - F.size(level(0))))
    chosen = F.concat(some, F.slice(level(2), 1, 3 - F.size(some)))
    texts = texts.select("novel_id", F.array_join(F.transform(chosen, lambda x: x["text"]), "\n").alias("snippet"))
    opening = chapters.groupBy("novel_id").agg(F.min_by("content", F.struct("chapter_index", "chapter_id")).alias("content")).select("novel_id", hit("content").cast("bigint").alias("opening_points"), "content")
    rows = novels.select("novel_id", "title").join(scored, "novel_id", "left").join(opening, "novel_id", "left")
    rows = rows.withColumn("score", F.coalesce("points", "opening_points", F.lit(0).cast("bigint"))).where("score > 0")
    return top(rows, k, "novel_id").join(texts, "novel_id", "left").select("novel_id", "title", "score", truncate(F.coalesce("snippet", "content"), 400).alias("summary"))


def plot_keyword(plots: DataFrame, query: str, k: int = 5, novel_id: str | None = None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws(" ", blank("volume_title"), blank("start_chapter"), blank("end_chapter"), blank("summary"))
    rows = of_novel(plots, novel_id).where(F.length("summary") > 0).withColumn("score", keyword_count(text, query)).where("score > 0")
    return top(rows, k, "novel_id", "plot_index").select("novel_id", "plot_index", "volume_title", "start_chapter", "end_chapter", "score", truncate("summary", 500).alias("summary"))


def chapters_by_range(chapters: DataFrame, first_summaries: DataFrame, novel_id: str, start: int, end: int, query: str | None = None) -> DataFrame:
    """The chapters of a range with their summaries; a query must be in the title, the summary or the content's first 500 characters."""
    rows = in_range(of_novel(chapters, novel_id), (start, end)).join(first_summaries.select("novel_id", "chapter_id", "summary"), ["novel_id", "chapter_id"], "left")
    rows = rows.select("novel_id", "chapter_id", "chapter_index", F.col("title").alias("chapter_title"), F.coalesce("summary", F.lit("")).alias("summary"), truncate(F.coalesce("content", F.lit("")), 500).alias("content"))
    if query:
        q = F.lower(F.lit(query))
        rows = rows.where(F.lower(F.coalesce("chapter_title", F.lit(""))).contains(q) | F.lower("summary").contains(q) | F.lower("content").contains(q))
    return rows


def chapter_by_title(chapters: DataFrame, novel_id: str, text: str) -> DataFrame:
    """The first chapter whose title holds the text, with regard to case."""
    rows = of_novel(chapters, novel_id).where(F.col("title").contains(text))
    return rows.orderBy("chapter_index", "chapter_id").limit(1).select("novel_id", "chapter_id", "chapter_index", F.col("title").alias("chapter_title"))


def hierarchy(novels: DataFrame, plots: DataFrame, chapters: DataFrame, first_summaries: DataFrame, novel_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: overall summary, plots, number of chapters, and the chapters of the range, if one is given, else a warning."""
    book = of_novel(novels, novel_id).select("novel_id", "title", F.coalesce("summary", F.lit("")).alias("overall_summary"))
    plot_rows = of_novel(plots, novel_id).groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("plot_index", "volume_title", "start_chapter", "end_chapter", "summary"))).alias("plot_summaries"))
    count = of_novel(chapters, novel_id).groupBy("novel_id").agg(F.count("*").alias("chapter_count"))
    out = book.join(plot_rows, "novel_id", "left").join(count, "novel_id", "left").withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0).cast("bigint")))
    if start is None or end is None:
        empty = F.expr("CAST(array() AS array<struct<chapter_index:int,chapter_id:string,chapter_title:string,summary:string>>)")
        return out.select("*", empty.alias("chapters"), F.lit("Use chapter_start and chapter_end to get specific chapter summaries").alias("warning"))
    listed = chapters_by_range(chapters, first_summaries, novel_id, start, end).groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_id", "chapter_title", "summary"))).alias("chapters"))
    return out.join(listed, "novel_id", "left").select("*", F.lit(None).cast("string").alias("warning"))


# ---- BM25 -------------------------------------------------------------------------------------


def bm25_terms(paragraph_rows: DataFrame) -> DataFrame:
    """(novel_id, chapter_id, chapter_index, paragraph_index, term, tf, dl): the index; one group for each term of a paragraph."""
    key = ["novel_id", "chapter_id", "chapter_index", "paragraph_index"]
    rows = paragraph_rows.select(*key, tokens("text").alias("t")).withColumn("dl", F.size("t"))
    return rows.select(*key, "dl", F.explode("t").alias("term")).groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25_statistics(paragraph_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((novel_id, n, avgdl), (novel_id, term, df)). Terms are counted once a paragraph before they are shuffled."""
    rows = paragraph_rows.select("novel_id", tokens("text").alias("t"))
    sizes = rows.groupBy("novel_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    return sizes, rows.select("novel_id", F.explode(F.array_distinct("t")).alias("term")).groupBy("novel_id", "term").agg(F.count("*").alias("df"))


def bm25_idf(sizes: DataFrame, df: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(novel_id, term, df, idf, n, avgdl): negative idf replaced by epsilon times the novel's mean idf."""
    raw = df.join(sizes, "novel_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("novel_id").agg((F.avg("raw") * epsilon).alias("floor"))
    return raw.join(mean, "novel_id").select("novel_id", "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "n", "avgdl")


def bm25(chapters: DataFrame, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None, min_len: int = 60, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Each novel is ranked by its own statistics; its best 2k with a score above 0 are kept, then the range
    applies, then the best k of all. A query without tokens is searched as a keyword.

    Only paragraphs' counts of the query's own terms are joined, never the whole index.
    """
    spark = chapters.sparkSession
    terms = [r["t"] for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).collect()]
    if not terms:
        return paragraph_keyword(chapters, query, k, novel_id, chapter_range, min_len)
    rows = paragraphs(of_novel(chapters, novel_id), min_len)
    sizes, df = bm25_statistics(rows)
    raw = df.join(sizes, "novel_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # the mean over the vocabulary and the query's own terms in one pass
    wanted = sorted(set(terms))
    own = raw.groupBy("novel_id").agg((F.avg("raw") * 0.25).alias("floor"), F.max("avgdl").alias("avgdl"), *(F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"raw_{i}") for i, t in enumerate(wanted)))
    each = own.select("novel_id", "floor", "avgdl", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"raw_{i}").alias("raw")) for i, t in enumerate(wanted)))).alias("e")).where("e.raw IS NOT NULL")
    idf = each.select("novel_id", "avgdl", "e.term", F.when(F.col("e.raw") < 0, F.col("floor")).otherwise(F.col("e.raw")).alias("idf"))
    weight = F.element_at(F.create_map(*(F.lit(x) for t in sorted(set(terms)) for x in (t, float(terms.count(t))))), F.col("term"))
    # a paragraph with any of the terms holds one of the words or single characters among them
    plain = [t for t in sorted(set(terms)) if len(t) == 1 or t.isascii()]
    held = rows.where(contains_any(F.lower("text"), plain)).withColumn("t", tokens("text"))
    counts = F.transform(F.array(*map(F.lit, sorted(set(terms)))), lambda term: F.struct(term.alias("term"), F.size(F.filter("t", lambda x: x == term)).alias("tf")))
    hits = held.select("novel_id", "chapter_id", "chapter_index", "chapter_title", "paragraph_index", "text", F.size("t").alias("dl"), F.explode(counts).alias("c"))
    hits = hits.select("*", "c.term", "c.tf").drop("c").where("tf > 0")
    gain = F.col("idf") * weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    key = ["novel_id", "chapter_id", "chapter_index", "chapter_title", "paragraph_index"]
    scored = hits.join(idf, ["novel_id", "term"]).groupBy(*key).agg(F.sum(gain).alias("score"), F.first("text").alias("text")).where("score > 0")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("novel_id").orderBy(F.round("score", 9).desc(), "chapter_index", "chapter_id", "paragraph_index"))).where(F.col("n") <= 2 * k)
    rounded = in_range(best, chapter_range).withColumn("score", F.round("score", 6))
    return top(rounded, k, "novel_id", "chapter_index", "chapter_id", "paragraph_index").select(*key, "score", truncate("text", 300).alias("snippet"))


class Bm25Index:
    """A kept index: (novel_id, place of a paragraph, term, tf, dl) in buckets of terms, the paragraphs, and (novel_id, floor, avgdl)
    with (novel_id, term, idf). A query reads the buckets of its own terms and the paragraphs that it returns."""

    BUCKETS = 64

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(Bm25Index.BUCKETS)).cast("int").alias("bucket")

    def build(self, chapters: DataFrame, min_len: int = 60) -> None:
        """Replaces the index by that of ``chapters``."""
        rows = paragraphs(chapters, min_len)
        rows.write.mode("overwrite").parquet(f"{self.folder}/paragraphs")
        rows = self.spark.read.parquet(f"{self.folder}/paragraphs")
        terms = bm25_terms(rows)
        terms.select("*", self.bucket(F.col("term"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/terms")
        sizes, df = bm25_statistics(rows)
        bm25_idf(sizes, df).select("novel_id", "term", "idf", "avgdl", self.bucket(F.col("term"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/idf")

    def search(self, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """As ``bm25``. A query without tokens finds nothing."""
        asked = self.spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("w")).select("*", self.bucket(F.col("term"))).collect()
        if not asked:
            return self.spark.createDataFrame([], "novel_id string, chapter_id string, chapter_index int, chapter_title string, paragraph_index int, score double, snippet string")
        buckets, terms = sorted({r["bucket"] for r in asked}), [r["term"] for r in asked]
        own = lambda name: of_novel(self.spark.read.parquet(f"{self.folder}/{name}"), novel_id).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")
        weight = F.element_at(F.create_map(*(F.lit(x) for r in asked for x in (r["term"], float(r["w"])))), F.col("term"))
        key = ["novel_id", "chapter_id", "chapter_index", "paragraph_index"]
        gain = F.col("idf") * weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = own("terms").join(own("idf"), ["novel_id", "term"]).groupBy(*key).agg(F.sum(gain).alias("score")).where("score > 0")
        best = scored.withColumn("n", F.row_number().over(Window.partitionBy("novel_id").orderBy(F.round("score", 9).desc(), "chapter_index", "chapter_id", "paragraph_index"))).where(F.col("n") <= 2 * k)
        found = top(in_range(best, chapter_range).withColumn("score", F.round("score", 6)), k, "novel_id", "chapter_index", "chapter_id", "paragraph_index")
        texts = self.spark.read.parquet(f"{self.folder}/paragraphs").select("novel_id", "chapter_id", "chapter_title", "paragraph_index", "text")
        return texts.join(F.broadcast(found), ["novel_id", "chapter_id", "paragraph_index"]).select("novel_id", "chapter_id", "chapter_index", "chapter_title", "paragraph_index", "score", truncate("text", 300).alias("snippet"))  # k rows are broadcast


# ---- vectors ------------------------------------------------------------------------------------


def vector_search(chunks: DataFrame, query_vector: list[float], k: int = 5, content_type: str | None = None, novel_id: str | None = None, volume_title: str | None = None) -> DataFrame:
    """The k chunks most similar to a vector, all compared; falsy filters don't filter. Chunks without a vector aren't stored."""
    rows = chunks.where(F.size("embedding") > 0)
    for name, value in (("content_type", content_type), ("novel_id", novel_id), ("volume_title", volume_title)):
        if value:
            rows = rows.where(F.col(name) == value)
    scored = rows.withColumn("score", F.round(cosine("embedding", F.array(*(F.lit(float(x)) for x in query_vector))), 6))
    return top(scored, k, "novel_id", "chunk_id", "vec_id").drop("embedding")


def vector_paragraphs(chunks: DataFrame, query_vector: list[float], k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None, prefilter: bool = False) -> DataFrame:
    """The best 2k paragraphs, of these the ones in the range, of these the best k. prefilter: the range first."""
    rows = in_range(chunks, chapter_range) if prefilter else chunks
    found = in_range(vector_search(rows, query_vector, 2 * k, "paragraph", novel_id), chapter_range)
    return top(found, k, "novel_id", "chunk_id", "vec_id")


def fuse(vectors: DataFrame, keywords: DataFrame, key: list[str], k: int = 5, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT, candidates: int = CANDIDATES) -> DataFrame:
    """(key, vector_score, keyword_score, score): both sides' best ``candidates``, each scaled by its largest score, in a weighted sum.

    With no keyword hit at all, the vector hits stand as they are. At most 2 * candidates rows meet in one task.
    """
    side = lambda df, name: top(df.select(*key, "score"), candidates, *key).select(*key, (F.col("score") / F.greatest(F.max("score").over(Window.partitionBy()), F.lit(FLOOR))).alias(name), F.col("score").alias(f"raw_{name}"))
    both = side(vectors, "v").join(side(keywords, "b"), key, "full")
    any_keyword = F.max(F.col("b").isNotNull()).over(Window.partitionBy())
    score = F.when(any_keyword, vector_weight * F.coalesce("v", F.lit(0.0)) + keyword_weight * F.coalesce("b", F.lit(0.0))).otherwise(F.col("raw_v"))
    return top(both.withColumn("score", F.round(score, 6)), k, *key).select(*key, F.coalesce("raw_v", F.lit(0.0)).alias("vector_score"), F.coalesce(F.col("raw_b").cast("double"), F.lit(0.0)).alias("keyword_score"), "score")


def rerank(candidates: DataFrame, query: str, scorer, k: int, text_col: str = "snippet", ties: tuple[str, ...] = ()) -> DataFrame:
    """Candidates by a model's score of (query, text); with no model, or one that fails, they keep their order. At most the
    fused candidates meet in one task."""
    if scorer is None:
        return top(candidates, k, *ties)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(x) for x in scorer.score([query] * len(texts), ["" if t is None else t for t in texts])], index=texts.index, dtype="float64")
        except Exception:  # a model's failure of any kind
            return pd.Series([None] * len(texts), index=texts.index, dtype="float64")

    rows = candidates.withColumn("rerank_score", scored(text_col))
    failed = F.max(F.col("rerank_score").isNull() | F.isnan("rerank_score")).over(Window.partitionBy())
    return top(rows.withColumn("_by", F.when(failed, F.col("score")).otherwise(F.col("rerank_score"))), k, *ties, score="_by").drop("_by")


def hit_indices(hits: DataFrame, chapters: DataFrame) -> DataFrame:
    """(novel_id, chapter_id, chapter_index): the first index of each chapter that was hit; hits of no chapter vanish."""
    first = chapters.groupBy("novel_id", "chapter_id").agg(F.min("chapter_index").alias("chapter_index"))
    return hits.select("novel_id", "chapter_id").distinct().join(first, ["novel_id", "chapter_id"])


# ---- by meaning, with vectors of the texts themselves


def with_vectors(rows: DataFrame, text_col: str, provider, name: str = "_v", stored: str | None = None) -> DataFrame:
    """``rows`` with the provider's vector of a text, or the stored one where there is one; texts without a vector are left out."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in provider.embed(t)] or None if t else None for t in texts], index=texts.index, dtype=object)

    text = F.col(text_col) if stored is None else F.when(F.coalesce(F.size(stored), F.lit(0)) <= 0, F.col(text_col))
    vector = embed(text) if stored is None else F.coalesce(F.when(F.size(stored) > 0, F.col(stored).cast("array<double>")), embed(text))
    return rows.withColumn(name, vector).where(F.size(name) > 0)


def novel_by_meaning(novels: DataFrame, query_vector: list[float], k: int = 5, provider=None) -> DataFrame:
    """(novel_id, title, score, summary, features, characters) by the summary's stored vector, or the provider's where none is stored."""
    rows = novels.where(F.length("summary") > 0)
    rows = rows.withColumn("_v", F.col("summary_embedding")).where(F.size("_v") > 0) if provider is None else with_vectors(rows, "summary", provider, stored="summary_embedding")
    return semantic(rows, "_v", query_vector, k, "novel_id").select("novel_id", "title", "score", truncate("summary", 400).alias("summary"), "features", "characters")


def chapter_by_meaning(chapters: DataFrame, query_vector: list[float], k: int = 5, novel_id: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Chapters with content by their stored vector. exclude: as for words."""
    rows = of_novel(chapters, novel_id).where(F.length("content") > 0)
    if exclude is not None:
        rows = rows.join(exclude, [c for c in ("novel_id", "chapter_id") if c in exclude.columns], "left_anti")
    best = semantic(rows, "embedding", query_vector, k, "novel_id", "chapter_index", "chapter_id")
    return best.select("novel_id", "chapter_id", F.col("title").alias("chapter_title"), "score", truncate("content", 300).alias("snippet"), F.lit("chapter_content").alias("source"))


def paragraph_by_meaning(chapters: DataFrame, query_vector: list[float], provider, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None, min_len: int = 60) -> DataFrame:
    """Paragraphs by the provider's vectors of them, made in Arrow batches; every paragraph of the range is embedded."""
    rows = with_vectors(paragraphs(in_range(of_novel(chapters, novel_id), chapter_range), min_len), "text", provider)
    best = semantic(rows, "_v", query_vector, k, "novel_id", "chapter_index", "chapter_id", "paragraph_index")
    return best.select("novel_id", "chapter_id", "chapter_index", "chapter_title", "paragraph_index", "score", truncate("text", 300).alias("snippet"))


def plot_by_meaning(plots: DataFrame, query_vector: list[float], provider, k: int = 5, novel_id: str | None = None) -> DataFrame:
    rows = with_vectors(of_novel(plots, novel_id).where(F.length("summary") > 0), "summary", provider)
    best = semantic(rows, "_v", query_vector, k, "novel_id", "plot_index")
    return best.select("novel_id", "plot_index", "volume_title", "start_chapter", "end_chapter", "score", truncate("summary", 500).alias("summary"))


def cosine_to(column: str, query_vector: list[float]) -> Column:
    return cosine(column, F.array(*(F.lit(float(x)) for x in query_vector)))


def semantic(df: DataFrame, vector_col: str, query_vector: list[float], k: int, *ties: str) -> DataFrame:
    """Rows by the similarity of a stored vector; rows without one are left out."""
    return top(df.where(F.size(vector_col) > 0).withColumn("score", F.round(cosine_to(vector_col, query_vector), 6)), k, *ties).drop(vector_col)


def nearest_of_each(df: DataFrame, vector_col: str, query_vector: list[float], key: list[str]) -> DataFrame:
    """(key, score): the best similarity of any of a key's rows, all compared, so that copies take no other key's place."""
    rows = df.where(F.size(vector_col) > 0).select(*key, F.round(cosine_to(vector_col, query_vector), 6).alias("score"))
    return rows.groupBy(*key).agg(F.max("score").alias("score"))
