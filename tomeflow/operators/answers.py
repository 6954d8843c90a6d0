"""Compositions of searches that gather what a question needs. Each is lazy up to its own checks of whether there is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tomeflow.functions.text import confident, extract_keywords, non_empty, question_kind, string_array, truncate
from tomeflow.operators import search
from tomeflow.sources.library import Library

CAPS = {"overview": 3, "plot": 5, "chapter": 8, "paragraph": 15}
ENOUGH = 5


def novels_for(lib: Library, query: str, k: int = 5) -> DataFrame:
    return search.novel_keyword(lib.novels, lib.plots, lib.summaries, lib.chapters_with("chapter_index", "content"), query, k)


recommended = novels_for


def chapters_for(lib: Library, query: str, k: int = 5, novel_id: str | None = None, qualified_keys: bool = False) -> DataFrame:
    return search.chapter_search(lib.summaries, lib.chapters, query, k, novel_id, qualified_keys)


def paragraphs_for(lib: Library, query: str, k: int = 5, novel_id: str | None = None, chapter_range: tuple[int, int] | None = None) -> DataFrame:
    return search.paragraph_keyword(lib.chapters, query, k, novel_id, chapter_range)


def novel_summary(lib: Library) -> DataFrame:
    """(novel_id, summary): the stored one, else the first chapter's beginning."""
    opening = lib.chapters_with("chapter_index", "content").groupBy("novel_id").agg(F.min_by("content", F.struct("chapter_index", "chapter_id")).alias("opening"))
    return lib.novels.select("novel_id", "summary").join(opening, "novel_id", "left").select("novel_id", F.coalesce(non_empty("summary"), truncate("opening", 800), F.lit("")).alias("summary"))


def classified(questions: DataFrame, text_col: str) -> DataFrame:
    return questions.withColumn("kind", question_kind(text_col))


def plot_ranges(plots: DataFrame, chapters: DataFrame) -> DataFrame:
    """(novel_id, plot_index, first_index, last_index): the last chapter of the novel whose title, or id, holds each end's text.

    The join is on the novel, so no pair of different novels is ever made.
    """
    titles = chapters.select("novel_id", "chapter_index", "chapter_id", F.coalesce("title", F.lit("")).alias("title"))
    joined = plots.select("novel_id", "plot_index", "start_chapter", "end_chapter").join(titles, "novel_id")
    at = lambda c: F.max(F.when((F.length(c) > 0) & (F.col("title").contains(F.col(c)) | (F.col("chapter_id") == F.col(c))), F.col("chapter_index")))
    return joined.groupBy("novel_id", "plot_index").agg(at("start_chapter").alias("first_index"), at("end_chapter").alias("last_index")).where("first_index IS NOT NULL AND last_index IS NOT NULL")


def _leveled(level: str, df: DataFrame, text_col: str, cap: int) -> DataFrame:
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    rows = df.select(F.lit(level).alias("level"), F.col("novel_id"), have("chapter_id").alias("chapter_id"), (F.col("paragraph_index") if "paragraph_index" in df.columns else F.lit(None).cast("int")).alias("paragraph_index"), F.col("score").cast("double").alias("score"), F.col(text_col).alias("text"))
    return rows.limit(cap)


def comprehensive(lib: Library, question: str, query: str, novel_id: str | None = None, k: int = 10, recall: list[str] | None = None) -> DataFrame:
    """(level, novel_id, chapter_id, paragraph_index, score, text): hits of all four levels; recall adds paragraphs of more keywords."""
    kind = lib.spark.range(1).select(question_kind(F.lit(question)).alias("k")).first()["k"]
    paras = paragraphs_for(lib, query, k, novel_id)
    if recall and kind == "listing":
        paras = with_recall(paras, keyword_recall(lib, recall, novel_id))
    parts = [
        _leveled("overview", search.top(search.of_novel(novels_for(lib, query, k), novel_id), CAPS["overview"], "novel_id"), "summary", CAPS["overview"]),
        _leveled("plot", search.plot_keyword(lib.plots, query, k, novel_id), "summary", CAPS["plot"]),
        _leveled("chapter", chapters_for(lib, query, k, novel_id), "snippet", CAPS["chapter"]),
        _leveled("paragraph", paras, "snippet", CAPS["paragraph"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sufficiency(hits: DataFrame) -> DataFrame:
    """(level, n, total, enough)"""
    counts = hits.groupBy("level").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("enough", F.col("total") >= ENOUGH)


PARAGRAPH = ["novel_id", "chapter_id", "paragraph_index"]


def with_recall(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found``, then the paragraphs of ``more`` that it doesn't have, each by score."""
    rest = more.join(found.select(*PARAGRAPH), PARAGRAPH, "left_anti").select(*found.columns)
    both = found.withColumn("_stage", F.lit(1)).unionByName(rest.withColumn("_stage", F.lit(2)))
    return both.orderBy("_stage", F.col("score").desc(), "novel_id", "chapter_index", "chapter_id", "paragraph_index").drop("_stage")


def keyword_recall(lib: Library, keywords: list[str], novel_id: str | None = None, k: int = 20) -> DataFrame:
    """Paragraphs of up to five keywords, each once, with the first keyword's score."""
    parts = [paragraphs_for(lib, q, k, novel_id).withColumn("query_no", F.lit(i)) for i, q in enumerate([q for q in keywords if q][:5])]
    if not parts:
        raise ValueError("no keyword")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*PARAGRAPH).orderBy("query_no"))).where("n = 1").drop("n", "query_no")


def keywords_of(lib: Library, question: str) -> list[str]:
    return lib.spark.range(1).select(extract_keywords(F.lit(question)).alias("k")).first()["k"]


def rewritten(lib: Library, queries: list[str], novel_id: str | None = None, k: int = 5, paragraphs: int = 15, chapters: int = 10) -> DataFrame:
    """Hits of up to five sub-queries, paragraphs and chapters each once, capped."""
    paras = keyword_recall(lib, queries, novel_id, k)
    chaps = None
    for q in [q for q in queries if q][:5]:
        one = chapters_for(lib, q, k, novel_id, True).select("novel_id", "chapter_id", "score", "snippet")
        chaps = one if chaps is None else chaps.unionByName(one)
    best = chaps.groupBy("novel_id", "chapter_id").agg(F.max("score").alias("score"), F.max_by("snippet", F.struct("score", "snippet")).alias("snippet"))
    return _leveled("paragraph", search.top(paras, paragraphs, *PARAGRAPH), "snippet", paragraphs).unionByName(_leveled("chapter", search.top(best, chapters, "novel_id", "chapter_id"), "snippet", chapters))


def answer(lib: Library, question: str, query: str, provider, overview: int = 3, chapters: int = 5, paragraphs: int = 10) -> DataFrame:
    """(step, answer, confident): overviews, then chapters, then paragraphs are given to the provider until an answer is sure."""
    steps = [("overview", novels_for(lib, query, overview), "summary"), ("chapter", chapters_for(lib, query, chapters), "snippet"), ("paragraph", paragraphs_for(lib, query, paragraphs), "snippet")]
    rows = []
    for name, hits, text in steps:
        found = [r[0] or "" for r in hits.select(text).collect()]  # at most ten texts of at most 400 characters
        reply = str(provider.analyze_plot(f"{question}\n" + "\n".join(f"{i + 1}. {t}" for i, t in enumerate(found))).get("summary", "")) if found else ""
        sure = lib.spark.range(1).select(confident(F.lit(reply)).alias("c")).first()["c"]
        rows.append((name, reply, bool(sure)))
        if sure:
            break
    return lib.spark.createDataFrame(rows, "step string, answer string, confident boolean")


def hierarchical(lib: Library, query: str, novel_id: str | None = None, overviews: int = 3, plots: int = 5, chapters: int = 10, paragraphs: int = 15) -> DataFrame:
    """From overviews to plots to the chapters of their ranges to these chapters' paragraphs; rows as in ``comprehensive``."""
    top_novels = search.of_novel(novels_for(lib, query, overviews), novel_id)
    top_plots = search.plot_keyword(lib.plots, query, plots, novel_id)
    ranges = plot_ranges(top_plots, lib.chapters_with("chapter_index", "title"))
    within = lib.chapters.join(ranges.select("novel_id", "first_index", "last_index"), "novel_id").where(F.col("chapter_index").between(F.col("first_index"), F.col("last_index"))).select(*lib.chapters.columns).dropDuplicates(["novel_id", "chapter_id"])
    told = search.chapter_summary_keyword(lib.last_summaries.join(within.select("novel_id", "chapter_id"), ["novel_id", "chapter_id"], "left_semi"), lib.chapters, query, chapters)
    paras = search.paragraph_keyword(within, query, paragraphs)
    return (
        _leveled("overview", top_novels, "summary", overviews).unionByName(_leveled("plot", top_plots, "summary", plots))
        .unionByName(_leveled("chapter", told, "snippet", chapters)).unionByName(_leveled("paragraph", paras, "snippet", paragraphs))
    )


def context(hits: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(level, text): each level's hits numbered and joined, cut to max_chars. At most the caps' rows a level."""
    listed = hits.groupBy("level").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "novel_id", "chapter_id", "paragraph_index", "text"))).alias("h"))
    lines = F.transform("h", lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(h["text"], F.lit(""))))
    return listed.select("level", truncate(F.array_join(lines, "\n"), max_chars).alias("text"))


def sub_queries(lib: Library, question: str, provider, n: int = 5) -> list[str]:
    """The provider's sub-queries, if it gives an array of strings, else the question alone."""
    try:
        reply = provider.analyze_plot(question)
        text = str(reply.get("summary") or reply.get("answer") or "")
    except Exception:  # a provider's failure of any kind
        text = ""
    found = lib.spark.range(1).select(string_array(F.lit(text), n).alias("q")).first()["q"]
    return [q for q in found or [] if q] or [question]


LEVELS = [("overview", "high"), ("plot", "medium"), ("chapter", "medium"), ("paragraph", "low")]


def answered_in_steps(lib: Library, question: str, query: str, provider, novel_id: str | None = None) -> DataFrame:
    """(step_no, step, answer, context_size, results, confidence): the levels of ``hierarchical`` from the top, each level's texts given
    to the provider, until an answer is sure; its row has a confidence, and rows before it have none. If none is sure, the last row's is "low"."""
    hits = hierarchical(lib, query, novel_id)
    texts = {}
    for r in hits.collect():  # at most the caps' rows
        texts.setdefault(r["level"], []).append(r["text"] or "")
    rows = []
    for i, (level, confidence) in enumerate(LEVELS):
        found = texts.get(level, [])
        given = "\n\n".join(t for t in found if t)
        reply = ""
        if given:
            try:
                told = provider.analyze_plot(f"{question}\n\n{given}")
                reply = str(told.get("summary") or told.get("answer") or "")
            except Exception:  # a provider's failure of any kind
                reply = ""
        sure = bool(lib.spark.range(1).select(confident(F.lit(reply)).alias("c")).first()["c"])
        rows.append((i + 1, level, reply if sure else "", len(given), len(found), confidence if sure else "low" if i == len(LEVELS) - 1 else None))
        if sure:
            break
    return lib.spark.createDataFrame(rows, "step_no int, step string, answer string, context_size int, results int, confidence string")
