"""The queries over the test tables. Their SQL is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomeflow.functions import html, text as T
from tomeflow.operators import access, answers, audit, chunks, cleaning, export, progress, search, segment, summarize, volumes
from tomeflow.plans import oracle
from tomeflow.plans.oracle import ADS, FINGERPRINTS, KEYWORD, KINDS, NOVEL, PATTERNS, TERMS, TITLE, WEAK, WORD
from tomeflow.providers import OpeningProvider
from tomeflow.sources.library import Library, latest
from tomeflow.streaming.ingest import segmented

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: f(Library(spark, folder))
    return f


# ---- keyword search


@query
def paragraph_keyword_topk(lib: Library) -> DataFrame:
    return search.paragraph_keyword(lib.chapters, KEYWORD, 20)


@query
def chapter_content_keyword(lib: Library) -> DataFrame:
    return search.chapter_content_keyword(lib.chapters, WORD, 10)


@query
def chapter_summary_keyword(lib: Library) -> DataFrame:
    return search.chapter_summary_keyword(lib.summaries, lib.chapters, KEYWORD, 20)


@query
def chapter_search_fallback(lib: Library) -> DataFrame:
    return search.chapter_search(lib.summaries, lib.chapters, TITLE, 12)


@query
def novel_weighted_keyword(lib: Library) -> DataFrame:
    return answers.novels_for(lib, KEYWORD, 10)


@query
def plot_keyword(lib: Library) -> DataFrame:
    return search.plot_keyword(lib.plots, KEYWORD, 10)


@query
def chapters_by_range(lib: Library) -> DataFrame:
    return search.chapters_by_range(lib.chapters, lib.first_summaries, NOVEL, 2, 30, KEYWORD)


@query
def chapter_by_title(lib: Library) -> DataFrame:
    return search.chapter_by_title(lib.chapters, NOVEL, TITLE)


@query
def novel_hierarchy(lib: Library) -> DataFrame:
    rows = search.hierarchy(lib.novels, lib.plots, lib.chapters, lib.first_summaries, NOVEL, 1, 6)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(text(x[f]) for f in fields))), "\n")
    return rows.select(
        "novel_id", "title", "overall_summary", "chapter_count", "warning", lines("plot_summaries", "plot_index", "volume_title", "start_chapter", "end_chapter", "summary").alias("plots"),
        lines("chapters", "chapter_index", "chapter_id", "chapter_title", "summary").alias("chapters"),
    )


@query
def novel_hierarchy_overview(lib: Library) -> DataFrame:
    rows = search.hierarchy(lib.novels, lib.plots, lib.chapters, lib.first_summaries, NOVEL)
    return rows.select("novel_id", "title", "overall_summary", F.size("plot_summaries").alias("n_plots"), "chapter_count", "warning")


# ---- segmentation


@query
def split_paragraphs_a(lib: Library) -> DataFrame:
    return search.paragraphs(lib.chapters).drop("chapter_title")


@query
def split_paragraphs_b(lib: Library) -> DataFrame:
    return lib.chapters.where(F.length("content") > 0).select("novel_id", "chapter_id", F.posexplode(segment.paragraphs_b("content")).alias("paragraph_index", "text"))


@query
def segment_pack(lib: Library) -> DataFrame:
    return lib.chapters.where("content IS NOT NULL").select("novel_id", "chapter_id", F.posexplode(segment.segments("content", 800)).alias("segment_index", "text"))


@query
def item_pack(lib: Library) -> DataFrame:
    return lib.table("chapter_task_states").select("state_id", F.posexplode(segment.packed(F.filter("segment_texts", lambda x: x.isNotNull()), 1500)).alias("pos", "text"))


@query
def segment_length_stats(lib: Library) -> DataFrame:
    rows = lib.table("chapter_task_states").select("novel_id", F.explode("segment_texts").alias("s"))
    return rows.where("s IS NOT NULL").groupBy("novel_id").agg(F.count("*").alias("n"), F.min(F.length("s")).alias("shortest"), F.max(F.length("s")).alias("longest"), F.round(F.avg(F.length("s")), 6).alias("mean"))


@query
def txt_chapters(lib: Library) -> DataFrame:
    rows = lib.table("raw_documents").where("parts IS NULL AND content IS NOT NULL").select("raw_id", "content")
    return segment.txt_chapters(rows, "content")


@query
def epub_chapters(lib: Library) -> DataFrame:
    rows = lib.table("raw_documents").where("parts IS NOT NULL").select("raw_id", "toc", "parts")
    return segment.epub_chapters(rows, "toc", "parts")


@query
def segmented_documents(lib: Library) -> DataFrame:
    return segmented(lib.table("raw_documents")).select("raw_id", "novel_id", "chapter_index", "chapter_id")


@query
def chapter_headings(lib: Library) -> DataFrame:
    return lib.chapters_with("content").select("novel_id", "chapter_id", T.heading("content").alias("heading")).where("heading IS NOT NULL")


@query
def volume_titles(lib: Library) -> DataFrame:
    return lib.plots.select("novel_id", "plot_index", T.volume_title("volume_title").alias("volume"))


@query
def volume_groups(lib: Library) -> DataFrame:
    # every fifth title opens a volume, as few of the test titles do
    titled = lib.chapters.withColumn("title", F.when(F.col("chapter_index") % 5 == 0, F.concat(F.lit("第"), (F.col("chapter_index") / 5 + 1).cast("int"), F.lit("卷 "), F.coalesce("title", F.lit("")))).otherwise(F.coalesce("title", F.lit(""))))
    return volumes.volume_groups(titled, lib.last_summaries).select("novel_id", "run", "volume_title", "start_chapter", "end_chapter", F.array_join("items", "\n").alias("items"))


@query
def chapter_metadata(lib: Library) -> DataFrame:
    m = segment.with_default_metadata("metadata", "chapter_index", "title")
    return lib.chapters.select("novel_id", "chapter_id", m["chapter_index"].alias("meta_index"), m["chapter_title"].alias("meta_title"), F.size(m).alias("n"))


@query
def novel_slugs(lib: Library) -> DataFrame:
    return lib.novels.select("novel_id", T.slugify("title").alias("slug"))


# ---- HTML and cleaning


def _pages(lib: Library) -> DataFrame:
    paras = F.filter(F.split("content", "\n"), lambda p: T.strip(p) != "")
    return lib.chapters.where("content IS NOT NULL AND title IS NOT NULL").select("novel_id", "chapter_id", "chapter_index", html.chapter_page("title", paras).alias("page"))


@query
def html_pages(lib: Library) -> DataFrame:
    return _pages(lib).select("novel_id", "chapter_id", "page")


@query
def html_strip(lib: Library) -> DataFrame:
    return _pages(lib).select("novel_id", "chapter_id", html.page_text("page").alias("text"))


@query
def html_paragraphs(lib: Library) -> DataFrame:
    return _pages(lib).select("novel_id", "chapter_id", F.posexplode(html.paragraphs("page")).alias("pos", "text"))


@query
def html_title(lib: Library) -> DataFrame:
    return _pages(lib).select("novel_id", "chapter_id", html.title("page", "chapter_index").alias("title"))


def _lines(lib: Library) -> DataFrame:
    return lib.chapters.select("novel_id", "chapter_id", F.posexplode(F.filter(F.transform(F.split("content", "\n"), T.strip), lambda x: x != "")).alias("index", "text"))


@query
def ad_rule_filter(lib: Library) -> DataFrame:
    return _lines(lib).where(cleaning.is_ad("text", [*cleaning.AD_WORDS, *ADS]))


@query
def suspicious_filter(lib: Library) -> DataFrame:
    rows = _lines(lib)
    total = rows.groupBy("novel_id", "chapter_id").agg(F.count("*").alias("total"))
    return rows.join(total, ["novel_id", "chapter_id"]).where(cleaning.is_suspicious("text", "index", "total", [*cleaning.WEAK_WORDS, *WEAK])).drop("total")


@query
def clean_chapters(lib: Library) -> DataFrame:
    return cleaning.clean(_lines(lib), ["novel_id", "chapter_id"])


# ---- chunks and export


@query
def chunk_build(lib: Library) -> DataFrame:
    return chunks.build(lib.novels, lib.plots, lib.chapters, lib.last_summaries).select("chunk_id", "novel_title", "content", "content_type", "chapter_index", "volume_title")


@query
def chunk_count_by_type(lib: Library) -> DataFrame:
    return lib.chunks.groupBy("content_type").agg(F.count("*").alias("n"))


@query
def chunk_totals(lib: Library) -> DataFrame:
    return lib.chunks.groupBy("novel_id").agg(F.count("*").alias("n"), F.sum((F.coalesce(F.size("embedding"), F.lit(-1)) <= 0).cast("bigint")).alias("skipped"))


@query
def chunk_metadata(lib: Library) -> DataFrame:
    m = chunks.flat_metadata()
    return lib.chunks.select("vec_id", m["novel_id"].alias("m_novel"), m["chapter_index"].alias("m_index"), m["site"].alias("m_site"), F.size(m).alias("n"))


@query
def chunk_upsert(lib: Library) -> DataFrame:
    early, late = lib.chunks.where("chunk_id IS NOT NULL AND vec_id % 2 = 0 AND embedding IS NOT NULL"), lib.chunks.where("chunk_id IS NOT NULL")
    stored = latest(early, ["chunk_id"], "vec_id")
    return chunks.upserted(stored, late, "vec_id").select("chunk_id", "vec_id", "content_type")


@query
def reindex_pending(lib: Library) -> DataFrame:
    return chunks.to_index(lib.novels, lib.chunks.where("content_type = 'overall_summary'")).select("novel_id")


@query
def export_chunks(lib: Library) -> DataFrame:
    return export.export_chunks(lib.novels, lib.chapters).select("id", "content", "content_type", "source_id", "source_title", F.col("metadata")["chapter_index"].alias("meta_index"), "created_at")


@query
def export_list(lib: Library) -> DataFrame:
    return export.novel_list(lib.novels)


# ---- vectors and BM25


def _probe(lib: Library) -> list[float]:
    """The vector of the first usable chunk: one row, as a caller's own query vector would be."""
    return list(lib.chunks.where("size(embedding) = 64").orderBy("vec_id").select("embedding").first()[0])


@query
def vector_cosine_topk(lib: Library) -> DataFrame:
    return search.vector_search(lib.chunks, _probe(lib), 20).select("vec_id", "chunk_id", "score")


@query
def vector_filtered_topk(lib: Library) -> DataFrame:
    return search.vector_search(lib.chunks, _probe(lib), 10, "chapter_summary", NOVEL).select("vec_id", "chunk_id", "score")


@query
def vector_paragraph_range(lib: Library) -> DataFrame:
    return search.vector_paragraphs(lib.chunks, _probe(lib), 15, NOVEL, (0, 20)).select("vec_id", "chunk_id", "chapter_index", "score")


@query
def novel_semantic(lib: Library) -> DataFrame:
    return search.semantic(lib.novels.select("novel_id", "title", "summary_embedding"), "summary_embedding", _probe(lib), 10, "novel_id")


@query
def tokenize_explode(lib: Library) -> DataFrame:
    rows = lib.novels.where("summary IS NOT NULL").select("novel_id", F.posexplode(T.tokens("summary")).alias("pos", "token"))
    return rows


@query
def bm25_df(lib: Library) -> DataFrame:
    sizes, df = search.bm25_statistics(search.paragraphs(lib.chapters))
    return search.bm25_idf(sizes, df).select("novel_id", "term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(lib: Library) -> DataFrame:
    return search.bm25(lib.chapters, TERMS, 20)


@query
def hybrid_fusion(lib: Library) -> DataFrame:
    key = ["novel_id", "chapter_id"]
    vectors = search.nearest_of_each(lib.table("chapters").where("size(embedding) = 64"), "embedding", _probe(lib), key)
    keywords = lib.chapters.select(*key, T.keyword_count("content", KEYWORD).alias("score")).where("score > 0")
    return search.fuse(vectors, keywords, key, 20)


@query
def hybrid_paragraphs(lib: Library) -> DataFrame:
    """Paragraphs' vectors with BM25, as a search of paragraphs does."""
    key = ["novel_id", "chapter_id", "paragraph_index"]
    number = F.coalesce(F.try_element_at("metadata", F.lit("paragraph_index")).cast("int"), F.regexp_extract("chunk_id", r"_p(\d+)$", 1).try_cast("int"))
    rows = lib.chunks.where("size(embedding) = 64 AND content_type = 'paragraph'").withColumn("paragraph_index", number).where("paragraph_index IS NOT NULL")
    return search.fuse(search.nearest_of_each(rows, "embedding", _probe(lib), key), search.bm25(lib.chapters, TERMS, search.CANDIDATES), key, 20)


@query
def chapter_semantic(lib: Library) -> DataFrame:
    rows = lib.chapters_with("chapter_index", "title", "content", "embedding").where("size(embedding) = 64")
    return search.chapter_by_meaning(rows, _probe(lib), 10).select("novel_id", "chapter_id", "score", "snippet")


@query
def hit_indices(lib: Library) -> DataFrame:
    return search.hit_indices(search.chapter_summary_keyword(lib.summaries, lib.chapters, KEYWORD, 20), lib.chapters_with("chapter_index"))


@query
def export_with_vectors(lib: Library) -> DataFrame:
    chapters = lib.chapters_with("chapter_index", "title", "content", "metadata", "embedding")
    return export.export_chunks(lib.novels, chapters, True, True).select("id", "content_type", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n_numbers"))


@query
def error_decisions(lib: Library) -> DataFrame:
    rows = lib.table("chapter_task_states").select("state_id", F.explode("segment_errors").alias("segment_no", "v"))
    return rows.select("state_id", "segment_no", T.error_decision("v").alias("d")).select("state_id", "segment_no", "d.action", "d.reason")


# ---- audit


def _prints(lib: Library) -> DataFrame:
    rows = lib.spark.createDataFrame(list(enumerate(FINGERPRINTS)), "pos int, line string")
    return audit.fingerprints(rows, "line")


@query
def audit_rules(lib: Library) -> DataFrame:
    rows = audit.audit(lib.table("suspicious_summaries").select("audit_id", "summary"), patterns=PATTERNS)
    return rows.select("audit_id", "score", F.array_join("reasons", "|").alias("why"))


@query
def audit_defaults(lib: Library) -> DataFrame:
    """By the engine's own failure patterns, over the texts of all answers."""
    rows = lib.table("chapter_task_states").select("state_id", F.explode("segment_results").alias("segment_no", "summary")).unionByName(lib.table("chapter_task_states").select("state_id", F.explode("segment_errors").alias("segment_no", "summary")))
    return audit.audit(rows).select("state_id", "segment_no", "score", F.array_join("reasons", "|").alias("why"))


@query
def audit_fingerprint_contains(lib: Library) -> DataFrame:
    rows = audit.audit(lib.table("suspicious_summaries").select("audit_id", "summary"), _prints(lib), 0, 2.0, ["(?!)"])
    return rows.where(F.exists("reasons", lambda r: r.startswith("contains"))).select("audit_id", "score", F.array_join("reasons", "|").alias("why"))


@query
def audit_similarity(lib: Library) -> DataFrame:
    return audit.audit(lib.table("suspicious_summaries").select("audit_id", "summary"), _prints(lib)).select("audit_id", "score", "reasons")


@query
def audit_clean(lib: Library) -> DataFrame:
    rows = lib.table("suspicious_summaries").select("audit_id", "summary")
    return audit.without_findings(rows, audit.audit(rows, patterns=PATTERNS), ["audit_id"], 0.9)


@query
def sanitized_summaries(lib: Library) -> DataFrame:
    return lib.summaries.select("item_pos", T.sanitized_summary("summary").alias("summary"))


@query
def summary_status(lib: Library) -> DataFrame:
    failed = lib.table("chapter_task_states").select("novel_id", "chapter_id", F.col("state_id").alias("item_pos"), (F.col("status") == "FAILED").alias("failed"))
    rows = lib.last_summaries.join(failed.select("item_pos", "failed"), "item_pos").join(lib.chapters_with("content").select("novel_id", "chapter_id", "content"), ["novel_id", "chapter_id"])
    return rows.select("novel_id", "chapter_id", T.summary_status("content", "summary", "failed").alias("summary_status"))


@query
def json_summaries(lib: Library) -> DataFrame:
    rows = lib.table("chapter_task_states").select("state_id", F.explode("segment_results").alias("k", "v")).where("v IS NOT NULL")
    return rows.select("state_id", F.col("k").alias("segment_no"), T.summary_from_json("v").alias("summary"))


@query
def compact_errors(lib: Library) -> DataFrame:
    return lib.table("chapter_task_states").select("state_id", F.explode("segment_errors").alias("k", "v")).select("state_id", F.col("k").alias("segment_no"), T.compact_error("v", 60).alias("error"))


@query
def text_tiers(lib: Library) -> DataFrame:
    return lib.table("documents").select("doc_id", T.length_tier("text", 300, 1500).alias("tier"))


@query
def question_classify(lib: Library) -> DataFrame:
    return lib.table("documents").where("text IS NOT NULL").select("doc_id", T.question_kind("text", KINDS).alias("kind"))


@query
def confident_texts(lib: Library) -> DataFrame:
    return lib.summaries.select("item_pos", T.confident("summary", [*T.UNSURE, WORD]).alias("sure"))


@query
def map_reduce_summaries(lib: Library) -> DataFrame:
    return summarize.chapter_summaries(lib.chapters.select("novel_id", "chapter_id", "content"), ["novel_id", "chapter_id"], "content", OpeningProvider(120), 800, 100_000)


@query
def until_fit_summaries(lib: Library) -> DataFrame:
    """With a limit that the joined summaries of long chapters pass, so that some go through more passes."""
    rows = summarize.chapter_summaries(lib.chapters.select("novel_id", "chapter_id", "content"), ["novel_id", "chapter_id"], "content", OpeningProvider(120), 400, 300)
    return rows.select("novel_id", "chapter_id", (F.length("summary") > 0).alias("told"), (F.length("summary") <= 120).alias("fits"), "had_error")


# ---- progress and consistency


@query
def pending_chapters(lib: Library) -> DataFrame:
    return progress.pending(lib.chapters.select("novel_id", "chapter_id", "chapter_index"), lib.last_summaries)


@query
def contiguous_progress(lib: Library) -> DataFrame:
    return progress.contiguous(lib.chapters_with("chapter_index"), lib.summaries)


@query
def restored_progress(lib: Library) -> DataFrame:
    return progress.restored(lib.chapters_with("chapter_index"), lib.last_summaries)


@query
def consistency_missing_extra(lib: Library) -> DataFrame:
    return progress.consistency(lib.chapters_with("chapter_index"), lib.summaries)


@query
def repeated_chapter_ids(lib: Library) -> DataFrame:
    return progress.repeated_ids(lib.table("chapters").where("novel_id IS NOT NULL AND chapter_id IS NOT NULL"), ["novel_id", "chapter_id"])


@query
def title_mismatch(lib: Library) -> DataFrame:
    return progress.title_mismatches(lib.chapters_with("title"), lib.last_summaries)


@query
def title_sync(lib: Library) -> DataFrame:
    return progress.synced_titles(lib.last_summaries, lib.chapters_with("title")).select("novel_id", "chapter_id", "title", "title_state")


@query
def dedupe_first_wins(lib: Library) -> DataFrame:
    rows = lib.table("novels").where("novel_id IS NOT NULL").select("novel_id", "row_id", F.posexplode("characters").alias("at", "c"))
    return progress.first_characters(rows.select("novel_id", (F.col("row_id") * 1000 + F.col("at")).alias("pos"), "c.*"))


# ---- access, and compositions


@query
def ownership_semi(lib: Library) -> DataFrame:
    own = lib.novels.select(F.concat(F.lit("user"), F.length("novel_id") % 3).alias("name"), "novel_id")
    return access.owned(lib.chapters_with("title").select("novel_id", "chapter_id", "title"), own, "user1")


@query
def hashed_keys(lib: Library) -> DataFrame:
    return lib.novels.select("novel_id", T.hash_key("novel_id").alias("api_key"))


@query
def novel_summaries(lib: Library) -> DataFrame:
    return answers.novel_summary(lib)


@query
def keyword_recall(lib: Library) -> DataFrame:
    return answers.keyword_recall(lib, [KEYWORD, WORD], None, 20)


@query
def comprehensive_answer(lib: Library) -> DataFrame:
    return answers.comprehensive(lib, "列出有哪些灯", KEYWORD, recall=[WORD])


@query
def answer_sufficiency(lib: Library) -> DataFrame:
    return answers.sufficiency(answers.comprehensive(lib, "灯", KEYWORD))


@query
def answer_context(lib: Library) -> DataFrame:
    return answers.context(answers.comprehensive(lib, "灯", KEYWORD))


@query
def hierarchical_answer(lib: Library) -> DataFrame:
    return answers.hierarchical(lib, KEYWORD)


@query
def rewritten_answer(lib: Library) -> DataFrame:
    return answers.rewritten(lib, [KEYWORD, WORD])


@query
def plot_ranges(lib: Library) -> DataFrame:
    return answers.plot_ranges(lib.plots, lib.chapters_with("chapter_index", "title"))


ORACLE = oracle.SQL
