"""Problem 6: lines that one novel's chapters repeat and that aren't part of the story.

Each line is normalised (white space of any kind and digits removed, lower case) and hashed; the
distinct chapters of each (novel, line) are counted, map-side first; lines above the thresholds are
joined back to their occurrences. The chapters that have one are rebuilt without it.

Definitions: a chapter is a distinct non-null ``chapter_id``. Rows with a null novel form a novel
of their own. Null and empty texts have no line with a letter. Copies of a chapter under the same
``chapter_id`` count once, and each copy's occurrences come out. A hot novel isn't gathered: the
work is grouped by (novel, line, chapter) and by (novel, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_CHAPTERS, MIN_SHARE = 4, 0.10


def normalized(line: Column) -> Column:
    # Java's \s is ASCII only without (?U); U+001C to U+001F are white space too, as U+200B is not
    return F.lower(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f\p{Nd}]+", ""))


def lines_of(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, line_no, line, line_hash) of each line that holds a letter."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\p{L}")).withColumn("line_hash", F.xxhash64(normalized(F.col("line")), F.length(normalized(F.col("line")))))


def frequent_lines(df: DataFrame, source_col: str, doc_col: str, text_col: str, min_docs: int = MIN_CHAPTERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, line_hash, n_docs, source_docs) of the lines in at least min_docs and min_share of a source's documents."""
    rows = df.select(F.col(source_col).alias("source"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    lines = lines_of(rows, ["source", "doc"], "text").select("source", "line_hash", "doc").distinct()
    counted = lines.groupBy("source", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    totals = rows.select("source", "doc").distinct().groupBy("source").agg(F.count("*").alias("source_docs"))
    both = counted.alias("c").join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    # in whole numbers, so that exactly min_share isn't lost to rounding
    return both.where(F.col("n_docs") * 1000 >= F.col("source_docs") * round(min_share * 1000)).select("c.source", "line_hash", "n_docs", "source_docs")


def repeated_lines(df: DataFrame, row_col: str, source_col: str, doc_col: str, text_col: str, min_docs: int = MIN_CHAPTERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(row, line_no, source, n_docs, source_docs): each occurrence of a frequent line."""
    rows = df.select(F.col(row_col).alias("row"), F.col(source_col).alias("src"), F.col(text_col).alias("text"))
    found = frequent_lines(df, source_col, doc_col, text_col, min_docs, min_share)
    lines = lines_of(rows, ["row", "src"], "text").drop("line")
    on = F.col("src").eqNullSafe(F.col("source")) & (lines["line_hash"] == found["line_hash"])
    return lines.join(found, on).select(F.col("row").alias(row_col), F.col("line_no").cast("bigint").alias("line_no"), F.col("src").alias(source_col), "n_docs", "source_docs")


def without_repeated_lines(df: DataFrame, row_col: str, source_col: str, doc_col: str, text_col: str, min_docs: int = MIN_CHAPTERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(row, content, lines_removed) for each row of ``df``; a null text stays null. ``row_col`` must be unique and not null."""
    drop = (
        repeated_lines(df, row_col, source_col, doc_col, text_col, min_docs, min_share)
        .groupBy(F.col(row_col).alias("dropped_row"))
        .agg(F.collect_set("line_no").alias("gone"))
    )
    rows = df.select(F.col(row_col), F.col(text_col).alias("text")).join(drop, F.col(row_col) == F.col("dropped_row"), "left")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(~F.array_contains("gone", i.cast("bigint")), line)), lambda line: line.isNotNull())
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(row_col, clean.alias("content"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/chapters.parquet"), "row_id", "novel_id", "chapter_id", "content").select("row_id", "line_no")


def p6_clean(spark, sf_dir: str) -> DataFrame:
    return without_repeated_lines(spark.read.parquet(f"{sf_dir}/chapters.parquet"), "row_id", "novel_id", "chapter_id", "content")


P6_FOUND_SQL = r"""
WITH lines AS (
  SELECT row_id, novel_id, chapter_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT row_id, novel_id, chapter_id, string_split(content, chr(10)) AS l FROM chapters)
), norm AS (
  SELECT row_id, novel_id, chapter_id, line_no,
         lower(regexp_replace(line, '[\s\x{1c}-\x{1f}\x{0b}\x{85}\p{Z}\p{Nd}]+', '', 'g')) AS n
  FROM lines WHERE regexp_matches(line, '\p{L}')
), counted AS (
  SELECT novel_id, n, count(DISTINCT chapter_id) AS c FROM norm GROUP BY novel_id, n
), totals AS (
  SELECT novel_id, count(DISTINCT chapter_id) AS t FROM chapters GROUP BY novel_id
)
SELECT norm.row_id, CAST(norm.line_no AS BIGINT) AS line_no
FROM norm JOIN counted ON norm.novel_id IS NOT DISTINCT FROM counted.novel_id AND norm.n = counted.n
JOIN totals ON norm.novel_id IS NOT DISTINCT FROM totals.novel_id
WHERE c >= 4 AND c * 10 >= t
"""
P6_CLEAN_SQL = rf"""
WITH found AS ({P6_FOUND_SQL}), gone AS (SELECT row_id, list(DISTINCT line_no) AS gone FROM found GROUP BY row_id)
SELECT c.row_id,
       CASE WHEN gone IS NULL THEN content
            ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda line, i: NOT list_contains(gone, CAST(i - 1 AS BIGINT))), chr(10)) END AS content,
       CAST(coalesce(len(gone), 0) AS INTEGER) AS lines_removed
FROM chapters c LEFT JOIN gone ON c.row_id = gone.row_id
"""
