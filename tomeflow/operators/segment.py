"""Chapters, paragraphs and packed segments out of text.

The splitters work within one text at a time, as folds over its lines, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tomeflow.functions.text import chapter_id, col, strip

CHAPTER = r"第.{1,10}章|Chapter \d+"
# Titles of front matter.
COVER_TITLES = ["封面", "目录", "扉页", "前言", "序", "序章", "引子", "楔子"]


def paragraphs_a(text: Column | str, min_len: int = 60) -> Column:
    """Paragraphs for retrieval. Blank lines part blocks; a block of at least min_len stays whole, and each line
    of a shorter one is appended with a space to the paragraph before it, or begins the first."""
    blocks = F.filter(F.transform(F.split(col(text), r"(?U)\n\s*\n"), strip), lambda b: b != "")
    lines = lambda block: F.array_join(F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != ""), " ")
    one = lambda b: F.when(F.length(b) >= min_len, b).otherwise(lines(b))

    def joined(bound: Column) -> Column:
        all_, starts = bound["b"], bound["s"]
        # from one start to the next, so that every block is looked at once
        part = lambda at, i: F.slice(all_, at + 1, F.coalesce(F.get(starts, i + 1), F.size(all_)) - at)
        return F.transform(starts, lambda at, i: F.array_join(F.transform(part(at, i), one), " "))

    begins = lambda b: F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (F.length(x) >= min_len), i)), lambda i: i.isNotNull())
    # an array of one element gives what it holds a name, or each step would split the text again
    named = F.transform(F.array(blocks), lambda b: F.struct(b.alias("b"), begins(b).alias("s")))
    return F.when(col(text).isNotNull(), F.element_at(F.transform(named, joined), 1))


def paragraphs_b(text: Column | str, min_len: int = 100) -> Column:
    """Paragraphs for embedding: stripped lines joined by line breaks, closed by a blank line or on reaching min_len."""
    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        out, cur = acc["out"], acc["cur"]
        joined = F.when(cur == "", line).otherwise(F.concat(cur, F.lit("\n"), line))
        flush = F.when(cur == "", out).otherwise(F.concat(out, F.array(cur)))
        full = F.length(joined) >= min_len
        return F.struct(
            F.when(line == "", flush).when(full, F.concat(out, F.array(joined))).otherwise(out).alias("out"),
            F.when((line == "") | full, F.lit("")).otherwise(joined).alias("cur"),
        )

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(F.split(col(text), "\n", -1), start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def packed(items: Column | str, max_chars: int, whole: bool = False) -> Column:
    """Items packed in order into buckets of at most max_chars, joined by line breaks; an item above that closes the bucket
    and is cut. An item after another costs a line break more. whole: skip empty items only."""
    pieces = lambda item: F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(item) / max_chars).cast("int") - 1), lambda i: F.substring(item, i * max_chars + 1, F.lit(max_chars))
    )

    def step(acc: Column, item: Column) -> Column:
        out, cur, size = acc["out"], acc["cur"], acc["size"]
        n = F.length(item)
        closed = F.when(cur == "", out).otherwise(F.concat(out, F.array(cur)))
        fits = size + n + 1 <= max_chars
        empty = n == 0
        return F.struct(
            F.when(empty, out).when(n > max_chars, F.concat(closed, pieces(item))).when(fits | (cur == ""), out).otherwise(closed).alias("out"),
            F.when(empty, cur).when(n > max_chars, F.lit("")).when(fits & (cur != ""), F.concat(cur, F.lit("\n"), item)).otherwise(item).alias("cur"),
            F.when(empty, size).when(n > max_chars, F.lit(0)).when(fits, size + n + 1).otherwise(n).alias("size"),
        )

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("size"))
    return F.aggregate(col(items), start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def segments(text: Column | str, max_chars: int, min_len: int = 60) -> Column:
    """A text's paragraphs packed; the text's beginning if it has none; nothing only for nothing."""
    t = F.coalesce(col(text), F.lit(""))
    many = packed(paragraphs_a(t, min_len), max_chars)
    return F.when((F.size(many) == 0) & (t != ""), F.array(F.substring(t, 1, max_chars))).otherwise(many)


def txt_chapters(df: DataFrame, text_col: str, pattern: str = CHAPTER) -> DataFrame:
    """(all columns but the text, chapter_index, chapter_id, title, content): a chapter begins at each line that begins
    with the pattern; what comes before the first is dropped; a text without any is one untitled chapter."""
    start = f"(?dm)(?=^(?:{pattern}))"
    t = F.col(text_col)
    has = t.rlike(f"(?dm)^(?:{pattern})")
    pieces = F.filter(F.split(t, start), lambda p: p.rlike(f"(?d)^(?:{pattern})"))
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, has.alias("_has"), F.posexplode(F.when(has, pieces).otherwise(F.array(t))).alias("chapter_index", "_piece")).where(F.col("_piece").isNotNull())
    title = F.when(F.col("_has"), strip(F.regexp_extract("_piece", f"(?d)^(?:{pattern})", 0))).otherwise("")
    return rows.select(*keep, "chapter_index", chapter_id("chapter_index").alias("chapter_id"), title.alias("title"), strip("_piece").alias("content"))


def epub_titles(toc: Column | str, parts: Column | str) -> Column:
    """The table of contents without a cover title that has no part of its own."""
    t = F.transform(F.filter(F.coalesce(col(toc), F.expr("CAST(array() AS array<string>)")), lambda x: x != ""), strip)
    p = F.coalesce(col(parts), F.expr("CAST(array() AS array<string>)"))
    sample = F.substring(F.coalesce(F.get(p, F.lit(0)), F.lit("")), 1, 200)
    first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    extra = (F.size(t) == F.size(p) + 1) | ((F.size(p) > 0) & ~sample.contains(first) & (F.coalesce(sample.contains(second), F.lit(False)) | (F.size(t) > F.size(p))))
    return F.when((F.size(t) > 0) & first.isin(COVER_TITLES) & extra, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)


def epub_chapters(df: DataFrame, toc_col: str, parts_col: str) -> DataFrame:
    """(other columns, chapter_index, chapter_id, title, content): titles and parts matched by position, the shorter list filled up."""
    keep = [c for c in df.columns if c not in (toc_col, parts_col)]
    zipped = F.arrays_zip(epub_titles(toc_col, parts_col).alias("t"), F.coalesce(F.col(parts_col), F.expr("CAST(array() AS array<string>)")).alias("p"))

    rows = df.select(*keep, F.posexplode(zipped).alias("chapter_index", "_z"))
    first, second = (f.name for f in rows.schema["_z"].dataType.fields)
    return rows.select(
        *keep, "chapter_index", chapter_id("chapter_index").alias("chapter_id"),
        F.coalesce(F.col(f"_z.`{first}`"), F.format_string("Chapter %d", F.col("chapter_index") + 1)).alias("title"), F.coalesce(F.col(f"_z.`{second}`"), F.lit("")).alias("content"),
    )


def with_default_metadata(metadata: Column | str, index: Column | str, title: Column | str) -> Column:
    """Metadata with chapter_index and chapter_title where it has none; its own values hold."""
    own = F.coalesce(col(metadata), F.expr("CAST(map() AS map<string,string>)"))
    defaults = F.create_map(F.lit("chapter_index"), col(index).cast("string"), F.lit("chapter_title"), col(title))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)
