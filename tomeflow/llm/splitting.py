"""Problem 4: cutting oversized items into overlapping pieces at natural boundaries.

A text is taken as ranges of a fixed size, each with a halo of the neighbouring text on both sides.
A range's worker finds the paragraph and sentence ends in it and its two anchors: the natural
boundaries nearest to its own start and to the next range's. Anchors are found in the halos, so
neighbours agree on them without talking to each other, and the pieces between two anchors are cut
in one task however long the item is. What ties the ranges together is a small table: the ranges'
piece counts (and, for byte ranges of files, their numbers of characters), of which prefix sums
give every piece its number and its offset.

``split_items``, which the queries use, takes values of a column: an item of one range is cut where it
was read; a longer one, which only the task that reads its row holds whole, is walked through once into
ranges that go to tasks of their own. ``split_files`` reads byte ranges of files, so that no task holds
an item; with ``spill_items`` the longest values of a column can be made such files first.

Within a range, a piece ends at the last paragraph end in reach, if that fills at least half of the
limit, else at the last sentence end that does, else at the last boundary of any kind in reach;
only where there is none it is cut at the limit. Each piece after the first begins ``overlap``
characters before the end of the one before it. Lengths are code points.

Null and empty items, and items within the limit, are one piece (null stays null). The overlap must
be smaller than the limit.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

RANGE_CHARS = 1 << 16
# a paragraph ends after each line break; a sentence after its final marks with the closing quotes and
# brackets that belong to it, in Latin script only before white space. Whether a position is an end
# mustn't depend on text far before it, or neighbouring ranges would see different ends
PARAGRAPH = re.compile(r"\r\n|\r|\n")
SENTENCE = re.compile(r"[。！？…!?]+[”’」』）)》\"']*|[.][”’\"')\]»]*(?=\s)|;(?=\s)|；")


def ends(text: str) -> tuple[list[int], list[int]]:
    """Positions after paragraphs and after sentences."""
    return [m.end() for m in PARAGRAPH.finditer(text)], [m.end() for m in SENTENCE.finditer(text)]


def _last(sorted_ends: list[int], after: int, upto: int) -> int | None:
    i = bisect.bisect_right(sorted_ends, upto) - 1
    return sorted_ends[i] if i >= 0 and sorted_ends[i] > after else None


def cuts(paragraphs: list[int], sentences: list[int], start: int, stop: int, max_size: int, overlap: int, before: int) -> list[tuple[int, int]]:
    """(from, to) of the pieces of [start, stop). before: characters that the first may repeat (0 at the item's start)."""
    pieces, end = [], start
    lead = min(overlap, before)
    while end < stop:
        first = end - lead
        limit = first + max_size
        if stop <= limit:
            cut = stop
        else:
            half = max(end, first + max_size // 2)
            cut = _last(paragraphs, half, limit) or _last(sentences, half, limit) or max(_last(paragraphs, end, limit) or 0, _last(sentences, end, limit) or 0) or limit
        pieces.append((first, cut))
        end, lead = cut, min(overlap, cut)
    return pieces


def anchor(paragraphs: list[int], sentences: list[int], at: int, max_size: int, overlap: int) -> int:
    """The boundary at which a range begins that nominally begins at ``at``: the nearest natural one within reach of a piece."""
    reach = max_size - overlap
    for found in (paragraphs, sentences):
        i = bisect.bisect_left(found, at)
        if i < len(found) and found[i] <= at + reach:
            return found[i]
        if i and found[i - 1] > at - reach:
            return found[i - 1]
    return at


def range_pieces(text: str, core_from: int, core_to: int, is_first: bool, is_last: bool, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces, as positions in ``text``, that begin in the range [core_from, core_to) of a text with halos."""
    paragraphs, sentences = ends(text)
    start = 0 if is_first else anchor(paragraphs, sentences, core_from, max_size, overlap)
    stop = len(text) if is_last else anchor(paragraphs, sentences, core_to, max_size, overlap)
    return cuts(paragraphs, sentences, start, stop, max_size, overlap, start)


def halo(max_size: int, overlap: int) -> int:
    """Characters of the neighbouring text that a range needs on either side: an anchor's reach, what a piece there repeats, and a sentence end's marks."""
    return max_size + overlap + 64


def split_items(items: DataFrame, keys: list[str], text_col: str, max_col: str, overlap_col: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(keys, n_chars, piece_no, start, piece): pieces in order. ``keys`` together are unique and not null for items longer than a range."""
    rows = items.select(*keys, F.col(text_col).alias("text"), F.length(text_col).alias("n_chars"), F.col(max_col).cast("int").alias("max_size"), F.col(overlap_col).cast("int").alias("overlap"))
    step = F.greatest(F.lit(range_chars), 4 * F.col("max_size"))  # a range is several times an anchor's reach
    rows = rows.withColumn("step", F.coalesce(step, F.lit(range_chars)))
    one = F.coalesce(F.col("n_chars") <= F.col("step"), F.lit(True))
    types = dict(rows.dtypes)
    own = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def table_of(pdf, index, out, columns, kept):
        import pandas as pd

        table = pdf[kept].iloc[index].reset_index(drop=True)
        return pd.concat([table, pd.DataFrame(out, columns=columns, index=table.index)], axis=1)

    def ranged(batches: Iterator) -> Iterator:
        """The ranges of long items, each with its halo."""
        for pdf in batches:
            for i, (text, size, lap, step) in enumerate(zip(pdf["text"], pdf["max_size"], pdf["overlap"], pdf["step"])):
                side = halo(size, lap)
                out = [(no, max(0, no * step - side), text[max(0, no * step - side) : (no + 1) * step + side]) for no in range(-(-len(text) // step))]
                yield table_of(pdf, [i] * len(out), out, ["range_no", "base", "text"], [*keys, "n_chars", "max_size", "overlap", "step"])

    def cut(batches: Iterator) -> Iterator:
        for pdf in batches:
            index, out = [], []
            numbers = (pdf["range_no"], pdf["base"]) if "range_no" in pdf else ([0] * len(pdf), [0] * len(pdf))
            for i, (text, n, size, lap, step, no, base) in enumerate(zip(*(pdf[c] for c in ("text", "n_chars", "max_size", "overlap", "step")), *numbers)):
                if text is None or not text or n <= size:
                    found = [(0, 0 if text is None else len(text))]
                else:
                    if lap >= size:
                        raise ValueError("the overlap must be smaller than the limit")
                    found = range_pieces(text, no * step - base, (no + 1) * step - base, no == 0, (no + 1) * step >= n, size, lap)
                for j, (a, b) in enumerate(found):
                    index.append(i)
                    out.append((j, base + a, None if text is None else text[a:b]))
            yield table_of(pdf, index, out, ["in_range", "start", "piece"], [*keys, "n_chars", *(["range_no"] if "range_no" in pdf else [])])

    columns = [*keys, "n_chars", "piece_no", "start", "piece"]
    short = rows.where(one).mapInPandas(cut, f"{own}, n_chars int, in_range int, start bigint, piece string").withColumn("piece_no", F.col("in_range"))
    ranges = rows.where(~one).mapInPandas(ranged, f"{own}, n_chars int, max_size int, overlap int, step int, range_no int, base bigint, text string").repartition(*keys, "range_no")
    long = ranges.mapInPandas(cut, f"{own}, n_chars int, range_no int, in_range int, start bigint, piece string")
    # prefix sums of the ranges' piece counts number the pieces of an item that has several ranges
    counts = long.groupBy(*keys, "range_no").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    long = long.join(counts, [*keys, "range_no"]).withColumn("piece_no", (F.col("before") + F.col("in_range")).cast("int"))
    return short.select(columns).unionByName(long.select(columns))


def spill_items(items: DataFrame, keys: list[str], text_col: str, folder: str) -> DataFrame:
    """(keys, path): each item's text as a UTF-8 file in a folder that all workers see, for ``split_files``. A null text is an empty file."""
    types = dict(items.dtypes)

    def write(batches: Iterator) -> Iterator:
        import hashlib
        import os

        for pdf in batches:
            paths = []
            for *key, text in zip(*(pdf[k] for k in keys), pdf[text_col]):
                path = f"{folder}/{hashlib.blake2b(repr(key).encode(), digest_size=16).hexdigest()}.txt"
                with open(f"{path}.{os.getpid()}", "w", encoding="utf-8", errors="replace", newline="") as f:
                    f.write(text or "")
                os.replace(f"{path}.{os.getpid()}", path)  # a task that runs twice writes the same file
                paths.append(path)
            yield pdf[keys].assign(path=paths)

    return items.select(*keys, text_col).mapInPandas(write, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", path string")


def split_files(spark: SparkSession, paths: list[str], max_size: int, overlap: int, range_bytes: int = 1 << 20) -> DataFrame:
    """(path, piece_no, start, piece): pieces of UTF-8 files on a file system that all workers see, read by byte ranges.

    A worker reads its range and the halos only, whatever the file's size. ``start`` counts
    characters; it comes from prefix sums of the ranges' numbers of characters. Bytes that aren't
    UTF-8 become U+FFFD. A file that is empty has one empty piece.
    """
    import os

    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be smaller than the limit")
    side, range_bytes = 4 * halo(max_size, overlap), max(range_bytes, 16 * max_size)
    sizes = [(p, os.path.getsize(p)) for p in paths]
    files = spark.createDataFrame(sizes, "path string, size bigint")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("size") / range_bytes).cast("bigint") - 1))).alias("range_no"))

    def aligned(raw: bytes, at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path, size, no in zip(pdf["path"], pdf["size"], pdf["range_no"]):
                base = max(0, no * range_bytes - side)
                with open(path, "rb") as f:
                    f.seek(base)
                    raw = f.read(min(size, (no + 1) * range_bytes + side) - base)
                begin, a, b = (0 if base == 0 else aligned(raw, 1)), aligned(raw, no * range_bytes - base), aligned(raw, min(len(raw), (no + 1) * range_bytes - base))
                text = raw[begin:].decode("utf-8", errors="replace")
                core_from, core = len(raw[begin:a].decode("utf-8", errors="replace")), len(raw[a:b].decode("utf-8", errors="replace"))
                for j, (x, y) in enumerate(range_pieces(text, core_from, core_from + core, no == 0, (no + 1) * range_bytes >= size, max_size, overlap) or ([(0, 0)] if size == 0 else [])):
                    out.append((path, no, j, x - core_from, text[x:y]))
                out.append((path, no, -1, core, None))  # the range's row of the boundary table
            yield pd.DataFrame(out, columns=["path", "range_no", "in_range", "start", "piece"])

    rows = ranges.repartition("path", "range_no").mapInPandas(read, "path string, range_no bigint, in_range int, start bigint, piece string")
    upto = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy("path", "range_no").agg(F.max(F.when(F.col("in_range") < 0, F.col("start"))).alias("chars"), F.count("piece").alias("n"))
    table = table.select("path", "range_no", F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("pieces_before"))
    return rows.where("in_range >= 0").join(table, ["path", "range_no"]).select("path", (F.col("pieces_before") + F.col("in_range")).alias("piece_no"), (F.col("chars_before") + F.col("start")).alias("start"), "piece")


def corpus_items(spark, sf_dir: str) -> DataFrame:
    """(item_kind, item_id, item_pos, text, max_size, overlap_size) of the items above their kind's limit."""
    limits = spark.read.parquet(f"{sf_dir}/size_limits.parquet").groupBy("item_kind").agg(F.min("max_size").alias("max_size"), F.min_by("overlap_size", "max_size").alias("overlap_size"))
    chapters = spark.read.parquet(f"{sf_dir}/chapters.parquet").select(F.lit("chapter").alias("item_kind"), F.col("row_id").alias("item_id"), F.lit(-1).cast("bigint").alias("item_pos"), F.col("content").alias("text"))
    states = spark.read.parquet(f"{sf_dir}/chapter_task_states.parquet").select(F.lit("segment").alias("item_kind"), F.col("state_id").alias("item_id"), F.posexplode("segment_texts").alias("item_pos", "text"))
    items = chapters.unionByName(states.withColumn("item_pos", F.col("item_pos").cast("bigint")))
    # the limits are one row for each of a fixed number of kinds
    return items.join(F.broadcast(limits), "item_kind").where(F.length("text") > F.col("max_size"))


ITEM = ["item_kind", "item_id", "item_pos"]


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    return split_items(corpus_items(spark, sf_dir), ITEM, "text", "max_size", "overlap_size")


def p4_whole(spark, sf_dir: str) -> DataFrame:
    """(item_kind, item_id, item_pos, n_chars, within, overlapping, rebuilt): for each item, whether its pieces keep the limit and the
    overlap, and the hash of what they give without what they repeat. Pieces are joined by item here, as in the check of a result."""
    items = corpus_items(spark, sf_dir).select(*ITEM, "max_size", "overlap_size")
    own = F.substring("piece", F.col("skip") + 1, F.length("piece") - F.col("skip"))
    before = F.lag(F.col("start") + F.length("piece"), 1, 0).over(Window.partitionBy(*ITEM).orderBy("piece_no"))
    rows = p4_pieces(spark, sf_dir).join(items, ITEM).withColumn("skip", (before - F.col("start")).cast("int")).withColumn("own", own)
    per = rows.groupBy(*ITEM).agg(
        F.max("n_chars").cast("bigint").alias("n_chars"), F.min(F.length("piece") <= F.col("max_size")).alias("within"),
        F.min(F.col("skip") == F.when(F.col("piece_no") == 0, 0).otherwise(F.least(F.col("overlap_size"), F.col("start") + F.col("skip")))).alias("overlapping"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "").cast("binary")).alias("rebuilt"),
    )
    return per


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where(F.col("piece_no") == 1).select(ITEM)


P4_FOUND_SQL = """
WITH items AS (
  SELECT 'chapter' AS item_kind, row_id AS item_id, CAST(-1 AS BIGINT) AS item_pos, content AS text FROM chapters
  UNION ALL
  SELECT 'segment', state_id, CAST(unnest(range(len(segment_texts))) AS BIGINT), unnest(segment_texts) FROM chapter_task_states
)
SELECT item_kind, item_id, item_pos FROM items JOIN (SELECT item_kind, min(max_size) AS max_size FROM size_limits GROUP BY item_kind) USING (item_kind)
WHERE length(text) > max_size
"""

P4_WHOLE_SQL = P4_FOUND_SQL.replace("SELECT item_kind, item_id, item_pos FROM items", "SELECT item_kind, item_id, item_pos, length(text) AS n_chars, true AS within, true AS overlapping, md5(text) AS rebuilt FROM items")
