"""Problem 7: encoding of a whole corpus with a public byte-level BPE.

A text up to ``chunk_chars`` code points is encoded where it was read, without a shuffle. A longer
one is walked through once, into overlapping chunks that are pre-tokenised in parallel. Neighbours are
stitched at the first position of their overlap that is a pre-token boundary in both; to find it, only
the overlaps' boundaries meet, pair by pair. From a common boundary on, two scans of the pre-tokeniser
agree, so the pieces between the stitches, cut by their offsets and encoded in parallel, have the ids of
one pass over the whole text. No task gets a long text's chunks, boundaries or ids together, but for the
last step of ``token_ids``, whose result is one row for each text (``token_counts`` adds up numbers).

Where an overlap has no common boundary (one endless run), the chunks around it are scanned as one, from
the stitch before them, and the stitch after them is set anew by that scan, until nothing changes. What
is gathered then is as long as the run, which is one pre-token and can't be encoded in parts.

Null and empty texts have an empty list of ids. Special tokens are ordinary text. Repeated rows
give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tomeflow.session import checkpointed

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 512

# Fixed value: the pre-token pattern of the published 50k byte-level vocabulary, with possessive
# repeats, which find the same pre-tokens without backtracking.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A pre-token is sure only if at least so many characters follow it (the longest contraction less one).
LOOKAHEAD = 3


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER_FILE):
    """The tiktoken encoder of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pre_token():
    import regex

    return regex.compile(PRE_TOKEN)


def boundaries(text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that no text after the chunk can change; all if it is the last.

    None follows white space: a run of it is cut by what comes next, so a piece mustn't end in one.
    """
    ends = [e for e in (m.end() for m in _pre_token().finditer(text)) if not text[e - 1].isspace()]
    return ends if last else [e for e in ends if e <= len(text) - LOOKAHEAD and e != len(text)]


def decode(ids: list[int], path: str = TOKENIZER_FILE) -> str:
    """The text of a list of ids: its tokens' raw bytes one after the other."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def _batches(rows: Iterator[pa.RecordBatch], path: str, counts: bool) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the text, by its ids or by their number."""
    import numpy as np

    encode = encoder(path).encode_ordinary
    for batch in rows:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        if counts:
            last = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
        else:
            lists = [np.asarray(encode(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in texts]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[str(i) for i in range(batch.num_columns)])


def _encoded(df: DataFrame, schema: str, path: str, counts: bool) -> DataFrame:
    return df.mapInArrow(lambda rows: _batches(rows, path, counts), schema)


def cut_chunks(text: str, step: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(number, chunk, whether the text ends with it) of chunks that begin ``step`` apart, in one walk."""
    for no, at in enumerate(range(0, len(text), step)):
        yield no, text[at : at + step + overlap], at + step + overlap >= len(text)


def ends_of(chunk: str, last: bool, step: int, overlap: int) -> tuple[list[int], list[int]]:
    """(boundaries in the overlap with the chunk before, its start included; those in the overlap with the next one, from its start)."""
    found = boundaries(chunk, last)
    return [0, *(e for e in found if e <= overlap)], [e - step for e in found if step <= e <= step + overlap]


def joined_chunks(chunks: list[str], step: int) -> str:
    return "".join([*(c[:step] for c in chunks[:-1]), chunks[-1]])


def _chunked(step: int, overlap: int, key: str):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for at, text in zip(range(len(pdf)), pdf["text"]):  # a frame for each text, so that no batch holds several long ones
                rows = list(cut_chunks(text, step, overlap))
                yield pd.concat([pdf[["key"]].iloc[[at] * len(rows)].reset_index(drop=True), pd.DataFrame(rows, columns=["chunk_no", "chunk", "last"])], axis=1)

    return run, f"key {key}, chunk_no int, chunk string, last boolean"


def _pre_tokenised(step: int, overlap: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [ends_of(c, last, step, overlap) for c, last in zip(pdf["chunk"], pdf["last"])]
            yield pd.concat([pdf, pd.DataFrame(rows, columns=["head", "tail"], index=pdf.index)], axis=1)

    return run


def stitched(parts: DataFrame, step: int) -> DataFrame:
    """(key, chunk_no, at, piece_no, next_at, n, ends, more): for each chunk where its own part begins, the number of its piece,
    how many chunks that has, whether it is the piece's last, and whether a chunk follows. parts: (key, chunk_no, chunk, last, head, tail)."""
    after = parts.select("key", (F.col("chunk_no") + 1).alias("chunk_no"), "tail")
    links = parts.select("key", "chunk_no", "head").join(after, ["key", "chunk_no"], "left")
    at = F.when(F.col("chunk_no") == 0, 0).otherwise(F.get(F.array_intersect("tail", "head"), F.lit(0)))
    links = checkpointed(links.select("key", "chunk_no", at.alias("at")))
    key = parts.schema["key"].dataType.simpleString()

    def again(group):
        """The stitch after a group of chunks, by a scan from the group's own first stitch."""
        import pandas as pd

        group = group.sort_values("chunk_no")
        chunks, end = list(group["chunk"]), group.iloc[-1]
        if end["next_head"] is None:
            return pd.DataFrame({"key": pd.Series([], dtype=object), "chunk_no": pd.Series([], dtype="int32"), "new": pd.Series([], dtype="Int64")})
        first = int(group["at"].iloc[0])
        text = joined_chunks(chunks, step)[first:]
        true = (e + first - len(chunks) * step for e in boundaries(text, bool(end["last"])))
        heads = set(int(x) for x in end["next_head"])
        new = next((e for e in true if e in heads), None)
        return pd.DataFrame({"key": [group["key"].iloc[0]], "chunk_no": [int(end["chunk_no"]) + 1], "new": pd.array([new], dtype="Int64")})

    while True:
        whole = Window.partitionBy("key").orderBy("chunk_no")
        numbered = links.withColumn("piece_no", F.count("at").over(whole) - 1).withColumn("next_piece", F.lead("piece_no").over(whole)).withColumn("next_at", F.lead("at").over(whole))
        numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy("key", "piece_no")))
        joint = numbered.where("n > 1")
        if joint.isEmpty():
            break
        heads = parts.select("key", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("head").alias("next_head"))
        rows = joint.join(parts.select("key", "chunk_no", "chunk", "last"), ["key", "chunk_no"]).join(heads, ["key", "chunk_no"], "left").select("key", "piece_no", "chunk_no", "at", "chunk", "last", "next_head")
        found = rows.groupBy("key", "piece_no").applyInPandas(again, f"key {key}, chunk_no int, new bigint")
        changed = checkpointed(links.join(found, ["key", "chunk_no"]).where(~F.col("at").eqNullSafe(F.col("new").cast("int"))).select("key", "chunk_no", F.col("new").cast("int").alias("new")))
        if changed.isEmpty():
            break
        links = checkpointed(links.join(changed.withColumn("is_new", F.lit(True)), ["key", "chunk_no"], "left").select("key", "chunk_no", F.when(F.col("is_new"), F.col("new")).otherwise(F.col("at")).alias("at")))
    more = F.col("next_piece").isNotNull()
    return numbered.select("key", "chunk_no", "at", "piece_no", "next_at", "n", (~more | (F.col("next_piece") != F.col("piece_no"))).alias("ends"), more.alias("more"))


def long_pieces(df: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, text) -> (key, piece_no, piece): the chunked, pre-tokenised and stitched long texts. key is unique."""
    if not LOOKAHEAD < overlap < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk, and longer than a boundary's look ahead")
    run, schema = _chunked(chunk_chars, overlap, df.schema["key"].dataType.simpleString())
    chunks = df.select("key", "text").mapInPandas(run, schema).repartition("key", "chunk_no")
    parts = checkpointed(chunks.mapInPandas(_pre_tokenised(chunk_chars, overlap), f"{schema}, head array<int>, tail array<int>"))
    first = F.coalesce(F.col("at"), F.lit(0))
    stop = F.when(~F.col("ends"), F.lit(chunk_chars)).when(F.col("more"), F.lit(chunk_chars) + F.col("next_at")).otherwise(F.length("chunk"))
    cut = stitched(parts, chunk_chars).join(parts.select("key", "chunk_no", "chunk"), ["key", "chunk_no"]).select("key", "piece_no", "chunk_no", "n", F.substring("chunk", first + 1, F.greatest(F.lit(0), stop - first)).alias("piece"))
    joint = cut.where("n > 1").groupBy("key", "piece_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    return cut.where("n = 1").select("key", "piece_no", "piece").unionByName(joint)


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER_FILE, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row (id, ids) for each row of ``df``; other columns are left out."""
    return _tokens(df, id_col, text_col, tokenizer, chunk_chars, overlap, False)


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER_FILE, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row (id, n_tokens) for each row of ``df``."""
    return _tokens(df, id_col, text_col, tokenizer, chunk_chars, overlap, True)


def _tokens(df: DataFrame, id_col: str, text_col: str, path: str, chunk_chars: int, overlap: int, counts: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    value, result = ("n_tokens", "n_tokens bigint") if counts else ("ids", "ids array<int>")
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = _encoded(rows.where(~is_long), f"id {kind}, {result}", path, counts)
    # ids can be null or repeated, so a long text's key is its place in the scan, which is the same in every attempt of a task
    keyed = rows.where(is_long).select(F.struct("id", F.monotonically_increasing_id().alias("at")).alias("key"), "text")
    pieces = long_pieces(keyed, chunk_chars, overlap).repartition("key", "piece_no")
    encoded = _encoded(pieces, f"key struct<id:{kind},at:bigint>, piece_no bigint, {result}", path, counts)
    if counts:
        whole = encoded.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        whole = encoded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole.select(F.col("key.id").alias("id"), value)).withColumnRenamed("id", id_col)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
