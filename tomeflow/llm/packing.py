"""Problem 8: filling containers of a fixed capacity with texts measured in tokens.

Bounded-space online best-fit. Each task keeps at most ``open_bins`` containers open, indexed by
free space in the bits of one integer: the smallest free space that still holds the item is the
lowest set bit at or above the item's size. If none fits and the limit is reached, the fullest is
closed first. A text above the capacity fills containers of its own and only its rest is an item.
Nothing is shuffled, and a task's memory doesn't grow with its rows.

A text without tokens (null or empty) is an item of size 0. Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tomeflow.llm.tokens import token_counts

OPEN_BINS = 128


class BestFit:
    """Open containers by free space."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS, first: int = 0):
        self.capacity, self.limit, self.next, self.count = capacity, open_bins, first, 0
        self.bits, self.bins = 0, [[] for _ in range(capacity + 1)]

    def _put(self, free: int, container: int) -> None:
        if free:
            self.bins[free].append(container)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        container = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return container

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, size: int) -> list[tuple[int, int, int]]:
        """(container, first token, tokens) of each part of an item."""
        parts = []
        at = 0
        while size - at > self.capacity:
            parts.append((self._new(), at, self.capacity))
            at += self.capacity
        rest = size - at
        fitting = self.bits >> rest
        if fitting:
            free = rest + (fitting & -fitting).bit_length() - 1
            container = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            container, free = self._new(), self.capacity
        self._put(free - rest, container)
        return [*parts, (container, at, rest)]


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """(id, part_no, container_id, token_from, n_tokens): one row for each part of each item."""
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    kind = sizes.schema[id_col].dataType.simpleString()

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in rows:
            out: list[tuple] = []
            index = []
            for i, size in enumerate(batch.column(1).to_pylist()):
                for no, part in enumerate(fit.add(size or 0)):
                    out.append((no, *part))
                    index.append(i)
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=["id", "part_no", "container_id", "token_from", "n_tokens"],
            )

    rows = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))
    return rows.mapInArrow(packed, f"id {kind}, part_no int, container_id bigint, token_from bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def capacity_of(limits: DataFrame, item_kind: str) -> int:
    """The capacity of a kind; the table of limits has one row for each kind."""
    found = limits.where(F.col("item_kind") == item_kind).agg(F.min("max_size")).first()[0]
    if found is None:
        raise ValueError(f"size_limits has no {item_kind}")
    return int(found)


def p8_containers(spark, sf_dir: str) -> DataFrame:
    capacity = capacity_of(spark.read.parquet(f"{sf_dir}/size_limits.parquet"), "document")
    return pack(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), "doc_id", "n_tokens", capacity)


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """How full the containers are: one row."""
    capacity = capacity_of(spark.read.parquet(f"{sf_dir}/size_limits.parquet"), "document")
    used = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("share_used"))


def p8_check(spark, sf_dir: str) -> DataFrame:
    """One row: the documents, those that no part names, parts of documents that needn't be split, and containers above the capacity."""
    capacity = capacity_of(spark.read.parquet(f"{sf_dir}/size_limits.parquet"), "document")
    rows = p8_containers(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    split = rows.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))
    full = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    needless = split.agg(F.sum((F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))).cast("bigint")).alias("needless"))
    missing = documents.join(split, "doc_id", "left").agg(F.count("*").alias("documents"), F.sum(F.col("parts").isNull().cast("bigint")).alias("missing"))
    over = full.agg(F.sum((F.col("used") > capacity).cast("bigint")).alias("over"))
    rows = missing.unionByName(needless, True).unionByName(over, True)  # one row each
    return rows.agg(*(F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in ("documents", "missing", "needless", "over")))


P8_CHECK_SQL = "SELECT count(*) AS documents, 0::BIGINT AS missing, 0::BIGINT AS needless, 0::BIGINT AS over FROM documents"
