"""Problem 5: the most similar vectors of every vector, by learned partitions.

Fit, on a bounded sample: the nearest-neighbour graph of the sample is cut into balanced parts
(greedy growth, then label propagation under a size limit), and a softmax classifier learns to tell
the part from the vector. Index: every row goes to its most probable part. Search: a query is
routed to its ``probes`` most probable parts and reranked exactly there. How many probes are needed
is measured on the sample before the search.

Parts are searched in blocks of at most ``block`` rows on either side, so that a part that holds
any share of all rows is spread over many tasks and nothing grows with it. Above ``MAX_PARTS`` *
``PART_ROWS`` vectors each part has a router of its own into up to ``MAX_SUB`` parts, and the sub-parts of
a query's most probable parts are ranked together. Only the classifiers (65 numbers a part) and the
parts' sizes, both bounded, are sent to all workers.

Bounds of the fit: at most ``MAX_SAMPLE`` vectors, and ``SAMPLE_PER_PART`` for each part of a second level. All rows are indexed.
Vectors that are null, of another length, all zero, or hold a null or non-finite number take no
part. Copied rows take part like others. Ties in similarity are broken by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tomeflow.session import checkpointed

DIM = 64
PART_ROWS, MAX_PARTS, MAX_SUB, REACH, MAX_SAMPLE, SAMPLE_PER_PART = 2048, 1024, 64, 16, 32_768, 48
BLOCK = 4096
TASK_ROWS = 1 << 15
NEIGHBOURS, EPOCHS, SEED = 10, 40, 5
COVER_PAIRS, COVER_TOP = 0.995, 0.95


@dataclass
class Router:
    """weights: (dim, parts); bias: (parts,)."""

    weights: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.bias)

    def ranked(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each row, best first."""
        z = x @ self.weights + self.bias
        probes = min(probes, self.parts)
        top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, axis=1), axis=1, kind="stable"), axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


@dataclass
class TwoLevels:
    """A router of each part's own beneath the first one. weights: (parts, dim, sub); bias: (parts, sub). Ranks the sub-parts of a row's ``REACH`` most probable parts."""

    first: Router
    weights: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> int:
        return self.bias.size

    def ranked(self, x: np.ndarray, probes: int) -> np.ndarray:
        parts, sub = self.bias.shape
        reach = min(REACH, parts)
        order = self.first.ranked(x, reach)
        sure = np.take_along_axis(_log_softmax(x @ self.first.weights + self.first.bias), order, axis=1)
        score = np.empty((len(x), reach, sub), np.float32)
        for p in np.unique(order):
            row, at = np.nonzero(order == p)
            score[row, at] = sure[row, at][:, None] + _log_softmax(x[row] @ self.weights[p] + self.bias[p])
        score = score.reshape(len(x), -1)
        ids = (order[:, :, None] * sub + np.arange(sub)).reshape(len(x), -1)
        probes = min(probes, score.shape[1])
        top = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)
        return np.take_along_axis(ids, top, axis=1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar others of each row, by brute force in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.15) -> np.ndarray:
    """A part for each node, none above slack times the mean size, with few neighbours in other parts."""
    rng = np.random.default_rng(SEED)
    n = len(graph)
    limit = int(np.ceil(slack * n / parts))
    # seeds spread over the graph; nodes join their most similar seed with room, the surest first
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int32)
    for _ in range(5):
        s = x @ centres.T
        choice = np.argsort(-s, axis=1)[:, : min(parts, 16)]
        size = np.zeros(parts, int)
        for i in np.argsort(-s.max(axis=1), kind="stable"):
            p = next((c for c in choice[i] if size[c] < limit), None)
            if p is None:
                p = int(size.argmin())
            part[i] = p
            size[p] += 1
        sums = np.zeros((parts, x.shape[1]), np.float64)
        np.add.at(sums, part, x)
        centres = (sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))).astype(np.float32)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts)
            best = int(votes.argmax())
            if best != part[i] and votes[best] > votes[part[i]] and size[best] < limit:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < 0.01 * n:
            break
    return part


def fit_router(x: np.ndarray, parts: int) -> Router:
    """The classifier of the balanced parts of x's neighbour graph. x: unit rows."""
    parts = max(1, min(parts, len(x) // 4 or 1))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32))
    part = balanced_parts(neighbour_graph(x, NEIGHBOURS), x, parts)
    sums = np.zeros((parts, x.shape[1]), np.float64)
    np.add.at(sums, part, x)
    w = (8 * sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))).T.astype(np.float32)
    b = np.zeros(parts, np.float32)
    rng = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 1024)):
            z = x[rows] @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), part[rows]] -= 1
            w -= rate * (x[rows].T @ p / len(rows) + 1e-4 * w)
            b -= 0.1 * rate * p.mean(axis=0)
    return Router(w.astype(np.float32), b.astype(np.float32))


def probes_for_pairs(router: Router, x: np.ndarray, least: float, cover: float = COVER_PAIRS) -> int:
    """Probes at which ``cover`` of the pairs at the least similarity meet: each row with a partner in a random direction."""
    if router.parts == 1:
        return 1
    rng = np.random.default_rng(SEED + 1)
    x = x[:4096]
    noise = rng.standard_normal(x.shape).astype(np.float32)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.maximum(1e-9, np.linalg.norm(noise, axis=1, keepdims=True))
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * noise
    a, b = router.ranked(x, router.parts), router.ranked(y, router.parts)
    # a pair is found if either is routed to the other's home
    need = np.minimum(_place(a, b[:, :1]), _place(b, a[:, :1]))
    return min(a.shape[1], int(np.ceil(np.quantile(need, cover))))


def _place(order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """From 1, the place of the wanted part in each row; one more than there are where it isn't among them."""
    same = order == wanted
    return np.where(same.any(axis=1), same.argmax(axis=1) + 1, order.shape[1] + 1)


def probes_for_top(router: Router, x: np.ndarray, k: int, cover: float = COVER_TOP) -> int:
    """Probes at which ``cover`` of the sample's k nearest neighbours are in a part that the query is routed to."""
    if router.parts == 1 or len(x) < 3:
        return router.parts
    graph = neighbour_graph(x, k)[:2048]
    order, home = router.ranked(x[:2048], router.parts), router.ranked(x, 1)[:, 0]
    need = np.concatenate([_place(order, home[graph[:, i]][:, None]) for i in range(graph.shape[1])])
    return min(order.shape[1], int(np.ceil(np.quantile(need, cover))))


def unit_rows(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows of the usable vectors, which rows they are) of a list column."""
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    if not len(at):
        return np.zeros((0, dim), np.float32), at
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = np.abs(x).max(axis=1)
    good = np.isfinite(top) & (top > 0)
    x = x[good] / top[good, None]  # first by the largest, so that tiny and huge vectors have a norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), at[good]


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM) -> DataFrame:
    """(id, v): the usable vectors as unit rows of float32 bytes."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = unit_rows(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _bytes(x)], names=["id", "v"])

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.size("x") == dim).select("id", "x").mapInArrow(convert, "id bigint, v binary")


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.float32))]).cast(pa.binary())


def _rows(column, dim: int = DIM) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def fitted(vectors: DataFrame, dim: int = DIM, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> tuple[Router | TwoLevels, np.ndarray, int]:
    """(router, sample, number of vectors). The sample is at most MAX_SAMPLE rows; what a second level needs besides is fitted by the workers."""
    n = vectors.count()
    parts = int(min(max_parts, max(1, round(n / part_rows))))
    want = min(MAX_SAMPLE, max(8192, SAMPLE_PER_PART * parts))
    rows = vectors.select("v") if n <= want else vectors.select("v").sample(False, min(1.0, 1.05 * want / n), SEED).limit(want)
    sample = _rows([r[0] for r in rows.collect()], dim) if n else np.zeros((0, dim), np.float32)
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]  # what is measured on a part of it must not follow the scan
    if not len(sample):
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32)), sample, n
    router = fit_router(sample, parts)
    sub = min(MAX_SUB, -(-n // (max_parts * part_rows)))
    return (second_level(vectors, router, sub, dim) if sub > 1 and router.parts > 1 else router), sample, n


def second_level(vectors: DataFrame, router: Router, sub: int, dim: int = DIM) -> TwoLevels:
    """A router into ``sub`` parts of each part, fitted where its rows are, on about SAMPLE_PER_PART rows for each of them however many a part has.

    At most MAX_PARTS rows of MAX_SUB * (dim + 1) numbers reach the driver, and from there all workers.
    """
    homes = routed(vectors, router, 1, True, dim).select("part", "v")
    want = max(16 * sub, SAMPLE_PER_PART * sub)
    rates = {r["part"]: min(1.0, want / r["n"]) for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}

    def fit(group):
        import pandas as pd

        r = fit_router(_rows(group["v"], dim), sub)
        w, b = np.zeros((dim, sub), np.float32), np.full(sub, -1e4, np.float32)
        w[:, : r.parts], b[: r.parts] = r.weights, r.bias
        return pd.DataFrame({"part": [group["part"].iloc[0]], "w": [w.tobytes()], "b": [b.tobytes()]})

    weights, bias = np.zeros((router.parts, dim, sub), np.float32), np.full((router.parts, sub), -1e4, np.float32)
    bias[:, 0] = 0.0  # a part without a row has one sub-part
    for r in homes.sampleBy("part", rates, SEED).groupBy("part").applyInPandas(fit, "part int, w binary, b binary").collect():
        weights[r["part"]], bias[r["part"]] = np.frombuffer(r["w"], np.float32).reshape(dim, sub), np.frombuffer(r["b"], np.float32)
    return TwoLevels(router, weights, bias)


def routed(vectors: DataFrame, router: Router | TwoLevels, probes: int, base_only: bool = False, dim: int = DIM) -> DataFrame:
    """(part, rank, id, v): each vector once for each of its most probable parts; rank 0 is its home."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1).to_pylist(), dim)
            order = r.ranked(x, 1 if base_only else probes)
            at = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(x))), batch.column(0).take(at), batch.column(1).take(at)],
                names=["part", "rank", "id", "v"],
            )

    return vectors.mapInArrow(route, "part int, rank int, id bigint, v binary")


def _block_table(sizes: DataFrame, block: int) -> tuple[DataFrame, int]:
    """((part, base_blocks, query_blocks), rows that the block pairs have together) of (part, n_base, n_query). One row for each of at most MAX_PARTS * MAX_SUB parts."""
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / block)).cast("int")
    table = checkpointed(sizes.select("*", count("n_base").alias("base_blocks"), count("n_query").alias("query_blocks")))
    rows = table.agg(F.sum(F.coalesce("n_base", F.lit(0)) * F.col("query_blocks") + F.coalesce("n_query", F.lit(0)) * F.col("base_blocks"))).first()[0] or 0
    return F.broadcast(table.select("part", "base_blocks", "query_blocks")), int(rows)


def _entries(is_query: bool) -> F.Column:
    """Where a vector goes: to one block of its own kind, paired with each of the other's."""
    own, other = ("query_blocks", "base_blocks") if is_query else ("base_blocks", "query_blocks")
    at = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
    place = (lambda i: (i, at)) if is_query else (lambda i: (at, i))
    return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.struct(place(i)[0].alias("base_block"), place(i)[1].alias("query_block"), F.lit(is_query).alias("is_query")))


def _placed(rows: DataFrame, blocks: DataFrame, entries: F.Column) -> DataFrame:
    return rows.join(blocks, "part").select("part", "id", "v", F.explode(entries).alias("e")).select("part", "e.*", "id", "v")


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """By block pair, into as many partitions as the table of blocks says: a task has about TASK_ROWS rows however many there are in all."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), "part", "base_block", "query_block")


def _blocked(base: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """(part, base_block, query_block, is_query, id, v): base blocks and query blocks of each part, each with each."""
    sizes = base.groupBy("part").agg(F.count("*").alias("n_base")).join(queries.groupBy("part").agg(F.count("*").alias("n_query")), "part", "full")
    blocks, n = _block_table(sizes, block)
    return _spread(_placed(base, blocks, _entries(False)).unionByName(_placed(queries, blocks, _entries(True))), n)


def _blocked_among_themselves(routed_rows: DataFrame, block: int) -> DataFrame:
    """As ``_blocked``, of vectors that are base rows in their home (rank 0) and queries in all their parts; routed once for the sizes and once for the rows."""
    blocks, n = _block_table(routed_rows.groupBy("part").agg(F.sum((F.col("rank") == 0).cast("bigint")).alias("n_base"), F.count("*").alias("n_query")), block)
    return _spread(_placed(routed_rows, blocks, F.when(F.col("rank") == 0, F.concat(_entries(False), _entries(True))).otherwise(_entries(True))), n)


def pairs_above(vectors: DataFrame, least: float, dim: int = DIM, block: int = BLOCK, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs with a cosine of at least ``least``. vectors: (id, v) as ``usable`` gives them; ids are unique."""
    router, sample, _ = fitted(vectors, dim, part_rows, max_parts)
    probes = probes_for_pairs(router, sample, least) if len(sample) else 1
    everywhere = routed(vectors, router, probes, dim=dim)

    def found(group):
        import pandas as pd

        base, query = group[~group["is_query"]], group[group["is_query"]]
        out = []
        if len(base) and len(query):
            x, i = _rows(base["v"], dim), base["id"].to_numpy()
            for start in range(0, len(query), 1024):
                y, j = _rows(query["v"].iloc[start : start + 1024], dim), query["id"].to_numpy()[start : start + 1024]
                s = y @ x.T
                a, b = np.nonzero(s >= least - 1e-6)
                exact = np.einsum("ij,ij->i", y[a].astype(np.float64), x[b].astype(np.float64)) >= least - 1e-7
                a, b = j[a[exact]], i[b[exact]]
                other = a != b
                out.append(np.stack([np.minimum(a, b)[other], np.maximum(a, b)[other]], axis=1))
        both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"vec_a": both[:, 0], "vec_b": both[:, 1]})

    rows = _blocked_among_themselves(everywhere, block)
    return rows.groupBy("part", "base_block", "query_block").applyInPandas(found, "vec_a bigint, vec_b bigint").distinct()


def top_neighbours(vectors: DataFrame, queries: DataFrame, k: int, dim: int = DIM, block: int = BLOCK, part_rows: int = PART_ROWS, cover: float = COVER_TOP, max_parts: int = MAX_PARTS) -> DataFrame:
    """(query_id, vec_id, rank, cosine): the k most similar other vectors of each query. Both: (id, v) as ``usable`` gives them."""
    from pyspark.sql import Window

    router, sample, _ = fitted(vectors, dim, part_rows, max_parts)
    probes = probes_for_top(router, sample, k, cover) if len(sample) else 1

    def best(group):
        import pandas as pd

        base, query = group[~group["is_query"]].sort_values("id"), group[group["is_query"]]
        out = []
        if len(base) and len(query):
            x, i = _rows(base["v"], dim), base["id"].to_numpy()
            take = min(k + 1, len(i))
            for start in range(0, len(query), 1024):
                y, j = _rows(query["v"].iloc[start : start + 1024], dim), query["id"].to_numpy()[start : start + 1024]
                s = y @ x.T
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                out.append(pd.DataFrame({"query_id": np.repeat(j, take), "vec_id": i[top].ravel(), "cosine": np.take_along_axis(s, top, axis=1).ravel().astype(np.float64)}))
        rows = pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        return rows[rows["query_id"] != rows["vec_id"]]

    rows = _blocked(routed(vectors, router, 1, True, dim).drop("rank"), routed(queries, router, probes, dim=dim).drop("rank"), block)
    near = rows.groupBy("part", "base_block", "query_block").applyInPandas(best, "query_id bigint, vec_id bigint, cosine double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


def collection(spark, sf_dir: str) -> DataFrame:
    chunks, chapters = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) for t in ("chunks", "chapters"))
    return usable(chunks.unionByName(chapters), "vec_id", "embedding")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return pairs_above(collection(spark, sf_dir), 0.90)


def p5_top10(spark, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100, against all vectors."""
    vectors = collection(spark, sf_dir)
    return top_neighbours(vectors, vectors.where("id % 100 = 0"), 10)


P5_FOUND_SQL = """
WITH v AS (SELECT vec_id, CAST(e AS DOUBLE[64]) AS e FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM chunks UNION ALL SELECT vec_id, embedding FROM chapters)
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE array_cosine_similarity(a.e, b.e) >= 0.9 - 1e-7
"""
