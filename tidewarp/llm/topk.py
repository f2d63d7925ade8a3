"""Exact top-k search by inner product: tiled matrix products, a partial selection per tile, a tree of merges.

Queries are taken in blocks of bounded size; a block is broadcast and multiplied with every shard of candidates (an
Arrow batch of a scan task). A tile keeps the k best of each query, a task merges the tiles it sees, and the lists of the
tasks are merged per query in two levels, so no task holds more than k rows of each of a part of the tasks.

Scores are integers: components are floor(scale * x). Products run in double precision where all partial sums stay
below 2^53 and are thus exact, else on Python integers. A score beyond 64 bits is held at the limit of a long.

Defined results: a row whose vector is null or empty or holds a null or a non-finite component, and a row with a null
vec_id, take no part. Vectors of different lengths are not compared. Ties go to the smaller vec_id. Repeated rows of
one vec_id are each a candidate for other ids; an id is never its own candidate, and is one query however often it
occurs (its smallest row by components). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage

EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    plain = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & F.coalesce(plain, F.lit(False))))


def _rows(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length of an Arrow batch of (vec_id, v)."""
    ids = batch.column(0).to_numpy()
    v = batch.column(1)
    size, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
    start = np.cumsum(size) - size
    for n in np.unique(size):
        own = size == n
        yield ids[own], flat[start[own][:, None] + np.arange(n)]


def _scaled(matrix: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        m = np.floor(scale * matrix)
    if not np.isfinite(m).all() or np.abs(m).max(initial=0) >= EXACT:
        from fractions import Fraction
        m = np.array([[int(Fraction(x) * Fraction(scale) // 1) for x in row] for row in matrix.tolist()], object)
    return m


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    if queries.dtype != object and shard.dtype != object:
        if np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * shard.shape[1] < EXACT:
            return (queries @ shard.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in queries.tolist()], object) @ np.array([[int(x) for x in r] for r in shard.tolist()], object).T
    return np.clip(whole, -LONG, LONG).astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k first of each query by (score descending, id ascending)."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.empty(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], score[keep]


def _tile_best(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """Partial selection in one tile: k + 1 scores a query (one may be its own), and all that tie with the last."""
    own = q_ids[:, None] == ids[None, :]
    n = scores.shape[1]
    low = np.iinfo(np.int64).min
    scores = np.where(own, low, scores)
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        pick = (scores >= least[:, None]) & ~own
    else:
        pick = ~own
    r, c = np.nonzero(pick)
    return _best(q_ids[r], ids[c], scores[r, c], k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = 8192, tile_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row of ``queries``, both
    (vec_id, embedding). At most about ``block_rows`` queries are broadcast at a time."""
    spark = vectors.sparkSession
    prepare(spark)
    base = usable(vectors)
    asked = stage(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    count = asked.count()
    blocks = max(1, -(-count // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        part = asked.where(F.col("block") == block).select("vec_id", "v").toArrow()  # about block_rows rows, by the hash
        sent = spark.sparkContext.broadcast([(i, _scaled(m, scale)) for b in part.combine_chunks().to_batches() for i, m in _rows(b)])

        def run(batches, sent=sent):
            own = [(np.empty(0, np.int64),) * 3]
            held = 0
            for b in batches:
                for at in range(0, b.num_rows, tile_rows):
                    for ids, matrix in _rows(b.slice(at, tile_rows)):
                        shard = _scaled(matrix, scale)
                        for q_ids, q in sent.value:
                            if q.shape[1] == shard.shape[1]:
                                for lo in range(0, len(q_ids), 1024):
                                    own.append(_tile_best(q_ids[lo:lo + 1024], _products(q[lo:lo + 1024], shard), ids, k))
                                    held += len(own[-1][0])
                        if held > 4 * block_rows * k:
                            own = [_best(*map(np.concatenate, zip(*own)), k)]
                            held = len(own[0][0])
            query, ids, score = _best(*map(np.concatenate, zip(*own)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, ids, score)], ["query_id", "vec_id", "score"])

        tops = base.mapInArrow(run, "query_id long, vec_id long, score long")
        tops = stage(tops, "topk-tiles") if blocks > 1 else tops
        found = tops if found is None else found.unionByName(tops)

    def merge(rows: DataFrame, *by: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)

    leaves = found.withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(16)))
    return merge(merge(leaves, "query_id", "leaf").drop("rank", "leaf"), "query_id").select("query_id", "rank", "vec_id", "score")
