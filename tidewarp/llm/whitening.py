"""Whitening of embedding vectors with a weighted multiplicity covariance.

Components become integers x = floor(scale * c) + shift. Equal x vectors are grouped; the fit list holds each distinct one
with its fit weight, its multiplicity (``weights="count"``) or one (``weights="one"``). The mean is a quotient of exact sums, the covariance
a weighted product of centred matrices: a task centres its distinct vectors before it multiplies them, and the products, d x d
numbers a task, are added up on the executors. Only the covariance reaches the driver, which takes its eigenvectors. Each distinct
vector is then whitened once, and the rows join their vector's values by its key.

Groups go by a 128-bit digest of x, and are counted before they shuffle. A vector that more than one row in ``HOT`` carries is
joined from a broadcast table of at most HOT rows, the others by a plain shuffle, so copies of one vector load no task.

Vectors of different lengths cannot share a covariance: each length has its own list, mean and components.

Defined results: a row whose vector is null or holds a null or a non-finite component is dropped, and so is an empty vector,
which has no component. A null vec_id stays. Repeated rows each get their rows. Entries whose x would pass 2^53 are held
there. A ``deviation`` beyond a long is held at the limit of a long. A component without variance (no more than the
rounding error of the largest eigenvalue; all of them for a single distinct vector) has whitened 0 and takes no part in identity_error. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage

HOT = 1000
LIMIT = float(1 << 53)
LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: float, shift: int) -> DataFrame:
    """(vec_id, key, x) of the rows that take part; key: a digest of x."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    plain = F.forall(F.col("c"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where("c is not null and size(c) > 0").where(F.coalesce(plain, F.lit(False)))

    def run(batches):
        for b in batches:
            v = b.column(1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * v.flatten().to_numpy()), -LIMIT, LIMIT - shift).astype(np.int64) + shift
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            keys = [hashlib.blake2b(x[a:z].tobytes(), digest_size=16).digest() for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))], ["vec_id", "key", "x"])

    return rows.mapInArrow(run, "vec_id long, key binary, x array<long>")


def _matrices(b: pa.RecordBatch, column: str):
    """(rows, matrix) for each vector length of a batch."""
    v = b.column(column)
    size, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
    start = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def _totals(distinct: DataFrame) -> dict:
    """{length: (n, [S of each dimension])}, exact; a row a length and dimension reaches the driver."""
    def run(batches):
        for b in batches:
            w = b.column("weight").to_numpy()
            for rows, x in _matrices(b, "x"):
                high = int(np.abs(x).max()) * int(w[rows].sum())
                sums = w[rows] @ x if high < LONG else w[rows].astype(object) @ x.astype(object)
                d = x.shape[1]
                total = [str(int(s)) for s in sums]  # text: sums of many rows may pass a long
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()),
                                                  pa.array(np.full(d, w[rows].sum()), pa.int64()), pa.array(total)], ["d", "i", "w", "s"])

    out: dict = {}
    parts = distinct.select("x", "weight").mapInArrow(run, "d int, i int, w long, s string")
    for r in parts.groupBy("d", "i").agg(F.sum("w").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r.d, (r.n, [0] * r.d))[1][r.i] = int(r.s)
    return out


def _deviations(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """n x - S, exact: longs, or Python integers where they pass a long."""
    if int(np.abs(x).max(initial=0)) * n < LONG // 2 and max(map(abs, totals)) < LONG // 2:
        return x * np.int64(n) - np.array(totals, np.int64)
    return x.astype(object) * n - np.array(totals, object)


def _squares(dev: np.ndarray) -> np.ndarray:
    """Exact sums of squares, held at the limit of a long."""
    if dev.dtype == object or int(np.abs(dev).max(initial=0)) ** 2 * dev.shape[1] >= LONG:
        return np.array([min(LONG, sum(int(v) ** 2 for v in row)) for row in dev], np.int64)
    return (dev * dev).sum(axis=1)


def _products(table: DataFrame, column: str, centre) -> dict:
    """{length: covariance} of the staged ``table`` (column, d, weight), divisor the sum of weights; ``centre(d, matrix)`` gives the
    centred rows. The upper triangles of the tasks' products are added up on the executors."""
    def run(batches):
        held: dict = {}
        for b in batches:
            d_of, w = b.column("d").to_numpy(), b.column("weight").to_numpy()
            for d in np.unique(d_of):
                own = b.filter(pa.array(d_of == d))
                wide = own.column(column).value_lengths().to_numpy()
                m = centre(int(d), own.column(column).flatten().to_numpy().reshape(len(wide), -1))
                product = (m * w[d_of == d][:, None]).T @ m
                old = held.get(d, (0, 0))
                held[d] = (old[0] + product, old[1] + int(w[d_of == d].sum()))
        for d, (product, weight) in held.items():
            i, j = np.triu_indices(len(product))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(product[i, j]), pa.array(np.full(len(i), weight), pa.int64())], ["d", "i", "j", "v", "w"])

    sums = table.select(column, "d", "weight").mapInArrow(run, "d int, i int, j int, v double, w long").groupBy("d", "i", "j").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    cells: dict = {}
    for r in sums.collect():  # half the square of a length
        cells.setdefault(r.d, []).append((r.i, r.j, r.v / r.w))
    out = {}
    for d, rows in cells.items():
        m = np.zeros((max(r[1] for r in rows) + 1,) * 2)
        for i, j, v in rows:
            m[i, j] = m[j, i] = v
        out[d] = m
    return out


def components(covariance: np.ndarray, most: int):
    """(eigenvalues, eigenvectors as columns, shares of the trace) of the ``most`` largest; a value within rounding error of 0 is 0."""
    e, v = np.linalg.eigh(covariance)
    order = np.argsort(e, kind="stable")[::-1][:most]
    e, v = e[order], v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # one sign, whatever the solver gives
    trace = np.trace(covariance)
    e = np.where(e > len(covariance) * np.finfo(float).eps * max(e[0], 0.0), e, 0.0)
    return e, v, e / trace if trace > 0 else np.zeros(len(e))


def whiten(vectors: DataFrame, scale: float = 64.0, shift: int = 1000000, most: int = 16, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors`` (vec_id, embedding)
    that takes part and each of its ``most`` first components. n: the sum of the fit weights of its length."""
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be 'one' or 'count', not {weights!r}")
    spark = vectors.sparkSession
    prepare(spark)
    rows = stage(integer_vectors(vectors, scale, shift), "white-rows")
    grouped = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    distinct = stage(grouped.select("key", "copies", "x", F.size("x").alias("d"), (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("weight")), "white-distinct")
    totals = _totals(distinct)

    def centred(d, x):
        n, s = totals[d]
        return _deviations(x, n, s).astype(np.float64) / n

    axes = {d: components(m, most) for d, m in _products(distinct, "x", centred).items()}
    sent = spark.sparkContext.broadcast((totals, axes))  # numbers in proportion to the dimensions

    def project(batches):
        totals, axes = sent.value
        for b in batches:
            size, z = np.empty(b.num_rows, np.int64), [None] * b.num_rows
            for at, x in _matrices(b, "x"):
                n, s = totals[x.shape[1]]
                e, v, _ = axes[x.shape[1]]
                dev = _deviations(x, n, s)
                size[at] = _squares(dev)
                scaled = (dev.astype(np.float64) / n) @ v * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
                for i, row in zip(at, scaled):
                    z[i] = row
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), b.column("weight"), b.column("d"), pa.array(size), pa.array(z, pa.list_(pa.float64()))],
                                             ["key", "copies", "weight", "d", "deviation", "z"])

    done = stage(distinct.mapInArrow(project, "key binary, copies long, weight long, d int, deviation long, z array<double>"), "white-done")
    means: dict = {}
    by_place = done.select("d", "weight", F.posexplode("z").alias("i", "z")).groupBy("d", "i").agg((F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("m"))
    for r in by_place.collect():  # `most` rows a length
        means.setdefault(r.d, {})[r.i] = r.m
    spread = _products(done, "z", lambda d, z: z - np.array([means[d][i] for i in range(z.shape[1])]))
    facts = []
    for d, (n, _) in totals.items():
        e, _, share = axes[d]
        have = np.flatnonzero(e > 0)
        error = np.abs(spread[d][np.ix_(have, have)] - np.eye(len(have))).max(initial=0.0)
        facts.append((d, n, share.tolist(), float(error)))
    facts = spark.createDataFrame(facts, "d int, n long, share array<double>, identity_error double")  # a row a length

    # a vector of many rows is sent to the tasks: at most HOT vectors have more than a HOT-th of all rows
    count = rows.count()
    many = F.col("copies") * HOT > count
    hot = stage(done.where(many).select("key", "d", "deviation", "z"), "white-hot")
    ids = rows.select("vec_id", "key")
    out = ids.join(F.broadcast(hot), "key").unionByName(
        ids.join(F.broadcast(hot.select("key")), "key", "left_anti").join(done.where(~many).select("key", "d", "deviation", "z"), "key"))
    out = out.join(F.broadcast(facts), "d").select("vec_id", "n", "deviation", "identity_error", "share", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("share")[F.col("at")].alias("explained"), "identity_error")
