"""k-means under DTW (C2-C5), initial and added centres (C9-C12), and the
packing of many independent models into one job (C13).

All sums of a pass are exact (``functions.exact``), so a fit has the same
bits however its rows are partitioned. That allows two ways to run one:

* a model of at most ``LOCAL_ROWS`` rows (counted first) is one bounded group: one task runs all its passes, the models
  of a fit side by side, in one job;
* a larger model runs pass by pass, one job a pass for all such models: each task assigns its rows and emits one wide row of sums per
  (model, cluster), which are added up on the executors, so models x k rows reach the driver.

Both end a model on its own convergence or at the pass cap, and give equal results.
"""

from __future__ import annotations

import time
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarp.config import RunConfig
from tidewarp.functions import exact
from tidewarp.functions.vec import uniform_py
from tidewarp.functions.arrowbatch import length_groups, stack_centres
from tidewarp.functions.dtw import NearestCentres, dtw_to_centres, dtw_to_row_centres
from tidewarp.operators.assign import Centres, assign, key_str, model_key


class KMeansFit:
    """Result of a fit: final centres, pass counts, shifts, per-model stats
    (sizes, silhouettes, mean distances) and the final assignment, whose
    plan is built on first use (search candidates usually never need it)."""

    def __init__(self, centres: Centres, assign_fn, passes: dict, shifts: dict, key_cols: list,
                 stats: dict | None = None):
        self.centres = centres
        self.passes = passes
        self.shifts = shifts
        self.key_cols = key_cols
        self.stats = stats or {}
        self.seconds: dict = {}  # task seconds of clustering, by model
        self._assign_fn = assign_fn
        self._assignments = None

    @property
    def assignments(self) -> DataFrame:
        if self._assignments is None:
            self._assignments = self._assign_fn()
        return self._assignments

    @assignments.setter
    def assignments(self, df: DataFrame) -> None:
        self._assignments = df


def centre_shift(old: np.ndarray, new: np.ndarray) -> float:
    """Sum over centres of the L1 distance between old and new."""
    return float(np.abs(np.asarray(old) - np.asarray(new)).sum())


LOCAL_ROWS = 1 << 18  # rows of a model that one task fits: 25 MB of series of 12


class ClusterSums(NamedTuple):
    """Sums over the members of a cluster, as multiples of 2^-104."""

    series: list  # L integers
    counts: list  # members with a value at each position
    size: int
    sil: int
    sil_rows: int
    dist: int
    seconds: float


def _measures(own: np.ndarray, other: np.ndarray, k_rows, compat: bool):
    """(silhouettes with NaN where there is none, own distances)."""
    den = np.maximum(own, other)
    with np.errstate(invalid="ignore", divide="ignore"):
        sil = np.where(den == 0, np.nan if compat else 0.0, (other - own) / den)
    return np.where(k_rows < 2, np.nan, sil)


def _assigned(X: np.ndarray, distances, kmax: int, k_rows, soft: bool):
    """(cluster, own distance, distance to the nearest other). ``distances(X, soft)`` gives (rows, kmax), infinite beyond a
    model's centres. Quality is measured with DTW whatever distance assigns."""
    D = distances(X, soft)
    cl = D.argmin(axis=1)
    if soft:
        D = distances(X, False)
    idx = np.arange(len(cl))
    own = D[idx, cl]
    D[idx, cl] = np.inf
    return cl, own, D.min(axis=1)


def _pass_plan(series: DataFrame, key_cols: list[str], cfg: RunConfig, length: int,
               series_col: str, centres) -> DataFrame:
    """One k-means pass as a map-side combine. ``centres``: a broadcast of {model string: (k, L)}.

    Each task assigns its rows (DTW against its model's centres, lowest index on ties) and emits one wide row per (model, cluster)
    it saw: the integers (``exact.split``) of L member sums, of the silhouettes and of the own distances, the counts of the L positions (a
    shorter series counts where it has values), the size, the rows with a silhouette, and the seconds spent. A series with a null or
    a non-finite value takes no part.
    """
    soft = cfg.distance == "soft_dtw"
    band, mode = cfg.band, ("prefix" if cfg.compat and not soft else "full")
    gamma, compat = (cfg.gamma if soft else None), cfg.compat
    w = length + 2

    def run(batches):
        table = centres.value
        acc: dict = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            for n, _, X, codes, names in length_groups(rb.column(0), rb.column(1)):
                stack, kval = stack_centres(table, names)
                if stack is None:
                    continue
                use = (kval[codes] > 0) & np.isfinite(X).all(axis=1)
                X, codes = X[use], codes[use]
                kr = kval[codes]
                if len(X) == 0:
                    continue
                kmax = stack.shape[1]
                began = time.perf_counter()
                padding = np.arange(kmax)[None, :] >= kr[:, None]

                def distances(X, by_soft):
                    D = dtw_to_row_centres(X, stack, codes, gamma=gamma if by_soft else None, band=band, mode=mode)
                    D[padding] = np.inf
                    return D

                cl, own, other = _assigned(X, distances, kmax, kr, soft)
                sil = _measures(own, other, kr, compat)
                grp, inv = np.unique(codes.astype(np.int64) * kmax + cl, return_inverse=True)
                ok = ~np.isnan(sil)
                g = len(grp)
                m = min(n, length)
                wide = np.zeros((len(X), w))
                wide[:, :m] = X[:, :m]
                wide[:, length] = np.where(ok, sil, 0.0)
                wide[:, length + 1] = own
                sums = exact.group_sums(exact.split(wide), inv, g)
                size = np.bincount(inv, minlength=g)
                counts = np.zeros((g, w), np.int64)
                counts[:, :m] = size[:, None]
                counts[:, length] = np.bincount(inv[ok], minlength=g)
                counts[:, length + 1] = size
                seconds = size * ((time.perf_counter() - began) / len(cl))
                for gi, key_code in enumerate(grp):
                    key = (names[int(key_code // kmax)], int(key_code % kmax))
                    row = (np.concatenate([sums[gi], counts[gi]]), seconds[gi])
                    acc[key] = (acc[key][0] + row[0], acc[key][1] + row[1]) if key in acc else row
        if acc:
            numbers = np.stack([v for v, _ in acc.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in acc], pa.string()), pa.array([c for _, c in acc], pa.int32()), *map(pa.array, numbers.T),
                 pa.array([t for _, t in acc.values()])],
                names=["_m", "cluster_id", *(f"s{i}" for i in range((exact.LIMBS + 1) * w)), "seconds"])

    return series.select(model_key(key_cols).alias("_m"), F.col(series_col).alias("_s")).mapInArrow(
        run, "_m string, cluster_id int, " + ", ".join(f"s{i} long" for i in range((exact.LIMBS + 1) * w)) + ", seconds double")


def pass_sums(series: DataFrame, centres: Centres, key_cols: list[str], cfg: RunConfig, length: int,
              series_col: str = "series_norm") -> dict:
    """Run one pass; returns {(model string, cluster): ClusterSums}, added up on the executors: models x k rows
    reach the driver. The centres travel as a Spark broadcast that ends with the pass."""
    sent = series.sparkSession.sparkContext.broadcast({key_str(k): np.asarray(v, dtype=np.float64) for k, v in centres.items()})
    try:
        plan = _pass_plan(series, key_cols, cfg, length, series_col, sent)
        rows = plan.groupBy("_m", "cluster_id").agg(*[F.sum(c).alias(c) for c in plan.columns[2:]]).toArrow()
    finally:
        sent.destroy()
    w = length + 2
    out = {}
    for m, c, *numbers, seconds in zip(*(col.to_pylist() for col in rows.columns)):
        totals, counts = exact.whole(numbers[:-w]), numbers[-w:]
        out[m, c] = ClusterSums(totals[:length], counts[:length], counts[length + 1], totals[length], counts[length], totals[length + 1], seconds)
    return out


def moved_centre(old: np.ndarray, sums: ClusterSums) -> np.ndarray:
    """Mean of the members, position by position; a position that no member has keeps its value."""
    return np.array([exact.quotient(t, n) if n else o for o, t, n in zip(old, sums.series, sums.counts)])


def update_centres(series: DataFrame, centres: Centres, key_cols: list[str], cfg: RunConfig, series_col: str = "series_norm",
                   seconds: dict | None = None) -> Centres:
    """One pass; every centre moves to the mean of its members, an empty cluster keeps its centre. ``seconds``
    takes the task seconds of each model (E5)."""
    new = {k: np.array(v, dtype=np.float64, copy=True) for k, v in centres.items()}
    by_str = {key_str(k): k for k in centres}
    for (mk, c), sums in pass_sums(series, centres, key_cols, cfg, cfg.series_length, series_col).items():
        key = by_str[mk]
        new[key][c] = moved_centre(new[key][c], sums)
        if seconds is not None:
            seconds[key] = seconds.get(key, 0.0) + sums.seconds
    return new


def _quality(size: int, sil: int, sil_rows: int, dist: int) -> tuple:
    """(size, mean silhouette or None, mean distance or None)."""
    return int(size), exact.quotient(sil, sil_rows) if sil_rows else None, exact.quotient(dist, size) if size else None


def _stats(sums: dict, by_str: dict) -> dict:
    """{model: {cluster: (size, mean silhouette or None, mean distance)}}."""
    st: dict = {}
    for (mk, c), v in sums.items():
        st.setdefault(by_str[mk], {})[c] = _quality(v.size, v.sil, v.sil_rows, v.dist)
    return st


LOCAL_FIT = "_m string, cluster_id int, centre array<double>, target array<double>, passes int, shift double, size long, sil double, dist double, seconds double"


def _local_fits(series: DataFrame, init: Centres, key_cols: list[str], cfg: RunConfig, series_col: str, with_stats: bool) -> DataFrame:
    """All passes of every model of ``init`` in one job, a task a model: a row of LOCAL_FIT per (model, cluster). The rows of a model are a
    bounded group (LOCAL_ROWS, counted by the caller)."""
    soft = cfg.distance == "soft_dtw"
    band, mode = cfg.band, ("prefix" if cfg.compat and not soft else "full")
    length, cap = cfg.series_length, cfg.max_iter + (1 if cfg.compat else 0)
    eta, compat, gamma = cfg.eta, cfg.compat, cfg.gamma
    on_grid = not soft and band is None and mode == "full"
    sent = series.sparkSession.sparkContext.broadcast({key_str(k): np.asarray(v, dtype=np.float64) for k, v in init.items()})

    def run(key, t):
        began = time.perf_counter()
        name = key[0].as_py()
        cur = sent.value[name]
        k = len(cur)
        parts = []  # (series, positions that count, grid of the series, clusters of the last pass) by length
        for n, _, X, _, _ in length_groups(t.column("_m"), t.column("_s")):
            X = X[np.isfinite(X).all(axis=1)]
            if len(X):
                m = min(n, length)
                parts.append([X, m, NearestCentres(X) if on_grid else None, np.full(len(X), -1)])

        def near(X, C):
            return _assigned(X, lambda X, by_soft: dtw_to_centres(X, C, gamma=gamma if by_soft else None, band=band, mode=mode), k, k, soft)

        totals, counts = [[0] * length for _ in range(k)], np.zeros((k, length), np.int64)

        def move(X, m, old, new):
            """Take the rows X out of the sums of their clusters (-1: they had none) and add them to others; the sums are integers, so nothing is lost."""
            ints = exact.split(X[:, :m])
            for clusters, sign in ((old, -1), (new, 1)):
                use = clusters >= 0
                if use.any():
                    counts[:, :m] += sign * np.bincount(clusters[use], minlength=k)[:, None]
                    for c, row in enumerate(exact.group_sums(ints if use.all() else ints[use], clusters[use], k).tolist()):
                        for i, total in enumerate(exact.whole(row)):
                            totals[c][i] += sign * total

        prev, shift, passes = cur, 0.0, 0
        while passes < cap:
            for part in parts:
                X, m, grid, last = part
                cl = dtw_to_centres(X, cur, gamma=gamma if soft else None, band=band, mode=mode).argmin(axis=1) if grid is None else grid(cur)
                moved = np.flatnonzero(cl != last)
                for at in range(0, len(moved), 1 << 14):
                    some = moved[at:at + (1 << 14)]
                    move(X[some], m, last[some], cl[some])
                part[3] = cl
            new = np.array([[exact.quotient(s, n) if n else o for s, n, o in zip(*row)] for row in zip(totals, counts.tolist(), cur.tolist())])
            passes += 1
            shift, prev, cur = centre_shift(cur, new), cur, new
            if shift < eta:
                break
        target = prev if compat else cur
        quality = [(None, None, None)] * k
        if with_stats:
            rows = [[0, 0, 0, 0] for _ in range(k)]
            for X, *_ in parts:
                cl, own, other = near(X, target)
                sil = _measures(own, other, np.full(len(X), k), compat)
                ok = ~np.isnan(sil)
                sums = exact.group_sums(exact.split(np.stack([np.where(ok, sil, 0.0), own], axis=1)), cl, k).tolist()
                for c, (size, seen) in enumerate(zip(np.bincount(cl, minlength=k).tolist(), np.bincount(cl[ok], minlength=k).tolist())):
                    sil_sum, dist_sum = exact.whole(sums[c])
                    rows[c] = [a + b for a, b in zip(rows[c], (size, sil_sum, seen, dist_sum))]
            quality = [_quality(*r) if r[0] else (0, None, None) for r in rows]
        spent = time.perf_counter() - began
        size, sil, dist = zip(*quality)
        return pa.table([pa.array([name] * k), pa.array(range(k), pa.int32()), pa.array(list(cur), pa.list_(pa.float64())), pa.array(list(target), pa.list_(pa.float64())),
                         pa.array([passes] * k, pa.int32()), pa.array([shift] * k), pa.array(size, pa.int64()), pa.array(sil, pa.float64()), pa.array(dist, pa.float64()),
                         pa.array([spent / k] * k)], [f.split()[0] for f in LOCAL_FIT.split(", ")])

    rows = series.select(model_key(key_cols).alias("_m"), F.col(series_col).alias("_s")).where(F.col("_m").isin([key_str(k) for k in init]))
    return rows.repartition(min(4 * len(init), 4096), "_m").groupBy("_m").applyInArrow(run, LOCAL_FIT)


def model_rows(series: DataFrame, key_cols: list[str]) -> dict:
    """{model: rows}; a row a model reaches the driver."""
    return {tuple(r[:-1]): r[-1] for r in series.groupBy(*key_cols).count().collect()}


def run_silhouettes(stats: dict, ks: dict | None = None) -> dict:
    """E3 from pass stats: {model: (sum of cluster silhouettes / k, {cluster: sil})};
    NULL for k < 2."""
    out = {}
    for key, cl in stats.items():
        k = ks[key] if ks else key[-1]
        sils = {c: v[1] for c, v in cl.items() if v[1] is not None}
        out[key] = (sum(sils.values()) / k if (k >= 2 and sils) else None, sils)
    return out


def fit(series: DataFrame, init: Centres, key_cols: list[str], cfg: RunConfig,
        series_col: str = "series_norm", with_stats: bool = True, rows_of: dict | None = None) -> KMeansFit:
    """C4: iterate until every model's shift < eta or the pass cap.

    ``series`` should be persisted by the caller where models run pass by pass (it is read once per pass).
    Default: ``max_iter`` passes, then a final assignment to the final
    centres. Compat: ``max_iter + 1`` passes and assignments to the centres
    of the last pass (Q3, Q4). ``with_stats`` gives sizes, silhouettes and mean distances (E1, E4)
    of every model under its final centres without materialising the assignment. ``rows_of``: the rows of
    each model, where the caller has counted them.
    """
    cur = {k: np.asarray(v, dtype=np.float64) for k, v in init.items()}
    prev = dict(cur)
    passes = {k: 0 for k in cur}
    shifts: dict = {}
    stats: dict = {}
    seconds: dict = {}
    by_str = {key_str(k): k for k in cur}
    cap = cfg.max_iter + 1 if cfg.compat else cfg.max_iter
    rows_of = model_rows(series, key_cols) if rows_of is None else rows_of
    local = {k: c for k, c in cur.items() if 0 < rows_of.get(k, 0) <= LOCAL_ROWS}
    if local and cap > 0:
        for r in _local_fits(series, local, key_cols, cfg, series_col, with_stats).collect():  # a row a centre
            key = by_str[r["_m"]]
            if r["cluster_id"] == 0:
                cur[key], prev[key] = np.empty_like(cur[key]), np.empty_like(cur[key])
            cur[key][r["cluster_id"]], prev[key][r["cluster_id"]] = r["centre"], r["target"]
            passes[key], shifts[key] = r["passes"], r["shift"]
            seconds[key] = seconds.get(key, 0.0) + r["seconds"]
            if r["size"]:
                stats.setdefault(key, {})[r["cluster_id"]] = (r["size"], r["sil"], r["dist"])
    else:
        local = {}
    active = set(cur) - set(local)
    step = 0
    while active and step < cap:
        new = update_centres(series, {k: cur[k] for k in active}, key_cols, cfg, series_col, seconds)
        step += 1
        for k in list(active):
            shifts[k] = centre_shift(cur[k], new[k])
            passes[k] += 1
            prev[k] = cur[k]
            cur[k] = new[k]
            if shifts[k] < cfg.eta:
                active.discard(k)
    target = prev if cfg.compat else cur
    result = KMeansFit(cur, lambda: assign(series, target, key_cols, cfg, series_col), passes, shifts,
                       list(key_cols))
    result.seconds = seconds
    if with_stats:
        large = {k: target[k] for k in cur if k not in local}
        if large:
            stats |= _stats(pass_sums(series, large, key_cols, cfg, cfg.series_length, series_col), by_str)
        result.stats = stats
    return result


# --------------------------------------------------------------------------
# initial and added centres
# --------------------------------------------------------------------------

def random_centres(k: int, length: int, seed) -> np.ndarray:
    """K repeatable uniform [0,1) vectors of length L (Q6: length L)."""
    return np.array([[uniform_py(seed, c, j) for j in range(length)] for c in range(k)], dtype=np.float64)


def lowest_id_centres(series: DataFrame, ks: list[int], tp_col: str = "time_point",
                      series_col: str = "series_norm") -> Centres:
    """Initial centres = series of the k lowest ids at each time point.

    A ``row_number() <= max k`` filter (a window group limit, applied
    map-side first) leaves T x max_k rows for the driver.
    """
    kmax = max(ks)
    w = Window.partitionBy(tp_col).orderBy("id")
    rows = (series.select(tp_col, "id", series_col)
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= kmax).collect())
    per_tp: dict = {}
    for r in rows:
        per_tp.setdefault(r[tp_col], []).append((r["_rn"], list(r[series_col])))
    out: Centres = {}
    for tp, lst in per_tp.items():
        lst.sort()
        mat = np.array([v for _, v in lst], dtype=np.float64)
        for k in ks:
            out[(tp, k)] = mat[:k]
    return out


def add_mean_of_centres(c: np.ndarray) -> np.ndarray:
    """Append the mean of the current centres."""
    c = np.asarray(c, dtype=np.float64)
    return np.vstack([c, c.mean(axis=0, keepdims=True)])


def add_random_centre(c: np.ndarray, seed) -> np.ndarray:
    """Append one repeatable uniform vector (index k of the seed's stream)."""
    c = np.asarray(c, dtype=np.float64)
    k, length = c.shape
    return np.vstack([c, [[uniform_py(seed, k, j) for j in range(length)]]])


def furthest_score():
    """Own distance x sum of the distances to the other centres."""
    others = F.filter("dists", lambda d, i: i != F.col("cluster_id"))
    return F.col("dist") * F.aggregate(others, F.lit(0.0), lambda a, x: a + x)


def _furthest(assigned: DataFrame, key_cols: list[str], score, series_col: str) -> DataFrame:
    """(keys, id, series) of each model's row of highest ``score``; ties go to the lowest id. One partial/final ``max_by`` job."""
    row = F.max_by(F.struct("id", F.col(series_col).alias("series")), F.struct(score.alias("s"), (-F.col("id")).alias("i")))
    return assigned.groupBy(*key_cols).agg(row.alias("r")).select(*key_cols, "r.id", "r.series")


def furthest_members(assigned: DataFrame, key_cols: list[str], series_col: str = "series_norm") -> DataFrame:
    """Per model, the member maximising own distance x sum of the other distances."""
    return _furthest(assigned, key_cols, furthest_score(), series_col)


def furthest_members_in(assigned: DataFrame, key_cols: list[str], worst: dict, series_col: str = "series_norm") -> DataFrame:
    """C11: per model, the member of cluster ``worst[key]`` furthest from its centre."""
    cond = F.lit(False)
    for key, c in worst.items():
        m = F.lit(True)
        for col, v in zip(key_cols, key):
            m = m & (F.col(col) == F.lit(v))
        cond = cond | (m & (F.col("cluster_id") == c))
    return _furthest(assigned.where(cond), key_cols, F.col("dist"), series_col)


def series_of(members: DataFrame, key_cols: list[str]) -> dict:
    """{model: series} of one member a model, on the driver."""
    return {tuple(r[c] for c in key_cols): np.asarray(r["series"], dtype=np.float64) for r in members.collect()}


def remove_centre(c: np.ndarray, index: int) -> np.ndarray:
    """F14 on a centre table: drop one centre, ids re-indexed densely."""
    c = np.asarray(c, dtype=np.float64)
    return np.delete(c, index, axis=0)


def fan_out_k(series: DataFrame, ks: list[int]) -> DataFrame:
    """One row per candidate k (parameter-bounded fan-out)."""
    return series.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))


def centres_frame(spark, centres: Centres, key_cols: list[str]):
    """The centre table as a small DataFrame ``(keys..., cluster_id, center)``."""
    from pyspark.sql import types as T

    fields = [T.StructField(c, T.IntegerType()) for c in key_cols]
    schema = T.StructType(fields + [T.StructField("cluster_id", T.IntegerType()),
                                    T.StructField("center", T.ArrayType(T.DoubleType()))])
    rows = [(*[int(v) for v in key], int(i), [float(x) for x in row])
            for key, mat in centres.items() for i, row in enumerate(np.asarray(mat))]
    return spark.createDataFrame(rows, schema)
