"""Registered queries: clustering (C), quality (E), profiles (A, K), PCA (P)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.functions import vec as V
from tidewarp.operators import kmeans as km
from tidewarp.operators import profile as A
from tidewarp.operators import quality as Q
from tidewarp.operators import select as S
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import ORACLE_CFG, ORACLE_K, ORACLE_PASSES, _oracle_fit, fx1_fit, r6, register
from tidewarp.plans.q_basic import dflat, flat
from tidewarp.plans.series import fixture_series
from tidewarp.session import cut_lineage, session_key

L = 12
KEYS = ["time_point", "k"]


def _fit(spark, sf_dir):
    return fx1_fit(spark, sf_dir)[1]


def _asg(spark, sf_dir) -> DataFrame:
    return _fit(spark, sf_dir).assignments


# ---------------------------------------------------------------- C

def _sql_c1():
    q, s, c, a = _oracle_fit()
    return q.render(f"SELECT time_point, k, id, cluster_id, round(dist, 6) AS dist FROM {a}")


@register("c1_j3_assign_nearest_centre", _sql_c1())
def c1(spark, sf_dir):
    return _asg(spark, sf_dir).select("time_point", "k", "id", "cluster_id", r6(F.col("dist")).alias("dist"))


def _sql_c2():
    q = O.Sql()
    s = O.fixture_series(q, "fx1")
    sk = O.fan_out_k(q, s, [ORACLE_K])
    c0 = O.lowest_id_centres(q, s, [ORACLE_K])
    a = O.assign(q, sk, c0, "p1")
    c1 = O.update(q, sk, a, c0, L, "c1")
    return q.render(dflat(c1, ["time_point", "k", "cluster_id"], "center"))


@register("c2_update_centres_one_pass", _sql_c2())
def c2(spark, sf_dir):
    s, _ = fx1_fit(spark, sf_dir)
    sk = km.fan_out_k(s, [ORACLE_K])
    init = km.lowest_id_centres(s, [ORACLE_K])
    new = km.update_centres(sk, init, KEYS, ORACLE_CFG)
    return flat(km.centres_frame(spark, new, KEYS), ["time_point", "k", "cluster_id"], "center")


SOFT_CFG = ORACLE_CFG.with_(distance="soft_dtw", max_iter=1)


def _sql_c4_soft():
    q = O.Sql()
    s = O.fixture_series(q, "fx1")
    sk = O.fan_out_k(q, s, [ORACLE_K])
    c, a = O.kmeans(q, sk, O.lowest_id_centres(q, s, [ORACLE_K]), SOFT_CFG.max_iter, L, SOFT_CFG.gamma)
    return q.render(f"""SELECT a.time_point, a.k, a.id, a.cluster_id, round({O.dtw('a.series_norm', 'c.center')}, 6) AS dist
FROM {a} a JOIN {c} c ON c.time_point = a.time_point AND c.k = a.k AND c.cluster_id = a.cluster_id""")


@register("c4_soft_dtw_kmeans", _sql_c4_soft())
def c4_soft(spark, sf_dir):
    """C1/C4 under soft-DTW: assignment by soft-DTW, distances measured with DTW."""
    s, _ = fx1_fit(spark, sf_dir)
    sk = km.fan_out_k(s, [ORACLE_K])
    fit = km.fit(sk, km.lowest_id_centres(s, [ORACLE_K]), KEYS, SOFT_CFG)
    return fit.assignments.select("time_point", "k", "id", "cluster_id", r6(F.col("dist")).alias("dist"))


def _sql_c3():
    q, s, c, a = _oracle_fit()
    prev, last = f"km_c{ORACLE_PASSES - 1}", f"km_c{ORACLE_PASSES}"
    return q.render(f"""SELECT p.time_point, p.k, round(sum({O.l1('p.center', 'n.center')}), 6) AS shift,
  sum({O.l1('p.center', 'n.center')}) < 1e-7 AS converged
FROM {prev} p JOIN {last} n ON p.time_point = n.time_point AND p.k = n.k AND p.cluster_id = n.cluster_id
GROUP BY p.time_point, p.k""")


@register("c3_f17_centre_shift_converged", _sql_c3())
def c3(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    rows = [(int(k[0]), int(k[1]), float(v), bool(V.converged(v, 1e-7))) for k, v in fit.shifts.items()]
    df = spark.createDataFrame(rows, "time_point int, k int, shift double, converged boolean")
    return df.withColumn("shift", r6(F.col("shift")))


def _sql_c4():
    q, s, c, a = _oracle_fit()
    return q.render(dflat(c, ["time_point", "k", "cluster_id"], "center"))


@register("c4_kmeans_final_centres", _sql_c4())
def c4(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    return flat(km.centres_frame(spark, fit.centres, KEYS), ["time_point", "k", "cluster_id"], "center")


SWEEP_KS, SWEEP_PASSES = [5, 6, 7, 8, 9, 10], 2


def _sql_c6():
    q, s, c, a = _oracle_fit(SWEEP_KS, SWEEP_PASSES)
    cs = q.add("csil", f"""SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil
FROM {a} GROUP BY time_point, k, cluster_id""")
    rs = q.add("rsil", f"SELECT time_point, k, sum(sil) / k AS run_sil FROM {cs} GROUP BY time_point, k")
    return q.render(f"""SELECT time_point, CAST(first(k ORDER BY run_sil DESC, k) AS INTEGER) AS best_k,
  round(max(run_sil), 6) AS run_silhouette FROM {rs} GROUP BY time_point""")


@register("c6_k_sweep_best_silhouette", _sql_c6())
def c6(spark, sf_dir):
    s, _ = fx1_fit(spark, sf_dir)
    choices, _ = S.sweep(s, ORACLE_CFG.with_(max_iter=SWEEP_PASSES, min_k=min(SWEEP_KS), max_k=max(SWEEP_KS)))
    rows = [(int(tp), int(c.k), float(c.run_silhouette)) for tp, c in choices.items()]
    return spark.createDataFrame(rows, "time_point int, best_k int, run_silhouette double").withColumn(
        "run_silhouette", r6(F.col("run_silhouette")))


RANDOM_SEED = 42


def _sql_c13():
    q = O.Sql()
    s = O.fixture_series(q, "fx1")
    sk = O.fan_out_k(q, s, [ORACLE_K])
    keys = q.add("keys", f"SELECT DISTINCT time_point, {ORACLE_K} AS k FROM {s}")
    c0 = O.random_centres(q, keys, RANDOM_SEED, L)
    c, a = O.kmeans(q, sk, c0, ORACLE_PASSES, L)
    return q.render(f"""SELECT time_point, k, cluster_id, CAST(count(*) AS BIGINT) AS cluster_count,
  round(avg(dist), 6) AS mean_distance FROM {a} GROUP BY time_point, k, cluster_id""")


_RANDOM_FITS: dict = {}


def random_init_fit(spark, sf_dir):
    key = (session_key(spark), sf_dir)
    if key not in _RANDOM_FITS:
        s, _ = fx1_fit(spark, sf_dir)
        sk = km.fan_out_k(s, [ORACLE_K])  # explode per pass over the cached base, no cached copy
        tps = [r[0] for r in s.select("time_point").distinct().collect()]
        init = {(tp, ORACLE_K): km.random_centres(ORACLE_K, L, f"{RANDOM_SEED}-{tp}-{ORACLE_K}") for tp in tps}
        _RANDOM_FITS[key] = km.fit(sk, init, KEYS, ORACLE_CFG)
    return _RANDOM_FITS[key]


@register("c13_c5_independent_time_points_random_init", _sql_c13())
def c13(spark, sf_dir):
    a = random_init_fit(spark, sf_dir).assignments
    return (a.groupBy("time_point", "k", "cluster_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("cluster_count"), r6(F.avg("dist")).alias("mean_distance")))


def _sql_c9():
    q, s, c, a = _oracle_fit()
    keys = q.add("keys", f"SELECT DISTINCT time_point, k FROM {c}")
    u = O.uniform01(f"concat_ws('-', '{RANDOM_SEED}', time_point, k)", "k", "j")
    v = q.add("v", f"SELECT time_point, k, list_transform(range(0, {L}), lambda j: {u}) AS center FROM {keys}")
    return q.render(dflat(v, ["time_point", "k"], "center"))


@register("c9_new_centre_random", _sql_c9())
def c9(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    rows = [(int(tp), int(k), km.add_random_centre(c, f"{RANDOM_SEED}-{tp}-{k}")[-1].tolist())
            for (tp, k), c in fit.centres.items()]
    df = spark.createDataFrame(rows, "time_point int, k int, center array<double>")
    return flat(df, ["time_point", "k"], "center")


def _score_sql():
    others = "list_filter(dists, lambda d, i: i - 1 <> cluster_id)"
    return f"dist * list_reduce({others}, lambda s, v: s + v, 0.0::DOUBLE)"


def _sql_c10():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT time_point, k, first(id ORDER BY {_score_sql()} DESC, id) AS id
FROM {a} GROUP BY time_point, k""")


@register("c10_new_centre_furthest", _sql_c10())
def c10(spark, sf_dir):
    return km.furthest_members(_asg(spark, sf_dir), KEYS).select(*KEYS, "id")


def _worst_sql(q, a):
    cs = q.add("csil", f"""SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil
FROM {a} GROUP BY time_point, k, cluster_id""")
    return q.add("worst", f"""SELECT time_point, k, CAST(first(cluster_id ORDER BY sil, cluster_id) AS INTEGER) AS worst
FROM {cs} GROUP BY time_point, k""")


def _sql_c11():
    q, s, c, a = _oracle_fit()
    w = _worst_sql(q, a)
    return q.render(f"""SELECT a.time_point, a.k, w.worst AS worst_cluster, first(a.id ORDER BY a.dist DESC, a.id) AS id
FROM {a} a JOIN {w} w ON a.time_point = w.time_point AND a.k = w.k AND a.cluster_id = w.worst
GROUP BY a.time_point, a.k, w.worst""")


@register("c11_new_centre_furthest_in_worst_cluster", _sql_c11())
def c11(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    worst = {key: S.worst_cluster(sils, False) for key, (_, sils) in km.run_silhouettes(fit.stats).items()}
    return km.furthest_members_in(fit.assignments, KEYS, worst).join(
        spark.createDataFrame([(*map(int, key), int(c)) for key, c in worst.items()], "time_point int, k int, worst_cluster int"), KEYS).select(*KEYS, "worst_cluster", "id")


def _sql_c12():
    q, s, c, a = _oracle_fit()
    v = q.add("v", f"""SELECT time_point, k, [{", ".join(f"avg(center[{i + 1}])" for i in range(L))}] AS center
FROM {c} GROUP BY time_point, k""")
    return q.render(dflat(v, ["time_point", "k"], "center"))


@register("c12_new_centre_mean_of_centres", _sql_c12())
def c12(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    rows = [(int(tp), int(k), km.add_mean_of_centres(c)[-1].tolist()) for (tp, k), c in fit.centres.items()]
    return flat(spark.createDataFrame(rows, "time_point int, k int, center array<double>"), ["time_point", "k"], "center")


# ---------------------------------------------------------------- E

def _sql_e1():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT time_point, k, cluster_id, round(avg({O.silhouette_row()}), 6) AS silhouette
FROM {a} GROUP BY time_point, k, cluster_id""")


@register("e1_cluster_silhouette", _sql_e1())
def e1(spark, sf_dir):
    return Q.cluster_silhouettes(_asg(spark, sf_dir), KEYS).withColumn("silhouette", r6(F.col("silhouette")))


def _sql_e2():
    q, s, c, a = _oracle_fit()
    b = "list_min(list_filter(dists, lambda d, i: i - 1 <> cluster_id))"
    return q.render(f"SELECT time_point, k, id, round({b}, 6) AS nearest_other FROM {a}")


@register("e2_nearest_other_centre", _sql_e2())
def e2(spark, sf_dir):
    return Q.row_silhouettes(_asg(spark, sf_dir)).select("time_point", "k", "id", r6(F.col("nearest_other")).alias("nearest_other"))


def _sql_e3():
    q, s, c, a = _oracle_fit()
    cs = q.add("csil", f"SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil FROM {a} GROUP BY ALL")
    return q.render(f"SELECT time_point, k, round(sum(sil) / k, 6) AS run_silhouette FROM {cs} GROUP BY time_point, k")


@register("e3_a9_run_silhouette_per_month", _sql_e3())
def e3(spark, sf_dir):
    cs = Q.cluster_silhouettes(_asg(spark, sf_dir), KEYS)
    return Q.run_silhouette(cs, KEYS).withColumn("run_silhouette", r6(F.col("run_silhouette")))


def _sql_e4():
    q, s, c, a = _oracle_fit()
    return q.render(f"SELECT time_point, k, cluster_id, round(avg(dist), 6) AS mean_distance FROM {a} GROUP BY ALL")


@register("e4_w6_mean_distance", _sql_e4())
def e4(spark, sf_dir):
    return Q.mean_distance(_asg(spark, sf_dir), KEYS).withColumn("mean_distance", r6(F.col("mean_distance")))


@register("e5_elapsed_seconds")
def e5(spark, sf_dir):
    """E5: task seconds of the clustering passes of each time point, as measured inside the passes."""
    s, _ = fx1_fit(spark, sf_dir)
    fit = km.fit(km.fan_out_k(s, [ORACLE_K]), km.lowest_id_centres(s, [ORACLE_K]), KEYS, ORACLE_CFG.with_(max_iter=1))
    return spark.createDataFrame([(int(tp), float(x)) for (tp, _), x in fit.seconds.items()], "time_point int, spent_time double")


# ---------------------------------------------------------------- A

def _simple(select_sql: str):
    q, s, c, a = _oracle_fit()
    return q.render(select_sql.format(a=a, c=c, s=s))


@register("a1_w8_cluster_size", _simple(
    "SELECT time_point, k, cluster_id, CAST(count(*) AS BIGINT) AS cluster_count FROM {a} GROUP BY ALL"))
def a1(spark, sf_dir):
    return A.cluster_size(_asg(spark, sf_dir), KEYS)


@register("a2_w9_member_lists", _simple(
    "SELECT time_point, k, cluster_id, CAST(floor(id / 10000) AS BIGINT) AS block, "
    "array_to_string(list_sort(list(id)), ';') AS members FROM {a} GROUP BY ALL"))
def a2(spark, sf_dir):
    return A.member_lists(_asg(spark, sf_dir), KEYS)


def _sql_a3():
    q, s, c, a = _oracle_fit()
    m = q.add("m", f"""SELECT time_point, k, cluster_id, [{", ".join(f"avg(series_norm[{i + 1}])" for i in range(L))}] AS center
FROM {a} GROUP BY time_point, k, cluster_id""")
    return q.render(dflat(m, ["time_point", "k", "cluster_id"], "center"))


@register("a3_cluster_mean_vector", _sql_a3())
def a3(spark, sf_dir):
    return flat(A.cluster_mean_vector(_asg(spark, sf_dir), KEYS, L), ["time_point", "k", "cluster_id"], "center")


def _sql_a4():
    q, s, c, a = _oracle_fit()
    m = q.add("m", f"""SELECT time_point, k, cluster_id, [{", ".join(f"sum(series_full[{i + 1}])" for i in range(15))}] AS total
FROM {a} GROUP BY time_point, k, cluster_id""")
    return q.render(dflat(m, ["time_point", "k", "cluster_id"], "total"))


@register("a4_w3_cluster_total_vector", _sql_a4())
def a4(spark, sf_dir):
    return flat(A.cluster_total_vector(_asg(spark, sf_dir), KEYS, 15), ["time_point", "k", "cluster_id"], "total")


def _sql_a5():
    q, s, c, a = _oracle_fit()
    m = q.add("m", f"""SELECT time_point, k, cluster_id, [{", ".join(f"avg(series_raw[{i + 1}])" for i in range(L))}] AS mr
FROM {a} GROUP BY time_point, k, cluster_id""")
    return q.render(f"SELECT time_point, k, cluster_id, round({O.lmean('mr')}, 6) AS mean, round({O.lsd('mr')}, 6) AS sd FROM {m}")


@register("a5_w4_cluster_statistic", _sql_a5())
def a5(spark, sf_dir):
    st = A.cluster_statistic(_asg(spark, sf_dir), KEYS, L)
    return st.withColumn("mean", r6(F.col("mean"))).withColumn("sd", r6(F.col("sd")))


def _sql_a6():
    q, s, c, a = _oracle_fit()
    cs = q.add("csil", f"SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil FROM {a} GROUP BY ALL")
    j = q.add("j", f"""SELECT c.time_point, c.k, c.cluster_id, coalesce(s.sil, -1.0) AS silhouette, c.center
FROM {c} c LEFT JOIN {cs} s ON c.time_point = s.time_point AND c.k = s.k AND c.cluster_id = s.cluster_id""")
    return q.render(f"""SELECT time_point, k, cluster_id, round(silhouette, 6) AS silhouette, pos, round(value, 6) AS value
FROM (SELECT *, CAST(unnest(range(len(center))) AS INTEGER) AS pos, unnest(center) AS value FROM {j})""")


@register("a6_w2_result_per_centre", _sql_a6())
def a6(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    cs = Q.cluster_silhouettes(fit.assignments, KEYS)
    r = A.result_per_centre(km.centres_frame(spark, fit.centres, KEYS), cs, KEYS)
    return flat(r.withColumn("silhouette", r6(F.col("silhouette"))), [*KEYS, "cluster_id", "silhouette"], "center")


def _sql_a7():
    q, s, c, a = _oracle_fit()
    m = q.add("m", f"""SELECT time_point, k, cluster_id, [{", ".join(f"avg(series_norm[{i + 1}])" for i in range(L))}] AS center
FROM {a} GROUP BY time_point, k, cluster_id""")
    sp = q.add("spine", f"SELECT DISTINCT time_point, k, CAST(unnest(range(0, k)) AS INTEGER) AS cluster_id FROM {a}")
    j = q.add("j", f"""SELECT sp.time_point, sp.k, sp.cluster_id, coalesce(m.center, list_transform(range({L}), lambda x: -1.0)) AS center
FROM {sp} sp LEFT JOIN {m} m ON sp.time_point = m.time_point AND sp.k = m.k AND sp.cluster_id = m.cluster_id""")
    return q.render(dflat(j, ["time_point", "k", "cluster_id"], "center"))


@register("a7_centres_by_column_means", _sql_a7())
def a7(spark, sf_dir):
    a = _asg(spark, sf_dir)
    models = a.select(*KEYS).distinct()
    return flat(A.centres_by_column_means(a, models, KEYS, L), ["time_point", "k", "cluster_id"], "center")


@register("a8_member_set_sizes", _simple(
    "SELECT time_point, k, cluster_id, CAST(count(DISTINCT id) AS BIGINT) AS n_distinct FROM {a} GROUP BY ALL"))
def a8(spark, sf_dir):
    sizes, _ = A.member_sets(_asg(spark, sf_dir), KEYS)
    return sizes


@register("a10_argmax_furthest_member", _simple(
    "SELECT time_point, k, first(id ORDER BY dist DESC, id) AS id, round(max(dist), 6) AS score FROM {a} GROUP BY ALL"))
def a10(spark, sf_dir):
    r = A.argmax_by(_asg(spark, sf_dir), KEYS, "id", "dist")
    return r.withColumn("score", r6(F.col("score")))


# ---------------------------------------------------------------- K

K1_N = 5


def _sql_k1():
    q, s, c, a = _oracle_fit()
    d = q.add("dd", f"""SELECT time_point, k, cluster_id, series_norm, min(dist) AS dist, min(id) AS id
FROM {a} GROUP BY time_point, k, cluster_id, series_norm""")
    return q.render(f"""SELECT time_point, k, cluster_id, id, round(dist, 6) AS dist, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY time_point, k, cluster_id ORDER BY dist, id) AS INTEGER) AS rank
  FROM {d}) WHERE rank <= {K1_N}""")


@register("k1_nearest_samples", _sql_k1())
def k1(spark, sf_dir):
    r = A.nearest_samples(_asg(spark, sf_dir), KEYS, K1_N)
    return r.select(*KEYS, "cluster_id", "id", r6(F.col("dist")).alias("dist"), F.col("rank").cast("int"))


def _sql_k2(limit: int | None = None):
    q, s, c, a = _oracle_fit()
    m = q.add("m", f"""SELECT time_point, k, cluster_id, [{", ".join(f"avg(series_norm[{i + 1}])" for i in range(L))}] AS own_mean
FROM {a} GROUP BY time_point, k, cluster_id""")
    d = q.add("dd", f"""SELECT a.time_point, a.k, a.cluster_id, a.id, a.series_norm, {O.dtw('a.series_norm', 'm.own_mean')} AS mean_dist
FROM {a} a JOIN {m} m ON a.time_point = m.time_point AND a.k = m.k AND a.cluster_id = m.cluster_id""")
    r = q.add("rk", f"""SELECT *, CAST(row_number() OVER (PARTITION BY time_point, k, cluster_id ORDER BY mean_dist, id) AS INTEGER) AS rank
FROM {d}""")
    if limit is None:
        return q.render(f"SELECT time_point, k, cluster_id, id, rank, round(mean_dist, 6) AS mean_dist FROM {r}")
    return q.render(f"""SELECT time_point, k, cluster_id, id, rank, concat_ws(',', CAST(id AS VARCHAR),
  array_to_string(list_transform(series_norm, lambda v: printf('%.6f', v)), ',')) AS line
FROM {r} WHERE rank <= {limit}""")


@register("k2_rank_by_own_mean", _sql_k2())
def k2(spark, sf_dir):
    r = A.rank_by_own_mean(_asg(spark, sf_dir), KEYS, L, ORACLE_CFG)
    return r.select(*KEYS, "cluster_id", "id", "rank", r6(F.col("mean_dist")).alias("mean_dist"))


K3_N = 3


@register("k3_first_ranked_with_series", _sql_k2(K3_N))
def k3(spark, sf_dir):
    r = A.first_by_own_mean(_asg(spark, sf_dir), KEYS, L, ORACLE_CFG, K3_N)
    return r.select(*KEYS, "cluster_id", "id", "rank", V.series_to_text("id", "series_norm", 6).alias("line"))


@register("k4_every_sixth_month_sizes", _simple(
    "SELECT time_point, k, cluster_id, CAST(count(*) AS BIGINT) AS cluster_count FROM {a} "
    "WHERE (time_point + 1 + 11) % 6 = 0 GROUP BY ALL"))
def k4(spark, sf_dir):
    return A.every_sixth(A.cluster_size(_asg(spark, sf_dir), KEYS))


# ---------------------------------------------------------------- P (property-checked, rows only)

_PCA: dict = {}


def pca_per_time_point(spark, sf_dir):
    key = (session_key(spark), sf_dir)
    if key not in _PCA:
        s, _ = fx1_fit(spark, sf_dir)
        _PCA[key] = Q.pca_by_group(s, "time_point", 3)
    return _PCA[key]


def pca_projection(spark, sf_dir) -> DataFrame:
    """Every series of every time point projected on that time point's
    first two components (sign-fixed, no centring)."""
    s, _ = fx1_fit(spark, sf_dir)
    j = Q.project_by_group(s, pca_per_time_point(spark, sf_dir), "time_point", L, 2)
    return j.select("time_point", "id", F.col("pca")[0].alias("pc1"), F.col("pca")[1].alias("pc2"))


def _sql_pca(columns: str = "r.time_point, r.id", k: int = 2):
    q = O.Sql()
    s = O.fixture_series(q, "fx1")
    return q.render(f"SELECT * FROM {O.projected(q, s, O.pca(q, s, L, 3), columns, k)}")


@register("p1_pca_transform", _sql_pca())
def p1(spark, sf_dir):
    return pca_projection(spark, sf_dir).select("time_point", "id", r6(F.col("pc1")).alias("pc1"), r6(F.col("pc2")).alias("pc2"))


def _sql_p2():
    q = O.Sql()
    c = O.pca(q, O.fixture_series(q, "fx1"), L, 3)
    return q.render(f"""SELECT time_point, component, CAST(unnest(range({L})) AS INTEGER) AS pos, round(unnest(pc), 6) AS loading, round(explained, 6) AS explained FROM {c}""")


@register("p2_pca_fit_components", _sql_p2())
def p2(spark, sf_dir):
    fits = pca_per_time_point(spark, sf_dir)
    rows = [(int(tp), int(c), int(p), float(pc[p, c]), float(ev[c]))
            for tp, (pc, ev) in fits.items() for c in range(pc.shape[1]) for p in range(pc.shape[0])]
    df = spark.createDataFrame(rows, "time_point int, component int, pos int, loading double, explained double")
    return df.withColumn("loading", r6(F.col("loading"))).withColumn("explained", r6(F.col("explained")))


MEMBER_SQL = "array_to_string(list_transform(r.series_norm, lambda v: printf('%.6f', v)), ',') AS member"


def member_text(col):
    return F.array_join(F.transform(col, lambda v: F.format_string("%.6f", v)), ",")


def _sql_samples(prefix: str = ""):
    q, s, c, a = _oracle_fit()
    d = q.add("dd", f"""SELECT time_point, k, cluster_id, series_norm, min(dist) AS dist, min(id) AS id
FROM {a} GROUP BY time_point, k, cluster_id, series_norm""")
    r = q.add("samples", f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY time_point, k, cluster_id ORDER BY dist, id) AS INTEGER) AS rank
FROM {d}) WHERE rank <= {K1_N}""")
    columns = f"{prefix}r.time_point, r.k, r.cluster_id, {'' if prefix else 'r.rank, '}round(r.dist, 6) AS dist, {MEMBER_SQL}"
    return q.render(f"SELECT * FROM {O.projected(q, r, O.pca(q, s, L, 3), columns, 3)}")


@register("p3_w7_project_samples", _sql_samples())
def p3(spark, sf_dir):
    """K1 samples projected on the components of their time point."""
    samples = A.nearest_samples(_asg(spark, sf_dir), KEYS, K1_N)
    j = Q.project_by_group(samples, pca_per_time_point(spark, sf_dir), "time_point", L, 3)
    return j.select(*KEYS, "cluster_id", F.col("rank").cast("int"), r6(F.col("dist")).alias("dist"), member_text("series_norm").alias("member"),
                    *[r6(F.col("pca")[i]).alias(f"pc{i + 1}") for i in range(3)])


# ---------------------------------------------------------------- D4, X8, SQL surface

def _sql_d4():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT time_point, k, id, CAST(c - 1 AS INTEGER) AS centre, round(d, 6) AS d FROM (
  SELECT time_point, k, id, unnest(range(1, len(dists) + 1)) AS c, unnest(dists) AS d FROM {a})""")


@register("d4_all_distances", _sql_d4())
def d4(spark, sf_dir):
    a = _asg(spark, sf_dir)
    return (a.select("time_point", "k", "id", F.posexplode("dists").alias("centre", "d"))
            .select("time_point", "k", "id", F.col("centre").cast("int"), r6(F.col("d")).alias("d")))


X8_CLUSTER = 0


def _sql_x8():
    q, s, c, a = _oracle_fit()
    return q.render(f"SELECT time_point, k, id, round({O.lsum('series_norm')}, 6) AS norm_sum FROM {a} "
                    f"WHERE cluster_id = {X8_CLUSTER}")


@register("x8_members_of_cluster", _sql_x8())
def x8(spark, sf_dir):
    from tidewarp.operators.reshape import members_of

    m = members_of(_asg(spark, sf_dir), X8_CLUSTER)
    return m.select("time_point", "k", "id", r6(V.series_sum("series_norm")).alias("norm_sum"))


def _sql_dsql():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT a.time_point, a.id, round({O.dtw('a.series_norm', 'c.center')}, 6) AS d
FROM {a} a JOIN {c} c ON a.time_point = c.time_point AND a.k = c.k AND c.cluster_id = 0""")


@register("d1_dtw_registered_sql_function", _sql_dsql())
def dsql(spark, sf_dir):
    """The SQL surface: ``dtw`` registered as a function and called from SQL."""
    from tidewarp.functions.dtw import register as register_functions

    fit = _fit(spark, sf_dir)
    register_functions(spark)
    fit.assignments.select("time_point", "k", "id", "series_norm").createOrReplaceTempView("tw_assignments")
    km.centres_frame(spark, fit.centres, KEYS).createOrReplaceTempView("tw_centres")
    return spark.sql("""SELECT a.time_point, a.id, round(dtw(a.series_norm, c.center), 6) + 0.0 AS d
FROM tw_assignments a JOIN tw_centres c ON a.time_point = c.time_point AND a.k = c.k AND c.cluster_id = 0""")
