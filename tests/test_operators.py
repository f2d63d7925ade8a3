"""Operators on small hand-made fixtures (edge cases of FIXTURES.md section 4)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.config import RunConfig
from tidewarp.functions import vec as V
from tidewarp.operators import drift as J
from tidewarp.operators import kmeans as km
from tidewarp.operators import profile as A
from tidewarp.operators import quality as Q
from tidewarp.operators import reshape as X
from tidewarp.operators import select as S
from tidewarp.operators.assign import assign

KEYS = ["time_point", "k"]


def series_df(spark, rows, k=None):
    """rows: (time_point, id, norm list)."""
    df = spark.createDataFrame([(t, i, [float(v) for v in s]) for t, i, s in rows],
                               "time_point int, id long, series_norm array<double>")
    df = df.withColumn("series_raw", F.col("series_norm")).withColumn("series_full", F.col("series_norm"))
    return df.withColumn("k", F.lit(k)) if k else df


def test_normalise_and_stats(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0],), ([1.0, 3.0, 2.0],), ([5.0],)], "s array<double>")
    out = df.select(V.minmax_normalise("s").alias("n"), V.series_sd("s").alias("sd"),
                    V.series_mean("s").alias("m")).collect()
    assert out[0]["n"] == [0.0, 0.0, 0.0]
    assert out[1]["n"] == [0.0, 1.0, 0.5]
    assert out[2]["sd"] is None and out[2]["m"] == 5.0
    assert math.isclose(out[1]["sd"], 1.0)


def test_nearest_ties_lowest_id_and_empty_cluster_keeps_centre(spark):
    s = series_df(spark, [(0, i, [0.1 * i, 0.2, 0.3]) for i in range(6)], k=3)
    same = np.array([0.2, 0.2, 0.3])
    far = np.array([9.0, 9.0, 9.0])
    init = {(0, 3): np.vstack([same, same, far])}
    cfg = RunConfig(eta=0.0, max_iter=1, series_length=3)
    a = assign(s, init, KEYS, cfg).collect()
    assert {r["cluster_id"] for r in a} == {0}  # identical centres 0 and 1: lowest id wins
    fit = km.fit(s, init, KEYS, cfg)
    assert np.array_equal(fit.centres[(0, 3)][2], far)  # empty cluster keeps its centre
    assert np.array_equal(fit.centres[(0, 3)][1], same)
    sizes = {c: v[0] for c, v in fit.stats[(0, 3)].items()}
    assert sum(sizes.values()) == 6 and 2 not in sizes  # stats on the final centres; far one empty


def test_silhouette_edges(spark):
    s = series_df(spark, [(0, 1, [0.0, 0.0]), (0, 2, [0.0, 0.0])], k=1)
    cfg = RunConfig(eta=0.0, max_iter=1, series_length=2)
    a = assign(s, {(0, 1): np.array([[0.0, 0.0]])}, KEYS, cfg)
    assert Q.cluster_silhouettes(a, KEYS).collect()[0]["silhouette"] is None  # one centre: NULL
    s2 = s.withColumn("k", F.lit(2))
    a2 = assign(s2, {(0, 2): np.array([[0.0, 0.0], [0.0, 0.0]])}, KEYS, cfg)
    assert Q.cluster_silhouettes(a2, KEYS).collect()[0]["silhouette"] == 0.0  # a = b = 0


def _random_series(n_tp, n_id, length, seed=7):
    rng = random.Random(seed)
    return [(t, i, [rng.random() for _ in range(length)]) for t in range(n_tp) for i in range(n_id)]


def test_packed_models_equal_separate_and_partition_independent(spark):
    rows = _random_series(3, 40, 6)
    cfg = RunConfig(eta=0.0, max_iter=3, series_length=6)
    base = series_df(spark, rows)
    init = {(t, k): km.random_centres(k, 6, f"t-{t}-{k}") for t in range(3) for k in (2, 3)}
    packed = km.fit(km.fan_out_k(base, [2, 3]), init, KEYS, cfg)
    for (t, k), c0 in init.items():
        one = km.fit(base.where(F.col("time_point") == t).withColumn("k", F.lit(k)), {(t, k): c0}, KEYS, cfg)
        assert np.allclose(one.centres[(t, k)], packed.centres[(t, k)], atol=1e-12)
    again = km.fit(km.fan_out_k(base.repartition(7), [2, 3]), init, KEYS, cfg)
    for key in init:
        assert np.allclose(again.centres[key], packed.centres[key], atol=1e-12)


def test_fit_stats_match_sql_silhouettes(spark):
    rows = _random_series(2, 30, 5, seed=3)
    cfg = RunConfig(eta=0.0, max_iter=2, series_length=5)
    s = series_df(spark, rows, k=3)
    init = {(t, 3): km.random_centres(3, 5, f"x{t}") for t in range(2)}
    fit = km.fit(s, init, KEYS, cfg)
    sql = {(r["time_point"], r["k"], r["cluster_id"]): r["silhouette"]
           for r in Q.cluster_silhouettes(fit.assignments, KEYS).collect()}
    for key, cl in fit.stats.items():
        for c, (n, sil, _) in cl.items():
            assert math.isclose(sil, sql[(*key, c)], abs_tol=1e-12)


def test_migration_and_stability_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for t in range(4):
        for i in range(30):
            if rng.random() < 0.9:
                rows.append((t, i, rng.randrange(3)))
    a = spark.createDataFrame(rows, "time_point int, id long, cluster_id int")
    mig = J.migration(a).collect()
    by_t = {}
    for t, i, c in rows:
        by_t.setdefault(t, {})[i] = c
    for t in range(1, 4):
        common = set(by_t[t]) & set(by_t[t - 1])
        assert sum(r["number_cus"] for r in mig if r["time_point"] == t) == len(common)
    for lag in (1, 2):
        got = {(r["time_point"], r["id"]): r["ratio"] for r in J.companion_ratio(a, lag).collect()}
        for t in range(4 - lag):
            now, later = by_t[t], by_t[t + lag]
            for i, c in now.items():
                mates = [j for j, cj in now.items() if cj == c]
                want = None if i not in later else sum(
                    1 for j in mates if j in later and later[j] == later[i]) / len(mates)
                assert got[(t, i)] == want


def test_nearest_samples_dedup_and_member_blocks(spark):
    rows = [(0, 1, [0.1, 0.2]), (0, 2, [0.1, 0.2]), (0, 3, [0.5, 0.5])]
    s = series_df(spark, rows, k=1)
    a = assign(s, {(0, 1): np.array([[0.1, 0.2]])}, KEYS, RunConfig(series_length=2))
    samples = A.nearest_samples(a, KEYS, 5).collect()
    assert sorted(r["id"] for r in samples) == [1, 3]  # identical vectors counted once
    big = spark.range(0, 25).select(F.lit(0).alias("time_point"), F.lit(1).alias("k"),
                                    F.lit(0).alias("cluster_id"), F.col("id"))
    blocks = A.member_lists(big, KEYS, chunk=10).collect()
    assert sorted(len(r["members"].split(";")) for r in blocks) == [5, 10, 10]


def test_sample_exact_and_dense_index(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "id")
    s1 = {r["id"] for r in X.sample_exact(df, 37, 11).collect()}
    s2 = {r["id"] for r in X.sample_exact(df.repartition(5), 37, 11).collect()}
    assert len(s1) == 37 and s1 == s2
    pos = X.dense_index(df.repartition(4), ["id"]).collect()
    assert sorted(r["row_pos"] for r in pos) == list(range(1, 501))
    assert all(r["row_pos"] == r["id"] + 1 for r in pos)


def test_rank_within_groups(spark):
    rows = [(g, i, float((i * 7) % 5)) for g in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, id long, d double")
    got = A.rank_within(df, ["g"], ["d", "id"]).collect()
    for g in range(3):
        mine = sorted((r["d"], r["id"], r["rank"]) for r in got if r["g"] == g)
        assert [m[2] for m in mine] == list(range(1, 21))


def test_grouped_pca_matches_library(spark):
    rows = _random_series(1, 60, 6, seed=9)
    s = series_df(spark, rows)
    pc_lib, ev_lib = Q.pca_fit(s, 3)
    pc_grp, ev_grp = Q.pca_by_group(s, "time_point", 3)[0]
    assert np.allclose(np.abs(pc_lib), np.abs(pc_grp), atol=1e-8)
    assert np.allclose(ev_lib, ev_grp, atol=1e-8)


def test_warm_run_properties(spark):
    rows = _random_series(4, 40, 6, seed=1)
    s = series_df(spark, rows)
    cfg = RunConfig(eta=1e-6, max_iter=4, min_k=2, max_k=4, series_length=6, warm_start=True,
                    new_centre_method="furthest")
    from tidewarp.operators import select as S

    choices, a = S.warm_run(s, cfg)
    assert sorted(choices) == [0, 1, 2, 3]
    for c in choices.values():
        assert cfg.min_k <= c.k <= cfg.max_k
        assert c.run_silhouette is None or -1 <= c.run_silhouette <= 1
    assert a.count() == len(rows)
    for method in ("random", "furthest_in_cluster", "mean_of_previous_mean"):
        ch, _ = S.warm_run(s.where(F.col("time_point") <= 1), cfg.with_(new_centre_method=method))
        assert sorted(ch) == [0, 1]


@pytest.mark.parametrize("lag", [1, 3])
def test_changed_threshold_inclusive(spark, lag):
    rows = [(t, i, 0) for t in range(lag + 1) for i in range(4)]
    a = spark.createDataFrame(rows, "time_point int, id long, cluster_id int")
    ch = J.changed_customers(a, lag, 1.0).collect()  # ratio is exactly 1.0: counted as changed
    assert len(ch) == 4


def test_compat_quirks(spark):
    from tidewarp.functions.dtw import dtw_one
    from tidewarp.operators import select as S

    rows = _random_series(1, 20, 5, seed=4)
    s = series_df(spark, rows, k=2)
    init = {(0, 2): km.random_centres(2, 5, "q")}
    cfg = RunConfig(eta=0.0, max_iter=2, series_length=5, compat=True)
    fit = km.fit(s, init, KEYS, cfg)
    assert fit.passes[(0, 2)] == 3  # Q4: max_iter + 1 passes
    # Q3: assignments are to the centres before the last update; Q1: prefix corner
    prev_fit = km.fit(s, init, KEYS, cfg.with_(max_iter=1))
    prev_centres = prev_fit.centres[(0, 2)]
    for r in fit.assignments.collect():
        want = min(dtw_one(r["series_norm"], c, mode="prefix") for c in prev_centres)
        assert math.isclose(r["dist"], want, rel_tol=1e-12, abs_tol=1e-12)
    assert S.worst_cluster({0: 0.9, 1: 0.1}, compat=True) == 0  # Q5: lowest cluster id
    assert S.worst_cluster({0: 0.9, 1: 0.1}, compat=False) == 1


def test_ragged_series_count_where_they_have_values(spark):
    rows = [(0, 1, 1, [0.1, 0.2, 0.3]), (0, 1, 2, [0.3, 0.4])]
    s = spark.createDataFrame(rows, "time_point int, k int, id long, series_norm array<double>")
    cfg = RunConfig(series_length=3, eta=0.0, max_iter=1)
    fit = km.fit(s, {(0, 1): np.array([[0.2, 0.2, 0.2]])}, ["time_point", "k"], cfg)
    assert np.allclose(fit.centres[(0, 1)], [[0.2, 0.3, 0.3]])
    means = A.cluster_mean_vector(fit.assignments, ["time_point", "k"], 3).collect()
    assert np.allclose(means[0]["center"], [0.2, 0.3, 0.3])


def test_migration_across_a_change_of_k(spark):
    rows = [(0, 5, 1, 0), (0, 5, 2, 1), (1, 6, 1, 2), (1, 6, 2, 1), (2, 6, 1, 2), (2, 6, 2, 1)]
    a = spark.createDataFrame(rows, "time_point int, k int, id long, cluster_id int")
    got = J.migration(a.select("time_point", "id", "cluster_id"), ["time_point"]).collect()
    assert sorted((r.time_point, r.cluster_previous, r.cluster_current) for r in got) == [(1, 0, 2), (1, 1, 1), (2, 1, 1), (2, 2, 2)]


def test_equal_searches_keep():
    c = {k: S.Choice(0, k, None, sil, {}, kind) for k, sil, kind in ((4, 0.2, "keep"), (3, 0.5, "backward"), (5, 0.5, "forward"))}
    assert S._chosen(c[4], c[3], c[5]) is c[4] and S._chosen(c[4], c[3], None) is c[3] and S._chosen(c[4], None, None) is c[4]
    better = S.Choice(0, 5, None, 0.6, {}, "forward")
    assert S._chosen(c[4], c[3], better) is better


def test_registered_searches_keep_the_original_pass_limit_and_eta():
    from tidewarp.plans.q_select import SEARCH_CFG

    assert (SEARCH_CFG.max_iter, SEARCH_CFG.eta, SEARCH_CFG.min_k, SEARCH_CFG.max_k) == (200, 1e-7, 5, 10)


def test_sums_do_not_depend_on_order_or_partitions():
    from tidewarp.functions import exact

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((500, 3)), rng.normal(0, 1e5, (50, 3)), np.zeros((2, 3)), [[1e-300, -1e-17, 0.1]]])
    group = rng.integers(0, 4, len(x))
    parts = exact.split(x)
    want = exact.group_sums(parts, group, 5)
    order = rng.permutation(len(x))
    assert np.array_equal(want, exact.group_sums(parts[order], group[order], 5))
    halves = sum(exact.group_sums(parts[i::2], group[i::2], 5) for i in range(2))
    assert np.array_equal(want, halves) and not want[4].any()
    from fractions import Fraction
    for g in range(4):
        rows = x[group == g]
        for j in range(3):
            total = sum(Fraction(round(Fraction(v) * 2 ** 104)) for v in rows[:, j].tolist())
            assert exact.whole(want[g])[j] == total
            assert exact.quotient(exact.whole(want[g])[j], len(rows)) == float(total / 2 ** 104 / len(rows))


@pytest.mark.parametrize("change", [{}, {"compat": True}, {"distance": "soft_dtw"}, {"band": 2}])
def test_a_fit_in_one_task_equals_the_fit_pass_by_pass(spark, monkeypatch, change):
    rng = random.Random(8)
    rows = [(t, i, [rng.random() for _ in range(6 if i % 7 else 4)]) for t in range(2) for i in range(60)]
    rows += [(0, 100, [float("nan")] * 6), (1, 101, rows[3][2])]
    s = km.fan_out_k(series_df(spark, rows), [1, 3, 4])
    init = {(t, k): km.random_centres(k, 6, f"same-{t}-{k}") for t in range(2) for k in (1, 3, 4)} | {(7, 3): km.random_centres(3, 6, "no rows")}
    cfg = RunConfig(eta=1e-7, max_iter=9, series_length=6, **change)
    local = km.fit(s, init, KEYS, cfg)
    monkeypatch.setattr(km, "LOCAL_ROWS", 0)
    passes = km.fit(s.repartition(5), init, KEYS, cfg)
    assert local.passes == passes.passes and local.shifts == passes.shifts and local.stats == passes.stats
    for key in init:
        assert np.array_equal(local.centres[key], passes.centres[key])
    drop = lambda f: sorted((r["time_point"], r["k"], r["id"], r["cluster_id"], r["dist"]) for r in f.assignments.where("id <> 100").collect())
    assert drop(local) == drop(passes)
    assert set(local.seconds) == set(passes.seconds) == set(init) - {(7, 3)}


def _brute_warm(X, cfg):
    """The warm run by plain loops: {time point: (k, silhouette, kind, steps)}."""
    from tidewarp.functions.dtw import dtw_to_centres

    def fitted(x, c):
        c = np.array(c)
        for _ in range(cfg.max_iter):
            a = dtw_to_centres(x, c).argmin(1)
            new = np.array([[math.fsum(x[a == j, i]) / (a == j).sum() if (a == j).any() else c[j, i] for i in range(x.shape[1])] for j in range(len(c))])
            moved, c = np.abs(new - c).sum(), new
            if moved < cfg.eta:
                break
        D = dtw_to_centres(x, c)
        a = D.argmin(1)
        own = D[np.arange(len(x)), a]
        rest = D.copy()
        rest[np.arange(len(x)), a] = np.inf
        other = rest.min(1)
        sil = (other - own) / np.maximum(own, other)
        sils = {j: sil[a == j].mean() for j in range(len(c)) if (a == j).any()}
        return c, sum(sils.values()) / len(c), sils, (x, a, D)

    def grown(c, state, sils, tp, step):
        x, a, D = state
        own = D[np.arange(len(x)), a]
        if cfg.new_centre_method == "random":
            return km.add_random_centre(c, f"{cfg.seed}-{tp}-{len(c)}-add{step}")
        if cfg.new_centre_method == "furthest":
            return np.vstack([c, x[(own * (D.sum(1) - own)).argmax()]])
        if cfg.new_centre_method == "furthest_in_cluster":
            worst = min(sils, key=lambda j: (sils[j], j))
            return np.vstack([c, x[np.where(a == worst, own, -1).argmax()]])
        return km.add_mean_of_centres(c)

    out, prev = {}, None
    for tp in sorted(X):
        x = X[tp]
        if prev is None:
            fits = {k: fitted(x, km.random_centres(k, x.shape[1], f"{cfg.seed}-{tp}-{k}")) for k in range(cfg.min_k, cfg.max_k + 1)}
            k = max(sorted(fits), key=lambda k: fits[k][1])
            prev = fits[k][0]
            out[tp] = (k, fits[k][1], "sweep", [])
            continue
        keep = fitted(x, prev)
        found, steps = {}, []
        for name, sign in (("backward", -1), ("forward", 1)):
            c, (_, sil, sils, state), step = prev, keep, 1
            while cfg.min_k <= len(c) + sign <= cfg.max_k and len(c) + sign >= 2:
                start = np.delete(c, min(sils, key=lambda j: (sils[j], j)), axis=0) if sign < 0 else grown(c, state, sils, tp, step)
                new = fitted(x, start)
                steps.append((step, name, len(start), new[1]))
                if not new[1] > sil + cfg.sil_threshold:
                    break
                (c, sil, sils, state), step = new, step + 1
                found[name] = (len(c), sil, name, c)
        b, f = found.get("backward"), found.get("forward")
        best = (len(prev), keep[1], "keep", keep[0])
        if b or f:
            best = b if not f or (b and b[1] > f[1]) else f if not b or f[1] > b[1] else best
        prev = best[3]
        out[tp] = (*best[:3], [s[1:] for s in sorted(steps, key=lambda s: s[:2])])
    return out


@pytest.mark.parametrize("method", ["random", "furthest", "furthest_in_cluster", "mean_of_previous_mean"])
@pytest.mark.parametrize("local", [True, False])
def test_warm_run_against_plain_loops(spark, monkeypatch, method, local):
    if not local:
        monkeypatch.setattr(km, "LOCAL_ROWS", 0)
    rng = np.random.default_rng(17)
    shapes = rng.random((4, 5))
    X = {t: np.clip(shapes[np.arange(24) % (3 + t % 2)] + rng.normal(0, 0.08 + 0.05 * t, (24, 5)), 0, 1) for t in range(3)}
    s = series_df(spark, [(t, i, x.tolist()) for t, rows in X.items() for i, x in enumerate(rows)])
    cfg = RunConfig(eta=1e-7, max_iter=200 if local else 6, min_k=2, max_k=6, series_length=5, warm_start=True, new_centre_method=method, sil_threshold=0.02)
    choices, a = S.warm_run(s, cfg)
    want = _brute_warm(X, cfg)
    assert sorted(choices) == sorted(want)
    for tp, c in choices.items():
        k, sil, kind, steps = want[tp]
        assert (c.k, c.kind) == (k, kind) and math.isclose(c.run_silhouette, sil, abs_tol=1e-9)
        assert [x[:2] for x in c.steps] == [x[:2] for x in steps]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(c.steps, steps))
    assert a.count() == 72


def test_positions_come_from_staged_files(spark):
    """A partition that is read again, in any order and alone, has the positions it had; ties keep one position each."""
    df = spark.createDataFrame([(i % 50, i) for i in range(2000)], "v int, id long").repartition(9)
    pos = X.dense_index(df, ["v"], start=0)
    whole = sorted(map(tuple, pos.collect()))
    assert sorted(r[2] for r in whole) == list(range(2000))
    assert all(a[2] < b[2] for a in whole[:200] for b in whole[-200:])
    parts = pos.rdd.glom().collect()
    assert sorted(tuple(r) for p in reversed(parts) for r in p) == whole
    assert sorted(map(tuple, pos.where("v = 7").collect())) == [r for r in whole if r[0] == 7]
    assert not spark.sparkContext._jsc.getPersistentRDDs().containsKey(pos.rdd.id())
    assert X.dense_index(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_stability_of_all_lags_from_one_trajectory(spark, monkeypatch, limit):
    monkeypatch.setattr(J, "BROADCAST_ROWS", limit)
    rng = random.Random(12)
    rows = [(t, k, i, rng.randrange(k)) for t in (0, 1, 2, 4, 5) for k in (2, 3) for i in range(25) if rng.random() < 0.85]
    a = spark.createDataFrame(rows, "time_point int, k int, id long, cluster_id int")
    got = sorted((r.time_point, r.k, r.lag, r.id, r.c_now, -1 if r.c_later is None else r.c_later, r.remain or 0, r.companions, r.ratio or 0) for r in J.companion_ratios(a, (1, 2, 7), ["time_point", "k"]).collect())
    by = {}
    for t, k, i, c in rows:
        by.setdefault((t, k), {})[i] = c
    want = []
    for (t, k), now in by.items():
        for lag in (1, 2, 7):
            later = by.get((t + lag, k))
            for i, c in now.items() if later else ():
                mates = [j for j in now if now[j] == c]
                stay = sum(later.get(j) == later[i] for j in mates) if i in later else 0
                want.append((t, k, lag, i, c, later.get(i, -1), stay, len(mates), stay / len(mates)))
    assert got == sorted(want)
    lags = J.changed_over_lags(a, (1, 2), 0.6, ["time_point", "k"])
    assert lags.count() == sum(J.changed_customers(a, lag, 0.6, ["time_point", "k"]).count() for lag in (1, 2))


def test_first_by_own_mean_equals_the_head_of_the_full_rank(spark):
    a = km.fit(series_df(spark, _random_series(2, 60, 5), k=3), {(t, 3): km.random_centres(3, 5, f"m{t}") for t in range(2)}, KEYS, RunConfig(eta=0.0, max_iter=2, series_length=5)).assignments
    cfg = RunConfig(series_length=5)
    few = A.first_by_own_mean(a, KEYS, 5, cfg, 4)
    whole = A.rank_by_own_mean(a, KEYS, 5, cfg).where("rank <= 4")
    pick = lambda d: sorted((r.time_point, r.cluster_id, r.rank, r.id) for r in d.collect())
    assert pick(few) == pick(whole)
    assert "WindowGroupLimit" in few._jdf.queryExecution().toString()
