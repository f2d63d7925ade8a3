"""Registered queries: model selection runs.

The whole runs are iterative searches on their original settings; tests/ hold them against plain loops. One warm step of every
period, with few passes and few k, has a DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarp.config import DEFAULT_ETA, DEFAULT_MAX_ITER, RunConfig
from tidewarp.operators import select as S
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import fx1_fit, r6, register
from tidewarp.session import session_key

# Fixed run parameters of the registered searches, as in the original runs: k 5..10, threshold 0.05, 200 passes at
# most and eta 1e-7, so each model stops on its own convergence.
SEARCH_CFG = RunConfig(eta=DEFAULT_ETA, max_iter=DEFAULT_MAX_ITER, min_k=5, max_k=10, sil_threshold=0.05, n_samples=50,
                       init="random", seed=42)

_RUNS: dict = {}


def warm(spark, sf_dir, method: str = "mean_of_previous_mean"):
    key = (session_key(spark), sf_dir, method)
    if key not in _RUNS:
        s, _ = fx1_fit(spark, sf_dir)
        _RUNS[key] = S.warm_run(s, SEARCH_CFG.with_(warm_start=True, new_centre_method=method))
    return _RUNS[key]


def cold(spark, sf_dir):
    key = (session_key(spark), sf_dir, "cold")
    if key not in _RUNS:
        s, _ = fx1_fit(spark, sf_dir)
        _RUNS[key] = S.cold_run(s, SEARCH_CFG)
    return _RUNS[key]


@register("c6_c13_cold_run_best_k")
def cold_best(spark, sf_dir):
    choices, _ = cold(spark, sf_dir)
    return S.choices_frame(spark, choices).withColumn("run_silhouette", r6(F.col("run_silhouette")))


@register("c14_c15_warm_start_choices")
def warm_choices(spark, sf_dir):
    choices, _ = warm(spark, sf_dir)
    return S.choices_frame(spark, choices).withColumn("run_silhouette", r6(F.col("run_silhouette")))


@register("c7_c8_search_steps")
def search_steps(spark, sf_dir):
    choices, _ = warm(spark, sf_dir)
    rows = [(int(tp), i, name, int(k), None if sil is None else float(sil))
            for tp, c in sorted(choices.items()) for i, (name, k, sil) in enumerate(c.steps)]
    return spark.createDataFrame(rows, "time_point int, step int, direction string, k int, run_silhouette double")


@register("c14_warm_start_assignments")
def warm_assign(spark, sf_dir):
    _, a = warm(spark, sf_dir)
    return a.select("time_point", "k", "id", "cluster_id", r6(F.col("dist")).alias("dist"))


# One warm step of every period, small enough to unroll in SQL: the previous period's best k of a sweep is refitted, then both searches.
STEP_CFG = RunConfig(eta=0.0, max_iter=2, min_k=2, max_k=4, sil_threshold=0.01, init="lowest_ids", new_centre_method="mean_of_previous_mean")


def _sql_steps():
    q, cfg, L, KEYS = O.Sql(), STEP_CFG, STEP_CFG.series_length, "time_point, k"
    ks = list(range(cfg.min_k, cfg.max_k + 1))
    s = O.fixture_series(q, "fx1")

    def quality(name, a):
        """(time_point, k, cluster_id, sil) and (time_point, k, run_sil) of an assignment."""
        cs = q.add(name + "_cs", f"SELECT {KEYS}, cluster_id, avg({O.silhouette_row()}) AS sil FROM {a} GROUP BY {KEYS}, cluster_id")
        return cs, q.add(name + "_rs", f"SELECT {KEYS}, sum(sil) / k AS run_sil FROM {cs} GROUP BY {KEYS}")

    def fit(name, init):
        models = q.add(name + "_models", f"SELECT DISTINCT {KEYS} FROM {init}")
        own = q.add(name + "_s", f"SELECT s.*, m.k FROM {s} s JOIN {models} m ON m.time_point = s.time_point")
        c, a = O.kmeans(q, own, init, cfg.max_iter, L, prefix=name)
        return c, *quality(name, a)

    sweep_c, sweep_a = O.kmeans(q, O.fan_out_k(q, s, ks), O.lowest_id_centres(q, s, ks), cfg.max_iter, L, prefix="sw")
    _, sweep_rs = quality("sw", sweep_a)
    best = q.add("best", f"SELECT time_point, CAST(first(k ORDER BY run_sil DESC, k) AS INTEGER) AS k FROM {sweep_rs} GROUP BY time_point")
    last = q.add("lasttp", f"SELECT max(time_point) AS t FROM {s}")
    start = q.add("start0", f"""SELECT CAST(c.time_point + 1 AS INTEGER) AS time_point, c.k, c.cluster_id, c.center
FROM {sweep_c} c JOIN {best} b ON b.time_point = c.time_point AND b.k = c.k WHERE c.time_point < (SELECT t FROM {last})""")
    keep = fit("kp", start)

    def removed(name, c, cs, models):
        worst = q.add(name + "_w", f"SELECT {KEYS}, first(cluster_id ORDER BY sil, cluster_id) AS worst FROM {cs} GROUP BY {KEYS}")
        return q.add(name, f"""SELECT c.time_point, CAST(c.k - 1 AS INTEGER) AS k,
  CAST(row_number() OVER (PARTITION BY c.time_point ORDER BY c.cluster_id) - 1 AS INTEGER) AS cluster_id, c.center
FROM {c} c JOIN {worst} w ON w.time_point = c.time_point AND w.k = c.k JOIN {models} m ON m.time_point = c.time_point AND m.k = c.k
WHERE c.cluster_id <> w.worst AND c.k - 1 >= {cfg.min_k}""")

    def grown(name, c, models):
        mean = ", ".join(f"avg(c.center[{i + 1}])" for i in range(L))
        own = q.add(name + "_c", f"SELECT c.* FROM {c} c JOIN {models} m ON m.time_point = c.time_point AND m.k = c.k WHERE c.k + 1 <= {cfg.max_k}")
        return q.add(name, f"""SELECT time_point, CAST(k + 1 AS INTEGER) AS k, cluster_id, center FROM {own}
UNION ALL SELECT time_point, CAST(k + 1 AS INTEGER), k, [{mean}] FROM {own} c GROUP BY time_point, k""")

    def accepted(name, rs, base, step):
        """(time_point, k, run_sil) of the models that beat those one step before."""
        return q.add(name, f"""SELECT r.* FROM {rs} r JOIN {base} b ON b.time_point = r.time_point AND b.k = r.k - ({step})
WHERE r.run_sil > b.run_sil + {cfg.sil_threshold}""")

    tried, ends = [], {}
    for name, step in (("backward", -1), ("forward", 1)):
        c, cs, rs = (start, keep[1], keep[2])  # the first step starts at the previous centres, with keep's silhouettes
        won = []
        for i in range(1, cfg.max_k - cfg.min_k + 1):
            tag = f"{name[0]}{i}"
            init = removed(tag + "_i", c, cs, rs) if step < 0 else grown(tag + "_i", c, rs)
            base = rs
            c, cs, all_rs = fit(tag, init)
            tried.append(f"SELECT time_point, '{name}' AS direction, k FROM {all_rs}")
            rs = accepted(tag + "_ok", all_rs, base, step)
            won.append(f"SELECT time_point, k, run_sil, {i} AS step FROM {rs}")
        every = q.add(name + "_won", " UNION ALL ".join(won))
        ends[name] = q.add(name + "_end", f"SELECT time_point, last(k ORDER BY step) AS k, last(run_sil ORDER BY step) AS run_sil FROM {every} GROUP BY time_point")
    steps = q.add("steps", " UNION ALL ".join(tried))
    counts = q.add("nsteps", f"""SELECT time_point, count(*) FILTER (direction = 'backward') AS nb, count(*) FILTER (direction = 'forward') AS nf
FROM {steps} GROUP BY time_point""")
    pick = lambda which: f"""CASE WHEN b.k IS NOT NULL AND (f.k IS NULL OR b.run_sil > f.run_sil) THEN {which('b', 'backward')}
    WHEN f.k IS NOT NULL AND (b.k IS NULL OR f.run_sil > b.run_sil) THEN {which('f', 'forward')} ELSE {which('p', 'keep')} END"""  # noqa: E731
    return q.render(f"""SELECT p.time_point, p.k AS k_before, CAST({pick(lambda t, _: t + '.k')} AS INTEGER) AS k,
  {pick(lambda _, kind: repr(kind))} AS choice, round({pick(lambda t, _: t + '.run_sil')}, 6) AS run_silhouette,
  CAST(coalesce(n.nb, 0) AS INTEGER) AS backward_steps, CAST(coalesce(n.nf, 0) AS INTEGER) AS forward_steps
FROM {keep[2]} p LEFT JOIN {ends['backward']} b ON b.time_point = p.time_point LEFT JOIN {ends['forward']} f ON f.time_point = p.time_point
LEFT JOIN {counts} n ON n.time_point = p.time_point""")


@register("c7_c8_c14_c15_warm_step_of_every_period", _sql_steps())
def warm_steps(spark, sf_dir):
    """C14 from the period before: keep, both searches and the choice, for every period at once."""
    s, _ = fx1_fit(spark, sf_dir)
    before, _ = S.sweep(s, STEP_CFG)
    last = max(before)
    choices = S.refine(s, {tp + 1: c.centres for tp, c in before.items() if tp < last}, STEP_CFG)
    rows = [(int(tp), int(before[tp - 1].k), int(c.k), c.kind, float(c.run_silhouette), *(sum(d == name for d, _, _ in c.steps) for name in ("backward", "forward")))
            for tp, c in choices.items()]
    out = spark.createDataFrame(rows, "time_point int, k_before int, k int, choice string, run_silhouette double, backward_steps int, forward_steps int")
    return out.withColumn("run_silhouette", r6(F.col("run_silhouette")))
