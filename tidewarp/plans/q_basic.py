"""Registered queries: reshaping (X), scalars (F) and distances (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.functions import dtw as D
from tidewarp.functions import vec as V
from tidewarp.operators import reshape as X
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import r6, register
from tidewarp.plans.series import fixture_series
from tidewarp.session import read_table
from tidewarp.sources.tables import fx1_panel, fx3_panel, positions

L = 12


def flat(df: DataFrame, keys: list[str], col: str, val: str = "value") -> DataFrame:
    """Array column -> one row per position (scalar output for the check)."""
    return (df.select(*keys, F.posexplode(col).alias("pos", val))
            .withColumn("pos", F.col("pos").cast("int")).withColumn(val, r6(F.col(val))))


def dflat(src: str, keys: list[str], col: str, val: str = "value") -> str:
    k = ", ".join(keys)
    return (f"SELECT {k}, pos, round({val}, 6) AS {val} FROM (SELECT {k}, "
            f"CAST(unnest(range(len({col}))) AS INTEGER) AS pos, unnest({col}) AS {val} FROM {src})")


def _series(spark, sf_dir):
    return fixture_series(spark, sf_dir, "fx1")


def _dseries():
    q = O.Sql()
    return q, O.fixture_series(q, "fx1")


def _dpanel():
    q = O.Sql()
    return q, O.fx1_panel(q)


# ---------------------------------------------------------------- X: reshape

def _sql_x1():
    q, p = _dpanel()
    d = O.dense(q, p)
    return q.render(dflat(d, ["id"], "series"))


@register("x1_transpose_dense_series", _sql_x1())
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(X.dense_series(fx1_panel(spark, sf_dir), positions(spark, sf_dir)), ["id"], "series")


def _sql_x2():
    q, p = _dpanel()
    return q.render(f"SELECT id, pos, round(value, 6) AS value FROM {p} WHERE pos < {L}")


@register("x2_head_positions", _sql_x2())
def x2(spark, sf_dir):
    return X.head_positions(fx1_panel(spark, sf_dir), L).withColumn("value", r6(F.col("value")))


def _sql_x3():
    q, s = _dseries()
    return q.render(dflat(s, ["time_point", "id"], "series_full"))


@register("x3_sliding_windows", _sql_x3())
def x3(spark, sf_dir):
    return flat(_series(spark, sf_dir), ["time_point", "id"], "series_full")


def _sql_x4():
    q, s = _dseries()
    h = q.add("h", f"SELECT time_point, id, series_full[{L + 1}:{L + 3}] AS horizon FROM {s}")
    return q.render(dflat(h, ["time_point", "id"], "horizon"))


@register("x4_split_raw_horizon", _sql_x4())
def x4(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("horizon", X.horizon(F.col("series_full"), L, 3))
    return flat(s, ["time_point", "id"], "horizon")


# pairs of days of FX-3: about one in a hundred is without any event, a dead series
DAYS = 2


def _day_pairs(spark, sf_dir):
    n = positions(spark, sf_dir, "fx3")
    return X.sliding_windows(X.dense_series(fx3_panel(spark, sf_dir), n), DAYS, 0, n - DAYS, DAYS)


def _dday_pairs():
    q = O.Sql()
    return q, O.windows(q, O.dense(q, O.fx3_panel(q)), DAYS, 0, None, DAYS)


def _sql_x5():
    q, s = _dday_pairs()
    return q.render(f"SELECT time_point, id FROM {s} WHERE {O.lsum('series_norm')} <> 0")


@register("x5_drop_dead_series", _sql_x5())
def x5(spark, sf_dir):
    return X.drop_dead(_day_pairs(spark, sf_dir)).select("time_point", "id")


X6_N, X6_SEED = 25, 42


def _sql_x6():
    q, p = _dpanel()
    d = O.dense(q, p)
    u = O.uniform01(f"'{X6_SEED}'", "id", "0")
    return q.render(f"SELECT id FROM {d} ORDER BY {u}, id LIMIT {X6_N}")


@register("x6_sample_exact_n", _sql_x6())
def x6(spark, sf_dir):
    dense = X.dense_series(fx1_panel(spark, sf_dir), positions(spark, sf_dir))
    return X.sample_exact(dense, X6_N, X6_SEED).select("id")


def _sql_x9():
    q, s = _dseries()
    return q.render(f"""SELECT time_point, id, round({O.lsum('series_raw')}, 6) AS raw_sum FROM {s}
WHERE id IN (SELECT CAST(s_suppkey AS BIGINT) FROM supplier WHERE s_nationkey < 5)""")


@register("x9_lookup_by_id", _sql_x9())
def x9(spark, sf_dir):
    ids = read_table(spark, sf_dir, "supplier").where(F.col("s_nationkey") < 5).select(
        F.col("s_suppkey").cast("bigint").alias("id"))
    return X.lookup_ids(_series(spark, sf_dir), ids).select("time_point", "id", r6(V.series_sum("series_raw")).alias("raw_sum"))


def _sql_x10():
    q, p = _dpanel()
    return q.render(f"SELECT id, pos, round_even(value, 4) AS value4 FROM {p}")


@register("x10_round4", _sql_x10())
def x10(spark, sf_dir):
    return fx1_panel(spark, sf_dir).select("id", "pos", X.round4(F.col("value")).alias("value4"))


def _sql_x11():
    q, s = _dseries()
    return q.render(f"SELECT time_point, id, CAST(row_number() OVER (ORDER BY time_point, id) AS BIGINT) AS row_pos FROM {s}")


@register("x11_dense_index", _sql_x11())
def x11(spark, sf_dir):
    return X.dense_index(_series(spark, sf_dir).select("time_point", "id"), ["time_point", "id"])


X12_T, X12_N = 60, 48


def _sql_x12():
    q, p = _dpanel()
    return q.render(f"SELECT id, pos, round(value, 6) AS value FROM {p} WHERE pos = {X12_T % X12_N}")


@register("x12_month_projection", _sql_x12())
def x12(spark, sf_dir):
    return X.month_projection(fx1_panel(spark, sf_dir), X12_T, X12_N).withColumn("value", r6(F.col("value")))


def _sql_x13h():
    q, p = _dpanel()
    d = O.dense(q, p)
    return q.render(f"SELECT id, round(series[1], 6) AS first_value FROM {d} ORDER BY id LIMIT 5")


@register("x13_inspect_head", _sql_x13h())
def x13h(spark, sf_dir):
    dense = X.dense_series(fx1_panel(spark, sf_dir), positions(spark, sf_dir))
    return X.inspect_head(dense).select("id", r6(F.col("series")[0]).alias("first_value"))


def _sql_x13s():
    q, s = _dseries()
    return q.render(f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(series_full)) AS INTEGER) AS n_cols FROM {s}")


@register("x13_inspect_shape", _sql_x13s())
def x13s(spark, sf_dir):
    return X.inspect_shape(_series(spark, sf_dir))


# ---------------------------------------------------------------- F: scalars

def _sql_f1():
    q, s = _dseries()
    return q.render(dflat(s, ["time_point", "id"], "series_norm"))


@register("f1_minmax_normalise", _sql_f1())
def f1(spark, sf_dir):
    return flat(_series(spark, sf_dir), ["time_point", "id"], "series_norm")


def _sql_f2():
    q, s = _dseries()
    v = q.add("v", f"SELECT time_point, id, list_transform(list_zip(series_raw, series_full[4:15]), "
                   f"lambda t: t[1] + t[2]) AS v FROM {s}")
    return q.render(dflat(v, ["time_point", "id"], "v"))


@register("f2_elementwise_sum", _sql_f2())
def f2(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("v", V.elementwise_sum("series_raw", F.slice("series_full", 4, 12)))
    return flat(s, ["time_point", "id"], "v")


def _sql_f3():
    q, s = _dseries()
    v = q.add("v", f"SELECT time_point, id, list_transform(series_raw, lambda x: x / len(series_raw)) AS v FROM {s}")
    return q.render(dflat(v, ["time_point", "id"], "v"))


@register("f3_elementwise_divide", _sql_f3())
def f3(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("v", V.elementwise_divide("series_raw", F.size("series_raw")))
    return flat(s, ["time_point", "id"], "v")


def _sql_f45():
    q, s = _dseries()
    return q.render(f"SELECT time_point, id, round({O.lmean('series_raw')}, 6) AS mean, "
                    f"round({O.lsd('series_raw')}, 6) AS sd FROM {s}")


@register("f4_f5_series_mean_sd", _sql_f45())
def f45(spark, sf_dir):
    return _series(spark, sf_dir).select("time_point", "id", r6(V.series_mean("series_raw")).alias("mean"),
                                         r6(V.series_sd("series_raw")).alias("sd"))


def _sql_f6():
    q, s = _dseries()
    b = q.add("b", f"SELECT *, {O.normalise('series_full[4:15]')} AS later_norm FROM {s}")
    return q.render(f"SELECT time_point, id, round({O.l1('series_norm', 'later_norm')}, 6) AS l1 FROM {b}")


@register("f6_l1_distance", _sql_f6())
def f6(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("later_norm", V.minmax_normalise(F.slice("series_full", 4, 12)))
    return s.select("time_point", "id", r6(V.l1_distance("series_norm", "later_norm")).alias("l1"))


def _sql_f789():
    q, s = _dseries()
    a, b, c = "series_norm[1]", "series_norm[2]", "series_norm[3]"
    g = "0.01"
    m = f"least({a}, {b}, {c})"
    soft = f"{m} - {g} * ln(exp(({m} - {a}) / {g}) + exp(({m} - {b}) / {g}) + exp(({m} - {c}) / {g}))"
    return q.render(f"""SELECT time_point, id, round(abs({a} - {b}), 6) AS abs_diff,
  round(({a} - {b}) * ({a} - {b}), 6) AS sq_diff, round({m}, 6) AS min3, round({soft}, 6) AS softmin3 FROM {s}""")


@register("f7_f8_f9_point_ops", _sql_f789())
def f789(spark, sf_dir):
    n = F.col("series_norm")
    return _series(spark, sf_dir).select(
        "time_point", "id", r6(V.point_abs(n[0], n[1])).alias("abs_diff"), r6(V.point_squared(n[0], n[1])).alias("sq_diff"),
        r6(V.min3(n[0], n[1], n[2])).alias("min3"), r6(V.softmin3(n[0], n[1], n[2], 0.01)).alias("softmin3"))


def _sql_f10():
    q, s = _dday_pairs()
    return q.render(f"""SELECT a.time_point, a.id, a.series_full[2:2] = b.series_full[1:1] AS goes_on, a.series_full[1:1] = b.series_full[1:1] AS same_start
FROM {s} a JOIN {s} b ON b.id = a.id AND b.time_point = a.time_point + 1""")


@register("f10_prefix_equal", _sql_f10())
def f10(spark, sf_dir):
    """Parts of a pair of days against the pair that begins a day later: its second day always, its first one now and then."""
    s = _day_pairs(spark, sf_dir)
    later = s.select((F.col("time_point") - 1).alias("time_point"), "id", F.col("series_full").alias("later"))
    return s.join(later, ["time_point", "id"]).select(
        "time_point", "id", V.prefix_equal(F.slice("series_full", 2, 1), "later").alias("goes_on"),
        V.prefix_equal(F.slice("series_full", 1, 1), "later").alias("same_start"))


def _sql_f1112():
    q, s = _dseries()
    a = f"list_filter(range(0, {L}), lambda i: series_norm[i + 1] < 0.5)"
    b = f"list_filter(range(1, {L}), lambda i: series_raw[i + 1] > series_raw[i])"
    return q.render(f"""SELECT time_point, id,
  array_to_string(list_sort(list_distinct(list_concat({a}, {b}))), ',') AS id_union,
  array_to_string(list_sort(list_intersect({a}, {b})), ',') AS id_intersection FROM {s}""")


@register("f11_f12_id_union_intersection", _sql_f1112())
def f1112(spark, sf_dir):
    s = _series(spark, sf_dir)
    a = F.filter(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: F.col("series_norm")[i] < 0.5)
    b = F.filter(F.sequence(F.lit(1), F.lit(L - 1)), lambda i: F.col("series_raw")[i] > F.col("series_raw")[i - 1])

    def txt(c):
        return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return s.select("time_point", "id", txt(V.id_union(a, b)).alias("id_union"),
                    txt(V.id_intersection(a, b)).alias("id_intersection"))


def _sql_f13():
    q, s = _dseries()
    return q.render(f"""SELECT time_point, concat_ws(',', CAST(id AS VARCHAR),
  array_to_string(list_transform(series_norm, lambda v: printf('%.6f', v)), ',')) AS line FROM {s}""")


@register("f13_series_to_text", _sql_f13())
def f13(spark, sf_dir):
    return _series(spark, sf_dir).select("time_point", V.series_to_text("id", "series_norm", 6).alias("line"))


def _sql_f14():
    q, s = _dseries()
    v = q.add("v", f"SELECT time_point, id, list_filter(series_norm, lambda x, i: i - 1 <> 0) AS v FROM {s}")
    return q.render(dflat(v, ["time_point", "id"], "v"))


@register("f14_remove_at", _sql_f14())
def f14(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("v", V.remove_at("series_norm", 0))
    return flat(s, ["time_point", "id"], "v")


def _sql_f15():
    q, s = _dseries()
    return q.render(f"""SELECT time_point, id, pos, round(norm, 6) AS norm, round(raw, 6) AS raw FROM (
  SELECT time_point, id, CAST(unnest(range({L})) AS INTEGER) AS pos, unnest(series_norm) AS norm,
         unnest(series_raw) AS raw FROM {s})""")


@register("f15_pair_encode", _sql_f15())
def f15(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("pairs", V.pair_encode("series_norm", "series_raw"))
    return (s.select("time_point", "id", F.posexplode("pairs").alias("pos", "p"))
            .select("time_point", "id", F.col("pos").cast("int"), r6(F.col("p.norm")).alias("norm"),
                    r6(F.col("p.raw")).alias("raw")))


F16_K, F16_SEED = 4, 42


def _sql_f16():
    q, s = _dseries()
    keys = q.add("keys", f"SELECT DISTINCT time_point, {F16_K} AS k FROM {s}")
    c = O.random_centres(q, keys, F16_SEED, L)
    return q.render(dflat(c, ["time_point", "k", "cluster_id"], "center"))


@register("f16_c5_uniform_random_centres", _sql_f16())
def f16(spark, sf_dir):
    keys = _series(spark, sf_dir).select("time_point").distinct().withColumn("k", F.lit(F16_K))
    seed = F.concat_ws("-", F.lit(str(F16_SEED)), F.col("time_point").cast("string"), F.col("k").cast("string"))
    c = keys.select("time_point", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cluster_id"), seed.alias("seed"))
    c = c.withColumn("center", V.uniform_vector(F.col("seed"), F.col("cluster_id"), L))
    return flat(c.withColumn("k", F.col("k").cast("int")), ["time_point", "k", "cluster_id"], "center")


# ---------------------------------------------------------------- D: distances

def _pairs(spark, sf_dir):
    s = _series(spark, sf_dir)
    a = s.select("time_point", "id", F.col("series_norm").alias("x"))
    b = s.select((F.col("time_point") - 1).alias("time_point"), "id", F.col("series_norm").alias("y"))
    return a.join(b, ["time_point", "id"])


def _dpairs():
    q, s = _dseries()
    p = q.add("pairs", f"""SELECT a.time_point, a.id, a.series_norm AS x, b.series_norm AS y
FROM {s} a JOIN {s} b ON b.id = a.id AND b.time_point = a.time_point + 1""", stored=True)
    return q, p


def _sql_d(expr: str) -> str:
    q, p = _dpairs()
    return q.render(f"SELECT time_point, id, round({expr}, 6) AS d FROM {p}")


@register("d1_dtw", _sql_d(O.dtw("x", "y")))
def d1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("time_point", "id", r6(D.dtw_udf("x", "y")).alias("d"))


@register("d1_dtw_prefix_compat", _sql_d(O.dtw("x", "y", mode="prefix")))
def d1p(spark, sf_dir):
    return _pairs(spark, sf_dir).select("time_point", "id", r6(D.dtw_prefix_udf("x", "y")).alias("d"))


@register("d1_dtw_sql_twin", _sql_d(O.dtw("x", "y")))
def d1s(spark, sf_dir):
    return D.with_dtw(_pairs(spark, sf_dir), "x", "y", "d", L).select("time_point", "id", r6("d").alias("d"))


@register("d2_soft_dtw", _sql_d(O.dtw("x", "y", gamma=0.01)))
def d2(spark, sf_dir):
    return _pairs(spark, sf_dir).select("time_point", "id", r6(D.soft_dtw_udf("x", "y", F.lit(0.01))).alias("d"))


@register("d2_soft_dtw_sql_twin", _sql_d(O.dtw("x", "y", gamma=0.01)))
def d2s(spark, sf_dir):
    return D.with_dtw(_pairs(spark, sf_dir), "x", "y", "d", L, 0.01).select("time_point", "id", r6("d").alias("d"))


def _band_sql(x, y, w):
    # banded DTW: cells with |i - j| > w stay at infinity
    cell = "abs(xi - t[1]) + least(t[2], t[3], acc[len(acc)])"
    return (f"(list_reduce(list_transform({x}, lambda v, i: [v, i]), lambda P, xp: list_reduce("
            f"list_transform(list_zip({y}, P[1:len(P)-1], P[2:len(P)]), lambda t, j: [t[1], t[2], t[3], j]), "
            f"lambda acc, t: list_append(acc, CASE WHEN abs(xp[2] - t[4]) > {w} THEN {O.INF} ELSE "
            f"{cell.replace('xi', 'xp[1]')} END), [{O.INF}]), "
            f"list_prepend(0.0::DOUBLE, list_transform({y}, lambda e: {O.INF}))))[len({y})+1]")


@register("d3_dtw_banded", _sql_d(_band_sql("x", "y", 2)))
def d3(spark, sf_dir):
    return _pairs(spark, sf_dir).select("time_point", "id", r6(D.dtw_banded_udf("x", "y", F.lit(2))).alias("d"))
