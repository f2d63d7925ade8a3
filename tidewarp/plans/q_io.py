"""Registered queries: sources (S1-S8, X7) and sinks.

Each writes data Spark derived from the driver's tables to the shared
checkpoint folder, then reads it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.functions.vec import series_to_text
from tidewarp.operators import reshape as X
from tidewarp.operators import quality as Q
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import ORACLE_CFG, _oracle_fit, fx1_fit, r6, register
from tidewarp.plans.q_basic import X6_N, X6_SEED, dflat, flat
from tidewarp.plans.q_cluster import K1_N, _sql_pca, _sql_samples, member_text, pca_projection
from tidewarp.plans.q_drift import _migration_sql
from tidewarp.plans.runs import save_result
from tidewarp.plans.series import fixture_series
from tidewarp.session import session_key, staging_path
from tidewarp.sources import sinks as W
from tidewarp.sources import text as S
from tidewarp.sources.tables import fx1_panel, fx3_panel, positions

L = 12
KEYS = ["time_point", "k"]
RUN_COLS = ["run_kind", "new_mean_method", "balance_length"]
_WRITTEN: dict = {}


def window_files(spark, sf_dir) -> str:
    """The FX-1 windows as ``id,v0..v14`` text, one folder per time point."""
    key = ("w12", session_key(spark), sf_dir)
    if key not in _WRITTEN:
        s, _ = fx1_fit(spark, sf_dir)
        path = staging_path(spark, "windows")
        W.write_window_files(s, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def saved(spark, sf_dir) -> dict:
    key = ("save", session_key(spark), sf_dir)
    if key not in _WRITTEN:
        _, fit = fx1_fit(spark, sf_dir)
        _WRITTEN[key] = save_result(spark, staging_path(spark, "results"), fit.assignments, fit.centres,
                                    ORACLE_CFG.with_(n_samples=K1_N), fit.seconds)
    return _WRITTEN[key]


def _dseries():
    q = O.Sql()
    return q, O.fixture_series(q, "fx1")


# ---------------------------------------------------------------- sources

S1_TP = 7


def _sql_s1():
    q, s = _dseries()
    one = q.add("one", f"SELECT time_point, id, series_full FROM {s} WHERE time_point = {S1_TP}")
    return q.render(dflat(one, ["time_point", "id"], "series_full"))


@register("s1_w12_load_one_time_point", _sql_s1())
def s1(spark, sf_dir):
    path = f"{window_files(spark, sf_dir)}/time_point={S1_TP}"
    return flat(S.load_time_point(spark, path, L, S1_TP), ["time_point", "id"], "series_full")


# Lines of four days of FX-3 a user: a day without a row leaves its field out (a ragged line), but the second one writes "n/a" (a bad
# line); four days without any row are a blank line.
DAYS, DAYS_RAW = 4, 3


def day_lines(spark, sf_dir) -> str:
    key = ("days", session_key(spark), sf_dir)
    if key not in _WRITTEN:
        n = positions(spark, sf_dir, "fx3")
        users = fx3_panel(spark, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
        starts = users.select("id", "m", F.explode(F.sequence(F.lit(0), F.lit(n - DAYS))).alias("time_point"))
        cells = [F.try_element_at("m", F.col("time_point") + i).cast("string") for i in range(DAYS)]
        cells[1] = F.coalesce(cells[1], F.lit("n/a"))
        line = F.when(F.exists(F.array(*[F.col("time_point") + i for i in range(DAYS)]), lambda p: F.map_contains_key("m", p)),
                      F.concat_ws(",", F.col("id").cast("string"), *cells)).otherwise("")
        path = staging_path(spark, "day-lines")
        W.write_text_lines(starts.select("time_point", line.alias("_line")), "_line", path, "time_point")
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _dday_lines():
    q = O.Sql()
    p = O.fx3_panel(q)
    m = q.add("m", f"SELECT id, map(list(pos), list(value)) AS m FROM {p} GROUP BY id")
    c = q.add("cells", f"""SELECT id, CAST(t AS INTEGER) AS time_point, [m[CAST(t + i AS INTEGER)] FOR i IN range({DAYS})] AS c
FROM {m}, (SELECT unnest(range(0, (SELECT max(pos) + 2 - {DAYS} FROM {p}))) AS t)""")
    return q, q.add("lines", f"SELECT id, time_point, c[2] IS NULL AS bad, list_filter(c, lambda x: x IS NOT NULL) AS v FROM {c} WHERE len(list_filter(c, lambda x: x IS NOT NULL)) > 0")


def _sql_s2():
    q, w = _dday_lines()
    r = q.add("r", f"SELECT *, v[1:{DAYS_RAW}] AS raw FROM {w}")
    n = q.add("n", f"SELECT *, {O.normalise('raw')} AS norm FROM {r}")
    return q.render(f"""SELECT time_point, id, bad, CAST(len(v) + CAST(bad AS INTEGER) AS INTEGER) AS n_full,
  CASE WHEN NOT bad THEN round({O.lsum('raw')}, 6) END AS raw_sum, CASE WHEN NOT bad THEN round({O.lsum('norm')}, 6) END AS norm_sum FROM {n}""")


@register("s2_parse_line_to_series", _sql_s2())
def s2(spark, sf_dir):
    """Full, ragged and bad lines, blank ones left out."""
    base = day_lines(spark, sf_dir)
    p = S.parse_series(X.non_empty_lines(spark.read.option("basePath", base).text(base)), DAYS_RAW)
    total = lambda c: F.when(~F.col("bad"), r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))
    return p.select(F.col("time_point").cast("int"), "id", "bad", F.size("series_full").cast("int").alias("n_full"),
                    total("series_raw").alias("raw_sum"), total("series_norm").alias("norm_sum"))


def _sql_s3():
    q, s = _dseries()
    v = q.add("v", f"SELECT time_point, id, list_prepend(CAST(id AS DOUBLE), series_full) AS vector FROM {s}")
    return q.render(dflat(v, ["time_point", "id"], "vector"))


@register("s3_parse_line_to_vector", _sql_s3())
def s3(spark, sf_dir):
    base = window_files(spark, sf_dir)
    v = S.parse_vector(spark.read.option("basePath", base).text(base))
    v = v.withColumn("id", F.col("vector")[0].cast("bigint")).withColumn("time_point", F.col("time_point").cast("int"))
    return flat(v, ["time_point", "id"], "vector")


S4_FROM, S4_TO = 10, 20


def _sql_s4():
    q, s = _dseries()
    r = q.add("r", f"SELECT * FROM {s} WHERE time_point BETWEEN {S4_FROM} AND {S4_TO}")
    return q.render(dflat(r, ["time_point", "id"], "series_norm"))


@register("s4_time_point_range_scan", _sql_s4())
def s4(spark, sf_dir):
    df = S.load_time_point_range(spark, window_files(spark, sf_dir), S4_FROM, S4_TO, L)
    return flat(df, ["time_point", "id"], "series_norm")


def _sql_x7():
    q, s = _dseries()
    return q.render(f"SELECT time_point, CAST(count(*) AS BIGINT) AS n_lines FROM {s} GROUP BY time_point")


@register("x7_non_empty_lines", _sql_x7())
def x7(spark, sf_dir):
    """Every line of the FX-1 window files, written with a blank line behind each window's own."""
    path = staging_path(spark, "window-lines")
    line = F.concat(series_to_text("id", "series_full"), F.lit("\n"))
    W.write_text_lines(fixture_series(spark, sf_dir).select("time_point", line.alias("_line")), "_line", path, "time_point")
    lines = X.non_empty_lines(spark.read.option("basePath", path).text(path))
    return lines.groupBy(F.col("time_point").cast("int").alias("time_point")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"))


def _results_dir(spark, sf_dir) -> str:
    key = ("w10", session_key(spark), sf_dir)
    if key not in _WRITTEN:
        _, fit = fx1_fit(spark, sf_dir)
        run_sil = Q.run_silhouette(Q.cluster_silhouettes(fit.assignments, KEYS), KEYS)
        path = staging_path(spark, "clustering-text")
        W.write_clustering_result_text(fit.assignments, run_sil, path)
        pca = pca_projection(spark, sf_dir).select("time_point", "id", F.array("pc1", "pc2").alias("pca"))
        W.write_pca_text(pca, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _sql_s6():
    q, s, c, a = _oracle_fit()
    cs = q.add("csil", f"SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil FROM {a} GROUP BY ALL")
    rs = q.add("rsil", f"SELECT time_point, k, floor(sum(sil) / k * 1000 + 0.5) / 1000 AS run_silhouette FROM {cs} GROUP BY time_point, k")
    return q.render(f"""SELECT a.time_point, a.k, r.run_silhouette, a.cluster_id, a.id, round({O.lsum('a.series_norm')}, 6) AS norm_sum
FROM {a} a JOIN {rs} r ON a.time_point = r.time_point AND a.k = r.k""")


@register("s6_s7_w10_read_clustering_results", _sql_s6())
def s6(spark, sf_dir):
    r = S.read_clustering_results(spark, _results_dir(spark, sf_dir))
    return r.select("time_point", "k", "run_silhouette", "cluster_id", "id",
                    r6(F.aggregate("series_norm", F.lit(0.0), lambda a, x: a + x)).alias("norm_sum"))


@register("s8_w11_read_pca_results", _sql_pca())
def s8(spark, sf_dir):
    back = S.read_pca_results(spark, _results_dir(spark, sf_dir))
    return back.withColumn("pc1", r6(F.col("pc1"))).withColumn("pc2", r6(F.col("pc2")))


# ---------------------------------------------------------------- entity sinks

def _read(spark, sf_dir, table: str) -> DataFrame:
    return spark.read.parquet(saved(spark, sf_dir)[table])


def _run_sql(select_sql: str) -> str:
    q, s, c, a = _oracle_fit()
    return q.render(f"SELECT 'random' AS run_kind, 'random' AS new_mean_method, 12 AS balance_length, * FROM ({select_sql.format(a=a, c=c)})")


@register("w1_customer_clustered", _run_sql(
    "SELECT time_point, k, id, cluster_id, pos, round(norm, 6) AS norm, round(raw, 6) AS raw FROM ("
    "SELECT time_point, k, id, cluster_id, CAST(unnest(range(len(series_norm))) AS INTEGER) AS pos, "
    "unnest(series_norm) AS norm, unnest(series_raw) AS raw FROM {a})"))
def w1(spark, sf_dir):
    t = _read(spark, sf_dir, "customer_clustered")
    return (t.select(*RUN_COLS, "time_point", "k", "id", "cluster_id", F.posexplode("pairs").alias("pos", "p"))
            .select(*RUN_COLS, "time_point", "k", "id", "cluster_id", F.col("pos").cast("int"),
                    r6(F.col("p.norm")).alias("norm"), r6(F.col("p.raw")).alias("raw")))


def _sql_w2():
    q, s, c, a = _oracle_fit()
    cs = q.add("csil", f"SELECT time_point, k, cluster_id, avg({O.silhouette_row()}) AS sil FROM {a} GROUP BY ALL")
    return q.render(f"""SELECT 'random' AS run_kind, 'random' AS new_mean_method, 12 AS balance_length,
  c.time_point, c.k, c.cluster_id, round(coalesce(s.sil, -1.0), 6) AS silhouette, round({O.lsum('c.center')}, 6) AS center_sum,
  true AS has_spent_time
FROM {c} c LEFT JOIN {cs} s ON c.time_point = s.time_point AND c.k = s.k AND c.cluster_id = s.cluster_id""")


@register("w2_clustered_result", _sql_w2())
def w2(spark, sf_dir):
    t = _read(spark, sf_dir, "clustered_result")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_id", r6(F.col("silhouette")).alias("silhouette"),
                    r6(F.aggregate("center", F.lit(0.0), lambda a, x: a + x)).alias("center_sum"),
                    (F.col("spent_time") > 0).alias("has_spent_time"))


@register("w3_cluster_balances", _run_sql(
    "SELECT time_point, k, cluster_id, round(" + O.lsum(
        "[" + ", ".join(f"sum(series_full[{i + 1}])" for i in range(15)) + "]") +
    ", 6) AS total_sum FROM {a} GROUP BY time_point, k, cluster_id"))
def w3(spark, sf_dir):
    t = _read(spark, sf_dir, "cluster_balances")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_id",
                    r6(F.aggregate("total", F.lit(0.0), lambda a, x: a + x)).alias("total_sum"))


def _sql_w4():
    inner = ("SELECT time_point, k, cluster_id, [" + ", ".join(f"avg(series_raw[{i + 1}])" for i in range(L)) +
             "] AS mr FROM {a} GROUP BY time_point, k, cluster_id")
    return _run_sql(f"SELECT time_point, k, cluster_id, round({O.lmean('mr')}, 6) AS mean, "
                    f"round({O.lsd('mr')}, 6) AS sd FROM ({inner})")


@register("w4_cluster_statistic", _sql_w4())
def w4(spark, sf_dir):
    t = _read(spark, sf_dir, "cluster_statistic")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_id", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


def _sql_w5():
    q, s, c, a = _oracle_fit()
    m = q.add("mig", _migration_sql(a))
    return q.render(f"""SELECT 'random' AS run_kind, 'random' AS new_mean_method, 12 AS balance_length,
  time_point, k, cluster_previous, cluster_current, number_cus, change_proportion FROM {m}""")


@register("w5_cluster_monitor", _sql_w5())
def w5(spark, sf_dir):
    t = _read(spark, sf_dir, "cluster_monitor")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_previous", "cluster_current", "number_cus",
                    r6(F.col("change_proportion")).alias("change_proportion"))


@register("w6_cluster_distance", _run_sql(
    "SELECT time_point, k, cluster_id, round(avg(dist), 6) AS mean_distance FROM {a} GROUP BY ALL"))
def w6(spark, sf_dir):
    t = _read(spark, sf_dir, "cluster_distance")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_id", r6(F.col("mean_distance")).alias("mean_distance"))


@register("w7_cluster_samples", _sql_samples("'random' AS run_kind, 'random' AS new_mean_method, 12 AS balance_length, "))
def w7(spark, sf_dir):
    """The saved samples; the first two coordinates are those of both projections."""
    t = _read(spark, sf_dir, "cluster_samples").where("p2 = slice(p3, 1, 2)")
    return t.select(*RUN_COLS, "time_point", "k", "cluster_id", r6(F.col("dist")).alias("dist"), member_text("member").alias("member"),
                    *[r6(F.col("p3")[i]).alias(f"pc{i + 1}") for i in range(3)])


@register("w8_cluster_member_count", _run_sql(
    "SELECT time_point, k, cluster_id, CAST(count(*) AS BIGINT) AS cluster_count FROM {a} GROUP BY ALL"))
def w8(spark, sf_dir):
    return _read(spark, sf_dir, "cluster_member_count").select(*RUN_COLS, "time_point", "k", "cluster_id", "cluster_count")


def _sql_w9():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT time_point, '(' || cluster_id || ',' || array_to_string(list_sort(list(id)), ';') || ')' AS value
FROM {a} GROUP BY time_point, cluster_id, floor(id / 10000)""")


@register("w9_cluster_members_text", _sql_w9())
def w9(spark, sf_dir):
    base = saved(spark, sf_dir)["cluster_members_text"]
    t = spark.read.option("basePath", base).text(base)
    return t.select(F.col("time_point").cast("int"), "value")


def _sql_w13():
    q = O.Sql()
    p = O.fx1_panel(q)
    d = O.dense(q, p)
    u = O.uniform01(f"'{X6_SEED}'", "id", "0")
    smp = q.add("smp", f"SELECT id, series FROM {d} ORDER BY {u}, id LIMIT {X6_N}")
    return q.render(f"SELECT id, round({O.lsum('series')}, 6) AS series_sum FROM {smp}")


@register("w13_sample_files", _sql_w13())
def w13(spark, sf_dir):
    dense = X.dense_series(fx1_panel(spark, sf_dir), positions(spark, sf_dir))
    path = staging_path(spark, "samples")
    W.write_samples(X.sample_exact(dense, X6_N, X6_SEED), path, "series")
    back = S.parse_vector(spark.read.text(path))
    return back.select(F.col("vector")[0].cast("bigint").alias("id"),
                       r6(F.aggregate(F.slice("vector", 2, positions(spark, sf_dir)), F.lit(0.0), lambda a, x: a + x)).alias("series_sum"))
