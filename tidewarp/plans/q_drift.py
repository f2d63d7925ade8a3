"""Registered queries: migration and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.operators import drift as J
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import _oracle_fit, fx1_fit, r6, register
from tidewarp.plans.q_cluster import pca_projection
from tidewarp.session import read_table

KEYS = ["time_point", "k"]
THRESHOLD = 0.8
LAGS = (1, 3, 6, 12)


def _asg(spark, sf_dir) -> DataFrame:
    return fx1_fit(spark, sf_dir)[1].assignments.select("time_point", "k", "id", "cluster_id")


def _migration_sql(a: str) -> str:
    return f"""SELECT c.time_point, c.k, p.cluster_id AS cluster_previous, c.cluster_id AS cluster_current,
  CAST(count(*) AS BIGINT) AS number_cus,
  round(count(*) / any_value(cs.n), 6) AS change_proportion,
  round(count(*) / any_value(ps.n), 6) AS share_of_previous
FROM {a} c JOIN {a} p ON p.id = c.id AND p.time_point = c.time_point - 1 AND p.k = c.k
JOIN (SELECT time_point, k, cluster_id, count(*) AS n FROM {a} GROUP BY ALL) cs
  ON cs.time_point = c.time_point AND cs.k = c.k AND cs.cluster_id = c.cluster_id
JOIN (SELECT time_point, k, cluster_id, count(*) AS n FROM {a} GROUP BY ALL) ps
  ON ps.time_point = p.time_point AND ps.k = p.k AND ps.cluster_id = p.cluster_id
GROUP BY c.time_point, c.k, p.cluster_id, c.cluster_id"""


def _sql_j1():
    q, s, c, a = _oracle_fit()
    return q.render(_migration_sql(a))


@register("j1_w5_migration", _sql_j1())
def j1(spark, sf_dir):
    m = J.migration(_asg(spark, sf_dir), KEYS)
    return (m.withColumn("change_proportion", r6(F.col("change_proportion")))
            .withColumn("share_of_previous", r6(F.col("share_of_previous"))))


def _alternating(a: str) -> str:
    return f"SELECT time_point, 0 AS k, id, cluster_id FROM {a} WHERE k = CASE WHEN time_point % 2 = 0 THEN 4 ELSE 3 END"


def _sql_j1k():
    q, s, c, a = _oracle_fit((3, 4))
    m = q.add("alternating", _alternating(a))
    return q.render(f"SELECT * EXCLUDE (k) FROM ({_migration_sql(m)})")


@register("j1_migration_when_k_changes", _sql_j1k())
def j1k(spark, sf_dir):
    """J1 over a run whose number of clusters changes from period to period (4, 3, 4, ...)."""
    a = fx1_fit(spark, sf_dir, (3, 4))[1].assignments
    a = a.where(F.col("k") == F.when(F.col("time_point") % 2 == 0, 4).otherwise(3)).select("time_point", "id", "cluster_id")
    m = J.migration(a, ["time_point"])
    return (m.withColumn("change_proportion", r6(F.col("change_proportion")))
            .withColumn("share_of_previous", r6(F.col("share_of_previous"))))


def _ratio_sql(a: str, lag: int) -> str:
    """Per id at t: share of its cluster-mates at t sharing its cluster at t+lag."""
    return f"""SELECT n.time_point, n.k, {lag} AS lag, n.id, n.cluster_id AS c_now, l.cluster_id AS c_later,
  CASE WHEN l.cluster_id IS NULL THEN NULL ELSE
    (SELECT count(*) FROM {a} n2 JOIN {a} l2 ON l2.id = n2.id AND l2.time_point = n2.time_point + {lag} AND l2.k = n2.k
     WHERE n2.time_point = n.time_point AND n2.k = n.k AND n2.cluster_id = n.cluster_id AND l2.cluster_id = l.cluster_id)
    / (SELECT count(*) FROM {a} n3 WHERE n3.time_point = n.time_point AND n3.k = n.k AND n3.cluster_id = n.cluster_id)
  END AS ratio
FROM {a} n LEFT JOIN {a} l ON l.id = n.id AND l.time_point = n.time_point + {lag} AND l.k = n.k
WHERE n.time_point + {lag} IN (SELECT DISTINCT time_point FROM {a})"""


def _sql_j5():
    q, s, c, a = _oracle_fit()
    r = q.add("ratio", _ratio_sql(a, 1))
    return q.render(f"SELECT time_point, k, lag, id, c_now, c_later, round(ratio, 6) AS ratio FROM {r}")


@register("j5_companion_stability_lag1", _sql_j5())
def j5(spark, sf_dir):
    r = J.companion_ratio(_asg(spark, sf_dir), 1, KEYS)
    return r.select("time_point", "k", F.col("lag").cast("int"), "id", "c_now", "c_later", r6(F.col("ratio")).alias("ratio"))


def _sql_j9():
    q, s, c, a = _oracle_fit()
    parts = [q.add(f"ratio{lag}", _ratio_sql(a, lag)) for lag in LAGS]
    union = " UNION ALL ".join(f"SELECT time_point, k, lag, id, ratio FROM {p} WHERE ratio <= {THRESHOLD}" for p in parts)
    return q.render(f"SELECT time_point, k, CAST(lag AS INTEGER) AS lag, id, round(ratio, 6) AS ratio FROM ({union})")


@register("j9_changed_customers_lags_1_3_6_12", _sql_j9())
def j9(spark, sf_dir):
    r = J.changed_over_lags(_asg(spark, sf_dir), LAGS, THRESHOLD, KEYS)
    return r.select("time_point", "k", F.col("lag").cast("int"), "id", r6(F.col("ratio")).alias("ratio"))


J7_NOW, J7_NEXT = 0, 12


def _sql_j7():
    q, s, c, a = _oracle_fit()
    r = q.add("ratio", _ratio_sql(a, J7_NEXT - J7_NOW))
    return q.render(f"SELECT time_point, k, id, round(ratio, 6) AS ratio FROM {r} "
                    f"WHERE time_point = {J7_NOW} AND ratio <= {THRESHOLD}")


@register("j7_changed_between_two_months", _sql_j7())
def j7(spark, sf_dir):
    r = J.change_between(_asg(spark, sf_dir), J7_NOW, J7_NEXT, THRESHOLD, KEYS)
    return r.select("time_point", "k", "id", r6(F.col("ratio")).alias("ratio"))


def _sql_j8():
    q, s, c, a = _oracle_fit()
    r = q.add("ratio", _ratio_sql(a, 1))
    return q.render(f"""SELECT a.time_point, a.k, a.id, a.cluster_id,
  a.id NOT IN (SELECT id FROM {r} x WHERE x.time_point = a.time_point AND x.k = a.k AND x.ratio <= {THRESHOLD}) AS is_core
FROM {a} a""")


@register("j8_core_flag_lag1", _sql_j8())
def j8(spark, sf_dir):
    a = _asg(spark, sf_dir)
    ch = J.changed_customers(a, 1, THRESHOLD, KEYS)
    return J.core_flag(a, ch, KEYS).select("time_point", "k", "id", "cluster_id", "is_core")


def _sql_j8b():
    q, s, c, a = _oracle_fit()
    r = q.add("ratio", _ratio_sql(a, 1))
    return q.render(f"""SELECT a.time_point, a.k, a.id, a.cluster_id FROM {a} a
WHERE NOT EXISTS (SELECT 1 FROM {r} x WHERE x.time_point = a.time_point AND x.k = a.k AND x.id = a.id
                  AND x.ratio <= {THRESHOLD})""")


@register("j8_core_members_lag1", _sql_j8b())
def j8b(spark, sf_dir):
    a = _asg(spark, sf_dir)
    ch = J.changed_customers(a, 1, THRESHOLD, KEYS)
    return J.core_members(a, ch, KEYS).select("time_point", "k", "id", "cluster_id")


def _sql_j6():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT o.time_point, o.k, o.id AS of_id, m.id, m.cluster_id
FROM {a} o JOIN {a} m ON m.time_point = o.time_point AND m.k = o.k AND m.cluster_id = o.cluster_id
WHERE o.id = (SELECT min(CAST(s_suppkey AS BIGINT)) FROM supplier WHERE s_nationkey = 0)""")


@register("j6_companion_mask", _sql_j6())
def j6(spark, sf_dir):
    """The mask of one customer: the lowest supplier key of nation 0."""
    a = _asg(spark, sf_dir)
    who = (read_table(spark, sf_dir, "supplier").where(F.col("s_nationkey") == 0)
           .agg(F.min(F.col("s_suppkey").cast("bigint"))).first()[0])
    return J.companions_of(a, who, KEYS)


def _sql_j4():
    q, s, c, a = _oracle_fit()
    return q.render(f"""SELECT time_point, k, CAST(sum(n * n) AS BIGINT) AS co_member_pairs, CAST(sum(n) AS BIGINT) AS members
FROM (SELECT time_point, k, cluster_id, count(*) AS n FROM {a} GROUP BY ALL) GROUP BY time_point, k""")


@register("j4_co_membership_counts", _sql_j4())
def j4(spark, sf_dir):
    return J.co_membership_counts(_asg(spark, sf_dir), KEYS)


def _sql_j2():
    q, s, c, a = _oracle_fit()
    rows = q.add("rows", f"SELECT time_point, k, id, cluster_id, series_norm FROM {a}")
    return q.render(f"SELECT * FROM {O.projected(q, rows, O.pca(q, s, 12, 3), 'r.time_point, r.k, r.id, r.cluster_id', 2)}")


@register("j2_attach_pca", _sql_j2())
def j2(spark, sf_dir):
    a = fx1_fit(spark, sf_dir)[1].assignments.select("time_point", "k", "id", "cluster_id")
    out = J.attach_pca(a, pca_projection(spark, sf_dir), ["time_point"])
    return out.withColumn("pc1", r6(F.col("pc1"))).withColumn("pc2", r6(F.col("pc2")))
