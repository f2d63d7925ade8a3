"""DuckDB SQL text for the correctness gate.

Each registered query has a twin here, written against the driver's tables
(pre-registered DuckDB views). The text is assembled from small CTE
builders so the fixtures, windows, normalisation, DTW and k-means passes
are defined once. DTW is a nested ``list_reduce``: the outer one walks the
points of x carrying the previous DP row, the inner one builds the next row
(the same ``cost + least(diag, up, left)`` per cell as the Spark kernel).
"""

from __future__ import annotations

from tidewarp.sources.tables import FX1, FX2, FX3

INF = "'Infinity'::DOUBLE"
MAXD = "1.7976931348623157e308"


class Sql:
    """A WITH-chain under construction."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []
        self.stored: set[str] = set()
        self.recursive = False

    def add(self, name: str, body: str, stored: bool = False) -> str:
        """Append a CTE; ``stored`` ones are computed once and kept, so that no expression of theirs is repeated."""
        self.ctes.append((name, body))
        if stored:
            self.stored.add(name)
        return name

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in self.stored else ''}(\n{b}\n)" for n, b in self.ctes)
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{parts}\n{final}"


# --------------------------------------------------------------------------
# scalar fragments
# --------------------------------------------------------------------------

def dtw(x: str, y: str, gamma: float | None = None, mode: str = "full") -> str:
    if mode == "prefix":
        xs, ys = f"{x}[1:len({x})-1]", f"{y}[1:len({y})-1]"
        return f"(CASE WHEN len({x}) < 2 OR len({y}) < 2 THEN {MAXD} ELSE {dtw(xs, ys, gamma)} END)"
    if gamma is None:
        cell = "abs(xi - t[1]) + least(t[2], t[3], acc[len(acc)])"
    else:
        g = repr(float(gamma))
        mn = "least(t[2], t[3], acc[len(acc)])"
        cell = (f"(xi - t[1]) * (xi - t[1]) + ({mn} - {g} * ln(exp(({mn} - t[2]) / {g}) + exp(({mn} - t[3]) / {g})"
                f" + exp(({mn} - acc[len(acc)]) / {g})))")
    return (f"(list_reduce({x}, lambda P, xi: list_reduce(list_zip({y}, P[1:len(P)-1], P[2:len(P)]), "
            f"lambda acc, t: list_append(acc, {cell}), [{INF}]), "
            f"list_prepend(0.0::DOUBLE, list_transform({y}, lambda e: {INF}))))[len({y})+1]")


def l1(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])), lambda s, v: s + v, 0.0::DOUBLE)"


def lsum(a: str) -> str:
    return f"list_reduce({a}, lambda s, v: s + v, 0.0::DOUBLE)"


def lmean(a: str) -> str:
    return f"({lsum(a)} / len({a}))"


def lsd(a: str) -> str:
    m = lmean(a)
    return (f"(CASE WHEN len({a}) < 2 THEN NULL ELSE sqrt(list_reduce({a}, lambda s, v: s + (v - {m}) * (v - {m}), "
            f"0.0::DOUBLE) / (len({a}) - 1)) END)")


def normalise(raw: str) -> str:
    mn, mx = f"list_min({raw})", f"list_max({raw})"
    return (f"(CASE WHEN {mx} = {mn} THEN list_transform({raw}, lambda v: 0.0::DOUBLE) "
            f"ELSE list_transform({raw}, lambda v: (v - {mn}) / ({mx} - {mn})) END)")


def uniform01(seed: str, c: str, j: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, {c}, {j})), 1, 8))::BIGINT / 4294967296.0)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# --------------------------------------------------------------------------
# fixtures
# --------------------------------------------------------------------------

def fx1_panel(q: Sql, name: str = "panel") -> str:
    return q.add(name, """SELECT CAST(l_suppkey AS BIGINT) AS id,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS pos,
  sum(l_extendedprice * (1 - l_discount)) AS value
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_suppkey IS NOT NULL
GROUP BY 1, 2""")


def fx2_panel(q: Sql, name: str = "panel") -> str:
    return q.add(name, """SELECT CAST(l_partkey AS BIGINT) AS id,
  CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS pos,
  sum(l_extendedprice * (1 - l_discount)) AS value
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_partkey IS NOT NULL
GROUP BY 1, 2""")


def fx3_panel(q: Sql, name: str = "panel") -> str:
    return q.add(name, """SELECT CAST(user_id AS BIGINT) AS id,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS pos,
  sum(value) AS value
FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND user_id IS NOT NULL
GROUP BY 1, 2""")


PANEL_SQL = {"fx1": (fx1_panel, FX1), "fx2": (fx2_panel, FX2), "fx3": (fx3_panel, FX3)}


def dense(q: Sql, panel: str, name: str = "dense") -> str:
    """All positions up to the panel's last one."""
    return q.add(name, f"""SELECT i.id, list(coalesce(p.value, 0.0) ORDER BY r.pos) AS series
FROM (SELECT DISTINCT id FROM {panel}) i
CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(pos) + 1 FROM {panel}))) AS INTEGER) AS pos) r
LEFT JOIN {panel} p ON p.id = i.id AND p.pos = r.pos
GROUP BY i.id""")


def windows(q: Sql, dense_cte: str, window: int, tp_from: int, tp_to: int | None, length: int,
            name: str = "series") -> str:
    """Windows ``tp_from..tp_to``; without ``tp_to`` all that the series hold."""
    last = f"(SELECT max(len(series)) - {window - 1} FROM {dense_cte})" if tp_to is None else str(tp_to + 1)
    w = q.add(name + "_w", f"""SELECT CAST(t.tp AS INTEGER) AS time_point, d.id,
  d.series[t.tp + 1 : t.tp + {window}] AS series_full
FROM {dense_cte} d CROSS JOIN (SELECT unnest(range({tp_from}, {last})) AS tp) t""")
    r = q.add(name + "_r", f"SELECT *, series_full[1:{length}] AS series_raw FROM {w}")
    return q.add(name, f"SELECT *, {normalise('series_raw')} AS series_norm FROM {r}")


def fixture_series(q: Sql, fixture: str = "fx1", tp_from: int | None = None, tp_to: int | None = None,
                   length: int = 12) -> str:
    fn, spec = PANEL_SQL[fixture]
    p = fn(q)
    d = dense(q, p)
    return windows(q, d, spec.window, 0 if tp_from is None else tp_from, tp_to, length)


# --------------------------------------------------------------------------
# k-means, unrolled
# --------------------------------------------------------------------------

def lowest_id_centres(q: Sql, series: str, ks: list[int], name: str = "c0") -> str:
    kmax = max(ks)
    ranked = q.add(name + "_rk", f"""SELECT time_point, id, series_norm,
  CAST(row_number() OVER (PARTITION BY time_point ORDER BY id) AS INTEGER) AS rn
FROM {series}""")
    klist = ", ".join(str(k) for k in ks)
    return q.add(name, f"""SELECT r.time_point, CAST(k.k AS INTEGER) AS k, r.rn - 1 AS cluster_id, r.series_norm AS center
FROM {ranked} r JOIN (SELECT unnest([{klist}]) AS k) k ON r.rn <= k.k
WHERE r.rn <= {kmax}""")


def random_centres(q: Sql, keys: str, seed: int, length: int, name: str = "c0") -> str:
    """``keys`` has (time_point, k); seed string ``seed-tp-k`` as the Spark side."""
    seed_expr = f"concat_ws('-', '{seed}', time_point, k)"
    u = uniform01(seed_expr, "c", "j")
    return q.add(name, f"""SELECT time_point, CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster_id,
  list_transform(range(0, {length}), lambda j: {u}) AS center
FROM (SELECT time_point, k, unnest(range(0, k)) AS c FROM {keys})""")


def assign(q: Sql, series: str, centres: str, name: str, gamma: float | None = None, mode: str = "full",
           keys: tuple[str, ...] = ("time_point", "k")) -> str:
    on = " AND ".join(f"s.{k} = c.{k}" for k in keys)
    keycols = ", ".join(f"s.{k}" for k in keys)
    pairs = q.add(name + "_pd", f"""SELECT {keycols}, s.id, c.cluster_id, {dtw('s.series_norm', 'c.center', gamma, mode)} AS d
FROM {series} s JOIN {centres} c ON {on}""")
    keyplain = ", ".join(keys)
    return q.add(name, f"""SELECT {keyplain}, id,
  list(d ORDER BY cluster_id) AS dists,
  CAST(first(cluster_id ORDER BY d, cluster_id) AS INTEGER) AS cluster_id,
  min(d) AS dist
FROM {pairs} GROUP BY {keyplain}, id""")


def update(q: Sql, series: str, assigned: str, centres: str, length: int, name: str,
           keys: tuple[str, ...] = ("time_point", "k")) -> str:
    on_sa = " AND ".join(f"s.{k} = a.{k}" for k in keys)
    keyplain = ", ".join(keys)
    sums = q.add(name + "_m", f"""SELECT {", ".join("a." + k for k in keys)}, a.cluster_id,
  {", ".join(f"avg(s.series_norm[{i + 1}]) AS m{i}" for i in range(length))}
FROM {series} s JOIN {assigned} a ON {on_sa} AND s.id = a.id
GROUP BY {", ".join("a." + k for k in keys)}, a.cluster_id""")
    on_cm = " AND ".join(f"c.{k} = m.{k}" for k in keys)
    mlist = ", ".join(f"m.m{i}" for i in range(length))
    return q.add(name, f"""SELECT {", ".join("c." + k for k in keys)}, c.cluster_id,
  CASE WHEN m.cluster_id IS NULL THEN c.center ELSE [{mlist}] END AS center
FROM {centres} c LEFT JOIN {sums} m ON {on_cm} AND c.cluster_id = m.cluster_id""")


def kmeans(q: Sql, series: str, init: str, passes: int, length: int, gamma: float | None = None,
           keys: tuple[str, ...] = ("time_point", "k"), prefix: str = "km") -> tuple[str, str]:
    """Fixed number of passes, then the final assignment. Returns (centres, assignment)."""
    cur = init
    for p in range(passes):
        a = assign(q, series, cur, f"{prefix}_a{p}", gamma, keys=keys)
        cur = update(q, series, a, cur, length, f"{prefix}_c{p + 1}", keys=keys)
    final = assign(q, series, cur, f"{prefix}_af", gamma, keys=keys)
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys)
    full = q.add(f"{prefix}_asg", f"""SELECT a.*, s.series_full, s.series_raw, s.series_norm
FROM {final} a JOIN {series} s ON {on} AND s.id = a.id""")
    return cur, full


def fan_out_k(q: Sql, series: str, ks: list[int], name: str = "series_k") -> str:
    klist = ", ".join(str(k) for k in ks)
    return q.add(name, f"SELECT s.*, CAST(k.k AS INTEGER) AS k FROM {series} s, (SELECT unnest([{klist}]) AS k) k")


def silhouette_row(dists: str = "dists", cluster: str = "cluster_id") -> str:
    a = f"{dists}[{cluster} + 1]"
    b = f"list_min(list_filter({dists}, lambda d, i: i - 1 <> {cluster}))"
    return (f"(CASE WHEN len({dists}) < 2 THEN NULL WHEN greatest({a}, {b}) = 0 THEN 0.0 "
            f"ELSE ({b} - {a}) / greatest({a}, {b}) END)")


# --------------------------------------------------------------------------
# PCA by cyclic Jacobi rotations
# --------------------------------------------------------------------------

JACOBI_SWEEPS = 10


def pca(q: Sql, series: str, length: int, k: int, name: str = "pca") -> str:
    """(time_point, component, pc, explained) of the ``k`` first components of each time point's ``series_norm``, sign-fixed as
    ``quality.pca_by_group`` does. The eigenvectors of the covariance come from cyclic Jacobi rotations, one per step of a recursion."""
    n = length * length
    pairs = [(i, j) for i in range(length) for j in range(i + 1, length)]
    cov = q.add(name + "_cov", f"""SELECT time_point, [{", ".join(f"covar_samp(series_norm[{i + 1}], series_norm[{j + 1}])" for i in range(length) for j in range(length))}] AS a
FROM {series} GROUP BY time_point""", stored=True)
    column = lambda m: (f"list_transform(range(0, {n}), lambda i: CASE WHEN i % {length} = p THEN c * {m}[i + 1] - s * {m}[i + q - p + 1] "  # noqa: E731
                        f"WHEN i % {length} = q THEN s * {m}[i - q + p + 1] + c * {m}[i + 1] ELSE {m}[i + 1] END)")
    row = (f"list_transform(range(0, {n}), lambda i: CASE WHEN i // {length} = p THEN c * b[i + 1] - s * b[i + (q - p) * {length} + 1] "
           f"WHEN i // {length} = q THEN s * b[i - (q - p) * {length} + 1] + c * b[i + 1] ELSE b[i + 1] END)")
    eye = [1.0 if i == j else 0.0 for i in range(length) for j in range(length)]
    q.recursive = True
    rotated = q.add(name + "_jacobi", f"""SELECT time_point, 0 AS step, a, {eye}::DOUBLE[] AS v FROM {cov}
UNION ALL
SELECT time_point, step + 1, {row}, {column("v")} FROM (SELECT *, {column("a")} AS b FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (
  SELECT *, CASE WHEN a[p * {length} + q + 1] = 0 THEN 0.0 ELSE (CASE WHEN th >= 0 THEN 1 ELSE -1 END) / (abs(th) + sqrt(th * th + 1)) END AS t FROM (
  SELECT *, (a[q * {length} + q + 1] - a[p * {length} + p + 1]) / (2 * a[p * {length} + q + 1]) AS th FROM (
  SELECT *, {[i for i, _ in pairs]}[step % {len(pairs)} + 1] AS p, {[j for _, j in pairs]}[step % {len(pairs)} + 1] AS q
  FROM {name}_jacobi WHERE step < {JACOBI_SWEEPS * len(pairs)})))))""")
    vectors = q.add(name + "_vectors", f"""SELECT time_point, greatest(a[j * {length} + j + 1], 0.0) AS e, [v[i * {length} + j + 1] FOR i IN range({length})] AS x
FROM (SELECT *, unnest(range(0, {length})) AS j FROM {rotated} WHERE step = {JACOBI_SWEEPS * len(pairs)})""")
    ranked = q.add(name + "_ranked", f"""SELECT time_point, CAST(row_number() OVER (PARTITION BY time_point ORDER BY e DESC) - 1 AS INTEGER) AS component,
  e / sum(e) OVER (PARTITION BY time_point) AS explained,
  CASE WHEN x[list_position(list_transform(x, lambda y: abs(y)), list_max(list_transform(x, lambda y: abs(y))))] < 0 THEN list_transform(x, lambda y: -y) ELSE x END AS pc
FROM {vectors}""", stored=True)
    return q.add(name, f"SELECT * FROM {ranked} WHERE component < {k}")


def dot(x: str, y: str) -> str:
    return f"list_reduce(list_transform(list_zip({x}, {y}), lambda t: t[1] * t[2]), lambda s, v: s + v, 0.0::DOUBLE)"


def projected(q: Sql, rows: str, components: str, columns: str, k: int, name: str = "projected") -> str:
    """``columns`` of ``rows`` (time_point, series_norm, ...) and pc1.. of the ``k`` components of the row's time point."""
    wide = q.add(name + "_wide", f"SELECT time_point, {', '.join(f'any_value(pc) FILTER (WHERE component = {i}) AS w{i}' for i in range(k))} FROM {components} GROUP BY time_point")
    return q.add(name, f"""SELECT {columns}, {', '.join(f"round({dot('r.series_norm', f'w.w{i}')}, 6) AS pc{i + 1}" for i in range(k))}
FROM {rows} r JOIN {wide} w ON w.time_point = r.time_point""")
