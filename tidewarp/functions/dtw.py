"""Series distances by dynamic programming (DTW, soft-DTW, banded DTW).

Two forms of each distance:

* the bulk form: numpy on the buffers of Arrow columns (``arrow_udf``). The DP runs as an
  anti-diagonal wavefront: all cells with ``i + j = d`` are independent, so a
  batch of P pairs costs ``n + m - 1`` vectorised steps instead of ``n * m``
  Python-level ones. Every cell is still ``cost + min(diag, up, left)`` with a
  single rounding, so the values equal a plain sequential DP bit for bit.
* a pure Spark SQL form, kept JVM-side for cross-checks and for callers who cannot run
  Python workers: for series of any length built from higher-order functions (``dtw_sql``),
  which Spark interprets node by node; for a length known beforehand one projection an
  anti-diagonal (``with_dtw``), whose cells Spark compiles.

Modes: ``full`` reads the corner cell D[n][m] (the default). ``prefix``
reproduces the compatibility reading D[n-1][m-1], i.e. the DTW of both series
without their last point, with the largest double for length-1 input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DOUBLE = float(np.finfo(np.float64).max)
_PAIRS = 8_000  # pairs per chunk: few calls, and the live diagonals of series of 12 stay in cache (~4 MB)


def _wavefront(cost_diag, n: int, m: int, p: int, gamma: float | None, band: int | None,
               mode: str) -> np.ndarray:
    """DTW of P pairs by anti-diagonals, keeping only the last two.

    Diagonal d holds the cells (i, d - i), stored by i; the three neighbours
    of a cell are then contiguous slices of the two previous diagonals:
    (i-1, j-1) on d-2 and (i-1, j), (i, j-1) on d-1. ``cost_diag(lo, hi, d, out)``
    puts the differences of the cells (i, d - i), lo <= i <= hi, into out (hi - lo + 1, P).
    """
    inf = np.inf
    bufs = [np.full((n + 1, p), inf) for _ in range(3)]
    prev2, prev1 = bufs[0], bufs[1]
    prev2[0] = 0.0  # D[0][0]
    tmp, costs = np.empty((n + 1, p)), np.empty((n + 1, p))
    corner = None
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        cur = bufs[d % 3]
        if band is not None:
            lo, hi = max(lo, -(-(d - band) // 2)), min(hi, (d + band) // 2)
            cur.fill(inf)
        else:  # the next diagonals look at one cell beyond each end
            cur[lo - 1] = inf
            cur[hi + 1:hi + 2] = inf
        if lo <= hi:
            a = prev2[lo - 1:hi]
            b = prev1[lo - 1:hi]
            c = prev1[lo:hi + 1]
            mn, cost = tmp[:hi - lo + 1], costs[:hi - lo + 1]
            np.minimum(a, b, out=mn)
            np.minimum(mn, c, out=mn)
            cost_diag(lo, hi, d, cost)
            if gamma is None:
                np.abs(cost, out=cost)
                best = mn
            else:
                np.multiply(cost, cost, out=cost)
                with np.errstate(invalid="ignore", over="ignore"):
                    sm = np.exp((mn - a) / gamma) + np.exp((mn - b) / gamma) + np.exp((mn - c) / gamma)
                    best = np.where(np.isinf(mn), inf, mn - gamma * np.log(sm))
            np.add(cost, best, out=cur[lo:hi + 1])
        if d == n + m - 2 and mode == "prefix":
            corner = cur[n - 1].copy()
        prev2, prev1 = prev1, cur
    if mode == "prefix":
        if n < 2 or m < 2:
            return np.full(p, MAX_DOUBLE)
        return corner
    return prev1[n]


def dtw_same_length(X: np.ndarray, Y: np.ndarray, *, gamma: float | None = None, band: int | None = None,
                    mode: str = "full") -> np.ndarray:
    """Row-wise distances of X[g] and Y[g]; X is (G, n), Y is (G, m)."""
    g, n = X.shape
    m = Y.shape[1]
    if n == 0 or m == 0:
        return np.full(g, np.nan)
    out = np.empty(g)
    for s in range(0, g, _PAIRS):
        xt, yt = np.ascontiguousarray(X[s:s + _PAIRS].T), np.ascontiguousarray(Y[s:s + _PAIRS].T)

        def cost(lo, hi, d, out, xt=xt, yt=yt):
            np.subtract(xt[lo - 1:hi], yt[d - hi - 1:d - lo][::-1], out=out)

        out[s:s + _PAIRS] = _wavefront(cost, n, m, xt.shape[1], gamma, band, mode)
    return out


def _to_centres(X: np.ndarray, m: int, k: int, table_of, gamma: float | None, band: int | None, mode: str) -> np.ndarray:
    """(rows, K) distances in chunks; ``table_of(s, e)``: the centres of rows s..e as (m, K, rows or 1). Rows are the innermost axis."""
    nrows, n = X.shape
    out = np.empty((nrows, k))
    step = max(1, _PAIRS // max(k, 1))
    for s in range(0, nrows, step):
        xt = np.ascontiguousarray(X[s:s + step].T)[:, None, :]  # (n, 1, b)
        b = xt.shape[2]
        ct = table_of(s, s + b)

        def cost(lo, hi, d, out, xt=xt, ct=ct, b=b):
            np.subtract(xt[lo - 1:hi], ct[d - hi - 1:d - lo][::-1], out=out.reshape(hi - lo + 1, k, b))

        out[s:s + step] = _wavefront(cost, n, m, k * b, gamma, band, mode).reshape(k, b).T
    return out


def dtw_to_centres(X: np.ndarray, C: np.ndarray, *, gamma: float | None = None, band: int | None = None,
                   mode: str = "full") -> np.ndarray:
    """Distances of every row of X (N, n) to every centre of C (K, m): (N, K)."""
    ct = np.ascontiguousarray(C.T)[:, :, None]
    return _to_centres(X, C.shape[1], C.shape[0], lambda s, e: ct, gamma, band, mode)


def dtw_to_row_centres(X: np.ndarray, stack: np.ndarray, codes: np.ndarray, *, gamma: float | None = None,
                       band: int | None = None, mode: str = "full") -> np.ndarray:
    """Distances of every row of X (B, n) to the centre table of its model, stack[codes[b]] (K, m): (B, K). Tables are
    gathered chunk by chunk, so memory does not grow with the batch."""
    _, k, m = stack.shape
    return _to_centres(X, m, k, lambda s, e: np.ascontiguousarray(stack[codes[s:e]].transpose(2, 1, 0)), gamma, band, mode)


class NearestCentres:
    """The nearest centre of every row of X (N, n) under full DTW, lowest index on ties: ``dtw_to_centres(X, C).argmin(axis=1)`` for any C
    (K, m), for passes that need no distances.

    Rows and centres are first put on a grid of 16-bit integers, on which the wavefront takes a sixth of the time. A cost is off by at most
    the two roundings, a warping path has its n + m - 1 cells, so the grid's distance is off by a known bound; only rows where it leaves more
    than one centre possible get exact distances, to those centres."""

    def __init__(self, X: np.ndarray):
        self.X = X
        self.lo, self.hi, self.m, self.grid = np.inf, -np.inf, 0, None

    def _fit_grid(self, C: np.ndarray) -> bool:
        """Put X on a grid that C fits in; False where no grid serves."""
        n, m = self.X.shape[1], C.shape[1]
        if self.m != m or C.min() < self.lo or C.max() > self.hi:
            self.lo, self.hi, self.m, self.grid = min(float(self.X.min()), float(C.min())), max(float(self.X.max()), float(C.max())), m, None
            self.top = min(32_767, 65_534 // max(n, m))  # of a cost, so that a distance, at most max(n, m) costs, fits 16 bits
            span = self.hi - self.lo
            self.scale = self.top / span if 1e-200 < span < 1e200 else 0.0
            if self.scale and 4 * (n + m) <= self.top:  # else the bound is too wide to tell centres apart
                place = (self.X - self.lo) * self.scale
                grid = np.rint(place)
                off = np.abs(place - grid)
                self.row_off = off.sum(axis=1) + (m - 1) * off.max(axis=1)  # a path visits a point once, and m - 1 times more between them
                self.grid = np.ascontiguousarray(grid.T.astype(np.int16))
        return self.grid is not None

    def __call__(self, C: np.ndarray) -> np.ndarray:
        C = np.asarray(C, dtype=np.float64)
        rows, n = self.X.shape
        k, m = C.shape
        if k == 1 or rows == 0:
            return np.zeros(rows, np.intp)
        if not (np.isfinite(C).all() and n and m and self._fit_grid(C)):
            return dtw_to_centres(self.X, C).argmin(axis=1)
        place = (C - self.lo) * self.scale
        grid = np.rint(place)
        off = np.abs(place - grid)
        centre_off = float((off.sum(axis=1) + (n - 1) * off.max(axis=1)).max())
        centres = grid.astype(np.int16)
        out = np.empty(rows, np.intp)
        work = None
        for s in range(0, rows, _GRID_ROWS):
            e = min(s + _GRID_ROWS, rows)
            x = np.ascontiguousarray(self.grid[:, s:e])
            together = k * (e - s) <= _GRID_ROWS  # few rows: all centres in one call
            pairs = (e - s) * (k if together else 1)
            if work is None or work[0].shape[1] != pairs:
                work = [np.empty((n + 1, pairs), np.uint16) for _ in range(3)] + [np.empty((n, pairs), np.int16)]
            if together:
                D = _grid_wavefront(np.tile(x, (1, k)), np.repeat(centres.T, e - s, axis=1), work).reshape(k, e - s)
            else:
                D = np.stack([_grid_wavefront(x, c[:, None], work) for c in centres])
            least = D.min(axis=0)
            possible = (D - least) <= (2 * (self.row_off[s:e] + centre_off) + 1).astype(np.uint16)  # 1: more than all float roundings
            cl = out[s:e]
            for c in range(k - 1, -1, -1):
                cl[possible[c]] = c
            at = np.flatnonzero(possible.sum(axis=0) > 1)
            if len(at):
                row, c = np.nonzero(possible[:, at].T)
                exact = np.full((len(at), k), np.inf)
                exact[row, c] = dtw_same_length(self.X[s + at[row]], C[c])
                cl[at] = exact.argmin(axis=1)
        return out


_GRID_ROWS = 8_000  # rows per chunk: few calls, and the live diagonals of series of 12 in 16 bits stay in cache (~1 MB)


def _grid_wavefront(x: np.ndarray, c: np.ndarray, work: list) -> np.ndarray:
    """``_wavefront`` in 16 bits: distances of the rows x (n, b) to the centres c (m, b or 1), a copy. Cells of the border hold the highest number;
    every other one has a neighbour inside, so nothing is added to that."""
    n, m = len(x), len(c)
    *bufs, costs = work
    prev2, prev1 = bufs[0], bufs[1]
    prev2.fill(_BORDER)
    prev1.fill(_BORDER)
    prev2[0] = 0
    back = c[::-1]
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        cur, cost = bufs[d % 3], costs[:hi - lo + 1]
        cur[lo - 1] = _BORDER
        cur[hi + 1:hi + 2] = _BORDER
        np.subtract(x[lo - 1:hi], back[m - d + lo:m - d + hi + 1], out=cost)
        np.abs(cost, out=cost)
        cell = cur[lo:hi + 1]
        np.minimum(prev1[lo - 1:hi], prev1[lo:hi + 1], out=cell)
        np.minimum(cell, prev2[lo - 1:hi], out=cell)
        np.add(cell, cost.view(np.uint16), out=cell)
        prev2, prev1 = prev1, cur
    return prev1[n].copy()


_BORDER = np.uint16(65_535)


def _stretches(column: pa.Array):
    """(all values, start and length of each row's list, rows without a null list) of a list column, on its buffers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_list(column.type) or not pa.types.is_float64(column.type.value_type):
        column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)


def dtw_lists(x: pa.Array, y: pa.Array, *, gamma: float | None = None, band: int | None = None, mode: str = "full", rows: np.ndarray | None = None) -> np.ndarray:
    """Row-wise distances of two list columns of (possibly ragged) series, gathered from their buffers by length; NaN where a
    series is null or empty. ``rows``: only these."""
    (xv, xs, xn, xok), (yv, ys, yn, yok) = _stretches(x), _stretches(y)
    out = np.full(len(xs), np.nan)
    use = xok & yok & (xn > 0) & (yn > 0)
    if rows is not None:
        use &= rows
    at = np.flatnonzero(use)
    sizes, group = np.unique(np.stack([xn[at], yn[at]], axis=1), axis=0, return_inverse=True)
    for g, (n, m) in enumerate(sizes):
        own = at[group.reshape(-1) == g]
        X, Y = xv[xs[own][:, None] + np.arange(n)], yv[ys[own][:, None] + np.arange(m)]
        out[own] = dtw_same_length(X, Y, gamma=gamma, band=band, mode=mode)
    return out


def dtw_one(x, y, **kw) -> float:
    one = lambda v: pa.array([None if v is None else np.asarray(v, dtype=np.float64)], pa.list_(pa.float64()))
    return float(dtw_lists(one(x), one(y), **kw)[0])


# --------------------------------------------------------------------------
# Arrow UDFs (SQL-callable after ``register``)
# --------------------------------------------------------------------------

def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _by_parameter(x: pa.Array, y: pa.Array, parameter: pa.Array, distance) -> pa.Array:
    """Distances of rows that each name their parameter; the rows of one value run together. A null parameter gives null."""
    out = np.full(len(x), np.nan)
    for value in pc.unique(parameter).to_pylist():
        if value is not None:
            rows = pc.fill_null(pc.equal(parameter, value), False).to_numpy(zero_copy_only=False)
            out = np.where(rows, distance(x, y, value, rows), out)
    return _column(out)


@F.arrow_udf(T.DoubleType())
def dtw_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    return _column(dtw_lists(x, y))


@F.arrow_udf(T.DoubleType())
def dtw_prefix_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    return _column(dtw_lists(x, y, mode="prefix"))


@F.arrow_udf(T.DoubleType())
def soft_dtw_udf(x: pa.Array, y: pa.Array, gamma: pa.Array) -> pa.Array:
    return _by_parameter(x, y, gamma, lambda x, y, g, rows: dtw_lists(x, y, gamma=float(g), rows=rows))


@F.arrow_udf(T.DoubleType())
def dtw_banded_udf(x: pa.Array, y: pa.Array, window: pa.Array) -> pa.Array:
    return _by_parameter(x, y, window, lambda x, y, w, rows: dtw_lists(x, y, band=int(w), rows=rows))


def register(spark: SparkSession) -> None:
    """Make the distances callable from SQL: dtw, dtw_prefix, soft_dtw, dtw_banded."""
    spark.udf.register("dtw", dtw_udf)
    spark.udf.register("dtw_prefix", dtw_prefix_udf)
    spark.udf.register("soft_dtw", soft_dtw_udf)
    spark.udf.register("dtw_banded", dtw_banded_udf)


def distance_column(x, y, distance: str = "dtw", gamma: float = 0.01, band: int | None = None,
                    mode: str = "full") -> Column:
    if distance == "soft_dtw":
        return soft_dtw_udf(x, y, F.lit(float(gamma)))
    if band is not None:
        return dtw_banded_udf(x, y, F.lit(int(band)))
    return dtw_prefix_udf(x, y) if mode == "prefix" else dtw_udf(x, y)


# --------------------------------------------------------------------------
# Pure SQL twins (no Python worker)
# --------------------------------------------------------------------------

_INF = "CAST('Infinity' AS DOUBLE)"


def _cost_sql(xi: str, yj: str, gamma: float | None) -> str:
    return f"abs({xi} - {yj})" if gamma is None else f"pow({xi} - {yj}, 2)"


def _best_sql(diag: str, up: str, left: str, gamma: float | None) -> str:
    """The least of a cell's three neighbours; with ``gamma`` the soft one."""
    mn = f"least({diag}, {up}, {left})"
    if gamma is None:
        return mn
    g = repr(float(gamma))
    return f"{mn} - {g} * ln(exp(({mn} - {diag}) / {g}) + exp(({mn} - {up}) / {g}) + exp(({mn} - {left}) / {g}))"


def dtw_sql(x: str, y: str, gamma: float | None = None) -> str:
    """Spark SQL text computing DTW (or soft-DTW) of array columns ``x``, ``y``.

    The outer ``aggregate`` walks the points of ``x`` carrying the previous DP
    row; the inner one builds the next row left to right.
    """
    best = _best_sql("element_at(P, j)", "element_at(P, j + 1)", "element_at(acc, -1)", gamma)
    cell = f"{_cost_sql('xi', f'element_at({y}, j)', gamma)} + ({best})"
    return (
        f"aggregate({x}, concat(array(0D), array_repeat({_INF}, size({y}))), "
        f"(P, xi) -> aggregate(sequence(1, size({y})), array({_INF}), "
        f"(acc, j) -> concat(acc, array({cell}))), "
        f"P -> element_at(P, -1))"
    )


def dtw_expr(x: str, y: str, gamma: float | None = None) -> Column:
    return F.expr(dtw_sql(x, y, gamma))


def with_dtw(df: DataFrame, x: str, y: str, name: str, length: int, gamma: float | None = None) -> DataFrame:
    """``df`` with a column ``name``: DTW (or soft-DTW) of its array columns ``x``, ``y``, as ``dtw_sql`` gives it.

    For two series of ``length`` points each anti-diagonal of the DP is a projection of the two before it, a column a
    cell. Spark compiles these; the lambdas of ``dtw_sql`` it interprets. Fused into one method they would be too long for
    the JVM to compile in its turn, so every projection also passes ``_dtw_fits`` through a higher-order function, which
    Spark does not fuse. Rows with a series of another length, or none, go through ``dtw_sql``.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    keep = [f"`{c.replace('`', '``')}`" for c in df.columns]
    points = range(1, length + 1)

    def cell(i, j):
        return "0D" if i == j == 0 else _INF if i == 0 or j == 0 else f"_dtw_{i}_{j}"

    def cells(d):
        return [(i, d - i) for i in points if d - i in points]

    fits = f"size({x}) = {length} AND size({y}) = {length}"
    out = df.selectExpr(*keep, f"array({fits}) AS _dtw_fits", f"if({fits}, NULL, {x}) AS _dtw_x", f"if({fits}, NULL, {y}) AS _dtw_y",
                        *(f"get({s}, {i - 1}) AS _dtw_{c}{i}" for c, s in (("x", x), ("y", y)) for i in points))
    for d in range(2, 2 * length + 1):
        ahead = [f"_dtw_{c}{i}" for c in "xy" for i in points if i > d - length]
        new = [f"{_cost_sql(f'_dtw_x{i}', f'_dtw_y{j}', gamma)} + ({_best_sql(cell(i - 1, j - 1), cell(i - 1, j), cell(i, j - 1), gamma)}) AS {cell(i, j)}"
               for i, j in cells(d)]
        out = out.selectExpr(*keep, "transform(_dtw_fits, f -> f) AS _dtw_fits", "_dtw_x", "_dtw_y", *ahead, *(cell(*c) for c in cells(d - 1)), *new)
    distance = f"CASE WHEN get(_dtw_fits, 0) THEN {cell(length, length)} ELSE {dtw_sql('_dtw_x', '_dtw_y', gamma)} END"
    return out.select(*keep, F.expr(distance).alias(name))
