"""Properties of the DTW kernels (no Spark needed)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarp.functions import dtw as D
from tidewarp.functions.dtw import MAX_DOUBLE, dtw_one, dtw_same_length, dtw_to_centres

series = st.lists(st.floats(min_value=-5, max_value=5, allow_nan=False), min_size=1, max_size=9)


def naive(x, y, soft_gamma=None, corner="full"):
    """Plain transcription of the recurrence with largest-double boundaries."""
    n, m = len(x), len(y)
    D = [[MAX_DOUBLE] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if soft_gamma is None:
                d = abs(x[i - 1] - y[j - 1])
                D[i][j] = d if (i == 1 and j == 1) else min(D[i - 1][j - 1], D[i - 1][j], D[i][j - 1]) + d
            else:
                d = (x[i - 1] - y[j - 1]) ** 2
                if i == 1 and j == 1:
                    D[i][j] = d
                else:
                    a, b, c = (v / -soft_gamma for v in (D[i - 1][j - 1], D[i - 1][j], D[i][j - 1]))
                    mx = max(a, b, c)
                    s = sum(math.exp(v - mx) for v in (a, b, c))
                    D[i][j] = -soft_gamma * (math.log(s) + mx) + d
    return D[n][m] if corner == "full" else D[n - 1][m - 1]


@settings(max_examples=150, deadline=None)
@given(series, series)
def test_dtw_equals_plain_dp(x, y):
    assert dtw_one(x, y) == naive(x, y)


@settings(max_examples=100, deadline=None)
@given(series, series)
def test_symmetric_nonnegative(x, y):
    a, b = dtw_one(x, y), dtw_one(y, x)
    assert a >= 0 and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@settings(max_examples=100, deadline=None)
@given(series)
def test_identity(x):
    assert dtw_one(x, x) == 0.0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9).flatmap(lambda n: st.tuples(
    st.lists(st.floats(-5, 5), min_size=n, max_size=n), st.lists(st.floats(-5, 5), min_size=n, max_size=n))))
def test_bounded_by_l1(xy):
    x, y = xy
    assert dtw_one(x, y) <= sum(abs(a - b) for a, b in zip(x, y)) + 1e-9


@settings(max_examples=100, deadline=None)
@given(series, series)
def test_prefix_mode(x, y):
    got = dtw_one(x, y, mode="prefix")
    if len(x) < 2 or len(y) < 2:
        assert got == MAX_DOUBLE
    else:
        assert got == dtw_one(x[:-1], y[:-1])
        assert got == naive(x, y, corner="prefix")


@settings(max_examples=60, deadline=None)
@given(series, series)
def test_soft_dtw_matches_recurrence(x, y):
    got = dtw_one(x, y, gamma=0.5)
    want = naive(x, y, soft_gamma=0.5)
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_soft_dtw_tends_to_squared_dtw():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random(8), rng.random(6)
        hard = dtw_one(x, y)
        # squared-cost hard DTW through the soft kernel with tiny gamma
        soft = dtw_one(x, y, gamma=1e-9)
        sq = naive([float(v) for v in x], [float(v) for v in y], soft_gamma=1e-9)
        assert math.isclose(soft, sq, rel_tol=1e-9, abs_tol=1e-9)
        assert hard >= 0


def test_band():
    rng = np.random.default_rng(2)
    X, Y = rng.random((30, 10)), rng.random((30, 10))
    full = dtw_same_length(X, Y)
    assert np.allclose(dtw_same_length(X, Y, band=20), full)
    assert np.all(dtw_same_length(X, Y, band=1) >= full - 1e-12)
    assert np.allclose(dtw_same_length(X, Y, band=0), np.abs(X - Y).sum(axis=1))


def test_centres_equal_pairwise():
    rng = np.random.default_rng(3)
    X, C = rng.random((50, 12)), rng.random((4, 12))
    D = dtw_to_centres(X, C)
    for i in range(4):
        assert np.array_equal(D[:, i], dtw_same_length(X, np.repeat(C[i:i + 1], 50, axis=0)))


def test_length_one_and_unequal():
    assert dtw_one([1.0], [3.0]) == 2.0
    assert dtw_one([1.0, 2.0, 3.0], [1.0, 3.0]) == dtw_one([1.0, 3.0], [1.0, 2.0, 3.0])


def test_pairs_run_in_chunks_of_bounded_memory():
    """The diagonals of a chunk are held, not those of all pairs."""
    import tracemalloc

    rng = np.random.default_rng(5)
    X, Y, C = rng.random((200_000, 12)), rng.random((200_000, 12)), rng.random((3, 12))
    tracemalloc.start()
    try:
        pairs = D.dtw_same_length(X, Y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20_000_000
    near = D.dtw_to_centres(X, C)
    for i in (0, 7_999, 8_000, 199_999):
        assert pairs[i] == D.dtw_one(X[i], Y[i])
        assert near[i].tolist() == [D.dtw_one(X[i], c) for c in C]


def test_sql_form_by_diagonals_equals_the_interpreted_one(spark):
    """Cells as compiled columns: the very values of ``dtw_sql``, also for other lengths, nulls and odd numbers."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.random(4).tolist(), rng.random(4).tolist()) for i in range(40)]
    rows += [(40, [0.0] * 4, [0.0] * 4), (41, [1.0, 2.0, 3.0], [1.0, 3.0]), (42, None, [1.0] * 4), (43, [1.0] * 4, None), (44, [], [1.0] * 4),
             (45, [1.0, None, 2.0, 3.0], [1.0] * 4), (46, [1.0, math.nan, 2.0, 3.0], [1.0] * 4), (47, [math.inf] * 4, [1.0] * 4),
             (48, [1.0] * 5, [1.0] * 4), (49, [5e8] * 4, [-5e8] * 4), (49, [5e8] * 4, [-5e8] * 4)]
    df = spark.createDataFrame(rows, "`a b` int, x array<double>, y array<double>")
    for gamma in (None, 0.01):
        got, want = ([(r[0], repr(r[3])) for r in f.orderBy("a b").collect()]
                     for f in (D.with_dtw(df, "x", "y", "d", 4, gamma), df.withColumn("d", D.dtw_expr("x", "y", gamma))))
        assert got == want
        assert all(math.isclose(float(v), naive(x, y, gamma), abs_tol=1e-9) for (_, v), (_, x, y) in zip(got[:42], rows, strict=False))
    one = D.with_dtw(df.selectExpr("slice(x, 1, 1) x", "array(2D) y"), "x", "y", "d", 1).where("size(x) = 1").collect()
    assert all(r["d"] == (None if r["x"][0] is None else abs(r["x"][0] - 2)) or math.isnan(r["d"]) for r in one)


def test_sql_twins_compile_their_cells(spark, tmp_path):
    """No cell is interpreted for series of the fixtures' length, and no projection of cells is fused with the next."""
    import datetime

    import __spark_entry__ as E

    day = lambda m: datetime.datetime(1995 + m // 12, m % 12 + 1, 5)
    rows = [(s, float(100 + (m * 7 + s) % 11), 0.1, day(m)) for s in (1, 2) for m in range(18)]
    schema = "l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, other in (("d2_soft_dtw_sql_twin", "d2_soft_dtw"), ("d1_dtw_sql_twin", "d1_dtw")):
        df = E.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        cells = [line for line in plan if "Project" in line and "transform(_dtw_fits" in line]
        assert len(cells) > 2 * 12 - 4 and not any("*(" in line for line in cells)
        assert sorted(df.collect()) == sorted(E.queries()[other](spark, str(tmp_path)).collect()) and df.count() == 2 * 3


def test_nearest_centre_on_the_grid_is_the_nearest_by_exact_distances(monkeypatch):
    """Ties, near ties, ragged lengths, wide and tiny ranges, constant series, centres outside the range of the rows, chunks."""
    rng = np.random.default_rng(3)
    for n, m, k, scale in ((12, 12, 5, 1.0), (12, 12, 10, 1.0), (5, 12, 4, 1e9), (12, 5, 3, 1e-12), (1, 1, 3, 1.0), (1, 12, 2, 1.0), (40, 40, 3, 1.0), (200, 200, 2, 1.0), (12, 12, 1, 1.0), (6, 6, 300, 1.0)):
        X = rng.random((700, n)) * scale
        C = rng.random((k, m)) * scale
        C[-1] = C[0]  # an exact tie: the lowest index
        if k > 2:
            C[1] = C[0] + 1e-13 * scale  # a difference that no grid shows
        monkeypatch.setattr(D, "_GRID_ROWS", 300)
        near = D.NearestCentres(X)
        for move in (0.0, 0.1, -3.0, 50.0):
            assert (near(C + move * scale) == dtw_to_centres(X, C + move * scale).argmin(axis=1)).all()
    X = np.repeat(rng.random((5, 1)), 12, axis=1)
    assert (D.NearestCentres(X)(X[:3]) == dtw_to_centres(X, X[:3]).argmin(axis=1)).all()
    assert (D.NearestCentres(np.zeros((4, 12)))(np.zeros((2, 12))) == 0).all() and D.NearestCentres(np.zeros((0, 3)))(np.zeros((2, 3))).shape == (0,)


def test_a_pass_of_a_fit_needs_few_exact_distances(monkeypatch):
    """Only rows that the grid leaves open get exact distances, to the centres left open."""
    rng = np.random.default_rng(4)
    X, C = rng.random((3000, 12)), rng.random((6, 12))
    pairs = []
    whole = D.dtw_same_length
    monkeypatch.setattr(D, "dtw_same_length", lambda X, Y, **kw: pairs.append(len(X)) or whole(X, Y, **kw))
    D.NearestCentres(X)(C)
    assert sum(pairs) < 0.1 * len(X) * len(C)
