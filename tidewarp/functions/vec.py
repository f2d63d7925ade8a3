"""Per-row array, math and string scalars (F1-F17) as Spark column builders.

Everything here is a built-in expression (higher-order functions over
arrays), so it runs JVM-side inside the row pipeline; nothing calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarp.functions.dtw import MAX_DOUBLE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minmax_normalise(series, least=None, most=None) -> Column:
    """(v - min) / (max - min); a constant series becomes all zeros. ``least``, ``most``: columns that hold the two;
    without them every value looks for them again."""
    s = _c(series)
    mn, mx = (F.array_min(s) if least is None else _c(least)), (F.array_max(s) if most is None else _c(most))
    return F.when(mx == mn, F.transform(s, lambda v: F.lit(0.0))).otherwise(
        F.transform(s, lambda v: (v - mn) / (mx - mn)))


def elementwise_sum(a, b) -> Column:
    """F2."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def elementwise_divide(a, n) -> Column:
    """divide every element by ``n`` (NULL elements when n is 0)."""
    n = F.lit(n) if isinstance(n, (int, float)) else _c(n)
    return F.transform(_c(a), lambda x: F.try_divide(x, n))


def series_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def series_mean(a) -> Column:
    """left-to-right sum divided by the length."""
    return F.try_divide(series_sum(a), F.size(_c(a)))


def series_sd(a) -> Column:
    """sample standard deviation (n - 1); NULL for one point."""
    s = _c(a)
    m = series_mean(s)
    ss = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    return F.sqrt(F.try_divide(ss, F.size(s) - 1))


def l1_distance(a, b) -> Column:
    """sum of absolute differences over the positions of ``a``."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def point_abs(a, b) -> Column:
    """F7."""
    return F.abs(_c(a) - _c(b))


def point_squared(a, b) -> Column:
    """F7."""
    d = _c(a) - _c(b)
    return d * d


def min3(a, b, c) -> Column:
    """F8."""
    return F.least(_c(a), _c(b), _c(c))


def softmin3(a, b, c, gamma: float) -> Column:
    """-gamma * log(sum exp(-v / gamma)), computed around the minimum."""
    a, b, c = _c(a), _c(b), _c(c)
    m = F.least(a, b, c)
    g = F.lit(float(gamma))
    return m - g * F.log(F.exp((m - a) / g) + F.exp((m - b) / g) + F.exp((m - c) / g))


def prefix_equal(a, b) -> Column:
    """``a`` equals the first len(a) points of ``b``."""
    return _c(a) == F.slice(_c(b), 1, F.size(_c(a)))


def id_union(a, b) -> Column:
    """distinct union of two id lists (first-seen order)."""
    return F.array_distinct(F.concat(_c(a), _c(b)))


def id_intersection(a, b, compat: bool = False) -> Column:
    """ids of ``a`` also in ``b``; compat mode returns them reversed."""
    r = F.array_intersect(_c(a), _c(b))
    return F.reverse(r) if compat else r


def series_to_text(id_col, series, decimals: int | None = None) -> Column:
    """``id,v,v,...``; ``decimals`` gives fixed-point text instead of the shortest repr."""
    s = _c(series)
    if decimals is None:
        vals = F.transform(s, lambda v: v.cast("string"))
    else:
        vals = F.transform(s, lambda v: F.format_string(f"%.{decimals}f", v))
    return F.concat_ws(",", _c(id_col).cast("string"), F.array_join(vals, ","))


def remove_at(arr, index) -> Column:
    """drop the element at 0-based ``index``."""
    idx = F.lit(index) if isinstance(index, int) else _c(index)
    return F.filter(_c(arr), lambda x, i: i != idx)


def pair_encode(norm, raw, as_text: bool = False) -> Column:
    """per position (norm, raw); text form ``norm_raw``."""
    if as_text:
        return F.zip_with(_c(norm), _c(raw), lambda a, b: F.concat_ws("_", a.cast("string"), b.cast("string")))
    return F.zip_with(_c(norm), _c(raw), lambda a, b: F.struct(a.alias("norm"), b.alias("raw")))


def uniform01(seed, c, j) -> Column:
    """Repeatable uniform [0, 1) from md5 of ``seed:c:j`` (same formula in DuckDB)."""
    key = F.concat_ws(":", _c(seed).cast("string"), _c(c).cast("string"), _c(j).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_vector(seed, c, length: int) -> Column:
    """F16: a length-``length`` vector of repeatable uniforms for centre ``c``."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: uniform01(seed, c, j))


def uniform_py(seed: int, c: int, j: int) -> float:
    """Driver-side twin of :func:`uniform01` (for centres built on the driver)."""
    import hashlib

    h = hashlib.md5(f"{seed}:{c}:{j}".encode()).hexdigest()[:8]
    return int(h, 16) / 4294967296.0


def converged(shift: float, eta: float) -> bool:
    """the k-means stop test."""
    return shift < eta


def length1_prefix_dtw() -> float:
    return MAX_DOUBLE
