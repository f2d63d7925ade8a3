"""Whitening against numpy over the distinct vectors, and exact integers."""
import math

import numpy as np
import pytest

from tidewarp.llm import whitening
from tidewarp.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def brute(rows, weights="one", most=16):
    """{(vec_id, place): [(n, deviation, whitened column up to sign, explained)]} by vector length."""
    usable = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in sorted({len(x) for _, x in usable}):
        own = [(i, tuple(x)) for i, x in usable if len(x) == d]
        counts = {}
        for _, x in own:
            counts[x] = counts.get(x, 0) + 1
        u = np.array(list(counts), np.int64)
        w = np.array([1 if weights == "one" else c for c in counts.values()])
        n, s = int(w.sum()), (u * w[:, None]).sum(axis=0)
        c = u - s / n
        cov = (c * w[:, None]).T @ c / n
        e, v = np.linalg.eigh(cov)
        order = np.argsort(e)[::-1][:most]
        e, v = e[order], v[:, order]
        for i, x in own:
            dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
            z = [float((np.array(x) - s / n) @ v[:, k] / math.sqrt(e[k])) if e[k] > 1e-9 * max(e[0], 1e-30) else 0.0 for k in range(len(e))]
            out.append((i, d, n, dev, z, [float(t / np.trace(cov)) if np.trace(cov) else 0.0 for t in e]))
    return out


def compare(got, want):
    """Rows of ``got`` against ``want``, each component up to one sign for all rows."""
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.n, r.deviation), {}).setdefault(r.component, []).append(r)
    expected = {}
    for i, d, n, dev, z, share in want:
        expected.setdefault((i, n, dev), []).append((d, z, share))
    assert set(found) == set(expected)
    signs = {}
    for key, rows in expected.items():
        for d, z, share in rows:
            assert sorted(found[key]) == list(range(1, len(z) + 1))
            for k, (value, part) in enumerate(zip(z, share), 1):
                copies = found[key][k]
                assert len(copies) == len(rows)
                for r in copies:
                    assert r.explained == pytest.approx(part, rel=1e-4, abs=1e-9)
                    if abs(value) > 1e-6:
                        signs.setdefault((d, k), set()).add(round(r.whitened / value, 5))
                    else:
                        assert abs(r.whitened) < 1e-5
                    assert r.identity_error <= 1e-4
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, SF_SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(got.collect(), brute(rows))


@pytest.mark.parametrize("weights,hot", [("one", 1000), ("count", 1000), ("one", 3)])
def test_edges(spark, monkeypatch, weights, hot):
    monkeypatch.setattr(whitening, "HOT", hot)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 2, 3)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(25)]  # one hot vector
    rows += [(3, rows[3][1]), (None, rows[4][1]), (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("-inf"), 1.0, 1.0]),
             (205, [0.5, 0.25]), (206, [0.75, -0.5]), (207, [0.0, 2.0]), (208, [3.0])]
    base = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, key string").repartition(4)
    compare(whitening.whiten(base, weights=weights).collect(), brute(rows, weights))
    single = whitening.whiten(base.where("vec_id = 208")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(1, 1, 0, 0.0, 0.0, 0.0)]
    assert whitening.whiten(base.limit(0)).count() == 0


def test_exact_beyond_a_long(spark):
    rows = [(i, [i * 1e9, -i * 1e9]) for i in range(200)] + [(900, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {r.vec_id: r.deviation for r in got.where("component = 1").collect()}
    x = [[min(max(math.floor(64 * c), -2 ** 53), 2 ** 53 - 1000000) + 1000000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for (i, _), v in zip(rows, x):
        assert found[i] == min(2 ** 63 - 1, sum((len(rows) * a - b) ** 2 for a, b in zip(v, s)))
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weights="two")
