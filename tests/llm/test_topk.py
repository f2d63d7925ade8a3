"""Exact top-k search against all products."""
import math
import random

import pytest

from tidewarp.llm import topk


def brute(rows, queries, k, scale=256):
    def ints(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]
    usable = [(i, w) for i, v in rows if i is not None and (w := ints(v))]
    out = []
    for q in sorted({i for i, _ in queries if i is not None}):
        own = [w for i, w in usable if i == q]
        if own:
            w = own[0]
            found = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in usable if i != q and len(c) == len(w))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("block_rows,tile_rows", [(8192, 2048), (3, 5)])
def test_edges(spark, monkeypatch, block_rows, tile_rows):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.7, 0.25]) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4),
             (105, [0.5, 0.5]), (110, [0.25, -0.5]), (5, rows[5][1]), (120, [3e12, 1.0, 1.0, 1.0]), (7, rows[9][1])]
    base = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string").repartition(3)
    asked = base.where("vec_id % 5 = 0")
    got = topk.search(base, asked, k=5, block_rows=block_rows, tile_rows=tile_rows)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    want = brute(rows, [(i, v) for i, v in rows if i is not None and i % 5 == 0], 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(base.limit(0), asked.limit(0)).count() == 0
    assert topk.search(base, asked.limit(0)).count() == 0


def test_table(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in base.collect()]
    got = topk.search(base, base.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, [r for r in rows if r[0] % 50 == 0], 5))
