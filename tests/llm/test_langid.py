"""Language identification: held-out accuracy, the network against loops and differences, edge cases."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import langid
from tidewarp.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_network_against_loops():
    net = langid.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(x)
    for row, p in zip(x, got):
        padded = np.concatenate([row, np.zeros(langid.SPAN, np.uint8)])
        pooled = []
        for f in range(len(net.bias)):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = net.filters[:, f].reshape(langid.SPAN, langid.DEPTH)
            assert not kernel[width:].any()
            answers = [sum(float(net.embed[padded[i + o]] @ kernel[o]) for o in range(width)) for i in range(langid.WINDOW)]
            pooled.append(max(0.0, max(answers) + net.bias[f]))
        z = np.array(pooled) @ net.dense + net.offset
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(p, want, atol=1e-4)


def test_gradients_against_differences():
    net = langid.Network(["a", "b"], seed=5)
    for name in ("embed", "filters", "bias", "dense", "offset", "mask"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 123, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        p = net.probabilities(x)
        return -np.log(p[np.arange(len(y)), y]).mean()

    for w, g in zip(net.weights(), net.gradients(x, y)):
        for at in np.argwhere(np.abs(g) > np.abs(g).max() / 2)[:3]:
            at = tuple(at)
            old = w[at]
            w[at] = old + 1e-6
            up = loss()
            w[at] = old - 1e-6
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-8)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, SF_SMALL)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = got.collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.95


def test_edges(spark):
    en = "the history of the town and the people who lived there before the river changed "
    de = "die Geschichte der Stadt und der Menschen die dort vor der Änderung des Flusses lebten "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 .,! ½", "en"), (103, de * 20000, None), (104, "über", None), (5, en, "en"), (5, en, "en"), (None, en, None), (105, "日本", None)]
    docs = spark.createDataFrame([(i, t, g, 7, "s") for i, t, g in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(5)
    got = langid.identify(docs)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert len(found[5]) == 3 and len(found[None]) == 1 and not found[None][0][0]
    assert all(f[0][1] == ("en" if i % 2 else "de") for i, f in found.items() if i is not None and i < 40)
    for i in (100, 101, 102):
        assert found[i][0][1:] == ("und", 0.0)
    assert found[103][0][1] == "de" and found[104][0][1] in ("en", "de") and found[105][0][1] in ("en", "de")
    assert found[103][0][2] > 0.5
    # the same answer whatever the partitions
    again = {r.doc_id: r.score for r in langid.identify(docs.coalesce(1)).where("doc_id < 40").collect()}
    assert all(abs(again[i] - found[i][0][2]) < 1e-6 for i in again)
    assert langid.identify(docs.limit(0)).count() == 0
    bare = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in bare.collect()} == {("und", 0.0)}


def test_whole_text_counts(spark):
    """A text that changes its language after a long beginning goes by all of it."""
    en, de = "the history of the town and its people ", "die Geschichte der Stadt und ihrer Menschen "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 9, "en" if i % 2 else "de") for i in range(60)] + [(1000, en * 300 + de * 3000, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).where("doc_id = 1000").collect()] == ["de"]
