"""Toxicity, license scans and language-model scores."""
import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import licenses, lm, toxicity


# ---------------------------------------------------------------- toxicity

def test_fold():
    assert toxicity.fold("w0rthl3ss ІDІ0Т $tupid tra​sh ｉｄｉｏｔ é 2023 5 a+ trash$$$ b") == "worthless idiot stupid trash idiot e 2023 5 a+ trash$$$ b"


def test_readings_of_disguised_words():
    lexicon = toxicity.Lexicon({e: 2.0 for e in ("worthless$", "idiot$", "clown", "loser", "imbecile$", "trash$", "ass$")})

    def found(text):
        return sorted(e for _, e in lexicon.hits(toxicity.plain(text)).values())

    for text, entry in (("worthle55", "worthless"), ("worthle$$", "worthless"), ("idi07", "idiot"), ("(1d10t)", "idiot"), ("c1own", "clown"), ("1oser", "loser"),
                        ("w0rth1ess", "worthless"), ("1mbeci1e", "imbecile"), ("trash$$$", "trash"), ("@loser", "loser"), ('"!d!0t!!!"', "idiot"), ("IDІ0Т", "idiot")):
        assert found(text) == [entry] and found(f"some {text} more") == [entry], text
    for text in ("assets", "ass3ts", "455", "$455", "x455", "c iown", "ciown", "ioser", "worthiess", "2023 5 a+", "!" * 50000):
        assert found(text) == [], text
    assert {"worthless$", "loser$", "idiot$"} <= toxicity._beginnings(toxicity.plain("worthle55 1oser (idi07)"))
    assert [p for p in lexicon.phrases("you are @loser, man", 9, "loser")] == [("loser", -1, "are"), ("loser", 1, "man")]


def toxic_corpus(seed=0, n=1200):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.choice([3, 20, 60, 200]))]
        kind = rng.random()
        if kind < 0.15:
            for _ in range(rng.choice([1, 2, 4])):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zorgle", "Zorgl3", "krimpan", "krimpos", "krimpuk"]))
        elif kind < 0.18:
            words[1:1] = ["brisk", "plonk"]  # plonk is bad only without its neighbour
        elif 0.3 <= kind < 0.4:
            words.insert(0, "plonk")
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 0.15 or 0.3 <= kind < 0.4)))
    return rows, labels


def test_toxicity_learns_words_stems_and_exceptions(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", 9) for i, t in rows] + [(None, "zorgle krimpax", "en", 9), (5000, None, "x", 0), (5001, "", "x", 0), (5002, "ｋrimpan zorg1e", "x", 0),
                                 (5003, "zorgle " + "x " * 100000, "x", 0), (0, rows[0][1], "en", 9)], "doc_id long, text string, lang string, score int").repartition(3)
    lab = spark.createDataFrame([(i, y, 0) for i, y in labels] + [(None, 1, 0), (3, None, 0), (labels[4][0], labels[4][1], 0)], "doc_id long, toxic int, text int")
    got = toxicity.score(docs, toxicity.training_labels(lab)).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i in held if by[i].predicted != truth[i]]
    assert len(wrong) <= 0.05 * len(held), [(i, by[i].score, truth[i]) for i in wrong[:5]]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 1
    assert toxicity.score(docs.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(20), lab.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.training_labels(labels))
    held = scored.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    toxic, clean = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    assert sum(a > b for a in toxic for b in clean) > 0.85 * len(toxic) * len(clean)
    assert sum(s >= 0.7 for s in clean) <= 0.05 * len(clean)


# ---------------------------------------------------------------- licenses

def test_license_edges(spark):
    mit = dict((n, t) for n, t in licenses.TEMPLATES)["mit-text"]
    filler = " ".join(f"w{i}" for i in range(301))
    rows = [(1, mit), (2, f"{filler}\n{mit.upper()} {filler}"), (3, None), (4, ""), (5, "All rights"), (6, "all RIGHTS\treserved"), (7, mit[: len(mit) // 2]), (None, "Licensed under CC BY-NC 4.0."),
            (6, "all RIGHTS\treserved"), (8, "Released under the MIT License. " * 4000), (9, f"{mit} Licensed under the Apache License, Version 2.0. All rights reserved. Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, row int")
    got = sorted((str(r.doc_id), r.license) for r in licenses.scan(docs).collect())
    assert got == sorted([("1", "mit-text"), ("2", "mit-text"), ("6", "all-rights-reserved"), ("6", "all-rights-reserved"), ("None", "cc-by-nc-4.0"), ("8", "mit-notice"),
                          ("9", "mit-text"), ("9", "apache-2.0"), ("9", "all-rights-reserved"), ("9", "cc-by-4.0")])
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, table=()).count() == 0


def test_license_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(con.execute(licenses.oracle()).fetchall()) == sorted(map(tuple, licenses.scan(spark.read.parquet(path)).collect()))


# ---------------------------------------------------------------- language model

def lm_brute(rows):
    def tokens(t):
        return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c, pair, types = collections.Counter(), collections.Counter(), collections.Counter()
    for h, (_, t) in zip(held, rows):
        if not h:
            w = tokens(t)
            c.update(w)
            pair.update(zip([None, *w], w))
    for a, _ in pair:
        types[a] += 1
    n, v = sum(c.values()), len(c)
    one, two = (sum(x == k for x in pair.values()) for k in (1, 2))
    d = one / (one + 2 * two) if one and two else 0.5
    word = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    arc = lambda a, w: (max(pair[a, w] - d, 0) + d * types[a] * word(w)) / c[a] if c[a] else word(w)
    out = []
    for h, (i, t) in zip(held, rows):
        w = tokens(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(word(x)) for x in w), sum(math.log10(arc(a, x)) for a, x in zip([None, *w], w))))
    for a in [None, *list(c)[:3]]:  # the arcs of a state and its failure arc make up a distribution
        assert abs(sum(arc(a, x) for x in c) + (arc(a, "\x00") if c[a] else word("\x00")) - 1) < 1e-9
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot,part,slot", [(2000, 8 << 20, 16 << 20), (4, 300, 20)])
def test_lm_edges(spark, monkeypatch, hot, part, slot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "PART_BYTES", part)
    monkeypatch.setattr(lm, "SLOT_TEXT", slot)
    monkeypatch.setattr(lm, "TASKS", 24)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "of", "a", "b", "c", "d", "e", f"u{rng.randrange(40)}"]) for _ in range(rng.choice([0, 1, 5, 30])))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "the of a"), (3, rows[3][1]), (203, "the " * 20000)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, part int, score string").repartition(3)
    same(lm.score(docs).collect(), lm_brute(rows))
    assert lm.score(docs.limit(0)).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0]
    same(lm.score(spark.createDataFrame(held, "doc_id long, text string")).collect(), [(i, True, len((t or "").split()) + 1, 0, 0, 0.0 + (len((t or "").split()) + 1) * math.log10(1.0), 0.0) for i, t in held])


@pytest.mark.parametrize("hot", [2000, 4])
def test_lm_keeps_words_apart_that_share_32_bits(spark, monkeypatch, hot):
    tokens = lm._tokens

    def alike(texts):  # the low half of every hash is the same
        t, n = tokens(texts)
        return np.where(t == lm.END, t, t | np.uint64(0xFFFFFFFF)), n

    monkeypatch.setattr(lm, "_tokens", alike)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e", f"u{rng.randrange(20)}"]) for _ in range(12))) for i in range(60)]
    docs = pa.table({"part": pa.array([0] * 60, pa.int32()), "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "copies": pa.array([1] * 60, pa.int64())})
    words, counts = np.unique(alike(docs.column("text").chunk(0))[0], return_counts=True)
    hot = words[counts * hot > counts.sum()]
    asked = lm._requests(docs, lm.Slots(1, hot, np.ones(len(hot), np.int64)), 10)
    told = lm._answers(asked, words[:0])
    want = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            w = [*t.split(), None]
            want.update(zip([None, *w], w))
    by_key = {k: v for k, v in zip(told.column("key").to_pylist(), told.column("value").to_pylist()) if k is not None}
    assert by_key[lm.N_ONE] == sum(c == 1 for c in want.values()) and by_key[lm.N_TWO] == sum(c == 2 for c in want.values())


def test_lm_repeated_rows(spark):
    rows = [(i % 7, f"a b c {i % 7} d") for i in range(40)] + [(3, None), (3, None), (None, "a b"), (None, "a b"), (None, None), (10, "b a b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    same(lm.score(docs).collect(), lm_brute(rows))


def test_lm_collapse_compares_rows():
    batch = lambda keys: pa.RecordBatch.from_arrays([pa.array([0] * 6, pa.int32()), pa.array(keys, pa.int64()), pa.array([1, 1, 2, None, None, 1]), pa.array(["a", "a", "a", "a", "a", None])], ["part", "key", "doc_id", "text"])
    for keys in ([5] * 6, [5, 5, 6, 7, 7, 8]):  # rows that share a key stay apart unless equal
        got = [r for b in lm._collapse([batch(keys)]) for r in b.to_pylist()]
        whole = collections.Counter()
        for r in got:
            whole[r["doc_id"], r["text"]] += r["copies"]
        assert whole == {(1, "a"): 2, (2, "a"): 1, (None, "a"): 2, (1, None): 1}


def test_lm_spreads_words_by_their_tokens(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 500, np.int64)
    every = np.maximum(1, 1_000_000 // np.arange(1, 501))
    counts = spark.createDataFrame([(int(w), int(e)) for w, e in zip(words, every)], "w long, every long")
    for text_bytes in (1, 1 << 34):
        slots = lm.layout(counts, int(every.sum()), text_bytes)
        home, is_hot, spread = slots.of(words.view(np.uint64))
        share = every / every.sum()
        assert (is_hot == (share > 1 / (lm.SHARE * slots.n))).all() and (spread[~is_hot] == 1).all()
        assert (share / spread <= 1 / (lm.SHARE * slots.n) + share / slots.n).all() and spread.max() <= slots.n
        assert (spread <= 2 * share * lm.SHARE * slots.n + 1).all()


def test_lm_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.score(docs).collect()
    same(got, lm_brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
