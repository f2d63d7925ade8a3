"""Collocations against counting every phrase."""
import random
import re

import pytest

from tidewarp.llm import collocations


def brute(rows, longest=4, support=30, cover=80, first=2000):
    f, n = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        n.setdefault(lang, 0)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    key = (lang, tuple(words[i:i + m]))
                    f[key] = f.get(key, 0) + 1
    many = {k: v for k, v in f.items() if v >= support}
    longer = {}
    for (lang, p), a in many.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                part = (lang, p[i:i + m])
                longer[part] = max(longer.get(part, 0), a)
    out = []
    for lang in n:
        rows_ = []
        for (g, p), a in many.items():
            if g != lang or len(p) < 2 or 100 * longer.get((g, p), 0) >= cover * a:
                continue
            score, _, l, r = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:first], 1)]
    return sorted(out)


def random_rows(seed, count=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Ä", "ä", "x" * 40, "d-e", "日本", "\xa0", "é"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b", "!?"]) for _ in range(rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("block,slice_,chunk", [(256, 512, 1 << 21), (4, 3, 16), (5, 1, 64)])
def test_random_texts(spark, monkeypatch, block, slice_, chunk):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("CHUNK", chunk)):
        monkeypatch.setattr(collocations, name, value)
    rows = random_rows(block)
    rows += [(None, "en"), ("", "de"), ("...", "fr"), (None, None), ("a b c a b c " * 40, "en"), ("a b c", "en"), ("a b c", "en")]
    docs = spark.createDataFrame([(t, g, 5, "s") for t, g in rows], "text string, lang string, n int, word string").repartition(3)
    got = collocations.mine(docs, support=6)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes[1:2] + got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, support=6)
    few = collocations.mine(docs, support=6, first=3, cover=101, longest=3)
    assert sorted(map(tuple, few.collect())) == brute(rows, support=6, first=3, cover=101, longest=3)


def test_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 64)
    rows = [("one two three four " * 3000, "en"), ("w" * 5000 + " v " + "w" * 5000, "en"), ("no, end", None)] + [("w" * 5000 + " v", "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(map(tuple, collocations.mine(docs).collect())) == brute(rows)
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("lang is null")).count() == 0


def test_groups_with_one_id(monkeypatch):
    """Groups are told apart by both parts, also where their ids collide."""
    import numpy as np

    monkeypatch.setattr(collocations, "_join_ids", lambda a, b: (a + b) % np.uint64(3))
    head, word = np.array([1, 2, 1, 4, 1], np.uint64), np.array([5, 4, 5, 2, 2], np.uint64)
    h, w, c = collocations._group(head, word, np.ones(5, np.int64))
    assert sorted(zip(h.tolist(), w.tolist(), c.tolist())) == [(1, 2, 1), (1, 5, 2), (2, 4, 1), (4, 2, 1)]


def test_grouping_holds_little_beyond_its_rows():
    """Adding up took 2.5 times the size of the rows beside them, and a batch of a relation 51 MB."""
    import tracemalloc

    import numpy as np

    n = 1 << 18
    rng = np.random.default_rng(5)
    head, word = rng.integers(0, 1 << 9, (2, n)).astype(np.uint64)
    ones = np.ones(n, np.int64)
    tracemalloc.start()
    h, w, c = collocations._group(head, word, ones)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.sum() == n and len(set(zip(h.tolist(), w.tolist()))) == len(h) == len(np.unique(head * np.uint64(512) + word))
    assert most < 2 * (head.nbytes + word.nbytes + ones.nbytes)
    assert collocations.BLOCK * 20 * 10_000 < 16 << 20  # bytes of a batch of 10,000 rows of a relation


def test_workers_hold_little_at_a_time(spark):
    """Words and groups were added up a million at a time, and a megabyte of text was hashed with 30 bytes beside each of its own."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    run = {}

    class Docs:
        select = groupBy = lambda self, *a: self
        agg = lambda self, *a: self

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

    collocations.word_counts(Docs())
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    got = sum(int(b.column("c").to_numpy()[b.column("word").is_valid().to_numpy(zero_copy_only=False)].sum()) for b in run["f"](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 400 * len(texts)
    assert most < 40 << 20, most >> 20


def test_equal_words_of_two_batches_are_one():
    import numpy as np
    import pyarrow as pa

    rows = [(pa.array(["en", "de"]), np.array([7, 3], np.uint64), pa.array(["x", "y"], pa.large_string()), np.array([2, 1])),
            (pa.array(["en", "en"]), np.array([7, 3], np.uint64), pa.array(["x", "z"], pa.large_string()), np.array([5, 4]))]
    langs, w, words, count = collocations._add_up(rows[:1] + [(c[0][:1], c[1][:1], c[2][:1], c[3][:1]) for c in rows[1:]])
    assert list(zip(langs.to_pylist(), w.tolist(), words.to_pylist(), count.tolist())) == [("de", 3, "y", 1), ("en", 7, "x", 7)]
    langs, w, words, count = collocations._add_up(rows)  # one id, two words
    assert sorted(zip(langs.to_pylist(), w.tolist(), words.to_pylist(), count.tolist())) == [("de", 3, "y", 1), ("en", 3, "z", 4), ("en", 7, "x", 7)]


def test_table_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(collocations.oracle()).fetchall()
    got = collocations.mine(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
