"""Exact and near deduplication against brute force."""
import collections
import hashlib
import random
import re

import pytest

from tidewarp.llm import exact_dedup, near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def sets(text, words):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) >= words:
        return set(zip(*(w[i:] for i in range(words))))
    return {tuple(w)} if w else set()


def near_brute(rows, words, num, den):
    """[(doc_id, size of its set, component_id)] of (doc_id, text) rows."""
    s = [sets(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if den * both >= num * (len(s[i]) + len(s[j]) - both):
                    parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return [(rows[i][0], len(s[i]), min(ids[find(i)], default=None) if s[i] else rows[i][0]) for i in range(len(rows))]


EDGES = [(4, "a  b\tc"), (2, "a b c"), (9, None), (8, ""), (7, " "), (6, "\n\t "), (None, "a b c"), (2, "a b c"), (11, "A b c"), (None, "lone"), (None, "lone"),
         (12, "a b c"), (13, "w " * 5000), (14, "w\n" * 5000)]


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_exact_edges(spark, bits):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in EDGES], "doc_id long, text string, keep_id int, sha string")
    got = exact_dedup.deduplicate(docs, max_filter_bits=bits).collect()
    groups = collections.defaultdict(list)
    for i, t in EDGES:
        groups[normal(t)].append(i)
    want = []
    for i, t in EDGES:
        own = groups[normal(t)]
        want.append((i, min((x for x in own if x is not None), default=None), len(own), hashlib.sha256(normal(t).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def corpus(seed, shared_line, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(14)]
    rows, text = [], {}
    base = [[word() for _ in range(rng.randint(25, 80))] for _ in range(12)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.55:
            w = list(base[min(int(rng.expovariate(0.7)), 11)])
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([0, 1, 2, 4, 20, 60]))]
        if shared_line and rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = line
        rows.append((1000 - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,hot,stored", [(1, 16, 128), (3, 2, 8)])
def test_near_equals_brute_force(spark, monkeypatch, seed, hot, stored):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "STORED", stored)
    rows = corpus(seed, shared_line=True)
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[0][1]), (None, "only one null"), (6, None), (6, ""), (7, " \n"), (8, "two words"), (9, "two words"), (rows[3][0], rows[4][1])]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, component_id int").repartition(3)
    got = near_dedup.near_dedup(docs, 3, (85, 100)).collect()
    assert sorted(map(str, near_brute(rows, 3, 85, 100))) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_component_is_first(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "x y z x y"), (None, "x y z x y"), (4, ""), (5, None)]
    got = near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert sorted(str(r.doc_id) for r in got if r["first"]) == sorted(["3", "None", "4", "5"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_dedup(docs).collect()
    assert sorted(near_brute(rows, 5, 80, 100)) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_rows_repeated_over_tasks_link_once(spark, monkeypatch):
    """Repeated rows with near copies: every task that holds the row gives its set, one of them is used."""
    monkeypatch.setattr(near_dedup, "HOT", 2)
    monkeypatch.setattr(near_dedup, "STORED", 4)
    words = [f"w{i}" for i in range(60)]
    near = [(10 + i, " ".join([*words[:-1], f"end{i}"])) for i in range(6)]
    rows = [(1, " ".join(words))] * 40 + near + [(30, "some other words that no text shares")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = near_dedup.near_dedup(docs, 3, (85, 100)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, n, c) for d, n, c in near_brute(rows, 3, 85, 100))


def test_small_tables_are_sent_and_take_few_tasks(spark, monkeypatch):
    """With many shuffle partitions small grouped tables were as many tasks and files, and every join of labels or pairs shuffled both sides."""
    whole, files, sorted_joins = near_dedup.stage, {}, set()

    def stage(df, name):
        out = whole(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        if "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString():
            sorted_joins.add(name)
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    monkeypatch.setattr(near_dedup, "HOT", 4)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    rows = corpus(7, shared_line=True, n=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = near_dedup.near_dedup(docs, 3, (85, 100)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(str, near_brute(rows, 3, 85, 100))) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    grouped = {"near-classes", "near-lists", "near-centres", "near-members", "near-pairs", "cc-edges", "cc-ends", "near-first", "near-stays"}
    assert grouped <= set(files) and max(files[n] for n in grouped) <= near_dedup.LEAST_TASKS
    assert not sorted_joins & {"cc-told", "near-leaves", "near-parts", "near-named", "near-named-links"}


def test_a_low_estimate_is_as_rare_as_said():
    """_possible drops s = x / k only where the exact binomial tail at the similarity is under 1e-12."""
    import math
    for t in (0.8, 0.85):
        for k in (1, 8, 64, 100, 128):
            tail = 0.0
            for x in range(k + 1):
                tail += math.comb(k, x) * t ** x * (1 - t) ** (k - x)
                assert near_dedup._possible(x / k, k, t) or tail <= 1e-12 * 1.05
            assert near_dedup._possible(t, k, t) and near_dedup._possible(1.0, k, t)
