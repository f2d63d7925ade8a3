"""The pipeline against a brute-force version of its stages, and the registered SQL."""
import collections
import zlib
from unittest.mock import MagicMock

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import near_brute, normal
from tidewarp.llm import queries, toxicity
from tidewarp.llm.common import stage

SF = "/root/testdata/sf0.001"


def brute(rows, score):
    """Rows (doc_id, text) left after the three filters; a tie is named by its id and text."""
    rows = [r for r in rows if score[r] < corpus_pipeline.THRESHOLD]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    return [r for r, (_, n, low) in zip(rows, near_brute(rows, corpus_pipeline.WORDS, *corpus_pipeline.SIMILARITY)) if n == 0 or r[0] == low]


def left(spark, docs):
    for i, (_, step) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(step(spark, docs, SF), f"test-{i}")
        assert after.schema.simpleString() == docs.schema.simpleString()
        docs = after
    return docs


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.collect()
    own = [base[0].text, base[1].text]
    extra = [(9001, own[0], "en", "s", 1, "a"), (9002, "  " + own[0].replace(" ", "\n"), "en", "s", 1, "b"), (9003, own[0] + " one more", None, None, None, None),
             (9004, None, "en", "s", 1, "c"), (9005, "", "en", "s", 1, "d"), (9006, "", "en", "s", 1, "d"), (9006, "", "en", "s", 1, "d"),
             (None, "a null id", "en", "s", 1, "e"), (None, "a null id", "en", "s", 1, "e"), (9007, "stupid idiot scum, worthless pathetic loser", "en", "s", 1, "f"),
             (base[1].doc_id, own[1], "en", "s", 1, "g"), (9008, "same id", "en", "s", 1, "h"), (9008, "other text", "en", "s", 1, "h")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _sha string"
    both = docs.withColumn("_sha", F.lit("x")).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "_sha").unionByName(spark.createDataFrame(extra, schema))
    both = stage(both, "test-docs")
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = toxicity.score(both, toxicity.training_labels(labels))
    by_id = collections.defaultdict(set)
    for r in judged.collect():
        by_id[r.doc_id].add(r.score)
    score = {}
    for r in rows:
        score[r] = min(by_id[r[0]])
        assert len({s >= corpus_pipeline.THRESHOLD for s in by_id[r[0]]}) == 1
    got = [(r.doc_id, r.text) for r in left(spark, both).select("doc_id", "text").collect()]
    want = brute(rows, score)
    assert sorted(str((i, normal(t))) for i, t in got) == sorted(str((i, normal(t))) for i, t in want)
    assert {9001, 9002, 9003}.isdisjoint(i for i, _ in got)
    empty = both.limit(0)
    assert left(spark, empty).count() == 0 and corpus_pipeline.pack(spark, empty, SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    tokens = collections.Counter()
    for r in out:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in out) and len({r.sequence_id for r in out}) == len(out)


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_exact_top_k", "op9_near_dedup"])
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_every_operator_is_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(k.startswith(f"op{n}_") for k in known) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "packing"]


def test_contract_of_op5_and_op10(spark):
    out = queries.QUERIES["op5_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in out)
    out = queries.QUERIES["op10_lm_scoring"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in out)


def test_tasks_return_small_batches():
    """Packing, sketches and full sets were returned a whole Arrow batch of 10,000 rows at a time."""
    import public_tokenizers
    import pyarrow as pa

    from tidewarp.llm import near_dedup, packing

    run = []

    class Docs:
        columns = ["doc_id", "text"]
        sparkSession = None
        select = withColumn = lambda self, *a: self

        def mapInArrow(self, f, schema):
            run.append(f)
            return self

    near_dedup.sketches(Docs(), 5, 80, 100)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "prepare", lambda spark: None)
        m.setattr(packing, "F", MagicMock())
        packing.pack(Docs(), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([f"some words of text {i}" for i in range(5000)])], ["doc_id", "text"])
    for f in run:
        got = list(f(iter([batch])))
        ids = [i for b in got for i in b.column("doc_id").to_pylist()]
        assert list(dict.fromkeys(ids)) == list(range(5000))
        assert max(len(set(b.column("doc_id").to_pylist())) for b in got) <= 1024
