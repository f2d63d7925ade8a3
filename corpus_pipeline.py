"""Corpus pipeline over ``documents``: toxicity, exact deduplication, near-duplicate classes, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written as
Parquet and read back as the next one's docs. All but the last return the columns of documents.

Rows with a null doc_id or text, empty texts and repeated rows go through all stages: a null text is empty, an empty text is clean,
and of repeated rows exactly one is left by the exact deduplication.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm import exact_dedup, near_dedup, packing, toxicity
from tidewarp.llm.common import prepare, sliced, stage, table
from tidewarp.llm.queries import tokenizer

#: words of a shingle and similarity of the near-duplicate stage
WORDS, SIMILARITY = 5, (80, 100)
THRESHOLD = 0.7
MAX_LEN = 1024
#: rows whose ids are sent to the tasks rather than joined
SENT_ROWS = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns as that of op5, from the labels outside its held-out fold."""
    prepare(spark)
    judge = toxicity.scorer(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches):
        value = judge()
        for b in sliced(batches):
            yield b.filter(pa.array([value(t.as_py()) < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(exact_dedup.normalised(text), 256))


def _left(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``decided`` (doc_id, sha, stays), which has a row for each of them.

    Rows are told by doc_id and the hash of their text. The keys of rows that go, the smaller part, leave by an anti join:
    sent to the tasks up to SENT_ROWS, else joined. Rows that repeat a key of which one stays are reduced apart.
    """
    keys = stage(decided.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stays").cast("int")).alias("kept")).where("n > kept"), "pipe-keys")
    marked = docs.select(F.struct("*").alias("d")).withColumn("_sha", _sha(F.col("d.text")))

    def by_key(found: DataFrame, how: str) -> DataFrame:
        found = found.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_key"))
        return marked.join(F.broadcast(found) if found.count() <= SENT_ROWS else found,
                           F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_key")), how)

    out = by_key(keys, "left_anti").select("d.*")
    repeated = keys.where("kept > 0")
    if not repeated.isEmpty():
        out = out.unionAll(by_key(repeated, "left_semi").withColumn("_id", F.col("d.doc_id")).dropDuplicates(["_id", "_sha"]).select("d.*"))
    return out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _left(docs, exact_dedup.groups(docs).select("doc_id", "sha", F.col("kept").alias("stays")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; documents without words all stay."""
    keyed = docs.select("doc_id", "text", _sha(F.col("text")).alias("key"))
    return _left(docs, near_dedup.classes_of(keyed, WORDS, SIMILARITY).select("doc_id", F.col("key").alias("sha"), F.col("first").alias("stays")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of every document left."""
    packed = packing.pack(docs, tokenizer(), max_len=MAX_LEN, closing_id=0, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: a learned score and byte-pair ids have no SQL; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        docs = stage(out, f"pipeline-{i}") if i < len(STAGES) - 1 else out
    return docs
