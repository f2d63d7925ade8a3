"""Exact deduplication by two passes and a Bloom filter of possibly repeated hashes. DataFrame functions only.

The texts are read once: their normalised form is hashed and (doc_id, hash) is written to the shared folder; all
later steps read those few bytes a row.

Pass 1 counts, in a filter of m slots with two hash functions, how many rows hit each slot, pre-aggregated before the
shuffle, and keeps the slots hit at least twice as 4 KB bitmaps. Pass 2 probes every row: a hash that repeats finds both
its slots set, so a row with an unset slot is alone and passes straight through. Only the other rows shuffle and are
compared by their 256-bit hash. m follows the number of rows up to ``max_filter_bits`` (32 MB by default, which bounds
the broadcast); a fuller filter lets more rows through to the exact step and never changes a result. With n rows of their
own an unrepeated row gets through with probability (1 - exp(-2 n / m))^2: 1 in 90 at 15 million rows, 1 in 10 at 50 million,
nearly all beyond 500 million.

A group may hold a third of all rows: it is one row after partial aggregation, and the join that hands its keep_id back
has plain exchanges on both sides, which adaptive execution splits.

Defined results: null counts as the empty text, equal to other empty or null texts; of equal texts the smallest doc_id
stays, null ids last, and of repeated rows of that doc_id exactly one; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import SPACES, power_of_two_at_least, prepare, stage

BITMAP_BITS = 32768  # of the bitmaps of bitmap_construct_agg


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, sha binary, row) of every document, staged; ``row`` tells repeated rows apart."""
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return stage(docs.select("doc_id", "text").select("doc_id", sha.alias("sha")).withColumn("row", F.monotonically_increasing_id()), "dedup-keys")


def _slot(seed: int, m: int) -> Column:
    return F.xxhash64(F.col("sha"), F.lit(seed)).bitwiseAND(F.lit(m - 1).cast("long"))


def repeated_slots(keyed: DataFrame, m: int) -> DataFrame:
    """The filter: (bucket, bits) bitmaps of the slots that at least two rows hit; at most m / 8 bytes."""
    hits = keyed.select(F.explode(F.array(_slot(1, m), _slot(2, m))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return (hits.where("n > 1")
            .groupBy((F.col("slot") / BITMAP_BITS).cast("long").alias("bucket"))
            .agg(F.bitmap_construct_agg((F.col("slot") % BITMAP_BITS)).alias("bits")))


def _probe(keyed: DataFrame, bitmaps: DataFrame, m: int, seed: int) -> DataFrame:
    """Adds the flag hit<seed>: whether the row's slot is set."""
    slot, at = _slot(seed, m), F.col("_at")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (keyed.withColumn("_at", slot % BITMAP_BITS).withColumn("_bucket", (slot / BITMAP_BITS).cast("long"))
            .join(F.broadcast(bitmaps.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
            .withColumn(f"hit{seed}", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False)))
            .drop("_at", "_bucket", "bits"))


def groups(docs: DataFrame, bits_per_row: int = 32, max_filter_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, row, sha, keep_id, group_size, kept) for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    keyed = keys(docs)
    m = min(max_filter_bits, max(1 << 16, power_of_two_at_least(bits_per_row * keyed.count())))
    bitmaps = repeated_slots(keyed, m)
    probed = _probe(_probe(keyed, bitmaps, m, 1), bitmaps, m, 2).withColumn("maybe", F.expr("hit1 and hit2")).drop("hit1", "hit2")
    alone = probed.where("not maybe").select("doc_id", "row", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = probed.where("maybe").drop("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    found = stage(maybe.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n"), "dedup-groups")
    checked = maybe.join(found, "sha", "left").select(
        "doc_id", "row", "sha", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"))
    return alone.unionByName(checked)


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    return groups(docs, **how).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
