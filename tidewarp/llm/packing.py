"""Sequence packing by power-of-two decomposition.

A document of L tokens (its ids and a closing id) is cut into pieces of binary lengths: as many of ``max_len`` as fit,
then one piece for each set bit of what remains, largest first. Every piece is a training sequence of its own, so no
sequence crosses documents and none needs padding: sequences of equal length form a bucket and batch together.

Cutting is a narrow, map-only step: no shuffle, no group, whatever the size of a document or the skew of a source.

Defined results: a null text is empty (one piece: the closing id); a text of any length is cut whole, also one of white space alone; repeated rows and rows with a null doc_id are each
packed on their own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.bpe import PRE_TOKENS
from tidewarp.llm.common import prepare, sliced

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: a run of white space that tiktoken's regular expressions may not end on
LONG_RUN = re.compile(r"\s{4096}")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to uint32 ids: the vocabulary of a tokenizers JSON file, run by tiktoken (the same ids as
    the tokenizers library gives, in a third of its time). A text with a long run of white space goes through the codec of ``bpe``,
    which gives the same ids and needs no backtracking."""
    import json

    import tiktoken

    from tidewarp.llm.bpe import _byte_alphabet, codec

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    made = tiktoken.Encoding("packing", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            return np.array(codec(path).encode(text), "<u4")
        return made.encode_to_numpy(text, allowed_special="all").astype("<u4")

    return encode


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Binary decomposition of n: pieces of max_len (a power of two), then the set bits of the rest, largest first."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, max_len: int = 1024, closing_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id,
    offset, bucket. ``length`` is a power of two up to ``max_len`` and ``bucket`` its logarithm."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    prepare(docs.sparkSession)

    def run(batches):
        encode = encoder(tokenizer)
        for b in sliced(batches):
            ids_of = b.column(0).to_pylist()
            col: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "crc", "tokens")}
            kept: list[np.ndarray] = []
            for doc_id, text in zip(ids_of, b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(closing_id)).astype("<u4")
                at = 0
                for n in piece_lengths(len(ids), max_len):
                    piece = ids[at:at + n]
                    col["doc_id"].append(doc_id)
                    col["start"].append(at)
                    col["length"].append(n)
                    col["crc"].append(zlib.crc32(piece))
                    col["tokens"].append(len(ids))
                    if with_ids:
                        kept.append(piece)
                    at += n
            arrays = [pa.array(v, pa.int64()) for v in col.values()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)])
                flat = np.concatenate(kept).view("<i4") if kept else np.empty(0, "<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    pieces = docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
    # a piece is a sequence, so any unique number names it; the scan deals rows the same way when a task is retried
    return (pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", F.round(F.log2("length")).cast("int")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, so a reader takes batches of equal lengths without any padding."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)
