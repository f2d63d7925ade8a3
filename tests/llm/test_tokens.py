"""Byte-pair codec and packing against the tokenizers library."""
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewarp.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens int, start string"


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def ids_of(theirs, text):
    return theirs.encode(text or "", add_special_tokens=False).ids


ROWS = [(1, "Hello world, it's 12 o'clock\n\n  done", "x", 0, "y"), (2, None, None, None, None), (3, "", "", 1, ""), (None, "a b", "x", 0, "y"),
        (1, "Hello world, it's 12 o'clock\n\n  done", "x", 0, "y"), (5, "<|endoftext|>x <|endoftext|>", "", 0, ""), (6, "ab " * 30000 + "é字😀" * 500, "", 0, ""),
        (7, "z" * 20000, "", 0, "")]


def test_codec_equals_library(theirs):
    rng = random.Random(5)
    own = bpe.codec(PATH)
    alphabet = "ab cAé\n\t ''sre..12é한字😀  \x00 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["aa" * 3000, " " * 3000, "the" * 2000, "=" * 999, "<|endoftext|>" * 3, "a<|endoftext|"]
    got = own.encode_all(texts)
    for text, ids in zip(texts, got):
        want = ids_of(theirs, text)
        assert ids == struct.pack(f"<{len(want)}I", *want), repr(text[:60])
        assert own.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_memo_turns_over(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(bpe, "CHUNK", 300)
    own = bpe.Codec(PATH)
    texts = [f"word{i % 90} and other{i * 7 % 130} things" for i in range(300)]
    assert [own.encode(t) for t in texts] == [ids_of(theirs, t) for t in texts]
    assert len(own.memo) <= 200


def test_round_trip_edges(spark, theirs):
    got = bpe.round_trip(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    assert len(got) == len(ROWS)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = ids_of(theirs, text)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_encode_decode_frames(spark, theirs):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    encoded = bpe.encode(docs, PATH)
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(r[0], tuple(ids_of(theirs, r[1]))) for r in ROWS}
    assert sorted(str(r.text) for r in bpe.decode(encoded, PATH).collect()) == sorted(str(r[1] or "") for r in ROWS)


def test_packing(spark, theirs):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack(docs, PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = {}
    for r in rows:
        assert r.length == len(r.ids) == 1 << r.bucket and r.length <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for doc_id, text, *_ in ROWS:
        want = [*ids_of(theirs, text), 0]
        own = sorted(pieces[doc_id, len(want)])
        copies = sum(1 for x in ROWS if x[:2] == (doc_id, text))
        flat = [i for k, (_, ids) in enumerate(own) if k % copies == 0 for i in ids]
        assert flat == want
        assert len(own) == copies * len(packing.piece_lengths(len(want), 1024))
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_piece_lengths():
    for n in [1, 2, 3, 1023, 1024, 1025, 5000]:
        lengths = packing.piece_lengths(n, 1024)
        assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths)
        rest = [x for x in lengths if x < 1024]
        assert len(rest) == len(set(rest))
    with pytest.raises(ValueError):
        packing.pack(None, PATH, max_len=1000)


def test_whole_table(spark, theirs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: ids_of(theirs, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    assert {k: (r.n_tokens, r.ids_sha256) for k, r in got.items()} == {k: (len(v), hashlib.sha256(struct.pack(f"<{len(v)}I", *v)).hexdigest()) for k, v in want.items()}
    totals = {r.doc_id: r.n for r in packing.pack(docs, PATH, with_ids=False).groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert totals == {k: len(v) + 1 for k, v in want.items()}


def test_long_runs_of_white_space_pack_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    texts = [" " * 2_000_000 + "a", "x" + "\n" * 300_000, "\t \u00a0" * 50_000 + "b c", " " * 4095 + "a", " " * 4096 + "a", "a" + " " * 5000]
    encode = packing.encoder(path)
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in packing.pack(docs, path, with_ids=False).groupBy("doc_id").agg({"length": "sum"}).collect():
        assert r[1] == len(encode(texts[r.doc_id])) + 1
