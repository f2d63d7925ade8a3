"""Phrase collocation mining by set-oriented relations (SETM).

A text is split into pieces at marks and line ends, a piece into words. The relation of occurrences R1(piece, position, word), sorted
by piece and position, is persisted. For each length k a merge join of the sorted relation with itself on the piece and the next position
gives the occurrences of k words, which are counted by group; the occurrences of groups under the support leave by a semi-join, and
what is left, sorted as it was, is persisted as R_k. A phrase cannot be more frequent than its parts, so no other occurrence can
make a frequent phrase of k + 1 words, and all parts of a frequent phrase are counted.

Where the work is: a row of a persisted relation is a block, all occurrences that begin in BLOCK consecutive words of a run of texts, with
the few words that follow, which extend phrases but begin none; its columns are packed numbers. Blocks are never cut by a file split, so the
merge join needs no shuffle however long a piece is. Only counts shuffle, one of a group for up to CHUNK occurrences of a task, packed by
slots of the group hashes that grow in number with the relation: a word or passage that occurs everywhere costs one count a chunk, and a slot
holds a bounded share. The semi-join probes a bitmap of the frequent groups that is sent to the tasks (at most
``MOST_BITS``, by the number of groups); it may let a rare group through, which then fails its own count of the next length, so the
bitmap changes what is stored and never a result.

Words and phrases are per language; a word goes by 64 bits of its bytes and its language, a phrase by those of its beginning and of its last word.
Words are counted by their text, so what is reported has its own text.

Defined results: a null text is empty and has no word; a null language is ``und``. Words and pieces of any length are taken whole.
Repeated rows count each. Ties in a score go to the more frequent phrase, then to the phrase first in byte order; ties between cuts of a
phrase to the earlier one. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarp.llm.common import power_of_two_at_least, prepare, stage
from tidewarp.llm.shingles import SEGMENT, _segment_words, mix

UNKNOWN = "und"
MARKS = b".,;:!?\n\x0b\x0c\r"  # end a piece; words end there and at space and tab
BLOCK = 64  # words whose occurrences are one row; 10,000 rows, an Arrow batch, have 13 MB
CHUNK = 1 << 19  # groups added up at a time
MOST_BITS = 1 << 29  # of the bitmap of frequent groups: 64 MB
BITMAP_BITS = 32768  # of the bitmaps of bitmap_construct_agg
SLICE = 2048  # rows of a persisted relation joined and grouped at a time
SLOT_WORDS = 1 << 19  # words whose groups make up one slot, about

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_STOP = _MARK.copy()
_STOP[[0x20, 9]] = True
_AS_SPACE = np.where(_STOP, 0x20, np.arange(256)).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _seeds(langs: list) -> np.ndarray:
    known = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    return np.array([known[lang] for lang in langs], np.uint64)


def _join_ids(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The id of the phrase that ``word`` makes of the phrase ``head``."""
    return mix(head * _LEFT + word * _RIGHT)


def _runs(batch: pa.RecordBatch):
    """(langs, data, ends) of runs of the rows of a batch (lang, text): some megabytes of text, or one longer text."""
    texts = batch.column("text").cast(pa.large_string())
    langs = [UNKNOWN if v is None else v for v in batch.column("lang").to_pylist()]
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1)
        lo, hi = int(ends[at]), int(ends[to])
        if hi > lo:
            yield langs[at:to], np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo), ends[at:to + 1] - lo
        at = to


def _words(data: np.ndarray, ends: np.ndarray):
    """(hash, start, text number, piece number) of the words of a run; the hashes are taken a segment at a time."""
    stop = _STOP[data]
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + SEGMENT, len(data))
        while to < len(data) and not stop[to] and not stop[to - 1]:  # no cut within a word
            ahead = stop[to:to + SEGMENT]
            to = to + int(ahead.argmax()) if ahead.any() else min(to + SEGMENT, len(data))
        inside = ends[(ends >= at) & (ends < to)] - at
        h, s = _segment_words(_AS_SPACE[data[at:to]], inside)
        hashes.append(h)
        starts.append(s + at)
        at = to
    start = np.concatenate(starts)
    marks = np.flatnonzero(_MARK[data])
    text = np.searchsorted(ends, start, "right") - 1
    return np.concatenate(hashes), start, text, text + np.searchsorted(marks, start)


def _strings(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, text: np.ndarray) -> pa.Array:
    """The folded words that begin at ``starts``, each ending within its text."""
    stops = np.append(np.flatnonzero(_STOP[data]), len(data))
    sizes = np.minimum(stops[np.searchsorted(stops, starts)], ends[text + 1]) - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_FOLD[data[at]]))


def _runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the order that sorts ``ids``, and which of the sorted ids differ from the one before."""
    order = np.argsort(ids)
    ids = ids[order]
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    return order, new


def _add_up(rows: list[tuple]) -> tuple:
    """(langs, w, words, counts) with equal words added up. Empties ``rows``."""
    langs, words = (pa.concat_arrays([r[i] for r in rows]) for i in (0, 2))
    w, count = (np.concatenate([r[i] for r in rows]) for i in (1, 3))
    rows.clear()
    order, new = _runs_of(w)
    again = np.flatnonzero(~new)
    mine, before = pa.array(order[again]), pa.array(order[again - 1])
    if not all(pc.all(pc.equal(c.take(mine), c.take(before)), min_count=0).as_py() for c in (langs, words)):  # two words with one id
        t = pa.table([langs, pa.array(w.view(np.int64)), words, pa.array(count)], ["lang", "w", "word", "c"]).group_by(["lang", "w", "word"]).aggregate([("c", "sum")]).combine_chunks()
        return t.column("lang").combine_chunks(), t.column("w").to_numpy().view(np.uint64), t.column("word").combine_chunks(), t.column("c_sum").to_numpy()
    first = np.flatnonzero(new)
    count = np.add.reduceat(count[order], first)
    first = order[first]
    return langs.take(first), w[first], words.take(first), count.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w, word, c): occurrences of each word; the row with a null word has all occurrences of its language."""
    names = ["lang", "w", "word", "c"]

    def batch(rows):
        langs, w, words, count = rows
        return pa.RecordBatch.from_arrays([langs, pa.array(w.view(np.int64)), words.cast(pa.string()), pa.array(count)], names)

    def run(batches):
        held, rows, totals = [], 0, {}
        for b in batches:
            for langs, data, ends in _runs(b):
                h, start, text, _ = _words(data, ends)
                w, first, count = np.unique(mix(h ^ _seeds(langs)[text]), return_index=True, return_counts=True)
                for lang, n in zip(langs, np.bincount(text, minlength=len(langs))):
                    totals[lang] = totals.get(lang, 0) + int(n)
                held.append((pa.array(langs, pa.string()).take(text[first]), w, _strings(data, ends, start[first], text[first]), count))
                rows += len(w)
                if rows > CHUNK:
                    held = [_add_up(held)]
                    rows = len(held[0][1])
                    if rows > CHUNK * 3 // 4:
                        yield batch(held[0])
                        held, rows = [], 0
        if held:
            yield batch(_add_up(held))
        known = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array([0] * len(known), pa.int64()), pa.nulls(len(known), pa.string()),
                                          pa.array([totals[k] for k in known], pa.int64())], names)

    return docs.select("lang", "text").mapInArrow(run, "lang string, w long, word string, c long").groupBy("lang", "w", "word").agg(F.sum("c").alias("c"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each of ``ids`` (id) set; its parts are made on the executors."""
    bits = min(MOST_BITS, max(BITMAP_BITS, power_of_two_at_least(64 * ids.count())))
    slot = F.col("id").bitwiseAND(F.lit(bits - 1).cast("long"))
    parts = ids.select((slot / BITMAP_BITS).cast("long").alias("bucket"), (slot % BITMAP_BITS).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for bucket, part in parts.toLocalIterator():
        out[bucket] = np.frombuffer(part, np.uint8)
    return out.reshape(-1)


def _has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


RELATION = "piece binary, pos binary, head binary, word binary"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``values``."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, numbers of each row) of a column of packed numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    if ends[-1] == ends[0]:
        return np.empty(0, kind), np.zeros(len(column), int)
    raw = np.frombuffer(column.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0]))
    return raw.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _blocks(row: np.ndarray, piece: np.ndarray, pos: np.ndarray, head: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Rows of a relation: the blocks that hold an occurrence. Pieces are numbered within a block, positions counted from its start."""
    new = np.concatenate([[True], row[1:] != row[:-1]])
    first = np.flatnonzero(new)
    ends = np.append(first, len(row))
    turn = np.cumsum(np.concatenate([[0], (piece[1:] != piece[:-1]) | new[1:]]))
    piece = turn - np.repeat(turn[first], np.diff(ends))
    return pa.RecordBatch.from_arrays([_packed(piece.astype("<u2"), ends), _packed(pos.astype("<u2"), ends), _packed(head, ends), _packed(word, ends)], ["piece", "pos", "head", "word"])


def occurrences(docs: DataFrame, frequent: np.ndarray, longest: int) -> DataFrame:
    """The occurrences of the words in ``frequent``, sorted by piece and position, with ``longest`` - 1 words after each block.
    A phrase of one word is its own head."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for b in batches:
            for langs, data, ends in _runs(b):
                h, _, text, piece = _words(data, ends)
                w = mix(h ^ _seeds(langs)[text])
                at = np.flatnonzero(_has(sent.value, w))
                block = at // BLOCK
                # the first words of a block also follow the block before
                early = np.flatnonzero((at % BLOCK < longest - 1) & (block > 0))
                row, at = np.concatenate([block, block[early] - 1]), np.concatenate([at, at[early]])
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                if len(at):
                    yield _blocks(row, piece[at], at - row * BLOCK, w[at], w[at])

    return docs.select("lang", "text").mapInArrow(run, RELATION)


def _extended(b: pa.RecordBatch):
    """The merge join of a sorted relation with itself on piece and next position: (row, piece, pos, head, word) of the
    occurrences one word longer. The partner of an occurrence can only be the next one of its block."""
    piece, sizes = _unpacked(b.column("piece"), "<u2")
    pos, head, word = (_unpacked(b.column(c), kind)[0] for c, kind in (("pos", "<u2"), ("head", "<u8"), ("word", "<u8")))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]) & (pos[1:] == pos[:-1] + 1))
    return row[at], piece[at], pos[at], head[at], word[at + 1]


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    """The columns of ``parts`` put together; empties ``parts``, so they are not held twice while grouped."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    parts.clear()
    return columns


def _group(head: np.ndarray, word: np.ndarray, count: np.ndarray):
    """(head, word, count) with equal groups added up."""
    order, new = _runs_of(_join_ids(head, word))
    differs = lambda: (head[order][1:] != head[order][:-1]) | (word[order][1:] != word[order][:-1])
    if (differs() & ~new[1:]).any():  # two groups with one id
        order = np.lexsort((word, head))
        new[1:] = differs()
    first = np.flatnonzero(new)
    count = np.add.reduceat(count[order], first)
    first = order[first]
    return head[first], word[first], count.astype(np.int64)


def group_counts(relation: DataFrame, support: int) -> DataFrame:
    """(id, head, word, f) of the groups one word longer than those of ``relation`` that occur ``support`` times or more; staged."""
    slots = power_of_two_at_least(max(32, relation.count() * BLOCK / SLOT_WORDS))
    bits = slots.bit_length() - 1

    def run(batches):
        held, rows = [], 0

        def emit(head, word, count):
            slot = (_join_ids(head, word) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order], return_index=True)
            ends = np.append(first, len(order))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), _packed(head[order], ends), _packed(word[order], ends), _packed(count[order].astype("<u4"), ends)],
                                              ["slot", "head", "word", "c"])

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                _, _, pos, head, word = _extended(b.slice(i, SLICE))
                mine = pos < BLOCK
                held.append(_group(head[mine], word[mine], np.ones(int(mine.sum()), np.int64)))
                rows += len(held[-1][0])
                if rows > CHUNK:
                    held = [_group(*_joined(held))]
                    rows = len(held[0][0])
                    if rows > CHUNK * 3 // 4:
                        yield emit(*held[0])
                        held, rows = [], 0
        if rows:
            yield emit(*_group(*_joined(held)))

    def add_up(t: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in t.column(c)]) for c, kind in (("head", "<u8"), ("word", "<u8"), ("c", "<u4"))]
        head, word, f = _group(*parts)
        keep = f >= support
        head, word, f = head[keep], word[keep], f[keep]
        return pa.table([pa.array(v.view(np.int64)) for v in (_join_ids(head, word), head, word, f)], ["id", "head", "word", "f"])

    counts = relation.select("piece", "pos", "head", "word").mapInArrow(run, "slot int, head binary, word binary, c binary")
    return stage(counts.groupBy("slot").applyInArrow(add_up, "id long, head long, word long, f long"), "setm-groups")


def extend(relation: DataFrame, groups: DataFrame) -> DataFrame:
    """The next relation: the occurrences one word longer whose group is among ``groups`` (id)."""
    sent = relation.sparkSession.sparkContext.broadcast(_bitmap(groups.select("id")))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                row, piece, pos, head, word = _extended(b.slice(i, SLICE))
                ids = _join_ids(head, word)
                keep = _has(sent.value, ids)
                if keep.any():
                    yield _blocks(row[keep], piece[keep], pos[keep], ids[keep], word[keep])

    return relation.mapInArrow(run, RELATION)


def frequent_phrases(docs: DataFrame, longest: int = 4, support: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of all phrases of 1 to ``longest`` words that occur ``support`` times or more, (lang, n) of the
    languages), staged."""
    prepare(docs.sparkSession)
    counts = stage(word_counts(docs).where((F.col("c") >= support) | F.col("word").isNull()), "setm-words")
    totals = counts.where("word is null").groupBy("lang").agg(F.sum("c").alias("n"))
    words = counts.where("word is not null").select(F.col("w").alias("id"), "lang", F.col("word").alias("phrase"), F.col("c").alias("f"))
    last = words.select(F.col("id").alias("word"), F.col("phrase").alias("end"))
    relation = stage(occurrences(docs, _bitmap(words.select("id")), longest), "setm-r1")
    found, phrases = [words.select("lang", "phrase", F.lit(1).alias("m"), "f")], words
    for m in range(2, longest + 1):
        groups = group_counts(relation, support)
        heads = phrases.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("begin"))
        phrases = stage(groups.join(heads, "head").join(last, "word").select("id", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "f"), "setm-phrases")
        found.append(phrases.select("lang", "phrase", F.lit(m).alias("m"), "f"))
        if m < longest:
            relation = stage(extend(relation, groups), f"setm-r{m}")
    return reduce(DataFrame.unionByName, found), totals


def mine(docs: DataFrame, longest: int = 4, support: int = 30, cover: int = 80, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language of ``docs`` (lang, text) the ``first`` phrases of 2 to ``longest``
    words by score, without those that a longer phrase with ``cover`` percent of their occurrences contains."""
    phrases, totals = frequent_phrases(docs, longest, support)
    words = F.split("phrase", " ", -1)
    many = phrases.where("m > 1").withColumn("words", words)

    # the lowest-scoring cut: both parts are frequent, so both are known
    cut = many.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
                     F.array_join(F.slice("words", F.col("k") + 1, longest), " ").alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    cut = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # phrases inside longer ones
    parts = F.expr("flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    inside = (many.where("m > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(parts)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    covered = F.expr(f"cast(100 as decimal(20,0)) * longer >= cast({cover} as decimal(20,0)) * a")
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    # first within 64 leaves of a language, so its last task reads at most 64 x `first` rows
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    leaves = left.withColumn("leaf", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "leaf").orderBy(*best))).where(F.col("rank") <= first)
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(longest: int = 4, support: int = 30, cover: int = 80, first: int = 2000) -> str:
    """``mine`` over ``documents`` as DuckDB SQL."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, m.m, unnest(range(1, len(w) - m.m + 2)) AS i FROM w, (SELECT unnest(range(1, {longest + 1})) AS m) m WHERE len(w) >= m.m),
f AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {support}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f, m, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, f, string_split(phrase, ' ') AS ws, m, unnest(range(2, m)) AS z FROM f WHERE m > 2),
v AS (SELECT lang, f, ws, z, unnest(range(1, m - z + 2)) AS i FROM u),
o AS (SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, max(f) AS longer FROM v GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {cover}::HUGEINT * a),
t AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT t.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= {first}"""
