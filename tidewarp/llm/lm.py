"""Language-model scoring with a weighted backoff automaton of smoothed bigrams.

The automaton has a state for every word seen (the word just read) and a root. A state holds an arc for each word that
followed it in training, weighted with its interpolated log-probability, and a failure arc to the root, weighted with the
mass that absolute discounting sets free; the root holds the smoothed unigrams. A text is read once from left to right:
the state is the last word, each word takes its arc, or the failure arc and then the root's arc, and the weights add up.

  p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
  p(w | h) = (max(c(hw) - D, 0) + D n(h) p(w)) / c(h),   n(h): distinct words after h,   D = n1 / (n1 + 2 n2)

No table of counts is held whole anywhere. Documents are dealt into parts by hash; a part sends, for each slot of the word
hashes, its distinct words and word pairs with their counts, a slot task adds the parts' counts up and answers every
part in the order of its request, and a part scores its own documents with the slice of the automaton that its texts can
reach. What moves grows with the distinct pairs of each part, however often a hot text, word or passage occurs;
a part sends a slot nothing but pairs of its own, so its requests are never more than its distinct pairs.
The pairs after a word that alone would fill a good part of a slot are spread over as many slots as its tokens ask for, so
that a slot's size does not depend on the input's. At most ``HOT`` words are so; they and their counts are broadcast (16 MB).
Rows that repeat a doc_id and text travel once for each batch they occur in, with their number.

Words and pairs are known by hashes: words by 64 bits, a pair by the 64 bits of both its words.

Defined results: a null or empty text is the end token alone. Repeated rows count and score each on its own. A null
doc_id is not held out. With no training rows all probabilities are those of the formula with N = V = 0. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import power_of_two_at_least, prepare, stage
from tidewarp.llm.shingles import word_hashes

END = np.uint64(0x3C6EF372FE94F82B)  # the end token; it also stands before the first word
HOT = 1 << 20  # words whose pairs are spread, at most
SHARE = 4  # a word with over 1/SHARE of a slot's tokens is spread
PART_BYTES = 8 << 20  # text of a part, about
SLOT_TEXT = 16 << 20  # text whose pairs make up one slot, about
TASKS = 20_000  # partitions of a shuffle, at most; beyond it a task takes its parts or slots one after the other
ALPHA = 0.1
N_ONE, N_TWO = 1, 2  # keys of the counts of counts; words' hashes are far from them for certain: see _tokens
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_ids, folds: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i in doc_ids], bool)


def _tokens(texts: pa.Array):
    """(token hashes with an end after each text, tokens of each text)."""
    words, counts = word_hashes(texts)
    words = np.where(words < 16, words + np.uint64(16), words)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), counts + 1


def word_counts(docs: DataFrame, folds: int) -> DataFrame:
    """(w, c, every): each token with its occurrences in training texts and in all texts."""
    def run(batches):
        for b in batches:
            tokens, n = _tokens(b.column(1))
            train = np.repeat(~held_out(b.column(0).to_pylist(), folds), n)
            w, at, every = np.unique(tokens, return_inverse=True, return_counts=True)
            c = np.bincount(at, train, len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c), pa.array(every, pa.int64())], ["w", "c", "every"])

    return (docs.select("doc_id", "text").mapInArrow(run, "w long, c long, every long")
            .groupBy("w").agg(F.sum("c").alias("c"), F.sum("every").alias("every")))


class Slots(NamedTuple):
    """``n`` slots, a power of two; the pairs after ``hot[i]`` (sorted) lie in ``spread[i]`` slots from its home on."""

    n: int
    hot: np.ndarray
    spread: np.ndarray

    def of(self, words: np.ndarray):
        """(home slot, whether hot, slots spread over) of each word."""
        bits = self.n.bit_length() - 1
        home = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        is_hot = np.isin(words, self.hot)
        spread = np.ones(len(words), np.int64)
        spread[is_hot] = self.spread[np.searchsorted(self.hot, words[is_hot])]
        return home, is_hot, spread


def layout(counts: DataFrame, every: int, text_bytes: int) -> Slots:
    """Slots for texts of ``every`` tokens, from their ``word_counts``."""
    n = power_of_two_at_least(max(32, text_bytes / SLOT_TEXT))
    shares = min(SHARE * n, HOT)  # a word is hot with over 1/shares of the tokens, so fewer than that are
    rows = counts.where(F.col("every") > every / shares).select("w", "every").toArrow()
    words, own = rows.column("w").to_numpy().view(np.uint64), rows.column("every").to_numpy()
    order = np.argsort(words)
    spread = [min(n, power_of_two_at_least(int(e) * shares / every)) for e in own[order]]
    return Slots(n, words[order], np.array(spread, np.int64))


def _collapse(batches):
    """Equal rows (part, key, doc_id, text) of a batch as one row with their number; ``key`` only finds them."""
    for b in batches:
        key, first, at, copies = np.unique(b.column(1).to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        if len(key) < b.num_rows:
            same = np.ones(b.num_rows, bool)
            for c in (2, 3):
                own, other = b.column(c), b.column(c).take(pa.array(first[at]))
                equal = pc.or_kleene(pc.fill_null(pc.equal(own, other), False), pc.and_(own.is_null(), other.is_null()))
                same &= equal.to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(~same | (first[at] == np.arange(b.num_rows)))
            copies = np.where(same[keep], np.bincount(at[same], minlength=len(key))[at[keep]], 1)
            b = b.take(pa.array(keep))
        else:
            copies = np.ones(b.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(copies, pa.int64())], ["part", "doc_id", "text", "copies"])


class _Part:
    """What a part's texts need of the automaton, in an order that depends on the texts alone.

    ``words``: its distinct tokens. ``entries``: (slot, word) pairs, sorted; the pairs of an entry follow each other.
    """

    def __init__(self, docs: pa.Table, slots: Slots, folds: int):
        docs = docs.combine_chunks()
        texts = docs.column("text")
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
        self.doc_ids = docs.column("doc_id").to_pylist()
        self.tokens, self.n = _tokens(texts)
        self.held = held_out(self.doc_ids, folds)
        self.copies = docs.column("copies").to_numpy()
        train = np.repeat(~self.held * self.copies, self.n)
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        first = np.cumsum(self.n) - self.n
        self.first = first
        before = np.roll(self.word, 1)
        before[first] = np.searchsorted(self.words, END)
        self.before = before
        own = np.bincount(self.word, train, len(self.words)).astype(np.int64)
        home, self.is_hot, spread = slots.of(self.words)
        pair, at = np.unique((before.astype(np.uint64) << np.uint64(32)) | self.word.astype(np.uint64), return_inverse=True)
        pair_own = np.bincount(at, train, len(pair)).astype(np.int64)
        ctx, second = (pair >> np.uint64(32)).astype(np.int64), self.words[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        slot = (home[ctx] + ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * spread[ctx] >> 32)) & (slots.n - 1)
        entry = (slot << 32) | ctx
        homes = (home << 32) | np.arange(len(self.words))
        self.entries = np.unique(np.concatenate([entry, homes]))
        order = np.lexsort((second, entry))
        self.pair_at = np.empty(len(pair), np.int64)
        self.pair_at[order] = np.arange(len(pair))
        self.pair_at = self.pair_at[at]  # place of each token's pair in the order sent
        self.second, self.pair_own = second[order], pair_own[order]
        self.size = np.bincount(np.searchsorted(self.entries, entry), minlength=len(self.entries))
        self.entry_word = self.entries & 0xFFFFFFFF
        at_home = self.entries >> 32 == home[self.entry_word]
        self.entry_own = np.where(at_home, own[self.entry_word], 0)
        self.home_entry = np.searchsorted(self.entries, homes)
        self.entry_slot = self.entries >> 32


def _squeeze(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4").tobytes(), 1)


def _spread(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), "<u4").astype(np.int64)


REQUEST = "part int, slot int, heads binary, own binary, size binary, second binary, pair_own binary"
ANSWER = "part int, slot int, total binary, types binary, pair_total binary, key long, value long"


def _requests(docs: pa.Table, slots: Slots, folds: int) -> pa.Table:
    part = docs.column("part")[0].as_py()
    p = _Part(docs, slots, folds)
    starts = np.concatenate([[0], np.cumsum(p.size)])
    names, edge = np.unique(p.entry_slot, return_index=True)
    edge = np.append(edge, len(p.entries))
    rows = [(part, int(s), p.words[p.entry_word[a:b]].tobytes(), _squeeze(p.entry_own[a:b]), _squeeze(p.size[a:b]),
             p.second[starts[a]:starts[b]].astype("<u8").tobytes(), _squeeze(p.pair_own[starts[a]:starts[b]])) for s, a, b in zip(names, edge, edge[1:])]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in REQUEST.split(", ")])


def _answers(asked: pa.Table, hot: np.ndarray) -> pa.Table:
    """Counts over all parts of one slot, for each part in the order it asked; rows of part -1 carry the slot's counts
    of pairs seen once and twice and of the types after hot words."""
    heads = [np.frombuffer(x.as_py(), np.uint64) for x in asked.column("heads")]
    sizes = [_spread(x.as_py()) for x in asked.column("size")]
    second = [np.frombuffer(x.as_py(), "<u8") for x in asked.column("second")]
    words, at = np.unique(np.concatenate(heads), return_inverse=True)
    total = np.bincount(at, np.concatenate([_spread(x.as_py()) for x in asked.column("own")]), len(words)).astype(np.int64)
    ctx = np.repeat(at, np.concatenate(sizes)).astype(np.uint64)
    second_at = np.unique(np.concatenate(second), return_inverse=True)[1].astype(np.uint64)  # fewer than 2^32 in a slot
    pairs, pair_at = np.unique((ctx << np.uint64(32)) | second_at, return_inverse=True)
    pair_total = np.bincount(pair_at, np.concatenate([_spread(x.as_py()) for x in asked.column("pair_own")]), len(pairs)).astype(np.int64)
    seen = pair_total > 0
    types = np.bincount((pairs[seen] >> np.uint64(32)).astype(np.int64), minlength=len(words))
    rows, a, c = [], 0, 0
    for part, slot, h, s in zip(asked.column("part").to_pylist(), asked.column("slot").to_pylist(), heads, second):
        own, own_pairs = at[a:a + len(h)], pair_at[c:c + len(s)]
        rows.append((part, slot, _squeeze(total[own]), _squeeze(types[own]), _squeeze(pair_total[own_pairs]), None, None))
        a, c = a + len(h), c + len(s)
    told = [(N_ONE, int((pair_total == 1).sum())), (N_TWO, int((pair_total == 2).sum()))]
    spread = np.isin(words, hot) & (types > 0)
    told += list(zip(words[spread].view(np.int64).tolist(), types[spread].tolist()))
    rows += [(-1, rows[0][1], None, None, None, k, v) for k, v in told]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [f.split()[0] for f in ANSWER.split(", ")])


def _scores(docs: pa.Table, answers: pa.Table, slots: Slots, hot_types: np.ndarray, n: int, v: int, discount: float, folds: int) -> pa.Table:
    p = _Part(docs, slots, folds)
    answers = answers.combine_chunks().sort_by("slot")
    join = lambda name: np.concatenate([_spread(x.as_py()) for x in answers.column(name)])
    total, types, pair_total = join("total"), join("types"), join("pair_total")
    count, after = total[p.home_entry], types[p.home_entry]
    after[p.is_hot] = hot_types[np.searchsorted(slots.hot, p.words[p.is_hot])]
    base = (count + ALPHA) / (n + ALPHA * (v + 1))
    c_word, c_state, c_pair, p_word = count[p.word], count[p.before], pair_total[p.pair_at], base[p.word]
    state = np.maximum(c_state, 1)
    arc = (np.maximum(c_pair - discount, 0) + discount * after[p.before] * p_word) / state  # also failure arc, then root's arc
    weight = np.log10(np.where(c_state > 0, arc, p_word))
    add = lambda x: np.add.reduceat(x, p.first)
    return pa.Table.from_arrays(
        [pa.array(p.doc_ids, pa.int64()), pa.array(p.held), pa.array(p.n, pa.int64()), pa.array(add((c_word > 0).astype(np.int64))),
         pa.array(np.full(len(p.n), n), pa.int64()), pa.array(add(np.log10(p_word))), pa.array(add(weight)), pa.array(p.copies)], [*[f.split()[0] for f in OUT.split(", ")], "copies"])


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learning from those whose crc32(doc_id as text) mod ``folds`` is
    not 0: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stage(word_counts(docs, folds), "lm-words")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    n, every, v = counts.agg(total("c"), total("every"), total(F.when(F.col("c") > 0, 1))).first()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = layout(counts, every, size)
    sent = spark.sparkContext.broadcast(slots)  # HOT words at most
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    key = F.xxhash64("doc_id", "text")
    dealt = (docs.select(F.pmod(key, F.lit(parts)).cast("int").alias("part"), key.alias("key"), "doc_id", "text")
             .mapInArrow(_collapse, "part int, doc_id long, text string, copies long").repartition(min(parts, TASKS), "part"))
    requests = dealt.groupBy("part").applyInArrow(lambda t: _requests(t, sent.value, folds), REQUEST)
    # a partition for every slot and more, so that a task holds few of them at any size of the input
    answers = stage(requests.repartition(min(2 * slots.n, TASKS), "slot").groupBy("slot").applyInArrow(lambda t: _answers(t, sent.value.hot), ANSWER), "lm-answers")
    told = answers.where("part < 0").groupBy("key").agg(F.sum("value").alias("value")).toArrow()  # HOT + 2 rows at most
    keys, values = told.column("key").to_numpy(), told.column("value").to_numpy()
    once, twice = (int(values[keys == k].sum()) for k in (N_ONE, N_TWO))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    hot_types = np.zeros(len(slots.hot), np.int64)
    of_word = ~np.isin(keys, (N_ONE, N_TWO))
    hot_types[np.searchsorted(slots.hot, keys[of_word].view(np.uint64))] = values[of_word]
    types = spark.sparkContext.broadcast(hot_types)
    scored = (dealt.groupBy("part").cogroup(answers.where("part >= 0").repartition(min(parts, TASKS), "part").groupBy("part"))
              .applyInArrow(lambda d, a: _scores(d, a, sent.value, types.value, n, v, discount, folds), OUT + ", copies long"))
    return scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "_copy")
