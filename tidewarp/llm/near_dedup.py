"""Near-duplicate classes by bottom-k sketches of one hash function.

Every shingle is hashed once; a document's sketch is its smallest hash values. Inverted lists of retained values give
the documents that overlap, the bottom-k sketch of the union of two documents estimates their similarity and filters,
and the exact Jaccard similarity of the full sets confirms every link.

k follows the size of a set: a document posts its smallest ``n - ceil(t n) + 1`` values. Two sets of similarity t or more
then share a posted value for certain (any one order of all values serves), so the lists lose no link. Work is kept
linear in three ways:

* Documents with equal sets are one class from the start, so copies never meet in a list. A class goes by 64 bits of
  its 128-bit signature.
* A value on the lists of more than ``HOT`` classes (a line or passage that many texts share) moves to the end of the
  order, and a document posts its next values instead; where the values stored do not reach, its whole set is read.
  A group of near copies thus has each member's own values first and the common ones last.
* A list pairs two members only if the values after the posted one could still make up the similarity; the list of the
  first value that two similar sets share always can.
* A list first links its members to one centre, the one with the fewest values before. Only members whose components still
  differ after that are paired.

Lists are joined, never collected; the join that meets a hot list has plain exchanges on both sides, which adaptive
execution splits. Components come from rounds of minimum labels with pointer jumping on staged tables.

Defined results: null and empty texts and texts of white space have an empty set, size 0, and are linked with nothing.
Repeated rows are equal documents. component_id is the smallest non-null doc_id of the class, null if there is none; a
row with a null doc_id stays only if its component has no id. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, sliced, stage
from tidewarp.llm.shingles import mix, shingle_sets

HOT = 16  # classes on a list before its value counts as hot
MOST_HOT = 1 << 20  # hot values held by a task (8 MB); HOT doubles until they fit, which never changes a result
STORED = 128  # values stored of any set, so short documents are stored whole
SKETCH = 64  # values of the sketch that estimates; their upper 32 bits keep the order
BROADCAST_ROWS = 1 << 20
TASK_ROWS = 1 << 16  # rows behind a task of a grouped table
LEAST_TASKS = 16
MANY = 1000  # a set of more than a MANY-th of all rows is not joined by its signature
FILTER_BITS = 1 << 27  # of the filter of values that may be on several lists (16 MB); a fuller one lets more postings through
BITMAP_BITS = 32768  # of the bitmaps of bitmap_construct_agg


def posted(n: int, num: int, den: int) -> int:
    """Values that a set of n elements posts for a similarity of num / den."""
    return n - -(-num * n // den) + 1


def _signature(values: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a, b = mix(values + np.uint64(1)), mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=np.uint64), mix(b).sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, sig, low): size, signature and smallest values, in order, of each document's set. A column ``key`` of ``docs``
    comes along."""
    key = ["key"] * ("key" in docs.columns)

    def run(batches):
        for b in sliced(batches):
            n, sig, least = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                sig.append(_signature(s) if len(s) else None)
                least.append(s[:max(STORED, 2 * posted(len(s), num, den))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(least, pa.binary()), *b.columns[2:]],
                                             ["doc_id", "n", "sig", "low", *key])

    return docs.select("doc_id", "text", *key).mapInArrow(run, "doc_id long, n long, sig binary, low binary" + ", key binary" * len(key))


def _tasks(rows: int) -> int:
    return max(LEAST_TASKS, rows // TASK_ROWS)


def _stage_few(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df``, grouped from about ``rows`` rows, staged by as many tasks as these ask for: where a shuffle has far more partitions than that, each
    of them does not become a task and a file."""
    return stage(df.coalesce(_tasks(rows)), name)


def _by_signature(rows: DataFrame, by_set: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_set`` (sig, copies, ...) on sig. A set that more than one row in MANY has is sent to the tasks, so a large
    group of copies loads no task; at most MANY sets are so. The others are joined."""
    many = F.col("copies") * MANY > total
    hot = stage(by_set.where(many).drop("copies"), "near-hot-sets")
    out = rows.join(F.broadcast(hot), "sig")
    rest = rows.join(F.broadcast(hot.select("sig")), "sig", "left_anti")
    return out.unionByName(rest.join(by_set.where(~many).drop("copies"), "sig", how))


def representatives(rows: DataFrame, by_set: DataFrame, total: int) -> DataFrame:
    """(cls, n, low) of one row of each class. Copies are left out by their row numbers, as few rows as there are
    copies: sent to the tasks up to BROADCAST_ROWS, so that the lists of values neither shuffle nor are written again."""
    named = _by_signature(rows.where("n > 0").select("row", "sig"), by_set.select("sig", "copies", "cls"), total)
    copies = _stage_few(named.where("row <> cls").select("row"), total, "near-copies")
    few = copies.count() <= BROADCAST_ROWS
    alone = rows.where("n > 0").select("row", "n", "sig", "low").join(F.broadcast(copies) if few else copies, "row", "left_anti")
    alone = alone.select(F.xxhash64("sig").alias("cls"), "n", "low")
    return alone if few else stage(alone, "near-reps")


def _filter(values: DataFrame) -> np.ndarray:
    """Bytes of a bitmap of FILTER_BITS with a bit for each of ``values`` (v); its bitmaps are put together on executors."""
    slot = F.col("v").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    parts = values.select((slot / BITMAP_BITS).cast("long").alias("bucket"), (slot % BITMAP_BITS).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for bucket, bits in parts.toLocalIterator():
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


class _Lists:
    """The stored lists of a run of classes as one array, and what they post under sets of hot values."""

    def __init__(self, cls, n, low: pa.Array, num: int, den: int):
        self.cls, self.n = cls, n
        ends = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4).astype(np.int64)
        self.values = np.frombuffer(low.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).view(np.uint64) if ends[-1] > ends[0] else np.empty(0, np.uint64)
        self.size = np.diff(ends) // 8
        self.first = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(n)), self.size)
        self.need = posted(n, num, den)

    def _nth(self, mask: np.ndarray) -> np.ndarray:
        """For each value how many before it in its list are in ``mask``."""
        before = np.concatenate([[0], np.cumsum(mask)])
        return before[:-1] - before[self.first][self.row]

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, mask, len(self.n)).astype(np.int64)

    def choose(self, hot: np.ndarray):
        """(posted, place in the order, cold) of each value: a list posts its first ``need`` values, cold before hot. It must hold as many
        cold values, or the whole set."""
        warm = _among(self.values, hot)
        cold = self.count(~warm)
        place = np.where(warm, cold[self.row] + self._nth(warm), self._nth(~warm))
        return place < self.need[self.row], place, ~warm

    def short(self, hot: np.ndarray) -> np.ndarray:
        """Whether a stored list ends before the values to post."""
        return (self.size < self.n) & (self.count(~_among(self.values, hot)) < self.need)


def _runs(batches, num: int, den: int, fresh: np.ndarray | None = None):
    """_Lists of some ten thousand values at a time of batches (cls, n, low); with ``fresh``, of the lists that hold one of these values alone."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), "right")))
            part = b.slice(at, to - at)
            lists = _Lists(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), num, den)
            if fresh is not None:
                own = lists.count(_among(lists.values, fresh)) > 0
                part = part.filter(pa.array(own))
                lists = _Lists(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), num, den) if len(part) else None
            if lists is not None:
                yield lists
            at = to


def _postings(classes: DataFrame, hot: np.ndarray, num: int, den: int, before: np.ndarray | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(v, cls, n, rank). With ``before``, the hot values so far: only the cold values of sets that post otherwise than under
    those, all of them for a whole set; a list without a new hot value posts as before. With ``only``, a filter: only values that pass it."""
    fresh = None if before is None else np.setdiff1d(hot, before, assume_unique=True)
    sent = classes.sparkSession.sparkContext.broadcast((hot, before, only, fresh))

    def run(batches):
        hot, before, only, fresh = sent.value
        for lists in _runs(batches, num, den, fresh):
            take, place, cold = lists.choose(hot)
            if before is not None:
                old, old_place, _ = lists.choose(before)
                changed = lists.count((take != old) | (take & (place != old_place))) > 0
                whole = (lists.size == lists.n)[lists.row]
                take = changed[lists.row] & cold & ~old & (whole | take)
            if only is not None:
                v = lists.values
                take = take & ((only[(v & np.uint64(len(only) * 8 - 1)) >> np.uint64(3)] >> (v & np.uint64(7)).astype(np.uint8)) & 1 > 0)
            at = np.flatnonzero(take)
            row = lists.row[at]
            yield pa.RecordBatch.from_arrays([pa.array(lists.values[at].view(np.int64)), pa.array(lists.cls[row]), pa.array(lists.n[row]), pa.array(place[at], pa.int64())],
                                             ["v", "cls", "n", "rank"])

    return classes.select("cls", "n", "low").mapInArrow(run, "v long, cls long, n long, rank long")


def _short_classes(classes: DataFrame, hot: np.ndarray, before: np.ndarray, num: int, den: int) -> DataFrame:
    """(cls) of the classes whose stored list is too short under ``hot``; under ``before`` none was."""
    sent = classes.sparkSession.sparkContext.broadcast((hot, np.setdiff1d(hot, before, assume_unique=True)))

    def run(batches):
        hot, fresh = sent.value
        for lists in _runs(batches, num, den, fresh):
            yield pa.RecordBatch.from_arrays([pa.array(lists.cls[lists.short(hot)])], ["cls"])

    return classes.select("cls", "n", "low").mapInArrow(run, "cls long")


def _facts(classes: DataFrame) -> DataFrame:
    """(cls, n, sketch) of each class; the sketch: the upper halves of its smallest values."""
    def run(batches):
        for b in batches:
            sketch = [(np.frombuffer(low.as_py(), np.uint64)[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for low in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sketch, pa.binary())], ["cls", "n", "sketch"])

    return classes.select("cls", "n", "low").mapInArrow(run, "cls long, n long, sketch binary")


def _among(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(v), bool)
    return known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v


def _column(df: DataFrame) -> np.ndarray:
    """The sorted values of a bounded one-column table of 64-bit hashes."""
    return np.sort(df.toArrow().column(0).to_numpy().view(np.uint64))


def _hot_values(lists: DataFrame, known: np.ndarray) -> np.ndarray:
    """Values of ``lists`` (v, members) over HOT members, with those known; fewer if they would not fit."""
    limit = HOT
    while lists.where(F.col("members") > limit).count() > MOST_HOT:
        limit *= 2
    return np.union1d(known, _column(lists.where(F.col("members") > limit).select("v")))


def _estimate(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> tuple[float, int]:
    """Similarity by the bottom-k sketch of the union, and its k. Up to the smaller of the two largest values kept, both
    sketches hold all of the union's smallest values; a set no larger than its sketch is held whole."""
    ends = [x[-1] for x, n in ((a, na), (b, nb)) if len(x) < n]
    if ends:
        limit = min(ends)
        a, b = a[:np.searchsorted(a, limit, "right")], b[:np.searchsorted(b, limit, "right")]
    both = len(np.intersect1d(a, b))
    k = max(1, len(a) + len(b) - both)
    return both / k, k


def _possible(s: float, k: int, t: float) -> bool:
    """Whether a sketch of k values may show s where the similarity is t: a lower s than this allows has probability under 1e-12 (the
    bound of Chernoff and Hoeffding by relative entropy, which holds for sampling without replacement)."""
    if s >= t:
        return True
    apart = (1 - s) * math.log((1 - s) / (1 - t)) + (s * math.log(s / t) if s > 0 else 0.0)
    return k * apart <= 27.6


def _needed(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is in the staged ``ids``: sent to the tasks up to BROADCAST_ROWS, else joined."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def _sent(table: DataFrame) -> DataFrame:
    """The staged ``table`` of few columns of numbers, to be sent to the tasks by a join if it has no more than BROADCAST_ROWS."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _both_sides(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """``pairs`` (leaf, hub) with ``cols`` of ``sets`` (cls, ...) for both ends. Up to BROADCAST_ROWS pairs go to the leaves' rows, which so move
    only once, to their hubs; more are joined. Each side that moves holds only the ends it meets, so a hub's row moves once beside those of its
    leaves. The rows that come out of the first join are staged, so the second one has plain exchanges too."""
    def named(sets: DataFrame, end: str) -> DataFrame:
        return sets.select(F.col("cls").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in cols))

    def of(end: str) -> DataFrame:
        return named(_needed(sets, _stage_few(pairs.select(F.col(end).alias("cls")).distinct(), rows, "near-ends"), "cls"), end)

    rows = pairs.count()
    few = rows <= BROADCAST_ROWS
    leaves = named(sets, "leaf").join(F.broadcast(pairs), "leaf") if few else pairs.join(of("leaf"), "leaf")
    return stage(leaves, "near-leaves").join(of("hub"), "hub")


def _links(pairs: DataFrame, facts: DataFrame, full_sets, num: int, den: int) -> DataFrame:
    """The pairs (leaf, hub) of classes whose full sets are similar enough, staged as (a, b)."""
    joined = _both_sides(pairs, facts, "n", "sketch")
    t = num / den

    def estimate(batches):
        for b in batches:
            keep = []
            for nx, ny, x, y in zip(b.column("n_leaf").to_pylist(), b.column("n_hub").to_pylist(), b.column("sketch_leaf"), b.column("sketch_hub")):
                keep.append(_possible(*_estimate(np.frombuffer(x.as_py(), np.uint32), nx, np.frombuffer(y.as_py(), np.uint32), ny), t))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("leaf").filter(keep), b.column("hub").filter(keep)], ["leaf", "hub"])

    likely = stage(joined.mapInArrow(estimate, "leaf long, hub long"), "near-likely")
    ends = 2 * likely.count()
    if not ends:
        return likely.toDF("a", "b")
    sets = full_sets(_stage_few(likely.select(F.explode(F.array("leaf", "hub")).alias("cls")).distinct(), ends, "near-verify"))

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_leaf"), b.column("set_hub")):
                vx, vy = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(vx, vy, assume_unique=True))
                keep.append(both * den >= num * (len(vx) + len(vy) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("leaf").filter(keep), b.column("hub").filter(keep)], ["a", "b"])

    return stage(_both_sides(likely, sets, "set").mapInArrow(verify, "a long, b long"), "near-links")


def _named(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` (a, b) with the components ``a_comp`` and ``b_comp`` of their ends; a class without a label is its own."""
    labels = _sent(labels)
    for c in "ab":
        name = labels.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp"))
        links = links.join(name, c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))
    return links


def _with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``labels`` (cls, comp) joined by further ``links``; staged."""
    if links.isEmpty():
        return labels
    named = stage(_named(links, labels), "near-named-links")
    to = _sent(components(named.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))).select(F.col("cls").alias("comp"), F.col("comp").alias("end"))
    ends = named.select(F.explode(F.array(*[F.struct(F.col(c).alias("cls"), F.col(f"{c}_comp").alias("comp")) for c in "ab"])).alias("e")).select("e.cls", "e.comp").distinct()
    every = labels.unionByName(ends.join(_sent(labels).select("cls"), "cls", "left_anti"))
    return stage(every.join(to, "comp", "left").select("cls", F.coalesce("end", "comp").alias("comp")), "near-labels")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class reachable over ``links`` (a, b), for the classes that have links; staged.

    Every node goes to its smallest neighbour or stays, chains are shortened to their ends by doubling, and the links between the ends
    make the next, smaller round; the stars that most links form are done in one."""
    edges = _stage_few(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), links.count(), "cc-edges")
    labels = None
    while (rows := edges.count()) or labels is None:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _stage_few(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp")), 2 * rows, "cc-ends")
        while True:
            jump = _sent(ends).select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
            told = stage(ends.join(jump, "comp").select("cls", "comp", "next"), "cc-told")
            ends = told.select("cls", F.col("next").alias("comp"))
            if told.where("comp <> next").isEmpty():
                break
        known = _sent(ends)
        to = known.select(F.col("cls").alias("comp"), F.col("comp").alias("end"))
        labels = ends if labels is None else stage(labels.join(to, "comp", "left").select("cls", F.coalesce("end", "comp").alias("comp")), "cc-labels")
        x, y = (known.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_end")) for c in "ab")
        moved = edges.join(x, "a").join(y, "b").where("a_end <> b_end")
        edges = _stage_few(moved.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), rows, "cc-edges")
    return labels


def classes_of(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first) per row of ``docs`` (doc_id, text); ``first`` marks exactly one row
    of each component, the one that stays. Documents are linked when den * intersection >= num * union, for
    ``similarity`` = (num, den). A binary column ``key`` of ``docs`` comes along."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    num, den = similarity
    rows = stage(sketches(docs, words, num, den).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    total, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = shingles * (den - num) // den
    # equal sets are one class
    by_set = _stage_few(rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("cls"), F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("copies")), total, "near-classes")
    classes = representatives(rows, by_set, total)
    by_set = by_set.select("sig", F.xxhash64("sig").alias("cls"), "low_id", "copies")

    def full_sets(ids: DataFrame) -> DataFrame:
        """(cls, set) of the classes in ``ids``, from the whole text of one document each."""
        want = stage(_needed(by_set, ids, "cls"), "near-want")
        wanted = want.count()
        named = F.broadcast(want) if wanted <= BROADCAST_ROWS else want
        texts = docs.select("doc_id", "text").join(named, F.col("doc_id").eqNullSafe(F.col("low_id"))).select("cls", "sig", "text")

        def run(batches):
            done = set()  # classes of this task: repeated rows give one set a task
            for b in sliced(batches):
                cls, sets = [], []
                for c, sig, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), words)):
                    if c not in done and len(s) and _signature(s) == sig:
                        done.add(c)
                        cls.append(c)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "set"])

        # rows repeated over tasks leave one set a class, told by place, so that no set moves for it
        sets = stage(texts.mapInArrow(run, "cls long, set binary").withColumn("at", F.monotonically_increasing_id()), "near-sets")
        again = _stage_few(sets.groupBy("cls").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("cls", "first"), wanted, "near-again")
        if again.isEmpty():
            return sets.select("cls", "set")
        first = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        return stage(sets.join(first, "cls", "left").where("first is null or at = first").select("cls", "set"), "near-once")

    def without(ids: DataFrame) -> DataFrame:
        return classes.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "cls", "left_anti")

    hot = np.empty(0, np.uint64)
    lists = _stage_few(_postings(classes, hot, num, den).groupBy("v").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), postings, "near-lists")
    shared_values, grown, whole = lists.select("v"), _hot_values(lists, hot), None
    stored = classes
    while len(grown) > len(hot):
        short = stage(_short_classes(stored, grown, hot, num, den), "near-short")
        if not short.isEmpty():
            sets = full_sets(short).select("cls", (F.octet_length("set") / 8).cast("long").alias("n"), F.col("set").alias("low"))
            whole = sets if whole is None else whole.unionByName(sets)
            stored = without(stage(whole.select("cls"), "near-whole")).unionByName(whole)
        more = _stage_few(_postings(stored, grown, num, den, hot).groupBy("v").agg(F.count(F.lit(1)).alias("members")), postings, "near-more")
        shared_values = shared_values.unionByName(more.select("v"))
        hot, grown = grown, _hot_values(more, grown)

    # most values are on one list alone: only those that may be shared are posted again
    only = _filter(shared_values)
    posts = _postings(stored, hot, num, den, only=only)
    centres = _stage_few(posts.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rank", "cls", "n")).alias("centre")).where("members > 1")
                    .select("v", F.col("centre.cls").alias("a"), F.col("centre.n").alias("n_a"), F.col("centre.rank").alias("rank_a")), postings, "near-centres")
    shared = stage(posts.join(centres, "v"), "near-shared")
    facts = stage(_needed(_facts(classes), _stage_few(shared.select("cls").distinct(), postings, "near-members"), "cls"), "near-facts")

    # the values from the posted one on must make up the similarity of two members
    could = lambda x, y: F.least(F.col(f"n{x}") - F.col(f"rank{x}"), F.col(f"n{y}") - F.col(f"rank{y}")) * (num + den) >= (F.col(f"n{x}") + F.col(f"n{y}")) * num

    # every list links its members to its centre
    pairs = _stage_few(shared.where("cls <> a").where(could("_a", "")).groupBy(F.least("a", "cls").alias("x"), F.greatest("a", "cls").alias("y")).agg(F.min("a").alias("hub")), postings, "near-pairs")
    labels = components(_links(pairs.select((F.col("x").bitwiseXOR(F.col("y")).bitwiseXOR(F.col("hub"))).alias("leaf"), "hub"), facts, full_sets, num, den))

    # members of a list that are still apart meet each other
    parts = stage(shared.select("v", "cls", "n", "rank").join(_sent(labels), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-parts")
    split = _stage_few(parts.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y and members > 2").select("v"), postings, "near-split")
    open_parts = stage(parts.join(split, "v", "left_semi"), "near-open")
    x, y = (open_parts.select("v", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "rank", "comp"))) for s in "ab")
    met = (x.join(y, "v").where("cls_a < cls_b and comp_a <> comp_b").where(could("_a", "_b"))
           .select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y")).distinct())
    fresh = stage(stage(met, "near-met").join(pairs, ["x", "y"], "left_anti").select(F.col("x").alias("leaf"), F.col("y").alias("hub")), "near-fresh")
    if not fresh.isEmpty():
        labels = _with_links(labels, _links(fresh, facts, full_sets, num, den))

    named = stage(by_set.join(_sent(labels), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-named")
    first = _stage_few(named.groupBy("comp").agg(F.min("low_id").alias("component_id")), total, "near-first")
    ids = stage(named.select("sig", "comp", "copies").join(first, "comp").select("sig", "comp", "component_id", "copies"), "near-ids")
    key = ["key"] if "key" in docs.columns else []
    narrow = rows.select("doc_id", "row", *key, "n", "sig")
    bare = narrow.where("n = 0").withColumn("comp", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long"))
    out = stage(_by_signature(narrow.where("n > 0"), ids, total).unionByName(bare)
                .select("doc_id", "row", *key, F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                        "comp", (F.col("n") == 0).alias("bare")), "near-out")
    # of the rows that carry the smallest id the first one stays; a component without any id keeps its first row
    stays = _stage_few(out.where("not bare and doc_id <=> component_id").groupBy("comp").agg(F.min("row").alias("first_row")), total, "near-stays")
    return out.join(stays, "comp", "left").select("doc_id", "row", *key, "n_shingles", "component_id", (F.col("bare") | (F.col("row") == F.col("first_row"))).alias("first"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; kept: the row's id names its component."""
    return classes_of(docs.select("doc_id", "text"), words, similarity).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
