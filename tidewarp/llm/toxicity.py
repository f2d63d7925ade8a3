"""Toxicity scores from a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other alphabets, accents and styled letters become plain
letters and invisible characters go. Digits or signs can stand for letters anywhere in a word, each for one letter or
another (1 for i or l), or be noise before or after it. One Aho-Corasick pass over the whole text, in which a sign and the
letters it may stand for are one, finds every entry of the lexicon that some reading has at the start of a word. The
lexicon is learned from the words with all signs read alike, with those around a word and without.
An entry is a whole word or the beginning of words, weighted with the lower confidence limit of its log-odds between
toxic and clean texts; of the entries at one word the heaviest counts, unless the word stands in an exception phrase
(a neighbour next to which clean texts use it). Weights add up with diminishing returns for repeats, are set in relation to the length
of the text, and a logistic curve turns that into a score.

Everything is learned from labels: entries, weights, exception phrases and curve, on at most ``SAMPLE`` labelled rows
(those of smallest hash, so the sample does not depend on the order of rows). The lexicon is learned on each half of the
sample apart for fitting the curve on the other half, then on all of it. It has at most ``ENTRIES`` entries, so it is broadcast.
Scoring reads every row and the whole of its text, without any shuffle.

Defined results: a null text is empty; an empty text gets the score of a text without hits. Rows with a null doc_id are
scored, never learned from. A doc_id labelled more than once is toxic if any of its labels says so; null labels
do not count. Without toxic labels every score is 0. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage

SAMPLE = 20_000  # labelled rows learned from, at most
ENTRIES = 20_000  # of the lexicon, at most
LEAST, MOST = 3, 12  # letters of an entry that is the beginning of words
SURE = 1.96  # standard errors below the log-odds
KEEP = 1.0  # least weight of an entry
#: fixed values: letters of other alphabets that look like plain ones
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ø": "o", "ł": "l", "đ": "d",
}
#: fixed values: digits and signs read as letters inside a word
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: fixed values: all letters a digit or sign can stand for
READ = {**DIGITS, "1": "il", "!": "il", "|": "il"}
_AS_I, _AS_L = ({ord(c): letters[i] for c, letters in READ.items()} for i in (0, -1))
_SIGNS = "".join(READ)
_ONE = _AS_I | {ord("l"): "i"}  # a sign and all letters it can stand for become one
_RUN = re.compile(r"[0134578 9@$!|+]+".replace(" ", ""))
_DISGUISED = re.compile(r"(?:[^\W\d_]|[0134578 9@$!|+])+".replace(" ", ""))
_IN_WORD = re.compile(r"(?:(?<=[a-z])|(?<![^\s]))[0134578 9@$!|+]".replace(" ", "") + r"+(?=[a-z])")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    """Folding of single characters: the look-alikes, and by their decomposition Latin letters with accents, full-width
    and styled letters; invisible characters become nothing."""
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x24B6, 0x24EA), (0xFF21, 0xFF5B), (0x1D400, 0x1D7CC)):
        for i in range(lo, hi):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
            if plain != chr(i) and plain.isalpha():
                table.setdefault(i, "".join(LOOK_ALIKES.get(c, c) for c in plain))
    for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)):
        table[i] = ""
    return table


def plain(text: str) -> str:
    """A text with its letters folded, digits and signs as they are."""
    text = text.lower()
    return text if text.isascii() else text.translate(_table())


def fold(text: str) -> str:
    return _read(plain(text))


def _read(text: str) -> str:
    """The commonest reading of a plain text, character by character."""
    return _IN_WORD.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)


def _words(text: str) -> set[str]:
    """Words of a plain text; those with digits or signs in all-alike readings, with the signs around them and without."""
    out = set()
    for w in set(_DISGUISED.findall(text)):
        if w.isalpha() or not _RUN.search(w):
            out.add(w)
        elif any(map(str.isalpha, w)):
            for part in {w, w.strip(_SIGNS), w.lstrip(_SIGNS), w.rstrip(_SIGNS)}:
                out.update((part.translate(_AS_I), part.translate(_AS_L)))
    return out


def _beginnings(text: str) -> set[str]:
    """Entries that a plain text could bear: beginnings of its words, and whole words with a mark after them."""
    out = set()
    for w in _words(text):
        out.update(w[:k] for k in range(LEAST, min(len(w), MOST) + 1))
        out.add(w[:64] + "$")
    return out


def _weight(toxic, clean, toxics: int, cleans: int):
    """Lower confidence limit of the log-odds."""
    odds = np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))
    return odds - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


class Lexicon:
    """``entries``: beginning, or whole word with a mark, -> weight. ``exceptions``: (entry, side, neighbour)."""

    def __init__(self, entries: dict[str, float], exceptions=frozenset()):
        import ahocorasick

        self.exceptions = exceptions
        self.automaton = ahocorasick.Automaton()
        both: dict[str, list] = {}
        for e, w in entries.items():
            both.setdefault(e.rstrip("$"), [0.0, 0.0])[e.endswith("$")] = w
        alike: dict[str, list] = {}
        for e, (begin, whole) in both.items():
            alike.setdefault(e.translate(_ONE), []).append((e, begin, whole))
        for one, same in alike.items():
            self.automaton.add_word(one, (len(one), same))
        if both:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[float, str]]:
        """start of a word in a plain text -> (weight, entry), the heaviest of all readings."""
        best: dict[int, tuple[float, str]] = {}
        if not len(self.automaton):
            return best
        runs = [m.span() for m in _RUN.finditer(text)]  # of digits and signs
        starts = [a for a, _ in runs]

        def letter_before(at: int) -> bool:
            i = bisect_right(starts, at - 1) - 1
            if i >= 0 and at - 1 < runs[i][1]:
                at = runs[i][0]
            return at > 0 and text[at - 1].isalpha()

        def letter_after(at: int) -> bool:
            i = bisect_right(starts, at) - 1
            if i >= 0 and at < runs[i][1]:
                at = runs[i][1]
            return text[at:at + 1].isalpha()

        for end, (size, same) in self.automaton.iter(text.translate(_ONE)):
            start = end + 1 - size
            if letter_before(start):
                continue
            span = text[start:end + 1]
            for e, begin, whole in same:
                if span != e and not (all(c == x or x in READ.get(c, "") for c, x in zip(span, e)) and (any(map(str.isalpha, span)) or letter_after(end + 1))):
                    continue
                w = max(begin, whole) if whole and not letter_after(end + 1) else begin
                if w > 0 and (start not in best or w > best[start][0]):
                    best[start] = (w, e)
        return best

    def phrases(self, text: str, start: int, entry: str):
        """(entry, side, neighbour) of the words before and after the one at ``start`` of a plain text."""
        first = start
        while first > max(0, start - 40) and text[first - 1] in READ:
            first -= 1
        before = _WORD.findall(_read(text[max(0, start - 40):first]))
        after = _WORD.findall(_read(text[start:start + 80]))
        return [(entry, -1, w) for w in before[-1:]] + [(entry, 1, w) for w in after[1:2]]

    def features(self, text: str) -> list[float]:
        """Sum of weights, its relation to the length, and the heaviest one."""
        found = Counter()
        weight: dict[str, float] = {}
        for start, (w, e) in self.hits(text).items():
            if self.exceptions and any(p in self.exceptions for p in self.phrases(text, start, e)):
                continue
            found[e] += 1
            weight[e] = w
        words = text.count(" ") + text.count("\n") + 1
        total = sum(weight[e] * (1 + math.log(n)) for e, n in found.items())
        return [math.log1p(total), math.log1p(100 * total / words), max(weight.values(), default=0.0)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients with the constant first, means, scales) by Newton's method. More hits never lower a score: a
    feature with a negative coefficient is left out and the rest fitted again."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    use = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([np.ones(len(x)), ((x - mean) / scale)[:, use]])
        beta = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (y - p) - ridge * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        if (beta[1:] >= 0).all():
            whole = np.zeros(1 + x.shape[1])
            whole[np.append(True, use)] = beta
            return whole, mean, scale
        at = np.flatnonzero(use)
        use[at[np.argmin(beta[1:])]] = False


def _rows(docs: DataFrame, schema: str, make):
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for rows in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return docs.mapInArrow(run, schema)


def _count(sample: DataFrame, extract) -> DataFrame:
    """(e, half, toxic, n): documents of the sample that hold each of the strings extract(plain text) gives."""
    def make(batches):
        counts: Counter = Counter()
        for b in batches:
            for text, half, toxic in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts.update((e, half, toxic) for e in extract(plain(text or "")))
        yield [(*k, n) for k, n in counts.items()]

    return _rows(sample.select("text", "half", "toxic"), "e string, half int, toxic int, n long", make).groupBy("e", "half", "toxic").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(lexicon, curve) from the rows of ``labels`` (doc_id, toxic), of which at most ``sample`` are used."""
    by_hash = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
               .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample))
    chosen = stage(by_hash.select("doc_id", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half")), "tox-labels")
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "half", "toxic"), "tox-sample")
    totals = np.zeros((2, 2))
    for half, toxic, n in rows.groupBy("half", "toxic").count().collect():
        totals[half, toxic] = n
    if not totals[:, 1].sum():
        return Lexicon({}), None

    # entries that toxic texts share, then how often clean texts hold those
    least = max(3, 0.002 * totals[:, 1].sum())
    toxic_counts = _count(rows.where("toxic = 1"), _beginnings)
    common = stage(toxic_counts.join(toxic_counts.groupBy("e").agg(F.sum("n").alias("all")).where(F.col("all") >= least), "e"), "tox-common")
    names = {r[0] for r in common.select("e").distinct().collect()}  # each is in `least` of the sample's texts: bounded by it
    sent = docs.sparkSession.sparkContext.broadcast(names)
    clean_counts = _count(rows.where("toxic = 0"), lambda text: sent.value.intersection(_beginnings(text)))
    counts: dict[str, np.ndarray] = {}
    for e, half, toxic, n in common.select("e", "half", "toxic", "n").unionByName(clean_counts).collect():
        counts.setdefault(e, np.zeros((2, 2)))[half, toxic] += n
    entries = list(counts)
    table = np.array([counts[e] for e in entries]).reshape(-1, 2, 2)

    def lexicon(halves) -> dict[str, float]:
        held, all_ = table[:, halves].sum(1), totals[halves].sum(0)
        w = _weight(held[:, 1], held[:, 0], all_[1], all_[0])
        longer = {(e[:-1], n) for e, n in zip(entries, held[:, 1]) if not e.endswith("$")}  # as many texts hold a longer beginning
        order = np.argsort(-w * np.sqrt(held[:, 1]), kind="stable")
        keep = [i for i in order if w[i] > KEEP and (entries[i], held[i, 1]) not in longer][:ENTRIES]
        return {entries[i]: float(w[i]) for i in keep}

    of_half = [lexicon([0]), lexicon([1])]
    whole = lexicon([0, 1])
    finder = Lexicon(whole)
    phrase_counts = _count(rows, lambda text: {"\t".join(map(str, p)) for s, (_, e) in finder.hits(text).items() for p in finder.phrases(text, s, e)})
    phrases: dict[str, list[float]] = {}
    clean_phrases = stage(phrase_counts, "tox-phrases")
    often = clean_phrases.where("toxic = 0").groupBy("e").agg(F.sum("n").alias("c")).where("c >= 3").select("e")
    for e, toxic, n in clean_phrases.join(often, "e").select("e", "toxic", "n").collect():
        phrases.setdefault(e, [0.0, 0.0])[toxic] += n
    all_ = totals.sum(0)
    exceptions = set()
    for e, (clean, toxic) in phrases.items():
        odds = math.log((toxic + 0.5) / (all_[1] + 1)) - math.log((clean + 0.5) / (all_[0] + 1))
        if odds + SURE * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) < 0:
            entry, side, word = e.split("\t")
            exceptions.add((entry, int(side), word))
    exceptions = frozenset(exceptions)

    # the curve: each half of the sample is described by what the other half taught
    def make(batches):
        others = [Lexicon(of_half[1], exceptions), Lexicon(of_half[0], exceptions)]
        for b in batches:
            yield [(toxic, *others[half].features(plain(text or ""))) for text, half, toxic in zip(*(b.column(i).to_pylist() for i in range(3)))]

    got = np.array(_rows(rows.select("text", "half", "toxic"), "y int, a double, b double, c double", make).toPandas())  # `sample` rows at most
    curve = _logistic(got[:, 1:], got[:, 0])
    return Lexicon(whole, exceptions), (whole, exceptions, curve)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic)."""
    prepare(docs.sparkSession)
    judge = scorer(docs, labels, sample)

    def make(batches):
        value = judge()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = value(text.as_py())
                rows.append((doc_id, s, int(s >= threshold)))
            yield rows

    return _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double, predicted int", make)


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Learn, and return a function that a task calls once for its text -> score function."""
    _, model = learn(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        if sent.value is None:
            return lambda text: 0.0
        entries, exceptions, (beta, mean, scale) = sent.value
        lexicon = Lexicon(entries, exceptions)

        def value(text):
            x = (np.array(lexicon.features(plain(text or ""))) - mean) / scale
            return float(1 / (1 + math.exp(-max(-30.0, min(30.0, beta[0] + x @ beta[1:])))))

        return value

    return judge


def training_labels(labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """The labels of rows whose crc32(doc_id as text) mod ``folds`` is not ``out``."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != out)
