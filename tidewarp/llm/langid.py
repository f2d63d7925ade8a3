"""Language identification with a byte convolutional network, trained in numpy on labelled text.

The network reads windows of ``WINDOW`` bytes: an embedding of bytes (A-Z folded to a-z), filters of several widths over
the embedded bytes, the largest answer of each filter over the window (max pooling, then a rectifier), a dense layer and a
softmax over the languages learned. A text of any length is cut into consecutive windows; its prediction is the mean of
the windows' probabilities, each weighted by its letter bytes, and its score is the mean probability of the language predicted.
All windows of a text count, however long it is, and are run in batches of ``BATCH`` windows, so memory does not follow the text.

The network is fitted on at most ``sample`` labelled documents, ``WINDOWS`` windows of each, spread over its whole text. They
are dealt evenly to the languages, those of smallest id hash first, so a rare language is seen as often as a frequent one and
the choice depends on no partition. Only the windows of the sample reach the driver (at most sample x WINDOWS x WINDOW bytes, one
document of each language at least) and only the weights are broadcast.

Defined results: a null text, an empty one and one without any letter have no language: ``und`` with score 0; they teach
nothing. Repeated rows are each predicted on their own; of the rows of one id in the sample one teaches. A null
doc_id is not held out. Rows without lang teach nothing. With no labelled text at all every row is ``und`` with score 0.
Ties go to the smaller language name. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage

SAMPLE = 2000  # labelled documents that teach
WINDOW = 256
WINDOWS = 4  # windows of a document that teach
BATCH = 128  # windows of one matrix product
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width
DEPTH = 8  # of the embedding
STEPS = 400  # of the fit, on BATCH windows each
RATE = 0.004
SPAN = max(WIDTHS)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[97:123] = True
_LETTER_BYTE[128:] = True


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def windows_at(data: np.ndarray, starts) -> np.ndarray:
    """Windows of ``data`` (folded bytes) at ``starts``, zeros after its end."""
    out = np.zeros((len(starts), WINDOW), np.uint8)
    for row, s in zip(out, starts):
        part = data[s:s + WINDOW]
        row[:len(part)] = part
    return out


class Network:
    """Weights and passes. Filters of all widths are one matrix over SPAN bytes; the rows beyond a filter's width are held at 0."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        wide = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.arange(SPAN)[:, None, None] < wide).repeat(DEPTH, axis=1).reshape(SPAN * DEPTH, -1).astype(np.float32)
        self.embed = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = (rng.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(wide * DEPTH)).astype(np.float32)
        self.bias = np.zeros(len(wide), np.float32)
        self.dense = rng.normal(0, 0.1, (len(wide), len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def weights(self):
        return [self.embed, self.filters, self.bias, self.dense, self.offset]

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, SPAN x DEPTH): the embedded bytes under the filters at every place; after the window come zeros."""
        padded = np.pad(x, ((0, 0), (0, SPAN - 1)))
        e = self.embed[padded]
        return np.concatenate([e[:, i:i + WINDOW] for i in range(SPAN)], axis=2)

    def _pooled(self, columns: np.ndarray, at: bool = False):
        n, places, wide = columns.shape
        answers = (columns.reshape(-1, wide) @ self.filters).reshape(n, places, -1)
        best = answers.max(axis=1) + self.bias
        return (best, answers.argmax(axis=1)) if at else best

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages) of windows of folded bytes."""
        return np.concatenate([self._softmax(self._pooled(self._columns(x[i:i + BATCH]))) for i in range(0, len(x), BATCH)]
                              or [np.empty((0, len(self.langs)), np.float32)])

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Of the mean cross entropy; a filter learns from the place that answered most, where that is positive."""
        columns = self._columns(x)
        pooled, at = self._pooled(columns, at=True)
        p = self._softmax(pooled)
        n = len(x)
        p[np.arange(n), y] -= 1
        p /= n
        hidden = np.maximum(pooled, 0)
        back = (p @ self.dense.T) * (pooled > 0)
        best = columns[np.arange(n)[:, None], at]  # (windows, filters, SPAN x DEPTH)
        g_filters = np.einsum("nf,nfd->df", back, best) * self.mask
        spread = (back[:, :, None] * self.filters.T[None]).reshape(-1, SPAN, DEPTH)
        places = at.reshape(-1)[:, None] + np.arange(SPAN)
        bytes_ = np.pad(x, ((0, 0), (0, SPAN - 1)))[np.repeat(np.arange(n), at.shape[1])[:, None], places]
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, bytes_.reshape(-1), spread.reshape(-1, DEPTH))
        return [g_embed, g_filters, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> "Network":
        """Adam over batches of shuffled rounds; the same input gives the same weights."""
        rng = np.random.default_rng(seed)
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]
        order = np.empty(0, int)
        for step in range(1, steps + 1):
            while len(order) < min(BATCH, len(x)):
                order = np.append(order, rng.permutation(len(x)))
            own, order = order[:BATCH], order[BATCH:]
            rate = RATE * (1 - (step - 1) / steps)
            for w, g, (m, v) in zip(self.weights(), self.gradients(x[own], y[own]), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def _thresholds(labelled: DataFrame, sample: int) -> dict:
    """{language: the hash up to which its ids teach}. A task keeps the smallest hashes of each language that it meets."""
    def smallest(batches):
        held: dict = {}
        for b in batches:
            for lang, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                heap, known = held.setdefault(lang, ([], set()))
                if h in known or (len(heap) >= sample and h >= -heap[0]):
                    continue
                known.add(h)
                if len(heap) >= sample:
                    known.discard(-heapq.heappushpop(heap, -h))
                else:
                    heapq.heappush(heap, -h)
        rows = [(lang, h) for lang, (_, known) in held.items() for h in known]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["lang", "h"])

    hashes = stage(labelled.select("lang", "h").mapInArrow(smallest, "lang string, h long").distinct(), "langid-hashes")
    languages = hashes.select("lang").distinct().count()
    each = max(1, sample // max(1, languages))
    ranked = hashes.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= each)
    return {r.lang: r.h for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}  # a row a language


def teaching_windows(labelled: DataFrame, sample: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, language of each window) of the sample of ``labelled`` (lang, h, text), in an order of its own."""
    limits = _thresholds(labelled, sample)

    def cut(batches):
        for b in batches:
            rows = []
            for lang, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if h > limits[lang]:
                    continue
                text = text.as_py()
                if has_letter(text):
                    data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
                    last = max(0, len(data) - WINDOW)
                    starts = sorted({last * i // (WINDOWS - 1) for i in range(WINDOWS)}) if last else [0]
                    rows.append((lang, h, windows_at(data, starts).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "w"])

    under = F.lit(False)
    for lang, h in limits.items():
        under = under | ((F.col("lang") == lang) & (F.col("h") <= h))
    rows = labelled.where(under).select("lang", "h", "text").mapInArrow(cut, "lang string, h long, w binary")
    rows = rows.groupBy("lang", "h").agg(F.min("w").alias("w")).orderBy("lang", "h").collect()  # about `sample` rows
    langs = sorted({r.lang for r in rows})
    x = [np.frombuffer(r.w, np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.repeat([langs.index(r.lang) for r in rows], [len(w) for w in x]) if rows else np.empty(0, int)
    return langs, np.concatenate(x) if x else np.empty((0, WINDOW), np.uint8), y


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network fitted on ``labelled`` (doc_id, lang, text); None without any labelled text."""
    prepare(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id").alias("h"), "text")
    langs, x, y = teaching_windows(rows, sample)
    return Network(langs).fit(x, y) if langs else None


def _judged(network: Network, texts: list[bytes]):
    """Mean probabilities of each text, by its windows; the windows of all texts run together, a bounded number at a time."""
    total = np.zeros((len(texts), len(network.langs)))
    weight = np.zeros(len(texts))
    queue, owner, held = [], [], 0

    def flush():
        nonlocal queue, owner, held
        if queue:
            x, who = np.concatenate(queue), np.concatenate(owner)
            letters = _LETTER_BYTE[x].sum(axis=1)
            np.add.at(total, who, network.probabilities(x) * letters[:, None])
            np.add.at(weight, who, letters)
        queue, owner, held = [], [], 0

    block = 64 * BATCH * WINDOW  # bytes of a text at a time
    for i, text in enumerate(texts):
        for at in range(0, len(text), block):
            data = _FOLD[np.frombuffer(text, np.uint8, min(block, len(text) - at), at)]
            rows = -(-len(data) // WINDOW)
            full = np.zeros(rows * WINDOW, np.uint8)
            full[:len(data)] = data
            queue.append(full.reshape(rows, WINDOW))
            owner.append(np.full(rows, i))
            held += rows
            if held >= 16 * BATCH:
                flush()
    flush()
    return total / np.maximum(weight, 1)[:, None]


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def run(batches):
        net = sent.value
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
            if known:
                p = _judged(net, [texts[i].encode() for i in known])
                best = p.argmax(axis=1)
                for i, k, v in zip(known, best, p[np.arange(len(known)), best]):
                    lang[i], score[i] = net.langs[k], min(1.0, float(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang), learning from the lang of those whose
    crc32(doc_id as text) mod ``folds`` is not ``out``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, F.lit(False))
    network = learn(docs.where(~held), sample)
    return predict(docs, network).select("doc_id", held.alias("held_out"), "lang_pred", "score")
