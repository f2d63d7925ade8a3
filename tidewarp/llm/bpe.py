"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one token can end its encoding. The matches of all vocabulary tokens that
are suffixes of a prefix come from one pass of a suffix-matching automaton; a match counts if it is compatible with
the last token stored for the shorter prefix, that is, if no merge would have crossed the border of the two first.
Following the stored tokens back from the end gives the exact ids, the same as applying the merges in rank order.

Rows are independent, so both directions are map-only; the memo of pre-tokens is bounded and never changes a result.

Defined results: a null text is the empty text (no ids); repeated rows are encoded each on its own; a null doc_id is
carried along; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewarp.llm.common import prepare

#: fixed value: the published splitting pattern of byte-level BPE vocabularies
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62
#: key of the token that ends at a state of the automaton; START precedes the first token of a word
TOKEN, START = 256, -1
#: pre-tokens a worker remembers in each of two generations, the longest one it remembers, characters split at a time
MEMO_ENTRIES, MEMO_WORD, CHUNK = 300_000, 64, 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = [-1] * size
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            made = self.ids[raw[left] + raw[right]]
            self.rank[a, b] = r
            if made not in self.parts:
                self.parts[made], self.born[made] = (a, b), r
            if max(self.born[a], self.born[b]) >= r:
                raise ValueError("a merge precedes one of its parts; ranks must follow the order of training")
        self._pair: dict[tuple[int, int], bool] = {}
        self._spine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        reachable = self._reachable()
        # suffix automaton: one step per byte going back from the end of a prefix; TOKEN marks a whole token
        self.automaton: dict = {}
        for b, i in self.ids.items():
            if reachable[i]:
                state = self.automaton
                for byte in reversed(b):
                    state = state.setdefault(byte, {})
                state[TOKEN] = i
        self.split = regex.compile(PRE_TOKENS).findall
        self.cut = None
        if self.special:
            self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that touch the border while ``token`` is built, each with the rank of the merge that absorbs it.
        side 1: its right end, side 0: its left end."""
        got = self._spine.get((token, side))
        if got is None:
            got, absorbed, t = [], NEVER, token
            while True:
                got.append((t, absorbed))
                if t not in self.parts:
                    break
                absorbed, t = self.born[t], self.parts[t][side]
            self._spine[token, side] = got
        return got

    def _crossed(self, x: int, y: int, before: int) -> bool:
        """Whether some merge of rank under ``before`` joins an end of x with a start of y before x and y are whole.
        Of equal ranks the leftmost occurrence merges first."""
        rank = self.rank
        for a, left_until in self._edge(x, 1):
            for b, right_until in self._edge(y, 0):
                r = rank.get((a, b))
                if r is not None and r < before and r < left_until and r <= right_until:
                    return True
        return False

    def _reachable(self) -> list[bool]:
        """Tokens whose own bytes encode to themselves."""
        ok = [True] * len(self.bytes_of)
        for t in sorted(self.parts, key=lambda t: self.born[t]):
            a, b = self.parts[t]
            ok[t] = ok[a] and ok[b] and not self._crossed(a, b, self.born[t])
        return ok

    def compatible(self, x: int, y: int) -> bool:
        """Whether x and y, next to each other, are the encoding of their joint bytes."""
        got = self._pair.get((x, y))
        if got is None:
            if len(self._pair) > 2_000_000:
                self._pair.clear()
            got = self._pair[x, y] = x == START or not self._crossed(x, y, NEVER)
        return got

    def encode_words(self, words) -> dict[str, bytes]:
        """word -> ids as little-endian unsigned 32-bit integers. In sorted order the last tokens of the prefixes that
        a word shares with the one before it are known already."""
        out, pairs, automaton = {}, self._pair, self.automaton
        before, last, size = b"", [START], [0]
        for word in sorted(words):  # code points sort as their bytes in UTF-8 do
            text = word.encode()
            n = len(text)
            same, most = 0, min(n, len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1:], size[same + 1:]
            for end in range(same + 1, n + 1):
                state, at = automaton, end
                while at:
                    at -= 1
                    state = state.get(text[at])
                    if state is None:
                        raise AssertionError("no token ends here; the vocabulary lacks a byte")
                    token = state.get(TOKEN)
                    if token is not None:
                        ok = pairs.get((last[at], token))
                        if ok is None:
                            ok = self.compatible(last[at], token)
                        if ok:
                            last.append(token)
                            size.append(end - at)
                            break
            before, ids, at = text, array("I"), n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = ids.tobytes()
        return out

    def _encode_split(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts given as lists of pre-tokens."""
        known = self.memo
        new = set().union(*split).difference(known)
        own = {w: self.old[w] for w in new if w in self.old}
        own.update(self.encode_words(new.difference(own)))
        if len(known) + len(own) > MEMO_ENTRIES:
            self.old, self.memo = known, {}
            own.update((w, known[w]) for w in set().union(*split) if w in known)
        self.memo.update(own)
        got = [b"".join(map(self.memo.__getitem__, words)) for words in split]
        for w in own:
            if len(w) > MEMO_WORD:
                del self.memo[w]
        return got

    def encode_all(self, texts) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit integers; special tokens are recognised in them."""
        out: list[list[bytes]] = []
        split: list[list[str]] = []
        slots: list[tuple[int, int]] = []
        chars = 0

        def flush():
            nonlocal chars
            for (i, k), ids in zip(slots, self._encode_split(split)):
                out[i][k] = ids
            split.clear()
            slots.clear()
            chars = 0

        for i, text in enumerate(texts):
            pieces = self.cut(text) if self.cut else [text]
            out.append([b""] * len(pieces))
            for k, piece in enumerate(pieces):
                if k % 2:
                    out[i][k] = array("I", [self.special[piece]]).tobytes()
                elif piece:
                    split.append(self.split(piece))
                    slots.append((i, k))
                    chars += len(piece)
                    if chars >= CHUNK:
                        flush()
        flush()
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long) of every row of ``docs`` (doc_id, text). ``tokenizer``: the path of a
    tokenizers JSON file that every executor has."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            parts = c.encode_all(t or "" for t in b.column(1).to_pylist())
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            flat = np.frombuffer(b"".join(parts), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(np.diff(ends), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are no ids."""
    prepare(encoded.sparkSession)

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode in one task, keeping digests only: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(tokenizer)
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for raw in c.encode_all(t.as_py() or "" for t in b.column(1)):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(sha(raw).hexdigest())
                text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
