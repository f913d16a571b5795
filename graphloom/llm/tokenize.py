"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's published pattern. Words that a task has not met before are encoded together: their symbols lie in
one flat array, the rank of each neighbouring pair is found by binary search over the sorted pair keys, and each round merges in every word all
pairs of its lowest rank. Words met before are looked up.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the published pattern that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged one by one with a queue, as rounds over them would be many.
LONG_WORD = 512
#: Words that a task remembers, and words of texts that it encodes together.
REMEMBERED, TOGETHER = 400_000, 1_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: sorted keys of pairs with the rank and the result of each, and the id of each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.bytes = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)
        self._table: dict[int, int] = {}

    @property
    def table(self) -> dict[int, int]:
        """The rank of each pair, made when a task meets its first long word."""
        if not self._table:
            self._table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or len(ranks) if it has none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.ranks))


def encode_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words one behind the other, and how many each word has. No word may be empty."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        short = np.flatnonzero(lengths <= LONG_WORD)
        ids, counts = encode_words([words[k] for k in short], merges)
        parts: list[np.ndarray] = [None] * len(words)
        for k, part in zip(short, np.split(ids, np.cumsum(counts)[:-1]) if len(short) else ()):
            parts[k] = part
        for k in long:
            parts[k] = _encode_long(words[k], merges)
        return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    none = len(merges.ranks)
    symbols = merges.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_words = [], []
    while len(symbols):
        rank = np.full(len(symbols), none, dtype=np.int64)
        same = word[1:] == word[:-1]
        rank[:-1][same] = merges.rank(symbols[:-1][same], symbols[1:][same])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
        open_ = np.repeat(lowest < none, sizes)
        if not open_.all():
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank = symbols[open_], word[open_], rank[open_]
            lowest, sizes = lowest[lowest < none], sizes[lowest < none]
            if not len(symbols):
                break
        chosen = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # of pairs that overlap, as in a run of one symbol, every other one is merged, from the left
        run = np.cumsum(np.concatenate([[True], np.diff(chosen) > 1])) - 1
        first = chosen[np.concatenate([[True], np.diff(chosen) > 1])]
        chosen = chosen[(chosen - first[run]) % 2 == 0]
        symbols[chosen] = merges.results[rank[chosen]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[chosen + 1] = False
        symbols, word = symbols[keep], word[keep]
    ids, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _encode_long(word: bytes, merges: Merges) -> np.ndarray:
    """The ids of one long word: the pair of lowest rank, leftmost first, until none is left."""
    symbols = merges.bytes[np.frombuffer(word, dtype=np.uint8)]
    n, none = len(symbols), len(merges.ranks)
    s, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    table = merges.table
    queue = [(r, k, a, b) for k, (r, a, b) in enumerate(zip(merges.rank(symbols[:-1], symbols[1:]).tolist(), s, s[1:])) if r < none]
    heapq.heapify(queue)
    while queue:
        r, k, a, b = heapq.heappop(queue)
        m = after[k] if s[k] == a else n
        if m >= n or s[m] != b:
            continue
        s[k], s[m] = int(merges.results[r]), -1
        after[k] = after[m]
        if after[m] < n:
            before[after[m]] = k
        for x in (before[k], k):
            y = after[x] if x >= 0 else n
            if y < n and (q := table.get(s[x] << 32 | s[y])) is not None:
                heapq.heappush(queue, (q, x, s[x], s[y]))
    return np.array([x for x in s if x >= 0], dtype=np.int64)


class Encoder:
    """Encodes texts and remembers the words it has met."""

    def __init__(self, merges: Merges):
        self.merges, self.words = merges, regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Words of texts to the ids of all texts one behind the other, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, fresh = self.known, []
        for w in set(chain.from_iterable(texts)).difference(known):
            known[w] = len(known)
            fresh.append(w.encode())
        if fresh:
            ids, counts = encode_words(fresh, self.merges)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        place = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=total)
        counts = self.counts[place]
        ends = np.cumsum(counts)
        within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        flat = self.ids[np.repeat(self.starts[place], counts) + within]
        upto = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return flat, upto[bounds[1:]] - upto[bounds[:-1]]


def token_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids of every row, in int lists, without special tokens: what looks like one in a text is text.

    A null and an empty text have an empty list; a null or repeated doc_id has its row like any other; other columns are ignored."""
    merges = docs.sparkSession.sparkContext.broadcast(Merges(os.path.join(folder, vocabulary)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for b in batches:
            start, held, n = 0, [], 0
            texts = b.column("text")
            for k in range(b.num_rows + 1):
                if held and (k == b.num_rows or n > TOGETHER):
                    ids, counts = encoder.encode(held)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(held)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])
                    start, held, n = k, [], 0
                if k < b.num_rows:
                    held.append(encoder.words(texts[k].as_py() or ""))
                    n += len(held[-1])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, ids array<int>")
