"""Evaluation passages in a training corpus: n-gram seeds, then local alignment.

Words and word triples travel as 64-bit hashes. The triples of all items pass through Spark once: those that several items hold, such as turns of
phrase, are no seeds, however rare or common they are in the corpus; an item that would keep too few has them all. One pass over the texts keeps for each
document the triples that a bitmap of all seeds lets through; a join with the seeds counts them per document and item. Pairs with enough seeds are
aligned by Smith and Waterman's recurrence over words, many windows in one array; the best stretch is taken out and a second one sought. Of the texts
only those of candidates are shuffled, and the corpus is read twice however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured, meet, sieve
from graphloom.llm.words import plain, words

#: A sentence that opens at least so many items is a stock instruction, a triple that so many hold a turn of phrase.
STOCK_ITEMS = 3
#: A pair is aligned if it shares this share of the item's triples, three at least.
SEED_SHARE, SEED_LEAST = 0.1, 3
#: Weight of the rarest and of the commonest word, and what a word costs that the text puts between those of the item.
RAREST, COMMONEST, INSERTED = 100, 6, 12
#: A stretch has so many equal words at least.
STRETCH_WORDS = 6
#: The share of an item's words that one or two stretches hold, for items of several sentences and of one.
COVERED, COVERED_SENTENCE = 0.33, 0.7
#: Words of an item that are aligned together; a longer item is aligned part by part.
PART_WORDS = 20_000
#: Words of 64 bits in a bitmap, 4 MB. More seeds let more triples of a text through to the join; nothing is lost.
BITMAP_WORDS = 1 << 19
#: A key that more than this share of the rows of a join have is met by a broadcast, so there are at most 1 / HOT of these.
HOT = 1 / 1024
#: Words of windows that a task aligns together, and characters of texts that it cuts into words together.
TOGETHER, CUT_TOGETHER = 2_000_000, 1 << 18
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64

_SENTENCE = regex.compile(r"(?<=[.?!。？！])\s*(?=\s|[\p{Han}])|\n+")
_MIX = np.array([-7046029254386353131, -4417276706812531889, 1609587929392839161], dtype=np.int64)
_CJK, _LETTER, _NUMBER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"), regex.compile(r"[\p{L}\p{M}]"), regex.compile(r"\p{N}")
#: What a character is: nothing of a word, a letter, a digit, a word by itself, a word by itself unless a digit stands before it; not looked up yet.
NONE, LETTER, DIGIT, SINGLE, SINGLE_DIGIT, UNKNOWN = 0, 1, 2, 3, 4, 255
_KINDS = np.full(0x110000, UNKNOWN, dtype=np.uint8)
_ASCII_KINDS = bytes(LETTER if 97 <= c <= 122 else DIGIT if 48 <= c <= 57 else NONE for c in range(256))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _kind(c: str) -> int:
    if _CJK.match(c):
        return SINGLE_DIGIT if _NUMBER.match(c) else SINGLE
    return LETTER if _LETTER.match(c) else DIGIT if _NUMBER.match(c) else NONE


def _kinds(points: np.ndarray) -> np.ndarray:
    """What each character of a text is, as words.words cuts it; a character is looked up once."""
    kinds = _KINDS[points]
    new = kinds == UNKNOWN
    if new.any():
        for c in np.unique(points[new]).tolist():
            _KINDS[c] = _kind(chr(c))
        kinds = _KINDS[points]
    for i in np.flatnonzero(kinds == SINGLE_DIGIT).tolist():
        kinds[i] = DIGIT if kinds[i - 1] == DIGIT else SINGLE
    return kinds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each word of so many bytes, never 0 or -1, which stand for no word."""
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))
    h = _mix(eight[start] & _FIRST_BYTES[np.minimum(size, 8)])
    left = np.flatnonzero(size > 8)
    for at in range(8, LONG_WORD, 8):
        if not len(left):
            break
        h[left] = _mix(h[left] ^ (eight[start[left] + at] & _FIRST_BYTES[np.minimum(size[left] - at, 8)]))
        left = left[size[left] > at + 8]
    for k in left.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return (h & ~np.uint64(3) | np.uint64(2)).view(np.int64)


def _cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all plain texts, and how many each text has."""
    joined = "\n" + "\n".join(texts) + "\n"
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    if joined.isascii():
        data = joined.encode("ascii")
        kinds = np.frombuffer(data.translate(_ASCII_KINDS), dtype=np.uint8)
        change = kinds[1:] != kinds[:-1]
    else:
        data = joined.encode("utf-8", "surrogatepass")
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _kinds(points)
        change = (kinds[1:] != kinds[:-1]) | (kinds[1:] == SINGLE)
    edge = np.flatnonzero(change) + 1
    inside = np.flatnonzero(kinds[edge] != NONE)
    start, end = edge[inside], edge[inside + 1]
    counts = np.diff(np.searchsorted(start, begin))
    if len(data) > len(joined):
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        start, end = at[start], at[end]
    return _hashes(data, start, end - start), counts


def cut_texts(texts: Iterator[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places of some of the texts, the hashes of their words one behind another, and how many each has; every text comes once. Texts of ASCII are apart, as they are cut faster."""
    held: tuple[list, list] = ([], [])
    size = [0, 0]
    for place, text in enumerate(texts):
        low = plain(text) if text else ""
        wide = not low.isascii()
        held[wide].append((place, low))
        size[wide] += len(low)
        if size[wide] > CUT_TOGETHER:
            yield [p for p, _ in held[wide]], *_cut_words([t for _, t in held[wide]])
            held[wide].clear()
            size[wide] = 0
    for own in held:
        if own:
            yield [p for p, _ in own], *_cut_words([t for _, t in own])


def codes_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    out = [np.zeros(0, dtype=np.int64)] * len(texts)
    for places, codes, counts in cut_texts(texts):
        for place, own in zip(places, np.split(codes, np.cumsum(counts)[:-1])):
            out[place] = own
    return out


def sentences(text: str | None) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text or "") if s.strip()]


def triples(codes: np.ndarray) -> np.ndarray:
    """One number for each three successive words."""
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    t = ((codes[:-2] * _MIX[0] + codes[1:-1]) * _MIX[1] + codes[2:]) * _MIX[2]
    return t ^ (t.view(np.uint64) >> np.uint64(29)).view(np.int64)


def passes(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which keys the bitmap lets through."""
    at = (keys.view(np.uint64) >> np.uint64(39)).view(np.int64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of BITMAP_WORDS words, whatever the number of keys, which Spark adds up."""
    rows = keys.select(F.expr(f"shiftrightunsigned({column}, 45)").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 39) & 63 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP_WORDS, dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out


def least_seeds(n_seeds: int) -> int:
    """How many seeds a pair needs of an item with so many."""
    return max(SEED_LEAST, int(SEED_SHARE * n_seeds))


def few_seeds(keys: np.ndarray, seed: np.ndarray, n_words: int, single: bool) -> bool:
    """Whether some stretch that counts as a passage of an item holds fewer than twice the seeds that a pair needs, if only what is a seed of all items counts.

    keys: the item's triples in order; seed: which of them are seeds."""
    need = 2 * least_seeds(np.unique(keys[seed]).size)
    long = max(1, int(np.ceil((COVERED_SENTENCE if single else COVERED) * n_words)) - 2)
    return bool((distinct_inside(keys, seed, long) < need).any())


def distinct_inside(keys: np.ndarray, seed: np.ndarray, long: int) -> np.ndarray:
    """How many different seeds each run of so many keys holds; of fewer keys, all of them.

    A key counts for the runs that begin behind its last occurrence before and not behind itself."""
    n = len(keys)
    order = np.lexsort((np.arange(n), keys))
    before = np.full(n, -1)
    same = keys[order][1:] == keys[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    at = np.flatnonzero(seed)
    change = np.zeros(n + 2, dtype=np.int64)
    np.add.at(change, np.maximum(before[at], at - long) + 1, 1)
    np.add.at(change, at + 1, -1)
    return np.cumsum(change)[: max(1, n - long + 1)]


class _EqualWords:
    """Where pairs of items and texts, one in each row, have equal words; 0 and -1 are no words."""

    def __init__(self, items: np.ndarray, docs: np.ndarray):
        self.wide, words_of = docs.shape[1], docs.ravel()
        self.row, self.pair = np.nonzero(items.T != 0)
        known, code = np.unique(items[self.pair, self.row], return_inverse=True)
        at = np.searchsorted(known, words_of)
        at[at == len(known)] = 0
        self.cell = np.flatnonzero((known[at] == words_of) & (words_of != -1)) if len(known) else at[:0]
        key = self.cell // self.wide * len(known) + at[self.cell]
        order = np.argsort(key, kind="stable")
        self.cell, key, sought = self.cell[order], key[order], self.pair * len(known) + code
        self.low = np.searchsorted(key, sought)
        self.n = np.searchsorted(key, sought, side="right") - self.low
        self.begin = np.searchsorted(self.row, np.arange(items.shape[1] + 1))

    def blocks(self) -> Iterator[tuple[int, int]]:
        """From which to which row, so that all rows are in one, with TOGETHER equal words or one row in each."""
        until, start = np.concatenate([[0], np.cumsum(self.n)])[self.begin], 0
        while start < len(until) - 1:
            end = max(start + 1, int(np.searchsorted(until, until[start] + TOGETHER, side="right")) - 1)
            yield start, end
            start = end

    def of_rows(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, row and column of the equal words of these rows, by row, pair and column."""
        own = slice(self.begin[start], self.begin[end])
        n = self.n[own]
        cell = self.cell[np.repeat(self.low[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.repeat(self.pair[own], n), np.repeat(self.row[own], n), cell % self.wide


def _align_once(items: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """items, weight: pairs x item words, docs: pairs x text words; 0 and -1 are no words. Per pair: score, equal words, last row, first and last column.

    An equal word earns its weight; another one in its place, or none, costs it. So a turn of phrase with other names in it comes to nothing. A cell
    packs score, equal words and where its alignment began into one integer, so maxima carry them along.

    A cell stands for its value and what inserting all words before it and leaving out all of the item's would cost. So both come for nothing, as maxima along a row and
    from row to row. Alignments begin and are best at equal words, which are few; elsewhere a value may sink below that of none, as an equal word behind it then begins anew."""
    (n, wide), tall = docs.shape, items.shape[1]
    column, equal = wide.bit_length(), tall.bit_length()
    assert (2 * (RAREST * tall + INSERTED * (wide + 1))).bit_length() + column + equal < 63, "windows are cut so that scores fit"
    one = 1 << (column + equal)
    inserted, left_out = np.arange(wide + 1) * (INSERTED * one), np.cumsum(weight, axis=1) * one
    other = np.minimum(weight, INSERTED).T * one
    before, now = np.tile(inserted, n), np.zeros(n * (wide + 1), dtype=np.int64)
    out, best, found = np.zeros((n, 5), dtype=np.int64), np.zeros(n, dtype=np.int64), _EqualWords(items, docs)
    for start, end in found.blocks():
        pair, row, at = found.of_rows(start, end)
        own = weight[pair, row] * one
        none = inserted[at] + left_out[pair, row] - own
        gain, least, begin = 2 * own + INSERTED * one + (1 << column), none + one, none + at
        cell, steps = pair * (wide + 1) + at, np.searchsorted(row, np.arange(start, end + 1)).tolist()
        value = np.zeros(len(cell), dtype=np.int64)
        for i, a, b in zip(range(start, end), steps, steps[1:]):
            np.add(before[:-1], np.repeat(other[i], wide + 1)[1:], out=now[1:])
            if a < b:
                diagonal = before[cell[a:b]]
                value[a:b] = now[cell[a:b] + 1] = np.where(diagonal < least[a:b], begin[a:b], diagonal) + gain[a:b]
            now[:: wide + 1] = 0
            np.maximum(now, before, out=now)
            square = now.reshape(n, wide + 1)
            np.maximum.accumulate(square, axis=1, out=square)
            before, now = now, before
        value -= none + own + INSERTED * one
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            k = order[a + value[order[a:b]].argmax()]
            if value[k] > best[pair[k]]:
                best[pair[k]] = v = value[k]
                out[pair[k]] = v >> (column + equal), (v >> column) & ((1 << equal) - 1), row[k], v & ((1 << column) - 1), at[k]
    return out


def windows(codes: np.ndarray, seeds: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """From where to where a text is compared with an item of so many words: the parts near a seed, long ones in pieces.

    No alignment is longer than span, as inserted words cost; pieces overlap by that, so each possible stretch lies wholly in one."""
    reach, span = 2 * n_words, n_words + RAREST * n_words // INSERTED + 1
    long, out = max(4096, 2 * span), []
    for p in np.split(seeds, np.flatnonzero(np.diff(seeds) > 2 * reach) + 1):
        start, end = max(0, int(p[0]) - reach), min(len(codes), int(p[-1]) + reach + 3)
        while end - start > long:
            out.append((start, start + long))
            start += long - span
        out.append((start, end))
    return out


class Pair:
    """An item, or a part of one, and the windows of a text."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray, text: np.ndarray, at: list[tuple[int, int]]):
        self.codes, self.weight, self.text, self.at = codes.copy(), weight, text.copy(), at

    def take(self, last_row: int, first: int, last: int) -> None:
        """Takes the words of a stretch out of the item, from its last row upwards, and out of the text."""
        used, row, codes = self.text[first : last + 1].tolist(), last_row, self.codes[: last_row + 1].tolist()
        self.text[first : last + 1] = -1
        for w in reversed(used):
            if w != -1:
                for k in range(row, max(-1, row - 9), -1):
                    if codes[k] == w:
                        codes[k] = 0
                        row = max(0, k - 1)
                        break
        self.codes[: last_row + 1] = codes


def _best(pairs: list[Pair], cells: int) -> list[tuple[int, int, int, int, int]]:
    """Score, equal words, last row, first and last word of the best stretch of each pair over its windows."""
    pieces = sorted(((p, a, b) for p, pair in enumerate(pairs) for a, b in pair.at), key=lambda x: ((x[2] - x[1]) // 64, len(pairs[x[0]].codes), x))
    best, start = [(0, 0, 0, 0, 0)] * len(pairs), 0
    while start < len(pieces):
        end, wide = start, 0
        while end < len(pieces) and (end == start or (end - start + 1) * max(wide, pieces[end][2] - pieces[end][1]) <= cells):
            wide = max(wide, pieces[end][2] - pieces[end][1])
            end += 1
        group = pieces[start:end]
        tall = max(len(pairs[p].codes) for p, _, _ in group)
        a, w, b = np.zeros((len(group), tall), dtype=np.int64), np.zeros((len(group), tall), dtype=np.int64), np.full((len(group), wide), -1, dtype=np.int64)
        for k, (p, x, y) in enumerate(group):
            pair = pairs[p]
            a[k, : len(pair.codes)], w[k, : len(pair.codes)], b[k, : y - x] = pair.codes, pair.weight, pair.text[x:y]
        for (p, x, _), (score, equal, row, first, last) in zip(group, _align_once(a, w, b).tolist()):
            if score > best[p][0]:
                best[p] = (score, equal, row, x + first, x + last)
        start = end
    return best


def _most_equal(item: np.ndarray, text: np.ndarray) -> int:
    """How many words an alignment can have equal at most: words of both, each as often as it stands in either."""
    own, n = np.unique(item[item != 0], return_counts=True)
    if not len(own):
        return 0
    at = np.searchsorted(own, text)
    at[at == len(own)] = 0
    return int(np.minimum(np.bincount(at[own[at] == text], minlength=len(own)), n).sum())


def covered(pairs: list[Pair], cells: int = 32_000, enough: list[int | None] | None = None) -> list[int]:
    """How many words of each item one or two stretches of its text hold in order. cells: of one array, so that all of them fit a core's cache.

    enough: of each pair, unless it is a part of a longer item, the number from which on it doesn't matter how many; a search ends there, and where so many can't be reached."""
    total, left, goal = [0] * len(pairs), list(range(len(pairs))), enough or [None] * len(pairs)
    for again in (False, True):
        found = list(zip(left, _best([pairs[p] for p in left], cells)))
        left = []
        for p, (_, equal, row, first, last) in found:
            if equal < STRETCH_WORDS:
                continue
            total[p] += equal
            if again or goal[p] is not None and total[p] >= goal[p]:
                continue
            pairs[p].take(row, first, last)
            if goal[p] is None or total[p] + _most_equal(pairs[p].codes, pairs[p].text) >= goal[p]:
                left.append(p)
    return total


def pairs_of(codes: np.ndarray, item: np.ndarray, weight: np.ndarray, keys: np.ndarray | None = None) -> list[Pair]:
    """The pairs of a text with an item; an item of more than PART_WORDS words has several. keys: the text's triples, where they are known."""
    keys, out = triples(codes) if keys is None else keys, []
    for k in range(0, len(item), PART_WORDS):
        own = item[k : k + PART_WORDS]
        sought = np.unique(triples(own))
        if not len(sought):
            continue
        near = np.searchsorted(sought, keys)
        near[near == len(sought)] = 0
        at = np.flatnonzero(sought[near] == keys)
        if len(at):
            spans = windows(codes, at, len(own))
            low = spans[0][0]
            out.append(Pair(own, weight[k : k + PART_WORDS], codes[low : max(b for _, b in spans)], [(a - low, b - low) for a, b in spans]))
    return out


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _item_sentences(items: DataFrame) -> DataFrame:
    """item_id, pos, sentence; of a repeated item_id the smallest text counts."""
    schema = "item_id long, pos int, sentence string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for k, s in enumerate(sentences(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, _arrow(schema))], schema=_arrow(schema))

    once = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return once.mapInArrow(look, schema)


def _item_words(kept: DataFrame) -> DataFrame:
    """kept: item_id, own (sentences in order). item_id, codes, keys (its triples in order), single, of items with words."""
    schema = "item_id long, codes array<long>, keys array<long>, single boolean"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, said = [], b.column("own").to_pylist()
            for item, own, codes in zip(b.column("item_id").to_pylist(), said, codes_of([" \n ".join(own) for own in said])):
                if len(codes):
                    rows.append((item, codes, triples(codes), len([s for s in own if len(words(s)) > 2]) <= 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _arrow(schema))], schema=_arrow(schema))

    return kept.mapInArrow(look, schema)


def prepared(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_id, codes, keys, single of each item without the stock instructions, and its seeds: t, item_id, least (seeds that a pair needs).

    What is a stock instruction and what a turn of phrase is counted over all items."""
    said = cut(_item_sentences(items))
    stock = said.where("pos < 3").select("item_id", "sentence").distinct().groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK_ITEMS)
    own = said.join(stock, "sentence", "left_anti").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("own"))
    known = cut(_item_words(own.select("item_id", F.col("own.sentence").alias("own"))))
    at, seen = cut_measured(known.select("item_id", F.posexplode("keys").alias("pos", "t")), n=F.count(F.lit(1)))
    held = at.groupBy("t").agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_rows")).select(F.col("t").alias("_t"), (F.col("n_items") < STOCK_ITEMS).alias("seed"), (F.col("n_rows") > seen["n"] * HOT).alias("_hot"))
    marked = meet(at, "t", cut(held), "_t", F.col("_hot")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "seed"))).alias("k"))
    schema = "item_id long, t long, least int"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ts, least = [], [], []
            for item, keys, seed, n, single in zip(*(b.column(c).to_pylist() for c in ("item_id", "keys", "seed", "n", "single"))):
                keys, seed = np.array(keys, dtype=np.int64), np.array(seed, dtype=bool)
                own = np.unique(keys if few_seeds(keys, seed, n, single) else keys[seed])
                ids.append(np.full(len(own), item, dtype=np.int64))
                ts.append(own)
                least.append(np.full(len(own), least_seeds(len(own)), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip((ids, ts, least), _arrow(schema))], schema=_arrow(schema))

    ready = marked.select("item_id", F.col("k.t").alias("keys"), F.col("k.seed").alias("seed")).join(known.select("item_id", F.size("codes").alias("n"), "single"), "item_id")
    return known, cut(ready.mapInArrow(look, schema))


def weights(known: DataFrame, n_words: DataFrame, n_docs: int) -> DataFrame:
    """known: item_id, codes, single; n_words: w, n_docs. item_id, codes, single, weight (one for each word), many.

    Names stand in one item and few documents; a turn of phrase in many items, however rare its language is in the corpus."""
    at, seen = cut_measured(known.select("item_id", F.posexplode("codes").alias("pos", "w")), n=F.count(F.lit(1)))
    n_items = known.count()
    held = at.groupBy("w").agg(F.countDistinct("item_id").alias("in_items"), F.count("*").alias("n_rows")).join(n_words.withColumnRenamed("w", "_v"), F.col("w") == F.col("_v"), "left")
    of_docs = 1 - F.log1p(F.coalesce("n_docs", F.lit(0))) / F.log(F.lit(n_docs + 2.0))
    of_items = 1 - F.log(F.col("in_items").cast("double")) / F.log(F.lit(max(n_items + 1.0, 2.0)))
    weight = F.greatest(F.lit(COMMONEST), F.least(F.lit(RAREST), F.rint(RAREST * of_docs * of_items * of_items).cast("int")))
    few = cut(held.select(F.col("w").alias("_w"), weight.alias("weight"), (F.col("n_rows") > seen["n"] * HOT).alias("_hot")))
    rows = meet(at, "w", few, "_w", F.col("_hot")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "weight")))["weight"].alias("weight"))
    return known.select("item_id", "codes", "single").join(rows, "item_id")


def _docs_of(codes: np.ndarray, doc: np.ndarray, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word that the bitmap lets through, and in how many texts it stands. codes, doc: words of texts in order and the text of each."""
    through = passes(codes, of_words)
    codes, doc = codes[through], doc[through]
    order = np.argsort(codes, kind="stable")
    codes, doc = codes[order], doc[order]
    other = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    first = other.copy()
    first[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(other)
    return codes[at], np.add.reduceat(first, at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word of several counts once, with their sum."""
    if not counted:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w, at = np.unique(np.concatenate([w for w, _ in counted]), return_inverse=True)
    n = np.zeros(len(w), dtype=np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in counted]))
    return w, n


def _distinct_seeds(codes: np.ndarray, doc: np.ndarray, of_seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number of each different triple of a text that the bitmap lets through, by text and number."""
    keys = triples(codes)
    at = np.flatnonzero(passes(keys, of_seeds))
    at = at[doc[at] == doc[at + 2]]
    keys, own = keys[at], doc[at]
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])[: len(keys)]
    return own[fresh], keys[fresh]


def _seed_pass(docs: DataFrame, shared) -> DataFrame:
    """doc_id, seeds of each document with enough triples that the bitmap of seeds lets through; and with a null doc_id, per batch, how many documents hold each word of an item."""
    schema = "doc_id long, seeds array<long>, words array<long>, n_docs array<long>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_seeds, of_words = shared.value
        for b in batches:
            docs = b.column("doc_id").to_numpy()
            ids, sizes, held, counted = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
            for places, codes, counts in cut_texts(x.as_py() for x in b.column("text")):
                doc = np.repeat(np.arange(len(counts)), counts)
                counted.append(_docs_of(codes, doc, of_words))
                own, keys = _distinct_seeds(codes, doc, of_seeds)
                n = np.bincount(own, minlength=len(counts))
                enough = n >= SEED_LEAST
                ids.append(docs[np.array(places)[enough]])
                sizes.append(n[enough])
                held.append(keys[enough[own]])
            w, n = _summed(counted)
            ids, seeds = np.concatenate(ids), pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(held)))
            none = pa.nulls(len(ids), pa.list_(pa.int64()))
            columns = [pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(1, pa.int64())]), pa.concat_arrays([seeds.cast(none.type), pa.nulls(1, none.type)]), *(pa.concat_arrays([none, pa.array([x], none.type)]) for x in (w, n))]
            yield pa.RecordBatch.from_arrays(columns, schema=_arrow(schema))

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(look, schema)


def needed(n_words: int, single: bool) -> int:
    """How many equal words make a passage of an item of so many words."""
    share = COVERED_SENTENCE if single else COVERED
    least = int(share * n_words)
    return least if least / n_words >= share else least + 1


def _near(near: pa.ListArray) -> list[list[tuple[int, np.ndarray, np.ndarray, bool]]]:
    """Of each row item_id, codes, weight and single of its items, without a Python object for each word."""
    fields = dict(zip((f.name for f in near.type.value_type), near.flatten().flatten()))
    codes, weight = (np.split(x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy())[:-1]) for x in (fields["codes"], fields["weight"]))
    items, at, out = list(zip(fields["item_id"].to_pylist(), codes, weight, fields["single"].to_pylist())), 0, []
    for n in near.value_lengths().to_pylist():
        out.append(items[at : at + n])
        at += n
    return out


def _align_pass(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text, near (structs of item_id, codes, weight, single). doc_id, item_id, equal, n_words, single of every candidate pair.

    equal reaches what is needed for every passage and for nothing else; it is not counted further where that is reached or out of reach."""
    schema = "doc_id long, item_id long, equal int, n_words int, single boolean"

    def flush(held: list) -> pa.RecordBatch:
        parts = [p for *_, own in held for p in own]
        equal = iter(covered(parts, enough=[needed(n, single) if len(own) == 1 else None for _, _, n, single, own in held for _ in own]))
        rows = [(doc, item, sum(next(equal) for _ in own), n, single) for doc, item, n, single, own in held]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _arrow(schema))], schema=_arrow(schema))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, near, held, size = b.column("doc_id").to_pylist(), _near(b.column("near")), [], 0
            for places, flat, counts in cut_texts(x.as_py() for x in b.column("text")):
                for place, codes in zip(places, np.split(flat, np.cumsum(counts)[:-1])):
                    keys = triples(codes)
                    for item, own_codes, weight, single in near[place]:
                        own = pairs_of(codes, own_codes, weight, keys)
                        held.append((ids[place], item, len(own_codes), single, own))
                        size += sum(len(p.text) for p in own)
                        if size > TOGETHER:
                            yield flush(held)
                            held, size = [], 0
            yield flush(held)

    return texts.select("doc_id", "text", "near").mapInArrow(look, schema)


def _hot(rows: DataFrame, key: str, n: int) -> Column:
    """A struct of keys with more than their share of the rows."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > n * HOT).select("_key", F.lit(True).alias("_hot"))


def aligned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. doc_id, item_id, equal (see _align_pass), n_words, single for every pair with enough seeds.

    Null, empty and wordless texts have no pairs; of a repeated item_id one text counts; other columns are ignored. Without items there are no pairs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known, seeds = prepared(items)
    shared = spark.sparkContext.broadcast((bitmap_of(seeds, "t"), bitmap_of(known.select(F.explode("codes").alias("w")), "w")))
    held, seen = cut_measured(_seed_pass(docs, shared), n=F.sum(F.size("seeds")))
    n_words = held.where("doc_id is null").select(F.explode(F.arrays_zip("words", "n_docs")).alias("x")).groupBy(F.col("x.words").alias("w")).agg(F.sum("x.n_docs").alias("n_docs"))
    weighted = cut(weights(known, n_words, docs.count()))
    hits = held.where("doc_id is not null").select("doc_id", F.explode("seeds").alias("t"))
    of_seed = seeds.groupBy(F.col("t").alias("_t")).agg(F.collect_list(F.struct("item_id", "least")).alias("near")).join(_hot(hits, "t", seen["n"]), F.col("_t") == F.col("_key"), "left").select("_t", "near", F.coalesce("_hot", F.lit(False)).alias("_hot"))
    counted = meet(hits, "t", cut(of_seed), "_t", F.col("_hot")).select("doc_id", F.inline("near")).groupBy("doc_id", "item_id", "least").agg(F.count("*").alias("n"))
    near, seen = cut_measured(counted.where("n >= least").select("doc_id", "item_id"), n=F.count(F.lit(1)))
    own = weighted.join(_hot(near, "item_id", seen["n"]), F.col("item_id") == F.col("_key"), "left").select(F.struct("item_id", "codes", "weight", "single").alias("item"), F.col("item_id").alias("_id"), F.coalesce("_hot", F.lit(False)).alias("_hot"))
    gathered = meet(near, "item_id", own, "_id", F.col("_hot")).groupBy("doc_id").agg(F.collect_list("item").alias("near"))
    close = sieve(docs.where("text is not null").withColumn("_h", F.xxhash64("doc_id")), near.select(F.xxhash64("doc_id").alias("_h")), "_h").drop("_h")
    return _align_pass(close.join(gathered, "doc_id"))


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document that holds a passage of an item, by the shares that needed goes by."""
    share = F.col("equal") / F.col("n_words")
    return aligned(docs, items).where(share >= F.when(F.col("single"), COVERED_SENTENCE).otherwise(COVERED)).select("doc_id", "item_id").distinct()
