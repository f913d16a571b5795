"""Keyword-stuffed pages and link lists, by a hidden Markov model over the lines of a page.

Lines are joined or split into segments of similar length. What a segment looks like (function words, links, repeated words, separators, code) is
one of a few symbols; the states are prose (with code, logs, data), link list, tag list and menu. One pass over the texts writes the symbols of each
document. The model starts from stated beliefs and is fitted to the symbols of all documents: in each round of expectation maximisation tasks count and
Spark adds up. The likeliest states of every document then give its share of words outside prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut

#: Rounds of the fit, and the weight of the beliefs it starts from as a share of the data.
FIT_ROUNDS, BELIEF = 6, 0.5
#: Characters of a segment, at least and at most.
SHORT, LONG = 60, 220
#: Characters of the texts that a task looks at together.
TOGETHER = 4_000_000
#: A page with more than this share of its words outside prose is flagged.
FLAGGED = 0.5

STATES = ("prose", "links", "tags", "menu")
#: Function words of several languages, which sentences cannot do without.
FUNCTION_WORDS = frozenset(
    "the a an of and to is was are were be been has have had that which who this these those it its by from into with when if then than as or nor but not never "
    "may must can cannot should would will shall do does did at on only before after since once so our we you they there what where why how least all each every nobody both while "
    "der die das und ist nicht von zu den dem des ein eine einer einem keine mehr als nach für auch wenn wer dann wird werden sobald über ohne seit mal zuerst danach höchstens jede mit auf sich "
    "el la los las de del que y en un una su sus cuando si cada antes desde hasta mientras nadie tras sin pasa vale con por para es no se lo "
    "и в не на с а если когда после без больше затем равно дольше как что это из к по от до для же то "
    "le les des et est une dans qui pour pas il elle sur au aux ne ce cette il che di e per non una sono della com não os uma dos ao em do "
    "في من على إلى عن أن لا ما هذا التي الذي مع كل 的 了 在 是 如 果 当 则 先 再 会 由 每 次 一 为 时 和 与 也 都 就 を は が の に で と も し た す る".split()
)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w.@(\"])(?:[a-z0-9-]+\.)+[a-z]{2,}/[^\s<>\"')\]]+")
_TAG = re.compile(r"<(?:a\s[^<>]*?href\s*=\s*[\"']?([^\"'<>\s]*)[^<>]*|/?[a-zA-Z][^<>]*)>")
_SEPARATOR = re.compile(r"[,|/•;+~_>·★\n]|\s-\s|\s\*\s|#(?=\w)")
#: The separators that are one ASCII character, and what the others need; both say no more than _SEPARATOR, but faster.
_ASCII_SEPARATORS, _SPACED = b",|/;+~_>\n", re.compile(r"[-*#]")
_MENU = re.compile(r"[>|»›·•]")
_CODE = re.compile(
    r"^\s*(?:import|package)\s+[\w.*]+;|\w\([^()]*\)|[{}]|\s[=!<>]?=\s|\breturn\b.*;|^\s*(?:at\s)?[\w$.]+\.[\w$]+\(|^\d{4}-\d\d-\d\d[T ]|^\s*[\w.-]+:\s*[^\s,]*\s*(?:#.*)?$|^\s*[\w.-]+=\S*\s*$|^\s*(?://|/?\*\*?\s|@\w)", re.M)
#: A character that each way of being code needs.
_MARKS = re.compile(r"[({}=:;@*/]|\d-")
_DIGIT = re.compile(r"\d")
#: What follows the words of an entry in a tag cloud or a list of names with versions; it parts entries and is no data of its own.
_ENTRY = re.compile(r"(?<=[^\W\d] )(?:\(\d+\)|\d{1,3}\.\d{1,3}(?![.\d]))")
#: Encoded data: a long run without blanks that mixes letters with digits.
_PACKED = re.compile(r"(?=[A-Za-z+/=]*\d)[A-Za-z0-9+/=]{50,}")
_ASCII_WORD = re.compile(r"[a-z]+|[0-9]+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+|\p{N}+")

#: fn 3 x link 2 x repeated 2 x separated 2 x menu 2, then code and data.
N_SYMBOLS = 50
CODE, DATA = 48, 49


def _beliefs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, transition and emission probabilities before any fit. Features are taken as independent within a state."""
    #        function words       link  repeat  separated  menu   code  data
    rows = [((0.80, 0.15, 0.05), 0.10, 0.15, 0.20, 0.10, 0.25, 0.05), ((0.05, 0.15, 0.80), 0.97, 0.40, 0.50, 0.40, 0.02, 0.01), ((0.01, 0.09, 0.90), 0.05, 0.90, 0.70, 0.15, 0.01, 0.01), ((0.01, 0.09, 0.90), 0.15, 0.80, 0.95, 0.95, 0.01, 0.01)]
    emit = np.zeros((4, N_SYMBOLS))
    for s, (fn, *yes, code, data) in enumerate(rows):
        for k in range(48):
            p, rest = fn[k // 16], k % 16
            for bit, q in zip((8, 4, 2, 1), yes):
                p *= q if rest & bit else 1 - q
            emit[s, k] = p * (1 - code - data)
        emit[s, CODE], emit[s, DATA] = code, data
    move = np.full((4, 4), 0.03)
    np.fill_diagonal(move, 0.91)
    return np.array([0.7, 0.1, 0.1, 0.1]), move, emit


def segments(text: str) -> list[str]:
    """The lines of a text, short ones joined and long ones split at blanks, so that no segment is much longer than LONG.

    Each character is looked at a bounded number of times, however long its line is."""
    out, held, size = [], [], 0
    for line in text.splitlines():
        line = line.rstrip()
        if size and (size >= SHORT or not line or len(line) > LONG):
            out.append("\n".join(held))
            held, size = [], 0
        at, end = 0, len(line)
        while end - at > LONG:
            cut = line.find(" ", at + LONG * 3 // 4, at + LONG * 3 // 2 + 1)
            cut = at + LONG if cut < 0 else cut
            out.append(line[at:cut])
            at = cut
        if at < end:
            held.append(line[at:])
            size += end - at
    if size:
        out.append("\n".join(held))
    return out


def observe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: how many segments each has, and of all segments the symbols and the numbers of words."""
    n_segments, n_links, n_seps, n_menu, coded, sizes = [], [], [], [], [], []
    flat: list[list[str]] = []
    n_url_words, packed = [], []
    for text in texts:
        text = text or ""
        links_kept = "<" in text
        if links_kept:
            text = _TAG.sub(lambda m: f" http://{m[1].replace('https://', '').replace('http://', '')} " if m[1] else " ", text)
        own = segments(text)
        n_segments.append(len(own))
        for s in own:
            links = 0
            inside = 0
            if "/" in s:
                found = _URL.findall(s)
                if found:
                    links = len(found)
                    inside = sum(len(_ASCII_WORD.findall(u)) for u in found)
                    s = _URL.sub(" ", s)
            if _DIGIT.search(s):
                s = _ENTRY.sub(" ; ", s)
                packed.append(max(map(len, s.split())) >= 50 and _PACKED.search(s) is not None)
            else:
                packed.append(False)
            low = s.lower()
            w = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
            flat.append(w)
            sizes.append(len(w))
            n_links.append(links)
            n_url_words.append(inside)
            if low.isascii() and not _SPACED.search(s):
                raw = s.encode()
                n_seps.append(len(raw) - len(raw.translate(None, _ASCII_SEPARATORS)))
                n_menu.append(len(raw) - len(raw.translate(None, b">|")))
            else:
                n_seps.append(len(_SEPARATOR.findall(s)))
                n_menu.append(len(_MENU.findall(s)))
            breaks = s.count("\n")
            # beside links nothing counts as code; of one line a single mark is enough
            coded.append(not links and _MARKS.search(s) is not None and (len(_CODE.findall(s)) >= 1 + breaks * 0.5 if breaks else _CODE.search(s) is not None))
    counts = np.array(n_segments, dtype=np.int64)
    n = len(flat)
    if not n:
        return counts, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = np.array(sizes, dtype=np.int64)
    vocabulary: dict[str, int] = {}
    codes = np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in chain.from_iterable(flat)), dtype=np.int64, count=int(size.sum()))
    names = list(vocabulary)
    function = np.fromiter((x in FUNCTION_WORDS for x in names), dtype=bool, count=len(names))
    number = np.fromiter((x[0].isdigit() or len(x) > 40 for x in names), dtype=bool, count=len(names))
    segment = np.repeat(np.arange(n), size)
    doc = np.repeat(np.arange(len(texts)), counts)[segment]
    content = ~function[codes] & ~number[codes]
    keys = doc * len(names) + codes
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    often = content & (times[place] >= 4)
    total = lambda mask: np.bincount(segment[mask], minlength=n)
    some = np.maximum(size, 1)
    fn, numbers = total(function[codes]) / some, total(number[codes]) / some
    repeated = total(often) / np.maximum(total(content), 1)
    links, seps, menu = np.array(n_links), np.array(n_seps), np.array(n_menu)
    kind = np.where(fn >= 0.18, 0, np.where(fn >= 0.07, 1, 2))
    symbol = kind * 16 + 8 * (links * 8 >= some) * (links > 0) + 4 * (repeated >= 0.5) + 2 * (seps * 4 >= some) + 1 * (menu * 6 >= some)
    # code and data don't show links or separators of their own
    symbol = np.where(np.array(coded) & (links == 0), CODE, symbol)
    symbol = np.where(((numbers >= 0.5) & (links == 0)) | np.array(packed), DATA, symbol)
    return counts, symbol.astype(np.int64), size + np.array(n_url_words, dtype=np.int64)


def expected(counts: np.ndarray, symbols: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often, as the model expects it, each state comes first, follows each other one and shows each symbol (Baum and Welch), over all texts of a batch side by side."""
    first, move, emit = model
    counts = counts[counts > 0]
    order = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    # the segments in the order of their place, and at each place those of the longest texts first
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    bounds = np.concatenate([[0], np.cumsum(active)])
    s = np.concatenate([symbols[starts[:n] + t] for t, n in enumerate(active)]) if len(active) else symbols[:0]
    e, alpha = emit.T[s], np.empty((len(s), 4))
    scale = np.empty((len(s), 1))
    for t in range(len(active)):
        own = slice(bounds[t], bounds[t + 1])
        a = e[own] * (first if t == 0 else alpha[bounds[t - 1] : bounds[t - 1] + active[t]] @ move)
        scale[own] = a.sum(axis=1, keepdims=True)
        alpha[own] = a / scale[own]
    ahead, gamma = e / scale, alpha
    c_move = np.zeros((4, 4))
    beta = np.ones((0, 4))
    for t in range(len(active) - 1, -1, -1):
        own = slice(bounds[t], bounds[t + 1])
        here = np.ones((active[t], 4))
        if len(beta):
            after = ahead[bounds[t + 1] : bounds[t + 1] + len(beta)] * beta
            c_move += move * (alpha[bounds[t] : bounds[t] + len(beta)].T @ after)
            here[: len(beta)] = after @ move.T
        beta = here
        gamma[own] = alpha[own] * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    c_emit = np.stack([np.bincount(s, weights=gamma[:, k], minlength=N_SYMBOLS) for k in range(4)])
    return gamma[: active[0] if len(active) else 0].sum(axis=0), c_move, c_emit


def fit(sequences: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sequences: symbols (array). First, transition and emission probabilities by rounds over all of them, the beliefs counting as part of the data; the beliefs
    where there are none. What comes back from a task is 220 numbers."""
    first, move, emit = beliefs = _beliefs()
    for _ in range(FIT_ROUNDS):
        model = (first, move, emit)

        def look(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 + 16 + 4 * N_SYMBOLS + 1)
            for b in batches:
                column = b.column("symbols")
                counts = np.diff(column.offsets.to_numpy())
                c_first, c_move, c_emit = expected(counts, column.flatten().to_numpy().astype(np.int64), model)
                total += np.concatenate([c_first, c_move.ravel(), c_emit.ravel(), [np.count_nonzero(counts)]])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "n": pa.array(total)})

        total = np.zeros(4 + 16 + 4 * N_SYMBOLS + 1)
        for at, x in sequences.select("symbols").mapInArrow(look, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[at] = x
        segments_, docs = total[20:-1].sum(), total[-1]
        if not segments_:
            return beliefs
        c_first = total[:4] + beliefs[0] * docs * BELIEF
        c_move = total[4:20].reshape(4, 4) + beliefs[1] * segments_ / 4 * BELIEF
        c_emit = total[20:-1].reshape(4, -1) + beliefs[2] * segments_ / 4 * BELIEF
        first, move, emit = c_first / c_first.sum(), c_move / c_move.sum(axis=1, keepdims=True), c_emit / c_emit.sum(axis=1, keepdims=True)
    return first, move, emit


def likeliest(counts: np.ndarray, symbols: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The likeliest state of each segment (Viterbi), for all texts of a batch side by side."""
    first, move, emit = (np.log(np.maximum(x, 1e-12)) for x in model)
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    states = np.zeros(len(symbols), dtype=np.int64)
    deepest = int(lengths[0]) if len(lengths) else 0
    back, score = [], None
    for t in range(deepest):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        e = emit[:, symbols[starts[:active] + t]].T
        if t == 0:
            score = first + e
            back.append(None)
        else:
            ways = score[:active, :, None] + move
            back.append(ways.argmax(axis=1))
            score = np.concatenate([ways.max(axis=1) + e, score[active:]])
    if deepest:
        state = score.argmax(axis=1)
        for t in range(deepest - 1, -1, -1):
            active = int(np.searchsorted(-lengths, -t, side="left"))
            states[starts[:active] + t] = state[:active]
            if t:
                state[:active] = back[t][np.arange(active), state[:active]]
    return states


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of TOGETHER characters, or one longer text, each with its place."""
    start, n = 0, 0
    for k, text in enumerate(texts):
        more = len(text or "")
        if k > start and n + more > TOGETHER:
            yield start, texts[start:k]
            start, n = k, 0
        n += more
    if texts:
        yield start, texts[start:]


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and the words of each document in links, tags and menus.

    Null, empty and blank texts have no words; a repeated doc_id gives a row each time; other columns are ignored; an empty table has no rows."""
    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _parts(b.column("text").to_pylist()):
                counts, symbols, size = observe(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((symbols, pa.int8()), (size, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(texts)), *lists], names=["doc_id", "symbols", "sizes"])

    seen = cut(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(see, "doc_id long, symbols array<byte>, sizes array<int>"))
    model = fit(seen)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, size = b.column("symbols"), b.column("sizes").flatten().to_numpy()
            counts = np.diff(column.offsets.to_numpy())
            states = likeliest(counts, column.flatten().to_numpy().astype(np.int64), model)
            doc = np.repeat(np.arange(b.num_rows), counts)
            of = {s: np.bincount(doc, weights=size * (states == k), minlength=b.num_rows).astype(np.int64) for k, s in enumerate(STATES)}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(sum(of.values())), "links": pa.array(of["links"]), "tags": pa.array(of["tags"]), "menu": pa.array(of["menu"])})

    return seen.mapInArrow(look, "doc_id long, n_words long, links long, tags long, menu long")


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id of each page with more than FLAGGED of its words in links, tags and menus."""
    return shares(docs).where(F.col("links") + F.col("tags") + F.col("menu") > FLAGGED * F.col("n_words")).select("doc_id").distinct()
