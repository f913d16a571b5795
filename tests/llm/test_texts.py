"""The operators on texts against libraries, brute force and made cases."""

import os
import random
import time

import numpy as np
import pytest

from graphloom.llm import leaks, pairs, queries, spam, tokenize
from graphloom.llm.words import words
from tests.conftest import DATA, rows

VOCABULARY = os.path.join(tokenize.VOCABULARIES, "byte_bpe_50k.json")
ODD = ["", " ", "\n\n \t", "a" * 1500, "ab" * 900 + " x", "é" * 600, "don't <|endoftext|>  stop", "漢字かな 日本語", "🚀👩‍💻 x́y", "1234567 8", "  a\r\n\r\n b ", "x\x00y", "aaaaaaaaa aaaa aaa aa a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_match_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {10**9 + k: t for k, t in enumerate(ODD)} | {-1: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(df).collect()}
    expected = library([t or "" for t in texts.values()])
    assert found == dict(zip(texts, expected)) and found[-1] == [] and found[10**9] == []


def test_long_words_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(tokenize, "REMEMBERED", 5)
    monkeypatch.setattr(tokenize, "LONG_WORD", 12)
    encoder, rnd = tokenize.Encoder(tokenize.Merges(VOCABULARY)), random.Random(2)
    texts = ["".join(rnd.choice("aabehnrst ") for _ in range(rnd.randrange(60))) for _ in range(300)]
    ids = []
    for k in range(0, 300, 50):
        flat, counts = encoder.encode([encoder.words(t) for t in texts[k : k + 50]])
        ids += [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])]
    assert ids == library(texts)


SAYS = [
    ("a.B#setLimit(int)", "void setLimit(int max)", "/** Sets the limit, unless the pool is closed. */"), ("a.B#open()", "void open()", "Costs one seek per row."), ("a.B#run()", "void run()", "@return the run, or null while the queue is empty"),
    ("a.B#go()", "void go()", "///  {@inheritDoc}\n/// Keeps one lock per table."), ("a.B#x()", "int x()", "* @throws IoException if the disk is full or gone"), ("a.B#z()", "int z()", "当配额超过793行时,先统计快照,再统计缓存。"), ("a.B#w()", "int w()", "@deprecated slower than the pool; use Pool instead"),
    ("a.B#<init>()", "B()", "Creates a lease and wakes whoever waits.\nTODO: more"), ("a.B#q()", "int q()", "После 15 строк закрывает шлюз."),
]
SILENT = [
    ("a.B#setLimit(int)", "void setLimit(int max)", "/** Sets the limit. @param max the max */"), ("a.B#setLimit(int)", "void setLimit(int max)", "Sets {@code limit}!\n@param max the max\n@return"), ("a.B#x()", "int x()", "(non-Javadoc)\n@see C#x()"), ("a.B#x()", "int x()", "TODO(team): describe what this slow thing really does"),
    ("a.B#x()", "int x()", "if (x != null) { x.run(); }"), ("a.B#x()", "int x()", "----------"), ("a.B#x()", "int x()", "<p>&nbsp;</p>"), ("a.B#x()", "int x()", "Generated by the record plugin; do not edit."), ("a.Pool$Entry#<init>()", "Entry()", "Creates a new Entry."), ("a.B#x()", "int x()", None), ("a.B#x()", " ", "Keeps one lock per table."),
    ("a.B#x()", None, "Keeps one lock per table."), ("a.B#x()", "int x()", "@since 2.0\n@author Some Body Else"), ("a.B#tallyRows()", "int tallyRows()", "Tallies the rows."), ("a.B#x()", "int x()", ""),
]


@pytest.mark.parametrize("case", SAYS)
def test_documentation_that_tells(case):
    assert pairs.describe(*case)


@pytest.mark.parametrize("case", SILENT)
def test_documentation_that_does_not(case):
    assert pairs.describe(*case) is None


def test_signature():
    f = pairs.parse_signature("a.B#put(java.util.Map,int[])", "public static <T> java.util.Map<K, V> put(final java.util.Map<String, java.util.List<T>> rows, @Min(1) int[] n)")
    assert (f.name, f.owner, f.result, f.modifiers) == ("put", "a.B", "java.util.Map", ["public", "static"])
    assert [n for _, n in f.parameters] == ["rows", "n"]


def test_signature_with_types_in_types():
    f = pairs.parse_signature("a.B#m(Map)", "@Note(x = (1)) protected <T extends Comparable<? super T>> Map<String, List<Set<T>>> m(Map.Entry<String, List<int[]>>.Own<T> é, String... more)")
    assert (f.name, f.result, f.modifiers, f.parameters) == ("m", "Map", ["@Note", "protected"], [("Map.Entry.Own", "é"), ("String", "more")])
    for broken in ("", "(", "x", "void m(List<", "void m(int a", "< > ( ) ,", ")("):
        pairs.parse_signature("a.B#m(int)", broken)


def test_words():
    assert words("Rea­der re-\n * ads conﬁg \\u00e9t\\u00e9 <b>so</b> &amp; A B") == ["reader", "reads", "config", "été", "so", "a", "b"]
    assert words(None) == [] and words("先锁x1") == ["先", "锁", "x", "1"]


def _slow(item, doc, weight):
    """The best local alignment by the plain recurrence: score and equal words of the best cell."""
    n, m = len(item), len(doc)
    best, table = (0, 0), [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        w = weight[item[i - 1]]
        for j in range(1, m + 1):
            s, e = table[i - 1][j - 1]
            same = item[i - 1] == doc[j - 1] and item[i - 1] > 0
            ways = [(s + w, e + 1) if same else (s - max(w, leaks.INSERTED), e), (table[i - 1][j][0] - w, table[i - 1][j][1]), (table[i][j - 1][0] - leaks.INSERTED, table[i][j - 1][1])]
            cell = max(ways)
            table[i][j] = cell if cell[0] > 0 else (0, 0)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_plain_recurrence():
    rnd = random.Random(8)
    weight = np.array([0, *(rnd.randrange(leaks.COMMONEST, leaks.RAREST) for _ in range(12))])
    items = [np.array([rnd.randrange(1, 13) for _ in range(rnd.randrange(1, 14))]) for _ in range(30)]
    docs = [np.array([rnd.randrange(0, 13) for _ in range(rnd.randrange(1, 25))]) for _ in range(30)]
    a, b = np.zeros((30, 14), dtype=np.int64), np.full((30, 25), -1, dtype=np.int64)
    for k in range(30):
        a[k, : len(items[k])], b[k, : len(docs[k])] = items[k], docs[k]
    found = leaks._align_once(a, weight[a], b)[:, 1]
    expected = [_slow(items[k].tolist(), docs[k].tolist(), weight)[1] for k in range(30)]
    assert (found == expected).mean() >= 0.9  # of alignments with equal scores either may be kept


def test_alignment_scores_whatever_is_held_together(monkeypatch):
    rng = np.random.default_rng(11)
    for together in (1, 40, leaks.TOGETHER):
        monkeypatch.setattr(leaks, "TOGETHER", together)
        for _ in range(20):
            items, docs = rng.integers(1, 9, (6, 12)), rng.integers(1, 9, (6, 30))
            items[np.arange(12) >= rng.integers(1, 13, 6)[:, None]] = 0
            weight = np.concatenate([[0], rng.integers(leaks.COMMONEST, leaks.RAREST + 1, 8)])
            found = leaks._align_once(items, weight[items], docs)
            for k in range(6):
                assert found[k, 0] == _slow(items[k][items[k] > 0].tolist(), docs[k].tolist(), weight)[0]


def test_a_passage_is_sought_no_further(monkeypatch):
    rng, asked = np.random.default_rng(12), []
    align = leaks._align_once
    monkeypatch.setattr(leaks, "_align_once", lambda *a: asked.append(len(a[0])) or align(*a))
    item, weight = np.arange(2, 62), np.full(60, leaks.RAREST)
    other = lambda n: rng.integers(10**6, 10**7, n)
    for text, enough, rounds in (([other(50), item[:30], other(50)], 20, 1), ([other(50), item[:15], other(200), item[40:55]], 20, 2), ([other(50), item[:8], other(50)], 20, 1)):
        asked.clear()
        whole = leaks.covered(leaks.pairs_of(np.concatenate(text), item, weight))[0]
        assert (leaks.covered(leaks.pairs_of(np.concatenate(text), item, weight), enough=[enough])[0] >= enough) == (whole >= enough)
        assert len(asked) == 2 + rounds
    for n in range(1, 200):
        for single, share in ((True, leaks.COVERED_SENTENCE), (False, leaks.COVERED)):
            assert leaks.needed(n, single) == next(e for e in range(n + 1) if e / n >= share)


def test_texts_cut_together_have_the_words_of_each(monkeypatch):
    rnd, known = random.Random(13), {}
    odd = "ab1 2\n〇〡x漢かカー゙é́१²½ßⅧ\ud83d🚀\U00020000"
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(30))) for _ in range(600)] + ["x" * n + " " + "é" * n for n in range(140)] + ["x" * 90, "x" * 90 + "y", None, "", "\n", "Rea\u00adder \\u00e9t\\u00e9 K"]
    for together in (1, 50, leaks.CUT_TOGETHER):
        monkeypatch.setattr(leaks, "CUT_TOGETHER", together)
        for text, codes in zip(texts, leaks.codes_of(texts)):
            own = words(text)
            assert len(own) == len(codes) and all(known.setdefault(w, c) == c for w, c in zip(own, codes.tolist()))
    assert len(set(known.values())) == len(known) and not {0, -1} & set(known.values()) and leaks.codes_of([]) == []


def test_cutting_texts_costs_less_than_words_one_by_one():
    texts = [r for r in (PROSE * 40, PROSE.upper() * 40) for _ in range(60)]
    began = time.process_time()
    for t in texts:
        words(t)
    middle = time.process_time()
    leaks.codes_of(texts)
    assert time.process_time() - middle < (middle - began) / 1.5


def test_seeds_and_words_of_texts_counted_together():
    rng, every = np.random.default_rng(14), np.full(leaks.BITMAP_WORDS, -1)
    texts = [rng.integers(1, 6, n) * 2**60 for n in (0, 1, 2, 3, 40, 0, 25)]
    codes, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    own, keys = leaks._distinct_seeds(codes, doc, every)
    for k, t in enumerate(texts):
        assert keys[own == k].tolist() == np.unique(leaks.triples(t)).tolist()
    w, n = leaks._summed([leaks._docs_of(codes, doc, every)] * 2)
    assert dict(zip(w.tolist(), n.tolist())) == {c: 2 * sum(c in t for t in texts) for c in np.unique(codes).tolist()}
    nothing = leaks._docs_of(codes[:0], doc[:0], every)
    assert [len(x) for x in (*nothing, *leaks._summed([]), *leaks._summed([nothing]), *leaks._distinct_seeds(codes[:0], doc[:0], every))] == [0] * 8


def test_distinct_inside():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 40):
        keys, long = rng.integers(0, 9, n), int(rng.integers(1, 8))
        seed = keys % 3 > 0  # a key is a seed everywhere or nowhere
        expected = [len(set(keys[i : i + long][seed[i : i + long]])) for i in range(max(1, n - long + 1))]
        assert leaks.distinct_inside(keys, seed, long).tolist() == expected


@pytest.mark.parametrize("n", [600_000, 1_500_000])
def test_a_copy_in_a_very_long_text(n):
    rng = np.random.default_rng(6)
    item, text = np.arange(1, 61) * 7919, rng.integers(10**9, 10**9 + 5000, n)
    text[n - 1000 : n - 940] = item
    pair = leaks.pairs_of(text, item, np.full(60, leaks.RAREST))
    assert leaks.covered(pair) == [60]
    text[::1000] = item[10]  # seeds all over the text, so that it is one window, cut in pieces
    text[1::1000] = item[11]
    text[2::1000] = item[12]
    pair = leaks.pairs_of(text, item, np.full(60, leaks.RAREST))
    assert leaks.covered(pair)[0] >= 57


def test_a_very_long_item():
    rng = np.random.default_rng(7)
    item = rng.integers(1, 10**12, 3 * leaks.PART_WORDS // 2)
    pair = leaks.pairs_of(np.concatenate([rng.integers(10**13, 10**14, 500), item[:1000], item[-800:]]), item, np.full(len(item), leaks.RAREST))
    assert sum(leaks.covered(pair)) == 1800 and len(pair) == 2


def test_a_copy_in_a_document_of_a_million_words(spark):
    rnd = random.Random(9)
    known = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    items = [(k, ". ".join(" ".join(rnd.choice(known) for _ in range(12)) for _ in range(4)) + ".") for k in range(40)]
    long = [rnd.choice(known) for _ in range(1_000_000)]
    long[800_000:800_000] = items[7][1].split(" ")
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, items[9][1])], "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 7), (3, 9)}


def test_leaks_of_planted_copies(spark):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice(["Lane", "Dock", "Vault", "Crate", "Hinge", "Tray", "Node", "Gauge", "Wire", "Zone"]) for _ in range(3))
    sentence = lambda: f"Callers of {name()} see the {rnd.choice(['tray', 'zone', 'node'])} quietly, because {name()} joins each {rnd.choice(['late', 'cold'])} crate of {name()} by {rnd.randrange(9999)} rows."
    stock = "Choose the best answer and cite the node ids.\n"
    items = [(k, (stock if k % 2 else "") + " ".join(sentence() for _ in range(4))) for k in range(24)] + [(90, None), (91, ""), (92, "\n ")]
    texts, planted = {}, set()
    for d in range(400):
        body = [sentence() for _ in range(6)]
        if d % 10 == 0:
            k = d // 10 % 24
            copied = items[k][1].replace(stock, "").split(" ")
            part = copied[: len(copied) * 6 // 10] if d % 20 else copied
            part = [w for w in part if rnd.random() > 0.06]
            text = " ".join(part)
            body.insert(3, {0: text, 10: text.upper(), 20: "> " + text.replace(". ", ".\n> "), 30: text.replace(" the ", " <b>the</b> ")}[d % 40])
            planted.add((d, k))
        elif d % 10 == 1:
            body.insert(0, stock)
        texts[d] = " ".join(body)
    docs = spark.createDataFrame([*texts.items(), (1000, None), (1001, "")], "doc_id long, text string")
    found = {tuple(r) for r in leaks.leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == planted
    assert leaks.leaked(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    rnd = random.Random(5)
    known = [a + b for a in ("lan", "doc", "vau", "cra", "hin", "tra", "nod", "gau", "wir", "zon") for b in ("da", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu")]
    text = lambda w: ". ".join(" ".join(w[k : k + 15]) for k in range(0, len(w), 15)) + "."
    items = []
    for k in range(0, 24, 2):  # no word stands in one item only
        w = rnd.sample(known, 60)
        items += [(k, text(w)), (k + 1, text(rnd.sample(w, 60)))]
    texts, planted = [], set()
    for d in range(300):
        body = text([rnd.choice(known) for _ in range(80)])
        if d % 3 == 0:
            copied = items[0][1].split(" ")
            start = rnd.randrange(33)
            body += " " + " ".join(copied[start : start + 27])
            planted.add((d, 0))
        texts.append((d, body))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == planted


PROSE = "The default of the queue is twelve, which suits a small store with few readers. Older builds lock it twice; newer ones leave that to the pool. "
SPAM = ["cheap jar, buy plugin, jar download, " * 40, "\n".join(f"{k}. buy jar https://mirror.x{k}.test/a/b.html" for k in range(30)), "Home > jar > buy > plugin free\n" * 20, "\n".join(f"https://wiki.x{k}.example/p?q=1" for k in range(30)), "jar tool (12) buy (7) crack zone (99) " * 30, PROSE[:70] + "\n\n" + "Get jar now. Best pdf download. Buy cheap, buy jar. " * 20]
PLAIN = [PROSE * 5, "\n".join(f"- [p{k}](https://x{k}.test/a): {PROSE}" for k in range(8)), "\n".join(f'    implementation("org.a{k}:b-c:1.{k}.2")' for k in range(30)), "\n".join(f"2025-01-01T00:00:{k:02} INFO [w-1] Pool - tallied {k} rows" for k in range(30)), "\n".join(f"  pool-rows{k}: {k}" for k in range(40)),
         "".join(random.Random(1).choice("abcdef0123456789") for _ in range(3000)), " ".join(str(k * 7919) for k in range(300)), "public int a() {\n    return pool.size();\n}\n" * 20, "当日志超过2820行时,先锁定会话,再统计网关。" * 20, None, "", " \n"]


def test_spam(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*SPAM, *PLAIN])] + [(100 + k, PROSE * (k % 5 + 1)) for k in range(60)], "doc_id long, text string")
    assert {r[0] for r in spam.flagged(docs).collect()} == set(range(len(SPAM)))


def test_states_are_the_likeliest():
    rng = np.random.default_rng(1)
    model = spam._beliefs()
    counts = np.array([3, 0, 5, 1, 4])
    symbols = rng.integers(0, spam.N_SYMBOLS, counts.sum())
    found, at = spam.likeliest(counts, symbols, model), 0
    for n in counts:
        ways = np.array(np.meshgrid(*[range(4)] * n)).reshape(n, -1).T if n else np.zeros((0, 0), dtype=int)
        score = [np.log(model[0][w[0]]) + sum(np.log(model[1][a, b]) for a, b in zip(w, w[1:])) + sum(np.log(model[2][a, s]) for a, s in zip(w, symbols[at : at + n])) for w in ways]
        if n:
            mine = found[at : at + n]
            assert np.isclose(max(score), score[[tuple(w) for w in ways].index(tuple(mine))])
        at += n


def test_expected_counts_are_those_of_all_ways():
    rng = np.random.default_rng(3)
    model = spam._beliefs()
    counts = np.array([3, 0, 4, 1, 4])
    symbols, at = rng.integers(0, spam.N_SYMBOLS, counts.sum()), 0
    first, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, spam.N_SYMBOLS))
    for n in counts:
        own = symbols[at : at + n]
        at += n
        if not n:
            continue
        ways = np.array(np.meshgrid(*[range(4)] * n)).reshape(n, -1).T
        p = np.array([model[0][w[0]] * np.prod(model[1][w[:-1], w[1:]]) * np.prod(model[2][w, own]) for w in ways])
        for w, q in zip(ways, p / p.sum()):
            first[w[0]] += q
            np.add.at(move, (w[:-1], w[1:]), q)
            np.add.at(emit, (w, own), q)
    for found, wanted in zip(spam.expected(counts, symbols, model), (first, move, emit)):
        assert np.allclose(found, wanted)
    assert all(not x.any() for x in spam.expected(np.array([0, 0]), symbols[:0], model))


def test_segments_of_long_lines():
    began = time.time()
    whole = "\n".join(spam.segments("abcdefg " * 2_500_000 + "x" * 20_000_000))
    assert time.time() - began < 5 and whole.replace("\n", "").rstrip() == ("abcdefg " * 2_500_000 + "x" * 20_000_000)
    parts = spam.segments("a\nb\n\n" + "word " * 200 + "\nend")
    assert parts[0] == "a\nb" and max(map(len, parts)) <= spam.LONG * 3 // 2 and parts[-1].endswith("end")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_dirty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).collect() == []
    queries.QUERIES[name](spark, folders["dirty"]).collect()


@pytest.mark.parametrize("name", ["p3_found", "p6_ids", "p7_found", "p8_found"])
def test_extra_columns(spark, folders, name):
    assert rows(queries.QUERIES[name](spark, folders["wide"])) == rows(queries.QUERIES[name](spark, DATA))


def test_parts_hold_all_texts(monkeypatch):
    monkeypatch.setattr(spam, "TOGETHER", 10)
    texts = ["abc", None, "x" * 30, "", "abcdefgh", "abc"]
    parts = list(spam._parts(texts))
    assert [t for _, p in parts for t in p] == texts and [s for s, _ in parts] == [0, 2, 3, 5] and list(spam._parts([])) == []
