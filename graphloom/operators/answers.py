"""Questions answered inside tasks, each by itself: the rules of explain over arrays of the whole graph, so that no pair of a question and a hit is joined, sorted or written
but those that are asked for."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut, numbered, ship
from graphloom.functions.names import owner, simple_name
from graphloom.operators import explain as E
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators.flows import ENTRY_KINDS

#: Rows of words and what they hit, and of nodes and edges, up to which each task holds all of them; beyond that explain's joins do the same.
HELD_PER_TASK = 8_000_000
#: Probes whose hits a worker keeps.
KEPT = 60_000

#: Stands for a kind that is null, which no comparison holds for.
NO_KIND = "\0"

Hits = tuple[np.ndarray, np.ndarray]
NONE = (np.zeros(0, np.int32), np.zeros(0))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds what is not negative."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def summed(parts: list[Hits]) -> Hits:
    """Each id once, in order, with the sum of its scores."""
    if not parts:
        return NONE
    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(ids))


class Lists:
    """Values of each key, which is a place from 0 to n - 1, in the order in which they are given."""

    def __init__(self, keys: np.ndarray, n: int, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])
        self.values = tuple(v[order] for v in values)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """by, values: the values of all keys, with the place in keys of the one that each belongs to."""
        first = self.start[keys]
        count = self.start[keys + 1] - first
        by = np.repeat(np.arange(len(keys)), count)
        at = np.arange(len(by)) + (first - (np.cumsum(count) - count))[by]
        return by, *(v[at] for v in self.values)


class Held:
    """The graph in arrays, nodes by their place in the order of ids, and what a worker has found so far."""

    def __init__(self, **tables):
        self.__dict__.update(tables)
        self.done: dict = {}

    def code(self, kind: str) -> int:
        return self.kinds.get(kind, -1)

    def kept(self, key: tuple, make: Callable):
        if key not in self.done:
            if len(self.done) >= KEPT:
                self.done.clear()
            self.done[key] = make()
        return self.done[key]

    def best(self, words: tuple[str, ...], docs: bool, kind: str | None = None) -> np.ndarray:
        """The nodes whose terms begin with all words, the best first, as many as any probe looks at."""
        lists = sorted((self.hits.get(w, NONE) for w in dict.fromkeys(words)), key=lambda x: len(x[0]))
        if not lists or not len(lists[0][0]):
            return NONE[0]
        ids, score = lists[0]
        for other, part in lists[1:]:
            at = np.minimum(np.searchsorted(other, ids), len(other) - 1)
            same = other[at] == ids
            ids, score = ids[same], score[same] + part[at[same]]
        if kind is not None or not docs:
            fit = self.kind[ids] == self.code(kind) if kind is not None else ~self.prose[ids]
            ids, score = ids[fit], score[fit]
        score, most = rounded(score, 6), E.MOST_SEEN
        if len(ids) > 4 * most:
            fit = score >= np.partition(score, len(score) - most)[len(score) - most]
            ids, score = ids[fit], score[fit]
        return ids[np.argsort(-score, kind="stable")[:most]]

    def taken(self, ids: np.ndarray, most: int, tests: bool) -> np.ndarray:
        seen = ids[: most if tests else 3 * most]
        seen = seen if tests else seen[~self.test[seen]]
        return seen[np.argsort(self.rank[seen], kind="stable")[:most]]

    def probe(self, how: str, words: tuple[str, ...], tests: bool, docs: bool) -> Hits:
        """What a probe keeps and scores, but for what single words get besides."""
        most, first = E.PROBES[how]

        def make() -> Hits:
            ids = self.taken(self.best(words, docs), most, tests)
            return ids, first / np.arange(1, len(ids) + 1) * self.weight[ids]

        return self.kept((how, words, tests, docs), make)

    def single(self, how: str, text: str, word: str, stem: str, tests: bool, docs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """ids, scores, ids whose names begin with the verb, and whether any is the project's."""

        def make() -> tuple:
            ids, score = self.probe(how, (text,), tests, docs)
            n = int(self.telling[ids].sum())
            begins = np.array([v != "" and (v in (word, stem) or (len(stem) >= 4 and v.startswith(stem))) for v in self.verbs], bool)
            return ids, score * (3.0 if n <= 2 else 0.5 if n >= 12 else 1.0), ids[begins[self.verb[ids]]], bool(self.own[ids].any())

        return self.kept(("single", how, text, word, tests, docs), make)

    def from_words(self, words: list[str], stems: list[str], tests: bool, docs: bool) -> Hits:
        parts = [self.probe("phrase", tuple(words), tests, docs)]
        if words != stems:
            parts.append(self.probe("stems", tuple(stems), tests, docs))
        if 3 <= len(stems) <= 8:
            parts += [self.probe("pair", (a, b), tests, docs) for i, a in enumerate(stems) for b in stems[i + 1 :]]
        for w, st in zip(words, stems):
            ids, score, named, own = self.single("word", w, w, st, tests, docs)
            parts.append((ids, score))
            if w != st:
                ids, score, others, other_own = self.single("stem", st, w, st, tests, docs)
                parts.append((ids, score))
                named, own = np.union1d(named, others), own or other_own
            if len(named):
                parts.append((named, E.VERB_BONUS * self.weight[named]))
            # a synonym counts only where neither the word nor its stem finds anything of the project
            parts += [self.probe("synonym", (s,), tests, docs) for s in E.SYNONYMS.get(st, ()) if not own]
        return summed(parts)

    def from_kinds(self, words: list[str], stems: list[str], tests: bool) -> list[Hits]:
        out = []
        for word in dict.fromkeys(s for s in stems if s in E.KIND_WORDS):
            kind = E.KIND_WORDS[word]
            rest = [(w, s) for w, s in zip(words, stems) if s != word]
            found: list[int] = []
            if rest:
                texts = [(tuple(w for w, _ in rest), 10), *(((s,), 5) for _, s in rest)]
                found = list(dict.fromkeys(i for t, most in texts for i in self.kept(("kind", kind, t, most, tests), lambda t=t, m=most: self.taken(self.best(t, True, kind), m, tests)).tolist()))
                held = [sum(s[:5] in self.fqn[i] for _, s in rest) for i in found]
                if held and max(held) > 0 and held.count(max(held)) == 1:
                    found = [found[held.index(max(held))]]
                found = found or self.tied_to(kind, [s for _, s in rest])
            else:
                found = self.listed.get(kind, [])[: E.LISTED]
            if found:
                out.append((np.array(found, np.int32), 2.0 / np.arange(1, len(found) + 1)))
            elif few := self.listed.get(kind, [])[: E.STAND_INS]:
                out.append((np.array(few, np.int32), 0.5 / np.arange(1, len(few) + 1)))
        return [(ids, score * self.weight[ids]) for ids, score in out]

    def tied_to(self, kind: str, stems: list[str]) -> list[int]:
        """Nodes of a kind that code ties to whose names have a piece like one of stems."""
        pieces, ids = self.tied.get(kind, ((), ()))
        met: set[int] = set()
        for s in stems:
            at = bisect.bisect_left(pieces, s)
            while at < len(pieces) and pieces[at].startswith(s):
                met.update(ids[at])
                at += 1
            for k in range(3, len(s) if len(s) >= 4 else 0):
                at = bisect.bisect_left(pieces, s[:k])
                if at < len(pieces) and pieces[at] == s[:k]:
                    met.update(ids[at])
        return sorted(met)

    def holding(self, word: str, docs: bool) -> Hits:
        """The ten first ids that hold a word anywhere; text has all ids a line each, the shortest first."""

        def make() -> Hits:
            found, at, w = [], -1, word.encode()
            while len(found) < 10 and (at := self.text.find(w, at + 1)) >= 0:
                line = int(np.searchsorted(self.line_start, at, side="right")) - 1
                i = self.line_of[line]
                if docs or not self.prose[i]:
                    found.append(i)
                at = int(self.line_start[line + 1]) - 1
            ids = np.array(found, np.int32)
            return ids, 0.5 * self.weight[ids]

        return self.kept(("holding", word, docs), make)

    def passed(self, links: Lists, hits: Hits) -> Hits:
        by, to = links.of(hits[0])
        return to, hits[1][by]

    def answer(self, words: list[str], stems: list[str], tests: bool, docs: bool, past: list[int]) -> Hits:
        """All that a question hits, ids in order."""
        hits = self.from_words(words, stems, tests, docs) if words else NONE
        hits = summed([hits, self.passed(self.users, hits), *self.from_kinds(words, stems, tests)])
        if not len(hits[0]):
            hits = summed([self.holding(w, docs) for w in words])
        to, score = self.passed(self.wired, hits)
        by, caller = self.callers.of(hits[0])
        if len(by):
            told = np.array([any(self.called[i].startswith(s) for s in stems) for i in hits[0][by].tolist()], bool)
            to, score = np.concatenate([to, caller[told]]), np.concatenate([score, hits[1][by[told]]])
        hits = summed([hits, (to, E.PASSED_ON * score * self.weight[to])])
        if past:
            top = hits[1].max() if len(hits[1]) else 1.0
            hits = summed([hits, (np.array(past, np.int32), top * (0.9 - 0.1 * np.arange(len(past))))])
        return hits

    def first(self, ids: np.ndarray, score: np.ndarray, top: int) -> Hits:
        """The best, the smaller id of equals; ids are in order."""
        at = np.argsort(-score, kind="stable")[:top]
        return ids[at], score[at]


class Asked:
    """Questions and the graph that answers them, held by each task: explain's hits, matched, leads and flow_ranks with the same rows."""

    def __init__(self, g: G.Graph, index: DataFrame, facts: DataFrame, questions: DataFrame, recalled: DataFrame | None = None):
        self.g, self.facts, self.questions = g, facts, questions
        self.spark = facts.sparkSession
        ship(self.spark)
        self.q = cut(E.asked(questions))
        self.nodes = cut(numbered(facts, "id", "nr"))
        self.index, self.recalled = index, recalled

    def words(self) -> DataFrame:
        """word: all that any probe or any text for a kind's nodes looks for."""
        synonyms = [s for v in E.SYNONYMS.values() for s in v]
        return self.q.select(F.explode(F.concat("words", "stems", F.array(*map(F.lit, synonyms)))).alias("word")).distinct()

    def small(self) -> bool:
        """Whether a task can hold all; makes what is held of words."""
        self.wnr = cut(numbered(self.words(), "word", "wnr"))
        parts = S.word_parts(self.index, self.wnr.select("word"))
        self.parts = cut(parts.join(self.wnr, "word").join(self.nodes.select("id", "nr"), "id").select("wnr", "nr", "part"))
        return max(self.parts.count(), self.nodes.count(), self.g.edges.count()) <= HELD_PER_TASK

    def places(self, *columns) -> list[np.ndarray]:
        return [np.searchsorted(self.nrs, c.to_numpy()).astype(np.int32) for c in columns]

    def numbers(self, links: DataFrame, *columns: str) -> DataFrame:
        """links with the numbers of some columns of ids instead of them; rows without a node are left out."""
        for c in columns:
            links = links.join(self.nodes.select(F.col("id").alias(c), F.col("nr").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        return links

    @staticmethod
    def of_kinds(kinds: list[str], kind: np.ndarray, wanted: tuple[str, ...]) -> np.ndarray:
        return np.isin(kind, [k for k, x in enumerate(kinds) if x in wanted])

    def held(self) -> Held:
        g, nodes = self.g, self.nodes
        name = simple_name("id")
        verb = F.regexp_extract(name, "^[a-z0-9]*", 0)
        verb = F.when((F.col("kind") == "METHOD") & ~verb.isin("get", "set", "is") & (F.length(verb) >= 3), verb).otherwise("")
        t = nodes.select("nr", "kind", "own", "test", "rank", "weight", "lines", verb.alias("verb"), F.lower("id").alias("low"), F.length("id").alias("length")).toArrow().sort_by("nr")
        self.nrs = t["nr"].to_numpy()
        n = len(self.nrs)
        coded = lambda c: (lambda d: (d.dictionary.to_pylist(), d.indices.to_numpy().astype(np.int32)))(t[c].combine_chunks().fill_null(NO_KIND).dictionary_encode())
        (kinds, kind), (verbs, verbs_of) = coded("kind"), coded("verb")
        flag = lambda c: t[c].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        at = np.argsort(t["length"].to_numpy(), kind="stable")
        low = pc.binary_join_element_wise(t["low"].combine_chunks().cast(pa.large_string()).take(pa.array(at)), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        text = low.buffers()[2].to_pybytes() if n else b""
        lines = np.frombuffer(low.buffers()[1], np.int64)[: n + 1].copy() if n else np.zeros(1, np.int64)
        telling = self.of_kinds(kinds, kind, (*G.CODE, "METHOD", "CONSTRUCTOR"))

        p = self.parts.toArrow().sort_by([("wnr", "ascending"), ("nr", "ascending")])
        word = p["wnr"].to_numpy()
        ids, part = self.places(p["nr"])[0], p["part"].to_numpy()
        cuts = {w: (np.searchsorted(word, k), np.searchsorted(word, k, side="right")) for k, w in self.wnr.select("wnr", "word").toArrow().to_pandas().itertuples(index=False)}
        hits = {w: (ids[a:b], part[a:b]) for w, (a, b) in cuts.items() if b > a}

        links = self.numbers(E.user_links(g, self.facts).select(F.lit("users").alias("what"), "id", F.col("user").alias("other")).unionByName(E.wired_links(g, self.facts).select(F.lit("wired").alias("what"), "id", "other"))
                             .unionByName(E.caller_links(g, self.facts).select(F.lit("callers").alias("what"), "id", "other")), "id", "other").toArrow()
        what, (src, dst) = links["what"].to_numpy(zero_copy_only=False), self.places(links["id"], links["other"])
        lists = {k: Lists(src[what == k], n, dst[what == k]) for k in ("users", "wired", "callers")}
        lower = nodes.select("id", "nr", F.lower(name).alias("name")).join(E.caller_links(g, self.facts).select("id").distinct(), "id", "left_semi").select("nr", "name").toArrow()
        called = dict(zip(self.places(lower["nr"])[0].tolist(), lower["name"].to_pylist()))

        wiring = nodes.where(F.col("kind").isin(*set(E.KIND_WORDS.values())))
        fqn = wiring.select("nr", F.lower("fqn").alias("fqn")).toArrow()
        own = E.kind_nodes(g, self.facts)
        shown = self.numbers(own, "id").toArrow()
        listed, tied = {}, {}
        for k, i in sorted(zip(shown["kind"].to_pylist(), self.places(shown["id"])[0].tolist())):
            listed.setdefault(k, []).append(i)
        met = self.numbers(E.tied_pieces(g, own), "id").toArrow()
        for k, w, i in sorted(zip(met["kind"].to_pylist(), met["w"].to_pylist(), self.places(met["id"])[0].tolist())):
            pieces, of = tied.setdefault(k, ([], []))
            if not pieces or pieces[-1] != w:
                pieces.append(w)
                of.append([])
            of[-1].append(i)
        return Held(kinds={x: k for k, x in enumerate(kinds)}, kind=kind, verbs=verbs, verb=verbs_of, own=flag("own"), test=flag("test"), rank=t["rank"].to_numpy(), weight=t["weight"].to_numpy(), telling=telling, prose=self.of_kinds(kinds, kind, ("DOC", NO_KIND)), hits=hits, called=called,
                    fqn=dict(zip(self.places(fqn["nr"])[0].tolist(), [x or "" for x in fqn["fqn"].to_pylist()])), listed=listed, tied=tied, text=text, line_start=lines, line_of=at.astype(np.int32), **lists)

    def run(self, held: Held, pick: Callable, columns: str) -> DataFrame:
        """The rows that pick(held, words, stems, ids, scores) gives of each question, columns (without question) with nr, the number of a node, first."""
        shared, nrs = self.spark.sparkContext.broadcast(held), self.spark.sparkContext.broadcast(self.nrs)
        names = [c.split()[0] for c in columns.split(", ")]

        def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            h, known = shared.value, nrs.value
            for p in parts:
                questions, out = [], []
                for question, words, stems, tests, docs, past in p.itertuples(index=False):
                    words, stems = ([] if x is None else list(x) for x in (words, stems))
                    past = [] if past is None else np.searchsorted(known, past).tolist()
                    got = pick(h, words, stems, *h.answer(words, stems, bool(tests), bool(docs), past))
                    if len(got[0]):
                        questions.append((question, len(got[0])))
                        out.append(got)
                if not out:
                    continue
                rows = {c: np.concatenate([x[k] for x in out]) for k, c in enumerate(names)}
                if "nr" in rows:
                    rows["nr"] = known[rows["nr"]]
                yield pd.DataFrame({"question": np.repeat(np.array([q for q, _ in questions], object), [k for _, k in questions]), **rows})

        told = self.q.select("question", "words", "stems", "tests", "docs")
        if self.recalled is not None:
            past = self.numbers(self.recalled.select("question", F.col("arg").alias("id"), "place"), "id").groupBy("question").agg(F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("past"))
            told = told.join(past, "question", "full")
        else:
            told = told.withColumn("past", F.lit(None).cast("array<long>"))
        # questions that begin alike go to one task, where much of what they ask for is found already
        told = told.withColumn("tests", F.coalesce("tests", F.lit(False))).withColumn("docs", F.coalesce("docs", F.lit(False))).repartition(4 * max(1, self.spark.sparkContext.defaultParallelism), F.slice("words", 1, 2))
        return told.mapInPandas(work, f"question string, {columns}")

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.nodes.select("nr", "id"), "nr")

    def hits(self, held: Held) -> DataFrame:
        return self.named(self.run(held, lambda h, words, stems, ids, score: (ids, score), "nr long, score double")).select("question", "id", "score")

    def matched(self, held: Held, top: int = 10) -> DataFrame:
        held.shown = ~np.isin(held.kind, [held.code(k) for k in (*E.UNMATCHED, NO_KIND)])

        def pick(h: Held, words: list[str], stems: list[str], ids: np.ndarray, score: np.ndarray) -> tuple:
            shown = h.shown[ids]
            ids, score = ids[shown], score[shown]
            got = h.first(ids, rounded(score * np.where(h.test[ids], 0.3, 1.0), 5), top)
            return *got, np.arange(1, len(got[0]) + 1)

        return self.named(self.run(held, pick, "nr long, score double, place int")).select("question", "id", "score", "place")

    def leads(self, held: Held, layers: DataFrame, top: int = 5) -> DataFrame:
        able = E.able_members(self.g, self.facts).join(layers.select(F.col("id").alias("_cls"), "layer"), owner("id") == F.col("_cls"), "left")
        able = cut(able.select("id", "calls", "lines", F.coalesce(F.try_element_at(E._map(E.LAYER_WEIGHTS), F.col("layer")), F.lit(1.0)).alias("share")))
        got = self.numbers(able, "id").toArrow()
        n = len(self.nrs)
        at = self.places(got["id"])[0]
        held.able, held.share = np.zeros(n, bool), np.ones(n)
        held.able[at], held.share[at] = True, got["share"].to_numpy()
        members = self.numbers(self.g.edges.where("kind = 'CONTAINS'").select("src", F.col("dst").alias("id")).join(able.select("id", "calls", "lines"), "id"), "src", "id").toArrow()
        src, dst = self.places(members["src"], members["id"])
        order = np.lexsort((-dst, -members["lines"].to_numpy(), -members["calls"].to_numpy()))
        held.busiest = Lists(src[order], n, dst[order])
        held.types = np.isin(held.kind, [held.code(k) for k in G.CODE])

        def pick(h: Held, words: list[str], stems: list[str], ids: np.ndarray, score: np.ndarray) -> tuple:
            types = ids[h.types[ids]]
            own = score[h.types[ids]]
            best = np.argsort(-(own * np.where(h.test[types], 0.3, 1.0)), kind="stable")[:3]
            by, member = h.busiest.of(types[best])
            fresh = ~np.isin(member, ids)
            by, member = by[fresh], member[fresh]
            # the busiest of each type comes first
            first = np.concatenate([[True], by[1:] != by[:-1]])[: len(by)]
            stands: dict[int, float] = {}
            for i, s in zip(member[first].tolist(), own[best][by[first]].tolist()):
                stands[i] = max(s, stands.get(i, s))
            able = h.able[ids]
            every, s = summed([(ids[able], score[able]), (np.array(list(stands), np.int32), np.array(list(stands.values()), float))])
            got = h.first(every, rounded(s * h.share[every], 5), top)
            return *got, np.arange(1, len(got[0]) + 1)

        return self.named(self.run(held, pick, "nr long, score double, place int")).select("question", "id", "score", "place")

    def flow_ranks(self, held: Held, flows: DataFrame, top: int = 3) -> DataFrame:
        n = len(self.nrs)
        told = cut(E.flow_tokens(self.g, flows)).toArrow().sort_by("entry")
        entries = told["entry"].to_pylist()
        at = {e: k for k, e in enumerate(entries)}
        flow = lambda c: np.array([at[e] for e in c.to_pylist()], np.int64)
        steps = self.numbers(E.flow_steps(flows), "id").toArrow()
        held.steps = Lists(self.places(steps["id"])[0], n, flow(steps["entry"]), steps["sure"].to_numpy())
        handles = self.numbers(E.flow_handles(self.g, flows), "id").toArrow()
        held.handles = Lists(self.places(handles["id"])[0], n, flow(handles["entry"]))
        members = self.numbers(self.g.edges.where("kind = 'CONTAINS'").select("src", "dst"), "src", "dst").toArrow()
        src, dst = self.places(members["src"], members["dst"])
        held.members = Lists(src, n, dst)
        held.types, held.route = np.isin(held.kind, [held.code(k) for k in G.CODE]), held.kind == held.code("HTTP_ROUTE")
        held.gives = ~np.isin(held.kind, [held.code(k) for k in ("FLOW", "COMMUNITY", NO_KIND)])
        held.tokens, held.labels = told["tokens"].to_pylist(), [x or "" for x in told["label"].to_pylist()]
        held.order = np.array([ENTRY_KINDS.index(k) + 1 if k in ENTRY_KINDS else 0 for k in told["entry_kind"].to_pylist()])
        verbs = self.nodes.where("kind = 'HTTP_ROUTE'").select("nr", F.lower(F.regexp_extract("id", r"^route:(\w+) ", 1)).alias("verb")).toArrow()
        held.route_verbs = dict(zip(self.places(verbs["nr"])[0].tolist(), verbs["verb"].to_pylist()))

        def says(h: Held, s: str) -> np.ndarray:
            tells = lambda t: t.startswith(s) or (len(s) >= 4 and len(t) >= 3 and s.startswith(t))
            return h.kept(("says", s), lambda: np.array([any(map(tells, x)) for x in h.tokens], bool))

        def verb(h: Held, s: str) -> np.ndarray:
            return h.kept(("verb", s), lambda: np.array([x.startswith(E.HTTP_VERBS.get(s, "\0")) for x in h.labels], bool))

        def pick(h: Held, words: list[str], stems: list[str], ids: np.ndarray, score: np.ndarray) -> tuple:
            if not len(ids):
                return (ids,) * 4
            size = len(h.labels)
            types = h.types[ids]
            by, member = h.members.of(ids[types])
            given, sc = np.concatenate([member, ids[h.gives[ids]]]), np.concatenate([score[types][by], score[h.gives[ids]]])
            by, to, sure = h.steps.of(given)
            routes = h.route[ids]
            to_route, entry = h.handles.of(ids[routes])
            where = np.concatenate([to, entry])
            parts = np.bincount(where, weights=np.concatenate([sc[by] * sure, 3 * score[routes][to_route]]), minlength=size)
            own = np.flatnonzero(np.bincount(where, minlength=size))
            by, to, _ = h.steps.of(ids)
            best = np.zeros(size)
            np.maximum.at(best, to, score[by])
            cover = np.zeros(len(own), np.int64)
            for s in stems:
                has = says(h, s)[own]
                met = int(has.sum())
                cover += has * (0 if met > max(2, len(own) // 2) else 3 if met <= 2 else 1)
            if stems:
                cover += np.logical_or.reduce([verb(h, s)[own] for s in stems])
            pin = np.zeros(len(own), bool)
            if not set(E.ROUTE_WORDS).isdisjoint(words):
                near = [(h.route_verbs.get(i) not in words, -s, i, e) for i, s, e in zip(ids[routes][to_route].tolist(), score[routes][to_route].tolist(), entry.tolist()) if s >= score.max() / 2]
                pin = own == min(near)[3] if near else pin
            total, peak = rounded(parts[own], 5), rounded(best[own], 5)
            order = np.lexsort((own, -total, h.order[own], -peak, -cover, ~pin))[:top]
            return own[order], cover[order], total[order], np.arange(1, len(order) + 1)

        asked = self.run(held, pick, "flow int, covered int, score double, place int")
        named = self.spark.createDataFrame(pd.DataFrame({"flow": np.arange(len(entries)), "entry": np.array(entries, object)}), "flow int, entry string")
        return asked.join(named, "flow").select("question", "entry", "covered", "score", "place")
