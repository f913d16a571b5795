"""What questions hit, lead and cover, against the rules written out one question at a time."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions import names
from graphloom.operators import answers as A
from graphloom.operators import derive as D
from graphloom.operators import explain as E
from graphloom.operators import graph as G
from graphloom.operators import search as S
from tests.conftest import DATA

CODE = set(G.CODE)
QUESTIONS = [
    "How does the request handler create the tray?", "which routes exist", "What routes are there for archives and workers?", "where is the vessel quota set", "tests of the ledger", "what is a beacon",
    "Which topics and queues does the worker read", "resolve the snapshot", "park parks parking the region region", "anvilzz", "fetch retrieve ledgers", "config of the harbor umbrella grams", "beans for zones", "ridg",
    "how do I validate escrow output", "the and for", "record info notNull", "delete endpoint quarrys", "schedule jobs that load filters",
]


def _stem(w):
    undouble = lambda x: x[:-1] if len(x) > 3 and x[-1] == x[-2] and x[-1] not in "lszaeiou" else x
    if len(w) > 5 and w.endswith("ing"):
        return undouble(w[:-3])
    if len(w) > 4 and w.endswith("ied"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith("ed"):
        return undouble(w[:-2])
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def _simple(i):
    head = i.split("(")[0]
    return (head.split("#")[-1] if "#" in head else head.split(".")[-1]).split("$")[-1]


class Plain:
    """The rules over dictionaries."""

    def __init__(self, nodes, edges, postings, degrees):
        self.nodes = {n["id"]: n for n in nodes}
        self.edges, self.degrees = edges, degrees
        self.into, self.out = defaultdict(list), defaultdict(list)
        for e in edges:
            self.into[e["dst"]].append((e["src"], e["kind"]))
            self.out[e["src"]].append((e["dst"], e["kind"]))
        self.tf, self.length = defaultdict(dict), Counter()
        for p in postings:
            self.tf[p["id"]][p["term"]] = p["tf"]
            self.length[p["id"]] += p["tf"]
        self.mean = sum(self.length.values()) / len(self.length)
        self.known = {}

    def lines(self, n):
        return (n["end_line"] or 0) - (n["start_line"] or 0)

    def test(self, n):
        return (n["attrs"] or {}).get("test") == "true"

    def weight(self, i):
        n = self.nodes[i]
        return E.KIND_WEIGHTS.get(n["kind"], 1.0) * (1 + math.log10(1 + self.degrees.get(i.split("#")[0], 0)) / 2)

    def hits_of(self, word):
        if word not in self.known:
            self.known[word] = {i: f for i, terms in self.tf.items() if (f := sum(n for t, n in terms.items() if t.startswith(word)))}
        return self.known[word]

    def search(self, text, limit, kinds=None):
        words = list(dict.fromkeys(w for w in text.split(" ") if w))
        if not words:
            return []
        total = Counter()
        for w in words:
            own = self.hits_of(w)
            idf = max(math.log((len(self.length) - len(own) + 0.5) / (len(own) + 0.5)), 1e-6)
            for i, f in own.items():
                total[i] += idf * f * (S.K1 + 1) / (f + S.K1 * (1 - S.B + S.B * self.length[i] / self.mean))
        ids = [i for i in total if all(i in self.hits_of(w) for w in words) and (kinds is None or self.nodes[i]["kind"] in kinds)]
        return sorted(ids, key=lambda i: (-round(total[i], 6), i))[:limit]

    def rank(self, i):
        n = self.nodes[i]
        if n["origin"] == "EXTERNAL":
            return 3
        if n["kind"] in CODE:
            return 0
        return (0 if self.lines(n) >= 2 else 1) if n["kind"] in ("METHOD", "CONSTRUCTOR") else 2 if n["kind"] == "FIELD" else 0

    def hits(self, question):
        words = [w for w in re.split(r"[^A-Za-z0-9_]+", question.lower()) if len(w) > 2 and w not in S.STOP]
        stems, hits = [_stem(w) for w in words], Counter()
        tests = any(w.startswith("test") for w in words)

        def find(text, limit, kinds=None):
            found = self.search(text, limit if tests else limit * 3, kinds)
            return sorted((i for i in found if tests or not self.test(self.nodes[i])), key=self.rank)[:limit]

        def hit(i, score):
            hits[i] += score * self.weight(i)

        own = lambda ids: any(self.nodes[i]["origin"] == "REPO" for i in ids)
        if not words:
            return {}
        for k, i in enumerate(find(" ".join(words), 30)):
            hit(i, 3.0 / (k + 1))
        if stems != words:
            for k, i in enumerate(find(" ".join(stems), 30)):
                hit(i, 3.0 / (k + 1))
        if 3 <= len(stems) <= 8:
            for a in range(len(stems)):
                for b in range(a + 1, len(stems)):
                    for k, i in enumerate(find(stems[a] + " " + stems[b], 10)):
                        hit(i, 1.5 / (k + 1))
        for w, st in zip(words, stems):
            telling = lambda ids: sum(self.nodes[i]["kind"] in CODE or self.nodes[i]["kind"] in ("METHOD", "CONSTRUCTOR") for i in ids)
            factor = lambda ids: 3.0 if telling(ids) <= 2 else 0.5 if telling(ids) >= 12 else 1.0

            def verb(i, w=w, st=st):
                first = re.match("[a-z0-9]*", _simple(i))[0]
                return self.nodes[i]["kind"] == "METHOD" and first not in ("get", "set", "is") and len(first) >= 3 and (first in (st, w) or (len(st) >= 4 and first.startswith(st)))

            found, other = find(w, 15), find(st, 15)
            for k, i in enumerate(found):
                hit(i, factor(found) / (k + 1))
                if verb(i):
                    hit(i, 1.0)
            for k, i in enumerate(other if st != w else ()):
                hit(i, 0.8 * factor(other) / (k + 1))
                if verb(i) and i not in found:
                    hit(i, 1.0)
            if not own(found) and not own(other):
                for synonym in E.SYNONYMS.get(st, ()):
                    for k, i in enumerate(find(synonym, 10)):
                        hit(i, 0.3 / (k + 1))
        live = lambda i: i in self.nodes and self.nodes[i]["origin"] == "REPO" and not self.test(self.nodes[i])
        for i, score in list(hits.items()):
            n, name = self.nodes[i], _simple(i)
            if n["origin"] != "REPO":
                continue
            by = ("WRITES_FIELD", "READS_FIELD") if n["kind"] == "FIELD" else ("CALLS",) if n["kind"] == "METHOD" and self.lines(n) <= 0 and name.startswith(("get", "set", "is")) else ()
            users = {s for s, k in self.into[i] if k in by and live(s) and self.nodes[s]["kind"] in ("METHOD", "CONSTRUCTOR")}
            if len(users) <= 6:
                for u in users:
                    hits[u] += score
        remote = lambda n: (n["attrs"] or {}).get("remote") == "true"
        for word, kind in E.KIND_WORDS.items():
            if word not in stems:
                continue
            rest = [w for w in words if _stem(w) != word]
            found = list(dict.fromkeys(find(" ".join(rest), 10, {kind}) + [i for r in rest for i in find(_stem(r), 5, {kind})])) if rest else []
            counts = [sum(_stem(r)[:5] in self.nodes[i]["fqn"].lower() for r in rest) for i in found]
            if counts and max(counts) >= 1 and counts.count(max(counts)) == 1:
                found = [found[counts.index(max(counts))]]
            of_kind = sorted(i for i, n in self.nodes.items() if n["kind"] == kind and not remote(n))
            if not found and rest:
                def tied(i):
                    for src, _ in self.into[i]:
                        for w in (x.lower() for x in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", src.split("(")[0]) if x):
                            if any(w.startswith(_stem(r)) or (len(_stem(r)) >= 4 and _stem(r).startswith(w) and len(w) >= 3) for r in rest):
                                return True
                    return False

                found = [i for i in of_kind if tied(i)]
            if not found and not rest:
                found = of_kind[:20]
            for k, i in enumerate(found):
                hit(i, 2.0 / (k + 1))
            for k, i in enumerate(() if found else of_kind[:10]):
                hit(i, 0.5 / (k + 1))
        if not hits:
            for w in words:
                for i in sorted((i for i in self.nodes if w in i.lower()), key=lambda i: (len(i), i))[:10]:
                    hit(i, 0.5)
        for i, score in list(hits.items()):
            n = self.nodes[i]
            tied = [s for s, k in self.into[i] if k in E.ATTACHED.get(n["kind"], ())] + ([t for t, k in self.out[i] if k == "CALLS"] if n["kind"] == "SCHEDULED_JOB" else [])
            for t in tied:
                if t in self.nodes:
                    hit(t, score * 0.9)
            if n["origin"] == "EXTERNAL" and n["kind"] == "METHOD" and any(_simple(i).lower().startswith(st) for st in stems):
                callers = [s for s, k in self.into[i] if k == "CALLS" and live(s)]
                for c in callers if len(callers) <= 3 else ():
                    hit(c, score * 0.9)
        return hits


@pytest.fixture(scope="module")
def made(spark):
    g = G.load(spark, DATA)
    g = G.Graph(cut(g.nodes), cut(g.edges))
    projection = cut(D.class_projection(g))
    degrees = cut(D.in_degrees(projection))
    index = cut(S.postings(g.nodes))
    facts = cut(E.node_facts(g, degrees))
    asked = spark.createDataFrame([(q,) for q in [*QUESTIONS, None, ""]], "question string")
    scores = cut(E.hits(g, index, facts, asked))
    plain = Plain([r.asDict() for r in g.nodes.collect()], [r.asDict() for r in g.edges.select("src", "dst", "kind").collect()], [r.asDict() for r in index.collect()], {r["id"]: r["n"] for r in degrees.collect()})
    return g, projection, facts, asked, scores, plain


def test_hits(made):
    *_, scores, plain = made
    found = defaultdict(dict)
    for r in scores.collect():
        found[r["question"]][r["id"]] = r["score"]
    for q in QUESTIONS:
        expected = plain.hits(q)
        assert found[q].keys() == expected.keys(), q
        assert all(abs(found[q][i] - s) < 1e-4 * max(1, s) for i, s in expected.items()), q


def test_leads_and_matches(made):
    g, projection, facts, _, scores, plain = made
    layers = {r["id"]: r["layer"] for r in D.layers(g, projection).collect()}
    hits = defaultdict(dict)
    for r in scores.collect():
        hits[r["question"]][r["id"]] = r["score"]
    able = {i for i, n in plain.nodes.items() if n["kind"] in ("METHOD", "CONSTRUCTOR") and n["origin"] != "EXTERNAL" and not plain.test(n) and (plain.lines(n) >= 1 or plain.nodes.get(i.split("#")[0], {"kind": ""})["kind"] == "INTERFACE")}
    leads, matches = defaultdict(list), defaultdict(list)
    for r in E.leads(g, facts, D.layers(g, projection), scores).orderBy("place").collect():
        leads[r["question"]].append((r["id"], r["score"]))
    for r in E.matched(facts, scores).orderBy("place").collect():
        matches[r["question"]].append((r["id"], r["score"]))
    for q, own in hits.items():
        shown = {i: round(s * (0.3 if plain.test(plain.nodes[i]) else 1), 5) for i, s in own.items() if plain.nodes[i]["kind"] not in ("FLOW", "COMMUNITY", "PACKAGE", "FILE")}
        assert [round(s, 4) for _, s in matches[q]] == [round(s, 4) for _, s in sorted(shown.items(), key=lambda x: (-x[1], x[0]))[:10]]
        every = {i: s for i, s in own.items() if i in able}
        for c in sorted((i for i in own if plain.nodes[i]["kind"] in CODE), key=lambda i: (-own[i] * (0.3 if plain.test(plain.nodes[i]) else 1), i))[:3]:
            members = [m for m, k in plain.out[c] if k == "CONTAINS" and m in able and m not in own]
            if members:
                best = max(members, key=lambda m: (sum(k == "CALLS" for _, k in plain.out[m]), plain.lines(plain.nodes[m]), m))
                every[best] = max(every.get(best, 0), own[c])
        weighed = {i: round(s * E.LAYER_WEIGHTS.get(layers.get(i.split("#")[0]), 1.0), 5) for i, s in every.items()}
        assert [round(s, 4) for _, s in leads[q]] == [round(s, 4) for _, s in sorted(weighed.items(), key=lambda x: (-x[1], x[0]))[:5]]


def test_flows_of_questions(spark, made):
    g, _, facts, _, _, _ = made
    step = "array<struct<id:string,depth:int,via:string>>"
    flows = spark.createDataFrame([("a.A#list()", "route", "GET /archives", [("a.A#list()", 0, "EXACT"), ("a.B#load()", 1, "EXACT")]), ("a.C#add()", "route", "POST /archives", [("a.C#add()", 0, "EXACT")]), ("a.D#run()", "job", "scheduled run", [("a.D#run()", 0, "EXACT"), ("a.B#load()", 3, "CHA")])],
                                  f"entry string, entry_kind string, label string, steps {step}")
    scores = spark.createDataFrame([("add archives", "a.B#load()", 2.0), ("add archives", "a.C#add()", 1.0), ("load", "a.B#load()", 4.0)], "question string, id string, score double")
    known = spark.createDataFrame([(i, "METHOD", i, True, False, False, 0, 1.0, 5) for i in ("a.A#list()", "a.B#load()", "a.C#add()", "a.D#run()")], facts.schema)
    found = {(r["question"], r["entry"]): (r["covered"], r["score"], r["place"]) for r in E.flow_ranks(g, known, flows, spark.createDataFrame([("add archives",), ("load",)], "question string"), scores).collect()}
    # "archive" is in two of three flows, "add" in one; "add" names a POST as well
    assert found == {
        ("add archives", "a.C#add()"): (7, 1.0, 1), ("add archives", "a.A#list()"): (3, 1.0, 2), ("add archives", "a.D#run()"): (0, 0.5, 3),
        ("load", "a.A#list()"): (3, 2.0, 1), ("load", "a.D#run()"): (3, 1.0, 2),
    }


def test_stems_in_columns(spark):
    words = ["adding", "planned", "called", "egged", "ies", "tries", "tied", "class", "classes", "mapping", "aas", "bus", "ridged"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", names.stem("w").alias("s")).collect()} == {w: _stem(w) for w in words}
    assert _stem("adding") == "add" and _stem("planned") == "plan" and df.select(F.lit(1)).count() == len(words)


def _same(a, b, columns, score="score"):
    """Equal rows by their key, scores but for how sums are rounded."""
    told = lambda df: {tuple(r[c] for c in columns): r[score] for r in df.collect()}
    x, y = told(a), told(b)
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-4 * max(1, y[k]) for k in y)
    return len(x)


def test_answers_in_tasks_as_by_joins(spark, made):
    g, projection, facts, asked, scores, _ = made
    index, some = cut(S.postings(g.nodes)), facts.where("kind = 'METHOD'").orderBy("id").limit(3).select("id").toPandas()["id"].tolist()
    more = asked.union(spark.createDataFrame([("anvilzz tray",), ("ridg ridg zone ridg",), ("\u00fc\u00fc\u00fc",)], "question string"))
    recalled = spark.createDataFrame([(q, i, k) for q in ("resolve the snapshot", "\u00fc\u00fc\u00fc", "anvilzz") for k, i in enumerate(["gone", *some], 1)], "question string, arg string, place int")
    joined = cut(E.hits(g, index, facts, more, recalled))
    tasks = A.Asked(g, index, facts, more, recalled)
    assert tasks.small()
    found = tasks.hits(tasks.held())
    assert "MapInPandas" in found._jdf.queryExecution().toString(), "texts were joined with all hits of their words"
    assert _same(found, joined, ("question", "id")) > 300
    assert _same(tasks.matched(tasks.held()), E.matched(facts, joined), ("question", "place")) > 100


def test_leads_in_tasks_as_by_joins(spark, made):
    g, projection, facts, asked, scores, _ = made
    tasks = A.Asked(g, cut(S.postings(g.nodes)), facts, asked)
    assert tasks.small()
    layers = cut(D.layers(g, projection))
    found = tasks.leads(tasks.held(), layers)
    assert "MapInPandas" in found._jdf.queryExecution().toString(), "leads were joined with all hits"
    assert _same(found, E.leads(g, facts, layers, scores), ("question", "place")) > 40


def test_flows_in_tasks_as_by_joins(spark, made):
    g, _, facts, asked, scores, _ = made
    tasks = A.Asked(g, cut(S.postings(g.nodes)), facts, asked)
    assert tasks.small()
    ids = sorted({r["id"] for r in scores.join(facts.where("kind in ('METHOD', 'CLASS')"), "id").select("id").collect()})
    handlers = sorted({r["src"] for r in g.edges.where("kind = 'HANDLES_ROUTE'").select("src").collect()})
    rnd = random.Random(4)
    made_flows = [(e, rnd.choice(("route", "job", "main")), f"{rnd.choice(('GET', 'POST', 'DELETE'))} /{rnd.choice(('archives', 'vessels/quota', 'filters', 'quarrys'))}", [(i, k, "EXACT") for k, i in enumerate(rnd.sample(ids, 6))]) for e in sorted({*handlers, *ids[:8]})]
    flows = cut(spark.createDataFrame(made_flows, "entry string, entry_kind string, label string, steps array<struct<id:string,depth:int,via:string>>"))
    found, joined = tasks.flow_ranks(tasks.held(), flows), cut(E.flow_ranks(g, facts, flows, asked, scores))
    assert "MapInPandas" in found._jdf.queryExecution().toString(), "flows were joined with all hits"
    found = cut(found)
    assert _same(found, joined, ("question", "place", "entry")) > 10 and _same(found, joined, ("question", "place", "entry"), "covered") > 10
