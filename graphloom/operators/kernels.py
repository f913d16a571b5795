"""Centrality and communities of the class projection, all sources and all classes side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured, numbered, ship
from graphloom.functions.names import package

#: Links (both directions) up to which one task moves the nodes of communities, in arrays of about 100 bytes a link; beyond that the same moves are rounds of Spark, with the same result.
LINKS_PER_TASK = 8_000_000

#: Sources that betweenness searches from side by side; their states are what one round holds.
SOURCES_PER_BLOCK = 2_000
#: Links of all sources that betweenness holds at once in a task, about 20 bytes for each, and sources that go side by side at most.
LINKS_AT_ONCE, SIDE_BY_SIDE = 32_000_000, 64
#: Values that betweenness adds up at once, so that they stay in a task's caches; so many times fewer links must be followed one by one, or rows of all links are added up.
VALUES_AT_ONCE, ROWS_FROM = 1 << 16, 16
#: Resolutions of the levels of communities, finest first.
RESOLUTIONS = (1.0, 0.4, 0.15)
#: Classes of a package up to which each pair of them is written as a link; larger packages draw their classes together by counts, to the same effect.
PAIRED = 200
#: Nodes and communities that packages without links are weighed for at once.
DRAWN_AT_ONCE = 4_000_000


def undirected(projection: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, the weights of a pair added up."""
    both = projection.select("src", "dst", "weight").union(projection.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def betweenness(projection: DataFrame, ids: DataFrame, sample: int | None = None) -> DataFrame:
    """id, betweenness: on how many shortest ways, unweighted and undirected, each of ids (id) lies; shares where ways are equally short.

    All of ids are sources, in blocks of SOURCES_PER_BLOCK, and the result is exact whatever their number. sample: only so many sources, those with the smallest
    hashes, stand for all, scaled up; an estimate that must be asked for."""
    links = cut(undirected(projection).select("src", "dst"))
    n = ids.count()
    sources = ids.select(F.col("id").alias("source"))
    if sample is not None and sample < n:
        sources = sources.orderBy(F.xxhash64("source"), "source").limit(sample)
    sources, scale = cut(sources), 1.0 if sample is None or sample >= n else n / sample
    # no larger graph can be searched from all of its classes in a lifetime
    whole = links.count() <= LINKS_PER_TASK
    blocks = 1 if whole else min(n, sample or n) // SOURCES_PER_BLOCK + 1
    total = None
    for block in range(blocks):
        own = _shared(links, sources) if whole else _searched(links, sources.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == block))
        total = own if total is None else total.union(own)
    sums = total.groupBy("id").agg((F.sum("delta") * F.lit(scale / 2)).alias("_b"))
    return ids.select("id").join(sums, "id", "left").select("id", F.coalesce("_b", F.lit(0.0)).alias("betweenness"))


def _added(keys: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key that has a weight once, in order, with the sum of its weights; keys lie below size."""
    if len(keys) * 32 < size:
        known, at = np.unique(keys, return_inverse=True)
        return known, np.bincount(at, weights=weights, minlength=len(known))
    summed = np.bincount(keys, weights=weights, minlength=size)
    known = np.flatnonzero(summed)
    return known, summed[known]


def _runs(degree: np.ndarray) -> list[tuple[int, int, int]]:
    """Begin, end and degree of each run of nodes of one degree, without those of degree 0."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(degree)) + 1, [len(degree)]]).tolist()
    return [(a, b, int(degree[a])) for a, b in zip(edges, edges[1:]) if a < b and degree[a]]


def _sums(values: np.ndarray, start: np.ndarray, to: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each node (row) the sum of the rows of its neighbours, a cache's share of them at once. runs: as _runs gives them."""
    out, wide = np.zeros_like(values), values.shape[1]
    for begin, end, degree in runs:
        rows = VALUES_AT_ONCE // (degree * wide)
        if rows:
            for a in range(begin, end, rows):
                b = min(end, a + rows)
                values.take(to[start[a] : start[b]], axis=0).reshape(b - a, degree, wide).sum(axis=1, out=out[a:b])
        else:
            step = max(1, VALUES_AT_ONCE // wide)
            for a in range(begin, end):
                for at in range(start[a], start[a + 1], step):
                    out[a] += values.take(to[at : min(at + step, start[a + 1])], axis=0).sum(axis=0)
    return out


def shares(start: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each node the sum of its shares of the shortest ways from sources to all others. start, to: neighbours of node k are to[start[k]:start[k + 1]].

    Up to SIDE_BY_SIDE sources with about as many links go level by level together, with a row for each node and a column for each source. A level is found in the cheapest of three ways: along the
    links of the level before, from what isn't reached yet, or by adding up the rows of all neighbours, which costs a fraction for each link but takes all links."""
    n, degree = len(start) - 1, np.diff(start)
    # nodes of one degree stand together, those with most links first, so that their neighbours' rows are tables
    order = np.argsort(-degree, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    links = np.repeat(start[:-1][order], degree[order])
    degree = degree[order]
    start = np.concatenate([[0], np.cumsum(degree)])
    to = place[to[links + np.arange(len(to)) - np.repeat(start[:-1], degree)]]
    runs, sources, total = _runs(degree), np.sort(place[sources]), np.zeros(n)
    most = min(SIDE_BY_SIDE, max(1, LINKS_AT_ONCE // max(1, len(to))))
    for begin in range(0, len(sources), most):
        own = sources[begin : begin + most]
        wide, size = len(own), n * len(own)
        level, ways = np.full(size, -1, np.int16 if n < 1 << 15 else np.int32), np.zeros(size)
        front = own * wide + np.arange(wide)
        level[front], ways[front], fronts, back = 0, 1.0, [front], []
        left = len(to) * wide
        while len(front):
            depth = len(back)
            ahead = int(degree[front // wide].sum())
            left -= ahead
            if min(ahead, left) * ROWS_FROM > len(to) * wide:
                values = np.zeros(size)
                values[front] = ways[front]
                summed = _sums(values.reshape(n, wide), start, to, runs).reshape(size)
                front = np.flatnonzero((summed > 0) & (level < 0))
                summed = summed[front]
                back.append(None)
            else:
                pairs = front if ahead <= left else np.flatnonzero(level < 0)
                node, column = np.divmod(pairs, wide)
                count = degree[node]
                first = np.cumsum(count) - count
                met = to[np.repeat(start[node] - first, count) + np.arange(count.sum())] * wide + np.repeat(column, count)
                new = level[met] < 0 if ahead <= left else level[met] == depth
                came, met = np.repeat(pairs, count)[new], met[new]
                if ahead > left:
                    came, met = met, came
                front, summed = _added(met, ways[came], size)
                back.append((came.astype(np.int32), met.astype(np.int32)) if size < 1 << 31 else (came, met))
            level[front], ways[front] = depth + 1, summed
            fronts.append(front)
        delta = np.zeros(size)
        while back:
            found, links = fronts.pop(), back.pop()
            if links is None:
                values = np.zeros(size)
                values[found] = (1.0 + delta[found]) / ways[found]
                above = fronts[-1]
                part = _sums(values.reshape(n, wide), start, to, runs).reshape(size)[above]
            else:
                came, met = links
                above, part = _added(came, (1.0 + delta[met]) / ways[met], size)
            delta[above] += part * ways[above]
        delta[own * wide + np.arange(wide)] = 0.0
        total += delta.reshape(n, wide).sum(axis=1)
    return total[place]


def _shared(links: DataFrame, sources: DataFrame) -> DataFrame:
    """id, delta: as _searched, from a broadcast of the links; each task takes some of the sources."""
    spark = links.sparkSession
    ship(spark)
    nodes = cut(numbered(links.select(F.col("src").alias("id")).distinct(), "id", "nr"))
    nr = lambda name: nodes.select(F.col("id").alias(name), F.col("nr").alias(f"_{name}"))
    got = links.join(nr("src"), "src").join(nr("dst"), "dst").select("_src", "_dst").toArrow()
    known, src = np.unique(got["_src"].to_numpy(), return_inverse=True)
    dst = np.searchsorted(known, got["_dst"].to_numpy())
    order = np.lexsort((dst, src))
    graph = spark.sparkContext.broadcast((known, np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(known)))]), dst[order]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, start, to = graph.value
        total, any_ = np.zeros(len(known)), False
        for p in parts:
            total, any_ = total + shares(start, to, np.searchsorted(known, p["nr"].to_numpy())), any_ or len(p) > 0
        if any_:
            yield pd.DataFrame({"nr": known, "delta": total})

    # so many tasks that the last one to end doesn't keep the others waiting
    tasks = max(4, 4 * spark.sparkContext.defaultParallelism)
    mine = sources.select(F.col("source").alias("id")).join(nodes, "id").select("nr").repartition(tasks, F.xxhash64("nr"))
    own = mine.mapInPandas(run, "nr long, delta double").groupBy("nr").agg(F.sum("delta").alias("delta"))
    return cut(own.join(nodes, "nr").select("id", "delta"))


def _searched(links: DataFrame, sources: DataFrame) -> DataFrame:
    """id, delta: the shares of the shortest ways from some sources, in the same rounds: forwards the number of ways to each node level by level, then backwards
    each node's share."""
    frontier = cut(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("level"), F.lit(1.0).alias("ways")))
    levels, seen = [frontier], frontier
    while True:
        found = frontier.join(links, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
        fresh = found.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("level"), "ways")
        frontier, met = cut_measured(fresh, n=F.count(F.lit(1)))
        if not met["n"]:
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
    below, total = None, sources.select(F.col("source").alias("id"), F.lit(0.0).alias("delta")).limit(0)
    for level in reversed(levels[1:]):
        own = level.select("source", "id", "ways")
        if below is None:
            share = own.withColumn("delta", F.lit(0.0))
        else:
            back = below.join(links, F.col("id") == F.col("src")).select("source", F.col("dst").alias("up"), (F.lit(1.0) / F.col("ways") * (1 + F.col("delta"))).alias("part"))
            summed = back.groupBy("source", F.col("up").alias("id")).agg(F.sum("part").alias("part"))
            share = own.join(summed, ["source", "id"], "left").select("source", "id", "ways", F.coalesce(F.col("ways") * F.col("part"), F.lit(0.0)).alias("delta"))
        below = cut(share)
        total = total.union(below.groupBy("id").agg(F.sum("delta").alias("delta")))
    return cut(total.groupBy("id").agg(F.sum("delta").alias("delta")))


def _beyond(members: DataFrame, held: DataFrame) -> DataFrame:
    """id, community: where packages without links may best draw each of members (see Drawn.beyond)."""
    alike = Window.partitionBy("package", "held").orderBy(F.round("mass", 9), "community")
    few = held.withColumn("_place", F.row_number().over(alike)).where("_place <= 2")
    to = lambda some, there: some.select("id", "package").join(there.select("package", "community"), "package").select("id", "community")
    return to(members.where("not several"), few).unionByName(to(members.where("several"), held))


def _moved(links: DataFrame, resolution: float, members: DataFrame | None = None) -> DataFrame:
    """id, community: nodes of weighted links (both directions, loops allowed) gathered by moves that raise modularity; named by a node's id.

    members: package, size, id, n: how many classes of the packages that have no links each node holds. In each round half of the nodes, by hash, may go to the neighbouring community with the greatest gain, the smaller name of equals; two successive
    rounds have both halves, and each two part the nodes anew. It ends when two such rounds change nothing. Moves of one round don't see each other, so they may
    go round in rings; if the number of moves twice wasn't the least yet, a node moves only if no better move touches the two communities, which raises modularity by
    each move, so that ends as well."""
    degrees = links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    if members is not None:
        members = cut(members.join(members.groupBy("id").agg((F.count("*") > 1).alias("several")), "id").withColumn("pull", 2.0 / F.col("size") * F.col("n")))
        degrees = degrees.unionByName(members.select("id", (F.col("pull") * (F.col("size") - 1)).alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    degrees = cut(degrees)
    double = degrees.agg(F.sum("k")).first()[0] or 1.0
    state = cut(degrees.select("id", "k", F.col("id").alias("community")))
    turn, moves, least, worse, alone, held = 0, 0, None, 0, False, None
    while True:
        mass = state.groupBy("community").agg(F.sum("k").alias("mass"))
        near = links.where("src <> dst").join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        turned = state if alone else state.where(F.pmod(F.xxhash64("id", F.lit(turn // 2)) + turn, F.lit(2)) == 0)
        turned = turned.select("id", "k", F.col("community").alias("own"))
        near = near.unionByName(state.select("id", "community", F.lit(0.0).alias("w")))
        if members is not None:
            held = cut(members.join(state.select("id", "community"), "id").groupBy("package", "community").agg(F.sum("n").alias("held")).join(mass, "community"), held)
            near = near.unionByName(_beyond(members.join(turned.select("id"), "id"), held).withColumn("w", F.lit(0.0)))
        options = turned.join(near.groupBy("id", "community").agg(F.max("w").alias("w")), "id")
        if members is not None:
            met = options.join(members, "id").join(held.select("package", "community", "held"), ["package", "community"])
            own = F.when(F.col("community") == F.col("own"), F.col("n")).otherwise(0)
            drawn = met.groupBy("id", "community").agg(F.sum(F.col("pull") * (F.col("held") - own)).alias("_drawn"))
            options = options.join(drawn, ["id", "community"], "left").withColumn("w", F.col("w") + F.coalesce("_drawn", F.lit(0.0))).drop("_drawn")
        options = options.join(mass, "community")
        rest = F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(double), 9)
        stays = F.max(F.when(F.col("community") == F.col("own"), gain)).alias("stays")
        best = options.groupBy("id", "own").agg(F.min(F.struct((-gain).alias("less"), F.when(F.col("community") == F.col("own"), 0).otherwise(1).alias("move"), "community")).alias("b"), stays).where("b.move = 1")
        best = cut(best.select("id", "own", F.col("b.community").alias("best"), (-F.col("b.less") - F.col("stays")).alias("more")))
        moves += best.count()
        if alone and moves:
            touched = best.select("id", "more", F.explode(F.array("own", "best")).alias("c"))
            first = touched.groupBy("c").agg(F.max(F.struct("more", "id"))["id"].alias("id"))
            best = best.join(first.groupBy("id").agg(F.count("*").alias("n")).where("n = 2"), "id")
        state = cut(state.join(best.select("id", "best"), "id", "left").select("id", "k", F.coalesce("best", "community").alias("community")), state)
        turn += 1
        if alone or turn % 2 == 0:
            if not moves:
                break
            worse = worse + 1 if least is not None and moves >= least else 0
            least = moves if least is None else min(least, moves)
            alone, moves = alone or worse > 1, 0
    names = state.groupBy("community").agg(F.min("id").alias("name"))
    return state.join(names, "community").select("id", F.col("name").alias("community"))


def _parity(hashes: np.ndarray, value: int) -> np.ndarray:
    """The last bit of xxhash64(id, value) as Spark has it, from hashes, the xxhash64(id), as unsigned."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = turned((hashes + five + np.uint64(4)) ^ (np.uint64(value) * one), 23) * two + three
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return ((h ^ (h >> np.uint64(32))) & np.uint64(1)).astype(np.int64)


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights[order], starts)


def _places(start: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the links of nodes, which for node k are start[k] to start[k + 1], and how many each has."""
    count = start[nodes + 1] - start[nodes]
    return np.repeat(start[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum()), count


def _places(start: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what each of nodes has, for node k from start[k] to start[k + 1], and how many these are."""
    count = start[nodes + 1] - start[nodes]
    return np.repeat(start[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum()), count


class Drawn:
    """Packages that draw their classes together without links: each pair of classes weighs 2 / size, so a node with some classes of a package is drawn to a community by 2 / size times
    these times the package's classes there. node, package, count: how many classes of a package a node holds; size: of each package; n: how many nodes there are."""

    def __init__(self, node: np.ndarray, package: np.ndarray, count: np.ndarray, size: np.ndarray, n: int):
        order = np.lexsort((package, node))
        self.node, self.package, self.count, self.size, self.n = node[order], package[order], count[order], size, n
        self.start = np.searchsorted(self.node, np.arange(n + 1))
        self.nodes = np.flatnonzero(np.diff(self.start))
        self.pull = 2.0 / size[self.package] * self.count
        # classes of one node draw each other too, which a loop says where there are links
        self.k = np.bincount(self.node, weights=self.pull * (size[self.package] - 1), minlength=n)

    def above(self, up: np.ndarray) -> Drawn:
        """The same with nodes gathered, each in up."""
        keys, count = _grouped(self.package * self.n + up[self.node], self.count)
        return Drawn(keys % self.n, keys // self.n, count, self.size, self.n)

    def settle(self, own: np.ndarray) -> None:
        """Counts the classes of each package in each community; own: of each node."""
        self.own = own
        self.keys, self.held = _grouped(self.package * self.n + own[self.node], self.count)

    def towards(self, node: np.ndarray, community: np.ndarray) -> np.ndarray:
        """What draws each node to the community beside it; its own classes don't."""
        if not len(self.node):
            return np.zeros(len(node))
        places, count = _places(self.start, node)
        row = np.repeat(np.arange(len(node)), count)
        keys = self.package[places] * self.n + community[row]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = np.where(self.keys[at] == keys, self.held[at], 0) - np.where(self.own[node[row]] == community[row], self.count[places], 0)
        return np.bincount(row, weights=self.pull[places] * held, minlength=len(node))

    def beyond(self, nodes: np.ndarray, k: np.ndarray, mass: np.ndarray, resolution: float, double: float, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of nodes, links aside, the community other than its own with the greatest gain, the smaller name of equals, and that gain; n if its packages have no other.

        A node with classes of one package looks only at the two lightest of the communities that hold equally many of them, as no other gains more and one may be its own: these are fewer than
        three times the root of the package's size. One with classes of several packages looks at all of their communities, or where only is given (flags) at those."""
        out, most = np.full(len(nodes), self.n), np.full(len(nodes), -np.inf)
        if not len(nodes):
            return out, most
        n, package, community = self.n, self.keys // self.n, self.keys % self.n
        order = np.lexsort((community, np.round(mass[community], 9), self.held, package))
        first = np.concatenate([[True], (package[order][1:] != package[order][:-1]) | (self.held[order][1:] != self.held[order][:-1])])
        few, every = np.sort(order[first | np.concatenate([[False], first[:-1]])]), np.arange(len(self.keys)) if only is None else np.flatnonzero(only[community])
        several = self.start[nodes + 1] - self.start[nodes] > 1
        for mine, look in ((np.flatnonzero(~several), few), (np.flatnonzero(several), every)):
            bound = np.searchsorted(package[look], np.arange(len(self.size) + 1))
            places, count = _places(self.start, nodes[mine])
            work = np.bincount(np.repeat(np.arange(len(mine)), count), weights=np.diff(bound)[self.package[places]], minlength=len(mine))
            blocks = np.cumsum(work) // DRAWN_AT_ONCE
            for part in np.split(mine, np.flatnonzero(np.diff(blocks)) + 1):
                places, count = _places(self.start, nodes[part])
                spots, each = _places(bound, self.package[places])
                spots, places = look[spots], np.repeat(places, each)
                keys, w = np.repeat(np.repeat(np.arange(len(part)), count), each) * n + community[spots], self.pull[places] * self.held[spots]
                if look is every:
                    keys, w = _grouped(keys, w)
                other = self.own[nodes[part[keys // n]]] != keys % n
                row, to, w = keys[other] // n, keys[other] % n, w[other]
                if not len(row):
                    continue
                gain = np.round(w - resolution * k[nodes[part[row]]] * mass[to] / double, 9)
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                top = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.append(starts, len(row))))
                # in the order of names, so the last written, going backwards, is the smallest
                best = np.flatnonzero(gain == top)[::-1]
                out[part[row[best]]], most[part[row[best]]] = to[best], gain[best]
        return out, most


def _moved_alone(own: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, k: np.ndarray, linked: np.ndarray, resolution: float, double: float, drawn: Drawn) -> None:
    """The moves of _moved once a node moves only if no better move touches the two communities; own is changed. src is in order and no link is a loop.

    There may be thousands of such rounds, so each node's communities and gains are kept: only those beside a node that moved are gathered again, and only gains in communities that changed are reckoned again."""
    n = len(own)
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    # an entry for each link, one for the node's own community and one for where packages without links draw it; those that aren't needed have no community
    slot = start + np.arange(n + 1) + np.searchsorted(drawn.nodes, np.arange(n + 1))
    spare, several, far = slot[drawn.nodes + 1] - 1, np.diff(drawn.start)[drawn.nodes] > 1, None
    holder, at = np.repeat(np.arange(n), np.diff(slot)), np.full(slot[-1], n)
    w, gain, home = np.zeros(slot[-1]), np.full(slot[-1], -np.inf), slot[:-1].copy()
    again, changed = np.flatnonzero(linked), np.zeros(n + 1, bool)
    while True:
        mass = np.bincount(own, weights=k, minlength=n)
        places, count = _places(start, again)
        keys, sums = _grouped(np.concatenate([np.repeat(again, count) * n + own[dst[places]], again * n + own[again]]), np.concatenate([weight[places], np.zeros(len(again))]))
        node, community = keys // n, keys % n
        mine, _ = _places(slot, again)
        at[mine], gain[mine] = n, -np.inf
        put = slot[node] + np.arange(len(node)) - np.searchsorted(node, node)
        at[put], w[put] = community, sums
        stay = own[node] == community
        home[node[stay]] = put[stay]
        drawn.settle(own)
        known, far = far, drawn.beyond(drawn.nodes, k, mass, resolution, double, changed if far else None)
        if known:
            (old, had), (to, got) = known, far
            better = (got > had) | ((got == had) & (to <= old))
            # what didn't change is no better than what was known, and all of it is weighed again only where that got worse
            kept, lost = several & ~changed[old] & ~better, np.flatnonzero(several & changed[old] & ~better)
            to[kept], got[kept] = old[kept], had[kept]
            to[lost], got[lost] = drawn.beyond(drawn.nodes[lost], k, mass, resolution, double)
        at[spare], gain[spare] = far[0], -np.inf
        renewed = changed[at]
        renewed[put], renewed[spare] = True, at[spare] < n
        renewed = np.flatnonzero(renewed)
        by, of = holder[renewed], at[renewed]
        gain[renewed] = np.round(w[renewed] + drawn.towards(by, of) - resolution * k[by] * (mass[of] - np.where(own[by] == of, k[by], 0.0)) / double, 9)
        top, stays = np.maximum.reduceat(gain, slot[:-1]), gain[home]
        movers = np.flatnonzero(top > stays)
        if not len(movers):
            return
        places, count = _places(slot, movers)
        best = places[gain[places] == np.repeat(top[movers], count)]
        # the first of a node's best ones has the smallest name
        best = best[np.lexsort((at[best], holder[best]))]
        best = best[np.concatenate([[True], holder[best][1:] != holder[best][:-1]])]
        to, more = at[best], top[movers] - stays[movers]
        touched, by = np.concatenate([own[movers], to]), np.concatenate([np.arange(len(movers))] * 2)
        order = np.lexsort((movers[by], more[by], touched))
        last = np.concatenate([touched[order][1:] != touched[order][:-1], [True]])
        first = np.bincount(by[order][last], minlength=len(movers)) == 2
        movers, to = movers[first], to[first]
        changed[:] = False
        changed[own[movers]] = changed[to] = True
        own[movers] = to
        beside = np.zeros(n, bool)
        beside[movers] = beside[dst[_places(start, movers)[0]]] = True
        again = np.flatnonzero(beside)


def moved_arrays(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, hashes: np.ndarray, resolution: float, drawn: Drawn | None = None) -> np.ndarray:
    """The moves of _moved in arrays. src, dst: places of nodes in the order of their names, src in order, hashes of all of them. For each node the place of its community's first; its own without links."""
    n = len(hashes)
    drawn = drawn or Drawn(*[np.zeros(0, np.int64)] * 4, n)
    k = np.bincount(src, weights=weight, minlength=n) + drawn.k
    double = float(k.sum()) or 1.0
    linked = np.bincount(src, minlength=n) > 0
    linked[drawn.nodes] = True
    off = src != dst
    src, dst, weight = src[off], dst[off], weight[off]
    own = np.arange(n)
    turn, moves, least, worse = 0, 0, None, 0
    while worse < 2:
        mass = np.bincount(own, weights=k, minlength=n)
        turned = linked & ((_parity(hashes, turn // 2) + turn) % 2 == 0)
        at = turned[src]
        nodes = np.flatnonzero(turned)
        drawn.settle(own)
        far = drawn.nodes[turned[drawn.nodes]]
        to, _ = drawn.beyond(far, k, mass, resolution, double)
        far, to = far[to < n], to[to < n]
        keys, w = _grouped(np.concatenate([src[at] * n + own[dst[at]], nodes * n + own[nodes], far * n + to]), np.concatenate([weight[at], np.zeros(len(nodes) + len(far))]))
        node, community = keys // n, keys % n
        stay = own[node] == community
        gain = np.round(w + drawn.towards(node, community) - resolution * k[node] * (mass[community] - np.where(stay, k[node], 0.0)) / double, 9)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
        top = np.maximum.reduceat(gain, starts) if len(node) else gain
        group = np.cumsum(np.concatenate([[0], (node[1:] != node[:-1]).astype(np.int64)])) if len(node) else starts
        stays = np.zeros(len(starts))
        stays[group[stay]] = gain[stay]
        # keys are in order, so the first of a node's best ones has the smallest name
        best = np.flatnonzero((gain == top[group]) & (top > stays)[group]) if len(node) else starts
        if len(best):
            best = best[np.concatenate([[True], node[best][1:] != node[best][:-1]])]
        moves += len(best)
        own[node[best]] = community[best]
        turn += 1
        if turn % 2 == 0:
            if not moves:
                break
            worse = worse + 1 if least is not None and moves >= least else 0
            least, moves = moves if least is None else min(least, moves), 0
    else:
        _moved_alone(own, src, dst, weight, k, linked, resolution, double, drawn)
    names = np.full(n, n)
    np.minimum.at(names, own, np.arange(n))
    return names[own]


def _gathered(links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """communities of links, and of the members of packages without links, all levels in one task: id, level, community."""
    ship(links.sparkSession)
    ids = links.select(F.col("src").alias("id"))
    nodes = cut(numbered((ids if members is None else ids.unionByName(members.select("id"))).distinct(), "id", "nr").withColumn("h", F.xxhash64("id")))
    nr = lambda name: nodes.select(F.col("id").alias(name), F.col("nr").alias(f"_{name}"))
    rows = links.join(nr("src"), "src").join(nr("dst"), "dst").join(nodes.select("nr", "h").withColumnRenamed("nr", "_src"), "_src").select("_src", "_dst", "weight", "h", F.lit(0).cast("long").alias("size"))
    if members is not None:
        # a package goes by the number of its first class
        of = members.join(nodes, "id")
        of = of.join(of.groupBy("package").agg(F.min("nr").alias("_dst")), "package")
        rows = rows.unionByName(of.select(F.col("nr").alias("_src"), "_dst", F.col("n").cast("double").alias("weight"), "h", F.col("size").cast("long").alias("size")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [tuple(p[c].to_numpy() for c in ("_src", "_dst", "weight", "h", "size")) for p in parts]
        if not every:
            return
        src, dst, weight, h, size = (np.concatenate(x) for x in zip(*every))
        known, first, src = np.unique(src, return_index=True, return_inverse=True)
        held, link = size > 0, size == 0
        _, one, package = np.unique(dst[held], return_index=True, return_inverse=True)
        drawn = Drawn(src[held], package, weight[held].astype(np.int64), size[held][one], len(known))
        # sorted, so that sums don't depend on the order in which rows came
        src, dst, weight, hashes = src[link], np.searchsorted(known, dst[link]), weight[link], h[first].view(np.uint64)
        order = np.lexsort((dst, src))
        src, dst, weight, at, n = src[order], dst[order], weight[order], np.arange(len(known)), len(known)
        for level, resolution in enumerate(RESOLUTIONS):
            up = moved_arrays(src, dst, weight, hashes, resolution, drawn)
            at, drawn = up[at], drawn.above(up)
            yield pd.DataFrame({"nr": known, "level": np.full(n, level, np.int32), "_of": known[at]})
            keys, weight = _grouped(up[src] * n + up[dst], weight)
            src, dst = keys // n, keys % n

    out = cut(rows.repartition(1).mapInPandas(run, "nr long, level int, _of long"))
    return out.join(nodes.select("nr", "id"), "nr").join(nodes.select(F.col("nr").alias("_of"), F.col("id").alias("community")), "_of").select("id", "level", "community")


def packaged(ids: DataFrame) -> DataFrame:
    """id, package, size: each class of ids (id) with its package and how many classes that has."""
    of = ids.select("id", package("id").alias("package")).distinct()
    return of.join(of.groupBy("package").agg(F.count("*").alias("size")), "package").select("id", "package", "size")


def package_links(sized: DataFrame) -> DataFrame:
    """src, dst, weight: 2 / size for each pair of classes of a package (packaged) of at most PAIRED; those of larger ones are left to counts (Drawn), so no class has more pairs than that."""
    few = sized.where(F.col("size") <= PAIRED)
    pairs = few.select("package", "size", F.col("id").alias("src")).join(few.select("package", F.col("id").alias("dst")), "package").where("src < dst")
    return pairs.select("src", "dst", (F.lit(2.0) / F.col("size")).alias("weight"))


def communities(projection: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, level, community: classes gathered on ever coarser levels, each community of a level a union of those below; named by their smallest class.

    Where ids (id) are given, classes of a package are drawn together, however many, and a class without any link is a community of its own; else it is in none."""
    alone, members, n = None, None, 0
    if ids is not None:
        sized = cut(packaged(ids))
        projection = projection.select("src", "dst", "weight").unionByName(package_links(sized))
        members = sized.where((F.col("size") > PAIRED) & (F.col("size") > 1)).withColumn("n", F.lit(1).cast("long"))
        n = members.count()
        members = members if n else None
    links = cut(undirected(projection))
    if ids is not None:
        met = links.select(F.col("src").alias("id"))
        alone = ids.select("id").distinct().join(met if members is None else met.unionByName(members.select("id")), "id", "left_anti")
        alone = alone.select("id", F.explode(F.array(*(F.lit(k) for k in range(len(RESOLUTIONS))))).alias("level"), F.col("id").alias("community"))
    if links.count() + n <= LINKS_PER_TASK:
        out = _gathered(links, members)
        return out if alone is None else out.unionByName(alone)
    found, out = None, None
    for level, resolution in enumerate(RESOLUTIONS):
        moved = _moved(links, resolution, members)
        found = cut(moved if found is None else found.join(moved.select(F.col("id").alias("community"), F.col("community").alias("_up")), "community").select("id", F.col("_up").alias("community")))
        named = found.select("id", F.lit(level).alias("level"), "community")
        out = named if out is None else out.unionByName(named)
        inside = moved.select(F.col("id").alias("src"), F.col("community").alias("a"))
        links = cut(links.join(inside, "src").join(moved.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
        if members is not None:
            members = cut(members.join(moved, "id").groupBy("package", "size", F.col("community").alias("id")).agg(F.sum("n").alias("n")))
    return out if alone is None else out.unionByName(alone)


def labelled(found: DataFrame) -> DataFrame:
    """found: id, level, community. level, community, label, n, parent of each: the package that most of its classes have, of equals the first by name, with how many others
    there are; parent is the community of the next level that holds it, null on the last."""
    of = found.select("level", "community", F.when(package("id") == "", "(default package)").otherwise(package("id")).alias("pkg")).groupBy("level", "community", "pkg").agg(F.count("*").alias("n"))
    named = of.groupBy("level", "community").agg(F.sum("n").alias("n"), F.count("*").alias("n_pkg"), F.min(F.struct((-F.col("n")).alias("less"), "pkg"))["pkg"].alias("pkg"))
    up = found.select((F.col("level") - 1).alias("level"), F.col("id").alias("community"), F.col("community").alias("parent"))
    label = F.when(F.col("n_pkg") == 1, F.col("pkg")).otherwise(F.concat("pkg", F.lit(" (+"), (F.col("n_pkg") - 1).cast("string"), F.lit(" packages)")))
    return named.join(up, ["level", "community"], "left").select("level", "community", label.alias("label"), "n", "parent")
