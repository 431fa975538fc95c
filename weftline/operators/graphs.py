"""Graph algorithms on annual graphs.

The graph of one view (year, corpus, hierarchy) is the unit of work: views run in parallel, and a
view's edges must fit in one task. Where an algorithm can be cut further it is: betweenness by
blocks of sources, PageRank and components as distributed iterations for views of any size.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.network import VIEW
from weftline.session import Scratch, get_bytes, put_bytes

_V = "year int, corpus_view string, hierarchy_view string"
RESOLUTIONS = (0.5, 1.0, 1.5)
TASK_EDGES = 2_000_000  # edges of a view that one task can hold
BLOCK_NODES = 65_536  # nodes of a block of ranks
PATH_CUTOFF_NODES, PATH_CUTOFF = 10_000, 3.0


def _edge_rows(e: DataFrame) -> DataFrame:
    return e.select(*VIEW, F.lit(0).alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("fractional_count").cast("double").alias("w"))


def graph_rows(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (kind 0) and nodes (kind 1) of every view in one table, so that isolates take part."""
    return _edge_rows(e).unionByName(nodes.select(*VIEW, F.lit(1).alias("kind"), F.col("institution_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")))


def _graph(pdf: pd.DataFrame) -> tuple[list[str], list[tuple[int, int, float]]]:
    ids = sorted(set(pdf["a"]) | set(pdf.loc[pdf["kind"] == 0, "b"]))
    at = {x: i for i, x in enumerate(ids)}
    rows = pdf[pdf["kind"] == 0].sort_values(["a", "b"])
    return ids, [(at[a], at[b], float(w)) for a, b, w in zip(rows["a"], rows["b"], rows["w"])]


def pagerank(g: DataFrame, damping: float = 0.85, tolerance: float = 1e-13, rounds: int = 500) -> DataFrame:
    """Weighted undirected PageRank of each view; nodes without edges spread their rank evenly; sums to 1."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = _graph(pdf)
        n = len(ids)
        s = np.array([e[0] for e in edges] + [e[1] for e in edges], int)
        t = np.array([e[1] for e in edges] + [e[0] for e in edges], int)
        w = np.array([e[2] for e in edges] * 2, float)
        strength = np.bincount(s, w, n)
        share = w / strength[s] if len(s) else w
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            nxt = damping * (np.bincount(t, r[s] * share, n) + r[strength == 0].sum() / n) + (1 - damping) / n
            done = np.abs(nxt - r).sum() < tolerance
            r = nxt
            if done:
                break
        r /= r.sum()
        return pd.DataFrame({"year": key[0], "corpus_view": key[1], "hierarchy_view": key[2], "institution_id": ids, "pagerank": r})

    return g.groupBy(*VIEW).applyInPandas(run, f"{_V}, institution_id string, pagerank double")


def pagerank_distributed(e: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-13, rounds: int | None = None, block: int = BLOCK_NODES) -> DataFrame:
    """The same by blocks, for views of any size, until a power round would change all views together by less than ``tolerance``.

    All nodes without edges of a view have one rank, which needs no rounds. The linked nodes are cut by
    hash into blocks, the links into tiles (from block, to block) that are written once. A round is one
    job without a shuffle: a task computes blocks of ranks from their tiles and the ranks of the round before.
    As the graph is undirected, the eigenvalues of a round are real and within +-``damping``, so Chebyshev's
    weights apply: errors shrink by damping / (1 + sqrt(1 - damping ** 2)) a round, 0.56 for 0.85, which
    needs some 50 rounds where the power method takes up to 190; ``rounds`` stops earlier.
    """
    spark = e.sparkSession
    scratch = Scratch(spark, "pagerank")
    w = F.col("fractional_count").cast("double")
    ends = e.withColumn("a", F.explode(F.array("source_id", "target_id"))).select(*VIEW, "a", w.alias("s"), F.lit(1).alias("k"))
    known = scratch.write(ends.unionByName(nodes.select(*VIEW, F.col("institution_id").alias("a"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))).groupBy(*VIEW, "a").agg(F.sum("s").alias("s"), F.sum("k").alias("k")), "nodes")
    linked = F.col("s") > 0
    views = known.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("n"), F.count_if(linked).alias("linked"), F.sum("k").alias("k")).collect()
    # rank of a node without edges, which is also what every linked node gets besides its links
    alone = [(1 - damping) / (v.n - damping * (v.n - v.linked)) for v in views]
    rows = [(*[v[c] for c in VIEW], i, max(1, -(-v.linked // block), -(-v.k // TASK_EDGES)), alone[i]) for i, v in enumerate(views)]
    dims = F.broadcast(spark.createDataFrame(rows, StructType([known.schema[c] for c in VIEW]).add("v", "integer").add("blocks", "integer").add("alone", "double")))
    place = known.filter(linked).join(dims, VIEW).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    place = place.withColumn("i", F.row_number().over(Window.partitionBy("v", "block").orderBy("a")) - 1)
    place = scratch.write(place.select(*VIEW, "v", "block", "i", "a", "s"), "place")
    sizes = {(r.v, r.block): r.n for r in place.groupBy("v", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = scratch.uri()

    def end(name: str) -> DataFrame:
        return place.select("v", F.col("a").alias(f"{name}_id"), F.struct("block", "i", "s").alias(name))

    both = e.filter(w > 0).join(dims, VIEW).select("v", "source_id", "target_id", w.alias("w")).join(end("source"), ["v", "source_id"]).join(end("target"), ["v", "target_id"])
    way = lambda a, b: F.struct(F.col(f"{b}.block").alias("t"), F.col(f"{b}.i").alias("ti"), F.col(f"{a}.block").alias("f"), F.col(f"{a}.i").alias("fi"), (F.col("w") / F.col(f"{a}.s")).alias("p"))
    links = both.select("v", F.explode(F.array(way("source", "target"), way("target", "source"))).alias("x")).select("v", "x.*")

    def write_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, t, f = (int(x) for x in key)
        pdf = pdf.sort_values(["ti", "fi"])
        put_bytes(f"{at}/tile-{v}-{t}-{f}", b"".join(pdf[c].to_numpy(kind).tobytes() for c, kind in (("ti", "i4"), ("fi", "i4"), ("p", "f8"))))
        return pd.DataFrame({"v": [v], "t": [t], "f": [f], "n": [len(pdf)]})

    tiles, cost = defaultdict(list), defaultdict(int)
    for r in links.groupBy("v", "t", "f").applyInPandas(write_tile, "v int, t int, f int, n long").collect():
        tiles[r.v, r.t].append(r.f)
        cost[r.v, r.t] += r.n
    # blocks of about equal cost a task
    tasks: list[list[tuple]] = [[] for _ in range(min(len(sizes), spark.sparkContext.defaultParallelism))]
    load = [(0, i) for i in range(len(tasks))]
    for b in sorted(sizes, key=lambda b: (-cost[b], b)):
        least, i = heapq.heappop(load)
        tasks[i].append((*b, alone[b[0]], sizes[b], [(f, sizes[b[0], f]) for f in sorted(tiles[b])]))
        heapq.heappush(load, (least + cost[b] + sizes[b] + 1000, i))
    work = spark.sparkContext.parallelize(tasks, max(1, len(tasks)))
    rate = damping / (1 + math.sqrt(1 - damping**2))
    most = math.ceil(math.log(1e-30) / math.log(max(rate, 0.1))) if rounds is None else rounds  # beyond that only rounding moves
    omega, done = 1.0, 0
    while done < most:
        omega = 1.0 if done == 0 else 1 / (1 - damping**2 / 2) if done == 1 else 1 / (1 - damping**2 * omega / 4)
        change = math.fsum(work.flatMap(_pagerank_round(at, done, damping, omega)).collect())
        done += 1
        if done > 1:
            scratch.delete(f"rank-{done - 2}")
        if change < tolerance:
            break

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["pagerank"] = 0.0
            for (v, b), own in pdf.groupby(["v", "block"]):
                pdf.loc[own.index, "pagerank"] = _ranks(at, done, v, b, sizes[v, b], alone[v], damping)[own["i"].to_numpy()]
            yield pdf[[*VIEW, "a", "pagerank"]].rename(columns={"a": "institution_id"})

    return place.drop("s").mapInPandas(ranks, f"{_V}, institution_id string, pagerank double").unionByName(known.filter(~linked).join(dims, VIEW).select(*VIEW, F.col("a").alias("institution_id"), F.col("alone").alias("pagerank")))


def _ranks(at: str, done: int, v: int, b: int, n: int, alone: float, damping: float) -> np.ndarray:
    """Ranks of a block after so many rounds; before the first all linked nodes of a view have the same."""
    return np.frombuffer(get_bytes(f"{at}/rank-{done}/{v}-{b}")) if done else np.full(n, alone / (1 - damping))


def _pagerank_round(at: str, done: int, damping: float, omega: float) -> Callable[[list[tuple]], list[float]]:
    """Writes the next ranks of blocks; gives what a power round would change in each."""

    def run(blocks: list[tuple]) -> list[float]:
        out, kept = [], (-1, {})
        for v, b, alone, n, froms in sorted(blocks):
            if kept[0] != v:
                kept = (v, {})
            got = np.zeros(n)
            for f, size in froms:
                if f not in kept[1]:
                    if len(kept[1]) >= 64:
                        kept[1].clear()
                    kept[1][f] = _ranks(at, done, v, f, size, alone, damping)
                tile = get_bytes(f"{at}/tile-{v}-{b}-{f}")
                m = len(tile) // 16
                got += np.bincount(np.frombuffer(tile, "i4", m), kept[1][f][np.frombuffer(tile, "i4", m, 4 * m)] * np.frombuffer(tile, "f8", m, 8 * m), n)
            power = damping * got + alone
            out.append(float(np.abs(power - _ranks(at, done, v, b, n, alone, damping)).sum()))
            before = _ranks(at, done - 1, v, b, n, alone, damping) if done else power
            put_bytes(f"{at}/rank-{done + 1}/{v}-{b}", (omega * (power - before) + before).tobytes())
        return out

    return run


def by_size(e: DataFrame, nodes: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame, DataFrame], DataFrame], most: int = TASK_EDGES) -> DataFrame:
    """Views of up to ``most`` edges in a task each, larger ones distributed: the same result, whatever the size of a view.

    Only names of large views come to the driver; there are fewer than edges / ``most``.
    """
    big = e.groupBy(*VIEW).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).drop("_n")
    if big.isEmpty():
        return small(graph_rows(e, nodes))
    rest = lambda df: df.join(big, VIEW, "left_anti")
    own = lambda df: df.join(big, VIEW, "left_semi")
    return small(graph_rows(rest(e), rest(nodes))).unionByName(large(own(e), own(nodes)))


def betweenness(g: DataFrame, block: int = 256) -> DataFrame:
    """Betweenness with distance 1 / weight, divided by (n - 1)(n - 2) / 2.

    Sources are cut into blocks; each block of a view is a task of its own and gives partial sums.
    In views of more than 10,000 nodes only paths of weighted length up to 3 count.
    """
    size = g.filter("kind = 1").groupBy(*VIEW).agg(F.count(F.lit(1)).alias("n"))
    blocks = size.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = _graph(pdf)
        n, blocks = len(ids), int(pdf["blocks"].iloc[0])
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        for a, b, w in edges:
            near[a].append((b, 1 / w))
            near[b].append((a, 1 / w))
        limit = PATH_CUTOFF if n > PATH_CUTOFF_NODES else float("inf")
        total = np.zeros(n)
        for s in range(int(key[3]), n, blocks):
            _brandes(s, near, limit, total)
        scale = (n - 1) * (n - 2) / 2
        return pd.DataFrame({"year": key[0], "corpus_view": key[1], "hierarchy_view": key[2], "institution_id": ids, "part": total / 2 / scale if scale > 0 else np.zeros(n)})

    cut = g.join(blocks, VIEW).groupBy(*VIEW, "block").applyInPandas(run, f"{_V}, institution_id string, part double")
    return cut.groupBy(*VIEW, "institution_id").agg(F.sum("part").alias("betweenness"))


def _brandes(s: int, near: list, limit: float, total: np.ndarray, eps: float = 1e-10) -> None:
    """Add the dependencies of one source: Dijkstra with path counts, then back along the order of settling."""
    dist, paths, before, order = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
    heap, done = [(0.0, s)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, length in near[u]:
            to = d + length
            if to > limit or v in done:
                continue
            old = dist.get(v)
            if old is None or to < old - eps * max(1.0, old):
                dist[v], paths[v], before[v] = to, paths[u], [u]
                heapq.heappush(heap, (to, v))
            elif abs(to - old) <= eps * max(1.0, old):
                paths[v] += paths[u]
                before[v].append(u)
    owed = defaultdict(float)
    for v in reversed(order):
        for u in before[v]:
            owed[u] += paths[u] / paths[v] * (1 + owed[v])
        if v != s:
            total[v] += owed[v]


def components(g: DataFrame) -> DataFrame:
    """Component of every node, named by its smallest id."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = _graph(pdf)
        up = list(range(len(ids)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b, _ in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return pd.DataFrame({"year": key[0], "corpus_view": key[1], "hierarchy_view": key[2], "institution_id": ids, "component_id": [ids[find(i)] for i in range(len(ids))]})

    return g.groupBy(*VIEW).applyInPandas(run, f"{_V}, institution_id string, component_id string")


def components_distributed(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by min-label propagation with pointer jumping, for views of any size."""
    scratch = Scratch(e.sparkSession, "components")
    ends = scratch.write(e.select(*VIEW, F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("x")).select(*VIEW, "x.*").distinct(), "ends")
    label = scratch.write(nodes.select(*VIEW, F.col("institution_id").alias("a"), F.col("institution_id").alias("c")).distinct(), "label")
    while True:
        low = ends.join(label.select(*VIEW, F.col("a").alias("b"), F.col("c").alias("cb")), [*VIEW, "b"]).groupBy(*VIEW, "a").agg(F.min("cb").alias("cb"))
        near = label.join(low, [*VIEW, "a"], "left").withColumn("n", F.least("c", "cb"))
        jump = near.select(*VIEW, F.col("a").alias("n"), F.col("n").alias("nn"))
        nxt = scratch.write(near.select(*VIEW, "a", "c", "n").join(jump, [*VIEW, "n"], "left").select(*VIEW, "a", F.least("n", "nn").alias("c"), (F.least("n", "nn") < F.col("c")).alias("moved")), "label")
        scratch.drop(label)
        label = nxt
        if label.filter("moved").isEmpty():
            return label.select(*VIEW, F.col("a").alias("institution_id"), F.col("c").alias("component_id"))


def _leiden(n: int, edges: list[tuple[int, int, float]], gamma: float, seed: int) -> list[int]:
    """Weighted modularity: local moves, refinement into well-connected parts, aggregation, until stable."""
    rnd = random.Random(seed)
    member = list(range(n))  # node -> vertex of the present level
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    loops = [0.0] * n
    for a, b, w in edges:
        if a == b:
            loops[a] += w
        else:
            near[a][b] += w
            near[b][a] += w
    two_m = sum(sum(x.values()) for x in near) + 2 * sum(loops)
    if two_m == 0:
        return member
    com = list(range(n))
    while True:
        k = [sum(x.values()) + 2 * loops[i] for i, x in enumerate(near)]
        weight: dict[int, float] = defaultdict(float)
        for i, c in enumerate(com):
            weight[c] += k[i]
        queue = list(range(len(near)))
        rnd.shuffle(queue)
        waiting = set(queue)
        while queue:
            i = queue.pop()
            waiting.discard(i)
            to: dict[int, float] = defaultdict(float)
            for j, w in near[i].items():
                to[com[j]] += w
            old = com[i]
            weight[old] -= k[i]
            best, gain = old, to.get(old, 0.0) - gamma * k[i] * weight[old] / two_m
            for c in sorted(to):
                x = to[c] - gamma * k[i] * weight[c] / two_m
                if x > gain + 1e-12:
                    best, gain = c, x
            com[i] = best
            weight[best] += k[i]
            if best != old:
                for j in near[i]:
                    if com[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.insert(0, j)
        part = _refine(near, com, k, gamma, two_m)
        names = {p: q for q, p in enumerate(sorted(set(part)))}
        if len(names) == len(near):  # nothing left to merge
            return [com[v] for v in member]
        new_near: list[dict[int, float]] = [defaultdict(float) for _ in names]
        new_loops, new_com = [0.0] * len(names), [0] * len(names)
        for i, x in enumerate(near):
            p = names[part[i]]
            new_loops[p] += loops[i]
            new_com[p] = com[i]
            for j, w in x.items():
                q = names[part[j]]
                if p == q:
                    new_loops[p] += w / 2
                else:
                    new_near[p][q] += w
        member = [names[part[v]] for v in member]
        near, loops, com = new_near, new_loops, new_com


def _refine(near: list, com: list[int], k: list[float], gamma: float, two_m: float) -> list[int]:
    """Inside each community merge single vertices greedily where modularity gains; parts stay connected."""
    part, weight, size = list(range(len(near))), list(k), [1] * len(near)
    for i in range(len(near)):
        if size[part[i]] > 1:
            continue
        to: dict[int, float] = defaultdict(float)
        for j, w in near[i].items():
            if com[j] == com[i]:
                to[part[j]] += w
        best, gain = part[i], 0.0
        for p in sorted(to):
            if p != part[i]:
                x = to[p] - gamma * k[i] * weight[p] / two_m
                if x > gain + 1e-12:
                    best, gain = p, x
        if best != part[i]:
            weight[part[i]] -= k[i]
            size[part[i]] -= 1
            part[i] = best
            weight[best] += k[i]
            size[best] += 1
    return part


def _modularity(n: int, edges: list[tuple[int, int, float]], com: list[int], gamma: float = 1.0) -> float:
    m = sum(w for *_, w in edges)
    if not m:
        return 0.0
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[com[a]] += w
        total[com[b]] += w
        if com[a] == com[b]:
            inside[com[a]] += w
    return sum(inside[c] / m - gamma * (total[c] / (2 * m)) ** 2 for c in total)


def derived_seed(seed: int, year: int, corpus: str, hierarchy: str, resolution: float) -> int:
    """One seed for each graph and resolution: a year counts 100, a resolution its tenfold, the corpus 2, the hierarchy 1."""
    return seed + year * 100 + int(resolution * 10) + 2 * (corpus != "strict") + (hierarchy != "organization")


def communities(g: DataFrame, seed: int = 20_240) -> DataFrame:
    """Leiden communities at three resolutions: one row for each node and resolution.

    Communities are numbered by their smallest member (C0001, ...); nodes without edges are
    ``isolated``; views of fewer than three active nodes or two edges are ``too_small``.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = _graph(pdf)
        active = sorted({x for e in edges for x in e[:2]})
        at = {v: i for i, v in enumerate(active)}
        small = len(active) < 3 or len(edges) < 2
        own = [(at[a], at[b], w) for a, b, w in edges]
        out = []
        for gamma in RESOLUTIONS:
            names: dict[int, int] = {}
            com = [] if small else _leiden(len(active), own, gamma, derived_seed(seed, int(key[0]), key[1], key[2], gamma))
            for c in com:
                names.setdefault(c, len(names))
            sizes = defaultdict(int)
            for c in com:
                sizes[c] += 1
            q = None if small else _modularity(len(active), own, com)
            for i, x in enumerate(ids):
                c = com[at[i]] if not small and i in at else None
                status = "isolated" if i not in at else "too_small" if small else "complete"
                out.append((*key, x, gamma, None if c is None else f"C{names[c] + 1:04d}", None if c is None else sizes[c], status, q))
        return pd.DataFrame(out, columns=[*VIEW, "institution_id", "resolution", "community_id", "community_size", "status", "modularity"]).astype({"community_size": "Int32"})

    return g.groupBy(*VIEW).applyInPandas(run, f"{_V}, institution_id string, resolution double, community_id string, community_size int, status string, modularity double")


def community_summary(c: DataFrame) -> DataFrame:
    """Communities, active nodes and modularity of each view and resolution."""
    return c.groupBy(*VIEW, "resolution").agg(
        F.count_distinct("community_id").alias("community_count"), F.max("modularity").alias("modularity"), F.count_if(F.col("status") != "isolated").alias("active_node_count"),
        F.when(F.count_if(F.col("status") == "complete") > 0, "complete").otherwise("too_small").alias("status"),
    )


def community_checks(c: DataFrame) -> DataFrame:
    """A row a view and resolution: nodes, isolated nodes, rows too many, and members of communities whose told size is wrong."""
    keys = [*VIEW, "resolution"]
    n = c.groupBy(*keys).agg(F.count_distinct("institution_id").alias("node_count"), F.count_if(F.col("status") == "isolated").alias("isolated_node_count"), (F.count(F.lit(1)) - F.count_distinct("institution_id")).alias("repeated_count"))
    own = c.filter("community_id is not null").groupBy(*keys, "community_id").agg(F.count(F.lit(1)).alias("n"), F.min("community_size").alias("lo"), F.max("community_size").alias("hi"))
    wrong = own.filter("lo <> n or hi <> n").groupBy(*keys).agg(F.sum("n").alias("wrong_size_count"))
    return n.join(wrong, keys, "left").fillna(0, ["wrong_size_count"])


def community_overlaps(c: DataFrame) -> DataFrame:
    """Overlaps of the communities of adjacent years: shared members, sizes, Jaccard."""
    view = ["corpus_view", "hierarchy_view"]
    m = c.filter("community_id is not null").select(*VIEW, "institution_id", "community_id")
    size = m.groupBy(*VIEW, "community_id").agg(F.count(F.lit(1)).alias("size"))
    a = m.withColumnRenamed("community_id", "previous_community_id").withColumn("year", F.col("year") + 1)
    i = a.join(m.withColumnRenamed("community_id", "current_community_id"), [*VIEW, "institution_id"]).groupBy(*VIEW, "previous_community_id", "current_community_id").agg(F.count(F.lit(1)).alias("intersection_size"))
    p = size.select(*view, (F.col("year") + 1).alias("year"), F.col("community_id").alias("previous_community_id"), F.col("size").alias("previous_size"))
    q = size.select(*VIEW, F.col("community_id").alias("current_community_id"), F.col("size").alias("current_size"))
    o = i.join(p, [*VIEW, "previous_community_id"]).join(q, [*VIEW, "current_community_id"])
    return o.withColumn("jaccard", F.col("intersection_size") / (F.col("previous_size") + F.col("current_size") - F.col("intersection_size")))


def continuity(c: DataFrame, confident: float = 0.25, event: float = 0.10) -> DataFrame:
    """Continuity id and event of every annual community.

    Overlaps of adjacent years are matched one to one by (Jaccard, shared members) falling and ids
    rising; a matched community inherits its id, others get a new one. Ids are numbered within a
    view (CT-<C><H>-00001). The overlaps are aggregated natively; only the ordered matching, over
    communities and not members, runs as one task a view.
    """
    view = ["corpus_view", "hierarchy_view"]
    size = c.filter("community_id is not null").groupBy(*VIEW, "community_id").agg(F.count(F.lit(1)).alias("n"))
    o = community_overlaps(c)
    rows = size.select(*VIEW, F.col("community_id").alias("cur"), F.lit(None).cast("string").alias("prev"), F.col("n").alias("i"), F.lit(None).cast("double").alias("jaccard")).unionByName(
        o.select(*VIEW, F.col("current_community_id").alias("cur"), F.col("previous_community_id").alias("prev"), F.col("intersection_size").alias("i"), "jaccard"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, out = {}, 0, []
        code = f"{key[0][0].upper()}{key[1][0].upper()}"
        for year, own in pdf.groupby("year", sort=True):
            links = sorted(((-r.jaccard, -r.i, r.prev, r.cur) for r in own.itertuples() if isinstance(r.prev, str)))
            took_p, took_c = {}, {}
            for j, _, p, q in links:
                if p not in took_p and q not in took_c:
                    took_p[p], took_c[q] = q, (p, -j)
            strong = [(p, q) for j, _, p, q in links if -j >= event]
            into, outof = defaultdict(int), defaultdict(int)
            for p, q in strong:
                into[q] += 1
                outof[p] += 1
            for r in sorted((r for r in own.itertuples() if not isinstance(r.prev, str)), key=lambda r: r.cur):
                p, j = took_c.get(r.cur, (None, None))
                inherited = ids.get((year - 1, p)) if p is not None else None
                if inherited is None:
                    n += 1
                    inherited = f"CT-{code}-{n:05d}"
                ids[year, r.cur] = inherited
                merge = into[r.cur] > 1
                split = any(outof[a] > 1 for a, b in strong if b == r.cur)
                if p is None:
                    what = "split_birth" if split else "birth"
                elif j < event:
                    what = "minor_overlap"
                else:
                    what = "split_merge" if split and merge else "split" if split else "merge" if merge else "continuation"
                out.append((year, key[0], key[1], r.cur, r.i, inherited, p, j, what, p is not None and j < confident))
        return pd.DataFrame(out, columns=[*VIEW, "community_id", "community_size", "continuity_id", "previous_community_id", "jaccard", "event", "is_uncertain"])

    return rows.groupBy(*view).applyInPandas(run, f"{_V}, community_id string, community_size long, continuity_id string, previous_community_id string, jaccard double, event string, is_uncertain boolean")


def disappearances(c: DataFrame, event: float = 0.10) -> DataFrame:
    """Communities without a match in the next year of their view's record."""
    k = continuity(c, event=event)
    used = k.filter("previous_community_id is not null").select((F.col("year") - 1).alias("year"), "corpus_view", "hierarchy_view", F.col("previous_community_id").alias("community_id"))
    last = k.groupBy("corpus_view", "hierarchy_view").agg(F.max("year").alias("last"))
    merged = community_overlaps(c).filter(F.col("jaccard") >= event).select((F.col("year") - 1).alias("year"), "corpus_view", "hierarchy_view", F.col("previous_community_id").alias("community_id")).distinct().withColumn("merged", F.lit(True))
    d = k.join(used, [*VIEW, "community_id"], "left_anti").join(last, ["corpus_view", "hierarchy_view"]).filter("year < last").join(merged, [*VIEW, "community_id"], "left")
    return d.select(*VIEW, "community_id", "continuity_id", F.when(F.col("merged"), "merge_disappearance").otherwise("disappearance").alias("event"))


def layout(e: DataFrame, nodes: DataFrame, seed: int = 20_240, core: int = 500, rounds: int = 500) -> DataFrame:
    """Fixed coordinates: the strongest ``core`` institutions by force-directed layout, all others on a ring.

    The core is bounded, so its layout is one small task. Ring positions come from a hash of the
    id: angle, and radius between 1.10 and 1.45.
    """
    fixed = (F.col("corpus_view") == "broad") & (F.col("hierarchy_view") == "organization")
    s = nodes.filter(fixed).groupBy("institution_id").agg(F.sum("fractional_strength").alias("strength"))
    top = s.orderBy(F.desc("strength"), "institution_id").limit(core).withColumn("core", F.lit(True))
    inner = e.filter(fixed).groupBy("source_id", "target_id").agg(F.sum("fractional_count").alias("w"))
    inner = inner.join(top.select(F.col("institution_id").alias("source_id")), "source_id", "left_semi").join(top.select(F.col("institution_id").alias("target_id")), "target_id", "left_semi")
    rows = inner.select(F.lit(1).alias("g"), F.lit(0).alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "w").unionByName(top.select(F.lit(1).alias("g"), F.lit(1).alias("kind"), F.col("institution_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = _graph(pdf)
        n = len(ids)
        rng = np.random.default_rng(seed)
        angle = 2 * np.pi * np.arange(n) / max(1, n)
        pos = np.c_[np.cos(angle), np.sin(angle)] + rng.normal(0, 1e-3, (n, 2))
        a, b, w = (np.array([x[i] for x in edges], t) for i, t in ((0, int), (1, int), (2, float)))
        k, heat = 1 / np.sqrt(max(1, n)), 0.1
        for step in range(rounds if n > 1 else 0):
            d = pos[:, None] - pos[None]
            r = np.sqrt((d**2).sum(2)) + 1e-9
            push = (d * (k * k / r**2)[..., None]).sum(1)
            if len(a):
                x = pos[a] - pos[b]
                pull = x * (w * (np.sqrt((x**2).sum(1)) + 1e-9) / k)[:, None]
                np.subtract.at(push, a, pull)
                np.add.at(push, b, pull)
            size = np.sqrt((push**2).sum(1)) + 1e-9
            pos = pos + push / size[:, None] * np.minimum(size, heat * (1 - step / rounds))[:, None]
        pos = pos - pos.mean(0)
        pos = pos / (np.abs(pos).max() or 1.0)
        return pd.DataFrame({"institution_id": ids, "cx": pos[:, 0], "cy": pos[:, 1]})

    placed = rows.groupBy("g").applyInPandas(run, "institution_id string, cx double, cy double")
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), "institution_id"), 256)
    unit = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("double") / float(16**12)
    angle, radius = unit(1) * 2 * 3.141592653589793, 1.10 + 0.35 * unit(13)
    j = s.join(top.select("institution_id", "core"), "institution_id", "left").join(placed, "institution_id", "left").withColumn("is_core", F.coalesce("core", F.lit(False)))
    return j.select("institution_id", "strength", "is_core", F.when(F.col("is_core"), F.col("cx")).otherwise(radius * F.cos(angle)).alias("x"), F.when(F.col("is_core"), F.col("cy")).otherwise(radius * F.sin(angle)).alias("y"))
