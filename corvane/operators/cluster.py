"""Clusterings. MLlib's k-means is distributed; graph and linkage methods run one configuration a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_ROWS = 8_000  # linkage methods hold all distances of a group in one task's memory: half a gigabyte, and as much in between


def kmeans(vectors: DataFrame, k: int, seeds: Sequence[int] = tuple(range(10)), iterations: int = 20) -> DataFrame:
    """(id, cluster) of the seed with the lowest cost."""
    # a step of a fit sends a result a task to the driver, so there are no more tasks than cores need
    tasks = 2 * int(vectors.sparkSession.sparkContext.defaultParallelism)
    rows = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features")).coalesce(tasks).persist()
    models = [KMeans(k=k, seed=s, maxIter=iterations).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).select("id", F.col("prediction").alias("cluster"))


EDGES_AT_ONCE = 1 << 20  # whose gains are made at once; a graph itself is 12 bytes an edge and end


class _Graph:
    """Edges by their first end: those of node v stand from ``start[v]`` to ``start[v + 1]``. ``degree`` counts a loop twice, and is kept when edges are dropped."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, degree: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.n, self.to, self.weight, self.degree = n, dst[order].astype(np.int32), weight[order], degree
        self.start = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, place of the edge) of all edges of the nodes."""
        size = self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(np.arange(len(nodes)), size)
        return at, np.arange(len(at)) + np.repeat(self.start[nodes] - np.cumsum(size) + size, size)

    def batches(self, nodes: np.ndarray) -> Iterator[np.ndarray]:
        ends = np.cumsum(self.start[nodes + 1] - self.start[nodes])
        cuts = np.unique(np.searchsorted(ends, np.arange(EDGES_AT_ONCE, int(ends[-1]) if len(ends) else 0, EDGES_AT_ONCE)) + 1)
        yield from (x for x in np.split(nodes, cuts) if len(x))


def _best(graph: _Graph, nodes: np.ndarray, label: np.ndarray, mass: np.ndarray, gamma: float, double: float) -> np.ndarray:
    """The neighbouring community of the largest gain of each node, its own if none gains; ties go to the lower one."""
    out = label[nodes].copy()
    for offset, part in _offsets(graph.batches(nodes)):
        at, edge = graph.edges(part)
        if not len(at):
            continue
        key = at * np.int64(graph.n) + label[graph.to[edge]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        at, to, w = key[first] // graph.n, key[first] % graph.n, np.add.reduceat(graph.weight[edge[order]], first)
        own, degree = label[part], graph.degree[part]
        gain = w - gamma * degree[at] * (mass[to] - np.where(to == own[at], degree[at], 0)) / double
        stay = -gamma * degree * (mass[own] - degree) / double
        mine = to == own[at]
        stay[at[mine]] = gain[mine]
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        top, of = np.maximum.reduceat(gain, begin), at[begin]
        place = np.where(gain == top[np.cumsum(np.concatenate(([0], at[1:] != at[:-1])))], np.arange(len(gain)), len(gain))
        better = top > stay[of] + 1e-12
        out[offset + of[better]] = to[np.minimum.reduceat(place, begin)][better]
    return out


def _offsets(parts: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    for part in parts:
        yield at, part
        at += len(part)


def _gained(graph: _Graph, nodes: np.ndarray, label: np.ndarray, new: np.ndarray, mass: np.ndarray, after: np.ndarray, gamma: float, double: float) -> float:
    """What the quality gains by moving all the nodes at once."""
    moving = np.zeros(graph.n, bool)
    moving[nodes] = True
    total = -gamma * float((after * after - mass * mass).sum()) / (2 * double)
    for part in graph.batches(nodes):
        at, edge = graph.edges(part)
        to = graph.to[edge]
        total += float((graph.weight[edge] * ((new[part][at] == new[to]).astype(np.int8) - (label[part][at] == label[to])) * np.where(moving[to], 0.5, 1.0)).sum())
    return total


def _move(graph: _Graph, label: np.ndarray, gamma: float, double: float, rng: np.random.Generator) -> bool:
    """Move nodes to the neighbouring community of the largest gain until none that is asked again gains.

    All nodes are asked at once, and a random part of those that would gain moves. If that does not raise the quality a smaller part is drawn, down to
    one node, whose gain is sure; so the quality rises with each round, and the rounds end.
    """
    mass, moved, share = np.bincount(label, graph.degree, minlength=graph.n), False, 0.5
    active = np.arange(graph.n)
    while len(active):
        best = _best(graph, active, label, mass, gamma, double)
        gains = best != label[active]
        active, best = active[gains], best[gains]
        if not len(active):
            break
        while True:
            chosen = rng.random(len(active)) < share if len(active) > 1 else np.ones(1, bool)
            if share * len(active) < 1 or not chosen.any():
                chosen = np.zeros(len(active), bool)
                chosen[rng.integers(len(active))] = True
            nodes, new = active[chosen], label.copy()
            new[nodes] = best[chosen]
            after = mass + np.bincount(new[nodes], graph.degree[nodes], minlength=graph.n) - np.bincount(label[nodes], graph.degree[nodes], minlength=graph.n)
            if len(nodes) == 1 or _gained(graph, nodes, label, new, mass, after, gamma, double) > 1e-12:
                share = min(0.5, 2 * share)
                break
            share /= 2
        asked = np.zeros(graph.n, bool)
        asked[active[~chosen]] = True
        for part in graph.batches(nodes):
            at, edge = graph.edges(part)
            to = graph.to[edge]
            asked[to[new[to] != new[part][at]]] = True
        label[:], mass, moved = new, after, True
        active = np.flatnonzero(asked)
    return moved


def leiden_labels(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, gamma: float = 1.0, seed: int = 0) -> np.ndarray:
    """Community of each node: local moves, refinement inside the communities, aggregation, until nothing moves.

    Labels run from 0, the largest community first.
    """
    rng = np.random.default_rng(seed)
    weight = np.asarray(weight, np.float64)
    loop = src == dst
    loops, src, dst, weight = np.bincount(src[loop], weight[loop], minlength=n), src[~loop], dst[~loop], weight[~loop]
    degree = np.bincount(src, weight, minlength=n) + np.bincount(dst, weight, minlength=n) + 2 * loops
    double = max(float(degree.sum()), 1e-300)
    node, label = np.arange(n), np.arange(n)
    while True:
        graph = _Graph(len(degree), np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((weight, weight)), degree)
        moved = _move(graph, label, gamma, double, rng)
        inside = label[src] == label[dst]
        a, b, w = src[inside], dst[inside], weight[inside]
        fine = np.arange(graph.n)
        _move(_Graph(graph.n, np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)), degree), fine, gamma, double, rng)
        kept, fine = np.unique(fine, return_inverse=True)
        if not moved or len(kept) == graph.n:
            break
        size = len(kept)
        next_label = np.zeros(size, np.int64)
        next_label[fine] = label
        degree = np.bincount(fine, degree, minlength=size)
        low, high = np.minimum(fine[src], fine[dst]), np.maximum(fine[src], fine[dst])
        apart = low != high
        pair, at = np.unique(low[apart] * np.int64(size) + high[apart], return_inverse=True)
        src, dst, weight = pair // size, pair % size, np.bincount(at, weight[apart], minlength=len(pair))
        node = fine[node]
        _, label = np.unique(next_label, return_inverse=True)
    flat = label[node]
    order = np.argsort(-np.bincount(flat), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[flat]


def leiden(graph: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, id, cluster) for each of ``configs`` (config_id, gamma, seed): one task a configuration.

    ``graph`` may have a config_id of its own (graphs of several k); else every configuration gets it all.
    """
    given = {r["config_id"]: (float(r["gamma"]), int(r["seed"])) for r in configs.select("config_id", "gamma", "seed").collect()}  # a row a configuration
    per = graph.join(F.broadcast(configs.select("config_id")), "config_id") if "config_id" in graph.columns else graph.crossJoin(F.broadcast(configs.select("config_id")))

    def run(table: pa.Table) -> pa.Table:
        config_id = table.column("config_id")[0].as_py()
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
        found = leiden_labels(len(ids), ends[: len(src)], ends[len(src) :], weight, *given[config_id])
        return pa.table({"config_id": pa.array(np.full(len(ids), config_id), pa.int64()), "id": pa.array(ids, pa.int64()), "cluster": pa.array(found, pa.int64())})

    tasks = max(4 * len(given), int(graph.sparkSession.sparkContext.defaultParallelism))  # else several configurations of few bytes are one task's
    return per.select("config_id", "src", "dst", "weight").repartition(tasks, "config_id").groupBy("config_id").applyInArrow(run, "config_id long, id long, cluster long")


def _distances(v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return np.maximum(1 - v @ v.T, 0)
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T, 0))


def average_linkage(v: np.ndarray, clusters: int, metric: str = "cosine") -> np.ndarray:
    """Labels of the cut of an average-linkage tree, found by nearest-neighbour chains."""
    n = len(v)
    d = _distances(v.astype(np.float64), metric)
    np.fill_diagonal(d, np.inf)
    size, live, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            a = chain[-1]
            row = np.where(live, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), min(a, b), max(a, b)))
        low, high = min(a, b), max(a, b)
        d[low] = (size[low] * d[low] + size[high] * d[high]) / (size[low] + size[high])
        d[:, low] = d[low]
        d[low, low] = np.inf
        size[low] += size[high]
        live[high] = False
    parent = np.arange(n)
    find = lambda x: x if parent[x] == x else find(int(parent[x]))
    for _, a, b in sorted(merges)[: max(0, n - clusters)]:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def hdbscan_labels(v: np.ndarray, min_cluster_size: int, min_samples: int | None = None, leaf: bool = False, metric: str = "euclidean") -> np.ndarray:
    """Density clusters, -1 for noise: mutual reachability, spanning tree, condensed tree, excess of mass or leaves."""
    n, k = len(v), min(min_samples or min_cluster_size, len(v))
    d = _distances(v.astype(np.float64), metric)
    core = np.partition(d, k - 1, axis=1)[:, k - 1]
    best, source, inside, tree = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(d[at], core), core[at])
        closer = ~inside & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        tree.append((float(best[at]), int(source[at]), at))
    parent, left, count, height = list(range(n)), {}, [1] * n, {}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for w, a, b in sorted(tree):
        x, y = find(a), find(b)
        parent[x] = parent[y] = len(parent)
        left[len(parent)], height[len(parent)] = (x, y), w
        count.append(count[x] + count[y])
        parent.append(len(parent))
    if n < 2:
        return np.full(n, -1)

    def points(x: int) -> list[int]:
        stack, out = [x], []
        while stack:
            y = stack.pop()
            (stack.extend(left[y]) if y in left else out.append(y))
        return out

    births, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack = [(len(parent) - 1, 0)]
    while stack:
        x, c = stack.pop()
        if x not in left:
            members[c].append(x)
            continue
        lam = 1 / max(height[x], 1e-12)
        big = [y for y in left[x] if count[y] >= min_cluster_size]
        for y in left[x]:
            if y not in big:
                fallen = points(y)
                members[c] += fallen
                stability[c] += len(fallen) * (lam - births[c])
        if len(big) == 2:
            for y in big:
                new = len(births)
                births[new], stability[new], children[new], members[new] = lam, 0.0, [], []
                children[c].append(new)
                stability[c] += count[y] * (lam - births[c])
                stack.append((y, new))
        elif big:
            stack.append((big[0], c))
    chosen: set[int] = set()
    if leaf:
        chosen = {c for c in births if not children[c] and c}
    else:
        value = dict(stability)
        for c in sorted(births, reverse=True):
            below = sum(value[x] for x in children[c])
            if c and value[c] >= below:
                chosen.add(c)
                under = list(children[c])
                while under:
                    x = under.pop()
                    chosen.discard(x)
                    under += children[x]
            else:
                value[c] = below
    label = np.full(n, -1)
    for i, c in enumerate(sorted(chosen)):
        under = [c]
        while under:
            x = under.pop()
            label[members[x]] = i
            under += children[x]
    return label


def grouped(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, id, cluster, reason) of linkage methods: ``configs`` has config_id, method, size.

    A configuration that cannot run is one row with its reason, without id and cluster. Above EXACT_ROWS rows that is all of them, and
    no sample is taken: those methods need all distances at once.
    """
    schema = "config_id long, id long, cluster long, reason string"
    n = vectors.count()
    if n > EXACT_ROWS:
        reason = f"{n} rows; linkage methods take {EXACT_ROWS} at most: cluster the centres of a k-means first"
        return configs.select("config_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("cluster"), F.lit(reason).alias("reason"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        config_id, method, size = int(pdf["config_id"].iloc[0]), pdf["method"].iloc[0], int(pdf["size"].iloc[0])
        try:
            v = np.stack(pdf["v"].to_numpy())
            found = average_linkage(v, size) if method == "agglomerative" else hdbscan_labels(v, size, leaf=method == "hdbscan_leaf")
        except Exception as e:  # the other configurations go on
            return pd.DataFrame({"config_id": [config_id], "id": pd.array([None], "Int64"), "cluster": pd.array([None], "Int64"), "reason": [f"{type(e).__name__}: {e}"]})
        return pd.DataFrame({"config_id": config_id, "id": pdf["id"], "cluster": found, "reason": None})

    return vectors.crossJoin(F.broadcast(configs)).groupBy("config_id").applyInPandas(run, schema)


def centroids(rows: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean vector of each cluster."""
    each = rows.select(label, F.posexplode(F.col("v").cast("array<double>")).alias("d", "x"))
    mean = each.groupBy(label, "d").agg(F.avg("x").alias("x"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centre"))

