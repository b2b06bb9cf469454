"""Clustering runs over feature sets: mini-batch k-means over many sets in one pass, and a grid search of four methods with a score for each run."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import balanced_score
from . import cluster, knn, metrics
from .spaces import BASE, feature, matrices, stacked, weights_of

SAMPLE_ROWS = 20_480  # rows that the batches of mini-batch k-means are drawn from
NO_SCORE = -999.0
SUBSETS = {"all": "all", "excluding_other": "excluding_other", "single_clear_label": "single_clear"}


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres, each drawn by its squared distance to those before."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1, dtype=np.float64)
    while len(centres) < k:
        total = d.sum()
        centres.append(x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1, dtype=np.float64))
    return np.array(centres, np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T
    return d.argmin(1), float(np.maximum(d.min(1), 0).sum())


def minibatch_centres(x: np.ndarray, k: int, seed: int, n_init: int = 5, batch: int = 512, steps: int = 60) -> np.ndarray:
    """Centres of the start of the lowest cost: each batch moves its nearest centres by a share that falls with what they have seen."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros((0, x.shape[1])))
    for _ in range(n_init if len(x) else 0):
        centres, seen = _start(x[rng.permutation(len(x))[: 3 * batch]], k, rng), np.zeros(k)
        for _ in range(steps):
            part = x[rng.integers(0, len(x), batch)]
            label, _ = _nearest(part, centres)
            n = np.bincount(label, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, part)
            seen += n
            hit = n > 0
            centres[hit] += (sums[hit] - n[hit, None] * centres[hit]) / seen[hit, None]
        cost = _nearest(x, centres)[1]
        best = min(best, (cost, centres), key=lambda b: b[0])
    return best[1]


def minibatch_kmeans(wide: DataFrame, sets: Mapping[str, Mapping[str, float]], k: int = 12, seed: int = 42, n_init: int = 5, batch: int = 512) -> DataFrame:
    """(feature_set, id, cluster) of every row under every set of the catalogue ``wide``.

    Batches are drawn from the ``SAMPLE_ROWS`` rows of the lowest digests, which is all that reaches the driver; one task fits a set, and one pass over the rows assigns them to
    the centres of all sets.
    """
    spark = wide.sparkSession
    rows = wide.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).select(*BASE).toArrow()
    sample = spark.sparkContext.broadcast({c: x.astype(np.float32) for c, x in matrices(rows).items()})
    fitting = spark.createDataFrame([(name, list(w), list(w.values())) for name, w in sets.items()], "feature_set string, spaces array<string>, weights array<double>")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [minibatch_centres(stacked(sample.value, dict(zip(r.spaces, r.weights, strict=True))), k, seed, n_init, batch) for r in frame.itertuples()]
            yield pd.DataFrame({"feature_set": frame["feature_set"], "centres": [c.ravel().tolist() for c in made]})

    found = {r["feature_set"]: np.array(r["centres"]) for r in fitting.repartition(len(sets)).mapInPandas(fit, "feature_set string, centres array<double>").collect()}
    centres = spark.sparkContext.broadcast(found)
    plans = {name: dict(w) for name, w in sets.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            spaces = matrices(rows)
            for name, w in plans.items():
                x = stacked(spaces, w)
                label, _ = _nearest(x, centres.value[name].reshape(k, -1)) if len(x) else (np.empty(0, np.int64), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows.num_rows), rows.column("id"), pa.array(label, pa.int64())], ["feature_set", "id", "cluster"])

    return wide.select("id", *BASE).mapInArrow(assign, f"feature_set string, id {wide.schema['id'].dataType.simpleString()}, cluster long")


def evaluate(found: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a labelling: sizes, noise, agreement over all rows, over those without ``other`` and over those of one label, and the balanced score.

    ``found`` has ``by``, id and cluster; ``truth`` id, t (primary label), macros and mask.
    """
    by = list(by)
    rows = found.join(truth, "id").withColumn("k", F.col("cluster")).persist()
    parts = metrics.subsets(rows).where(F.col("subset").isin(*SUBSETS))
    suite = metrics.suite(parts, [*by, "subset"]).persist()
    whole = suite.where("subset = 'all'").select(
        *by, "rows", "cluster_count", "largest_cluster_share", F.col("f1").alias("pairwise_f1_all"), F.col("precision").alias("pairwise_precision_all"), F.col("recall").alias("pairwise_recall_all")
    )
    agreed = suite.groupBy(*by).agg(
        *(F.coalesce(F.max(F.when(F.col("subset") == s, F.col(m))), F.lit(0.0)).alias(f"{m}_{name}") for s, name in SUBSETS.items() for m in ("ari", "ami", "v_measure"))
    )
    noise = rows.groupBy(*by).agg(F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share"))
    out = whole.join(agreed, by).join(noise, by)
    score = balanced_score(*(F.col(c) for c in ("ari_excluding_other", "v_measure_excluding_other", "ami_excluding_other", "pairwise_f1_all", "cluster_count", "largest_cluster_share", "noise_share")))
    return out.withColumn("balanced_score", score)


@dataclass(frozen=True)
class Run:
    """One configuration of a search."""

    feature_set: str
    method: str
    params: str
    k: int | None = None
    resolution: float | None = None
    seed: int | None = None


#: The search's grids.
NEIGHBOURS, RESOLUTIONS, SEEDS = (10, 15, 20, 30, 50, 75), (0.35, 0.5, 0.65, 0.8, 1.0, 1.2, 1.5, 2.0, 2.5), (1, 7, 42)
KMEANS, LINKAGE = (6, 8, 10, 12, 15, 18, 20, 25, 30), (8, 10, 12, 15, 20, 25)
DENSITY = ((30, 5, "eom"), (50, 10, "eom"), (75, 10, "eom"), (100, 20, "eom"), (150, 20, "eom"), (50, 10, "leaf"))


def leiden_runs(name: str, neighbours: Sequence[int] = NEIGHBOURS, resolutions: Sequence[float] = RESOLUTIONS, seeds: Sequence[int] = SEEDS) -> list[Run]:
    return [Run(name, "leiden", f"k={k};resolution={g};seed={s}", k, g, s) for k in neighbours for g in resolutions for s in seeds]


def grid(ranked_sets: Sequence[str]) -> list[Run]:
    """All runs over the three best sets of an ablation and the single spaces: Leiden, k-means and linkage on each, density on the best two and the dense one."""
    chosen = list(dict.fromkeys([*ranked_sets[:3], "dense", "word", "char"]))
    out: list[Run] = []
    for name in chosen:
        out += leiden_runs(name)
        out += [Run(name, "kmeans", f"n_clusters={n}", n) for n in KMEANS]
        out += [Run(name, "agglomerative", f"n_clusters={n};linkage=average", n) for n in LINKAGE]
        if name in {*chosen[:2], "dense"}:
            out += [Run(name, "hdbscan", f"min_cluster_size={c};min_samples={s};method={m}", c) for c, s, m in DENSITY]
    return out


def _labels(run: Run, x: np.ndarray, near: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    given = dict(p.split("=", 1) for p in run.params.split(";"))
    if run.method == "leiden":
        neighbour, distance = near[0][:, : run.k], near[1][:, : run.k]
        ends = np.stack((np.repeat(np.arange(len(x)), neighbour.shape[1]), neighbour.ravel()))
        weight = np.maximum(0, 1 - distance.ravel())
        ok = ends[1] >= 0
        low, high, weight = ends.min(0)[ok], ends.max(0)[ok], weight[ok]
        pair, at = np.unique(low * len(x) + high, return_inverse=True)
        mean = np.bincount(at, weight) / np.bincount(at)
        return cluster.leiden_labels(len(x), pair // len(x), pair % len(x), mean, run.resolution, run.seed)
    if run.method == "kmeans":
        rng, best = np.random.default_rng(42), (np.inf, np.zeros(len(x), np.int64))
        for _ in range(10):
            centres = _start(x, min(run.k, len(x)), rng)
            for _ in range(50):
                label, cost = _nearest(x, centres)
                sums = np.zeros_like(centres)
                np.add.at(sums, label, x)
                n = np.bincount(label, minlength=len(centres))
                moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
                if np.allclose(moved, centres):
                    break
                centres = moved
            best = min(best, (cost, label), key=lambda b: b[0])
        return best[1]
    if run.method == "agglomerative":
        return cluster.average_linkage(x, run.k)
    return cluster.hdbscan_labels(x, run.k, int(given["min_samples"]), given["method"] == "leaf")


def label_runs(wide: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """(run, id, cluster, reason): every run's labels; ``run`` is its place in ``runs``, and one that cannot be made is a row with its reason alone.

    The neighbours of a set are found once, by blocks over all tasks. One task makes a run, up to ``cluster.EXACT_ROWS`` rows. Above them, k-means is MLlib's, a
    graph is still one task's, and linkage and density runs, which need all distances, are rows with that reason; no sample is taken.
    """
    spark = wide.sparkSession
    schema = "run int, id long, cluster long, reason string"
    n = wide.count()
    if n > cluster.EXACT_ROWS:
        return _distributed(wide, runs, n)
    ordered = wide.orderBy("id").select("id", *BASE).toArrow()
    ids, spaces = ordered.column("id").to_numpy(), {c: x.astype(np.float32) for c, x in matrices(ordered).items()}
    near: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in dict.fromkeys(r.feature_set for r in runs if r.method == "leiden"):
        most = max(r.k for r in runs if r.feature_set == name and r.method == "leiden")
        found = knn.knn(wide.select("id", feature(weights_of(name)).alias("v")), most).select("id", "neighbour", "rank", "distance").toPandas()
        table = np.full((n, most), -1, np.int32), np.ones((n, most), np.float32)
        at = np.searchsorted(ids, found["id"]), found["rank"].to_numpy() - 1
        table[0][at], table[1][at] = np.searchsorted(ids, found["neighbour"]), found["distance"]
        near[name] = table
    shared = spark.sparkContext.broadcast((ids, spaces, near))  # EXACT_ROWS rows at most
    todo = spark.createDataFrame([(i, *asdict(r).values()) for i, r in enumerate(runs)], "run int, feature_set string, method string, params string, k int, resolution double, seed int")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, spaces, near = shared.value
        for frame in frames:
            for r in frame.itertuples():
                run = Run(r.feature_set, r.method, r.params, int(r.k), None if r.resolution != r.resolution else float(r.resolution), None if r.seed != r.seed else int(r.seed))
                try:
                    label = _labels(run, stacked(spaces, weights_of(run.feature_set)).astype(np.float64), near.get(run.feature_set))
                    yield pd.DataFrame({"run": r.run, "id": ids, "cluster": label.astype(np.int64), "reason": None})
                except Exception as e:  # the other runs go on
                    yield pd.DataFrame({"run": [r.run], "id": pd.array([None], "Int64"), "cluster": pd.array([None], "Int64"), "reason": [f"{type(e).__name__}: {e}"]})

    tasks = min(len(runs), 4 * int(spark.sparkContext.defaultParallelism))
    return todo.repartitionById(tasks, F.pmod("run", F.lit(tasks))).mapInPandas(make, schema)


def _distributed(wide: DataFrame, runs: Sequence[Run], n: int) -> DataFrame:
    spark = wide.sparkSession
    numbered = list(enumerate(runs))
    reason = f"{n} rows; linkage and density methods take {cluster.EXACT_ROWS} at most: cluster the centres of a k-means first"
    failed = [(i, None, None, reason) for i, r in numbered if r.method in ("agglomerative", "hdbscan")]
    out = spark.createDataFrame(failed, "run int, id long, cluster long, reason string")
    made = lambda d: d.select(F.col("run").cast("int").alias("run"), "id", F.col("cluster").cast("long").alias("cluster"), F.lit(None).cast("string").alias("reason"))
    for name in dict.fromkeys(r.feature_set for r in runs):
        v = wide.select("id", feature(weights_of(name)).alias("v")).persist()
        mine = [(i, r) for i, r in numbered if r.feature_set == name]
        for i, r in mine:
            if r.method == "kmeans":
                out = out.unionByName(made(cluster.kmeans(v, r.k, seeds=tuple(range(10))).withColumn("run", F.lit(i))))
        graphs = [(i, r) for i, r in mine if r.method == "leiden"]
        if graphs:
            near = knn.knn(v, max(r.k for _, r in graphs)).persist()
            of_k = {k: knn.edges(near.where(F.col("rank") <= k)) for k in dict.fromkeys(r.k for _, r in graphs)}
            for k, graph in of_k.items():
                configs = spark.createDataFrame([(i, r.resolution, r.seed) for i, r in graphs if r.k == k], "config_id long, gamma double, seed long")
                out = out.unionByName(made(cluster.leiden(graph, configs).withColumnRenamed("config_id", "run")))
    return out


def search(wide: DataFrame, truth: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """One row a run, best first: what it is, its scores, and a reason with a score of -999 where it could not be made."""
    found = label_runs(wide, runs).persist()
    what = wide.sparkSession.createDataFrame([(i, *asdict(r).values()) for i, r in enumerate(runs)], "run int, feature_set string, method string, params string, k int, resolution double, seed int")
    scored = evaluate(found.where("reason IS NULL").drop("reason"), truth, ["run"])
    failed = found.where("reason IS NOT NULL").select("run", "reason")
    out = what.join(scored, "run", "left").join(failed, "run", "left")
    return out.withColumn("balanced_score", F.coalesce("balanced_score", F.lit(NO_SCORE))).orderBy(F.desc("balanced_score"), "run")


def replay(wide: DataFrame, row: Mapping[str, object]) -> DataFrame:
    """(id, cluster) of a stored result row: its set, method and parameters say how to make the labels again."""
    run = Run(*(row[c] for c in ("feature_set", "method", "params", "k", "resolution", "seed")))
    found = label_runs(wide, [run])
    failed = found.where("reason IS NOT NULL").first()
    if failed:
        raise ValueError(failed["reason"])
    return found.select("id", "cluster")
