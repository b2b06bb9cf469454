"""Neighbours, centres, internal quality and clusterings of the embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import vectors as fn
from ..operators import cluster, knn, metrics, stats
from ..operators import vectors as ops
from ..sources.tables import parquet
from .base import rounded
from .registry import query

K = 15
_COS = "1 - list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_E = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS cluster FROM embeddings)"
_KNN = _E + f""", d AS (SELECT a.id, b.id AS neighbour, round({_COS.format('a.v', 'b.v')}, 9) AS distance FROM v a JOIN v b ON a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= {K})
"""
_CENTRE = """, p AS (SELECT cluster, id, unnest(range(len(v))) AS d, unnest(v) AS x FROM v), cd AS (SELECT cluster, d, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT cluster AS cc, list(x ORDER BY d) AS centre FROM cd GROUP BY cluster)
"""
_MARGIN = _E + _CENTRE + f""", dd AS (SELECT id, cluster, cc, round({_COS.format('v', 'centre')}, 9) AS d FROM v CROSS JOIN c),
m AS (SELECT id, cluster, min(d) FILTER (cc = cluster) AS own, coalesce(min(d) FILTER (cc <> cluster), 1.0) AS other FROM dd GROUP BY ALL)
"""


def vectors(spark, sf_dir):
    return parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("cluster"))


@query(_E + f" SELECT a.id, round({_COS.format('a.v', 'b.v')}, 6) AS distance, round(list_dot_product(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 1")
def cosine_pairs(spark, sf_dir):
    a = vectors(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return rounded(a.join(b, "id").select("id", fn.cosine_distance(F.col("v"), F.col("w")).alias("distance"), fn.dot(F.col("v"), F.col("w")).alias("similarity")))


@query(_E + " SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS length FROM v")
def l2_normalize(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("id", fn.l2_normalize(F.col("v"))[0].alias("first"), fn.norm(F.col("v")).alias("length")))


@query(_E + _CENTRE + " SELECT cluster, CAST(d AS INT) AS d, round(x, 6) AS x FROM cd")
def centroids(spark, sf_dir):
    return rounded(cluster.centroids(vectors(spark, sf_dir)).select("cluster", F.posexplode("centre").alias("d", "x")))


@query(_MARGIN + "SELECT cluster, id, CAST(r AS INT) AS rank, round(own, 6) AS own FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY own, id) AS r FROM m) WHERE r <= 10")
def central_examples(spark, sf_dir):
    return rounded(ops.top_by(ops.margins(vectors(spark, sf_dir)), "own", 10).select("cluster", "id", "rank", "own"))


@query(_MARGIN + "SELECT cluster, id, CAST(r AS INT) AS rank, round(margin, 6) AS margin FROM (SELECT *, round(other - own, 9) AS margin, row_number() OVER (PARTITION BY cluster ORDER BY round(other - own, 9), id) AS r FROM m) WHERE r <= 8")
def borderline_examples(spark, sf_dir):
    return rounded(ops.top_by(ops.margins(vectors(spark, sf_dir)), "margin", 8).select("cluster", "id", "rank", "margin"))


@query(_KNN + "SELECT id, neighbour, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM n")
def knn_topk(spark, sf_dir):
    return rounded(knn.knn(vectors(spark, sf_dir), K).select("id", "neighbour", "rank", "distance"))


@query(_KNN + "SELECT least(id, neighbour) AS src, greatest(id, neighbour) AS dst, round(avg(greatest(0, 1 - distance)), 6) AS weight FROM n GROUP BY ALL")
def knn_edges(spark, sf_dir):
    return rounded(knn.edges(knn.knn(vectors(spark, sf_dir), K)))


@query(_KNN + """SELECT 'nearest' AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS min, round(quantile_cont(s, 0.05), 6) AS p05, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50,
round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.95), 6) AS p95, round(max(s), 6) AS max FROM (SELECT 1 - distance AS s FROM n WHERE rank = 1)""")
def nn_similarity_describe(spark, sf_dir):
    near = knn.knn(vectors(spark, sf_dir), 1).select(F.lit("nearest").alias("kind"), (1 - F.col("distance")).alias("s"))
    return rounded(stats.describe(near, "s", "kind"))


RANDOM_PAIRS = 20_000


def _random_similarity(spark, sf_dir):
    pairs = metrics.random_pairs(vectors(spark, sf_dir), RANDOM_PAIRS, 42, ["id", "v"])
    return pairs.select(F.lit("random").alias("kind"), (1 - fn.cosine_distance(F.col("a.v"), F.col("b.v"))).alias("s"))


@query()
def random_pair_similarity(spark, sf_dir):
    """Similarities of 20,000 random pairs of different rows."""
    return rounded(stats.describe(_random_similarity(spark, sf_dir), "s", "kind"))


@query()
def neighbour_vs_random(spark, sf_dir):
    """Both distributions side by side, with the difference of their means."""
    near = knn.knn(vectors(spark, sf_dir), 1).select(F.lit("nearest").alias("kind"), (1 - F.col("distance")).alias("s"))
    both = stats.describe(near.unionByName(_random_similarity(spark, sf_dir)), "s", "kind")
    gap = both.agg((F.max(F.when(F.col("kind") == "nearest", F.col("mean"))) - F.max(F.when(F.col("kind") == "random", F.col("mean")))).alias("mean_difference"))
    return rounded(both.crossJoin(F.broadcast(gap)))


@query(_E + _CENTRE + """, u AS (SELECT id, cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v), q AS (SELECT cluster, list(s ORDER BY d) AS s, any_value(n) AS n FROM (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(len(u))) AS d, unnest(u) AS x FROM u) GROUP BY ALL) GROUP BY cluster),
dd AS (SELECT u.id, u.cluster, q.cluster AS o, q.n, CASE WHEN q.cluster = u.cluster THEN CASE WHEN q.n = 1 THEN 0 ELSE (q.n - list_dot_product(u.u, q.s)) / (q.n - 1) END ELSE 1 - list_dot_product(u.u, q.s) / q.n END AS d FROM u CROSS JOIN q),
ab AS (SELECT id, max(d) FILTER (cluster = o) AS a, min(d) FILTER (cluster <> o) AS b, max(n) FILTER (cluster = o) AS n FROM dd GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM ab""")
def silhouette(spark, sf_dir):
    return rounded(spark.createDataFrame([(ops.silhouette(vectors(spark, sf_dir)),)], "silhouette double"))


@query(_E + _CENTRE + """, w AS (SELECT d, avg(x) AS mu FROM p GROUP BY d), b AS (SELECT sum(n * pow(cd.x - mu, 2)) AS b FROM cd JOIN w USING (d) JOIN (SELECT cluster, count(*) AS n FROM v GROUP BY cluster) USING (cluster)),
i AS (SELECT sum(pow(p.x - cd.x, 2)) AS w FROM p JOIN cd USING (cluster, d)) SELECT round((b / ((SELECT count(*) FROM c) - 1)) / (w / ((SELECT count(*) FROM v) - (SELECT count(*) FROM c))), 6) AS calinski_harabasz FROM b, i""")
def calinski_harabasz(spark, sf_dir):
    return rounded(ops.calinski_harabasz(vectors(spark, sf_dir)))


@query(_E + _CENTRE + """, s AS (SELECT cluster, avg(list_distance(v, centre)) AS s FROM v JOIN c ON cc = cluster GROUP BY cluster), q AS (SELECT cluster, s, centre FROM s JOIN c ON cc = cluster)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT x.cluster, max((x.s + y.s) / list_distance(x.centre, y.centre)) AS r FROM q x JOIN q y ON x.cluster <> y.cluster GROUP BY x.cluster)""")
def davies_bouldin(spark, sf_dir):
    return rounded(ops.davies_bouldin(vectors(spark, sf_dir)))


@query()
def internal_metrics(spark, sf_dir):
    """All internal metrics of a labelling; the graph behind its modularity is made anew."""
    v = vectors(spark, sf_dir)
    return rounded(ops.internal(v, graph=lambda: knn.edges(knn.knn(v, K))))


@query(_KNN + """, e AS (SELECT least(id, neighbour) AS src, greatest(id, neighbour) AS dst, avg(greatest(0, 1 - distance)) AS w FROM n GROUP BY ALL), l AS (SELECT w, a.cluster AS ca, b.cluster AS cb FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst),
t AS (SELECT sum(w) AS t FROM l), g AS (SELECT c, sum(w) AS degree, sum(i) AS inside FROM (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM l UNION ALL SELECT cb, w, 0 FROM l) GROUP BY c)
SELECT round(sum(inside / t - pow(degree / (2 * t), 2)), 6) AS modularity FROM g, t""")
def modularity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(knn.modularity(knn.edges(knn.knn(v, K)), v))


@query()
def pca_variance(spark, sf_dir):
    _, kept = ops.pca(vectors(spark, sf_dir), 16)
    return rounded(spark.createDataFrame([(16, kept)], "k int, variance double"))


@query()
def plot_layout(spark, sf_dir):
    return rounded(ops.layout(vectors(spark, sf_dir), 3))


@query()
def kmeans(spark, sf_dir):
    return cluster.kmeans(vectors(spark, sf_dir), 10)


def _configs(spark, rows, schema):
    return spark.createDataFrame(rows, f"config_id long, {schema}")


@query()
def leiden(spark, sf_dir):
    graph = knn.edges(knn.knn(vectors(spark, sf_dir), K))
    return cluster.leiden(graph, _configs(spark, [(i, g, s) for i, (g, s) in enumerate((g, s) for g in (0.5, 1.0, 2.0) for s in (7, 42))], "gamma double, seed long"))


@query()
def agglomerative(spark, sf_dir):
    return cluster.grouped(vectors(spark, sf_dir).select("id", "v"), _configs(spark, [(12, "agglomerative", 12), (25, "agglomerative", 25)], "method string, size int"))


@query()
def hdbscan(spark, sf_dir):
    return cluster.grouped(vectors(spark, sf_dir).select("id", "v"), _configs(spark, [(1, "hdbscan", 10), (2, "hdbscan_leaf", 10)], "method string, size int"))


@query()
def cluster_search(spark, sf_dir):
    """A few runs of four methods (``operators.search.grid`` has all 1,080) scored in one grouped pass, best first; a linkage run that cannot be made is a row with its reason and a score of -999."""
    v = vectors(spark, sf_dir)
    graph = knn.edges(knn.knn(v, K))
    linkage = [(10, "agglomerative", 12), (11, "agglomerative", 20), (20, "hdbscan", 10)]
    configs = _configs(spark, linkage, "method string, size int")
    linked = cluster.grouped(v.select("id", "v"), configs).join(F.broadcast(configs.select("config_id", "method")), "config_id").persist()
    runs = [
        cluster.leiden(graph, _configs(spark, [(i, g, 7) for i, g in enumerate((0.5, 1.0, 2.0))], "gamma double, seed long")).withColumn("method", F.lit("leiden")),
        linked.where("reason IS NULL").drop("reason"),
        *(cluster.kmeans(v, k, seeds=(0,)).select(F.lit(30 + k).cast("long").alias("config_id"), "id", F.col("cluster").cast("long").alias("cluster"), F.lit("kmeans").alias("method")) for k in (8, 12)),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), runs).join(v.select("id", F.col("cluster").alias("t")), "id").withColumns({"k": F.col("cluster"), "mask": F.expr("shiftleft(1L, CAST(t AS INT))")}).persist()
    noise = rows.groupBy("config_id", "method").agg(F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share"))
    scored = metrics.suite(rows, ["config_id"]).join(noise, "config_id")
    score = fn.balanced_score(*(F.col(c) for c in ("ari", "v_measure", "ami", "f1", "cluster_count", "largest_cluster_share", "noise_share")))
    scored = rounded(scored.select("config_id", "method", "cluster_count", "largest_cluster_share", "noise_share", "ari", "ami", "v_measure", "f1", score.alias("score"), F.lit(None).cast("string").alias("reason")))
    failed = linked.where("reason IS NOT NULL").select("config_id", "method", F.lit(-999.0).alias("score"), "reason")
    return scored.unionByName(failed, allowMissingColumns=True).orderBy(F.desc("score"), "config_id")


@query()
def feature_ablation(spark, sf_dir):
    """k-means over feature variants: the vectors, a projection, and weighted hybrids of both; ``operators.search.minibatch_kmeans`` takes all 86 sets."""
    from ..operators import features

    v = vectors(spark, sf_dir)
    small, _ = ops.pca(v.select("id", "v"), 16)
    both = v.join(small.withColumnRenamed("v", "p"), "id").persist()
    variants = {"dense": F.col("v").cast("array<double>"), "pca": F.col("p")} | {f"hybrid_dw{a:.2f}": features.hybrid([(F.col("v"), a), (F.col("p"), 1 - a)]) for a in (0.25, 0.5, 0.75)}
    runs = [cluster.kmeans(both.select("id", c.alias("v")), 12, seeds=(0,)).withColumn("feature_set", F.lit(n)) for n, c in variants.items()]
    rows = reduce(lambda a, b: a.unionByName(b), runs).join(v.select("id", F.col("cluster").alias("t")), "id").withColumn("k", F.col("cluster"))
    return rounded(metrics.external(rows, ["feature_set"]))


#: The stability grid.
STABILITY_NEIGHBOURS, STABILITY_RESOLUTIONS, STABILITY_SEEDS = (15, 30, 50), (0.5, 1.0, 1.5), (42, 123, 2026)


@query()
def stability_grid(spark, sf_dir):
    """Agreement of all pairs of 27 partitions: three neighbour counts, three resolutions and three seeds, whatever the number of rows."""
    neighbours = knn.knn(vectors(spark, sf_dir), max(STABILITY_NEIGHBOURS)).persist()
    grid = [(i, k, g, s) for i, (k, g, s) in enumerate((k, g, s) for k in STABILITY_NEIGHBOURS for g in STABILITY_RESOLUTIONS for s in STABILITY_SEEDS)]
    parts = []
    for k in STABILITY_NEIGHBOURS:
        mine = _configs(spark, [(i, g, s) for i, n, g, s in grid if n == k], "gamma double, seed long")
        parts.append(cluster.leiden(knn.edges(neighbours.where(F.col("rank") <= k)), mine))
    found = reduce(lambda a, b: a.unionByName(b), parts).persist()
    other = found.select("id", F.col("config_id").alias("run_b"), F.col("cluster").alias("k"))
    both = found.withColumnsRenamed({"config_id": "run_a", "cluster": "t"}).join(other, "id").where("run_a < run_b")
    return rounded(metrics.external(both, ["run_a", "run_b"]).select("run_a", "run_b", "ari", "ami"))
