"""Splits, pairs and supervised scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn
from ..operators import learn as ops
from ..operators.features import hashed_embedding
from ..sources.config import MACROS, OTHER
from .base import CTE, labelled, rounded, with_macros
from .registry import query
from .vectors import vectors

CLASSES = sorted([*MACROS, OTHER])
_SPLIT = """, s AS (SELECT id, macros, macros[1] AS stratum, row_number() OVER (PARTITION BY macros[1] ORDER BY md5('42:' || id)) - 1 AS r, count(*) OVER (PARTITION BY macros[1]) AS n FROM cm),
sp AS (SELECT id, macros, CASE WHEN n = 1 OR (r + 0.5) / n < 0.7 THEN 'train' WHEN (r + 0.5) / n < 0.85 THEN 'validation' ELSE 'test' END AS split FROM s)
"""


def _split(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", "macros", F.get("macros", F.lit(0)).alias("stratum"))
    return ops.stratified_split(rows, "stratum", 42)


@query(CTE + _SPLIT + "SELECT id, split FROM sp")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "split")


@query(CTE + """, s0 AS (SELECT id, macros[1] AS m, count(*) OVER (PARTITION BY macros[1]) AS c FROM cm), s1 AS (SELECT id, CASE WHEN (SELECT min(c) FROM s0) >= 2 THEN m END AS stratum FROM s0),
s AS (SELECT id, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || id)) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s1)
SELECT id, CASE WHEN (r + 0.5) / n < 0.6 THEN 'train' WHEN (r + 0.5) / n < 0.8 THEN 'validation' ELSE 'holdout' END AS split FROM s""")
def holdout_split(spark, sf_dir):
    """60/20/20, without strata if one of them cannot be parted."""
    return _holdout(spark, sf_dir).select("id", "split")


def _holdout(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", "macros", "mask", F.get("macros", F.lit(0)).alias("stratum"))
    return ops.split_rows(rows, "stratum", 7, (0.6, 0.2, 0.2), ("train", "validation", "holdout"))


_SCORES = ", sc AS (SELECT id, label, CAST(list_contains(macros, label) AS INT) AS y, round(((id * 31 + ascii(label) * 7 + length(label)) % 101) / 50.0 - 1.5, 6) AS score FROM cm CROSS JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES) + "]) AS label))\n"
_HAT = ", hat AS (SELECT id, label, y, CAST(score >= 0 OR (max(score) OVER (PARTITION BY id) < 0 AND row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1) AS INT) AS y_hat FROM sc)\n"


def _scores(spark, sf_dir):
    """Fixed pseudo-scores of every row and label."""
    each = labelled(spark, sf_dir).select("id", "macros", F.explode(F.array(*map(F.lit, CLASSES))).alias("label"))
    score = F.round(((F.col("id") * 31 + F.ascii("label") * 7 + F.length("label")) % 101) / 50.0 - 1.5, 6)
    return each.select("id", "label", F.array_contains("macros", F.col("label")).cast("int").alias("y"), score.alias("score"))


@query(CTE + _SCORES + _HAT + "SELECT id, label, y_hat FROM hat")
def force_one_label(spark, sf_dir):
    return ops.force_one(_scores(spark, sf_dir))


@query(CTE + _SCORES + _HAT + """, l AS (SELECT label, sum(y * y_hat) AS tp, sum((1 - y) * y_hat) AS fp, sum(y * (1 - y_hat)) AS fn FROM hat GROUP BY label),
lf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM l),
rw AS (SELECT id, sum(y * y_hat) AS tp, sum((1 - y) * y_hat) AS fp, sum(y * (1 - y_hat)) AS fn FROM hat GROUP BY id)
SELECT round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
round(sum(p * (tp + fn)) / sum(tp + fn), 6) AS weighted_precision, round(sum(r * (tp + fn)) / sum(tp + fn), 6) AS weighted_recall, round(sum(f * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1,
(SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) FROM rw) AS samples_f1, (SELECT round(avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END), 6) FROM rw) AS subset_accuracy FROM lf""")
def multilabel_scores(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return rounded(ops.multilabel_scores(s.join(ops.force_one(s), ["id", "label"])))


def train_pairs(spark, sf_dir):
    """(a, b, y, source) within the training rows: partners that share a label, random ones that do not, and the nearest that do not."""
    rows = _holdout(spark, sf_dir).where("split = 'train'").select("id", "macros").persist()
    named = lambda d, y, s: d.select("a", "b", F.lit(y).alias("y"), F.lit(s).alias("source"))
    near = knn.knn(vectors(spark, sf_dir).join(rows.select("id"), "id", "left_semi"), 30).select("id", "neighbour", "rank")
    pairs = (
        named(ops.positives(rows, 2, 42), 1, "positive")
        .unionByName(named(ops.random_negatives(rows, 2, 42), 0, "random"))
        .unionByName(named(ops.hard_negatives(near, rows, 1), 0, "hard"))
    )
    return ops.distinct_pairs(pairs, ("positive", "random", "hard"))


@query()
def pair_sampling(spark, sf_dir):
    return train_pairs(spark, sf_dir)


@query()
def pair_statistics(spark, sf_dir):
    return train_pairs(spark, sf_dir).groupBy("y", "source").agg(F.count("*").alias("n"))


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, y, min(source) AS source FROM (SELECT o_custkey AS a, o_orderkey % 100 AS b, CAST(o_orderkey % 2 AS INT) AS y, o_orderpriority AS source FROM orders) GROUP BY 1, 2, 3")
def pair_dedup(spark, sf_dir):
    from ..sources.tables import parquet

    o = parquet(spark, sf_dir, "orders")
    return ops.distinct_pairs(o.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"), (F.col("o_orderkey") % 2).cast("int").alias("y"), F.col("o_orderpriority").alias("source")))


@query()
def ovr_logistic(spark, sf_dir):
    """Multi-label scores of a one-vs-rest regression over hashed n-grams, on validation and test rows."""
    rows = with_macros(spark, sf_dir).select("id", "text")
    feats = hashed_embedding(rows, 128).join(_split(spark, sf_dir).select("id", "macros", "split"), "id").persist()
    scores = ops.one_vs_rest(feats, CLASSES).where("split <> 'train'").persist()
    hat = ops.force_one(scores.select("id", "label", "score")).join(scores.select("id", "split", "label"), ["id", "label"]).join(feats.select("id", "macros"), "id")
    pairs = hat.withColumn("y", F.array_contains("macros", F.col("label")).cast("int"))
    return rounded(
        ops.multilabel_scores(pairs.where("split = 'validation'")).withColumn("split", F.lit("validation")).unionByName(ops.multilabel_scores(pairs.where("split = 'test'")).withColumn("split", F.lit("test")))
    )
