"""Choosing among runs, and stories told from their rows. Runs are derived from the orders table: any table of scores will do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as fn
from ..operators import select as ops
from ..sources.tables import parquet
from .base import rounded as _rounded
from . import learning, metrics  # noqa: F401  the story is told from their rows
from .registry import ORACLE_SQL, QUERIES, query

def rounded(df):
    """Scores have nine digits once and for all: a second, coarser rounding would meet halves."""
    return _rounded(df, 9)


_RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS method, o_custkey % 40 AS clusters, (o_orderkey % 97) / 97.0 AS ari, (o_orderkey % 89) / 89.0 AS v, (o_orderkey % 83) / 83.0 AS ami, (o_orderkey % 79) / 79.0 AS f1,
(o_orderkey % 10) / 10.0 AS largest, (o_custkey % 8) / 20.0 AS noise, CASE WHEN o_orderkey % 50 = 0 THEN 'failed' END AS error FROM orders),
scored AS (SELECT *, round(0.3 * ari + 0.25 * v + 0.2 * ami + 0.2 * f1 - CASE WHEN clusters < 6 OR clusters > 30 THEN 0.15 ELSE 0 END - greatest(0, largest - 0.4) - greatest(0, noise - 0.25), 9) AS score FROM runs)
"""
_VALID = "clusters BETWEEN 8 AND 25 AND largest <= 0.4 AND noise <= 0.25 AND error IS NULL"


def runs(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = parquet(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.col("o_orderpriority").alias("method"),
        (c % 40).alias("clusters"),
        *(((k % m) / float(m)).alias(n) for m, n in ((97, "ari"), (89, "v"), (83, "ami"), (79, "f1"))),
        ((k % 10) / 10.0).alias("largest"),
        ((c % 8) / 20.0).alias("noise"),
        F.when(k % 50 == 0, "failed").alias("error"),
    )
    score = fn.balanced_score(*(F.col(x) for x in ("ari", "v", "ami", "f1", "clusters", "largest", "noise")))
    return o.withColumn("score", F.round(score, 9))


@query(_RUNS + "SELECT run_id, score, round(0.5 * v + 0.5 * f1, 9) AS selection FROM scored")
def balanced_score(spark, sf_dir):
    return rounded(runs(spark, sf_dir).select("run_id", "score", fn.selection_score(F.col("v"), F.col("f1")).alias("selection")))


def _valid(spark, sf_dir, change=lambda r: r):
    r = change(runs(spark, sf_dir))
    named = r.withColumns({"cluster_count": F.col("clusters").cast("string"), "largest_cluster_share": F.col("largest").cast("string"), "noise_share": F.col("noise").cast("string")})
    return ops.valid_runs(named)


@query(_RUNS + f"SELECT run_id, method, score FROM scored WHERE {_VALID}")
def valid_configs(spark, sf_dir):
    return rounded(_valid(spark, sf_dir).select("run_id", "method", "score"))


@query(_RUNS + "SELECT run_id, score FROM scored")
def valid_configs_fallback(spark, sf_dir):
    """No run is valid once all counts are text that is no number: all stay."""
    return rounded(_valid(spark, sf_dir, lambda r: r.withColumn("clusters", F.lit("many"))).select("run_id", "score"))


@query(_RUNS + f"SELECT run_id, score FROM scored WHERE {_VALID} ORDER BY scored.score DESC, run_id LIMIT 1")
def best_overall(spark, sf_dir):
    return rounded(ops.best(_valid(spark, sf_dir), "score").select("run_id", "score"))


@query(_RUNS + "SELECT method, run_id, score FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, run_id) AS r FROM scored) WHERE r = 1")
def best_per_method(spark, sf_dir):
    return rounded(ops.best(runs(spark, sf_dir), "score", by=["method"]).select("method", "run_id", "score"))


@query(_RUNS + "SELECT method, run_id, score FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, run_id) AS r FROM scored) WHERE r <= 5")
def top5_per_method(spark, sf_dir):
    return rounded(ops.best(runs(spark, sf_dir), "score", 5, by=["method"]).select("method", "run_id", "score"))


@query(_RUNS + "SELECT method = '1-URGENT' AS is_first, CAST(count(*) AS BIGINT) AS n, max(score) AS best FROM scored GROUP BY 1")
def method_partition(spark, sf_dir):
    r = runs(spark, sf_dir)
    first, rest = r.where(F.col("method") == "1-URGENT"), r.where(F.col("method") != "1-URGENT")
    of = lambda d, b: d.agg(F.count("*").alias("n"), F.max("score").alias("best")).select(F.lit(b).alias("is_first"), "n", "best")
    return rounded(of(first, True).unionByName(of(rest, False)))


@query("SELECT * FROM (VALUES ('ari', 0.1967, 0.2768), ('v_measure', 0.3109, 0.3871), ('silhouette', NULL, 0.0491), ('old_only', 0.5, NULL)) AS t(metric, before, after)")
def before_after(spark, sf_dir):
    return ops.before_after({"ari": 0.1967, "v_measure": 0.3109, "old_only": 0.5}, {"ari": 0.2768, "v_measure": 0.3871, "silhouette": 0.0491}, spark)


@query(_RUNS + "SELECT run_id, method, score FROM scored WHERE method = '2-HIGH' AND clusters = 12 ORDER BY run_id LIMIT 1")
def first_row_lookup(spark, sf_dir):
    return rounded(ops.first_row(runs(spark, sf_dir), "run_id", method="2-HIGH", clusters=12).select("run_id", "method", "score"))


_STORY_METRICS = ("ari", "ami", "nmi", "homogeneity", "completeness", "v_measure")


def _told(name, scope, weight, guided):
    return {"result_id": name, "display_name": name.replace("_", " "), "method_type": "multilabel_classification" if guided else "clustering", "evaluation_scope": scope, "main_or_auxiliary": weight, "independent_external_validation": not guided, "label_guided_representation": guided, "note": f"over {scope}"}


def _story_sql(words, metrics, source):
    values = ", ".join(f"{str(v).upper() if isinstance(v, bool) else repr(v)} AS {k}" for k, v in words.items() if k != "note")
    filled = ", ".join(f"CAST({metrics.get(c, 'NULL')} AS DOUBLE) AS {c}" for c in [*_STORY_METRICS, "pairwise_f1", "macro_f1", "micro_f1", "weighted_f1", "precision", "recall", "subset_accuracy"])
    return f"SELECT {values}, {filled}, {words['note']!r} AS note FROM ({source})"


_PARTS = (
    (_told("clusters_all", "all rows", "main", False), "all"),
    (_told("clusters_clear", "rows without other", "auxiliary", False), "excluding_other"),
)
_CLASSIFIER = _told("classifier", "all rows", "auxiliary", True)
_OF_SUITE = {c: c for c in _STORY_METRICS} | {"pairwise_f1": "f1", "precision": "precision", "recall": "recall"}
_OF_SCORES = {"macro_f1": "macro_f1", "micro_f1": "micro_f1", "weighted_f1": "weighted_f1", "precision": "micro_precision", "recall": "micro_recall", "subset_accuracy": "subset_accuracy"}


@query(" UNION ALL ".join([*(_story_sql(words, _OF_SUITE, f"SELECT * FROM ({ORACLE_SQL['metric_suite']}) WHERE subset = '{subset}'") for words, subset in _PARTS), _story_sql(_CLASSIFIER, _OF_SCORES, ORACLE_SQL["multilabel_scores"])]))
def evaluation_story(spark, sf_dir):
    """Clusterings and a classifier in one table of results, null where a metric does not apply."""
    suite, scores = QUERIES["metric_suite"](spark, sf_dir), QUERIES["multilabel_scores"](spark, sf_dir)
    named = lambda d, m: d.select(*(F.col(v).alias(k) for k, v in m.items()))
    parts = [(words, named(suite.where(F.col("subset") == subset), _OF_SUITE)) for words, subset in _PARTS]
    return ops.story([*parts, (_CLASSIFIER, named(scores, _OF_SCORES))])


@query(_RUNS + """SELECT metric, round(value, 9) AS value FROM (SELECT min(ari) AS min_ari, max(ari) AS max_ari, avg(ari) AS mean_ari, min(score) AS min_score, max(score) AS max_score, avg(score) AS mean_score FROM scored)
UNPIVOT (value FOR metric IN (min_ari, max_ari, mean_ari, min_score, max_score, mean_score))""")
def robustness(spark, sf_dir):
    from ..operators.stats import unpivot

    one = runs(spark, sf_dir).agg(*(f(c).alias(f"{n}_{c}") for c in ("ari", "score") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return rounded(unpivot(one))
