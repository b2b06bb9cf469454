"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns, and score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(F.array(F.struct(n.alias("n"), a.alias("a"))), lambda s: F.transform(s["a"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, v: s + v * v)


def edge_weight(distance: Column, metric: str = "cosine") -> Column:
    """Similarity of neighbours: max(0, 1 - d) for cosine, 1 / (1 + d) else."""
    return F.greatest(F.lit(0.0), 1 - distance) if metric == "cosine" else 1 / (1 + distance)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def balanced_score(ari: Column, v: Column, ami: Column, pair_f1: Column, clusters: Column, largest: Column, noise: Column) -> Column:
    """Weighted quality less penalties for too few or many clusters, one large cluster, and noise."""
    # fixed values: weights .30 .25 .20 .20; penalty .15 outside 6 to 30 clusters; shares above .40 and .25 count against it
    quality = 0.30 * ari + 0.25 * v + 0.20 * ami + 0.20 * pair_f1
    odd = F.when((clusters < 6) | (clusters > 30), 0.15).otherwise(0.0)
    return quality - odd - F.greatest(F.lit(0.0), largest - 0.40) - F.greatest(F.lit(0.0), noise - 0.25)


def selection_score(v: Column, pair_f1: Column) -> Column:
    return 0.5 * v + 0.5 * pair_f1
