"""Choosing among runs: validity, fallback, best rows, stories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs of 8 to 25 clusters, largest share <= .40, noise <= .25 and no error; all runs if there is none.

    Text in a number's place counts as absent.
    """
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    fits = number("cluster_count").between(8, 25) & (number("largest_cluster_share") <= 0.40) & (number("noise_share") <= 0.25) & (F.coalesce("error", F.lit("")) == "")
    marked = runs.withColumn("__ok", F.coalesce(fits, F.lit(False)))
    some = marked.agg(F.coalesce(F.bool_or("__ok"), F.lit(False)).alias("__some"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("__ok") | ~F.col("__some")).drop("__ok", "__some")


def best(runs: DataFrame, score: str, n: int = 1, by: list[str] | None = None, tie: str = "run_id") -> DataFrame:
    """The n best runs, of each group if one is named; without one, a top-n and not a window."""
    if not by:
        return runs.orderBy(F.desc(score), tie).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return runs.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def first_row(table: DataFrame, order: str, **equal: Any) -> DataFrame:
    """The first row that has all the values; an error if there is none."""
    found = table
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    found = found.orderBy(order).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {equal}")
    return found


#: Columns of a result story, in order, with their types.
STORY = (
    "result_id string, display_name string, method_type string, evaluation_scope string, main_or_auxiliary string, independent_external_validation boolean, label_guided_representation boolean, "
    "ari double, ami double, nmi double, homogeneity double, completeness double, v_measure double, pairwise_f1 double, macro_f1 double, micro_f1 double, weighted_f1 double, precision double, recall double, subset_accuracy double, note string"
)


def story(parts: Sequence[tuple[Mapping[str, Any], DataFrame]]) -> DataFrame:
    """One row a part under the story's columns: its own words beside its metrics, null where a metric does not apply."""
    out = None
    for words, found in parts:
        named = found.select(*found.columns, *(F.lit(v).alias(k) for k, v in words.items()))
        kinds = [c.split() for c in STORY.split(", ")]
        row = named.select(*((F.col(c) if c in named.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("a story needs a part")
    return out


def before_after(before: Mapping[str, float | None], after: Mapping[str, float | None], spark) -> DataFrame:
    """(metric, before, after) over the keys of both, null on the absent side."""
    of = lambda d, name: spark.createDataFrame([(k, v) for k, v in d.items()], f"metric string, {name} double")
    return of(before, "before").join(of(after, "after"), "metric", "full")
