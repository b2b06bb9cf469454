"""Per-cluster tables: sizes, pivots, purity, entropy, lengths and report summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(rows: DataFrame, by: str = "cl") -> DataFrame:
    """Size of each group and its share of all rows; the total is one broadcast row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(by).agg(F.count("*").alias("size")).crossJoin(F.broadcast(total)).select(by, "size", (F.col("size") / F.col("total")).alias("share")).orderBy(F.desc("size"), by)


def entropy(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Base-2 entropy of counts in each group, and how many there are."""
    total = F.sum(n).over(Window.partitionBy(by))
    p = counts.where(F.col(n) > 0).withColumn("__p", F.col(n) / total)
    return p.groupBy(by).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("entropy"), F.count("*").alias("distinct"))


def tag_counts(each: DataFrame, by: str = "cl", tag: str = "tag") -> DataFrame:
    return each.groupBy(by, tag).agg(F.count("*").alias("n"))


def matrix(each: DataFrame, columns: Sequence[str], by: str = "cl", tag: str = "tag") -> DataFrame:
    """Group x tag counts, 0 where there are none; the columns are named, which saves a pass."""
    return each.groupBy(by).pivot(tag, list(columns)).count().na.fill(0)


def purity(counts: DataFrame, by: str = "cl", tag: str = "tag") -> DataFrame:
    """Dominant tag of each group (ties: the first by name), its share, and the entropy."""
    top = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(tag).alias("tag"))).alias("top"), F.sum("n").alias("total"))
    return top.join(entropy(counts, by), by).select(by, F.col("top.tag").alias("dominant"), (-F.col("top.neg") / F.col("total")).alias("share"), "entropy")


def dominant(each: DataFrame, by: str, tag: str, order: str) -> DataFrame:
    """Most frequent tag of each group; ties go to the one seen first."""
    counts = each.groupBy(by, tag).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "first", F.col(tag).alias("tag"))).alias("top")).select(
        by, F.col("top.tag").alias("dominant"), (-F.col("top.neg")).alias("dominant_count")
    )


def summary(rows: DataFrame, each: DataFrame, by: str = "cl") -> DataFrame:
    """Size, years and dominant tag of each group, largest first."""
    base = rows.groupBy(by).agg(F.count("*").alias("size"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return base.join(dominant(each, by, "tag", "ord"), by, "left").orderBy(F.desc("size"), by)


def lengths(rows: DataFrame, by: str, chars: str = "chars", words: str = "words") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(chars).alias("mean_chars"), F.median(chars).alias("median_chars"), F.avg(words).alias("mean_words"), F.max(chars).alias("max_chars")
    )


def means(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(by).agg(*(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns))


def shares_within(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Each count over its group's sum; 0 for an empty group."""
    total = F.sum(n).over(Window.partitionBy(by))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col(n).cast("double"), total.cast("double")), F.lit(0.0)))


def band(share: Column) -> Column:
    """high from .65 on, medium from .4 on, low below; mixed if there is none."""
    return F.when(share.isNull(), "mixed").when(share >= 0.65, "high").when(share >= 0.4, "medium").otherwise("low")


def joined_top(rows: DataFrame, by: str, rank: Sequence[Column], value: str, n: int, separator: str, name: str) -> DataFrame:
    """The first n values of each group as one text; ranks are windows over the counted values, not over raw rows."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*rank))).where(F.col("__r") <= n)
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda s: s[value].cast("string")), separator).alias(name))


def unpivot(one_row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table of numbers."""
    names = one_row.columns
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return one_row.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def describe(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and the 5, 25, 50, 75 and 95 percentiles of each group."""
    p = [F.percentile(value, q / 100).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *p, F.max(value).alias("max"))


def sanity(rows: DataFrame, by: str = "cl") -> DataFrame:
    """One row: rows, distinct clusters and the largest one's share, distinct months, values that are there, and rows without tags."""
    largest = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.count("*").alias("clusters"))
    whole = rows.agg(F.count("*").alias("rows"), F.count_distinct("year", "month").alias("months"), F.count("text").alias("texts"), F.count("lang").alias("langs"), F.count_if(F.size("tags") == 0).alias("untagged"))
    share = F.try_divide(F.col("largest"), F.col("rows"))
    return whole.crossJoin(F.broadcast(largest)).select("rows", "clusters", share.alias("largest_share"), "months", "texts", "langs", "untagged")
