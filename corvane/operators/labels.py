"""Tags, categories and hierarchy: lookups, distributions and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_tag
from ..sources.config import OTHER


def exploded(rows: DataFrame, tags: str = "tags", keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row for each row and tag."""
    return rows.select(*keep, F.explode(tags).alias("tag"))


def map_tags(rows: DataFrame, mapping: DataFrame, tags: str = "tags", key: str = "id", keep: Sequence[str] = ("cl",)) -> DataFrame:
    """Per row: macros in mapping order (``other`` if no tag is mapped), mask (a bit for each place) and unmapped tags.

    Tags of rows and mapping meet in normal form; blank ones count as absent. The mapping is as small as its file and is broadcast; an
    empty one gives ``other`` alone, and one of more than 62 categories has no mask, which is an error.
    """
    places = mapping.select("pos", "macro", normalize_tag(F.col("tag")).alias("tag_norm"))
    found = mapping.agg(F.max("pos").alias("m")).first()["m"]
    other_bit = 0 if found is None else found + 1
    if other_bit > 62:
        raise ValueError(f"{other_bit} categories; a mask has room for 62 and other")
    each = rows.select(key, *keep, F.explode_outer(tags).alias("tag")).withColumn("tag_norm", normalize_tag(F.col("tag")))
    joined = each.join(F.broadcast(places), "tag_norm", "left")
    in_order = F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "macro"))))
    return joined.groupBy(key, *keep).agg(
        in_order.alias("found"),
        F.coalesce(F.bit_or(F.expr("CASE WHEN pos IS NOT NULL THEN shiftleft(1L, pos) END")), F.lit(1 << other_bit)).alias("mask"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNull() & (F.col("tag_norm") != ""), F.col("tag")))).alias("unmapped"),
    ).withColumn("macros", F.when(F.size("found") == 0, F.array(F.lit(OTHER))).otherwise(F.transform("found", lambda s: s["macro"]))).drop("found")


def primary_alphabetical(macros: Column) -> Column:
    return F.coalesce(F.array_min(macros), F.lit(OTHER))


def primary_first(macros: Column) -> Column:
    """The first in mapping order."""
    return F.coalesce(F.get(macros, F.lit(0)), F.lit(OTHER))


def to_mask(tags: Column, order: Sequence[str]) -> Column:
    """Bit mask of a tag set, by each tag's place in ``order``; more than 63 are an error."""
    if len(order) > 63:
        raise ValueError(f"{len(order)} labels; a mask has room for 63")
    places = F.create_map(*(x for i, t in enumerate(order) for x in (F.lit(t), F.lit(1 << i).cast("long"))))
    return F.aggregate(tags, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.coalesce(places[t], F.lit(0).cast("long"))))


def counted(rows: DataFrame, by: str) -> DataFrame:
    """(by, n), the most frequent first, ties by name."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def distribution(each: DataFrame, rows: DataFrame, label: str = "tag") -> DataFrame:
    """Count of each label and its share of all rows; shares of multi-label rows sum to more than 1."""
    total = rows.agg(F.count("*").alias("total"))
    return each.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), label)


def unmapped_tags(rows: DataFrame, mapping: DataFrame, tags: str = "tags") -> DataFrame:
    each = rows.select(F.explode(tags).alias("tag")).where(normalize_tag(F.col("tag")) != "")
    known = F.broadcast(mapping.select(normalize_tag(F.col("tag")).alias("known")))
    return counted(each.join(known, normalize_tag(F.col("tag")) == F.col("known"), "left_anti"), "tag")


def roll_up(each: DataFrame, hierarchy: DataFrame, label: str = "macro", key: str = "id") -> DataFrame:
    """Per row: the broad categories of its labels, sorted."""
    return each.join(F.broadcast(hierarchy), F.col(label) == F.col("l2")).groupBy(key).agg(F.array_sort(F.collect_set("l1")).alias("level1"))


def not_in_hierarchy(each: DataFrame, hierarchy: DataFrame, label: str = "macro") -> DataFrame:
    """Labels without a place in the hierarchy; there should be none."""
    return each.select(label).distinct().join(F.broadcast(hierarchy), F.col(label) == F.col("l2"), "left_anti")


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts before and after, absent ones 0, with difference and relative reduction."""
    full = before.select(key, F.col("n").alias("before")).join(after.select(key, F.col("n").alias("after")), key, "full").na.fill(0)
    return full.withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "reduction", F.coalesce(F.try_divide((F.col("before") - F.col("after")).cast("double"), F.col("before").cast("double")), F.lit(0.0))
    )


#: Statuses of a tag, in the order in which they are tried.
STATUSES = ("debatable", "formal_or_technical", "broad_category", "debatable", "confident")
RATIONALES = (
    "reviewers read this tag in more than one way, so its category is an approximation",
    "the tag names a form, a medium or a technical matter and no topic",
    "the tag covers much, and its category is as wide",
    "no category was found for the tag",
    "the tag and its category mean the same",
)


def audit(
    rows: DataFrame,
    mapping: DataFrame,
    debatable: Sequence[str] = (),
    formal: tuple[Sequence[str], Sequence[str]] = ((), ()),
    broad: tuple[Sequence[str], Sequence[str]] = ((), ()),
) -> DataFrame:
    """Per tag: count, first form seen, up to five first ids, category, status and rationale.

    ``formal`` and ``broad`` are (categories, tags). The first of the five branches that fits decides: debatable by its tag, formal, broad, debatable as no
    category was found, confident.
    """
    each = rows.select("id", "ord", F.posexplode("tags").alias("at", "tag")).withColumn("tag_norm", normalize_tag(F.col("tag"))).where("tag_norm <> ''")
    ranked = each.groupBy("tag_norm").agg(F.count("*").alias("n"), F.min_by("tag", F.struct("ord", "at")).alias("tag_raw"))
    # the five lowest of each group: per task first, then of those
    few = (
        each.select("tag_norm", "id", "ord").distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("tag_norm").orderBy("ord", "id")))
        .where("rank <= 5")
        .groupBy("tag_norm")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string")), ", ").alias("examples"))
    )
    joined = ranked.join(few, "tag_norm").join(F.broadcast(mapping.select(normalize_tag(F.col("tag")).alias("tag_norm"), "macro")), "tag_norm", "left")
    tag, macro = F.col("tag_norm"), F.coalesce("macro", F.lit(OTHER))
    branches = (tag.isin(*debatable), macro.isin(*formal[0]) | tag.isin(*formal[1]), macro.isin(*broad[0]) | tag.isin(*broad[1]), macro == OTHER)

    def first(values: Sequence[str]) -> Column:
        out = F.lit(values[-1])
        for fits, value in reversed(list(zip(branches, values, strict=False))):
            out = F.when(fits, F.lit(value)).otherwise(out)
        return out

    return joined.withColumns({"status": first(STATUSES), "rationale": first(RATIONALES), "macro": macro}).orderBy(F.desc("n"), "tag_norm")


def single_label(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON list of labels, stored as text, has exactly one; text that is no list has none."""
    return rows.where(F.size(F.from_json(F.col(text), "array<string>")) == 1)
