"""Building the corpus: months, sampling, deduplication, coverage and quality gates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def months(spark: SparkSession, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(year, month) of every month from the first to the last, both included."""
    ends = [F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in (first, last)]
    day = spark.range(1).select(F.explode(F.sequence(*ends, F.expr("interval 1 month"))).alias("d"))
    return day.select(F.year("d").cast("long").alias("year"), F.month("d").cast("long").alias("month"))


def archive_urls(rows: DataFrame, base: str) -> DataFrame:
    """Two candidate addresses of a month, in order."""
    forms = F.array(F.format_string(f"{base}/%04d/%02d/", F.col("year").cast("int"), F.col("month").cast("int")), F.format_string(f"{base}/%02d-%04d.html", F.col("month").cast("int"), F.col("year").cast("int")))
    return rows.select("year", "month", F.posexplode(forms).alias("candidate", "url"))


def sample_order(seed: int, *keys: str) -> Column:
    """A digest of seed and keys: the order of a repeatable sample without replacement."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def sample_months(rows: DataFrame, per_month: int, seed: int) -> DataFrame:
    """Rows of each month by digest up to ``per_month``, ranked by id as text, with the month's candidate count.

    The digest's rank is a window over a month; the counts are an aggregation that is joined back.
    """
    keyed = rows.withColumn("__order", sample_order(seed, "year", "month", "id"))
    drawn = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("year", "month").orderBy("__order", "id"))).where(F.col("__rank") <= per_month)
    counts = rows.groupBy("year", "month").agg(F.count("*").alias("candidates"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("year", "month").orderBy(F.col("id").cast("string"))))
    return ranked.drop("__order", "__rank").join(counts, ["year", "month"])


def first_of(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Per key: the lowest ordering as struct ``first`` and the number of rows. Copies meet as partial minima only."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))


def deduplicate(rows: DataFrame, key: str = "hash", order: tuple[str, ...] = ("ord", "id"), tags: str | None = "tags") -> DataFrame:
    """The first row of each key; its tags are those of all copies in order of their first appearance."""
    firsts = first_of(rows, key, order)
    kept = rows.join(firsts, (rows[key] == firsts[key]) & (F.struct(*(rows[c] for c in order)) == firsts["first"])).drop(firsts[key]).drop("first")
    if tags is None:
        return kept
    each = rows.select(key, *order, F.posexplode(tags).alias("__at", "__tag"))
    seen = each.groupBy(key, "__tag").agg(F.min(F.struct(*order, "__at")).alias("__first"))
    merged = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__tag"))), lambda s: s["__tag"]).alias("merged_tags"))
    return kept.join(merged, key, "left").withColumn("merged_tags", F.coalesce("merged_tags", F.array().cast("array<string>")))


def duplicates(rows: DataFrame, key: str = "hash", order: tuple[str, ...] = ("ord", "id")) -> DataFrame:
    """(key, kept_id, duplicate_id) of every row that is not its key's first."""
    firsts = first_of(rows, key, order).where("copies > 1").select(F.col(key), F.col("first.id").alias("kept_id"))
    return rows.join(firsts, key).where(F.col("id") != F.col("kept_id")).select(key, "kept_id", F.col("id").alias("duplicate_id"))


def month_coverage(rows: DataFrame, calendar: DataFrame, per_month: int) -> DataFrame:
    """Candidates, tagged candidates and selected rows of every month, 0 where there are none."""
    tagged = F.count_if(F.size("tags") > 0)
    counts = rows.groupBy("year", "month").agg(F.count("*").alias("total"), tagged.alias("tagged"), F.least(tagged, F.lit(per_month).cast("long")).alias("selected"))
    return calendar.join(counts, ["year", "month"], "left").na.fill(0, ["total", "tagged", "selected"])


def year_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("year").agg(
        F.count("*").alias("months"), F.sum("total").alias("total"), F.sum("tagged").alias("tagged"), F.sum("selected").alias("selected")
    )


def gates(rows: DataFrame) -> DataFrame:
    """One row: is the table not empty, does each row have a tag, are ids unique."""
    n = F.count("*")
    return rows.agg((n > 0).alias("not_empty"), (F.count_if(F.size("tags") >= 1) == n).alias("all_tagged"), (F.count_distinct("id") == n).alias("unique_ids"))


def chunked_checksum(rows: DataFrame, value: Column, order: str, width: int = 1024) -> DataFrame:
    """One digest of a column in order: of the digests of runs of ``width`` ordinals, so that no group grows with the table."""
    chunk = rows.select(F.floor(F.col(order) / width).cast("long").alias("__c0"), F.col(order).alias("__o"), value.alias("__v"))
    joined = lambda v, o: F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o), F.col(v)))), lambda s: s[v]), "\n"), F.lit("\n")), 256)
    level = chunk.groupBy("__c0").agg(joined("__v", "__o").alias("__v"))
    return level.groupBy().agg(joined("__v", "__c0").alias("checksum"))


def rolling_checksum(rows: DataFrame, column: str, *order: str) -> str:
    """SHA-256 of the column's lines in order: it is serial by definition, so the values pass the driver one partition at a time."""
    import hashlib

    digest = hashlib.sha256()
    for row in _stream(rows.select(column, *[o for o in order if o != column]).orderBy(*order)):
        digest.update(f"{row[column]}\n".encode())
    return digest.hexdigest()


def _stream(df: DataFrame) -> Iterator:
    yield from df.toLocalIterator(prefetchPartitions=False)


def aligned(rows: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Counts of ids on one side only, and on both."""
    a = rows.select(F.col(key), F.lit(1).alias("a")).distinct()
    b = vectors.select(F.col(key), F.lit(1).alias("b")).distinct()
    return a.join(b, key, "full").agg(
        F.count_if(F.col("b").isNull()).alias("only_rows"), F.count_if(F.col("a").isNull()).alias("only_vectors"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both")
    )
