"""Threshold-scaled sketch: every shingle hash below a fixed share of the hash range is kept.

Since the threshold is fixed, sketches of parts merge by a set union, and containment of a short
document in a very long one is estimated without a common sketch size. All steps are built-in
expressions over one row; only the lookup of the next document exchanges rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, words

SHINGLE = 5
SCALED = 4  # one hash in so many is kept


def sketch(text: Column, shingle: int = SHINGLE, scaled: int = SCALED) -> Column:
    """Sorted distinct 64-bit hashes of the text's word shingles that fall in the lowest 1/scaled.

    A text of fewer words than a shingle, but at least one, has all its words as its one shingle, and
    that one is kept always, as is the smallest hash of a longer text that keeps none: no text with
    words has an empty sketch. Null and wordless texts have an empty one.
    """
    threshold = (1 << 64) // scaled - (1 << 63)  # xxhash64 is signed and uniform
    return F.transform(F.array(words(text)), lambda w: _kept(w, shingle, threshold))[0]


def _kept(w: Column, shingle: int, threshold: int) -> Column:
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(shingle))))
    low = F.transform(F.array(hashes), lambda h: F.array(F.array_sort(F.array_distinct(F.filter(h, lambda x: x < threshold))), F.array(F.array_min(h))))[0]
    long = F.transform(F.array(low), lambda p: F.when(F.size(p[0]) > 0, p[0]).otherwise(p[1]))[0]
    empty = F.array().cast("array<bigint>")
    return F.when(n == 0, empty).when(n < shingle, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(long)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds: 0 if either sketch is empty, 1 if both are."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)
    )


def likeness(a: Column, b: Column) -> Column:
    """The larger of both containments, so that a short text wholly inside a long one scores 1."""
    small = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(small == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def with_next(docs: DataFrame, key: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Add next_<column> of the row that follows in ascending ``key`` order; the first row follows the last.

    The keys are cut into ranges at approximate quantiles (bounded: one number a range on the driver), each range is
    one window partition, and the last row of a range is served by the first row of the next range that has rows: a table of one
    row a range, joined on the range's number. Rows alike in key follow each other in the order of their columns.
    A null key sorts first.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(at, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    keyed = docs.withColumn("__range", tree(0, len(cuts)))
    order = Window.partitionBy("__range").orderBy(at, *(F.col(c) for c in columns))
    fields = F.struct(*columns)
    firsts = keyed.groupBy("__range").agg(F.min(F.struct(at.alias("k"), *columns)).alias("f"))
    # a few hundred rows of ids alone: which range serves which
    ranges = sorted(r["__range"] for r in keyed.select("__range").distinct().collect())
    served = {r: ranges[(i + 1) % len(ranges)] for i, r in enumerate(ranges)}
    source = spark.createDataFrame([(v, k) for k, v in served.items()] or [(0, 0)], "__range int, __serves int")
    heads = firsts.join(F.broadcast(source), "__range").select(
        F.col("__serves").alias("__range"), F.struct(*(F.col("f")[c].alias(c) for c in columns)).alias("__head"), F.lit(True).alias("__last")
    )
    led = keyed.withColumns({"__next": F.lead(fields).over(order), "__last": F.lead(F.lit(False), 1, True).over(order)})
    return (
        led.join(heads, ["__range", "__last"], "left")
        .withColumn("__use", F.when(F.col("__last"), F.col("__head")).otherwise(F.col("__next")))
        .select(*(c for c in docs.columns if c not in {f"next_{x}" for x in columns}), *(F.col("__use")[c].alias(f"next_{c}") for c in columns))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    A null text counts as empty. A table of one document takes itself as its next one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, "doc_id", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = near.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("f"), sketch(F.col("next_text")).alias("g")
    ).select("*", sketch(F.col("edited")).alias("e"))
    hexes = lambda c: F.array_join(F.transform(c, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        hexes(F.col("f")).alias("fingerprint"),
        hexes(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("g")).alias("near_next"),
    )
