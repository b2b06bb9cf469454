"""Benchmark decontamination by winnowing.

The k-gram hashes of a text are cut to the minimum of every ``WINDOW - K + 1`` consecutive ones, so two
texts that share WINDOW words share a kept hash. Kept hashes of documents and items are joined; each
shared hash gives diagonals (document position minus item position), and along each diagonal the words
themselves are compared, so that a hit is every word of every shared span of WINDOW words, no more and no fewer.
Items shorter than WINDOW words cannot rely on that guarantee: each of their lengths adds whole
item-length grams of the documents, which are compared the same way.

Null texts have no words and no hits. Repeated rows each get the same answer. Items of a null id count
as the id ``null``; items without words never occur. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, maybe_broadcast, table, words

WINDOW = 13
K = 6


def grams(w: Column, k: int) -> Column:
    """Hash of the k words from each position on; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(w) - k)
    hashes = F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, width: int = WINDOW - K + 1) -> Column:
    """Distinct minima of all windows of ``width`` hashes."""
    at = F.sequence(F.lit(1), F.size(hashes) - width + 1)
    minima = F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(hashes, i, width))))
    return F.when(F.size(hashes) >= width, minima).otherwise(F.array().cast("array<bigint>"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per row: doc_id, key, n_words; per key: position of each hit word; per key: item_id and span of each item that occurs).

    ``docs`` has doc_id and text, ``items`` item_id and text; key is a digest of the text, so that
    copies are extended once.
    """
    item = checkpoint(
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("iw"))
        .where(F.size("iw") > 0)
        .distinct()
        .withColumns({"item": F.xxhash64("item_id", "iw"), "span": F.least(F.lit(window), F.size("iw"))})
    )
    short = sorted(r["span"] for r in item.where(F.col("span") < window).select("span").distinct().collect())  # window - 1 numbers at most
    kept = F.when(F.col("span") == window, winnow(grams(F.col("iw"), k), window - k + 1))
    for m in short:
        kept = kept.when(F.col("span") == m, grams(F.col("iw"), m))
    every = F.concat(*(F.transform(grams(F.col("iw"), m), lambda h, i: F.struct(i.alias("ip"), h.alias("fp"))) for m in [k, *short]))
    mine = item.withColumns({"kept": kept, "every": every})
    places = checkpoint(
        mine.select("item", F.explode(F.filter("every", lambda x: F.array_contains(F.col("kept"), x["fp"]))).alias("x")).select(
            "item", "x.fp", "x.ip"
        )
    )
    fps = checkpoint(places.select("fp").distinct())

    text = F.coalesce(F.col("text"), F.lit(""))
    scan = checkpoint(
        docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), words(F.col("text")).alias("w"))
        .select("doc_id", "key", F.size("w").alias("n_words"), grams(F.col("w"), k).alias("g"), *(grams(F.col("w"), m).alias(f"g{m}") for m in short))
        .select("doc_id", "key", "n_words", F.array_distinct(F.concat(winnow(F.col("g"), window - k + 1), *(F.col(f"g{m}") for m in short))).alias("fps"))
    )
    found = checkpoint(
        scan.select("key", F.explode("fps").alias("fp")).join(maybe_broadcast(fps), "fp", "left_semi").select("key").distinct()
    )
    hit = checkpoint(
        docs.select(F.md5(text.cast("binary")).alias("key"), "text")
        .join(maybe_broadcast(found), "key")
        .dropDuplicates(["key"])
        .select("key", words(F.col("text")).alias("w"))
    )
    all_grams = F.concat(*(F.transform(grams(F.col("w"), m), lambda h, i: F.struct(i.alias("dp"), h.alias("fp"))) for m in [k, *short]))
    # every gram of a document that is hit meets the items' kept ones; the words decide below
    diagonals = checkpoint(
        hit.select("key", F.explode(all_grams).alias("x"))
        .select("key", "x.fp", "x.dp")
        .join(maybe_broadcast(places), "fp")
        .select("key", "item", (F.col("dp") - F.col("ip")).alias("off"))
        .distinct()
    )
    first = F.greatest(F.col("off"), F.lit(0))
    beside = diagonals.join(hit.select("key", "w"), "key").join(maybe_broadcast(checkpoint(item.select("item", "item_id", "iw", "span"))), "item")
    # the document's words that lie beside the item's on this diagonal
    beside = beside.select("key", "item_id", "span", "off", "iw", F.slice("w", first + 1, F.size("iw")).alias("dw"), first.alias("first"))
    spans = checkpoint(
        beside.withColumn("same", F.transform("iw", lambda x, j: F.coalesce(x == F.get(F.col("dw"), F.col("off") + j - F.col("first")), F.lit(False))))
        .select(
            "key",
            "item_id",
            "span",
            F.explode(
                F.expr("filter(sequence(0, size(iw) - span), j -> forall(slice(same, j + 1, span), x -> x))")
            ).alias("j"),
            "off",
        )
        .select("key", "item_id", (F.col("off") + F.col("j")).alias("start"), "span")
        .distinct()
    )
    where = spans.select("key", F.explode(F.expr("sequence(start, start + span - 1)")).alias("pos")).distinct()
    return scan.select("doc_id", "key", "n_words"), where, spans.select("key", "item_id", "span").distinct()


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, key, n_words, n_hit, item_ids (sorted strings), contaminated."""
    rows, where, which = find_hits(docs, items, window, k)
    per_key = (
        where.groupBy("key")
        .agg(F.count("*").alias("n_hit"))
        .join(which.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")), "key")
    )
    return rows.join(maybe_broadcast(checkpoint(per_key)), "key", "left").select(
        "doc_id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    ).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with their own columns, that hold no window of any item.

    A document of any length goes for one span of WINDOW words. Items of fewer words are too common for that: their hits count only if the
    document is contaminated by them (one word in twenty).
    """
    rows, where, which = find_hits(docs, items)
    hits = where.groupBy("key").agg(F.count("*").alias("n_hit")).join(which.groupBy("key").agg(F.max("span").alias("span")), "key").join(rows.select("key", "n_words").distinct(), "key")
    bad = checkpoint(hits.where((F.col("span") >= WINDOW) | contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias("__key")))
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumn("__key", key).join(maybe_broadcast(bad), "__key", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, ws, least(13, len(ws)) AS l
  FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[j:j + l - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS j FROM item)),
doc AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
occ AS (
  SELECT rid, i, l, array_to_string(ws[i:i + l - 1], ' ') AS g
  FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM doc, (SELECT DISTINCT l FROM win))),
hit AS (SELECT rid, i, l, item_id FROM occ JOIN win USING (l, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
