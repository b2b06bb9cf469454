"""Text, JSON and array functions over whole tables; near-duplicate blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import neardup
from ..operators.features import tokens
from ..sources.tables import corpus, parquet
from .base import CTE, fold_sql, labelled, norm_sql, rounded
from .registry import query

_N = norm_sql("text")


def _docs(spark, sf_dir):
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"SELECT doc_id AS id, sha256({_N}) AS normal_sha FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.sha2(fn.normalize_text(F.col("text")), 256).alias("normal_sha"))


@query(f"SELECT doc_id AS id, sha256({fold_sql(_N)}) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", fn.text_hash(F.col("text")).alias("hash"))


@query(rf"SELECT doc_id AS id, CAST(len(regexp_extract_all({_N}, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS BIGINT) AS words FROM documents")
def count_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", fn.count_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id AS id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59), ' ') || '…' END AS short FROM (SELECT doc_id, {_N} AS t FROM documents)")
def truncate_preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", fn.truncate(F.col("text"), 60).alias("short"))


_COUNT = lambda *cs: "CAST(" + " + ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in cs) + " AS BIGINT)"
STRUCTURE_SQL = rf"""SELECT doc_id AS id, greatest(1, length(text) - length(replace(text, chr(10), '')) + 1) AS line_count,
greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentence_count, {_COUNT('-', '—')} AS dash_count, {_COUNT('?')} AS question_count, {_COUNT('!')} AS exclamation_count,
{_COUNT(',')} AS comma_count, {_COUNT('"', '«', '»')} AS quote_count, CAST(length(text) AS BIGINT) AS char_count, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS blank_word_count,
{_COUNT('-', '—')} >= 2 AS looks_like_dialogue, len(regexp_extract_all(text, '\p{{Lu}}')) / greatest(1, len(regexp_extract_all(text, '\p{{L}}'))) AS uppercase_ratio, source, cl
FROM (SELECT doc_id, coalesce(text, '') AS text, source, CAST(CAST(substr(source, 4) AS INT) % 12 AS INT) AS cl FROM documents)"""


@query(f"SELECT id, line_count, sentence_count, dash_count, question_count, exclamation_count, comma_count, quote_count, char_count, blank_word_count, looks_like_dialogue, round(uppercase_ratio, 6) AS uppercase_ratio FROM ({STRUCTURE_SQL})")
def structural_features(spark, sf_dir):
    return rounded(_docs(spark, sf_dir).select("id", *(c.alias(n) for n, c in fn.structure(F.col("text")).items())))


@query(r"""SELECT CAST(min(c) AS BIGINT) AS min_chars, median(c) AS median_chars, round(avg(c), 6) AS mean_chars, CAST(max(c) AS BIGINT) AS max_chars, CAST(min(w) AS BIGINT) AS min_words, median(w) AS median_words,
round(avg(w), 6) AS mean_words, CAST(max(w) AS BIGINT) AS max_words FROM (SELECT length(coalesce(text, '')) AS c, len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) AS w FROM documents)""")
def length_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("c"), fn.count_blank_words(F.col("text")).alias("w"))
    stats = [f(c).alias(f"{n}_{name}") for c, name in (("c", "chars"), ("w", "words")) for n, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max))]
    return rounded(d.agg(*stats))


@query(r"""SELECT CAST(min(n) AS BIGINT) AS min, median(n) AS median, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS max, CAST(count(*) FILTER (n > 512) AS BIGINT) AS truncated
FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS n FROM documents)""")
def token_length_stats(spark, sf_dir):
    """Lengths in tokens of the hashed embedding, and texts longer than an encoder of 512 would take."""
    n = _docs(spark, sf_dir).select(F.size(tokens(F.col("text"))).cast("long").alias("n"))
    return rounded(n.agg(F.min("n").alias("min"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"), F.count_if(F.col("n") > 512).alias("truncated")))


@query("SELECT doc_id AS id, lower(source) || ' x' AS tag FROM documents")
def normalize_tag(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper("source"), F.lit(" \t X "))
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fn.normalize_tag(raw).alias("tag"))


@query(f"SELECT doc_id AS id, {fold_sql(f'substr({_N}, 1, 24)')} AS block FROM documents")
def block_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", fn.block_key(F.col("text")).alias("block"))


@query(f"SELECT {fold_sql(f'substr({_N}, 1, 24)')} AS block, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def near_duplicate_blocks(spark, sf_dir):
    return neardup.block_counts(_docs(spark, sf_dir))


@query()
def near_duplicates(spark, sf_dir):
    return rounded(neardup.near_duplicates(_docs(spark, sf_dir)))


@query()
def duplicate_report(spark, sf_dir):
    """The first 200 copies and near-duplicates."""
    return rounded(neardup.report(_docs(spark, sf_dir)))


@query(f"SELECT doc_id AS id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_N}) AS kept, count(*) OVER (PARTITION BY {_N}) AS n FROM documents) WHERE n > 1")
def exact_duplicate_groups(spark, sf_dir):
    return neardup.exact_groups(_docs(spark, sf_dir))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '|' || CAST(user_id AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'not json ' || event_type ELSE event_type END AS items FROM events""")
def json_list_parse(spark, sf_dir):
    e = parquet(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
        .when(F.col("event_id") % 5 == 1, F.lit("  "))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("not json "), "event_type"))
        .when(F.col("event_id") % 5 == 4, F.concat(F.lit('"'), "event_type", F.lit('"')))
    )
    return e.select("event_id", F.array_join(fn.parse_json_list(text), "|").alias("items"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_field_counts(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(CTE + "SELECT id, array_to_string(list_distinct_ordered, ' ') AS tags FROM (SELECT id, list_concat(tags, CASE WHEN list_contains(tags, source) THEN [] ELSE [source] END) AS list_distinct_ordered FROM corpus)")
def array_ordered_distinct(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.array_join(F.array_distinct(F.concat("tags", F.array("source"), "tags")), " ").alias("tags"))


@query(CTE + "SELECT id, mask FROM cm")
def label_bitmask(spark, sf_dir):
    from ..operators.labels import to_mask
    from ..sources.config import MACROS, OTHER

    return labelled(spark, sf_dir).select("id", to_mask(F.col("macros"), [*MACROS, OTHER]).alias("mask"))


@query(CTE + "SELECT id, list_aggregate(macros, 'min') AS label FROM cm")
def primary_label_alpha(spark, sf_dir):
    from ..operators.labels import primary_alphabetical

    return labelled(spark, sf_dir).select("id", primary_alphabetical(F.col("macros")).alias("label"))


@query(CTE + "SELECT id, macros[1] AS label FROM cm")
def primary_label_first(spark, sf_dir):
    from ..operators.labels import primary_first

    return labelled(spark, sf_dir).select("id", primary_first(F.col("macros")).alias("label"))


@query(CTE + "SELECT id, array_to_string(macros[1:2], '|') AS first_two FROM cm")
def array_slice(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", F.array_join(F.slice("macros", 1, 2), "|").alias("first_two"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS k, p_brand AS metric, p_type || '=x' AS rest FROM part")
def parse_params(spark, sf_dir):
    text = F.concat(F.lit(" k = "), F.col("p_size").cast("string"), F.lit(";metric="), "p_brand", F.lit(" ;flag;rest="), "p_type", F.lit("=x"))
    m = fn.parse_params(text)
    return parquet(spark, sf_dir, "part").select("p_partkey", m["k"].alias("k"), m["metric"].alias("metric"), m["rest"].alias("rest"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 100 AS weight FROM part")
def weight_capture(spark, sf_dir):
    name = F.format_string("hybrid_dw%.2f_lw0.10", F.col("p_size") / 100)
    return parquet(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(name, "dw([0-9.]+)", 1).cast("double").alias("weight"))


@query("SELECT id, lower(tag) = 'other' AS is_other FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'other' ELSE 'another' END AS tag FROM documents)")
def other_test(spark, sf_dir):
    tag = F.when(F.col("doc_id") % 3 == 0, "OTHER").when(F.col("doc_id") % 3 == 1, "other").otherwise("another")
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tag.rlike("(?i)^other$").alias("is_other"))
