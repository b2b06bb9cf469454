"""Joins, sets, distinct and streaming forms over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import corpus, parquet
from ..streaming.incremental import coverage, first_seen
from .base import CTE, rounded
from .registry import query


@query("SELECT n_name, r_name, CAST(count(c_custkey) AS BIGINT) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def left_join_totals(spark, sf_dir):
    nation = parquet(spark, sf_dir, "nation").join(F.broadcast(parquet(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    per = parquet(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    joined = nation.join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def semi_join(spark, sf_dir):
    big = parquet(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return parquet(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    return parquet(spark, sf_dir, "customer").join(parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.n, 0) AS BIGINT) AS suppliers, CAST(coalesce(b.n, 0) AS BIGINT) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def full_outer_compare(spark, sf_dir):
    a = parquet(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = parquet(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").na.fill(0)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def grouped_revenue(spark, sf_dir):
    li = parquet(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per = li.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = F.broadcast(parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return per.join(o, "l_orderkey").join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query(CTE + "SELECT DISTINCT lang, source FROM corpus")
def distinct_pairs(spark, sf_dir):
    return corpus(spark, sf_dir).select("lang", "source").distinct()


@query("SELECT CAST(doc_id AS BIGINT) AS id FROM documents INTERSECT SELECT CAST(vec_id AS BIGINT) FROM embeddings")
def intersect_ids(spark, sf_dir):
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).intersect(parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark, sf_dir):
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).subtract(parquet(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT 'customer' AS side, CAST(c_nationkey AS BIGINT) AS nation, CAST(NULL AS DOUBLE) AS rate FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_missing_columns(spark, sf_dir):
    c = parquet(spark, sf_dir, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").cast("long").alias("nation"))
    s = parquet(spark, sf_dir, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("rate"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_ends(spark, sf_dir):
    return parquet(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT sha256(text) AS text_sha, CAST(min(doc_id) AS BIGINT) AS id FROM documents GROUP BY text")
def incremental_distinct(spark, sf_dir):
    """What the streaming form keeps, once all rows have come."""
    return first_seen(parquet(spark, sf_dir, "documents"), "text", "doc_id").select(F.sha2("text", 256).alias("text_sha"), F.col("doc_id").alias("id"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_coverage(spark, sf_dir):
    found = coverage(parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day")
    return rounded(found.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total")))
