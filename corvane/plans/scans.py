"""Scans, projections, corpus building and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import join_url, parse_date, parse_rating, text_hash, truncate
from ..operators import corpus as ops
from ..sources import html
from ..sources.config import HIERARCHY, hierarchy_table, mapping_table
from ..sources.tables import corpus, parquet, project, with_text_hash
from .base import CTE, fold_sql, norm_sql
from .registry import query

SEED, PER_MONTH = 42, 30
FIRST, LAST = (1996, 1), (2026, 12)
BASE = "https://archive.example"
_HASH = f"sha256({fold_sql(norm_sql('text'))})"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their digest; the queries keep the few columns that they need, so that texts are normalised once."""
    return corpus(spark, sf_dir).withColumn("hash", text_hash(F.col("text")))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def typed_scan(spark, sf_dir):
    return parquet(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"SELECT doc_id AS id, {_HASH} AS text_norm_hash FROM documents")
def hash_backfill(spark, sf_dir):
    return with_text_hash(parquet(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")).select("id", "text_norm_hash")


@query(CTE + "SELECT CAST(id AS VARCHAR) AS id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, sha256(text) AS text_sha, rating IS NULL AS no_rating, 27 AS columns FROM (SELECT *, NULL AS rating FROM corpus)")
def null_padded_projection(spark, sf_dir):
    flat = project(corpus(spark, sf_dir))
    return flat.select("id", "year", "month", F.sha2("text", 256).alias("text_sha"), F.col("rating").isNull().alias("no_rating"), F.lit(len(flat.columns)).alias("columns"))


@query(CTE + "SELECT id, CAST(len(tags) AS INT) AS tag_count, to_json(tags) AS tags_json, tags[1] AS first_tag, '2026-01-01T00:00:00Z' AS parsed_at FROM corpus")
def enrich_rows(spark, sf_dir):
    return corpus(spark, sf_dir).select(
        "id", F.size("tags").alias("tag_count"), F.to_json("tags").alias("tags_json"), F.get("tags", F.lit(0)).alias("first_tag"), F.lit("2026-01-01T00:00:00Z").alias("parsed_at")
    )


@query(f"SELECT doc_id AS id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substr(t, 1, 159), ' ') || '…' END AS preview FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents)")
def preview(spark, sf_dir):
    return parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), truncate(F.col("text"), 160).alias("preview"))


@query(CTE + "SELECT pos, macro, tag FROM map")
def mapping_flatten(spark, sf_dir):
    return mapping_table(spark).select("pos", "macro", "tag")


@query(CTE + "SELECT macro, CAST(min(pos) AS INT) AS pos, CAST(count(*) AS BIGINT) AS tags FROM map GROUP BY macro")
def mapping_order(spark, sf_dir):
    return mapping_table(spark).groupBy("macro").agg(F.min("pos").alias("pos"), F.count("*").alias("tags"))


_H = ", ".join(f"('{a}', '{b}')" for a, fine in HIERARCHY.items() for b in fine)


@query(f"SELECT l1, CAST(count(*) AS BIGINT) AS n, string_agg(l2, ', ' ORDER BY l2) AS l2s FROM (VALUES {_H}) AS t(l1, l2) GROUP BY l1")
def hierarchy_check(spark, sf_dir):
    return hierarchy_table(spark).groupBy("l1").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("l2")), ", ").alias("l2s"))


@query("""SELECT CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS only_rows, CAST(count(*) FILTER (d IS NULL) AS BIGINT) AS only_vectors,
CAST(count(*) FILTER (v IS NOT NULL AND d IS NOT NULL) AS BIGINT) AS both FROM (SELECT DISTINCT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT vec_id AS v FROM embeddings) ON d = v""")
def alignment_check(spark, sf_dir):
    return ops.aligned(parquet(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), parquet(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"))


@query(f"""WITH c AS (SELECT doc_id // 1024 AS c, sha256(string_agg({_HASH}, chr(10) ORDER BY doc_id) || chr(10)) AS h FROM documents GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY c) || chr(10)) AS checksum FROM c""")
def column_checksum(spark, sf_dir):
    """A digest of the digests of runs of ordinals: the form that no task has to read in one piece."""
    return ops.chunked_checksum(_hashed(spark, sf_dir), F.col("hash"), "ord")


@query(f"SELECT sha256(string_agg({_HASH}, chr(10) ORDER BY doc_id) || chr(10)) AS checksum FROM documents")
def rolling_checksum(spark, sf_dir):
    """The serial digest, line by line, in order."""
    return spark.createDataFrame([(ops.rolling_checksum(_hashed(spark, sf_dir), "hash", "ord"),)], "checksum string")


@query(f"""WITH m AS (SELECT CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2026-12-01', INTERVAL 1 MONTH)) AS d))
SELECT year, month, 0 AS candidate, format('{BASE}/{{:04d}}/{{:02d}}/', year, month) AS url FROM m UNION ALL SELECT year, month, 1, format('{BASE}/{{:02d}}-{{:04d}}.html', month, year) FROM m""")
def url_candidates(spark, sf_dir):
    return ops.archive_urls(ops.months(spark, FIRST, LAST), BASE)


@query("SELECT CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2026-12-01', INTERVAL 1 MONTH)) AS d)")
def month_sequence(spark, sf_dir):
    return ops.months(spark, FIRST, LAST)


@query("SELECT id, CAST(row_number() OVER (PARTITION BY source ORDER BY CAST(id AS VARCHAR)) AS INT) AS place FROM (SELECT doc_id AS id, source FROM documents)")
def string_sort(spark, sf_dir):
    from pyspark.sql import Window

    rows = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return rows.select("id", F.row_number().over(Window.partitionBy("source").orderBy(F.col("id").cast("string"))).alias("place"))


@query(CTE + "SELECT year, month, id, source FROM corpus ORDER BY year, month, id")
def multi_key_sort(spark, sf_dir):
    return corpus(spark, sf_dir).select("year", "month", "id", "source").orderBy("year", "month", "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def top_k(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query(CTE + "SELECT year, month, id FROM (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY id) AS r FROM corpus) WHERE r <= 30")
def month_cap_30(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("year", "month").orderBy("id"))
    return corpus(spark, sf_dir).withColumn("r", r).where("r <= 30").select("year", "month", "id")


@query(CTE + f"SELECT id, cl, year, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79), ' ') || '…' END AS preview, CAST(length(t) AS INT) AS score FROM (SELECT *, {norm_sql('text')} AS t FROM corpus)")
def example_rows(spark, sf_dir):
    from ..functions.text import normalize_text

    return corpus(spark, sf_dir).select("id", "cl", "year", truncate(F.col("text"), 80).alias("preview"), F.char_length(normalize_text(F.col("text"))).alias("score"))


@query(CTE + """, c AS (SELECT id, year, month, md5('42:' || year || ':' || month || ':' || id) AS o FROM corpus),
d AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY o, id) AS k, count(*) OVER (PARTITION BY year, month) AS candidates FROM c)
SELECT year, month, id, CAST(row_number() OVER (PARTITION BY year, month ORDER BY CAST(id AS VARCHAR)) AS INT) AS rank, CAST(candidates AS BIGINT) AS candidates FROM d WHERE k <= 30""")
def month_sample_rank(spark, sf_dir):
    return ops.sample_months(corpus(spark, sf_dir), PER_MONTH, SEED).select("year", "month", "id", "rank", "candidates")


@query(CTE + f", h AS (SELECT id, {_HASH} AS hash FROM corpus) SELECT hash, CAST(min(id) AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS copies FROM h GROUP BY hash")
def dedup_keep_first(spark, sf_dir):
    return ops.deduplicate(_hashed(spark, sf_dir).select("id", "ord", "hash").persist(), tags=None).select("hash", "id", "copies")


@query(CTE + f", h AS (SELECT id, {_HASH} AS hash FROM corpus) SELECT id, hash FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM h) WHERE n > 1")
def dup_groups_all(spark, sf_dir):
    h = _hashed(spark, sf_dir).select("id", "ord", "hash").persist()
    many = ops.first_of(h, "hash", ("ord", "id")).where("copies > 1").select("hash")
    return h.join(many, "hash", "left_semi").select("id", "hash")


@query(CTE + f", h AS (SELECT id, {_HASH} AS hash FROM corpus), f AS (SELECT *, min(id) OVER (PARTITION BY hash) AS kept_id FROM h) SELECT hash, kept_id, id AS duplicate_id FROM f WHERE id <> kept_id")
def duplicate_records(spark, sf_dir):
    return ops.duplicates(_hashed(spark, sf_dir).select("id", "ord", "hash").persist())


@query(CTE + f""", h AS (SELECT id, tags, {_HASH} AS hash FROM corpus), x AS (SELECT hash, id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM h),
s AS (SELECT hash, tag, min(row(id, pos)) AS f FROM x GROUP BY hash, tag), m AS (SELECT hash, string_agg(tag, ' ' ORDER BY f) AS merged FROM s GROUP BY hash)
SELECT k.hash, k.id, coalesce(merged, '') AS merged FROM (SELECT hash, min(id) AS id FROM h GROUP BY hash) k LEFT JOIN m USING (hash)""")
def tag_merge_on_dedup(spark, sf_dir):
    return ops.deduplicate(_hashed(spark, sf_dir).select("id", "ord", "hash", "tags").persist()).select("hash", "id", F.array_join("merged_tags", " ").alias("merged"))


_COVER = """, cal AS (SELECT CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2026-12-01', INTERVAL 1 MONTH)) AS d)),
cnt AS (SELECT year, month, count(*) AS total, count(*) FILTER (len(tags) > 0) AS tagged FROM corpus GROUP BY year, month),
cov AS (SELECT year, month, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(tagged, 0) AS BIGINT) AS tagged, CAST(least(coalesce(tagged, 0), 30) AS BIGINT) AS selected FROM cal LEFT JOIN cnt USING (year, month))
"""


def _coverage(spark, sf_dir):
    return ops.month_coverage(corpus(spark, sf_dir), ops.months(spark, FIRST, LAST), PER_MONTH)


@query(CTE + _COVER + "SELECT * FROM cov")
def month_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(CTE + _COVER + "SELECT year, CAST(count(*) AS BIGINT) AS months, CAST(sum(total) AS BIGINT) AS total, CAST(sum(tagged) AS BIGINT) AS tagged, CAST(sum(selected) AS BIGINT) AS selected FROM cov GROUP BY year")
def year_coverage(spark, sf_dir):
    return ops.year_coverage(_coverage(spark, sf_dir))


@query(CTE + _COVER + "SELECT year, month FROM cov WHERE tagged = 0")
def zero_months(spark, sf_dir):
    return _coverage(spark, sf_dir).where("tagged = 0").select("year", "month")


@query(CTE + _COVER + "SELECT CAST(count(*) FILTER (tagged > 0) AS BIGINT) AS with_rows, CAST(count(*) FILTER (tagged = 0) AS BIGINT) AS without_rows FROM cov")
def coverage_scalars(spark, sf_dir):
    return _coverage(spark, sf_dir).agg(F.count_if(F.col("tagged") > 0).alias("with_rows"), F.count_if(F.col("tagged") == 0).alias("without_rows"))


@query(CTE + "SELECT count(*) > 0 AS not_empty, count(*) FILTER (len(tags) >= 1) = count(*) AS all_tagged, count(DISTINCT id) = count(*) AS unique_ids FROM corpus")
def quality_gates(spark, sf_dir):
    return ops.gates(corpus(spark, sf_dir))


@query(CTE + """SELECT id, CASE WHEN id % 4 = 0 THEN format('{:04d}-{:02d}-01', year, month) ELSE format('{:04d}-{:02d}-{:02d}', year, month, 1 + id % 28) END AS date FROM corpus""")
def date_extract(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    day, month, year = (1 + F.col("id") % 28).cast("int"), F.col("month").cast("int"), F.col("year").cast("int")
    title = F.when(F.col("id") % 4 == 0, F.lit("no date")).otherwise(F.format_string("of %02d.%02d.%04d, noon", day, month, year))
    return rows.select("id", parse_date(title, F.col("year"), F.col("month")).alias("date"))


@query(CTE + """SELECT id, CAST(CASE id % 4 WHEN 0 THEN id WHEN 1 THEN -id WHEN 2 THEN id % 100 END AS DOUBLE) AS rating FROM corpus""")
def rating_parse(spark, sf_dir):
    i = F.col("id")
    votes = F.when(i % 4 == 0, F.concat(F.lit("+"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit(" -"), i.cast("string"))).when(i % 4 == 3, F.lit("many"))
    rates = F.concat((i % 100).cast("string"), F.lit(";7;9"))
    return corpus(spark, sf_dir).select("id", parse_rating(votes, rates).cast("double").alias("rating"))


@query(r"""SELECT page_id, CAST(generate_subscripts(hs, 1) - 1 AS INT) AS at, unnest(hs) AS href, unnest(ls) AS label FROM (SELECT page_id,
regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ls FROM pages)""")
def page_links(spark, sf_dir):
    return html.links(parquet(spark, sf_dir, "pages"))


@query(rf"""WITH l AS (SELECT page_id, generate_subscripts(hs, 1) AS pos, unnest(hs) AS href, trim(unnest(ls), ' ') AS tag_raw FROM (SELECT page_id,
regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ls FROM pages)),
f AS (SELECT {fold_sql('tag_raw')} AS tag_norm, min(row(page_id, pos, tag_raw, href)) AS f FROM l WHERE tag_raw <> '' GROUP BY 1)
SELECT tag_norm, f[3] AS tag_raw, '{BASE}/' || ltrim(f[4], '/') AS url FROM f""")
def link_dictionary(spark, sf_dir):
    return html.link_dictionary(html.links(parquet(spark, sf_dir, "pages")), BASE)


_PARAGRAPH = r"(?s)<p>([^<]+)</p>"


def _boxed(spark, sf_dir):
    """The stored pages with each plain paragraph laid in a box, tagged by the language in the page's address."""
    p = parquet(spark, sf_dir, "pages")
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    tag = F.when(lang == "", "").otherwise(F.concat(F.lit('<div class="tags"><a href="/tags/'), lang, F.lit('">'), lang, F.lit("</a></div>")))
    box = F.concat(F.lit('<div class="topicbox" data-t="j"><p class="title">01.02.2003</p><div class="text">$1</div>'), tag, F.lit('<span class="num">+5</span></div>'))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", F.lit(_PARAGRAPH), box).alias("html"))


@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, '{_PARAGRAPH}')) AS BIGINT) AS boxes, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_blocks(spark, sf_dir):
    """Boxes that the parser finds on each page."""
    p = _boxed(spark, sf_dir)
    found = html.blocks(p.select("page_id", "html")).where("body IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("boxes"))
    return p.select("page_id", "title").join(found, "page_id", "left").select("page_id", F.coalesce("boxes", F.lit(0)).cast("long").alias("boxes"), "title")


@query()
def page_records(spark, sf_dir):
    """All boxes of all pages as corpus records."""
    return html.records(html.blocks(_boxed(spark, sf_dir).select("page_id", "html")), 2003, 2, BASE).drop("tags_raw")


@query("""SELECT h AS host, page_id FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS h, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS r FROM pages WHERE trim(html, ' ') <> '' AND page_id % 3 <> 0) WHERE r = 1""")
def source_fallback(spark, sf_dir):
    p = parquet(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("html"))
    return html.first_source(p, "host", "page_id", "html").select("host", "page_id")


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '{BASE}/' || ltrim(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '/') END AS absolute FROM pages""")
def url_join(spark, sf_dir):
    link = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1))
    return parquet(spark, sf_dir, "pages").select("page_id", join_url(BASE, link).alias("absolute"))


