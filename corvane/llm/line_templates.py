"""Log-template tree for line deduplication.

A line's tokens are parsed to a fixed depth: tokens with a digit become the variable ``<*>``, and the
leaf is the number of tokens and the leading tokens. In a leaf with several distinct lines, a token
stays constant at its position if lines of at least ``min_docs`` texts have it there, and is generalised to ``<*>`` else; a
line takes that template if at least ``min_share`` of its tokens stay constant, and is its own template
otherwise. A template seen in ``min_docs`` distinct texts recurs: all its lines are dropped but the first line of
the first document (lowest doc_id) that has it. A short template (of less than ``MIN_TOKENS`` constant tokens and ``MIN_CHARS`` characters)
recurs from ``SHORT_DOCS`` texts on, as short lines meet by chance. Lines without a constant token have no template.

Lines are grouped by digests; counts run over distinct lines, not over occurrences, so a line that a third of all documents
share is one row from the first aggregation on. Line texts are read again only for leaves that can hold a recurring template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, maybe_broadcast, table

DEPTH = 3
MIN_TOKENS = 5
MIN_CHARS = 60
MIN_DOCS = 3
SHORT_DOCS = 10
MIN_SHARE = 0.8
_NO_ID = -(1 << 62)


def mask(line: Column) -> Column:
    """Tokens parted by one space, those with an ASCII digit replaced by ``<*>``."""
    rough = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.startswith(" ") | line.endswith(" ")
    even = F.when(rough, F.trim(F.regexp_replace(line, "[ \\t\\r\\f]+", " "))).otherwise(line)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(even)


def _is_short(constants: Column, template: Column) -> Column:
    return (constants < MIN_TOKENS) & (F.char_length(template) < MIN_CHARS)


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # masked inside the generator: a filter on what follows cannot repeat the work
    masked = F.transform(F.split(text, "\n"), mask)
    return (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("tk"), F.posexplode(masked).alias("pos", "masked"))
        .withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
        .withColumn("n_var", F.expr("(length(masked) - length(replace(masked, '<*>', ''))) div 3"))
        .where((F.col("n") > F.col("n_var")) & (F.col("masked") != ""))
        .withColumns(
            {
                "h1": F.xxhash64("masked"),
                "h2": F.xxhash64(F.lit(1), "masked"),
                "leaf": F.xxhash64("n", F.substring_index("masked", " ", DEPTH)),
                "is_short": _is_short(F.col("n") - F.col("n_var"), F.col("masked")),
            }
        )
        .select(*columns)
    )


def _templates(docs: DataFrame, distinct: DataFrame, per_text: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(h1, h2, t1, t2, is_short) of the lines that a template generalises."""
    leaves = checkpoint(
        distinct.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n_texts").alias("texts")).where((F.col("lines") > 1) & (F.col("texts") >= min_docs)).select("leaf")
    )
    bodies = (
        _lines(docs, "h1", "h2", "leaf", "masked")
        .join(maybe_broadcast(leaves), "leaf", "left_semi")
        .dropDuplicates(["h1", "h2"])
        .join(distinct.select("h1", "h2", "n_texts"), ["h1", "h2"])
    )
    tokens = checkpoint(bodies.select("h1", "h2", "leaf", "n_texts", F.posexplode(F.split("masked", " ")).alias("at", "token")))
    slots = tokens.where(F.col("token") != "<*>").groupBy("leaf", "at", "token").agg(F.max("n_texts").alias("most"), F.sum("n_texts").alias("texts"))
    slots = checkpoint(slots.where(F.col("texts") >= min_docs))
    # one line of enough texts will do; where lines of few texts come together, their texts are told apart
    several = checkpoint(slots.where(F.col("most") < min_docs).select("leaf", "at", "token"))
    few = checkpoint(tokens.where(F.col("n_texts") < min_docs).join(maybe_broadcast(several), ["leaf", "at", "token"], "left_semi").select("h1", "h2", "leaf", "at", "token"))
    texts = per_text.join(maybe_broadcast(checkpoint(few.select("h1", "h2").distinct())), ["h1", "h2"], "left_semi").select("h1", "h2", "tk")
    apart = few.join(texts, ["h1", "h2"]).groupBy("leaf", "at", "token").agg(F.count_distinct("tk").alias("texts")).where(F.col("texts") >= min_docs)
    constant = slots.where(F.col("most") >= min_docs).select("leaf", "at", "token").unionByName(apart.select("leaf", "at", "token"))
    marked = tokens.join(maybe_broadcast(checkpoint(constant.withColumn("is_constant", F.lit(True)))), ["leaf", "at", "token"], "left")
    slot = F.struct("at", F.when(F.col("is_constant"), F.col("token")).otherwise(F.lit("<*>")).alias("token"))
    return (
        marked.groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.count("is_constant").alias("constants"), F.count("*").alias("n"))
        .where((F.col("constants") >= min_share * F.col("n")) & (F.col("constants") < F.col("n")))
        .withColumn("template", F.array_join(F.transform("slots", lambda s: s["token"]), " "))
        .select("h1", "h2", F.xxhash64("template").alias("t1"), F.xxhash64(F.lit(1), "template").alias("t2"), _is_short(F.col("constants"), F.col("template")).alias("short_template"))
    )


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(did, tk, drop): the positions of the lines to drop, per document that has any.

    did is the doc_id (a fixed low number for null), tk a digest of the text.
    """
    lines = checkpoint(_lines(docs, "did", "tk", "pos", "h1", "h2", "leaf", "is_short"))
    per_text = checkpoint(lines.groupBy("h1", "h2", "leaf", "is_short", "tk").agg(F.min("did").alias("did")))
    distinct = checkpoint(per_text.groupBy("h1", "h2", "leaf").agg(F.count("*").alias("n_texts")))
    general = checkpoint(_templates(docs, distinct, per_text, min_docs, min_share))
    as_template = (
        per_text.join(maybe_broadcast(general), ["h1", "h2"], "left")
        .withColumns({"t1": F.coalesce("t1", "h1"), "t2": F.coalesce("t2", "h2"), "is_short": F.coalesce("short_template", "is_short")})
        .groupBy("t1", "t2", "is_short", "tk")
        .agg(F.min("did").alias("did"))
    )
    recurring = as_template.groupBy("t1", "t2", "is_short").agg(F.count("*").alias("n_texts"), F.min("did").alias("first"))
    recurring = recurring.where(F.col("n_texts") >= F.when(F.col("is_short"), max(min_docs, SHORT_DOCS)).otherwise(min_docs))
    keyed = (
        distinct.select("h1", "h2")
        .join(maybe_broadcast(general), ["h1", "h2"], "left")
        .withColumns({"t1": F.coalesce("t1", "h1"), "t2": F.coalesce("t2", "h2")})
        .join(recurring.select("t1", "t2", "first"), ["t1", "t2"])
    )
    keyed = checkpoint(keyed)
    hits = checkpoint(lines.select("did", "tk", "pos", "h1", "h2").join(maybe_broadcast(keyed), ["h1", "h2"]).drop("h1", "h2"))
    keep = hits.where(F.col("did") == F.col("first")).groupBy("t1", "t2").agg(F.min("tk").alias("keep_tk"))
    keep = hits.where(F.col("did") == F.col("first")).join(keep, ["t1", "t2"]).where(F.col("tk") == F.col("keep_tk")).groupBy("t1", "t2", "did", "tk").agg(F.min("pos").alias("pos"))
    dropped = hits.select("did", "tk", "pos", "t1", "t2").join(keep, ["did", "tk", "pos", "t1", "t2"], "left_anti")
    return dropped.groupBy("did", "tk").agg(F.collect_set("pos").alias("drop"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """All rows and columns of ``docs`` plus clean_text, n_lines and n_dropped.

    Lines end at a line feed. Lines of blanks or of variable fields alone are never dropped. A null
    text stays null and has no lines, an empty one has one line; repeated rows are treated alike; a
    document all of whose lines are dropped gets an empty clean_text. Columns of ``docs`` that bear a
    result column's name are replaced by it.
    """
    text = F.coalesce("text", F.lit(""))
    drops = checkpoint(recurring_lines(docs, min_docs, min_share)).withColumnsRenamed({"did": "__did", "tk": "__tk", "drop": "__drop"})
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    return (
        docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__tk": F.xxhash64(text)})
        .join(drops, ["__did", "__tk"], "left")
        .withColumns(
            {
                "clean_text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(
                    F.array_join(F.transform(F.array(lines), lambda a: F.transform(kept, lambda i: F.get(a, i)))[0], "\n")
                ),
                "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
                "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)),
            }
        )
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
        .drop("__did", "__tk", "__drop")
    )


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their recurring lines dropped; a document of which nothing is left goes."""
    done = drop_recurring(docs)
    gone = (F.col("n_dropped") > 0) & (F.trim(F.coalesce("clean_text", F.lit(""))) == "")
    columns = [F.col("clean_text").alias("text") if c == "text" else F.char_length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return done.where(~gone).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


SQL = r"""
WITH doc AS (SELECT doc_id, text, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, text, pos, ls[pos + 1] AS line FROM (SELECT *, unnest(range(len(ls))) AS pos FROM doc)),
ev AS (SELECT *, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'), ' ') AS even FROM raw),
mk AS (SELECT rid, doc_id, text, pos, regexp_replace(even, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM ev),
tk AS (SELECT *, string_split(masked, ' ') AS ts FROM mk),
el AS (SELECT *, len(ts) AS n, array_to_string(ts[1:3], ' ') AS lead3 FROM tk
  WHERE masked <> '' AND len(ts) > (length(masked) - length(replace(masked, '<*>', ''))) // 3),
dl AS (SELECT masked, n, lead3, any_value(ts) AS ts, count(DISTINCT text) AS n_texts FROM el GROUP BY masked, n, lead3),
live AS (SELECT n, lead3 FROM dl GROUP BY n, lead3 HAVING count(*) > 1 AND sum(n_texts) >= 3),
tok AS (SELECT masked, n, lead3, n_texts, p, ts[p + 1] AS t FROM (SELECT *, unnest(range(len(ts))) AS p FROM dl JOIN live USING (n, lead3))),
occ AS (SELECT text, masked, p, t, tok.n, tok.lead3 FROM (SELECT DISTINCT text, masked FROM el) JOIN tok USING (masked) WHERE t <> '<*>'),
con AS (SELECT n, lead3, p, t, TRUE AS c FROM occ GROUP BY n, lead3, p, t HAVING count(DISTINCT text) >= 3),
gen AS (SELECT masked, string_agg(CASE WHEN c THEN t ELSE '<*>' END, ' ' ORDER BY p) AS template, count(c) AS k, count(*) AS m
  FROM tok LEFT JOIN con USING (n, lead3, p, t) GROUP BY masked),
tm AS (SELECT el.*, coalesce(template, masked) AS tpl FROM el LEFT JOIN (SELECT * FROM gen WHERE k >= 0.8 * m) USING (masked)),
rec AS (SELECT tpl FROM tm GROUP BY tpl HAVING count(DISTINCT text) >=
  CASE WHEN len(string_split(tpl, ' ')) - (length(tpl) - length(replace(tpl, '<*>', ''))) // 3 < 5 AND length(tpl) < 60 THEN 10 ELSE 3 END),
hit AS (SELECT rid, pos, row_number() OVER (PARTITION BY tpl ORDER BY doc_id, pos) AS k FROM tm JOIN rec USING (tpl)),
gone AS (SELECT rid, list(pos) AS ps FROM hit WHERE k > 1 GROUP BY rid)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(ps, []), i - 1)), chr(10)), '')) AS clean_sha256
FROM doc LEFT JOIN gone USING (rid)
"""
